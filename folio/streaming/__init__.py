"""Files that arrive in a folder, unpacked as they come: stateless, so that nothing has to be kept between batches. What
looks at whole documents or the whole collection (running lines, tiers, contents) stays a batch over the written rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.operators.chunks import markdown_chunks
from folio.session import ship
from folio.sources import docx, pdf

FILE = "path string, modificationTime timestamp, length long, content binary"


def files(spark: SparkSession, folder: str, ending: str, per_batch: int = 1_000) -> DataFrame:
    """The files of a folder as a stream, so many a batch."""
    ship(spark)
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", f"*{ending}").option("maxFilesPerTrigger", per_batch).load(folder).select("path", "content")


def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row a page of the PDF files that arrive."""
    return pdf.from_bytes(files(spark, folder, ".pdf"))


def word_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, markdown) of the Word files that arrive."""
    rows = docx.documents(files(spark, folder, ".docx"))
    return rows.select("path", "title", docx.markdown(rows["elements"]).alias("markdown"))


def write(stream: DataFrame, folder: str, state: str, each: Callable[[DataFrame], DataFrame] = lambda batch: batch):
    """Writes a stream as Parquet, a batch at a time and each batch once by its number; ``each`` may be a batch operator, such
    as cutting into chunks. Ends when all that is there was read."""

    def one(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()


def chunks_of(batch: DataFrame) -> DataFrame:
    """The chunk rows of a batch of (path, title, markdown)."""
    return markdown_chunks(batch.drop("title"), text="markdown", key="path")
