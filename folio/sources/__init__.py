"""Reading text files as documents, and writing chunk rows as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file of a folder as one document; an empty file gives no row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_json(rows: DataFrame, path: str) -> None:
    """Chunk rows as JSON lines, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
