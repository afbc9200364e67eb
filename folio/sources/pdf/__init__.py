"""PDF files as tables: pages, glyphs, rectangles, segments and images, and the documents made of them.

Files are unpacked in Python, one row a page, on Arrow batches; everything after that is the page operators of this engine.
A page that can't be read is left out, a file that can't be read gives one row with its error (or stops the job: FAILFAST).
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

from folio.operators import layout, markdown, tables
from folio.operators.geometry import turned
from folio.session import checkpointed, ship
from folio.sources.pdf.content import Resources, interpreted
from folio.sources.pdf.objects import IMAGE_FILTERS, Document, Page, PdfError, Stream

# Fixed value: largest image, in bytes.
LARGEST_IMAGE = 100 << 20
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
GLYPH = f"struct<seq_no: int, text: string, ox: double, oy: double, bbox: {BOX}, font_name: string, font_size: double, advance: double, form_obj: int, visual_size: double, clipped: boolean>"
IMAGE = f"struct<obj_nr: int, width: int, height: int, format: string, data: binary, bbox: {BOX}>"
PAGE = f"page_num int, width double, height double, rotate int, glyphs array<{GLYPH}>, rects array<{BOX}>, segments array<{BOX}>, images array<{IMAGE}>, error string"
SIDES = ("x0", "y0", "x1", "y1")


def _png(width: int, height: int, colors: int, data: bytes) -> bytes:
    rows = b"".join(b"\0" + data[k * width * colors : (k + 1) * width * colors] for k in range(height))
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if colors == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def _image(doc: Document, stream: Stream) -> tuple[str, bytes] | None:
    """Format and bytes of an image; plain pixels of one or three colours are written as PNG, others are left out."""
    try:
        data = doc.decoded(stream)
    except (PdfError, ValueError):
        return None
    coded = [IMAGE_FILTERS[n] for n, _ in doc.filters(stream) if n in IMAGE_FILTERS]
    if coded:
        return coded[-1], data
    width, height, bits = (int(doc.get(stream.props.get(k)) or 0) for k in ("Width", "Height", "BitsPerComponent"))
    colors = len(data) // (width * height) if width * height else 0
    return ("png", _png(width, height, colors, data)) if bits == 8 and colors in (1, 3) else None


def page_row(resources: Resources, page: Page, with_images: bool) -> dict:
    """A page as a row, in page space."""
    found = interpreted(resources, page)
    side = lambda values: dict(zip(SIDES, values))
    images = []
    if with_images:
        places = {number: box for _, number, box in found.placements}  # the last place of an image counts
        for name, stream in resources.objects(page.resources, "Image").items():
            if len(stream.raw) <= LARGEST_IMAGE and (read := _image(resources.doc, stream)) and read[1]:
                width, height = (int(resources.doc.get(stream.props.get(k)) or 0) for k in ("Width", "Height"))
                images.append({"obj_nr": stream.number, "width": width, "height": height, "format": read[0], "data": read[1], "bbox": side(places[stream.number]) if stream.number in places else None})
    return {"page_num": page.number, "width": page.width, "height": page.height, "rotate": page.rotate, "glyphs": found.glyphs, "rects": [side(r) for r in found.rects], "segments": [side(s) for s in found.segments], "images": images, "error": None}


def read_pages(data: bytes, wanted: tuple[int, ...] | None = None, with_images: bool = False, fail: bool = False) -> Iterator[dict]:
    """The rows of a file's pages, all or those wanted; numbers that don't exist are passed over."""
    blank = {"page_num": None, "width": None, "height": None, "rotate": None, "glyphs": None, "rects": None, "segments": None, "images": None}
    try:
        doc = Document(bytes(data))
        resources, pages = Resources(doc), doc.pages
    except (PdfError, ValueError, TypeError, RecursionError) as e:
        if fail:
            raise
        yield {**blank, "error": str(e)}
        return
    for number in wanted if wanted is not None else range(1, len(pages) + 1):
        if 1 <= number <= len(pages):
            try:
                yield page_row(resources, pages[number - 1], with_images)
            except (PdfError, ValueError, TypeError, ArithmeticError, RecursionError) as e:
                if fail:
                    raise
                yield {**blank, "page_num": number, "error": str(e)}


def from_bytes(files: DataFrame, pages: tuple[int, ...] | None = None, images: bool = False, mode: str = "PERMISSIVE", content: str = "content") -> DataFrame:
    """One row a page of the files: their columns, without the content, and page_num, width, height, rotate, glyphs, rects,
    segments, images, error. A row with an error has no other values but the page's number, if known."""
    @pandas_udf(f"array<struct<{', '.join(_typed(PAGE))}>>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else list(read_pages(v, pages, images, mode == "FAILFAST")) for v in values], dtype=object)

    return files.withColumn("_p", run(content)).drop(content).select("*", F.inline("_p")).drop("_p")


def _typed(schema: str) -> list[str]:
    """Fields of a schema, written as those of a struct."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = schema[start:k].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = k + 1
    return out


class PdfSource(DataSource):
    """``spark.read.format("pdf").load(glob)``: one row a page, with the file's path. Options: pages (comma-separated numbers),
    images (true), mode (FAILFAST), pages_per_task. A large file is cut into tasks of so many pages."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return "path string, " + PAGE

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)


class Part(InputPartition):
    def __init__(self, path: str, pages: tuple[int, ...] | None):
        self.path, self.pages = path, pages


class PdfReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[Part]:
        path = self.options.get("path", "")
        files = sorted(glob.glob(path) if not os.path.isdir(path) else glob.glob(os.path.join(path, "*.pdf")))
        wanted = self.options.get("pages")
        if not wanted:
            return [Part(f, None) for f in files]
        numbers, size = [int(x) for x in wanted.split(",")], int(self.options.get("pages_per_task", 50))
        return [Part(f, tuple(numbers[k : k + size])) for f in files for k in range(0, len(numbers), size)]

    def read(self, part: Part):
        with open(part.path, "rb") as f:
            data = f.read()
        for row in read_pages(data, part.pages, str(self.options.get("images", "false")).lower() == "true", self.options.get("mode") == "FAILFAST"):
            yield (part.path, *(row[f.split(":")[0]] for f in _typed(PAGE)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PdfSource)


class PdfTables:
    """The tables of a DataFrame of pages (path, page_num, ...): each is a plan of its own, so that what isn't asked for isn't
    made. Pages are in visual space. Files are unpacked once, and what several plans read (pages, glyphs, tables, lines) is
    persisted on the executors' disks until ``release``, or checkpointed."""

    def __init__(self, pages: DataFrame):
        self._held: dict[str, DataFrame] = {}
        pages = self._hold("pages", lambda: pages)
        # a path is a document; its hash is the key that the page operators group by
        self.raw = pages.where("error is null").withColumn("doc_id", F.xxhash64("path"))
        turn = F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(360)).isin(90, 270)
        self.sizes = self.raw.select("doc_id", "page_num", "rotate", "width", "height")
        self.pages = self.raw.select("doc_id", "path", "page_num", F.when(turn, F.col("height")).otherwise(F.col("width")).alias("width"), F.when(turn, F.col("width")).otherwise(F.col("height")).alias("height"))
        self.errors = pages.where("error is not null").select("path", "page_num", "error")

    def _hold(self, name: str, make: Callable[[], DataFrame], cut: bool = False) -> DataFrame:
        """Persisted or, where plans would grow out of hand (a table is read in several places by all that follows), written
        to the shared checkpoint folder."""
        if name not in self._held:
            self._held[name] = checkpointed(make()) if cut else make().persist(StorageLevel.DISK_ONLY)
        return self._held[name]

    def release(self) -> None:
        for df in self._held.values():
            df.unpersist()

    def _items(self, column: str) -> DataFrame:
        return self.raw.select("doc_id", "page_num", F.inline(column))

    def glyphs(self) -> DataFrame:
        """Without blank layers under others; the advance is the width of the box."""
        rows = turned(self._items("glyphs"), self.sizes, {"ox": "oy"}, ("bbox",)).withColumn("advance", F.col("bbox.x1") - F.col("bbox.x0"))
        return self._hold("glyphs", lambda: layout.without_doubled(rows), cut=True)

    def _boxes(self, column: str) -> DataFrame:
        rows = self.raw.select("doc_id", "page_num", F.explode(column).alias("bbox"))
        return self._hold(column, lambda: turned(rows, self.sizes, {}, ("bbox",)).select("doc_id", "page_num", "bbox.*"))

    def segments(self) -> DataFrame:
        return self._hold("segments", lambda: turned(self._items("segments"), self.sizes, {"x0": "y0", "x1": "y1"}))

    def cells(self, settings: tables.Settings = tables.Settings()) -> DataFrame:
        """(doc_id, page_num, x0, y0, x1, y1) of the cells that ruling lines make."""
        keyed = lambda df: df.select(F.struct("doc_id", "page_num").alias("page"), *(c for c in df.columns if c not in ("doc_id", "page_num")))
        edges = self._hold("edges", lambda: tables.ruled_edges(keyed(self._boxes("rects")), keyed(self.segments()), keyed(self.pages.drop("path")), settings))
        # the points meet each other four times
        points = self._hold("points", lambda: tables.crossing_points(edges, settings.cross))
        return self._hold("cells", lambda: tables.cells(points, settings.cell).select("page.*", "x0", "y0", "x1", "y1"), cut=True)

    def tables(self) -> DataFrame:
        return self._hold("tables", lambda: tables.table_cells(self.cells(), self.glyphs()), cut=True)

    def lines(self, with_tables: bool = True) -> DataFrame:
        """The lines of text, outside of the tables where these are asked for."""
        if not with_tables:
            return self._hold("all lines", lambda: layout.text_lines(self.glyphs()), cut=True)
        return self._hold("lines", self._lines, cut=True)

    def _lines(self) -> DataFrame:
        found = self.tables().where("x1 > x0")
        rows = layout.text_lines(tables.outside_tables(self.glyphs(), found.select("doc_id", "page_num", "x0", "y0", "x1", "y1")))
        places = found.select("doc_id", "page_num", F.col("t_y0").alias("y0"), F.col("t_y1").alias("y1")).distinct()
        # the parts of a cut box become boxes of their own
        return layout.split_at_tables(rows, places).withColumn("box_no", F.col("box_no") * 1_000 + F.col("part")).drop("part")

    def images(self) -> DataFrame:
        """(doc_id, page_num, obj_nr, width, height, format, data, bbox): pictures with the place where they stand, if any."""
        return self._hold("images", lambda: turned(self._items("images"), self.sizes, {}, ("bbox",)))

    def markdown(self, with_tables: bool = True, with_images: bool = False, names: DataFrame | None = None) -> DataFrame:
        """(doc_id, markdown). names: (doc_id, page_num, obj_nr, saved) of the images that were written."""
        others = []
        if with_tables:
            found = self.tables()
            head = found.groupBy("doc_id", "page_num", "table_no").agg(F.first("t_y0").alias("y0"))
            written = tables.tables_markdown(found, "doc_id", "page_num", "table_no")
            others.append(written.join(head, ["doc_id", "page_num", "table_no"]).select("doc_id", "page_num", F.lit("table").alias("kind"), F.col("table_no").alias("no"), "y0", "markdown"))
        if with_images:
            pictures = self.images()
            pictures = pictures.join(names, ["doc_id", "page_num", "obj_nr"], "left") if names is not None else pictures.withColumn("saved", F.lit(None).cast("string"))
            others.append(pictures.select("doc_id", "page_num", F.lit("image").alias("kind"), F.col("obj_nr").alias("no"), F.coalesce("bbox.y0", F.lit(0.0)).alias("y0"), markdown.image_markdown(F.col("saved"), (F.col("page_num") - 1).cast("string")).alias("markdown")))
        extra = others[0] if others else None
        for more in others[1:]:
            extra = extra.unionByName(more)
        return markdown.pages_markdown(self.lines(with_tables), extra)

    def titles(self) -> DataFrame:
        return layout.document_title(self.lines(False), self.pages)


def read(spark: SparkSession, path: str, pages: tuple[int, ...] | None = None, images: bool = False, mode: str = "PERMISSIVE") -> PdfTables:
    """The tables of the PDF files of a folder, read by Spark's own file source."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return PdfTables(from_bytes(files, pages, images, mode))
