"""Word documents as rows: elements in the order of the body, images, titles, and Markdown.

Only the unpacking runs in Python, per file on Arrow batches; levels of headings, filters, titles and Markdown are column
expressions over what it found. A file that is no Word document gives null elements, so that one bad file stops nothing.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folio.functions.text import base_name, utrim
from folio.session import ship

# Largest document and image, in bytes.
LARGEST, LARGEST_IMAGE = 500 << 20, 200 << 20
# Font sizes in points from which a bold line has the levels 1 to 6; the first ends below 100.
LEVEL_SIZES = (36, 26, 24, 22, 18, 16)
#: Paragraphs among which the title is looked for.
TITLE_WITHIN = 10
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
ELEMENT = "struct<kind: string, text: string, style: string, size: string, size_bold: boolean, bold: boolean, centred: boolean, largest: int, rows: array<array<string>>>"


def relations(xml: bytes) -> dict[str, str]:
    """File name by relation id, for pictures; broken XML gives none."""
    try:
        items = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return {}
    return {r.get("Id", ""): posixpath.basename(r.get("Target", "")) for r in items if any(k in r.get("Type", "") for k in ("image", "picture"))}


def _value(parent, name: str) -> str | None:
    found = parent.find(_W + name) if parent is not None else None
    return None if found is None else found.get(_W + "val", "")


def _run_text(run, files: dict[str, str]) -> str:
    """A run's text, or the placeholder of its drawing's picture, in line before anchored."""
    drawing = run.find(_W + "drawing")
    if drawing is None:
        return "".join(t.text or "" for t in run.findall(_W + "t"))
    for kind in ("inline", "anchor"):
        for blip in drawing.iterfind(f"{_DRAWING}{kind}//{_BLIP}"):
            name = files.get(blip.get(_EMBED, ""))
            return f"{{{{IMAGE:{name}}}}}" if name else ""
    return ""


def _paragraph(p, files: dict[str, str]) -> dict:
    props, runs = p.find(_W + "pPr"), p.findall(_W + "r")
    of = [r.find(_W + "rPr") for r in runs]
    sizes = [(_value(x, "sz"), x.find(_W + "b") is not None) for x in of if x is not None and x.find(_W + "sz") is not None]
    first = sizes[0] if sizes else (None, None)
    return {
        "kind": "paragraph", "text": "".join(_run_text(r, files) for r in runs), "style": _value(props, "pStyle"), "size": first[0], "size_bold": first[1],
        "bold": any(x is not None and x.find(_W + "b") is not None for x in of), "centred": _value(props, "jc") == "center",
        "largest": max((int(s) for s, _ in sizes if s and s.isdigit()), default=None), "rows": None,
    }


def _cell(cell) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(_W + "t")) for p in cell.findall(_W + "p"))


def elements_of(data: bytes) -> list[dict] | None:
    """Paragraphs and tables of a document, in order."""
    if data is None or len(data) > LARGEST:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
            names = set(z.namelist())
            files = relations(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in names else {}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError):
        return None
    out = []
    for e in body if body is not None else ():
        if e.tag == _W + "p":
            out.append(_paragraph(e, files))
        elif e.tag == _W + "tbl":
            rows = [[_cell(c) for c in r.findall(_W + "tc")] for r in e.findall(_W + "tr")]
            wide = len(rows[0]) if rows else 0
            out.append({"kind": "table", "rows": [(r + [""] * wide)[:wide] for r in rows]})
    return out


def images_of(data: bytes) -> list[dict] | None:
    """The pictures of a document; empty, unreadable and huge ones are left out."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                name = posixpath.basename(info.filename)
                if info.filename.startswith("word/media/") and name and 0 < info.file_size <= LARGEST_IMAGE:
                    try:
                        out.append({"id": name, "filename": name, "data": z.read(info)})
                    except (zipfile.BadZipFile, OSError):
                        continue
    except (zipfile.BadZipFile, TypeError):
        return None
    return out


def _unpacked(content: str, f, kind: str) -> Column:
    """What a function makes of the bytes of each file."""

    def run(data: pd.Series) -> pd.Series:
        return pd.Series([f(d) for d in data], dtype=object)

    return pandas_udf(run, kind)(content)


def style_level(style: Column) -> Column:
    """The level that a style's name tells, else 0."""
    named, digits = style.rlike(r"(?i)^(?:heading|标题)"), F.regexp_extract(style, r"(?i)^(?:heading|标题)[\t\n\f\r ]*(\d*)", 1)
    number = lambda c: F.when(c.rlike("^0*[1-6]$"), c.cast("int"))
    return F.coalesce(F.when(named, F.coalesce(number(digits), F.lit(1))), number(style), F.lit(0))


def size_level(size: Column, bold: Column) -> Column:
    """The level of a bold line by its size in half points, else 0."""
    points = F.floor(size.try_cast("int") / 2)
    out = F.when(~F.coalesce(bold, F.lit(False)) | points.isNull() | (points >= 100), 0)
    for level, least in enumerate(LEVEL_SIZES, 1):
        out = out.when(points >= least, level)
    return out.otherwise(0)


def is_contents(style: Column) -> Column:
    low = F.lower(style)
    return F.coalesce(low.rlike(r"^toc\s*0*[1-9]\s*$") | low.rlike(r"^0*1\d$"), F.lit(False))


def paragraph_level(e: Column) -> Column:
    """The level of a paragraph by its style, its first sized run, its own marks, or a number at the head of a bold line."""
    t = utrim(e["text"])
    marks = F.length(F.regexp_extract(t, r"^(#{1,6})(?:[ \t]|\z)", 1))
    numbered = F.when(e["bold"] & (F.octet_length(t) < 100) & t.rlike(r"^\d+\.[\t\n\f\r ]"), 2).otherwise(0)
    sources = (F.coalesce(style_level(e["style"]), F.lit(0)), size_level(e["size"], e["size_bold"]), marks, numbered)
    return F.coalesce(*(F.nullif(x, F.lit(0)) for x in sources), F.lit(0)).cast("int")


def documents(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds elements: the paragraphs, without those of a table of contents, and tables of each document with their level; and
    title: the first of the first paragraphs that is centred and looks like one."""
    rows = files.withColumn("_raw", _unpacked(content, elements_of, f"array<{ELEMENT}>"))
    paragraphs = F.slice(F.filter("_raw", lambda e: e["kind"] == "paragraph"), 1, TITLE_WITHIN)
    like_title = lambda e: (style_level(e["style"]) > 0) | e["bold"] | (F.coalesce(e["largest"], F.lit(0)) >= 36)
    titles = F.filter(paragraphs, lambda e: ~is_contents(e["style"]) & (utrim(e["text"]) != "") & e["centred"] & like_title(e))
    kept = F.filter("_raw", lambda e: (e["kind"] == "table") | ~is_contents(e["style"]))
    leveled = F.transform(kept, lambda e: F.struct(e["kind"].alias("kind"), F.when(e["kind"] == "table", 0).otherwise(paragraph_level(e)).alias("level"), e["text"].alias("text"), e["rows"].alias("rows")))
    return rows.withColumn("elements", leveled).withColumn("title", F.coalesce(utrim(F.get(titles, F.lit(0))["text"]), F.lit(""))).drop("_raw")


def table_markdown(rows: Column) -> Column:
    """A pipe table as wide as its first row; bars are escaped, line breaks stay."""
    wide = F.size(rows[0])
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    filled = lambda r: F.transform(F.sequence(F.lit(1), wide), lambda k: F.replace(F.coalesce(F.try_element_at(r, k), F.lit("")), F.lit("|"), F.lit("\\|")))
    body = F.transform(rows, lambda r, i: F.concat(line(filled(r)), F.when(i == 0, line(F.transform(F.sequence(F.lit(1), wide), lambda k: F.lit("---")))).otherwise("")))
    return F.when((F.size(rows) > 0) & (wide > 0), F.array_join(body, "")).otherwise("")


def markdown(elements: Column) -> Column:
    """The elements of a document as Markdown."""
    heading = lambda e: F.when(e["level"] > 0, F.concat(F.repeat(F.lit("#"), e["level"]), F.lit(" "))).otherwise("")
    one = lambda e: F.when(e["kind"] == "table", F.concat(table_markdown(e["rows"]), F.lit("\n"))).otherwise(F.concat(heading(e), e["text"], F.lit("\n\n")))
    return F.array_join(F.transform(elements, one), "")


def saved_name(name: Column, data: Column, prefix: str = "", unique: bool = False) -> Column:
    """The name under which an image is written: its own, or one made of its bytes, behind the last part of the prefix."""
    own = base_name(name)
    ending = F.regexp_extract(own, r"(\.[^.]*)$", 1)
    return F.concat(F.lit(posixpath.basename(prefix)), F.concat(F.substring(F.sha2(data, 256), 1, 32), ending) if unique else own)


def images(files: DataFrame, key: str = "path", content: str = "content", prefix: str = "", unique: bool = False) -> DataFrame:
    """(key, id, filename, saved, data): the pictures of documents."""
    rows = files.select(key, F.inline(_unpacked(content, images_of, "array<struct<id: string, filename: string, data: binary>>")))
    return rows.select(key, "id", "filename", saved_name(F.col("filename"), F.col("data"), prefix, unique).alias("saved"), "data")


def with_image_links(rows: DataFrame, names: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """Placeholders {{IMAGE:id}} in texts as links to the saved images (key, id, saved); unknown ones stay. The images of a
    document travel as one map."""
    maps = names.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("id", "saved"))).alias("_names"))
    parts = F.split(F.col(text), r"(?=\{\{IMAGE:[^}]+\}\})|(?<=\}\})", -1)
    known = lambda p: F.try_element_at(F.col("_names"), F.regexp_extract(p, r"^\{\{IMAGE:([^}]+)\}\}$", 1))
    linked = F.array_join(F.transform(parts, lambda p: F.coalesce(F.concat(F.lit("![]("), known(p), F.lit(")")), p)), "")
    return rows.join(maps, key, "left").withColumn(text, F.when(F.col(text).isNull(), None).otherwise(linked)).drop("_names")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, elements, title, content) of the Word files of a folder."""
    ship(spark)
    return documents(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content"))
