"""Problem 2: one consistent form for text that looks the same but is stored in other characters.

The form is the compatibility normalisation in composed form, with mapped white space and hyphens, without
default-ignorable characters, and with look-alike letters of other scripts written as one letter. Raised, circled and
fraction characters stay as they are, since a reader tells them from plain digits; so does letter case, unless full
case folding is asked for (``fold``). Case folding gives the blocks in which records are compared; the form that keeps
the case decides. The conversion runs on batches, once per distinct value.

Pairs are made between the distinct spellings of a form and then joined with their records, so equal records never
meet each other.

Defined results: null gives null; an empty text gives an empty text; blank chunks are no case (a reader sees no text),
while two overprinted blank glyphs are; records delivered twice count once; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folio.session import table

#: Distance, in points, up to which two glyphs lie over one another.
NEAR = 0.5
#: Side of the squares into which a page is cut for finding near glyphs.
SQUARE = 4.0

# Letters that look like a Latin letter (or, last line, like a Cyrillic one), and the letter they look like.
LOOKS = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "Г": "Γ", "П": "Π", "Ф": "Φ", "п": "π", "ф": "φ",
}
# Hyphens that look like the ASCII one, and compatibility characters that a reader tells from their mapping.
HYPHENS = "‐‑−﹣－˗⁃"
KEPT = "ſ"
SEEN_TAGS = ("<super>", "<sub>", "<circle>", "<fraction>")
# Default-ignorable characters outside the general category Cf.
IGNORED = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Format characters that are seen.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࣢࢐࢑\U000110bd\U000110cd"


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], dict[int, str]]:
    """By code point: what to write before decomposition, and what after it."""
    first: dict[int, str] = {}
    for n in range(128, sys.maxunicode + 1):
        if 0xD800 <= n < 0xF900 or 0x30000 <= n < 0xE0000 or n >= 0xE0200:
            continue
        c = chr(n)
        kind, tag = unicodedata.category(c), unicodedata.decomposition(c)
        if c in IGNORED or (kind == "Cf" and c not in VISIBLE_FORMAT) or 0xFE00 <= n <= 0xFE0F or 0xE0000 <= n <= 0xE0FFF:
            first[n] = ""
        elif kind == "Zs":
            first[n] = " "
        elif kind in ("Zl", "Zp") or n == 0x85:
            first[n] = "\n"
        elif c in HYPHENS:
            first[n] = "-"
        elif tag.startswith("<") and not tag.startswith(SEEN_TAGS) and c not in KEPT:
            plain = unicodedata.normalize("NFKC", c)
            if not plain.startswith(" "):
                # a square sign shows its digits raised
                first[n] = plain.translate({ord("2"): "²", ord("3"): "³"}) if tag.startswith("<square>") else plain
    first |= {9: " ", 11: "\n", 12: "\n"}
    after = {ord(c): like for like, cs in LOOKS.items() for c in cs}
    return first, after


def form(text: str, fold: bool = False) -> str:
    """The consistent form of one text."""
    if text.isascii():
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        out = text.translate({9: " ", 11: "\n", 12: "\n"}) if any(c in text for c in "\t\x0b\x0c") else text
    else:
        first, after = _tables()
        text = unicodedata.normalize("NFD", text.replace("\r\n", "\n").replace("\r", "\n").translate(first))
        # composed and decomposed look-alikes meet: letters are mapped while the accents stand apart
        out = unicodedata.normalize("NFC", text.translate(after))
    if fold:
        out = unicodedata.normalize("NFC", out.casefold())
    return out


def _by_value(values: pd.Series, f) -> pd.Series:
    known: dict[str, str] = {}
    out = []
    for v in values:
        if v is None:
            out.append(None)
            continue
        if v not in known:
            known[v] = f(v)
        out.append(known[v])
    return pd.Series(out, dtype=object)


def consistent(text: Column, fold: bool = False) -> Column:
    """The consistent form of a text column."""

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return _by_value(values, lambda v: form(v, fold))

    return run(text)


def _digests(texts: pd.Series) -> pd.DataFrame:
    """Of each text: a hash of its folded form, for blocking, and the digest of its form; nulls where it is blank."""
    known: dict[str, tuple] = {}
    out = []
    for t in texts:
        if t not in known:
            seen = form(t).strip()
            fold = unicodedata.normalize("NFC", seen.casefold()).encode("utf-8", "surrogatepass")
            known[t] = (xxhash.xxh64_intdigest(fold) >> 1, hashlib.md5(seen.encode("utf-8", "surrogatepass")).digest()) if seen else (None, None)
        out.append(known[t])
    return pd.DataFrame({"block": pd.array([b for b, _ in out], "Int64"), "form": pd.Series([f for _, f in out], dtype=object)})


def spelled_apart(records: DataFrame) -> DataFrame:
    """(id_a, id_b) of records (id, raw, block, form) with one block and form but different raw texts."""
    # a few dozen bytes a record; each of the joins below would make the forms again
    records = records.dropDuplicates(["id"]).persist(StorageLevel.MEMORY_AND_DISK)
    spellings = records.groupBy("block", "form", "raw").agg(F.lit(1).alias("one")).drop("one")
    ours, theirs = spellings.withColumnRenamed("raw", "raw_a"), spellings.withColumnRenamed("raw", "raw_b")
    couples = ours.join(theirs, ["block", "form"]).where("raw_a < raw_b")
    left = records.select("block", "form", F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    right = records.select("block", "form", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    out = couples.join(left, ["block", "form", "raw_a"]).join(right, ["block", "form", "raw_b"])
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def alike_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_a, id_b) of the records whose whole texts look the same but differ. Texts are compared by 128-bit digests."""
    step = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    step = step.select("id", F.unhex(F.md5("t")).alias("raw"), pandas_udf(_digests, "block bigint, form binary")("t").alias("d")).where("d.block is not null")
    return spelled_apart(step.select("id", "raw", "d.block", "d.form"))


def alike_glyphs(glyphs: DataFrame, near: float = NEAR) -> DataFrame:
    """(id_a, id_b) of the glyphs of one page that lie over one another and look the same but differ."""
    step = glyphs.where(F.col("text").isNotNull() & F.col("glyph_id").isNotNull()).select("glyph_id", "doc_id", "page_num", "text", "ox", "oy", consistent(F.col("text")).alias("form"))
    step = step.where("form != ''")
    mixed = step.groupBy("doc_id", "page_num", "form").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least < most").drop("least", "most")
    step = step.join(mixed, ["doc_id", "page_num", "form"])
    square = lambda c: F.floor(c / SQUARE).cast("int")
    ours = step.withColumn("sx", square(F.col("ox"))).withColumn("sy", square(F.col("oy")))
    theirs = step.select("doc_id", "page_num", "form", F.col("glyph_id").alias("id_b"), F.col("text").alias("text_b"), F.col("ox").alias("bx"), F.col("oy").alias("by"))
    theirs = theirs.withColumn("sx", F.explode(F.sequence(square(F.col("bx") - near), square(F.col("bx") + near)))).withColumn("sy", F.explode(F.sequence(square(F.col("by") - near), square(F.col("by") + near))))
    # a little more than near, so that sums of decimal fractions don't decide
    close = (F.pow(F.col("ox") - F.col("bx"), 2) + F.pow(F.col("oy") - F.col("by"), 2)) <= (near + 1e-9) ** 2
    out = ours.join(theirs, ["doc_id", "page_num", "form", "sx", "sy"]).where(close & (F.col("glyph_id") < F.col("id_b")) & (F.col("text") != F.col("text_b")))
    return out.select(F.col("glyph_id").alias("id_a"), "id_b").distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = alike_texts(table(spark, folder, "chunks"), "chunk_id", "content").select(F.lit("chunks").alias("src_table"), "id_a", "id_b")
    return chunks.unionByName(alike_glyphs(table(spark, folder, "glyphs")).select(F.lit("glyphs").alias("src_table"), "id_a", "id_b"))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk's content in the consistent form, and whether that changed it."""
    rows = table(spark, folder, "chunks").select("chunk_id", "content").dropDuplicates(["chunk_id"])
    return rows.select("chunk_id", consistent(F.col("content")).alias("form")).join(rows, "chunk_id").select("chunk_id", "form", (~F.col("form").eqNullSafe(F.col("content"))).alias("changed"))


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms}
ORACLE: dict[str, str] = {}
