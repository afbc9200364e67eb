"""Markdown to chunk rows, and the second cut of long chunks with an overlap that keeps tables and links whole."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folio.functions.text import HEADING, clean_special, heading_level, heading_title, is_dot_leader, is_toc_content, sentence_split, utrim

# Bounds of a chunk's limit, and the limit of the second pass.
LEAST, MOST, SECOND = 50, 100_000, 4_096
# Separators of the overlapping cut, the best first.
SEPARATORS = ("\n\n", "\n", "。", ". ", "！", "！ ", "？", "？ ", "; ", "；", " ")
# What is kept whole.
TABLE = r"(?:\|[^\n]+\|\n\|[-| ]+\|\n(?:\|[^\n]+\|\n?)+)"
LINK = r"!?\[[^\]]*\]\([^)]+\)"
_PLACE = re.compile(r"<<.*?>>", re.S)


def section_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, sec_no, level, title, body): a row for what stands before the first heading and for each heading with the lines
    up to the next one. A document is cut inside its row, so nothing is shuffled."""
    t = F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\0"), F.lit(""))
    # a line break goes in front, so that a heading in the first line is found like any other
    parts = F.split(F.concat(F.lit("\n"), t), rf"\n(?={HEADING[1:]})", -1)
    rows = docs.select(key, F.posexplode(parts).alias("sec_no", "part"))
    first = F.when(F.col("sec_no") > 0, F.substring_index("part", "\n", 1))
    body = F.when(F.col("sec_no") > 0, F.expr("substring(part, length(head) + 2)")).otherwise(F.col("part"))
    return rows.withColumn("head", first).select(key, "sec_no", F.coalesce(heading_level(F.col("head")), F.lit(0)).alias("level"), heading_title(F.col("head")).alias("title"), body.alias("body"))


def _blocks(body: Column, preamble: Column) -> Column:
    """The blocks of a section: one, or in front of the first heading one between blank lines."""
    lines = F.filter(F.transform(F.split(body, "\n", -1), lambda x: F.struct(x.alias("raw"), utrim(x).alias("t"))), lambda x: ~is_toc_content(x["t"]))
    whole = F.array_join(F.transform(F.filter(lines, lambda x: x["t"] != ""), lambda x: x["raw"]), "\n")
    parts = F.split(F.array_join(F.transform(lines, lambda x: F.when(x["t"] == "", "").otherwise(x["raw"])), "\n"), "\n\n+")
    return F.filter(F.transform(F.when(preamble, parts).otherwise(F.array(whole)), utrim), lambda b: b != "")


def ancestry(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds chain, the titles of the headings above and at each section, and next_level. A heading is an ancestor if it comes
    after the last heading of every shallower level."""
    order = Window.partitionBy(key).orderBy("sec_no")
    step = sections.withColumns({f"p{k}": F.last(F.when(F.col("level") == k, F.struct("sec_no", "title")), ignorenulls=True).over(order) for k in range(1, 7)})
    step = step.withColumn("next_level", F.lead("level").over(order))
    kept = []
    for k in range(1, 7):
        above = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"p{j}.sec_no"), F.lit(-1)) for j in range(1, k))) if k > 1 else F.lit(-1)
        kept.append(F.when(F.col(f"p{k}.sec_no") > above, F.col(f"p{k}.title")))
    return step.withColumn("chain", F.filter(F.array(*kept), lambda x: x.isNotNull())).drop(*(f"p{k}" for k in range(1, 7)))


def _without_toc(c: Column) -> Column:
    return utrim(F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~is_dot_leader(utrim(x))), "\n"))


def markdown_chunks(docs: DataFrame, limit: int = 4_096, with_filter: bool = True, filter_toc: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The chunk rows of Markdown documents: (key, chunk_no, title, content, keywords, parent_chain, level, originlevel,
    parentindex, parent_trunk_id_kwd).

    Defined results: a null text gives no chunk; a heading with neither text nor headings below it is a chunk of its own,
    under its parents; lines of a table of contents are dropped; keywords stay null."""
    limit = min(max(limit, LEAST), MOST)
    rows = section_rows(docs.where(F.col(text).isNotNull()), text, key)
    rows = rows.withColumn("blocks", _blocks(F.col("body"), F.col("sec_no") == 0)).drop("body")
    rows = ancestry(rows, key)
    pieces = F.flatten(F.transform("blocks", lambda b: sentence_split(b, limit)))
    clean = F.transform(pieces, clean_special) if with_filter else pieces
    clean = F.flatten(F.transform(clean, lambda b: F.when(F.length(b) > SECOND, sentence_split(b, SECOND)).otherwise(F.array(b)))) if limit > SECOND else clean
    clean = F.transform(clean, _without_toc) if filter_toc else clean
    alone = (F.col("level") > 0) & (F.size("blocks") == 0) & (F.coalesce(F.col("next_level"), F.lit(0)) <= F.col("level"))
    above = F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0)))
    rows = rows.select(key, "sec_no", F.when(alone, F.array("title")).otherwise(clean).alias("contents"), F.when(alone, above).otherwise(F.col("chain")).alias("chain"), F.when(alone, F.col("level") - 1).otherwise(F.col("level")).alias("originlevel"))
    rows = rows.select(key, "sec_no", "chain", "originlevel", F.posexplode("contents").alias("piece_no", "content")).where("content != ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("sec_no", "piece_no")) - 1
    return rows.select(
        key, number.alias("chunk_no"), F.array_join("chain", " ").alias("title"), "content", F.lit(None).cast("array<string>").alias("keywords"), F.when(F.size("chain") > 0, F.col("chain")).alias("parent_chain"),
        F.size("chain").alias("level"), "originlevel", F.lit(0).alias("parentindex"), F.lit("").alias("parent_trunk_id_kwd"),
    )


class Chunker:
    """Cuts texts into pieces of about ``size`` code points that share up to ``overlap``; tables and links stay whole, for
    which a piece may be longer, as may the last one."""

    def __init__(self, size: int, overlap: int = 0):
        self.size = max(size, LEAST)
        self.overlap = min(max(overlap, 0), self.size // 2)
        self.least = self.size - self.overlap

    def protected(self, text: str) -> tuple[str, dict[str, str]]:
        """The text with a placeholder for each table and then each link, and what the placeholders stand for."""
        known: dict[str, str] = {}
        for name, pattern in (("TABLE", TABLE), ("LINK", LINK)):
            count = iter(range(len(text)))

            def put(m: re.Match, name=name, count=count) -> str:
                place = f"<<{name}_{next(count)}>>"
                known[place] = m.group()
                return place

            text = re.sub(pattern, put, text)
        return text, known

    @staticmethod
    def restored(text: str, known: dict[str, str]) -> str:
        """Tables may hold the placeholders of links."""
        for kind in ("<<T", "<<L"):
            text = re.sub(r"<<(?:TABLE|LINK)_\d+>>", lambda m: known.get(m.group(), m.group()) if m.group().startswith(kind) else m.group(), text)
        return text

    def cut(self, text: str) -> int:
        """Where the first piece of a text ends."""
        if len(text) <= self.size:
            return len(text)
        closed = [m.span() for m in _PLACE.finditer(text)]
        end = self.size
        for a, b in closed:
            if a < end < b:
                end = b
        closed = [s for s in closed if s[0] < end]
        for sep in SEPARATORS:
            at = end
            while (at := text.rfind(sep, end // 2, at)) >= 0:
                if not any(a <= at < b or a <= at + len(sep) - 1 < b for a, b in closed):
                    return at + len(sep)
                at += len(sep) - 1
        return min(end, len(text))

    def shared(self, piece: str) -> str:
        """The end of a piece that the next one begins with; a placeholder is taken whole."""
        start = len(piece) - self.overlap
        for a, b in (m.span() for m in _PLACE.finditer(piece)):
            if a < start < b:
                start = a
        return piece[max(start, 0) :]

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.size:
            return [text]
        rest, known = self.protected(text)
        out: list[str] = []
        # as many pieces as the shorter of both texts needs; what is left then is one more
        for _ in range(-(-min(len(text), len(rest) or len(text)) // self.least)):
            if not rest:
                break
            at = self.cut(rest)
            piece, rest = rest[:at], rest[at:]
            out.append(piece)
            if self.overlap and rest and len(piece) > self.overlap:
                rest = self.shared(piece) + rest
        return [self.restored(p, known) for p in ([*out, rest] if rest else out)]


def overlapping(text: Column, size: int, overlap: int = 0) -> Column:
    """array<string>: the pieces of a text; null gives null."""

    @pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        chunker = Chunker(size, overlap)
        return pd.Series([None if v is None else chunker.pieces(v) for v in values], dtype=object)

    return run(text)


def split_large(chunks: DataFrame, size: int, overlap: int = 0, link: bool = False, key: str = "doc_id") -> DataFrame:
    """Chunk rows whose long contents are cut again. Rows that are cut lose originlevel and parent_trunk_id_kwd; parentindex
    is the number of the row they come from if ``link`` is set. Only long contents go through Python."""
    long = F.length("content") > size
    rows = chunks.withColumn("_long", long).withColumn("_parts", F.when(long, overlapping(F.when(long, F.col("content")), size, overlap)).otherwise(F.array("content")))
    rows = rows.withColumn("_from", F.col("chunk_no")).select("*", F.posexplode("_parts").alias("_part", "_content"))
    rows = rows.withColumn("content", F.when(F.col("_long"), utrim(F.col("_content"))).otherwise(F.col("content"))).where("not _long or content != ''")
    rows = rows.withColumn("originlevel", F.when(F.col("_long"), 0).otherwise(F.col("originlevel"))).withColumn("parent_trunk_id_kwd", F.when(F.col("_long"), "").otherwise(F.col("parent_trunk_id_kwd")))
    if link:
        rows = rows.withColumn("parentindex", F.col("_from"))
    rows = rows.withColumn("chunk_no", F.row_number().over(Window.partitionBy(key).orderBy("_from", "_part")) - 1)
    return rows.drop("_long", "_parts", "_from", "_part", "_content")


def json_arrays(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): the chunk rows of each document as one JSON array, nulls kept."""
    names = ("title", "content", "keywords", "parent_chain", "level", "originlevel", "parentindex", "parent_trunk_id_kwd")
    named = F.struct(*(F.col(n).alias({"originlevel": "originLevel", "parentindex": "parentIndex"}.get(n, n)) for n in names))
    rows = chunks.select(key, "chunk_no", named.alias("row")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "row"))).alias("rows"))
    return rows.select(key, F.to_json(F.transform("rows", lambda x: x["row"]), {"ignoreNullFields": "false"}).alias("json"))


def run_summary(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, segments, chars, tables, images): what a run made of each document."""
    c = F.col("content")
    return chunks.groupBy(key).agg(F.count("*").alias("segments"), F.sum(F.length(c)).alias("chars"), F.sum(c.startswith("|").cast("int")).alias("tables"), F.sum(F.regexp_count(c, F.lit(r"!\[[^\]]*\]\("))).alias("images"))
