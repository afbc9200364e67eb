"""Problem 3: oversized items cut at natural boundaries, by pointer doubling.

Every place of an item (each code point) is a node. Its successor is the farthest place at which a piece that starts
``overlap`` code points before it may end: the last paragraph end in the farther half of the piece, else the last
sentence end there, else the last white space, else the last such boundary in the nearer half that gets ahead, else the
last place that doesn't part a character from its marks. The
successors of all places of a batch are found with sorted searches at once; squaring the successor table and adding
the places reached doubles the number of cuts known in each round, so an item with n pieces takes log2(n) rounds and
no step depends on the piece before it.

Each piece is at most ``size`` code points long; consecutive pieces share exactly the overlap; pieces cover the whole
text. Any overlap below the size is kept; one at or above it, with which no piece could get ahead of the one before (a
title's limit may be below the overlap), is lowered to half the size.

Defined results: a null item gives no piece, an empty one or one within the limit gives itself; a limit that is
missing or below 2 counts as none (the item stays whole); rows delivered twice count once; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from folio.llm.rolling import code_points
from folio.session import table

PIECES = "array<struct<piece_no: int, start_at: int, end_at: int, piece: string>>"
# Ends of paragraphs and sentences, and white space, in the scripts of the corpus.
TIERS = (
    re.compile(r"\n\s*\n"),
    re.compile(r"[.!?…؟।]+[\"'”’»)\]]*(?=\s)|[。！？｡]+[」』”’）]*|\n"),
    re.compile(r"\s+|[、，；：,;:](?=\S)"),
)
_MARK = re.compile(r"[̀-ͯ҃-҉֑-ֽً-ٰٟऀ-ःऺ-ॏॢॣัิ-ฺ็-๎‍︀-️゙゚]")


def cuts(texts: list[str], sizes: list[int], overlaps: list[int]) -> list[np.ndarray]:
    """For each text, all longer than its size: the ends of its pieces."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1)  # a text of n code points has n + 1 places
    starts = ends - lengths - 1
    whole = "\n".join(texts) + "\n"
    places = np.arange(len(whole))
    last = np.repeat(ends - 1, lengths + 1)
    room = np.repeat(np.array(sizes) - np.array(overlaps), lengths + 1)
    at_start = np.zeros(len(whole), bool)
    at_start[starts] = True
    # the first piece has no piece before it to overlap with
    room = np.where(at_start, np.repeat(np.array(sizes), lengths + 1), room)
    far = np.minimum(places + room, last)
    # the second piece begins the overlap before the first one's end, behind the start of the text
    low = np.where(at_start, places + np.repeat(np.array(overlaps), lengths + 1), places)
    near = np.maximum(places + room // 2, low + 1)
    joins = np.zeros(len(whole) + 1, bool)
    for m in _MARK.finditer(whole):
        joins[m.start()] = True
    free = np.maximum.accumulate(np.where(joins[:-1], 0, places))
    nxt = np.where(free[far] > low, free[far], far)
    tiers = [np.array([m.end() for m in tier.finditer(whole)], np.int64) for tier in reversed(TIERS)]
    for marks, least in ((np.unique(np.concatenate(tiers)), low + 1), *((m, near) for m in tiers)):
        if len(marks):
            k = np.searchsorted(marks, far, "right") - 1
            found = np.where(k >= 0, marks[np.maximum(k, 0)], -1)
            nxt = np.where((found >= least) & (found <= far), found, nxt)
    nxt = np.where(places + room >= last, last, nxt)
    reached = np.zeros(len(whole), bool)
    reached[nxt[starts]] = True
    step = nxt
    while True:  # squaring: what is reached in 2k cuts follows from what is reached in k
        more = reached.copy()
        more[step[reached]] = True
        if (more == reached).all():
            break
        reached, step = more, step[step]
    hits = np.flatnonzero(reached)
    return [hits[a:b] - s for s, a, b in zip(starts, np.searchsorted(hits, starts), np.searchsorted(hits, ends - 1, "right"))]


def _split(texts: pd.Series, sizes: pd.Series, overlaps: pd.Series) -> pd.Series:
    out: list = [None] * len(texts)
    long: list[tuple[int, str, int, int]] = []
    for k, (t, size, overlap) in enumerate(zip(texts, sizes, overlaps)):
        if t is None:
            continue
        limit = int(size) if size is not None and size == size and size >= 2 else 0
        if not limit or len(t) <= limit:
            out[k] = [{"piece_no": 0, "start_at": 0, "end_at": len(t), "piece": t}]
        else:
            shared = max(int(overlap), 0) if overlap is not None and overlap == overlap else 0
            long.append((k, t, limit, shared if shared < limit else limit // 2))
    held: list = []
    while long or held:
        if long:
            held.append(long.pop())
        if not long or sum(len(x[1]) for x in held) > 1_000_000:
            for (k, t, _, overlap), ends in zip(held, cuts(*map(list, zip(*[x[1:] for x in held])))):
                begins = [0, *(int(e) - overlap for e in ends[:-1])]
                out[k] = [{"piece_no": n, "start_at": a, "end_at": int(b), "piece": t[a : int(b)]} for n, (a, b) in enumerate(zip(begins, ends))]
            held = []
    return pd.Series(out, dtype=object)


def pieces(text: Column, size: Column, overlap: Column) -> Column:
    """The ordered pieces of a text within the size."""
    return pandas_udf(_split, PIECES)(text, size, overlap)


def with_limits(chunks: DataFrame, docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Items (chunk_id, field_name, body, size, overlap): the contents and titles with their collection's limits.

    A document's missing collection, or a chunk whose document is missing, uses the collection ``default``. The limits
    are a table of collections, a handful of rows that Spark broadcasts by their size."""
    docs = docs.select("doc_id", "collection").dropDuplicates(["doc_id"])
    rows = chunks.select("chunk_id", "doc_id", "title", "content").join(docs, "doc_id", "left").withColumn("collection", F.coalesce("collection", F.lit("default")))
    rows = rows.join(limits.select("collection", "size", "overlap", "title_size").dropDuplicates(["collection"]), "collection", "left")
    items = F.array(
        F.struct(F.lit("content").alias("field_name"), F.col("content").alias("body"), F.col("size").alias("size"), F.col("overlap").alias("overlap")),
        F.struct(F.lit("title").alias("field_name"), F.col("title").alias("body"), F.col("title_size").alias("size"), F.col("overlap").alias("overlap")),
    )
    return rows.select("chunk_id", F.inline(items)).where("body is not null")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return with_limits(*(table(spark, folder, t) for t in ("chunks", "docs", "split_limits")))


def over_limit(items: DataFrame) -> DataFrame:
    return items.where("length(body) > size and size >= 2")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that the splitter had to cut."""
    cut = over_limit(_items(spark, folder)).select("chunk_id", "field_name", pieces(F.col("body"), F.col("size"), F.col("overlap")).alias("p"))
    return cut.where(F.size("p") > 1).select("chunk_id", "field_name").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all oversized items."""
    items = over_limit(_items(spark, folder)).dropDuplicates(["chunk_id", "field_name"])
    return items.select("chunk_id", "field_name", F.inline(pieces(F.col("body"), F.col("size"), F.col("overlap"))))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLE = {
    "p3_found": """
        WITH limits AS (SELECT d.doc_id, l.size, l.title_size FROM docs d LEFT JOIN split_limits l ON coalesce(d.collection, 'default') = l.collection),
        rows AS (SELECT c.chunk_id, c.content, c.title, l.size, l.title_size FROM chunks c LEFT JOIN limits l USING (doc_id))
        SELECT DISTINCT chunk_id, 'content' AS field_name FROM rows WHERE length(content) > size
        UNION SELECT DISTINCT chunk_id, 'title' AS field_name FROM rows WHERE length(title) > title_size"""
}
