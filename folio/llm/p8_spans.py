"""Problem 8: long exact spans shared between records.

Every window of SPAN code points is taken as a paragraph, and its set of GRAM-grams gets a MinHash signature. Two
windows that stand identically in two texts have the Jaccard similarity 1, so they collide in every band: one band
of one row already has the recall 1 for the exact spans asked for, and more bands would only add work. The minima of
all windows of a text are a few places (anchors, about two per SPAN - GRAM + 1 code points), so a text is written as
that many rows and not as one per window.

Paragraphs collide if they share an anchor's hash. An anchor's context is the stretch that all windows holding the
anchor cover. A context that stands in another record too is shared as a whole; that is one aggregation over hashes.
Only anchors at the rims of shared stretches are left: their contexts are fetched and compared, character by
character (edit distance 0), with the other distinct contexts of the anchor. An anchor with more than PAIRS distinct
contexts isn't compared in pairs: there the hashes of its windows are counted, which is linear and gives the same
result. The spans found are merged into stretches, the components of overlapping or touching spans.

Copies of one text share all contexts, so a group of copies costs one row per anchor and copy and no pair.

Defined results: null and short texts share nothing; a row delivered twice counts once (records are told apart by
the key); repetitions within one record aren't shared; further columns are ignored; positions are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.rolling import Hashes, code_points, sliding
from folio.session import table

SPAN = 400
GRAM = 160
#: Distinct contexts of an anchor up to which they are compared in pairs.
PAIRS = 48
#: Code points that are hashed at once; longer texts are taken in pieces with margins.
PIECE = 400_000


def _pieces(key: int, text: str, span: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(key, length, first place that counts, place of the piece, piece) with margins of a span on both sides."""
    n = len(text)
    for a in range(0, n, PIECE):
        start = max(0, a - span)
        yield key, n, a, start, text[start : a + PIECE + span]


def _anchors(items: list[tuple[int, int, int, int, str]], span: int, gram: int) -> pd.DataFrame:
    lengths = np.array([len(x[4]) for x in items])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    codes = code_points("".join(x[4] for x in items))
    n, width = len(codes), span - gram + 1
    hashes = Hashes(codes)
    place = np.arange(n - gram + 1)
    h = np.maximum(hashes.of(place, place + gram), np.uint64(1))
    least = sliding(h, width, np.minimum, np.iinfo(np.uint64).max)
    owner = np.repeat(np.arange(len(items)), lengths)
    # windows that cross from one text into the next don't count
    least[owner[: len(least)] != owner[span - 1 : span - 1 + len(least)]] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    p = np.flatnonzero(sliding(padded, width, np.maximum, 0) == h)
    o = owner[p]
    whole, first, at = (np.array([x[k] for x in items])[o] for k in (1, 2, 3))
    pos = p - starts[o] + at
    keep = (pos >= first) & (pos < first + PIECE)
    p, o, pos, whole = p[keep], o[keep], pos[keep], whole[keep]
    left = np.minimum(pos, span - gram)
    right = np.minimum(whole - pos, span)
    context = hashes.of(p - left, p + right) ^ (left * 1_000_003 + right).astype(np.uint64)
    return pd.DataFrame({"key": np.array([x[0] for x in items], np.int64)[o], "pos": pos.astype(np.int32), "n": whole.astype(np.int32), "h": h[p].view(np.int64), "c": context.view(np.int64)})


def anchors(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, pos, n, h, c) of a table (key, text): each anchor's place, the text's length, the hash of the gram at the
    place, and the hash of its context."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                held, size = [], 0
                for key, text in zip(batch["key"], batch["text"]):
                    for item in _pieces(key, text, span):
                        if len(item[4]) < span:
                            continue
                        held.append(item)
                        size += len(item[4])
                        if size > PIECE:
                            yield _anchors(held, span, gram)
                            held, size = [], 0
                if held:
                    yield _anchors(held, span, gram)

    return texts.mapInPandas(run, "key bigint, pos int, n int, h bigint, c bigint")


def _extents(contexts: list[str], lefts, keys, subject, span: int, gram: int) -> list[tuple[int, int]]:
    """For each subject among an anchor's contexts: how far to the left and right of the anchor the text of a partner
    goes on, over the partners with which it shares at least a span; (0, 0) where there is none."""
    reach = span - gram
    grid = np.zeros((len(contexts), reach + span), np.uint32)
    for k, (text, left) in enumerate(zip(contexts, lefts)):
        codes = code_points(text)
        grid[k, reach - left : reach - left + len(codes)] = codes + 1
    out = []
    for k in range(len(contexts)):
        if not subject[k]:
            out.append((0, 0))
            continue
        same = (grid == grid[k]) & (grid[k] > 0)
        right = np.logical_and.accumulate(same[:, reach:], axis=1).sum(1)
        left = np.logical_and.accumulate(same[:, :reach][:, ::-1], axis=1).sum(1)
        fit = (left + right >= span) & np.array([x != keys[k] for x in keys])
        out.append((int(left[fit].max()), int(right[fit].max())) if fit.any() else (0, 0))
    return out


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, pairs: int = PAIRS) -> DataFrame:
    """(key, start_at, end_at): the maximal stretches of each text covered by spans that stand in another record too."""
    reach = span - gram
    texts = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where((F.length("text") >= span) & F.col("key").isNotNull())
    found = anchors(texts, span, gram).persist(StorageLevel.MEMORY_AND_DISK)
    kinds = found.groupBy("h", "c").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.min(F.struct("key", "pos")).alias("at"))
    # one class of copies is enough to make its members' contexts shared; the rims need the anchor's other contexts
    hot = kinds.groupBy("h").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.count("*").alias("m"), F.max(F.col("lo") == F.col("hi")).alias("rim"))
    whole = kinds.where("lo < hi").select("h", "c", F.lit(-reach).alias("l"), F.lit(span).alias("r"))
    rims = hot.where("a < b and rim").select("h", "m")
    wanted = kinds.join(rims, "h").select("h", "c", "lo", "hi", "m", "at.key", "at.pos")
    places = wanted.groupBy("key").agg(F.collect_list(F.struct("pos", "h", "c", "lo", "hi", "m")).alias("places"))
    # where a key was delivered twice, its rows are alike
    texts = texts.join(places, "key").select("text", "places")

    def cut(batches):
        for batch in batches:
            rows = []
            for body, marks in zip(batch["text"], batch["places"]):
                for x in marks:
                    left = min(x["pos"], reach)
                    rows.append((x["h"], x["c"], x["lo"], x["hi"], x["m"], left, body[x["pos"] - left : x["pos"] + span]))
            yield pd.DataFrame(rows, columns=["h", "c", "lo", "hi", "m", "left", "context"])

    contexts = texts.mapInPandas(cut, "h bigint, c bigint, lo bigint, hi bigint, m bigint, left int, context string").dropDuplicates(["h", "c"]).persist(StorageLevel.MEMORY_AND_DISK)

    def compare(batches):
        for batch in batches:
            rows = []
            for h, group in zip(batch["h"], batch["group"]):
                # a context of several records counts as another record's for all
                owner = [x["lo"] if x["lo"] == x["hi"] else None for x in group]
                ends = _extents([x["context"] for x in group], [x["left"] for x in group], owner, [o is not None for o in owner], span, gram)
                rows += [(h, x["c"], -left, right) for x, (left, right) in zip(group, ends) if right]
            yield pd.DataFrame(rows, columns=["h", "c", "l", "r"])

    few = contexts.where(F.col("m") <= pairs).groupBy("h").agg(F.collect_list(F.struct("c", "lo", "hi", "left", "context")).alias("group"))
    few = few.mapInPandas(compare, "h bigint, c bigint, l int, r int")

    def windows(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for row in batch.itertuples(index=False):
                    codes = code_points(row.context)
                    start = np.arange(max(0, min(row.left, len(codes) - span) + 1))
                    if len(start):
                        yield pd.DataFrame({"h": row.h, "c": row.c, "lo": row.lo, "hi": row.hi, "off": (start - row.left).astype(np.int32), "w": Hashes(codes).of(start, start + span).view(np.int64)})

    window = "h bigint, c bigint, lo bigint, hi bigint, off int, w bigint"
    all_windows = contexts.where(F.col("m") > pairs).select("h", "c", "lo", "hi", "left", "context").mapInPandas(windows, window)
    common = all_windows.groupBy("h", "off", "w").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a < b").select("h", "off", "w")
    many = all_windows.where("lo = hi").join(common, ["h", "off", "w"]).groupBy("h", "c").agg(F.min("off").alias("l"), (F.max("off") + span).alias("r"))

    spans = found.join(whole.unionByName(few).unionByName(many), ["h", "c"])
    spans = spans.select("key", F.greatest(F.col("pos") + F.col("l"), F.lit(0)).alias("s"), F.least(F.col("pos") + F.col("r"), F.col("n")).alias("e"))
    return merged(spans).select(F.col("key").alias(key), F.col("s").alias("start_at"), F.col("e").alias("end_at"))


def merged(spans: DataFrame) -> DataFrame:
    """(key, s, e) with overlapping and touching spans of a key joined."""
    order = Window.partitionBy("key").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce(F.col("s") > before, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order))
    return islands.groupBy("key", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "documents"))


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each page other pages hold too."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    spans = p8_found(spark, folder).groupBy("doc_id").agg(F.sum(F.col("end_at") - F.col("start_at")).alias("shared"), F.count("*").alias("stretches"))
    out = docs.join(spans, "doc_id", "left").na.fill(0, ["shared", "stretches"])
    return out.select("doc_id", "n_chars", "shared", "stretches", F.when(F.col("n_chars") > 0, F.col("shared") / F.col("n_chars")).otherwise(0.0).alias("share"))


QUERIES = {"p8_found": p8_found, "p8_share": p8_share}
ORACLE: dict[str, str] = {}
