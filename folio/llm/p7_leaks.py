"""Problem 7: evaluation texts leaking into training text, by greedy string tiling.

Tokens are the words of a text in lower case (letters, marks, digits); in scripts without spaces each character is one.
Seeds are the hashes of consecutive tokens that a document and an item share, as many as the longest run of any held
half has at least, by the item's length, the tolerated errors and two passages, and at most SEED. As up to one word in ten may differ
and there are at most two passages, a lower bound follows for the item's tokens that seeds must cover in a pair that
counts; other pairs are dropped after one partial aggregation. For the pairs left, matches are found by running
Karp-Rabin over short token grams, and the longest ones that don't overlap are marked, again and again. Marked tiles
that follow each other in both texts with small gaps make a passage. The two best passages in the item's order must
hold at least half of the item's tokens.

Defined results: null and empty texts match nothing; an item delivered twice and a document delivered twice count
once; single tokens prove nothing, so that items of fewer than five tokens are found only by two in a row; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from heapq import heapify, heappop, heappush
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import table

#: Tokens of the longest seed.
SEED = 6
#: Tokens of the shortest tile.
TILE = 2
#: Tokens by which two tiles of one passage may lie apart.
GAP = 3
#: Share of a passage's tokens that may be replaced or left out.
SLACK = 0.1
#: Share of the item's tokens that must be held.
COVER = 0.5
#: Seeds of the items up to which they are broadcast (24 bytes each); beyond it both sides are shuffled.
BROADCAST_SEEDS = 1_000_000
#: Base and modulus of the running hashes.
BASE, PRIME = 1_000_003, (1 << 61) - 1
# Fixed value: scripts that are written without spaces between words.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*|[[\p{L}\p{M}\p{N}]&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def seed_size(n: Column | str) -> Column:
    """Tokens that the longest run has at least, however errors and two passages part any held half of n tokens."""
    runs = f"ceil((m - floor(m * {SLACK})) / (floor(m * {SLACK}) + 2))"
    return F.expr(f"cast(greatest({TILE}, least({SEED}, array_min(transform(sequence(cast(ceil({n} * {COVER}) as int), {n}), m -> {runs})))) as int)")


def _hashes(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*kept, F.transform("w", lambda w: F.xxhash64(w)).alias("x"))


def _runs(size: int) -> Column:
    """Hash of each run of ``size`` tokens, of the token hashes x."""
    return F.expr(f"if(size(x) >= {size}, transform(sequence(0, size(x) - {size}), i -> xxhash64({', '.join(f'x[i + {k}]' for k in range(size))})), cast(array() as array<bigint>))")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the pairs whose shared seeds cover enough of the item. docs and items have the column w, items
    their seed's size too. The sizes are a handful of numbers up to SEED."""
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [SEED]
    own = F.coalesce(*(F.when(F.col("size") == k, _runs(k)) for k in sizes))
    seeds = _hashes(items, "item_id", "size").select("item_id", F.posexplode(own).alias("at", "h"))
    # each error and the second passage cut the tokens held into one more run; of each run size - 1 tokens may be too few for a seed
    least = f"array_min(transform(sequence(cast(ceil(n * {COVER}) as int), n), m -> m - floor(m * {SLACK}) - (size - 1) * (floor(m * {SLACK}) + 2)))"
    lengths = items.select("item_id", "size", F.size("w").alias("n")).select("item_id", F.expr(f"greatest(1, {least})").alias("least"))
    if seeds.count() <= BROADCAST_SEEDS:
        seeds, lengths = F.broadcast(seeds), F.broadcast(lengths)
    of_docs = _hashes(docs, "doc_id").select("doc_id", F.explode(F.concat(*map(_runs, sizes))).alias("h"))
    pairs = of_docs.join(seeds, "h").groupBy("doc_id", "item_id", "at").agg(F.lit(1).alias("one"))
    counts = pairs.groupBy("doc_id", "item_id").agg(F.count("*").alias("covered"))
    return counts.join(lengths, "item_id").where("covered >= least").select("doc_id", "item_id")


def grams(words: list[str], size: int) -> list[int]:
    """The running Karp-Rabin hash of each run of ``size`` words."""
    values = [hash(w) % PRIME for w in words]
    out, h, first = [], 0, pow(BASE, size, PRIME)
    for k, v in enumerate(values):
        h = (h * BASE + v - (values[k - size] * first if k >= size else 0)) % PRIME
        if k >= size - 1:
            out.append(h)
    return out


def matches(item: list[str], doc: list[str], places: dict[int, list[int]], least: int = TILE) -> list[tuple[int, int, int]]:
    """The longest common runs (place in the item, place in the document, tokens), of ``least`` tokens or more. places: of the
    document's grams; words behind equal hashes are compared."""
    runs: list[tuple[int, int, int]] = []
    open_at: dict[int, tuple[int, int]] = {}
    for i, h in enumerate(grams(item, least)):
        now: dict[int, tuple[int, int]] = {}
        for d in places.get(h, ()):
            if item[i : i + least] == doc[d : d + least]:
                start, size = open_at.get(d - i, (i, least - 1))
                now[d - i] = start, size + 1
        runs += [(s, s + k, n) for k, (s, n) in open_at.items() if k not in now]
        open_at = now
    return runs + [(s, s + k, n) for k, (s, n) in open_at.items()]


def tiles(item: list[str], doc: list[str], places: dict[int, list[int]], seed: int = SEED, least: int = TILE) -> list[tuple[int, int, int]]:
    """Marked matches (place in the item, place in the document, tokens), the longest first. A match of which another has taken
    a part waits again, by the length of what is left. Those shorter than a seed are marked only beside longer ones, if there are any."""
    used_i, used_d, marked = bytearray(len(item)), set(), []

    def mark(waiting: list[tuple], rank, enough: int) -> list[tuple[int, int, int]]:
        """Marks the matches (rank, place in the item, place in the document, tokens) of ``enough`` tokens; gives the rest."""
        heapify(waiting)
        short = []
        while waiting:
            _, i, d, n = heappop(waiting)
            free = [not used_i[i + k] and d + k not in used_d for k in range(n)]
            if all(free):
                marked.append((i, d, n))
                used_i[i : i + n] = b"\1" * n
                used_d.update(range(d, d + n))
                continue
            k = 0
            for is_free, part in groupby(free):
                size = len(list(part))
                if is_free and size >= enough:
                    heappush(waiting, (rank(i + k, d + k, size), i + k, d + k, size))
                elif is_free and size >= least:
                    short.append((i + k, d + k, size))
                k += size
        return short

    runs = matches(item, doc, places, least)
    longest = lambda i, d, n: (0, -n)
    short = mark([(longest(*r), *r) for r in runs if r[2] >= seed], longest, seed) + [r for r in runs if r[2] < seed]
    diagonals = sorted(d - i for i, d, _ in marked)

    def beside(i: int, d: int, n: int) -> tuple[int, int]:
        k = bisect_left(diagonals, d - i)
        return min((abs(x - (d - i)) for x in diagonals[max(0, k - 1) : k + 1]), default=0), -n

    mark([(beside(*r), *r) for r in short if beside(*r)[0] <= GAP], beside, least)
    return marked


def passages(marked: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens held, place in the document): tiles joined where the gaps in both texts are small."""
    out: list[list[int]] = []  # start, end, held, place, end in the document
    ending = defaultdict(list)  # by end in the item
    for i, d, n in sorted(marked):
        best = None
        for p in (p for end in range(i, i - GAP - 1, -1) for p in reversed(ending[end])):
            gap_i, gap_d = i - p[1], d - p[4]
            if 0 <= gap_i <= GAP and 0 <= gap_d <= GAP and (i + n - p[0] - p[2] - n) <= max(1, SLACK * (i + n - p[0]) + 0.999):
                best = p
                break
        if best:
            ending[best[1]].remove(best)
            best[1], best[2], best[4] = i + n, best[2] + n, d + n
        else:
            best = [i, i + n, n, d, d + n]
            out.append(best)
        ending[best[1]].append(best)
    return [(s, e, held, d) for s, e, held, d, _ in out]


def spans(marked: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The same of each run of tiles with small gaps, from any tile to any later one."""
    out, ordered = [], sorted(marked)
    for k, (i, d, n) in enumerate(ordered):
        end, end_d, size = i + n, d + n, n
        out.append((i, end, size, d))
        for i2, d2, n2 in ordered[k + 1 :]:
            if 0 <= i2 - end <= GAP and 0 <= d2 - end_d <= GAP:
                end, end_d, size = i2 + n2, d2 + n2, size + n2
                out.append((i, end, size, d))
    return out


def held(found: list[tuple[int, int, int, int]], slack: float = 1.0) -> int:
    """The most item tokens in one passage or two in the item's order, with the tolerated gaps: of the tokens together at
    most the share ``slack``."""
    best = 0
    for a in [(0, 0, 0, -1), *found]:
        for b in found:
            size = a[1] - a[0] + b[1] - b[0]
            if size > best and a[1] <= b[0] and a[3] < b[3] and size - a[2] - b[2] <= slack * size + 1e-9:
                best = size
    return best


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): the documents that hold at least COVER of an item, and how much of it."""
    docs = docs.select(F.col("doc_id"), F.col("text"))
    items = items.select("item_id", tokens(F.col("text")).alias("w")).dropDuplicates(["item_id"]).where("size(w) > 0")
    items = items.withColumn("n", F.size("w")).withColumn("size", seed_size("n")).drop("n")
    pairs = candidates(docs.select("doc_id", tokens(F.col("text")).alias("w")), items)
    wanted = pairs.join(items, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "w", "size")).alias("items"))
    both = wanted.join(docs, "doc_id").select("doc_id", "items", tokens(F.col("text")).alias("w"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, items_of, words in zip(batch["doc_id"], batch["items"], batch["w"]):
                words = list(words)
                places = defaultdict(list)
                for k, h in enumerate(grams(words, TILE)):
                    places[h].append(k)
                for x in items_of:
                    item = list(x["w"])
                    share = held(passages(tiles(item, words, places))) / len(item)
                    if share < COVER and x["size"] < SEED:  # shorter runs prove less: no gap beyond the tolerated ones
                        share = held(spans(tiles(item, words, places, x["size"])), SLACK) / len(item)
                    if share >= COVER:
                        rows.append((doc_id, x["item_id"], share))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

    return both.mapInPandas(run, "doc_id bigint, item_id bigint, share double")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


QUERIES = {"p7_found": p7_found}
ORACLE: dict[str, str] = {}
