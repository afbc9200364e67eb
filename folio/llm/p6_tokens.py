"""Problem 6: encoding a corpus with a public byte-level BPE tokenizer, on the JVM side only.

A text is cut into words by the tokenizer's pattern. Words that are one token of the vocabulary get their id inside
the row. The distinct other words of the whole corpus are encoded once: a higher-order fold over the word's byte
tokens merges, again and again, the leftmost pair of the lowest rank. The rank map is a literal: a perfect hash in
two arrays, so that a look-up costs two array reads, whatever the size of the vocabulary.

Defined results: a null or empty text gives an empty list; exact repeats of a row (same key, same text) give one
row; strings that look like special tokens are ordinary text; further columns are ignored.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache, partial

import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.session import table

#: Folder of the vocabulary files; they are never copied into the repository.
TOKENIZERS = os.environ.get("FOLIO_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published word pattern of the tokenizer, with Unicode white space switched on for Java.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A merge that doesn't exist.
NO_RANK = 1 << 30
SLOTS, BUCKETS = 65_537, 16_384


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _displacements(keys: list[tuple[int, int, int, int]], values: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Hash and displace. keys: (key, bucket, start, step); gives the displacement of each bucket and, by slot, the
    key and value."""
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for k, key in enumerate(keys):
        buckets[key[1]].append(k)
    shift, at_key, at_value = [0] * BUCKETS, [-1] * SLOTS, [-1] * SLOTS
    taken = bytearray(SLOTS)
    for b in sorted(range(BUCKETS), key=lambda x: -len(buckets[x])):
        if not buckets[b]:
            break
        for d in range(SLOTS):
            slots = [(keys[k][2] + d * keys[k][3]) % SLOTS for k in buckets[b]]
            if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                break
        else:
            raise ValueError("no perfect hash found")
        shift[b] = d
        for k, s in zip(buckets[b], slots):
            taken[s], at_key[s], at_value[s] = 1, keys[k][0], values[k]
    return shift, at_key, at_value


class Vocabulary:
    """Rank map, one-token words and byte strings of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        ids: dict[str, int] = model["vocab"]
        special = {t for t in ids if any(c not in alphabet for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.bytes = {i: raw(t) for t, i in ids.items() if t not in special}
        self.byte_id = [ids[next(c for c, x in alphabet.items() if x == b)] for b in range(256)]
        # ids follow ranks in these files, so that the merged id itself orders the merges
        order = [new for _, (_, new) in sorted(self.pairs.items(), key=lambda x: x[1][0])]
        if any(a >= b for a, b in zip(order, order[1:])):
            raise ValueError("ids that don't follow the merge order aren't supported")
        keys, values = [], []
        for (a, b), (_, new) in self.pairs.items():
            keys.append((a * 65_536 + b, (a * 31_337 + b * 7_919) % BUCKETS, (a * 40_503 + b * 65_521) % SLOTS, 1 + (a * 257 + b * 769) % (SLOTS - 1)))
            values.append(new)
        self.pair_shift, self.pair_key, self.pair_value = _displacements(keys, values)
        keys, values = [], []
        for i, b in self.bytes.items():
            if self.encode(b) == [i]:
                h = xxhash.xxh64_intdigest(b, seed=42)
                keys.append((h - (1 << 64) * (h >> 63), h % BUCKETS, (h >> 14) % SLOTS, 1 + (h >> 31) % (SLOTS - 1)))
                values.append(i)
        self.word_shift, self.word_key, self.word_value = _displacements(keys, values)
        inside = [[False] * 256 for _ in range(256)]
        for b in self.bytes.values():
            for x, y in zip(b, b[1:]):
                inside[x][y] = True
        #: By 256 * first + second byte: may the two stand side by side within a token?
        self.inside = [int(v) for row in inside for v in row]

    def encode(self, data: bytes) -> list[int]:
        """The plain algorithm, for building the table of one-token words and for tests."""
        out = [self.byte_id[b] for b in data]
        while len(out) > 1:
            rank, k = min((self.pairs.get(p, (NO_RANK,))[0], k) for k, p in enumerate(zip(out, out[1:])))
            if rank == NO_RANK:
                break
            out[k : k + 2] = [self.pairs[out[k], out[k + 1]][1]]
        return out


@lru_cache(maxsize=4)
def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Vocabulary:
    return Vocabulary(os.path.join(folder, f"{name}.json"))


def _literal(values: list[int], kind: str = "int") -> str:
    """SQL of a literal array: folded to one constant by the optimizer."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def _pair_rank(v: Vocabulary, a: str, b: str) -> str:
    """SQL of the id that the tokens a and b merge to, NO_RANK if they don't."""
    slot = f"(({a} * 40503L + {b} * 65521L) + {_literal(v.pair_shift)}[cast(({a} * 31337L + {b} * 7919L) % {BUCKETS} as int)] * (1L + ({a} * 257L + {b} * 769L) % {SLOTS - 1})) % {SLOTS}"
    packed = [(-1 if k < 0 else k * 65_536 + x) for k, x in zip(v.pair_key, v.pair_value)]
    return f"transform(array({_literal(packed, 'bigint')}[cast({slot} as int)]), e -> if(shiftright(e, 16) = {a} * 65536L + {b}, cast(e & 65535 as int), {NO_RANK}))[0]"


def words(text: Column) -> Column:
    """The words of a text by the tokenizer's pattern; every character lies in one of them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def one_token(v: Vocabulary, column: str) -> tuple[Column, Column, Column]:
    """For an array of words: its hashes (to be named column + _h), their slots (column + _s), and then the id of each
    word that is one token, else -1."""
    hashes = f"transform({column}, w -> xxhash64(w))"
    slots = f"transform({column}_h, h -> cast((pmod(shiftrightunsigned(h, 14), {SLOTS}) + {_literal(v.word_shift)}[cast(h & {BUCKETS - 1} as int)] * (1L + pmod(shiftrightunsigned(h, 31), {SLOTS - 1}))) % {SLOTS} as int))"
    return F.expr(hashes), F.expr(slots), F.expr(f"zip_with({column}_h, {column}_s, (h, s) -> if({_literal(v.word_key, 'bigint')}[s] = h, {_literal(v.word_value)}[s], -1))")


def encode_words(distinct: DataFrame, v: Vocabulary, word: str = "word") -> DataFrame:
    """Adds ``ids`` to a table of distinct words: the ranked merges, folded over the word's bytes.

    The bytes are first cut where no token holds the two neighbours side by side, as no merge crosses such a place;
    that keeps the folds short in scripts without spaces.
    """
    rank_of = partial(_pair_rank, v)
    bytes_ = f"transform(sequence(1, octet_length({word})), i -> cast(conv(hex(substring(encode({word}, 'UTF-8'), i, 1)), 16, 10) as int))"
    step = distinct.withColumn("_b", F.expr(f"if(octet_length({word}) = 0, cast(array() as array<int>), {bytes_})"))
    step = step.withColumn("_cuts", F.expr(f"concat(filter(sequence(0, size(_b) - 1), i -> i = 0 or {_literal(v.inside)}[_b[i - 1] * 256 + _b[i]] = 0), array(size(_b)))"))
    step = step.withColumn("_t", F.expr(f"transform(_b, b -> {_literal(v.byte_id)}[b])"))
    step = step.withColumn("_seg", F.expr("transform(sequence(0, size(_cuts) - 2), k -> slice(_t, _cuts[k] + 1, _cuts[k + 1] - _cuts[k]))"))
    start = f"struct(s as t, if(size(s) < 2, cast(array() as array<int>), transform(sequence(0, size(s) - 2), i -> {rank_of('s[i]', 's[i + 1]')})) as r, 0 as p)"
    # p: place (from 1) of the lowest rank, 0 when nothing is left to merge
    place = "if(size(x.r) = 0 or array_min(x.r) = %d, 0, cast(array_position(x.r, array_min(x.r)) as int))" % NO_RANK
    merged = (
        "transform(array(named_struct('p', " + place.replace("x.", "a.") + ")), q -> if(q.p = 0, named_struct('t', a.t, 'r', cast(array() as array<int>), 'p', 0),"
        " named_struct('t', concat(slice(a.t, 1, q.p - 1), array(a.r[q.p - 1]), slice(a.t, q.p + 2, size(a.t))),"
        " 'r', concat(slice(a.r, 1, greatest(q.p - 2, 0)),"
        " transform(filter(array(named_struct('l', if(q.p > 1, a.t[q.p - 2], -1), 'm', a.r[q.p - 1]), named_struct('l', a.r[q.p - 1], 'm', if(q.p + 1 < size(a.t), a.t[q.p + 1], -1))), y -> y.l >= 0 and y.m >= 0), y -> " + rank_of("y.l", "y.m") + "),"
        " slice(a.r, q.p + 2, size(a.r))), 'p', 0)))[0]"
    )
    fold = f"if(size(s) < 2, s, aggregate(sequence(2, size(s)), {start}, (a, i) -> if(size(a.r) = 0, a, {merged}), a -> a.t))"
    return step.select(word, F.expr(f"flatten(transform(_seg, s -> {fold}))").alias("ids"))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", v: Vocabulary | None = None) -> DataFrame:
    """(key, ids) of every row: the token ids of its text."""
    v = v or vocabulary()
    step = df.select(F.col(key).alias("_key"), words(F.col(text)).alias("_w"))
    hashes, slots, ids = one_token(v, "_w")
    step = step.withColumn("_w_h", hashes).withColumn("_w_s", slots).withColumn("_base", ids)
    rest = F.expr("filter(transform(_w, (w, i) -> if(_base[i] < 0, named_struct('pos', i, 'word', w), null)), x -> x is not null)")
    rows = step.select("_key", "_base", rest.alias("_rest")).persist(StorageLevel.MEMORY_AND_DISK)
    places = rows.select("_key", F.inline("_rest"))
    known = encode_words(places.select("word").distinct(), v)
    parts = places.join(known.hint("shuffle_hash"), "word").select("_key", "pos", "ids")
    parts = parts.unionByName(rows.select("_key", F.lit(-1).alias("pos"), F.col("_base").alias("ids")))
    lists = parts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("_p"))
    lists = lists.withColumn("_p", F.expr("filter(_p, (x, i) -> i = 0 or x.pos != _p[i - 1].pos)"))
    # the k-th entry after the first follows the one-token words between it and the entry before it
    lists = lists.select(
        F.col("_key").alias(key),
        F.expr(
            "if(size(_p) = 1, _p[0].ids, flatten(concat(transform(sequence(1, size(_p) - 1), k -> concat(slice(_p[0].ids, _p[k - 1].pos + 2, _p[k].pos - _p[k - 1].pos - 1), _p[k].ids)),"
            " array(slice(_p[0].ids, _p[size(_p) - 1].pos + 2, size(_p[0].ids))))))"
        ).alias("ids"),
    )
    return lists


def decode_ids(ids: Column, v: Vocabulary | None = None) -> Column:
    """The text of a list of ids: the tokens' byte strings, concatenated."""
    v = v or vocabulary()
    top = max(v.bytes)
    names = ",".join(v.bytes.get(i, b"").hex() for i in range(top + 1))
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.expr(f"split('{names}', ',')")[i]), "")), "UTF-8")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


def p6_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Does each text come back from its ids?"""
    texts = table(spark, folder, "documents").select("doc_id", "text")
    back = encode_texts(texts).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), decode_ids(F.col("ids")).alias("back"))
    return back.join(texts, "doc_id").select("doc_id", (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))


QUERIES = {"p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip}
ORACLE = {"p6_roundtrip": "SELECT doc_id, true AS same FROM documents"}
