"""The eight problems on small fixtures: nulls, empty texts, ties, repeats, clashing columns, and brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.llm import p1_quality as p1
from folio.llm import p2_forms as p2
from folio.llm import p3_pieces as p3
from folio.llm import p4_sentences as p4
from folio.llm import p5_encoding as p5
from folio.llm import p6_tokens as p6
from folio.llm import p7_leaks as p7
from folio.llm import p8_spans as p8


def texts(spark, values, schema="doc_id bigint, text string, h int, c int, w string"):
    return spark.createDataFrame([(k, v, 1, 2, "x") for k, v in values], schema)


def test_p1_junk(spark):
    prose = [(k, f"The pump near the old mill was repaired in {1900 + k} by a man who had come from the town. It was not the last of them.", "en") for k in range(30)]
    odd = [(100, None, "en"), (101, "", None), (102, " \n ", "en"), (103, "- pump\n- mill\n- gate\n- heavy wheel", "en"), (104, "a | b | c | d | e", None), (105, "tray tray cable tray cable tray tray cable cable tray tray cable", "en")]
    df = spark.createDataFrame(prose + odd + prose[:3], "id bigint, body string, lang string").withColumn("key", F.lit(1)).withColumn("t", F.lit(1))
    got = p1.scored(df, "id", "body", "lang")
    assert got.count() == 33
    assert {r.key for r in got.where("junk").collect()} == {103, 104, 105}
    assert p1.scored(df.where("id < 0"), "id", "body", "lang").count() == 0


def test_p1_fillers(spark):
    prose = [(k, f"The pump near the old mill was repaired in {1900 + k} by a man who had come from the town. It was not the last of them.", "en") for k in range(30)]
    fillers = ["#-" * 60, "*" * 120, "_" * 90, "=" * 50, "~^" * 40, "-" * 95, "!" * 20, "─" * 60, "☎️" * 20, "#-" * 30 + " a " + "#-" * 30]
    sound = ["In 1905.", "Yes.", "«Oh!»", "Nein!", "���� ���� ��� �����."]
    df = spark.createDataFrame([*prose, *((100 + k, t, "en") for k, t in enumerate(fillers)), *((200 + k, t, "en") for k, t in enumerate(sound))], "id bigint, body string, lang string")
    assert {r.key for r in p1.scored(df, "id", "body", "lang").where("junk").collect()} == set(range(100, 100 + len(fillers)))


def test_p1_every_statistic_has_z(spark):
    rows = [(k, "The pump was repaired by a man from the town.\n" * 3, "en") for k in range(20)] + [(99, "The pump was\nrepaired by", "en")]
    got = p1.scored(spark.createDataFrame(rows, "id bigint, body string, lang string"), "id", "body", "lang")
    z = {r.key: (r.z_n_words, r.z_line_ends) for r in got.collect()}
    assert z[0] == (0.0, 0.0) and z[99] == ((30 - 5) / 8, 4.0)


@pytest.mark.parametrize("a,b,same", [("café", "café", True), ("Ａ１", "A1", True), ("a b", "a b", True), ("pаy", "pay", True), ("ﬁn", "fin", True), ("co­op​", "coop", True), ("x²", "x2", False), ("①", "1", False), ("½", "1/2", False), ("a", "A", False), ("e", "é", False), ("a‑b", "a-b", True)])
def test_p2_form(a, b, same):
    assert (p2.form(a) == p2.form(b)) == same
    assert p2.form(p2.form(a)) == p2.form(a)


def test_p2_pairs(spark):
    df = texts(spark, [(1, "a b"), (2, "a b"), (3, "a b"), (3, "a b"), (4, ""), (5, " "), (6, None), (7, "A b")])
    assert sorted(map(tuple, p2.alike_texts(df, "doc_id", "text").collect())) == [(1, 2), (2, 3)]
    g = spark.createDataFrame([(1, 1, 1, "e", 0.0, 0.0), (2, 1, 1, "е", 0.3, 0.4), (3, 1, 1, "е", 0.6, 0.0), (4, 1, 2, "е", 0.0, 0.0), (5, 1, 1, None, 0.0, 0.0)], "glyph_id bigint, doc_id bigint, page_num int, text string, ox double, oy double")
    assert sorted(map(tuple, p2.alike_glyphs(g).collect())) == [(1, 2)]


@pytest.mark.parametrize("size,overlap", [(20, 0), (20, 7), (7, 100), (2, 1)])
def test_p3_pieces(spark, size, overlap):
    random.seed(size)
    values = ["".join(random.choice("ab .\n。é😀") for _ in range(n)) for n in (0, 1, size, size + 1, 500)] + [None, "x" * 333]
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    shared = min(overlap, size // 2)
    for r in df.select("t", p3.pieces(F.col("t"), F.lit(size), F.lit(overlap)).alias("p")).collect():
        if r.t is None:
            assert r.p is None
            continue
        assert (r.p[0].start_at, r.p[-1].end_at) == (0, len(r.t))
        for a, b in zip(r.p, r.p[1:]):
            assert b.start_at == a.end_at - shared and b.end_at > a.end_at
        assert all(x.piece == r.t[x.start_at : x.end_at] and len(x.piece) <= size for x in r.p)
    assert df.limit(1).select(p3.pieces(F.lit("abc"), F.lit(None).cast("int"), F.lit(0)).alias("p")).first().p[0].piece == "abc"


@pytest.mark.parametrize("size,overlap", [(60, 48), (80, 60), (20, 19), (20, 10), (3, 2)])
def test_p3_keeps_overlap(size, overlap):
    random.seed(size)
    values = ["".join(random.choice("abcd .\né\u0301") for _ in range(n)) for n in (size + 1, 200, 500)] + ["a" * (size // 2) + ". " + "b" * 300, "a" + "\u0301" * 200]
    for text, pieces in zip(values, p3._split(pd.Series(values), pd.Series([size] * 5), pd.Series([overlap] * 5))):
        assert (pieces[0]["start_at"], pieces[-1]["end_at"]) == (0, len(text))
        for a, b in zip(pieces, pieces[1:]):
            assert b["start_at"] == a["end_at"] - overlap and b["start_at"] > a["start_at"] and b["end_at"] > a["end_at"]
        assert all(x["piece"] == text[x["start_at"] : x["end_at"]] and len(x["piece"]) <= size for x in pieces)


def test_p3_boundary_in_nearer_half():
    text = "ab cd " + "x" * 17 + " ef"
    (pieces,) = p3._split(pd.Series([text]), pd.Series([20]), pd.Series([0]))
    assert [p["piece"] for p in pieces] == ["ab cd ", "x" * 17 + " ef"]
    (pieces,) = p3._split(pd.Series([text]), pd.Series([20]), pd.Series([6]))
    assert [p["end_at"] for p in pieces] == [20, 26]  # a cut at 6 wouldn't get ahead of the overlap


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. A. Low paid 3.5 at www.x.example/a.html. It held etc. They left at 5 p.m. Now.", ["Dr. A. Low paid 3.5 at www.x.example/a.html.", "It held etc.", "They left at 5 p.m.", "Now."]),
        ("“Stop! It is wet,” said Xu. (It was.) He wrote: “So. Not.” End", ["“Stop! It is wet,” said Xu.", "(It was.)", "He wrote: “So. Not.”", "End"]),
        ("他说：“坏了！快停。”门在哪里？“在哪？”他问道。", ["他说：“坏了！快停。”", "门在哪里？", "“在哪？”他问道。"]),
        ("A line\nbreak here\n\nnew part", ["A line\nbreak here", "new part"]),
        ("Im 13. Stock, d. h. oben. Gut.", ["Im 13. Stock, d. h. oben.", "Gut."]),
        ("Πού είναι; Εδώ.", ["Πού είναι;", "Εδώ."]),
        (" \n ", []),
        ("", []),
        (None, []),
    ],
)
def test_p4(spark, text, want):
    df = spark.createDataFrame([(1, text)], "chunk_id bigint, content string")
    got = sorted(p4.sentence_rows(df, "chunk_id", "content").collect(), key=lambda r: r.start_at)
    assert [r.sentence for r in got] == want


def test_p4_long_quotations(spark):
    inside = ["It rained. It was wet. " * 40, "甲。" * 400, "One. Two! " * 60, "Eins. Zwei! " * 60]
    texts = [f"He said: “{inside[0]}It ended.” Then they left.", f"「{inside[1]}」完。", f'She said "{inside[2]}Four." They left.', f"Er sagte: „{inside[3]}Drei.“ Dann ging er."]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    got = p4.sentence_rows(df, "chunk_id", "content").groupBy("chunk_id").count().collect()
    assert {r.chunk_id: r["count"] for r in got} == {0: 2, 1: 1, 2: 2, 3: 2}


def test_p5_scores_and_counts_by_square():
    texts = ["abc éñЖ x\n", "日本 éé", "", "😀 a😀"]
    pairs, n = p5.pair_counts(texts)
    codes = p5.small(np.array([ord(c) for c in "\n" + "\n".join(texts) + "\n"]))
    want = np.unique(codes[:-1] << 21 | codes[1:], return_counts=True)
    assert np.array_equal(pairs, want[0]) and np.array_equal(n, want[1])
    model = p5.Bigrams(pairs, n)
    before, after = np.array([97, 233, 0x1F600, 5]), np.array([98, 233, 97, 0x65E5])
    fast = model.of(before, after)
    model._grid = np.full(0x10000, -1, np.int64), np.zeros((1, 1), np.float32)  # without the square all are searched
    assert np.allclose(fast, model.of(before, after), atol=1e-5)
    assert p5._plain(["plain", "é", "Ã©", "a\ufffd", ""]).tolist() == [True, True, False, False, True]


def test_p5_glyphs_without_page(spark):
    model = p5.Bigrams(*p5.pair_counts(["abc"] * 50))
    rows = [(k, None, None, k, "\ufffd" if k == 9_000 else "a", 1.0 * k, 0.0) for k in range(10_000)]
    df = spark.createDataFrame(rows, "glyph_id bigint, doc_id bigint, page_num int, seq_no int, text string, ox double, oy double")
    assert [r.glyph_id for r in p5.damaged_glyphs(df, model).collect()] == [9_000]


def test_p5_round_trip():
    random.seed(1)
    words = "le château était fermé près de la forêt où l’été déjà passé a laissé une fenêtre — élève très âgé à Nîmes".split()
    clean = [" ".join(random.choice(words) for _ in range(30)) + "." for _ in range(400)]
    model = p5.Model(p5.fit(clean))
    for read in ("cp1252", "cp437", "mac_roman"):
        broken = "le château était " + "fermé près de la forêt".encode().decode(read, "replace") + " où une fenêtre"
        (fixed, damaged), = model.label([broken])
        assert damaged.any() and "fermé" in fixed, read
    assert not any(d.any() for _, d in model.label(clean[:50] + ["", "plain"]))
    (_, lost), = model.label(["ferm� pr"])
    assert lost.tolist().index(True) == 4


def p5_best(model, text):
    """The score of the clean state and of the best path, over all places and all states, one text at a time."""
    codes = np.array([10, *map(ord, text), 10])
    n, names = len(codes), model.pairs.names
    seen = (codes > 127) | (np.append(10, codes[:-1]) > 127)
    clean = np.zeros(n)
    clean[seen] = model.bigrams.clean(codes, np.flatnonzero(seen))
    v0, v = 0.0, np.full(len(names), -1e9)
    units = [model.pairs.units(s, codes) for s in range(len(names))]
    score = lambda a, b: model.bigrams.of(np.array([a]), np.array([b]))[0]
    emits = np.zeros((len(names), n))
    begins = np.zeros((len(names), n), bool)
    for s, u in enumerate(units):
        end, tail, after = 0, 10, False  # where the last unit ends, what it ends with, whether it was one
        for k in range(n):
            if k < end:
                continue
            size = int(u.size[k])
            if names[s][0] == "lost":
                begins[s, k] = size > 0 or (codes[k] > 0xFF and k + 1 < n and codes[k + 1] == p5.LOST)
                emits[s, k] = -1.0 if codes[k] == p5.LOST else -6.0 if size else -9.0 if codes[k] > 127 else clean[k]
            elif size:
                begins[s, k], emits[s, k] = True, score(tail, u.first[k])
                tail, end, after = u.first[k], k + size, True
                if u.second is not None and u.second[k]:
                    emits[s, k] += score(tail, u.second[k])
                    tail = u.second[k]
            else:
                emits[s, k] = score(tail, codes[k]) if after else clean[k] - (codes[k] > 127)
                tail, after = codes[k], False
    cost = np.array([p5.ENTER_ONE if x in model.pairs.single else p5.ENTER for x in names])
    for k in np.flatnonzero(seen[:-1]):
        root = max(v0, v.max() - p5.LEAVE)
        v = np.maximum(v, np.where(begins[:, k], root - cost, -1e9)) + emits[:, k]
        v0 = root + clean[k]
    return clean[:-1].sum(), max(v0, v.max())


def test_p5_damaged_without_paths(monkeypatch):
    random.seed(3)
    words = "le château était fermé près de la forêt où l’été déjà passé — привет друзья сегодня хорошая погода 今天天气很好 plain words between".split()
    clean = [" ".join(random.choice(words) for _ in range(20)) for _ in range(300)]
    model = p5.Model(p5.fit(clean))
    texts = []
    for text in clean[:25]:
        place, word = random.randrange(len(text)), random.choice(words)
        true, read = random.choice([("utf-8", "cp1252"), ("utf-8", "cp437"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("utf-8", "gbk"), ("gbk", "cp1252"), ("cp1252", "mac_roman")])
        texts.append(text[:place] + word.encode(true, "ignore").decode(read, "replace") + text[place:])
        texts.append(text[:place] + random.choice("ÀÉÐ»·жñß\x92\ufffdÃ") + text[place:])
    texts += ["", "plain", "é", "\ufffd", "\n\n", "a" * 500 + "Ã©" + "b" * 500]
    doubtful, best = model.doubtful(texts), [p5_best(model, t) for t in texts]
    want = [bool(d and top > bottom + 1e-9) for d, (bottom, top) in zip(doubtful, best)]
    labelled = model.label(texts)
    assert 0 < sum(want) < doubtful.sum() and [bool(d.any()) for _, d in labelled] == want
    monkeypatch.setattr(p5, "BATCH", 300)  # neither batches nor the texts beside it change what a text gets
    assert all(a == c and np.array_equal(b, d) for (a, b), (c, d) in zip(labelled, model.label(texts)))
    monkeypatch.setattr(p5.Model, "_paths", None)  # whether a text is damaged is known without a path
    assert model.damaged(texts).tolist() == want
    assert len(model._scores(["a" * 500 + "Ã©" + "b" * 500]).codes) < 10


def test_p5_found_equals_restored(spark):
    model = p5.Bigrams(*p5.pair_counts(["le château était fermé"] * 50))
    df = spark.createDataFrame([(1, "le chÃ¢teau"), (1, "le chÃ¢teau"), (2, "était"), (3, None), (4, ""), (5, "ferm\ufffd")], "id bigint, body string")
    found, restored = p5.damaged_keys(df, "id", "body", model), p5.damaged_texts(df, "id", "body", model)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in restored.collect()) == [1, 5]


def test_p5_glyphs_are_restored(spark):
    random.seed(4)
    words = "le château était fermé près de la forêt où été déjà passé a laissé une fenêtre".split()
    model = p5.fit([" ".join(random.choice(words) for _ in range(30)) for _ in range(400)])
    page = [*"le ch", "Ã", "¢", *"teau ", "Ã©ta", *"it ferm", "é", *" pr", "\ufffd", *"s"]
    rows = [(k, 1, 1, k, t, 10.0 * k, 0.0) for k, t in enumerate(page)]
    rows += [rows[5], (100, 1, 1, 100, "Ã¨", 0.2, 0.0), (None, 1, 3, 0, "Ã©", 0.0, 0.0), (6, 1, 2, 0, "\ufffd", 0.0, 0.0)]
    rows += 2 * [(200 + k, 1, 4, k, t, None, None) for k, t in enumerate("fermÃ©")]  # delivered twice, without places
    df = spark.createDataFrame(rows, "glyph_id bigint, doc_id bigint, page_num int, seq_no int, text string, ox double, oy double").repartition(3)
    got = sorted(map(tuple, p5.damaged_glyphs(df, model).collect()))
    # two glyphs of one letter; a letter in a longer glyph; a lost one; one printed over another; one on two pages
    assert got == [(5, "â"), (6, ""), (12, "éta"), (page.index("\ufffd"), "\ufffd"), (100, "è"), (204, "é"), (205, "")]


def test_p5_fits_all_rows(spark):
    random.seed(2)
    values = ["".join(random.choice("abc éñЖ\n") for _ in range(random.randrange(12))) for _ in range(900)] + ["only here ŵŷ", "and here ŵŷ", "once ẁẃ"]
    df = spark.createDataFrame([*enumerate(values), (0, values[0]), (-1, None)], "id bigint, body string").repartition(3)
    got, few, want = p5.fitted(df, "id", "body"), p5.fitted(df, "id", "body", 90), p5.fit(values)
    for name in ("chars", "total", "single", "pairs", "score"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name
    # more rows than wanted: all are counted, with less weight, but what stands only once proves nothing
    assert np.array_equal(few.chars, want.chars) and np.allclose(few.total, want.total * 90 / 905)
    assert (ord("ŵ") << 21 | ord("ŷ")) in few.pairs and (ord("ẁ") << 21 | ord("ẃ")) not in few.pairs
    assert p5.fitted(df.where("id < 0"), "id", "body").total.sum() == 2


def test_p6_against_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{p6.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    values = ["", None, "Hello world's  end \n\n x", "<|endoftext|>", "虽然钟楼是廉价的", "😀🚲 naïve Ünïcode", "a" * 300, "1234567 " * 5, " 　tab\t", "ąęłó ğüneş"]
    df = texts(spark, [*enumerate(values), (2, values[2])])
    got = {r.doc_id: list(r.ids) for r in p6.encode_texts(df).collect()}
    assert got == {k: t.encode(v or "", add_special_tokens=False).ids for k, v in enumerate(values)}
    back = p6.encode_texts(df).select("doc_id", p6.decode_ids(F.col("ids")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {k: v or "" for k, v in enumerate(values)}


def test_p7(spark):
    item = " ".join(f"w{k}" for k in range(40))
    w = item.split()
    docs = [
        (1, "intro " + item.upper().replace(" ", ", ") + " more"),
        (2, " ".join(w[:11]) + " filler text here and more of it " + " ".join(w[20:31])),
        (3, " ".join(w[:15])),
        (4, " ".join(x if k % 12 else "zzz" for k, x in enumerate(w[:24], 1))),
        (5, " ".join(reversed(w))),
        (6, None),
        (7, ""),
        (1, "intro " + item.upper().replace(" ", ", ") + " more"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("w", F.lit(1)).withColumn("at", F.lit(1))
    items = spark.createDataFrame([(9, item), (9, item), (8, None), (7, "")], "item_id bigint, text string")
    assert sorted({(r.doc_id, r.item_id) for r in p7.leaks(df, items).collect()}) == [(1, 9), (2, 9), (4, 9)]


def test_p7_short_runs(spark):
    w = [f"w{k}" for k in range(40)]
    apart = lambda a, at: " ".join(w[a : a + at] + ["zzz"] + w[a + at + 1 : a + 10])
    docs = [(1, apart(0, 4) + " some filler text between them and more " + apart(20, 5)), (2, "x a1 a2 a3 y"), (3, " ".join(w[3:7]) + " u v x y z " + " ".join(w[20:24]))]
    items = spark.createDataFrame([(7, ""), (8, "a0 a1 a2 a3 a4"), (9, " ".join(w))], "item_id bigint, text string")
    got = p7.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 9), (2, 8)]
    sizes = spark.createDataFrame([(5,), (20,), (40,), (100,)], "n int").select(p7.seed_size("n"))
    assert [r[0] for r in sizes.collect()] == [2, 3, 5, 6]


def test_p7_many_passages():
    # thirty scattered passages of the same length, the two that stand in order far behind the others
    scattered = [(10 * k, 10 * k + 8, 8, 1000 - 10 * k) for k in range(30)]
    assert p7.held([*scattered, (400, 407, 7, 2000)]) == 15
    # a tile that goes on the passage ten tiles before it in the list
    tiles = [(0, 0, 6), *((6, 1000 - 20 * k, 2) for k in range(10)), (8, 8, 6)]
    assert (0, 14, 12, 0) in p7.passages(tiles)


def test_p7_tiles():
    grams = p7.grams("a b a b".split(), 2)
    assert grams[0] == grams[2] != grams[1] and p7.grams(["a"], 2) == []

    def tiles(item, doc, seed=3):
        places = {}
        for k, h in enumerate(p7.grams(doc.split(), p7.TILE)):
            places.setdefault(h, []).append(k)
        return sorted(p7.tiles(item.split(), doc.split(), places, seed))

    assert tiles("a b c d e f", "x a b c d y d e f") == [(0, 1, 4), (4, 7, 2)]  # what is left of d e f waits again
    assert tiles("a b c d", "c d q q q q q q q a b") == [(0, 9, 2), (2, 0, 2)]  # without a seed short ones count wherever they stand
    assert tiles("a b c d e x y", "a b c d e q q q q q q q x y") == [(0, 0, 5)]  # else only beside longer ones
    assert tiles("a b c", "a b c a b c") == [(0, 0, 3)]


def brute(docs, span):
    seen = {}
    for k, t in docs.items():
        for i in range(len(t or "") - span + 1):
            seen.setdefault(t[i : i + span], set()).add(k)
    out = []
    for k, t in docs.items():
        cover = None
        for i in range(len(t or "") - span + 1):
            if len(seen[t[i : i + span]]) > 1:
                if cover and i <= cover[1]:
                    cover[1] = i + span
                else:
                    cover and out.append((k, *cover))
                    cover = [i, i + span]
        cover and out.append((k, *cover))
    return sorted(out)


@pytest.mark.parametrize("pairs", [48, 1])
def test_p8_against_brute_force(spark, pairs):
    random.seed(pairs)
    word = lambda n: "".join(random.choice("abcd😀 ") for _ in range(n))
    shared = [word(90) for _ in range(4)]
    docs = {k: word(30) + random.choice(shared)[random.randrange(20) :] + word(20) + random.choice(shared) + word(random.randrange(30)) for k in range(25)}
    docs |= {30: docs[3], 31: docs[3], 32: "z" * 200, 33: "z" * 150, 34: None, 35: "", 36: word(39)}
    df = texts(spark, [*docs.items(), (3, docs[3])])
    got = sorted(map(tuple, p8.shared_spans(df, span=40, gram=16, pairs=pairs).collect()))
    assert got == brute(docs, 40)
    assert p8.shared_spans(df.where("doc_id < 0")).count() == 0
