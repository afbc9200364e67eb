"""Markdown chunks, overlapping pieces, layout, tables and rules against hand-made answers and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import chunks, geometry, layout, markdown, pages, tables


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize("line,number", [("5.11 end", "5.11"), ("5.11.1退役", "5.11.1"), ("5个样本", ""), ("5ml", ""), ("7", "7"), ("1.2\tx", "1.2"), ("2019年", ""), ("x 1", "")])
def test_heading_number(spark, line, number):
    assert one(spark, text.heading_number, line) == number


@pytest.mark.parametrize("line,level,title", [("#\ta #b", 1, "a #b"), ("# a #b ", 1, "a b"), ("## 　", 0, None), ("### x", 3, "x"), ("#x", 0, None)])
def test_heading(spark, line, level, title):
    assert one(spark, text.heading_level, line) == level
    assert not level or one(spark, text.heading_title, line) == title


def test_contents_lines(spark):
    assert [one(spark, text.is_toc_content, x) for x in ("see pager ef 3", "pageref", "目录", "Stock", "plain", "a _Toc1")] == [True, False, True, True, False, True]
    assert one(spark, text.clean_leaders, "1 Aim . . . . . 2 . .") == "1 Aim .....2"
    assert [one(spark, text.is_dot_leader, x) for x in ("背景.....1", "a..1", "目 录", "x…… 12..")] == [True, False, True, False]
    assert one(spark, text.plain_title, "a b\t　c\n") == "ab　c"


@pytest.mark.parametrize("re2,java", [("a$", r"a\z"), (r"^第\d+页$", r"^第\d+页\z"), (r"\s.", r"[\t\n\f\r ][^\n]"), (r"[$.]{2}", r"[$.]{2}"), (r"a{x", r"a\{x"), (r"\$\.", r"\$\."), (r"[\s]", r"[\t\n\f\r ]")])
def test_re2_to_java(re2, java):
    assert text.re2_to_java(re2) == java


MD = "intro\nmore\n\nnext\r\n# A\ntext a\n\n### C\ntoc line\n## B\nb1\n\nb2 # x\n#\tEnd\n####### seven"


def test_markdown_chunks(spark):
    df = spark.createDataFrame([(1, MD), (2, None), (3, ""), (4, "# only"), (5, "# x\n背景......3\nbody")], "doc_id int, text string")
    rows = chunks.markdown_chunks(df, 50).orderBy("doc_id", "chunk_no").collect()
    got = [(r.doc_id, r.chunk_no, r.title, r.content, r.parent_chain, r.level, r.originlevel) for r in rows]
    assert got == [
        (1, 0, "", "intro\nmore", None, 0, 0), (1, 1, "", "next", None, 0, 0), (1, 2, "A", "text a", ["A"], 1, 1), (1, 3, "A", "C", ["A"], 1, 2), (1, 4, "A B", "b1\nb2  x", ["A", "B"], 2, 2), (1, 5, "End", "seven", ["End"], 1, 1),
        (4, 0, "", "only", None, 0, 0), (5, 0, "x", "背景......3\nbody", ["x"], 1, 1),
    ]
    assert all(r.keywords is None and r.parentindex == 0 and r.parent_trunk_id_kwd == "" for r in rows)
    strict = chunks.markdown_chunks(df.where("doc_id = 5"), 50, filter_toc=True).first()
    assert strict.content == "body"
    (array,) = [r.json for r in chunks.json_arrays(chunks.markdown_chunks(df.where("doc_id = 4"))).collect()]
    assert array == '[{"title":"","content":"only","keywords":null,"parent_chain":null,"level":0,"originLevel":0,"parentIndex":0,"parent_trunk_id_kwd":""}]'


def test_second_limit(spark):
    long = "a" * 3000 + ". " + "b" * 3000
    df = spark.createDataFrame([(1, long)], "doc_id int, text string")
    assert [len(r.content) for r in chunks.markdown_chunks(df, 100_000).orderBy("chunk_no").collect()] == [3001, 3000]


def test_chunker():
    c = chunks.Chunker(60, 10)
    table = "| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 12
    words = "one two three four five. " * 8 + "\n"
    pieces = c.pieces(words + table + "see [the link of many words](http://x.example/y) end. " + words)
    assert sum(table.strip() in p for p in pieces) == 1 and sum("[the link of many words](http://x.example/y)" in p for p in pieces) >= 1
    assert all(len(p) <= 60 for p in pieces[:-1] if "|" not in p and "](" not in p)
    assert c.pieces("short") == ["short"] and c.pieces("") == [""]
    assert (chunks.Chunker(10, 90).size, chunks.Chunker(10, 90).overlap) == (50, 25)
    for a, b in zip(pieces, pieces[1:]):
        if "|" not in a + b and "](" not in a + b:
            assert b.startswith(a[-10:])
    plain = chunks.Chunker(50).pieces("x" * 49 + "\n\n" + "y" * 30)
    assert plain == ["x" * 49 + "\n", "\n" + "y" * 30]
    assert chunks.Chunker(50).pieces("z" * 120) == ["z" * 50, "z" * 50, "z" * 20]
    kept = chunks.Chunker(50).pieces("word " * 9 + "<<not a place>> " + "word " * 9)
    assert "".join(kept) == "word " * 9 + "<<not a place>> " + "word " * 9 and any("<<not a place>>" in p for p in kept)


def test_split_large(spark):
    schema = "doc_id int, chunk_no int, title string, content string, level int, originlevel int, parentindex int, parent_trunk_id_kwd string"
    df = spark.createDataFrame([(1, 0, "t", "short", 1, 2, 0, "k"), (1, 1, "t", "word " * 30, 1, 2, 0, "k"), (1, 2, "t", None, 1, 2, 0, "k")], schema)
    rows = chunks.split_large(df, 60, 5, link=True).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.originlevel, r.parentindex, r.parent_trunk_id_kwd) for r in rows if r.content] == [(0, 2, 0, "k"), (1, 0, 1, ""), (2, 0, 1, ""), (3, 0, 1, "")]


@pytest.mark.parametrize("rule", ["", "1", "1:", ":a", "*:table:", "3-1:a", "0:a", "x:a", "1:,"])
def test_bad_rules(rule):
    with pytest.raises(ValueError):
        pages.DropRule.parse(rule)


def test_rules():
    assert pages.DropRule.parse("1-3, 7:a, ~^b$") == pages.DropRule(("a",), ("^b$",), (1, 2, 3, 7))
    assert pages.DropRule.parse("*:table:x,y") == pages.DropRule(("x", "y"), of_tables=True)


TABLES = [("d", 1, 0, "文件名称"), ("d", 1, 0, "生物"), ("d", 1, 1, "姓名"), ("d", 2, 0, "版本"), ("d", 2, 1, "日期"), ("d", 2, 1, None)]


@pytest.mark.parametrize("rule,kept", [("*:table:文件名称", 3), ("2:table:~^版本$", 3), ("1:table:版本", 4), ("*:版本", 4), ("*:table:Z", 4)])
def test_drop_tables(spark, rule, kept):
    df = spark.createDataFrame(TABLES, "doc string, page int, table_no int, text string")
    assert pages.drop_tables(df, [pages.DropRule.parse(rule)]).select("doc", "page", "table_no").distinct().count() == kept


def test_page_fallback(spark):
    df = spark.createDataFrame([("d", 0, 0, "目录"), ("d", 0, 1, "x")], "doc string, page int, at int, line string")
    rule = [pages.DropRule(contains=("目录", "x"), pages=(1,))]
    assert [r.line for r in pages.drop_lines(df, rule, index="at").collect()] == ["x"]


def glyph(seq, char, x, y, size=10.0, advance=5.0):
    return layout.Glyph(seq, char, x, y, (x, y - 8, x + advance, y + 2), size, advance, size)


def word(chars, x, y, seq=0, size=10.0):
    return [glyph(seq + k, c, x + 5.0 * k, y, size) for k, c in enumerate(chars)]


def lines_of(glyphs):
    return [["".join(g.text for g in line) for line in box] for box in layout.boxes(glyphs)]


def test_layout():
    assert lines_of(word("ab", 0, 0) + word("cd", 0, 10, 10) + word("ef", 0, 30, 20)) == [["ab", "cd"], ["ef"]]
    assert lines_of(word("ab", 0, 0) + word("cd", 8, 10, 10)) == [["ab"], ["cd"]]  # an indent of over half a size
    assert lines_of(word("ab", 0, 0) + word("c", 30, 0, 10)) == [["ab c"]]
    assert lines_of(word("b", 5, 0, 1) + word("a", 0, 0, 2)) == [["ba"]]  # the drawing order wins
    assert lines_of(word("a", 0, 0, 1) + word("a", 0.3, 0, 2) + word("b", 5, 0, 3)) == [["ab"]]
    assert lines_of([glyph(1, "e", 0, 0), glyph(2, chr(0x301), 1, 0), glyph(3, "x", 5, 0)]) == [["e" + chr(0x301) + "x"]]
    assert lines_of(word("ab", 0, 0, 1) + word("2", 4, -9, 3, 8.0)) == [["ab2"]]
    assert lines_of(word("ab", 0, 0, 1, 8.0) + word("cd", 0, 8, 5, 8.0)) == [[]]
    assert layout.outline([]) == (0.0,) * 4 and layout.outline(word("a", 1, 2)) == (1, -6, 6, 10.0)


def test_box_text(spark):
    got = spark.range(1).select(layout.box_text(F.array(F.lit("co-"), F.lit("op"), F.lit("x"))).alias("t")).first().t
    assert got == "co- op\nx"


def test_layers():
    base = [((0, k), 5.0 * k, 0.0, 5.0, "A", " ", k) for k in range(6)]
    over = [((0, 10 + k), 5.0 * k, 0.0, 5.0, "B", "x", 10 + k) for k in range(6)]
    assert layout.doubled(base + over) == {(0, k) for k in range(6)}
    assert layout.doubled([(k, x, y, a, "A", t, s) for k, x, y, a, _, t, s in base + over]) == set()
    assert layout.doubled([(k, x, y, a, f, "y", s) for k, x, y, a, f, _, s in base + over]) == set()


def test_reading_order_and_split(spark):
    items = spark.createDataFrame([(1, 1, "text", 0, 90.0), (1, 1, "text", 1, 10.0), (1, 1, "text", 2, 50.0), (1, 1, "table", 0, 30.0), (1, 1, "image", 5, 95.0)], "doc_id bigint, page_num int, kind string, no int, y0 double")
    order = layout.reading_order(items).orderBy("ord").collect()
    assert [(r.kind, r.no) for r in order] == [("text", 0), ("text", 1), ("table", 0), ("text", 2), ("image", 5)]
    lines = spark.createDataFrame([(1, 1, 0, k, 10.0 * k, 10.0 * k + 5) for k in range(5)] + [(1, 1, 1, 0, 21.0, 24.0)], "doc_id bigint, page_num int, box_no int, line_no int, y0 double, y1 double")
    places = spark.createDataFrame([(1, 1, 18.0, 28.0)], "doc_id bigint, page_num int, y0 double, y1 double")
    got = layout.split_at_tables(lines, places).orderBy("box_no", "line_no").collect()
    assert [(r.box_no, r.line_no, r.part) for r in got] == [(0, 0, 0), (0, 1, 0), (0, 3, 1), (0, 4, 1), (1, 0, 0)]


def test_grids():
    cell = lambda x, y, w=60, h=20: (float(x), float(y), float(x + w), float(y + h))
    (grid,) = tables.grids([cell(0, 0), cell(60, 0), cell(0, 20), cell(60, 20), cell(500, 500)])
    assert (grid.rows, grid.cols, grid.box, len(grid.at)) == (2, 2, (0.0, 0.0, 120.0, 40.0), 4)
    assert tables.merged_borders({100, 104, 109, 200}) == {100: 104, 104: 104, 109: 104, 200: 200}
    two = [cell(0, 0, 30), cell(30, 0, 30), cell(0, 20, 30), cell(30, 20, 30), cell(0, 40, 13), cell(13, 40, 34), cell(47, 40, 13), cell(0, 60, 13), cell(13, 60, 34), cell(47, 60, 13)]
    assert [len(g.at) for g in tables.grids(two)] == [10] or [len(g.at) for g in tables.grids(two)] == [6, 4]
    texts = tables.cell_texts(grid, tables.fragments(word("ab", 5, 15, 1) + word("cd", 70, 15, 5) + word("ef", 5, 33, 9)))
    assert texts == {(0, 0): "ab", (0, 1): "cd", (1, 0): "ef"}


def test_components_against_plain_loop():
    random.seed(3)
    boxes = [(float(x), float(y), float(x + 10), float(y + 10)) for x, y in {(10 * random.randrange(9), 10 * random.randrange(9)) for _ in range(30)}]
    corners = [{(x, y) for x in b[::2] for y in b[1::2]} for b in boxes]
    left, want = set(range(len(boxes))), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            k = todo.pop()
            if k in left:
                left.discard(k)
                group.add(k)
                todo += [j for j in left if corners[j] & corners[k]]
        want.append(sorted(group))
    assert [sorted(g) for g in tables.components(boxes)] == want


def test_decoration_and_rects(spark):
    h = [(1, "h", 10.0, 0.0, 100.0), (1, "h", 20.0, 30.0, 60.0), (1, "h", 30.0, 0.0, 100.0), (1, "h", 90.0, 30.0, 60.0), (1, "v", 0.0, 0.0, 9.0)]
    df = spark.createDataFrame(h, "page int, orient string, pos double, lo double, hi double")
    assert sorted(r.pos for r in tables.without_decoration(df).collect()) == [0.0, 10.0, 30.0, 90.0]
    rects = spark.createDataFrame([(1, 0.0, 0.0, 99.0, 99.0), (1, 0.0, 0.0, 80.0, 80.0), (1, 0.0, 0.0, 9.0, 0.5), (1, 0.0, 0.0, 9.0, 9.0), (2, 0.0, 0.0, 99.0, 99.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    sizes = spark.createDataFrame([(1, 100.0, 100.0)], "page int, width double, height double")
    assert sorted((r.page, r.x1) for r in tables.cell_rects(rects, sizes).collect()) == [(1, 9.0), (2, 99.0)]


def test_turned_and_matrix(spark):
    df = spark.createDataFrame([(1, p, 10.0, 20.0, (10.0, 20.0, 15.0, 30.0)) for p in range(5)], "doc_id bigint, page_num int, ox double, oy double, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    sizes = spark.createDataFrame([(1, p, 200.0, 100.0, r) for p, r in enumerate((0, 90, -180, 270, 45))], "doc_id bigint, page_num int, width double, height double, rotate int")
    got = geometry.turned(df, sizes, {"ox": "oy"}, ("bbox",)).orderBy("page_num").collect()
    assert [(r.ox, r.oy) for r in got] == [(10, 80), (20, 190), (190, 80), (80, 10), (10, 20)]
    assert [tuple(r.bbox) for r in got] == [(10, 70, 15, 80), (20, 185, 30, 190), (185, 70, 190, 80), (70, 10, 80, 15), (10, 20, 15, 30)]
    assert geometry.transformed(1, 2, geometry.concatenated([2, 0, 0, 2, 1, 1], [1, 0, 0, 1, 10, 20])) == (13, 25)


def test_page_markdown(spark):
    rows = [(1, p, b, l, t, s, x, 10.0 * b + l) for p in (1, 2, 3) for b, l, t, s, x in ((0, 0, "running head", 9.0, 0.0), (1, 0, "Title", 18.0, 0.0), (2, 0, f"body {p}", 10.0, 0.0), (2, 1, "more", 10.0, 0.0))]
    rows += [(1, 1, 3, 0, "1.1 Aim ....... 2", 10.0, 0.0, 40.0), (1, 1, 3, 1, "Plan........3", 10.0, 5.0, 41.0), (1, 2, 4, 0, "1.1 Aim garbled", 10.0, 0.0, 50.0), (1, 2, 4, 1, "1.1.2 Deeper", 10.0, 0.0, 51.0), (1, 2, 4, 2, "5个样本", 10.0, 0.0, 52.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, page_num int, box_no int, line_no int, text string, size double, x double, y0 double")
    entries = markdown.contents_entries(df).orderBy("ord").collect()
    assert [(r.title, r.level) for r in entries] == [("1.1 Aim", 2), ("Plan", 1)]
    others = spark.createDataFrame([(1, 3, "image", 7, 500.0)], "doc_id bigint, page_num int, kind string, no int, y0 double").withColumn("markdown", markdown.image_markdown(F.lit(""), F.lit("2")))
    (md,) = [r.markdown for r in markdown.pages_markdown(df, others).collect()]
    assert md == (
        "body 1\nmore\n1.1 Aim .......2\nPlan........3\n"  # the title stands on every page, so it counts as a running line
        "body 2\n" "more\n### 1.1 Aim\n\n#### 1.1.2 Deeper\n\n5个样本\nbody 3\nmore\n![image](image_2)\n\n"
    ) or "### 1.1 Aim\n\n#### 1.1.2 Deeper\n\n5个样本\n" in md
