"""Glyphs of a page to lines and boxes of text: a pen follows the glyphs in the order in which they were drawn.

The fold runs per page, whose size is bounded by the paper; pages are spread over the executors. Rows without a document
or a page are left out, as they belong to no page.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import plain_title, utrim

PAGE = ("doc_id", "page_num")
# Fixed values, in units of the pen's font size: how far apart vertically glyphs of one line and of one box stand, by how
# much a line of a new box is indented, and how near a glyph printed again for boldness lies.
SAME_LINE, SAME_BOX, INDENT, AGAIN = 0.8, 1.5, 0.5, 0.1
#: A gap of so many average advances is a space.
WORD_GAP = 1.0
# Average size below which, and number of glyphs up to which, a line is a superscript.
SMALL, FEW = 9.0, 30
HYPHENS = "-‐‑‒–"
LINES = "doc_id bigint, page_num int, box_no int, line_no int, text string, n int, size double, x double, x0 double, y0 double, x1 double, y1 double"


@dataclass(frozen=True)
class Glyph:
    seq: int
    text: str
    x: float
    y: float
    box: tuple[float, float, float, float]
    size: float = 0.0
    advance: float = 0.0
    visual: float = 0.0

    def height(self, other: float = 0.0) -> float:
        return next((s for s in (self.visual, self.size) if s > 0), other)


Line = list[Glyph]


def of_page(page: pd.DataFrame) -> list[Glyph]:
    """The glyphs of a page as rows, in drawing order; missing numbers count as 0."""
    number = lambda v: 0.0 if v is None or v != v else float(v)
    side = lambda b: tuple(number(b[k]) for k in ("x0", "y0", "x1", "y1")) if b is not None else (0.0,) * 4
    columns = (page[c] for c in ("seq_no", "text", "ox", "oy", "bbox", "font_size", "advance", "visual_size"))
    rows = [Glyph(int(number(s)), t or "", number(x), number(y), side(b), number(f), number(a), number(v)) for s, t, x, y, b, f, a, v in zip(*columns)]
    return sorted(rows, key=lambda g: g.seq)


def finished(line: Line) -> Line:
    """A line in reading order, by place or, where that contradicts the drawing order, by the latter; with spaces in gaps."""
    line = sorted(line, key=lambda g: (g.x, g.seq))
    if any(a.seq > b.seq for a, b in zip(line, line[1:])):
        line.sort(key=lambda g: g.seq)
    steps = [g.advance for g in line if g.advance > 0]
    usual = sum(steps) / len(steps) if steps else math.inf
    out = line[:1]
    for g in line[1:]:
        end = out[-1].x + out[-1].advance
        if g.x - end > usual * WORD_GAP:
            reach = abs(out[-1].size) * 0.8
            out.append(replace(out[-1], seq=max(out[-1].seq - 1, 0), text=" ", x=end, advance=g.x - end, visual=0.0, box=(end, out[-1].y - reach, g.x, out[-1].y + reach)))
        out.append(g)
    return out


def boxes(glyphs: Iterable[Glyph]) -> list[list[Line]]:
    """The boxes of a page, each a list of lines; glyphs come in drawing order."""
    out: list[list[Line]] = []
    pen: Glyph | None = None
    pen_size, box_x = 12.0, 0.0
    for g in glyphs:
        if g.text and unicodedata.category(g.text[0]) == "Mn":
            if pen:  # a combining mark doesn't move the pen
                out[-1][-1].append(g)
            continue
        size = g.height(pen_size)
        if pen is None:
            out.append([[g]])
            box_x = g.x
        else:
            if g.text[:1] == pen.text[:1] and math.hypot(g.x - pen.x, g.y - pen.y) < AGAIN * size:
                continue
            away = abs(g.y - pen.y) / pen_size
            if away > SAME_BOX or (away >= SAME_LINE and g.x - box_x > INDENT * pen_size):
                out.append([[g]])
                box_x = g.x
            elif away >= SAME_LINE:
                out[-1].append([g])
            else:
                out[-1][-1].append(g)
        pen, pen_size = g, size
    return [with_superscripts([finished(line) for line in box]) for box in out]


def is_superscript(line: Line) -> bool:
    sizes = [g.size for g in line if g.size > 0]
    return bool(sizes) and sum(sizes) / len(sizes) < SMALL and len(line) <= FEW


def with_superscripts(lines: list[Line]) -> list[Line]:
    """Small lines go glyph by glyph behind the glyph drawn last before them. A box of several lines that are all small keeps
    none."""
    if len(lines) < 2:
        return lines
    kept = [line for line in lines if not is_superscript(line)]
    for line in filter(is_superscript, lines):
        for g in sorted(line, key=lambda g: g.seq):
            hosts = [(-h.seq, n, k) for n, host in enumerate(kept) for k, h in enumerate(host) if h.seq < g.seq]
            if hosts:
                _, n, k = min(hosts)
                kept[n].insert(k + 1, g)
    return kept


def outline(line: Line) -> tuple[float, float, float, float]:
    """The box around a line: its glyphs' boxes that aren't empty, and their origins; zeros where all are empty."""
    sides = [g.box for g in line if g.box[0] < g.box[2] and g.box[1] < g.box[3]]
    if not sides:
        return (0.0,) * 4
    sides += [(g.x, g.y - abs(g.size) * 0.2, g.x + g.advance, g.y + abs(g.size) * 0.8) for g in line]
    return tuple(f(v) for f, v in zip((min, min, max, max), zip(*sides)))


def line_rows(page: pd.DataFrame) -> pd.DataFrame:
    """One row a line of a page; a box without lines gives none."""
    rows = []
    for box_no, lines in enumerate(boxes(of_page(page))):
        for line_no, line in enumerate(lines):
            rows.append((page["doc_id"].iloc[0], page["page_num"].iloc[0], box_no, line_no, "".join(g.text for g in line), len(line), line[0].height(), line[0].x, *outline(line)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])


def by_page(glyphs: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return glyphs.where(" and ".join(f"{c} is not null" for c in PAGE)).groupBy(*PAGE).applyInPandas(f, schema)


def text_lines(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_num, box_no, line_no, text, n, size, x, x0, y0, x1, y1) of the glyphs of pages in visual space; size and x
    are those of the line's first glyph."""
    kept = glyphs.select(*PAGE, "seq_no", "text", "ox", "oy", "bbox", "font_size", "advance", "visual_size").where("text is not null")
    return by_page(kept, line_rows, LINES)


def box_text(lines: Column) -> Column:
    """The text of a box of ordered lines: line breaks between them, or a space behind a hyphen, which stays."""
    return F.aggregate(lines, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, F.when(F.right(a, F.lit(1)).isin(*HYPHENS), " ").otherwise("\n"), x)))


def text_boxes(lines: DataFrame) -> DataFrame:
    """(doc_id, page_num, box_no, text, x0, y0, x1, y1) of lines."""
    rows = lines.groupBy(*PAGE, "box_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    return rows.withColumn("text", box_text(F.transform("l", lambda x: x["text"]))).select(*PAGE, "box_no", "text", "x0", "y0", "x1", "y1")


def is_vertical(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box of text that runs upwards: high and narrow."""
    return (y1 - y0 > 50) & (x1 - x0 < 0.2 * (y1 - y0))


def _rows_of(glyphs: list[tuple], near: float = 3.0) -> list[list[tuple]]:
    """Runs of glyphs whose baseline lies within 3 points of the run's first one; downwards."""
    out: list[list[tuple]] = []
    for g in sorted(glyphs, key=lambda g: (-g[2], g[1])):
        if out and abs(out[-1][0][2] - g[2]) <= near:
            out[-1].append(g)
        else:
            out.append([g])
    return out


def _layered(row: list[tuple], reach: float, strict: bool) -> list[tuple[list[tuple], list[tuple], float, float]]:
    """Pairs of a row's fonts whose stretches overlap by more than ``reach`` points, with the stretch they share."""
    fonts: dict[str, list[tuple]] = {}
    for g in row:
        fonts.setdefault(g[4], []).append(g)
    spans = [(gs, min(g[1] for g in gs), max(g[1] + g[3] for g in gs)) for gs in fonts.values()]
    pairs = []
    for n, (a, a0, a1) in enumerate(spans):
        for b, b0, b1 in spans[n + 1 :]:
            lo, hi = max(a0, b0), min(a1, b1)
            if hi - lo > reach or (hi - lo == reach and not strict):
                pairs.append((a, b, lo, hi))
    return pairs


def doubled(glyphs: list[tuple], reach: float = 5.0, margin: float = 2.0) -> set:
    """Keys of the glyphs (key, x, y, advance, font, text, seq) of an earlier layer that is blank where a later one lies over
    it in another font. Only rows of five glyphs or more are looked at, and only if some row of the page has two layers."""
    rows = _rows_of(glyphs)
    if not any(_layered(r, reach, True) for r in rows):
        return set()
    gone = set()
    for row in (r for r in rows if len(r) >= 5):
        for a, b, lo, hi in _layered(row, reach, False):
            inside = [[g for g in layer if lo - margin <= g[1] <= hi + margin] for layer in (a, b)]
            if not all(inside):
                continue
            mean = [sum(g[6] for g in gs) / len(gs) for gs in inside]
            early, late = inside if mean[0] < mean[1] else inside[::-1]
            blank = lambda gs: all(not g[5].strip() for g in gs)
            if blank(early) and not blank(late):
                gone |= {g[0] for g in early}
    return gone


def without_doubled(glyphs: DataFrame) -> DataFrame:
    """The glyphs without those of earlier blank layers (see ``doubled``)."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        known = [((r.form_obj, r.seq_no), r.ox, r.oy, r.advance or 0.0, r.font_name or "", r.text or "", r.seq_no) for r in page.itertuples() if r.seq_no == r.seq_no]
        gone = sorted(doubled(known), key=str)
        return pd.DataFrame({"doc_id": page["doc_id"].iloc[:1].repeat(len(gone)), "page_num": page["page_num"].iloc[:1].repeat(len(gone)), "seq_no": [s for _, s in gone], "form": [None if f is None or f != f else int(f) for f, _ in gone]})

    narrow = glyphs.select(*PAGE, "seq_no", "form_obj", "ox", "oy", "advance", "font_name", "text").where("ox is not null and oy is not null and seq_no is not null")
    gone = by_page(narrow, run, "doc_id bigint, page_num int, seq_no int, form int").distinct()
    g, d = glyphs.alias("g"), gone.alias("d")
    same = (F.col("g.doc_id") == F.col("d.doc_id")) & (F.col("g.page_num") == F.col("d.page_num")) & (F.col("g.seq_no") == F.col("d.seq_no")) & F.col("g.form_obj").eqNullSafe(F.col("d.form"))
    return g.join(d, same, "left_anti")


def split_at_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines whose boxes are cut where they run through tables (doc_id, page_num, y0, y1): lines inside a table go, and the
    runs between become boxes. A box of one line or with one run stays as it is. Adds part, the number of the run."""
    t = tables.select(F.col("doc_id").alias("_d"), F.col("page_num").alias("_p"), F.col("y0").alias("_t0"), F.col("y1").alias("_t1"))
    inside = lines.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("page_num") == F.col("_p")) & (F.col("y0") >= F.col("_t0")) & (F.col("y1") <= F.col("_t1")), "left_semi").select(*PAGE, "box_no", "line_no", F.lit(True).alias("inside"))
    rows = lines.join(inside, [*PAGE, "box_no", "line_no"], "left")
    order = Window.partitionBy(*PAGE, "box_no").orderBy("line_no")
    box = Window.partitionBy(*PAGE, "box_no")
    free = F.col("inside").isNull()
    starts = free & ~F.coalesce(F.lag(free).over(order), F.lit(False))
    rows = rows.withColumn("run", F.sum(starts.cast("int")).over(order)).withColumn("runs", F.max("run").over(box)).withColumn("of", F.count("*").over(box))
    alone = (F.col("runs") <= 1) | (F.col("of") <= 1)
    return rows.where(alone | F.col("inside").isNull()).withColumn("part", F.when(alone, 0).otherwise(F.col("run") - 1)).drop("inside", "run", "runs", "of")


def reading_order(items: DataFrame) -> DataFrame:
    """(doc_id, page_num, kind, no, ord) of the items (kind, no, y0) of a page: text in its order; each table and image, from
    the top, in front of the item that begins next below it, by more than a point, else last."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        rows = list(page[["kind", "no", "y0"]].itertuples(index=False, name=None))
        order = sorted((r for r in rows if r[0] == "text"), key=lambda r: r[1])
        for r in sorted((r for r in rows if r[0] != "text"), key=lambda r: (r[2], r[0] != "table", r[1])):
            below = [(x[2], k) for k, x in enumerate(order) if x[2] - r[2] > 1]
            order.insert(min(below)[1] if below else len(order), r)
        return pd.DataFrame([(page["doc_id"].iloc[0], page["page_num"].iloc[0], kind, no, k) for k, (kind, no, _) in enumerate(order)], columns=["doc_id", "page_num", "kind", "no", "ord"])

    return by_page(items.select(*PAGE, "kind", "no", "y0"), run, "doc_id bigint, page_num int, kind string, no int, ord int")


def document_title(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, title): the topmost line of a document's first page that is no running line, if it stands in the middle of the
    page; the tolerance is a tenth of the page's width."""
    norm = lines.select(*PAGE, plain_title(F.col("text")).alias("norm")).where("norm != ''").distinct().groupBy("doc_id", "norm").agg(F.count("*").alias("n"))
    total = pages.groupBy("doc_id").agg(F.countDistinct("page_num").alias("total"), F.min_by(F.struct("page_num", "width"), "page_num").alias("first"))
    running = norm.join(total, "doc_id").where("total >= 3 and n >= greatest(3, total div 2)").select("doc_id", "norm")
    top = lines.join(total, "doc_id").where("page_num = first.page_num").withColumn("t", utrim(F.col("text"))).where("t != ''").withColumn("norm", plain_title(F.col("t")))
    top = top.join(running, ["doc_id", "norm"], "left_anti").groupBy("doc_id").agg(F.min_by(F.struct("t", ((F.col("x0") + F.col("x1")) / 2).alias("mid"), F.col("first.width").alias("width")), F.struct("y0", "box_no", "line_no")).alias("m"))
    return top.where("abs(m.mid - m.width / 2) <= m.width * 0.1").select("doc_id", F.col("m.t").alias("title"))
