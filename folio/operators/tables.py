"""Tables of ruling lines: filters of rectangles and edges, crossings with their edges, cells, grids, and the text in them.

Up to the cells everything is joins and windows on the page; what follows (components, grids, text) runs per page, whose
size is bounded by the paper. Columns: page keys, then orient, pos, lo, hi for edges.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import utrim
from folio.operators.geometry import edges, joined, snapped
from folio.operators.layout import Glyph, of_page


@dataclass(frozen=True)
class Settings:
    """Tolerances and least sizes, in points."""

    snap: float = 3.0
    join: float = 3.0
    edge: float = 3.0
    cross: float = 3.0
    cell: float = 5.0
    cells: int = 2
    rule: float = 1.0
    near: float = 30.0
    over: float = 5.0


def quantised(c: Column | str) -> Column:
    """Tenths of a point, halves away from zero."""
    return F.round(F.col(c) * 10 if isinstance(c, str) else c * 10).cast("int")


def overlap_area(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> float:
    w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
    return w * h if w > 0 and h > 0 else 0.0


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of the first box that the second covers; 0 where one is empty."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda r: F.when((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]), (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))
    return F.coalesce(F.when(area(b).isNotNull(), side("x0", "x1") * side("y0", "y1") / area(a)), F.lit(0.0))


def touching(left: DataFrame, right: DataFrame, page: str = "page", square: float = 64.0) -> DataFrame:
    """Pairs of boxes (no, x0, y0, x1, y1) of one page that overlap, found through the squares that they lie on."""
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / square).cast("int"), F.floor(F.col(hi) / square).cast("int"))
    on = lambda df, p: df.select(page, *(F.col(c).alias(p + c) for c in ("no", "x0", "y0", "x1", "y1")), F.explode(cells("x0", "x1")).alias("sx"), "y0", "y1").select("*", F.explode(cells("y0", "y1")).alias("sy")).drop("y0", "y1")
    both = on(left, "a_").join(on(right, "b_"), [page, "sx", "sy"])
    return both.where("a_x0 < b_x1 and b_x0 < a_x1 and a_y0 < b_y1 and b_y0 < a_y1").select(page, "a_no", "b_no").distinct()


def segment_edges(segments: DataFrame) -> DataFrame:
    """(page, orient, pos, lo, hi) of the segments (x0, y0, x1, y1) that run along an axis."""
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    kind = F.when((dx < 0.5) & (dy > 0.5), "v").when((dy < 0.5) & (dx > 0.5), "h")
    rows = segments.withColumn("orient", kind).where("orient is not null")
    pick = lambda h, v: F.when(F.col("orient") == "h", h).otherwise(v)
    return rows.select("page", "orient", pick(F.col("y0"), F.col("x0")).alias("pos"), pick(F.least("x0", "x1"), F.least("y0", "y1")).alias("lo"), pick(F.greatest("x0", "x1"), F.greatest("y0", "y1")).alias("hi")).distinct()


def cell_rects(rects: DataFrame, pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rectangles without empty ones, backgrounds (over 95 % of both sides, or over half of the page) and thin rules.
    pages: (page, width, height); a page without a size has no backgrounds."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = rects.where((w > 0) & (h >= settings.rule)).join(pages.select("page", F.col("width").alias("_w"), F.col("height").alias("_h")), "page", "left")
    whole = (F.col("_w") > 0) & (F.col("_h") > 0) & (w > F.col("_w") * 0.95) & (h > F.col("_h") * 0.95)
    half = (F.col("_w") * F.col("_h") > 0) & (w * h > F.col("_w") * F.col("_h") * 0.5)
    return rows.where(~F.coalesce(whole | half, F.lit(False))).drop("_w", "_h")


def without_decoration(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Edges without the horizontal ones that have a wider edge, which overhangs them, near above and near below."""
    h = rows.where("orient = 'h'")
    o = h.select("page", *(F.col(c).alias(f"o_{c}") for c in ("pos", "lo", "hi")), F.explode(F.array(*(F.floor(F.col("pos") / settings.near).cast("int") + k for k in (-1, 0, 1)))).alias("band"))
    pairs = h.withColumn("band", F.floor(F.col("pos") / settings.near).cast("int")).join(o, ["page", "band"])
    away = F.abs(F.col("pos") - F.col("o_pos"))
    wider = (away <= settings.near) & (away >= 0.5) & (F.col("o_lo") <= F.col("lo") + 3) & (F.col("o_hi") >= F.col("hi") - 3) & ((F.col("lo") - F.col("o_lo") >= settings.over) | (F.col("o_hi") - F.col("hi") >= settings.over))
    flags = pairs.where(wider).groupBy("page", "orient", "pos", "lo", "hi").agg(F.max(F.col("pos") > F.col("o_pos")).alias("above"), F.max(F.col("pos") < F.col("o_pos")).alias("below"))
    return rows.join(flags.where("above and below"), ["page", "orient", "pos", "lo", "hi"], "left_anti")


def ruled_edges(rects: DataFrame, segments: DataFrame | None, pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The edges of a page's rectangles and segments, snapped, joined and without decoration; short ones are left out."""
    rows = edges(cell_rects(rects, pages, settings))
    if segments is not None:
        rows = rows.unionByName(segment_edges(segments)).distinct()
    return without_decoration(joined(snapped(rows.where(F.col("hi") - F.col("lo") >= settings.edge), settings.snap), settings.join), settings)


def crossing_points(rows: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(page, kx, ky, x, y, hs, vs): where vertical edges meet horizontal ones, by tenths of a point, with the edges (by their
    left or upper ends) that meet there. As in the model for this operator, a horizontal edge counts as endless to the right."""
    h = rows.where("orient = 'h'").select("page", F.col("pos").alias("y"), F.col("lo").alias("hl"))
    v = rows.where("orient = 'v'").select("page", F.col("pos").alias("x"), F.col("lo").alias("vl"), F.col("hi").alias("vh"))
    meet = (F.col("hl") <= F.col("x") + tolerance) & (F.col("y") >= F.col("vl") - tolerance) & (F.col("y") <= F.col("vh") + tolerance)
    return h.join(v, "page").where(meet).groupBy("page", quantised("x").alias("kx"), quantised("y").alias("ky")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sort_array(F.collect_set("hl")).alias("hs"), F.sort_array(F.collect_set("vl")).alias("vs"))


def cells(points: DataFrame, least: float = 5.0) -> DataFrame:
    """(page, x0, y0, x1, y1): the smallest rectangle to the right of and below each crossing whose sides are edges. Snapped
    positions are farther apart than the tolerance, so points of one edge have one coordinate in common."""
    p = points.select("page", "kx", "ky", "x", "y", "hs", "vs")
    of = lambda n: p.select("page", *(F.col(c).alias(f"{n}_{c}") for c in p.columns if c != "page"))
    corner = of("a")
    below = corner.join(of("b").withColumnRenamed("b_kx", "a_kx"), ["page", "a_kx"]).where((F.col("b_y") > F.col("a_y")) & F.arrays_overlap("a_vs", "b_vs"))
    right = corner.select("page", "a_kx", "a_ky", "a_x", "a_hs").join(of("r").withColumnRenamed("r_ky", "a_ky"), ["page", "a_ky"]).where((F.col("r_x") > F.col("a_x")) & F.arrays_overlap("a_hs", "r_hs"))
    both = below.select("page", "a_kx", "a_ky", "a_x", "a_y", "b_ky", "b_y", "b_hs").join(right.select("page", "a_kx", "a_ky", "r_kx", "r_x", "r_vs"), ["page", "a_kx", "a_ky"])
    far = of("d").withColumnRenamed("d_kx", "r_kx").withColumnRenamed("d_ky", "b_ky")
    closed = both.join(far, ["page", "r_kx", "b_ky"]).where(F.arrays_overlap("d_vs", "r_vs") & F.arrays_overlap("d_hs", "b_hs"))
    best = closed.groupBy("page", "a_x", "a_y").agg(F.min(F.struct("b_y", "r_x")).alias("m"))
    return best.select("page", F.col("a_x").alias("x0"), F.col("a_y").alias("y0"), F.col("m.r_x").alias("x1"), F.col("m.b_y").alias("y1")).where(f"x1 - x0 >= {least} and y1 - y0 >= {least}")


Box = tuple[float, float, float, float]


def tenths(v: float) -> int:
    return int(abs(v) * 10 + 0.5) * (1 if v >= 0 else -1)


def components(boxes: list[Box]) -> list[list[int]]:
    """Groups of boxes that hang together by common corners, in the order of their first box."""
    parent = list(range(len(boxes)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    at: dict[tuple[int, int], int] = {}
    for k, (x0, y0, x1, y1) in enumerate(boxes):
        for corner in ((x, y) for x in (tenths(x0), tenths(x1)) for y in (tenths(y0), tenths(y1))):
            a, b = sorted((root(at.setdefault(corner, k)), root(k)))
            parent[b] = a
    groups = defaultdict(list)
    for k in range(len(boxes)):
        groups[root(k)].append(k)
    return [groups[k] for k in sorted(groups)]


def merged_borders(values: set[int], gap: int = 5) -> dict[int, int]:
    """By border: the whole mean of the run of borders that it belongs to, each at most ``gap`` tenths after the last."""
    out, run = {}, []
    for v in [*sorted(values), None]:
        if run and (v is None or v - run[-1] > gap):
            out |= dict.fromkeys(run, int(sum(run) / len(run)))
            run = []
        run.append(v)
    return out


def _parts(boxes: list[Box]) -> list[list[Box]]:
    """A group cut behind each row whose borders differ from those of the next one far more than usual, unless the row is one
    merged cell over the whole width."""
    rows = defaultdict(list)
    for b in boxes:
        rows[tenths(b[1])].append(b)
    if len(boxes) <= 2 or len(rows) <= 1:
        return [boxes]
    order = [rows[k] for k in sorted(rows)]
    borders = [set(merged_borders({tenths(x) for b in row for x in (b[0], b[2])}).values()) for row in order]
    alike = [len(a & b) / len(a | b) for a, b in zip(borders, borders[1:])]
    usual = sorted(alike)[len(alike) // 2]
    ends = {tenths(min(b[0] for b in boxes)), tenths(max(b[2] for b in boxes))}
    out: list[list[Box]] = [[]]
    for k, row in enumerate(order):
        out[-1] += row
        if k < len(alike) and alike[k] < min(usual * 0.4, 0.5) and not (len(borders[k]) <= 2 and ends <= borders[k]):
            out.append([])
    return out


@dataclass
class Grid:
    """A table: its box, numbers of rows and columns, and the boxes of its cells by row and column."""

    box: Box
    rows: int
    cols: int
    at: dict[tuple[int, int], Box]


def grids(boxes: list[Box], least: int = 2) -> list[Grid]:
    """The tables that the cells of a page make, from the bottom, then from the left."""
    out = []
    for group in components(boxes):
        for part in _parts([boxes[k] for k in group]) if len(group) > 1 else []:
            if len(part) < 2:
                continue
            xs, ys = (merged_borders({tenths(b[k]) for b in part for k in ks}) for ks in ((0, 2), (1, 3)))
            column, row = ({v: n for n, v in enumerate(sorted(set(m.values())))} for m in (xs, ys))
            grid = Grid((min(b[0] for b in part), min(b[1] for b in part), max(b[2] for b in part), max(b[3] for b in part)), len(row) - 1, len(column) - 1, {})
            for b in part:
                # a border that was moved belongs to the first row or column, as borders are looked up as they stand
                r, c = row.get(tenths(b[1]), 0), column.get(tenths(b[0]), 0)
                if r < grid.rows and c < grid.cols:
                    grid.at[r, c] = b
            if grid.rows * grid.cols >= least:
                out.append(grid)
    out.sort(key=lambda g: (-round(g.box[3]), g.box[0]))
    return out


def fragments(glyphs: list[Glyph]) -> list[tuple[list[Glyph], Box]]:
    """Runs of glyphs of one line without a wide gap, in drawing order, with their boxes."""
    lines: list[list[Glyph]] = []
    for g in sorted(glyphs, key=lambda g: g.y):
        if lines and g.y - lines[-1][-1].y <= 2:
            lines[-1].append(g)
        else:
            lines.append([g])
    out: list[list[Glyph]] = []
    for line in lines:
        last = None
        for g in sorted(line, key=lambda g: g.box[0]):
            wide = last is not None and g.box[0] - last.box[2] > max(last.box[3] - last.box[1], g.box[3] - g.box[1], 3.0)
            if last is None or wide:
                out.append([])
            out[-1].append(g)
            last = g
    return [(sorted(f, key=lambda g: g.seq), tuple(m(g.box[k] for g in f) for k, m in enumerate((min, min, max, max)))) for f in out]


def cell_texts(grid: Grid, parts: list[tuple[list[Glyph], Box]], wide: float = 3.0) -> dict[tuple[int, int], str]:
    """The text of each cell: the fragments that overlap it most, cells being a little wider; of cells that share a fragment
    equally the one that holds its middle, else the first."""
    held = defaultdict(list)
    for glyphs, box in parts:
        best, area = None, 0.0
        mid = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
        for at in sorted(grid.at):
            x0, y0, x1, y1 = grid.at[at]
            now = overlap_area(x0 - wide, y0, x1 + wide, y1, *box)
            if now > area or (now == area > 0 and x0 <= mid[0] < x1 and y0 <= mid[1] < y1):
                best, area = at, now
        if best is not None:
            held[best].append((glyphs[0].y, box[0], "".join(g.text for g in glyphs)))
    out = {}
    for at, pieces in held.items():
        pieces.sort(key=lambda p: p[0])
        rows: list[list] = []
        for p in pieces:
            if rows and p[0] - rows[-1][0][0] <= 2:
                rows[-1].append(p)
            else:
                rows.append([p])
        out[at] = "".join(p[2] for row in rows for p in sorted(row, key=lambda p: p[1]))
    return out


CELL_ROWS = "doc_id bigint, page_num int, table_no int, row int, col int, text string, x0 double, y0 double, x1 double, y1 double, n_rows int, n_cols int, t_x0 double, t_y0 double, t_x1 double, t_y1 double"


def table_cells(boxes: DataFrame, glyphs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The tables of pages (doc_id, page_num): one row for each place of a grid, empty ones included. boxes: the cells."""

    def run(boxes: pd.DataFrame, glyphs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        parts = fragments(of_page(glyphs)) if len(glyphs) else []
        order = sorted(boxes[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        for n, grid in enumerate(grids(order, settings.cells)):
            texts = cell_texts(grid, parts)
            for at in ((r, c) for r in range(grid.rows) for c in range(grid.cols)):
                rows.append((boxes["doc_id"].iloc[0], boxes["page_num"].iloc[0], n, *at, texts.get(at, ""), *grid.at.get(at, (0.0,) * 4), grid.rows, grid.cols, *grid.box))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CELL_ROWS.split(", ")])

    kept = glyphs.select("doc_id", "page_num", "seq_no", "text", "ox", "oy", "bbox", "font_size", "advance", "visual_size").where("text is not null")
    return boxes.groupBy("doc_id", "page_num").cogroup(kept.groupBy("doc_id", "page_num")).applyInPandas(run, CELL_ROWS)


def outside_tables(glyphs: DataFrame, cells: DataFrame, wide: float = 3.0) -> DataFrame:
    """The glyphs whose fragment overlaps no cell (doc_id, page_num, x0, y0, x1, y1), cells being a little wider."""

    def run(glyphs: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        boxes = [(x0 - wide, y0, x1 + wide, y1) for x0, y0, x1, y1 in cells[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None) if x0 < x1 and y0 < y1]
        gone = sorted({g.seq for f, box in (fragments(of_page(glyphs)) if boxes else []) if any(overlap_area(*b, *box) for b in boxes) for g in f})
        return pd.DataFrame({"doc_id": [glyphs["doc_id"].iloc[0]] * len(gone), "page_num": [glyphs["page_num"].iloc[0]] * len(gone), "seq_no": gone})

    kept = glyphs.select("doc_id", "page_num", "seq_no", "text", "ox", "oy", "bbox", "font_size", "advance", "visual_size").join(cells.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_semi")
    gone = kept.groupBy("doc_id", "page_num").cogroup(cells.select("doc_id", "page_num", "x0", "y0", "x1", "y1").groupBy("doc_id", "page_num")).applyInPandas(lambda g, c: run(g, c) if len(g) else pd.DataFrame({"doc_id": [], "page_num": [], "seq_no": []}), "doc_id bigint, page_num int, seq_no int")
    return glyphs.join(gone, ["doc_id", "page_num", "seq_no"], "left_anti")


def cell_markdown(text: Column) -> Column:
    """A cell's text on one line, with its bars escaped."""
    return F.replace(F.replace(utrim(text), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def tables_markdown(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, markdown): a pipe table of each table's cells (keys, row, col, text); its first row is the head, and a blank
    line follows it."""
    order = Window.partitionBy(*keys).orderBy("row")
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", cell_markdown(F.coalesce("text", F.lit(""))).alias("t")))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["t"]), " | "), F.lit(" |\n"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: F.lit("---")), " | "), F.lit(" |\n"))
    rows = rows.withColumn("first", F.row_number().over(order) == 1).withColumn("line", F.concat(line, F.when(F.col("first"), rule).otherwise("")))
    return rows.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), ""), F.lit("\n")).alias("markdown"))
