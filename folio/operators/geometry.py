"""Ruling lines: edges of rectangles, snapping and joining; and turning pages into visual space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(rects: DataFrame) -> DataFrame:
    """(page, orient, pos, lo, hi): the four edges of each rectangle that isn't empty."""
    side = lambda o, pos, lo, hi: F.struct(F.lit(o).alias("orient"), F.col(pos).alias("pos"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    four = F.array(side("h", "y0", "x0", "x1"), side("h", "y1", "x0", "x1"), side("v", "x0", "y0", "y1"), side("v", "x1", "y0", "y1"))
    return rects.where("x1 > x0 and y1 > y0").select("page", F.inline(four)).distinct()


def snapped(edges: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Edges whose positions lie within the tolerance of their neighbour's take the mean position of their group."""
    order = Window.partitionBy("page", "orient").orderBy("pos", "lo", "hi")
    step = edges.withColumn("new", (F.coalesce(F.col("pos") - F.lag("pos").over(order), F.lit(0.0)) > tolerance).cast("int"))
    step = step.withColumn("g", F.sum("new").over(order))
    mean = F.avg("pos").over(Window.partitionBy("page", "orient", "g"))
    return step.select("page", "orient", F.round(mean, 6).alias("pos"), "lo", "hi")


def joined(edges: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Edges of one position whose intervals meet within the tolerance, as one."""
    order = Window.partitionBy("page", "orient", "pos").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = edges.withColumn("new", F.coalesce(F.col("lo") > reach + tolerance, F.lit(True)).cast("int")).withColumn("g", F.sum("new").over(order))
    return step.groupBy("page", "orient", "pos", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


def turned(df: DataFrame, pages: DataFrame, points: dict[str, str], boxes: tuple[str, ...] = (), keys: tuple[str, ...] = ("doc_id", "page_num")) -> DataFrame:
    """Points (x column: y column) and boxes (structs x0, y0, x1, y1) of pages (keys, width, height, rotate) in visual space,
    where y grows downwards. Quarter turns only: other rotations leave everything as it is. Rows without a page stay out."""
    turn = F.pmod(F.coalesce("rotate", F.lit(0)), F.lit(360))
    step = df.join(pages.select(*keys, F.col("width").alias("_w"), F.col("height").alias("_h"), turn.alias("_turn")).dropDuplicates(list(keys)), list(keys))
    w, h = F.col("_w"), F.col("_h")

    def case(upright, right, over, left, other):
        t = F.col("_turn")
        return F.when(t == 0, upright).when(t == 90, right).when(t == 180, over).when(t == 270, left).otherwise(other)

    new = {}
    for cx, cy in points.items():
        x, y = F.col(cx), F.col(cy)
        new |= {cx: case(x, y, w - x, h - y, x), cy: case(h - y, w - x, h - y, x, y)}
    for b in boxes:
        x0, y0, x1, y1 = (F.col(f"{b}.{c}") for c in ("x0", "y0", "x1", "y1"))
        sides = case(x0, y0, w - x1, h - y1, x0), case(h - y1, w - x1, h - y1, x0, y0), case(x1, y1, w - x0, h - y0, x1), case(h - y0, w - x0, h - y0, x1, y1)
        new[b] = F.struct(*(s.alias(c) for s, c in zip(sides, ("x0", "y0", "x1", "y1"))))
    return step.withColumns(new).drop("_w", "_h", "_turn")


def transformed(x, y, m: list) -> tuple:
    """A point through the matrix [a, b, c, d, e, f]; works on columns and numbers."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def concatenated(m: list, n: list) -> list:
    """The matrix that first does m, then n."""
    return [*(m[r] * n[k] + m[r + 1] * n[k + 2] for r in (0, 2) for k in (0, 1)), m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]
