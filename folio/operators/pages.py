"""Pages: drop rules, headers and footers, body size, heading tiers, and lines made of glyphs of one baseline."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import one_line, re2_to_java
from folio.operators.geometry import turned


#: Body size of a document whose lines have none.
DEFAULT_BODY = 12.0


@dataclass(frozen=True)
class DropRule:
    """Drops lines (or their boxes) on the given pages, all pages if none are given."""

    contains: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    pages: tuple[int, ...] = ()
    whole_box: bool = False
    of_tables: bool = False

    @staticmethod
    def parse(rule: str) -> DropRule:
        """The rule written as PAGES:[table:]PATTERNS. PAGES is * or numbers and ranges; patterns are parted by commas, and
        one that begins with ~ is a regular expression. Malformed rules raise ValueError."""
        pages, colon, patterns = rule.partition(":")
        of_tables = patterns.startswith("table:")
        found = [p.strip() for p in patterns.removeprefix("table:").split(",")]
        numbers: list[int] = []
        for part in filter(None, (x.strip() for x in pages.split(",")) if pages.strip() != "*" else ()):
            ends = re.fullmatch(r"(\+?\d+)(?:-(\+?\d+))?", part)
            low, high = (int(ends[1]), int(ends[2] or ends[1])) if ends else (0, 0)
            if not 1 <= low <= high:
                raise ValueError(f"not a page or range of pages: {part!r}")
            numbers += range(low, high + 1)
        contains, regex = tuple(p for p in found if p and p[0] != "~"), tuple(p[1:] for p in found if p[:1] == "~")
        if not colon or not pages.strip() or not (contains or regex):
            raise ValueError(f"a rule is PAGES:[table:]PATTERNS, not {rule!r}")
        return DropRule(contains, regex, tuple(numbers), of_tables=of_tables)

    def hit(self, text: Column, page: Column) -> Column:
        tests = [F.contains(text, F.lit(c)) for c in self.contains if c]
        for pattern in self.regex:
            try:
                re.compile(pattern)
            except re.error:
                continue  # an invalid pattern matches nothing
            tests.append(text.rlike(re2_to_java(pattern)))
        found = F.lit(False)
        for t in tests:
            found = found | t
        return found & (text != "") & (page.isin(*self.pages) if self.pages else F.lit(True))


def drop_lines(lines: DataFrame, rules: list[DropRule], box: tuple[str, ...] = ("doc", "page"), index: str | None = None) -> DataFrame:
    """Lines that no rule drops. The first rule that hits a line decides whether its box goes too. index: a column with the
    place of a page among its document's pages, from 0, for pages whose number is missing or below 1."""
    rules = [r for r in rules if not r.of_tables]
    if not rules:
        return lines
    page = F.col("page") if index is None else F.when(F.col("page") > 0, F.col("page")).otherwise(F.col(index) + 1)
    hits = F.array(*(F.when(r.hit(F.col("line"), page), F.lit(r.whole_box)) for r in rules))
    first = F.filter(hits, lambda x: x.isNotNull())
    step = lines.withColumn("hit", F.when(F.size(first) > 0, first[0]))
    if not any(r.whole_box for r in rules):
        return step.where("hit is null").drop("hit")
    gone = F.max(F.coalesce("hit", F.lit(False))).over(Window.partitionBy(*box))
    return step.withColumn("gone", gone).where("hit is null and not gone").drop("hit", "gone")


def drop_tables(cells: DataFrame, rules: list[DropRule], keys: tuple[str, ...] = ("doc", "page", "table_no"), index: str | None = None) -> DataFrame:
    """The cells (keys, text) of the tables of which no cell is hit by a rule for tables."""
    rules = [r for r in rules if r.of_tables]
    page = F.col("page") if index is None else F.when(F.col("page") > 0, F.col("page")).otherwise(F.col(index) + 1)
    hit = F.lit(False)
    for r in rules:
        hit = hit | r.hit(F.col("text"), page)
    return cells.withColumn("_gone", F.max(F.coalesce(hit, F.lit(False))).over(Window.partitionBy(*keys))).where("not _gone").drop("_gone")


def running_lines(lines: DataFrame) -> DataFrame:
    """(doc, norm, pages): lines that stand on at least max(3, half) of a document's pages. The lines are read once: a null
    beside each line counts the pages."""
    norms = lines.select("doc", "page", one_line(F.col("line")).alias("norm"))
    seen = norms.select("doc", "page", F.explode(F.array("norm", F.lit(None).cast("string"))).alias("norm")).where("norm is null or norm != ''").distinct()
    counts = seen.groupBy("doc", "norm").agg(F.count("*").alias("pages"))
    total = F.max(F.when(F.col("norm").isNull(), F.col("pages"))).over(Window.partitionBy("doc"))
    # few lines stand on three pages, so few rows meet in the window
    kept = counts.where("norm is null or pages >= 3").withColumn("n", total)
    return kept.where("norm is not null and n >= 3 and pages >= greatest(3, n div 2)").select("doc", "norm", "pages")


def without_running_lines(lines: DataFrame) -> DataFrame:
    """Lines joined by a hash, so that long strings are compared only where it is equal."""
    rows = lines.withColumn("norm", one_line(F.col("line"))).withColumn("_h", F.xxhash64("norm"))
    running = running_lines(lines).select(F.col("doc").alias("_doc"), F.xxhash64("norm").alias("_r"), F.col("norm").alias("_norm"))
    return rows.join(running, (F.col("doc") == F.col("_doc")) & (F.col("_h") == F.col("_r")) & (F.col("norm") == F.col("_norm")), "left_anti").drop("norm", "_h")


def body_size(sized: DataFrame) -> DataFrame:
    """(doc, body): the most frequent size, rounded to half points; the smaller one of ties. A document without sizes gives no
    row; its body size counts as DEFAULT_BODY."""
    counts = sized.where("size > 0").groupBy("doc", (F.round(F.col("size") * 2) / 2).alias("s")).agg(F.count("*").alias("n"))
    return counts.groupBy("doc").agg(F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("body"))


def heading_tiers(sized: DataFrame, words: int = 15) -> DataFrame:
    """(doc, size, level): sizes above the body of short lines, largest first, levels 2 to 6."""
    short = (F.size(F.split(one_line(F.col("line")), " ")) <= words) & (F.regexp_count("line", F.lit(r"[\x{4E00}-\x{9FFF}]")) <= words)
    sizes = sized.join(body_size(sized), "doc").where((F.col("size") > F.col("body") + 0.5) & short).select("doc", F.round("size").alias("tier")).distinct()
    level = F.least(F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("tier"))) + 1, F.lit(6))
    return sizes.select("doc", F.col("tier").alias("size"), level.alias("level"))


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_num, oy, n, text, x0, x1, gaps): the glyphs of one baseline, by place or, where that contradicts the
    drawing order anywhere, by the latter. Gaps wider than the line's average advance become spaces."""
    step = glyphs.where("text is not null").withColumn("advance", F.coalesce("advance", F.lit(0.0)))
    part = F.struct("ox", "seq_no", "glyph_id", "text", "advance")
    rows = step.groupBy("doc_id", "page_num", "oy").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(part)).alias("p"), F.avg(F.when(F.col("advance") > 0, F.col("advance"))).alias("wide"), F.min("bbox.x0").alias("x0"), F.max("bbox.x1").alias("x1"))
    drawn = F.expr("array_sort(p, (a, b) -> case when a.seq_no != b.seq_no then a.seq_no - b.seq_no when a.glyph_id < b.glyph_id then -1 else 1 end)")
    rows = rows.withColumn("p", F.when(F.expr("exists(sequence(1, size(p)), i -> i < size(p) and p[i - 1].seq_no > p[i].seq_no)"), drawn).otherwise(F.col("p")))
    rows = rows.withColumn("gap", F.expr("transform(p, (x, i) -> i > 0 and coalesce(x.ox - (p[i - 1].ox + p[i - 1].advance) > wide, false))"))
    text = F.array_join(F.expr("zip_with(p, gap, (x, g) -> if(g, concat(' ', x.text), x.text))"), "")
    return rows.select("doc_id", "page_num", "oy", "n", text.alias("text"), "x0", "x1", F.size(F.filter("gap", lambda g: g)).cast("bigint").alias("gaps"))


def rotated(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """The glyphs in visual space; the advance becomes the width of the box."""
    return turned(glyphs, pages, {"ox": "oy"}, ("bbox",)).withColumn("advance", F.col("bbox.x1") - F.col("bbox.x0"))
