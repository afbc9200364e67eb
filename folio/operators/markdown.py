"""Markdown: headings and the ancestry of sections; and the lines of pages written as Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import after_number, clean_leaders, heading_level, heading_number, heading_title, one_line, utrim
from folio.operators import layout, pages

# Fixed value: a contents line, its title taken as short as possible.
CONTENTS = r"^([^\n]{1,150}?)[\t\n\f\r ]*[.。…]{3,} *\d+[.。… \t]*\z"
#: Indents, in points, that count as one.
SAME_INDENT = 2.0


def headings(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title) of the heading lines."""
    out = lines.select("doc_id", "line_no", heading_level(F.col("line")).alias("level"), heading_title(F.col("line")).alias("title"))
    return out.where("level > 0")


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, depth, chain): the headings above each line. A heading of level l is an ancestor if it comes
    after the last heading of every shallower level."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    step = lines.withColumn("level", heading_level(F.col("line"))).withColumn("title", heading_title(F.col("line")))
    last = {k: F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(order) for k in range(1, 7)}
    step = step.withColumns({f"p{k}": v for k, v in last.items()})
    kept = []
    for k in range(1, 7):
        above = F.greatest(F.lit(-1), *(F.coalesce(F.col(f"p{j}.line_no"), F.lit(-1)) for j in range(1, k))) if k > 1 else F.lit(-1)
        kept.append(F.when(F.col(f"p{k}.line_no") > above, F.col(f"p{k}.title")))
    chain = F.filter(F.array(*kept), lambda x: x.isNotNull())
    return step.select("doc_id", "line_no", F.size(chain).alias("depth"), F.array_join(chain, " ").alias("chain"))


def contents_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, title, level): the entries of the tables of contents of documents, from lines (doc_id, page_num, box_no,
    line_no, text, x). A numbered entry has as many levels as its number; the level of the others follows from the indents
    seen so far, a fold over the few such lines of a document."""
    title = utrim(F.regexp_extract(utrim(F.col("text")), CONTENTS, 1))
    rows = lines.where(utrim(F.col("text")).rlike(CONTENTS)).select("doc_id", "page_num", "box_no", "line_no", "x", title.alias("title")).where("title != ''")
    rows = rows.groupBy("doc_id", "page_num", "title").agg(F.min_by(F.struct("box_no", "line_no", "x"), F.struct("box_no", "line_no")).alias("f")).select("doc_id", "page_num", "title", "f.*")
    number = heading_number(F.col("title"))
    rows = rows.withColumn("level", F.when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1))

    def run(doc):
        doc = doc.sort_values(["page_num", "box_no", "line_no"], kind="stable")
        known: list[tuple[float, int]] = []
        last: tuple[float, int] | None = None
        out = []
        for ord_, (title, x, level) in enumerate(zip(doc["title"], doc["x"], doc["level"])):
            same = next((lv for at, lv in known if abs(at - x) < SAME_INDENT), None)
            if level == level and level is not None:  # numbered
                level = int(level)
                if same is None:
                    known.append((x, level))
            else:
                if last is None or last[0] < 0:
                    level = 1
                    known.append((x, level))
                elif same is not None:
                    level = same
                elif x > last[0]:
                    level = last[1] + 1
                    known.append((x, level))
                else:
                    level = max([1, *(lv for at, lv in known if at < x + SAME_INDENT)])
                    known.append((x, level))
                last = x, level
            out.append((doc["doc_id"].iloc[0], ord_, title, level))
        return pd.DataFrame(out, columns=["doc_id", "ord", "title", "level"])

    return rows.where("doc_id is not null").groupBy("doc_id").applyInPandas(run, "doc_id bigint, ord int, title string, level int")


def heading_lines(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds to lines what makes them headings: body, tier (the level of the first glyph's size, 0 if none), toc (the first
    entry of the document's contents that a line matches, by number or because one begins with the other), deeper (the level
    of a number whose beginning is in the contents), leaders (is it a contents line?) and t, the text to be written. The
    entries and tiers of a document are few, so they travel as arrays with its lines."""
    sized = lines.select(F.col("doc_id").alias("doc"), F.col("text").alias("line"), "size")
    body = pages.body_size(sized)
    tiers = pages.heading_tiers(sized).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("level", F.col("size").alias("tier")))).alias("tiers"))
    norm = one_line(F.col("title"))
    toc = entries.select("doc_id", F.struct("ord", "title", "level", norm.alias("norm"), heading_number(norm).alias("number")).alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    rows = lines.join(body.withColumnRenamed("doc", "doc_id"), "doc_id", "left").join(tiers.withColumnRenamed("doc", "doc_id"), "doc_id", "left").join(toc, "doc_id", "left")
    rows = rows.withColumn("body", F.coalesce("body", F.lit(pages.DEFAULT_BODY))).withColumn("raw", utrim(F.col("text")))
    near = F.array_min(F.transform("tiers", lambda x: F.struct(F.abs(x["tier"] - F.col("size")).alias("d"), x["level"].alias("level"))))
    rows = rows.withColumn("tier", F.when(F.col("size") > F.col("body") + 0.5, F.coalesce(near["level"], F.lit(0))).otherwise(0))
    cleaned = clean_leaders(F.col("raw"))
    is_toc = F.col("raw").rlike(CONTENTS)
    rows = rows.withColumn("leaders", is_toc | cleaned.rlike(CONTENTS)).withColumn("t", F.when(F.col("leaders"), cleaned).otherwise(F.col("raw")))
    rows = rows.withColumn("norm", one_line(F.col("t"))).withColumn("number", heading_number(F.col("norm")))
    alike = lambda e: (e["norm"] != "") & (F.col("norm") != "") & (((F.col("number") != "") & (e["number"] == F.col("number"))) | F.startswith(F.col("norm"), e["norm"]) | F.startswith(e["norm"], F.col("norm")))
    rows = rows.withColumn("toc", F.when(~F.col("leaders"), F.get(F.filter("entries", alike), F.lit(0))))
    above = F.expr("transform(sequence(1, greatest(size(split(number, '[.]')) - 1, 1)), k -> array_join(slice(split(number, '[.]'), 1, k), '.'))")
    numbers = F.transform("entries", lambda e: e["number"])
    deeper = ~F.col("leaders") & F.contains(F.col("number"), F.lit(".")) & ~F.array_contains(numbers, F.col("number")) & F.arrays_overlap(numbers, above)
    return rows.withColumn("deeper", F.when(deeper, F.regexp_count("number", F.lit(r"\.")) + 1)).drop("entries", "norm", "number", "raw")


def box_markdown(lines: DataFrame) -> DataFrame:
    """(doc_id, page_num, box_no, markdown, y0) of heading_lines. A box whose first line is as large as a heading is one
    heading, unless its text is a contents line."""
    mark = lambda n, text: F.concat(F.repeat(F.lit("#"), n.cast("int")), F.lit(" "), text, F.lit("\n\n"))
    over = F.col("size") - F.col("body")
    sized = F.when(F.size("tiers") > 0, F.when(F.col("tier") > 0, F.col("tier"))).otherwise(F.when(over > 2, 2).when(over > 0.5, 3))
    one = F.when(F.col("toc").isNotNull(), mark(F.col("toc.level") + 1, F.col("toc.title"))).when(F.col("deeper").isNotNull(), mark(F.col("deeper") + 1, F.col("t")))
    one = one.when(sized.isNotNull(), mark(sized, F.col("t"))).otherwise(F.concat("t", F.lit("\n")))
    rows = lines.withColumn("md", F.when(F.col("text") == "", "").otherwise(one))
    rows = rows.groupBy("doc_id", "page_num", "box_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "md", F.when(F.size("tiers") > 0, F.col("tier")).otherwise(0).alias("tier")))).alias("l"), F.min("y0").alias("y0"))
    whole = utrim(layout.box_text(F.transform("l", lambda x: x["text"])))
    first = F.col("l")[0]["tier"]
    return rows.select("doc_id", "page_num", "box_no", F.when((first > 0) & (whole != "") & ~whole.rlike(CONTENTS), mark(first, whole)).otherwise(F.array_join(F.transform("l", lambda x: x["md"]), "")).alias("markdown"), "y0")


def image_markdown(name: Column | str, page: Column | str) -> Column:
    """The link of an image by its saved name, or by the place of its page, from 0."""
    return F.concat(F.lit("![image]("), F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("image_"), F.col(page) if isinstance(page, str) else page)), F.lit(")\n\n"))


def pages_markdown(lines: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown): documents of lines (doc_id, page_num, box_no, line_no, text, size, x, y0) without running lines,
    with headings, and with tables and images (others: doc_id, page_num, kind, no, y0, markdown) in reading order."""
    named = lines.select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), F.col("text").alias("line"), "*")
    # read for the contents, the body size, the tiers and the text itself; on disk until the session's cache is cleared
    kept = pages.without_running_lines(named).drop("doc", "page", "line").persist(StorageLevel.DISK_ONLY)
    boxes = box_markdown(heading_lines(kept, contents_entries(kept))).select("doc_id", "page_num", F.lit("text").alias("kind"), F.col("box_no").alias("no"), "y0", "markdown")
    if others is None:
        items = boxes.withColumn("ord", F.col("no"))
    else:
        items = boxes.unionByName(others.select(*boxes.columns)).persist(StorageLevel.DISK_ONLY)
        items = items.join(layout.reading_order(items), ["doc_id", "page_num", "kind", "no"])
    return items.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "ord", "markdown"))), lambda x: x["markdown"]), "").alias("markdown"))
