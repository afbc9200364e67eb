"""Views over the Parquet tables that the page operators work on: lines, sized lines, rectangles, glyphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.pages import rotated
from folio.session import table


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): each document as a small Markdown file with skipped levels and childless titles."""
    parts = ["intro ", "lang", "\n\nsecond intro\n# ", "source", "\n", "body", "\n\n### ", "lang", "\nstock note\n1.2 body ", "source", "\n## empty\n# end ", "id"]
    d = table(spark, folder, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("body"), F.col("doc_id").cast("string").alias("id"))
    return d.select("doc_id", F.concat(*(F.col(p) if p in d.columns else F.lit(p) for p in parts)).alias("text"))


def lines(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of (doc_id, text)."""
    return df.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)).alias("line_no", "line"))


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, page, line_no, line): a site is a document, a page a page, with a running header and a page footer."""
    d = table(spark, folder, "documents").where("source is not null")
    text = F.concat(F.lit("Confidential "), "source", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\nDraft "), (F.col("doc_id") % 60).cast("string"))
    return d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def sized_lines(spark: SparkSession, folder: str) -> DataFrame:
    """page_lines with a font size."""
    short = F.length("line") < 60
    size = F.when(F.col("line_no") == 0, 18.0).when(short & (F.length("line") % 7 == 0), 14.2).when(short & (F.length("line") % 7 == 1), 12.6).otherwise(10.4)
    return page_lines(spark, folder).withColumn("size", size)


def rects(spark: SparkSession, folder: str) -> DataFrame:
    """(page, x0, y0, x1, y1): table cells with jittered left edges."""
    li = table(spark, folder, "lineitem")
    k, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    return li.select((F.col("l_orderkey") % 500).cast("int").alias("page"), (40.0 * k + (s % 3).cast("double") - 1).alias("x0"), (20.0 * (p % 8)).alias("y0"), (40.0 * (k + 1)).alias("x1"), (20.0 * (p % 8 + 1)).alias("y1")).distinct()


def glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """The glyphs, each once."""
    return table(spark, folder, "glyphs").drop("loaded_at").distinct()


def visual_glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """The glyphs of pages with a size, in visual space."""
    return rotated(glyphs(spark, folder), table(spark, folder, "pdf_pages"))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """(page, x0, y0, x1, y1): rules beside the cells, some of them slanted or written from the right."""
    li = table(spark, folder, "lineitem")
    k, q = F.col("l_linenumber"), F.col("l_quantity")
    return li.select((F.col("l_orderkey") % 500).cast("int").alias("page"), (40.0 * k).alias("x0"), (10.0 * (F.col("l_partkey") % 9)).alias("y0"), F.when(q % 3 == 0, 40.0 * k).when(q % 3 == 1, 40.0 * k - 2 * q).otherwise(40.0 * k + q).alias("x1"), (10.0 * (F.col("l_partkey") % 9) + F.when(q % 3 == 0, q).otherwise(F.when(q % 5 == 0, 7.0).otherwise(0.0))).alias("y1")).distinct()


def rect_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page, width, height) of the pages of rectangles."""
    return table(spark, folder, "lineitem").select((F.col("l_orderkey") % 500).cast("int").alias("page")).distinct().select("page", F.lit(320.0).alias("width"), F.lit(170.0).alias("height"))


def label_glyphs(spark: SparkSession, folder: str) -> DataFrame:
    """Words in the rectangles, a glyph a letter, as the glyph table has them; the pages are those of one document."""
    li = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 500).cast("int").alias("page_num"), "l_linenumber", (F.col("l_partkey") % 8).alias("row"), "l_returnflag", "l_shipdate", "l_orderkey").groupBy("page_num", "l_linenumber", "row").agg(F.max(F.concat("l_returnflag", F.lit("|"), F.date_format("l_shipdate", "yyMM"))).alias("word"))
    letters = li.select("page_num", (40.0 * F.col("l_linenumber") + 4).alias("x"), (20.0 * F.col("row") + 12).alias("y"), (F.col("row") * 1000 + F.col("l_linenumber") * 10).cast("int").alias("at"), F.posexplode(F.split("word", "")).alias("k", "text")).where("text != ''")
    ox = F.col("x") + 5.0 * F.col("k")
    box = F.struct(ox.alias("x0"), (F.col("y") - 7).alias("y0"), (ox + 5).alias("x1"), (F.col("y") + 1).alias("y1"))
    return letters.select(F.lit(0).cast("bigint").alias("doc_id"), "page_num", (F.col("at") + F.col("k")).alias("seq_no"), "text", ox.alias("ox"), F.col("y").alias("oy"), box.alias("bbox"), F.lit(10.0).alias("font_size"), F.lit(5.0).alias("advance"), F.lit(10.0).alias("visual_size"))


SQL = {
    "md": "SELECT doc_id, concat('intro ', coalesce(lang, ''), chr(10), chr(10), 'second intro', chr(10), '# ', coalesce(source, ''), chr(10), coalesce(text, ''), chr(10), chr(10), '### ', coalesce(lang, ''), chr(10), 'stock note', chr(10), '1.2 body ', coalesce(source, ''), chr(10), '## empty', chr(10), '# end ', cast(doc_id AS varchar)) AS text FROM documents",
    "md_lines": "SELECT doc_id, cast(i - 1 AS int) AS line_no, parts[i] AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM md), unnest(range(1, len(parts) + 1)) AS u(i)",
    "page_lines": "SELECT doc, page, cast(i - 1 AS int) AS line_no, parts[i] AS line FROM (SELECT source AS doc, doc_id AS page, string_split(concat('Confidential ', source, chr(10), coalesce(text, ''), chr(10), 'Draft ', cast(doc_id % 60 AS varchar)), chr(10)) AS parts FROM documents WHERE source IS NOT NULL), unnest(range(1, len(parts) + 1)) AS u(i)",
    "sized": "SELECT *, CASE WHEN line_no = 0 THEN 18.0e0 WHEN length(line) < 60 AND length(line) % 7 = 0 THEN 14.2e0 WHEN length(line) < 60 AND length(line) % 7 = 1 THEN 12.6e0 ELSE 10.4e0 END AS size FROM page_lines",
    "rects": "SELECT DISTINCT cast(l_orderkey % 500 AS int) AS page, 40.0e0 * l_linenumber + cast(l_suppkey % 3 AS double) - 1 AS x0, 20.0e0 * (l_partkey % 8) AS y0, 40.0e0 * (l_linenumber + 1) AS x1, 20.0e0 * (l_partkey % 8 + 1) AS y1 FROM lineitem",
    "segments": "SELECT DISTINCT cast(l_orderkey % 500 AS int) AS page, 40.0e0 * l_linenumber AS x0, 10.0e0 * (l_partkey % 9) AS y0, CASE WHEN l_quantity % 3 = 0 THEN 40.0e0 * l_linenumber WHEN l_quantity % 3 = 1 THEN 40.0e0 * l_linenumber - 2 * l_quantity ELSE 40.0e0 * l_linenumber + l_quantity END AS x1, 10.0e0 * (l_partkey % 9) + CASE WHEN l_quantity % 3 = 0 THEN l_quantity WHEN l_quantity % 5 = 0 THEN 7 ELSE 0 END AS y1 FROM lineitem",
    "rect_pages": "SELECT DISTINCT cast(l_orderkey % 500 AS int) AS page, 320.0e0 AS width, 170.0e0 AS height FROM lineitem",
    "g": "SELECT DISTINCT glyph_id, doc_id, page_num, seq_no, text, ox, oy, bbox, font_name, font_size, advance, form_obj, visual_size, clipped FROM glyphs",
}


def with_views(query: str, *names: str) -> str:
    """A query with the views it names in front of it."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + query
