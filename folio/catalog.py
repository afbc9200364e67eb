"""Every query of the core by name, with the SQL it must agree with."""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import DOT_LEADER, HEADING, STOPS, TOC_MARKS, WS, clean_leaders, clean_special, heading_number, is_toc_content, sentence_split, utrim
from folio.operators import chunks, geometry, layout, markdown, pages, tables
from folio.plans import views
from folio.plans.views import with_views
from folio.session import table

LIMIT = 256
RULES = [pages.DropRule(contains=("cookie", "Cookie")), pages.DropRule(regex=(r"^Draft \d+$", "(invalid"))]
# Fixed value: a contents line, its title taken as short as possible, its leaders and its page.
TOC_LINE = r"^([^\n]{1,150}?)[\t\n\f\r ]*[.。…]{3,} *(\d+)[.。… \t]*\z"
TEXT_RULES = ["*:cookie,~^Draft \\d+$", "1-40,77:Confidential,~^.?[0-9]*$"]
TABLE_RULES = ["*:table:cookie,~^Draft 7", "2:Confidential"]
BOX_RULES = [pages.DropRule(contains=("Draft 7",), whole_box=True)]


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null and text != ''")
    return docs.select("doc_id", "lang", "source", F.posexplode(sentence_split(F.col("text"), LIMIT)).alias("piece_no", "piece"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence pieces counted by language and source."""
    return _pieces(spark, folder).groupBy("lang", "source").agg(F.count("*").alias("pieces"), F.sum(F.length("piece")).alias("chars"), F.max(F.length("piece")).alias("longest"))


def md_headings(spark, folder):
    return markdown.headings(views.lines(views.markdown(spark, folder)))


def md_sections(spark, folder):
    return markdown.sections(views.lines(views.markdown(spark, folder)))


def md_pieces(spark, folder):
    return _pieces(spark, folder).select("doc_id", "piece_no", "piece")


def special_chars_filtered(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", clean_special(F.col("text")).alias("text"))


def toc_content_lines(spark, folder):
    return views.lines(views.markdown(spark, folder)).where(is_toc_content(F.col("line"))).select("doc_id", "line_no")


def heading_numbers(spark, folder):
    return views.lines(views.markdown(spark, folder)).select("doc_id", "line_no", heading_number(F.col("line")).alias("number")).where("number != ''")


def drop_lines(spark, folder):
    return pages.drop_lines(views.page_lines(spark, folder), RULES).select("doc", "page", "line_no")


def drop_boxes(spark, folder):
    return pages.drop_lines(views.page_lines(spark, folder), BOX_RULES).groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("lines"))


def header_footer_lines(spark, folder):
    return pages.running_lines(views.page_lines(spark, folder))


def header_footer_removed(spark, folder):
    return pages.without_running_lines(views.page_lines(spark, folder)).groupBy("doc").agg(F.count("*").alias("lines"))


def body_font_size(spark, folder):
    return pages.body_size(views.sized_lines(spark, folder))


def heading_tiers(spark, folder):
    return pages.heading_tiers(views.sized_lines(spark, folder))


def tier_nearest(spark, folder):
    sized = views.sized_lines(spark, folder)
    big = sized.join(pages.body_size(sized), "doc").where("size > body + 0.5").select("doc", "page", "line_no", "size")
    tiers = pages.heading_tiers(sized).withColumnRenamed("size", "tier")
    return big.join(tiers, "doc").groupBy("doc", "page", "line_no").agg(F.min_by("level", F.struct(F.abs(F.col("size") - F.col("tier")), F.col("level"))).alias("level"))


def rect_edges(spark, folder):
    return geometry.edges(views.rects(spark, folder))


def edge_snap(spark, folder):
    return geometry.snapped(rect_edges(spark, folder))


def edge_join(spark, folder):
    return geometry.joined(edge_snap(spark, folder))


def segment_edges(spark, folder):
    return tables.segment_edges(views.segments(spark, folder))


def ruled_edges(spark, folder):
    """The edges of the rectangles and segments, filtered, snapped, joined and without decoration."""
    return tables.ruled_edges(views.rects(spark, folder), views.segments(spark, folder), views.rect_pages(spark, folder)).select("page", "orient", F.round("pos", 3).alias("pos"), "lo", "hi")


def edge_crossings(spark, folder):
    points = tables.crossing_points(edge_join(spark, folder))
    return points.select("page", "kx", "ky", F.size("hs").alias("hs"), F.size("vs").alias("vs"))


def cells(spark, folder):
    return tables.cells(tables.crossing_points(edge_join(spark, folder))).select("page", *(tables.quantised(c).alias(c) for c in ("x0", "y0", "x1", "y1")))


def cell_groups(spark, folder):
    """Sizes of the groups of cells that hang together, by page."""

    def run(page):
        boxes = sorted(page[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        return pd.DataFrame([(page["page"].iloc[0], len(g), min(boxes[k][0] for k in g), min(boxes[k][1] for k in g)) for g in tables.components([tuple(v / 10 for v in b) for b in boxes])], columns=["page", "n", "x0", "y0"])

    return cells(spark, folder).groupBy("page").applyInPandas(run, "page int, n int, x0 int, y0 int")


def _table_cells(spark, folder):
    boxes = tables.cells(tables.crossing_points(edge_join(spark, folder))).select(F.lit(0).cast("bigint").alias("doc_id"), F.col("page").alias("page_num"), "x0", "y0", "x1", "y1")
    return tables.table_cells(boxes, views.label_glyphs(spark, folder))


def table_grid(spark, folder):
    """The tables of each page: rows, columns, filled places, and the characters in them."""
    rows = _table_cells(spark, folder)
    return rows.groupBy("page_num", "table_no").agg(F.first("n_rows").alias("n_rows"), F.first("n_cols").alias("n_cols"), F.sum((F.col("x1") > F.col("x0")).cast("int")).alias("cells"), F.sum(F.length("text")).alias("chars"))


def table_markdown(spark, folder):
    """The tables as Markdown pipe tables."""
    return tables.tables_markdown(_table_cells(spark, folder), "page_num", "table_no")


def drop_tables(spark, folder):
    """Tables of which no cell is hit by a rule; the cells are the lines of the pages."""
    rows = views.page_lines(spark, folder).withColumn("table_no", (F.col("line_no") / 4).cast("int")).withColumn("text", F.col("line"))
    return pages.drop_tables(rows, [pages.DropRule.parse(r) for r in TABLE_RULES]).groupBy("doc", "page").agg(F.countDistinct("table_no").alias("tables"), F.count("*").alias("cells"))


def drop_dsl(spark, folder):
    """Lines kept by rules that are written as text."""
    return pages.drop_lines(views.page_lines(spark, folder), [pages.DropRule.parse(r) for r in TEXT_RULES]).groupBy("doc", "page").agg(F.count("*").alias("lines"))


def text_lines(spark, folder):
    """The glyphs of each page as lines and boxes."""
    return layout.text_lines(views.visual_glyphs(spark, folder)).select("doc_id", "page_num", "box_no", "line_no", "text", "n", F.round("x0", 3).alias("x0"), F.round("y0", 3).alias("y0"))


def text_boxes(spark, folder):
    return layout.text_boxes(layout.text_lines(views.visual_glyphs(spark, folder))).select("doc_id", "page_num", "box_no", "text", layout.is_vertical(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("vertical"))


def layers_removed(spark, folder):
    """Glyphs left by page without blank layers under others."""
    return layout.without_doubled(views.visual_glyphs(spark, folder)).groupBy("doc_id", "page_num").agg(F.count("*").alias("n"))


def page_markdown(spark, folder):
    """The documents with pages as Markdown."""
    # several plans read the lines; they stay on disk until the session's cache is cleared
    return markdown.pages_markdown(layout.text_lines(layout.without_doubled(views.visual_glyphs(spark, folder))).persist(StorageLevel.DISK_ONLY))


def document_titles(spark, folder):
    return layout.document_title(layout.text_lines(views.visual_glyphs(spark, folder)), table(spark, folder, "pdf_pages"))


def contents_levels(spark, folder):
    """The entries of contents in the chunks and their levels; a chunk is a page, a line's indent its leading blanks."""
    rows = table(spark, folder, "chunks").select("chunk_id", "content").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("doc_id"), F.posexplode(F.split("content", "\n", -1)).alias("line_no", "text"))
    rows = rows.select("doc_id", F.lit(1).alias("page_num"), F.lit(0).alias("box_no"), "line_no", "text", (F.length("text") - F.length(F.ltrim("text"))).cast("double").alias("x"))
    return markdown.contents_entries(rows)


def glyph_lines(spark, folder):
    return pages.glyph_lines(views.glyphs(spark, folder))


def rotate_glyphs(spark, folder):
    """The glyphs in visual space."""
    sides = (F.round(F.col(f"bbox.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1"))
    return views.visual_glyphs(spark, folder).select("glyph_id", F.round("ox", 6).alias("x"), F.round("oy", 6).alias("y"), *sides, F.round("advance", 6).alias("advance"))


def page_font_stats(spark, folder):
    g = views.glyphs(spark, folder)
    return g.groupBy("doc_id", "page_num", "font_name").agg(F.count("*").alias("n"), F.min("bbox.x0").alias("x0"), F.max("bbox.x1").alias("x1"), F.round(F.avg("seq_no"), 6).alias("avg_seq"))


def toc_entries(spark, folder):
    """Contents lines with leaders, as they stand or with the blanks between their leaders taken out: their number, title and
    page."""
    rows = table(spark, folder, "chunks").select("chunk_id", "content").dropDuplicates(["chunk_id"])
    rows = rows.select("chunk_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line")).withColumn("line", utrim(F.col("line")))
    rows = rows.withColumn("line", F.when(F.col("line").rlike(TOC_LINE), F.col("line")).otherwise(clean_leaders(F.col("line")))).where(F.col("line").rlike(TOC_LINE))
    title = utrim(F.regexp_extract("line", TOC_LINE, 1))
    return rows.select("chunk_id", "line_no", heading_number(title).alias("number"), title.alias("title"), F.regexp_extract("line", TOC_LINE, 2).alias("page"))


def _chunks(spark, folder, limit=LIMIT, **options):
    return chunks.markdown_chunks(views.markdown(spark, folder), limit, **options)


def md_chunks(spark, folder):
    """The chunk rows of the Markdown view; the chain of titles is joined, as arrays don't compare everywhere."""
    return _chunks(spark, folder).select("doc_id", "chunk_no", "title", "content", "level", "originlevel", "parentindex", F.coalesce(F.array_join("parent_chain", " / "), F.lit("")).alias("chain"))


def md_chunks_plain(spark, folder):
    """Without cleaning, with lines of contents dropped from the chunks, counted by document."""
    return chunks.run_summary(_chunks(spark, folder, 4096, with_filter=False, filter_toc=True)).select("doc_id", "segments", "chars")


def chunk_overlap(spark, folder):
    """The overlapping pieces of every document, with other characters for those of tables and links, so that SQL can follow."""
    docs = table(spark, folder, "documents").where("text is not null").dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.posexplode(chunks.overlapping(F.translate("text", "|[", "/("), LIMIT, 12)).alias("piece_no", "piece"))


def chunk_protected(spark, folder):
    """The overlapping pieces of every document as it is, tables and links whole."""
    docs = table(spark, folder, "documents").where("text is not null").dropDuplicates(["doc_id"])
    return docs.select("doc_id", F.posexplode(chunks.overlapping(F.col("text"), LIMIT, 12)).alias("piece_no", "piece"))


def split_large_blocks(spark, folder):
    """Markdown chunks of up to 4,096 code points, cut again at 256 with an overlap of 12; characters as in chunk_overlap."""
    docs = views.markdown(spark, folder).withColumn("text", F.translate("text", "|[", "/("))
    rows = chunks.split_large(chunks.markdown_chunks(docs, 4096), LIMIT, 12, link=True)
    return rows.select("doc_id", "chunk_no", "title", "content", "level", "originlevel", "parentindex")


def chunks_json(spark, folder):
    """One JSON object a chunk, nulls kept, in the order of the document."""
    chunks = table(spark, folder, "chunks").drop("loaded_at").dropDuplicates(["chunk_id"])
    row = F.struct("title", "content", "keywords", "parent_chain", "level", "originlevel", "parentindex", "parent_trunk_id_kwd")
    return chunks.select("doc_id", "chunk_no", "chunk_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


QUERIES = {f.__name__: f for f in (flagship, md_headings, md_sections, md_pieces, special_chars_filtered, toc_content_lines, heading_numbers, drop_lines, drop_boxes, header_footer_lines, header_footer_removed, body_font_size, heading_tiers, tier_nearest, rect_edges, edge_snap, edge_join, edge_crossings, glyph_lines, rotate_glyphs, page_font_stats, toc_entries, chunks_json, md_chunks, md_chunks_plain, chunk_overlap, chunk_protected, split_large_blocks, segment_edges, ruled_edges, cells, cell_groups, table_grid, table_markdown, drop_tables, drop_dsl, text_lines, text_boxes, layers_removed, page_markdown, document_titles, contents_levels)}



def _trim(value: str) -> str:
    return rf"regexp_replace({value}, '^{WS}+|{WS}+$', '', 'g')"


_NORM = f"regexp_replace({_trim('line')}, '{WS}+', ' ', 'g')"
_LEVEL = rf"CASE WHEN regexp_matches(line, '{HEADING}') THEN length(regexp_extract(line, '^[ \t]*(#{{1,6}})[ \t]', 1)) ELSE 0 END"
_REST = r"regexp_replace(line, '^[ \t]*#{1,6}', '')"
_TITLE = _trim(rf"CASE WHEN starts_with({_REST}, ' ') THEN regexp_replace({_REST}, '[#\r\n]', '', 'g') ELSE {_REST} END")


def _number(value: str) -> str:
    found = rf"regexp_extract({value}, '^(\d+(?:\.\d+)*)', 1)"
    rest = f"substring({value}, length({found}) + 1, 1)"
    return rf"CASE WHEN {rest} IN ('', ' ', chr(9), chr(10), chr(13)) OR ({found} LIKE '%.%' AND unicode({rest}) > 127) THEN {found} ELSE '' END"


def _leaders(value: str) -> str:
    for pattern, to in ((r"[.。…]\s+[.。…]", ".."), (r"[.。…]\s+[.。…]", ".."), (r"[.。…]\s+(\d)", r".\1"), (r"(\d)\s+[.。…]", r"\1."), (r"(\d)[.。…]+\s*$", r"\1")):
        value = f"regexp_replace({value}, '{pattern}', '{to}', 'g')"
    return value


_STOP = STOPS.replace("\n", r"\n")
_PIECES = f"""p AS (SELECT doc_id, lang, source, text AS rest, '' AS piece, 0 AS k FROM documents WHERE text IS NOT NULL AND text <> ''
    UNION ALL SELECT doc_id, lang, source, substring(rest, length(cut) + 1), cut, k + 1 FROM (SELECT *, CASE WHEN length(rest) <= {LIMIT} THEN rest WHEN regexp_extract(substring(rest, 1, {LIMIT}), '(?s)^.*[{_STOP}]', 0) <> '' THEN regexp_extract(substring(rest, 1, {LIMIT}), '(?s)^.*[{_STOP}]', 0) ELSE substring(rest, 1, {LIMIT}) END AS cut FROM p WHERE rest <> '')),
    q AS (SELECT doc_id, lang, source, k, {_trim('piece')} AS piece FROM p WHERE k > 0)"""
_BODY = "b AS (SELECT doc, s AS body FROM (SELECT doc, s, row_number() OVER (PARTITION BY doc ORDER BY n DESC, s) AS r FROM (SELECT doc, round(size * 2) / 2 AS s, count(*) AS n FROM sized WHERE size > 0 GROUP BY 1, 2)) WHERE r = 1)"
_TIERS = f"t AS (SELECT doc, tier, least(dense_rank() OVER (PARTITION BY doc ORDER BY tier DESC) + 1, 6) AS level FROM (SELECT DISTINCT doc, round(size) AS tier FROM sized JOIN b USING (doc) WHERE size > body + 0.5 AND len(string_split({_NORM}, ' ')) <= 15 AND len(regexp_extract_all(line, '[\\x{{4E00}}-\\x{{9FFF}}]')) <= 15))"
_EDGES = "e AS (SELECT DISTINCT page, orient, pos, lo, hi FROM (SELECT page, 'h' AS orient, y0 AS pos, x0 AS lo, x1 AS hi FROM r UNION ALL SELECT page, 'h', y1, x0, x1 FROM r UNION ALL SELECT page, 'v', x0, y0, y1 FROM r UNION ALL SELECT page, 'v', x1, y0, y1 FROM r))"
_EDGES = "r AS (SELECT * FROM rects WHERE x1 > x0 AND y1 > y0), " + _EDGES
_SNAP = _EDGES + ", sn AS (SELECT page, orient, round(avg(pos) OVER (PARTITION BY page, orient, g), 6) AS pos, lo, hi FROM (SELECT *, sum(new) OVER (PARTITION BY page, orient ORDER BY pos, lo, hi) AS g FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY page, orient ORDER BY pos, lo, hi) > 3 THEN 1 ELSE 0 END AS new FROM e)))"
_JOIN = _SNAP + ", jn AS (SELECT page, orient, pos, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY page, orient, pos ORDER BY lo, hi) AS g FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY page, orient, pos ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS new FROM sn)) GROUP BY page, orient, pos, g)"
_SEGMENTS = "se AS (SELECT DISTINCT page, CASE WHEN abs(x1 - x0) < 0.5 THEN 'v' ELSE 'h' END AS orient, CASE WHEN abs(x1 - x0) < 0.5 THEN x0 ELSE y0 END AS pos, CASE WHEN abs(x1 - x0) < 0.5 THEN least(y0, y1) ELSE least(x0, x1) END AS lo, CASE WHEN abs(x1 - x0) < 0.5 THEN greatest(y0, y1) ELSE greatest(x0, x1) END AS hi FROM segments WHERE (abs(x1 - x0) < 0.5 AND abs(y1 - y0) > 0.5) OR (abs(y1 - y0) < 0.5 AND abs(x1 - x0) > 0.5))"
_WIDER = "o.page = j.page AND o.orient = 'h' AND abs(j.pos - o.pos) BETWEEN 0.5 AND 30 AND o.lo <= j.lo + 3 AND o.hi >= j.hi - 3 AND (j.lo - o.lo >= 5 OR o.hi - j.hi >= 5)"
_CROSS = "cx AS (SELECT h.page, cast(round(v.pos * 10) AS int) AS kx, cast(round(h.pos * 10) AS int) AS ky, min(v.pos) AS x, min(h.pos) AS y, list_sort(list(DISTINCT h.lo)) AS hs, list_sort(list(DISTINCT v.lo)) AS vs FROM jn h JOIN jn v ON h.page = v.page AND h.orient = 'h' AND v.orient = 'v' AND h.lo <= v.pos + 3 AND h.pos BETWEEN v.lo - 3 AND v.hi + 3 GROUP BY 1, 2, 3)"
_CELLS = "ce AS (SELECT page, x AS x0, y AS y0, (min({'y': yb, 'x': xr})).x AS x1, (min({'y': yb, 'x': xr})).y AS y1 FROM (SELECT a.page, a.x, a.y, b.y AS yb, r.x AS xr FROM cx a JOIN cx b ON a.page = b.page AND a.kx = b.kx AND b.y > a.y AND list_has_any(a.vs, b.vs) JOIN cx r ON r.page = a.page AND r.ky = a.ky AND r.x > a.x AND list_has_any(a.hs, r.hs) JOIN cx d ON d.page = a.page AND d.kx = r.kx AND d.ky = b.ky AND list_has_any(d.vs, r.vs) AND list_has_any(d.hs, b.hs)) GROUP BY page, x, y HAVING x1 - x0 >= 5 AND y1 - y0 >= 5)"
_GROUPS = "cq AS (SELECT page, row_number() OVER (ORDER BY page, x0, y0) AS c, cast(round(x0 * 10) AS int) AS x0, cast(round(y0 * 10) AS int) AS y0, cast(round(x1 * 10) AS int) AS x1, cast(round(y1 * 10) AS int) AS y1 FROM ce), co AS (SELECT page, c, x, y FROM (SELECT page, c, unnest([x0, x0, x1, x1]) AS x, unnest([y0, y1, y0, y1]) AS y FROM cq)), li AS (SELECT DISTINCT a.page, a.c, b.c AS d FROM co a JOIN co b USING (page, x, y)), re AS (SELECT page, c, c AS o FROM cq UNION SELECT li.page, li.d, re.o FROM re JOIN li ON li.page = re.page AND li.c = re.c), reach AS (SELECT re.*, cq.x0, cq.y0 FROM re JOIN cq USING (page, c))"
_TURNED = (("x", "ox", "oy", "pw - ox", "ph - oy", "ox"), ("y", "ph - oy", "pw - ox", "ph - oy", "ox", "oy"), ("x0", "bbox.x0", "bbox.y0", "pw - bbox.x1", "ph - bbox.y1", "bbox.x0"), ("y0", "ph - bbox.y1", "pw - bbox.x1", "ph - bbox.y1", "bbox.x0", "bbox.y0"), ("x1", "bbox.x1", "bbox.y1", "pw - bbox.x0", "ph - bbox.y0", "bbox.x1"), ("y1", "ph - bbox.y0", "pw - bbox.x0", "ph - bbox.y0", "bbox.x1", "bbox.y1"), ("advance", "bbox.x1 - bbox.x0", "bbox.y1 - bbox.y0", "bbox.x1 - bbox.x0", "bbox.y1 - bbox.y0", "bbox.x1 - bbox.x0"))
_RUN = f"n AS (SELECT doc, count(DISTINCT page) AS n FROM page_lines GROUP BY 1), h AS (SELECT doc, norm, count(*) AS pages FROM (SELECT DISTINCT doc, page, {_NORM} AS norm FROM page_lines) WHERE norm <> '' GROUP BY 1, 2), run AS (SELECT doc, norm, pages FROM h JOIN n USING (doc) WHERE n >= 3 AND pages >= greatest(3, n // 2))"
_CLEAN = lambda value: _trim(f"replace(replace(regexp_replace(CASE WHEN starts_with({value}, '|') THEN {value} ELSE regexp_replace({value}, '\\n+', chr(10), 'g') END, ' +', ' ', 'g'), '#', ''), chr(9), '')")
_TOC = lambda value: "(" + value + " IN ('目录', 'table of contents') OR " + " OR ".join(f"contains({value}, '{m}')" for m in TOC_MARKS) + ")"
_ABOVE = [f"CASE WHEN p{k}.n > greatest(-1, " + ", ".join(["-1"] + [f"coalesce(p{j}.n, -1)" for j in range(1, k)]) + f") THEN p{k}.t END" for k in range(1, 7)]


def _md(limit: int, clean: bool, strip: bool) -> str:
    """The chunk rows by lines and windows: blocks are runs of lines, cut by recursion."""
    stop = rf"regexp_extract(substring(rest, 1, {limit}), '(?s)^.*[{_STOP}]', 0)"
    done = _CLEAN("piece") if clean else _trim("piece")
    if strip:
        done = _trim(f"array_to_string(list_filter(string_split({done}, chr(10)), lambda x: NOT ({_trim('x')} IN ('目录', '目 录') OR regexp_matches({_trim('x')}, '{DOT_LEADER}'))), chr(10))")
    return f"""ml AS (SELECT doc_id, line_no, line, {_trim('line')} AS t, {_LEVEL} AS level, {_TITLE} AS head FROM md_lines),
    mw AS (SELECT *, coalesce(last_value(CASE WHEN level > 0 THEN line_no END IGNORE NULLS) OVER o, -1) AS sec, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER o AS blanks, """ + ", ".join(f"last_value(CASE WHEN level = {k} THEN {{'n': line_no, 't': head}} END IGNORE NULLS) OVER o AS p{k}" for k in range(1, 7)) + f""" FROM ml WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    ms AS (SELECT doc_id, line_no AS sec, level, list_filter([{", ".join(_ABOVE)}], lambda x: x IS NOT NULL) AS c, lead(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS after FROM mw WHERE level > 0),
    mb AS (SELECT doc_id, sec, CASE WHEN sec < 0 THEN blanks ELSE 0 END AS bid, {_trim("string_agg(line, chr(10) ORDER BY line_no)")} AS block FROM mw WHERE level = 0 AND t <> '' AND NOT {_TOC('lower(t)')} GROUP BY 1, 2, 3),
    mp AS (SELECT doc_id, sec, bid, block AS rest, '' AS piece, 0 AS k FROM mb UNION ALL SELECT doc_id, sec, bid, substring(rest, length(cut) + 1), cut, k + 1 FROM (SELECT *, CASE WHEN length(rest) <= {limit} THEN rest WHEN {stop} <> '' THEN {stop} ELSE substring(rest, 1, {limit}) END AS cut FROM mp WHERE rest <> '')),
    mc AS (SELECT p.doc_id, p.sec, bid, k, {done} AS content, coalesce(c, []) AS c, coalesce(level, 0) AS o FROM mp p LEFT JOIN ms USING (doc_id, sec) WHERE k > 0
        UNION ALL SELECT doc_id, sec, 0, 0, c[len(c)], c[1:len(c) - 1], level - 1 FROM ms WHERE coalesce(after, 0) <= level AND NOT EXISTS (SELECT 1 FROM mb WHERE mb.doc_id = ms.doc_id AND mb.sec = ms.sec)),
    chunked AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY sec, bid, k) - 1 AS int) AS chunk_no, array_to_string(c, ' ') AS title, content, cast(len(c) AS int) AS level, cast(o AS int) AS originlevel, 0 AS parentindex, array_to_string(c, ' / ') AS chain FROM mc WHERE content <> '')"""


# the overlapping cut by recursion, for texts without tables and links: the last place of the best separator in the second half
_SEPS = ", ".join("'" + x.replace("\n", "") + "'" if "\n" not in x else {"\n\n": "chr(10) || chr(10)", "\n": "chr(10)"}[x] for x in chunks.SEPARATORS)


def _overlapping(source: str, size: int, overlap: int) -> str:
    """source: a query (key, text). Gives cp(key, k, piece), the pieces in order."""
    half = size // 2
    ends = f"list_filter(list_transform([{_SEPS}], lambda s: CASE WHEN contains(substring(rest, {half + 1}, {size - half}), s) THEN {size} - instr(reverse(substring(rest, {half + 1}, {size - half})), reverse(s)) + 1 ELSE 0 END), lambda z: z > 0)"
    cut = f"CASE WHEN length(rest) <= {size} THEN length(rest) ELSE coalesce(({ends})[1], {size}) END"
    return f"""ct AS ({source}),
    cr AS (SELECT key, text AS rest, '' AS piece, 0 AS k, CASE WHEN length(text) <= {size} THEN 1 ELSE cast(ceil(length(text) / {size - overlap}.0) AS bigint) END AS most FROM ct
        UNION ALL SELECT key, CASE WHEN e < length(rest) AND e > {overlap} THEN substring(rest, e - {overlap} + 1, {overlap}) || substring(rest, e + 1) ELSE substring(rest, e + 1) END, substring(rest, 1, e), k + 1, most FROM (SELECT *, {cut} AS e FROM cr WHERE k < most AND rest <> '')),
    cp AS (SELECT key, k, piece FROM cr WHERE k > 0 UNION ALL SELECT key, k + 1, rest FROM cr WHERE k = most AND rest <> '' UNION ALL SELECT key, 1, '' FROM ct WHERE text = '')"""


_HIT = "(contains(line, 'cookie') OR contains(line, 'Cookie') OR regexp_matches(line, '^Draft \\d+$'))"
_MARKS = " OR ".join(f"contains(low, '{m}')" for m in TOC_MARKS)


def _with(query: str, more: str, *names: str) -> str:
    return with_views("", *names).rstrip() + (", " if names and more else " ") + more + " " + query


ORACLE = {
    "flagship": "WITH RECURSIVE " + _PIECES + " SELECT lang, source, count(*) AS pieces, sum(length(piece))::bigint AS chars, max(length(piece)) AS longest FROM q WHERE piece <> '' GROUP BY 1, 2",
    "md_headings": with_views(f"SELECT * FROM (SELECT doc_id, line_no, {_LEVEL} AS level, {_TITLE} AS title FROM md_lines) WHERE level > 0", "md", "md_lines"),
    "md_sections": _with(
        "SELECT doc_id, line_no, len(c) AS depth, array_to_string(c, ' ') AS chain FROM (SELECT doc_id, line_no, list_filter([" + ", ".join(f"CASE WHEN p{k}.n > greatest(-1, " + ", ".join(["-1"] + [f"coalesce(p{j}.n, -1)" for j in range(1, k)]) + f") THEN p{k}.t END" for k in range(1, 7)) + "], lambda x: x IS NOT NULL) AS c FROM w)",
        f"l AS (SELECT doc_id, line_no, {_LEVEL} AS level, {_TITLE} AS title FROM md_lines), w AS (SELECT doc_id, line_no, " + ", ".join(f"last_value(CASE WHEN level = {k} THEN {{'n': line_no, 't': title}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS p{k}" for k in range(1, 7)) + " FROM l)",
        "md",
        "md_lines",
    ),
    "md_pieces": "WITH RECURSIVE " + _PIECES + " SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS int) AS piece_no, piece FROM q WHERE piece <> ''",
    "special_chars_filtered": f"SELECT doc_id, {_trim('t')} AS text FROM (SELECT doc_id, replace(replace(regexp_replace(CASE WHEN starts_with(text, '|') THEN text ELSE regexp_replace(text, '\\n+', chr(10), 'g') END, ' +', ' ', 'g'), '#', ''), chr(9), '') AS t FROM documents WHERE text IS NOT NULL)",
    "toc_content_lines": with_views(f"SELECT doc_id, line_no FROM (SELECT doc_id, line_no, lower({_trim('line')}) AS low FROM md_lines) WHERE low IN ('目录', 'table of contents') OR {_MARKS}", "md", "md_lines"),
    "heading_numbers": with_views(f"SELECT * FROM (SELECT doc_id, line_no, {_number('line')} AS number FROM md_lines) WHERE number <> ''", "md", "md_lines"),
    "drop_lines": with_views(f"SELECT doc, page, line_no FROM page_lines WHERE NOT {_HIT}", "page_lines"),
    "drop_boxes": with_views("SELECT doc, count(DISTINCT page) AS pages, count(*) AS lines FROM (SELECT *, bool_or(contains(line, 'Draft 7')) OVER (PARTITION BY doc, page) AS gone FROM page_lines) WHERE NOT gone GROUP BY 1", "page_lines"),
    "header_footer_lines": _with("SELECT * FROM run", _RUN, "page_lines"),
    "header_footer_removed": _with(f"SELECT doc, count(*) AS lines FROM (SELECT doc, {_NORM} AS norm FROM page_lines) l WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.doc = l.doc AND run.norm = l.norm) GROUP BY 1", _RUN, "page_lines"),
    "body_font_size": _with("SELECT doc, body FROM b", _BODY, "page_lines", "sized"),
    "heading_tiers": _with("SELECT doc, tier AS size, level FROM t", _BODY + ", " + _TIERS, "page_lines", "sized"),
    "tier_nearest": _with("SELECT doc, page, line_no, level FROM (SELECT s.doc, s.page, s.line_no, t.level, row_number() OVER (PARTITION BY s.doc, s.page, s.line_no ORDER BY abs(s.size - t.tier), t.level) AS r FROM sized s JOIN b USING (doc) JOIN t USING (doc) WHERE s.size > body + 0.5) WHERE r = 1", _BODY + ", " + _TIERS, "page_lines", "sized"),
    "rect_edges": _with("SELECT * FROM e", _EDGES, "rects"),
    "edge_snap": _with("SELECT * FROM sn", _SNAP, "rects"),
    "edge_join": _with("SELECT * FROM jn", _JOIN, "rects"),
    "segment_edges": _with("SELECT * FROM se", _SEGMENTS, "segments"),
    "ruled_edges": _with("SELECT page, orient, round(pos, 3) AS pos, lo, hi FROM jn j WHERE NOT (orient = 'h' AND EXISTS (SELECT 1 FROM jn o WHERE " + _WIDER + " AND o.pos < j.pos) AND EXISTS (SELECT 1 FROM jn o WHERE " + _WIDER + " AND o.pos > j.pos))", _SEGMENTS + ", " + _JOIN.replace("rects WHERE x1 > x0 AND y1 > y0", "rects JOIN rect_pages USING (page) WHERE x1 > x0 AND y1 - y0 >= 1 AND NOT (x1 - x0 > 0.95 * width AND y1 - y0 > 0.95 * height) AND (x1 - x0) * (y1 - y0) <= 0.5 * width * height").replace("'v', x1, y0, y1 FROM r)", "'v', x1, y0, y1 FROM r UNION ALL SELECT * FROM se) WHERE hi - lo >= 3"), "rects", "segments", "rect_pages"),
    "edge_crossings": _with("SELECT page, kx, ky, cast(len(hs) AS int) AS hs, cast(len(vs) AS int) AS vs FROM cx", _JOIN + ", " + _CROSS, "rects"),
    "cells": _with("SELECT page, cast(round(x0 * 10) AS int) AS x0, cast(round(y0 * 10) AS int) AS y0, cast(round(x1 * 10) AS int) AS x1, cast(round(y1 * 10) AS int) AS y1 FROM ce", _JOIN + ", " + _CROSS + ", " + _CELLS, "rects"),
    "cell_groups": _with("SELECT page, cast(count(DISTINCT cell) AS int) AS n, cast(min(x0) AS int) AS x0, cast(min(y0) AS int) AS y0 FROM (SELECT page, c AS cell, min(o) AS least, any_value(x0) AS x0, any_value(y0) AS y0 FROM reach GROUP BY 1, 2) GROUP BY page, least", _JOIN + ", " + _CROSS + ", " + _CELLS + ", " + _GROUPS, "rects"),
    "drop_tables": _with("SELECT doc, page, count(DISTINCT table_no) AS tables, count(*) AS cells FROM (SELECT *, bool_or(contains(line, 'cookie') OR regexp_matches(line, '^Draft 7')) OVER (PARTITION BY doc, page, table_no) AS gone FROM (SELECT *, line_no // 4 AS table_no FROM page_lines)) WHERE NOT gone GROUP BY 1, 2", "", "page_lines"),
    "drop_dsl": _with("SELECT doc, page, count(*) AS lines FROM page_lines WHERE line = '' OR NOT (contains(line, 'cookie') OR regexp_matches(line, '^Draft \\d+$') OR ((page BETWEEN 1 AND 40 OR page = 77) AND (contains(line, 'Confidential') OR regexp_matches(line, '^.?[0-9]*$')))) GROUP BY 1, 2", "", "page_lines"),
    "glyph_lines": _with("SELECT doc_id, page_num, oy, count(*) AS n, string_agg(CASE WHEN ox - fin > wide THEN ' ' || text ELSE text END, '' ORDER BY place) AS text, min(bbox.x0) AS x0, max(bbox.x1) AS x1, sum(CASE WHEN ox - fin > wide THEN 1 ELSE 0 END)::bigint AS gaps FROM w GROUP BY 1, 2, 3", "w0 AS (SELECT *, coalesce(advance, 0) AS adv, row_number() OVER (PARTITION BY doc_id, page_num, oy ORDER BY ox, seq_no, glyph_id) AS by_x, row_number() OVER (PARTITION BY doc_id, page_num, oy ORDER BY seq_no, glyph_id) AS by_seq, lag(seq_no) OVER (PARTITION BY doc_id, page_num, oy ORDER BY ox, seq_no, glyph_id) > seq_no AS back FROM g WHERE text IS NOT NULL), w1 AS (SELECT *, CASE WHEN bool_or(back) OVER (PARTITION BY doc_id, page_num, oy) THEN by_seq ELSE by_x END AS place FROM w0), w AS (SELECT *, avg(CASE WHEN adv > 0 THEN adv END) OVER (PARTITION BY doc_id, page_num, oy) AS wide, lag(ox + adv) OVER (PARTITION BY doc_id, page_num, oy ORDER BY place) AS fin FROM w1)", "g"),
    "rotate_glyphs": with_views("SELECT glyph_id, " + ", ".join(f"round(CASE t WHEN 0 THEN {a} WHEN 90 THEN {b} WHEN 180 THEN {c} WHEN 270 THEN {d} ELSE {e} END, 6) AS {n}" for n, a, b, c, d, e in _TURNED) + " FROM g JOIN (SELECT doc_id, page_num, width AS pw, height AS ph, ((coalesce(rotate, 0) % 360) + 360) % 360 AS t FROM pdf_pages) USING (doc_id, page_num)", "g"),
    "toc_entries": rf"SELECT chunk_id, line_no, {_number('title')} AS number, title, page FROM (SELECT chunk_id, line_no, {_trim(f"regexp_extract(line, '{TOC_LINE}', 1)")} AS title, regexp_extract(line, '{TOC_LINE}', 2) AS page FROM (SELECT chunk_id, line_no, CASE WHEN regexp_matches(line, '{TOC_LINE}') THEN line ELSE {_leaders('line')} END AS line FROM (SELECT chunk_id, cast(i - 1 AS int) AS line_no, {_trim('parts[i]')} AS line FROM (SELECT DISTINCT chunk_id, string_split(content, chr(10)) AS parts FROM chunks), unnest(range(1, len(parts) + 1)) AS u(i))) WHERE regexp_matches(line, '{TOC_LINE}'))",
    "chunks_json": "SELECT DISTINCT doc_id, chunk_no, chunk_id, cast(json_object('title', title, 'content', content, 'keywords', keywords, 'parent_chain', parent_chain, 'level', level, 'originlevel', originlevel, 'parentindex', parentindex, 'parent_trunk_id_kwd', parent_trunk_id_kwd) AS varchar) AS json FROM chunks",
    "md_chunks": _with("SELECT * FROM chunked", _md(LIMIT, True, False), "md", "md_lines"),
    "md_chunks_plain": _with("SELECT doc_id, count(*) AS segments, sum(length(content))::bigint AS chars FROM chunked GROUP BY 1", _md(4096, False, True), "md", "md_lines"),
    "chunk_overlap": "WITH RECURSIVE " + _overlapping("SELECT DISTINCT doc_id AS key, translate(text, '|[', '/(') AS text FROM documents WHERE text IS NOT NULL", LIMIT, 12) + " SELECT key AS doc_id, cast(k - 1 AS int) AS piece_no, piece FROM cp",
    "split_large_blocks": _with(f"SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, k) - 1 AS int) AS chunk_no, title, CASE WHEN length(whole) > {LIMIT} THEN {_trim('piece')} ELSE whole END AS content, level, CASE WHEN length(whole) > {LIMIT} THEN 0 ELSE originlevel END AS originlevel, chunk_no AS parentindex FROM (SELECT doc_id, chunk_no, title, content AS whole, level, originlevel, k, piece FROM chunked JOIN cp ON cp.key = doc_id || ' ' || chunk_no) WHERE length(whole) <= {LIMIT} OR {_trim('piece')} <> ''", _md(4096, True, False).replace("FROM md_lines", "FROM (SELECT doc_id, line_no, translate(line, '|[', '/(') AS line FROM md_lines)") + ", " + _overlapping("SELECT doc_id || ' ' || chunk_no AS key, content AS text FROM chunked", LIMIT, 12), "md", "md_lines"),
    "page_font_stats": with_views("SELECT doc_id, page_num, font_name, count(*) AS n, min(bbox.x0) AS x0, max(bbox.x1) AS x1, round(avg(seq_no), 6) AS avg_seq FROM g GROUP BY 1, 2, 3", "g"),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
