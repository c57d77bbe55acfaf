"""Queries on derived positioned lines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators import align, captions, graph, labels, layout, tables
from vellum.plans.texts import HEAD
from vellum.registry import Registry, table
from vellum.sources import derived
from vellum.sources.derived import EDGE_SQL, LINE_SQL

R = Registry()
WITH = f"WITH {LINE_SQL}"


def line(spark, d):
    return derived.lines(table(spark, d, "documents"))


@R.query("a3_drawing_scan", f"{WITH} SELECT doc_id, line_no, (x1-x0)*(y1-y0) AS area FROM line WHERE (x1-x0)*(y1-y0) < 0.9::DOUBLE*2000.0::DOUBLE")
def _(s, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return line(s, d).select("doc_id", "line_no", area.alias("area")).where(F.col("area") < F.lit(0.9) * F.lit(2000.0))


@R.query("b1_drop_blank_lines", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE regexp_matches(t, '\\S') GROUP BY doc_id")
def _(s, d):
    x = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return x.where(F.col("t").rlike(r"\S")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


NUMBERED = """num AS (SELECT doc_id, line_no, x0, CASE WHEN line_no % 9 = 0 THEN CAST(line_no AS VARCHAR) ELSE text END AS text,
  CASE WHEN line_no % 9 = 0 THEN x0 - 40.0::DOUBLE ELSE x0 END AS nx, y0 FROM line)"""


def numbered(s, d):
    """Every ninth line is a margin number left of the body."""
    hit = F.col("line_no") % 9 == 0
    return line(s, d).withColumn("text", F.when(hit, F.col("line_no").cast("string")).otherwise(F.col("text"))).withColumn("x0", F.when(hit, F.col("x0") - 40).otherwise(F.col("x0")))


@R.query("b2_margin_numbers", f"""{WITH}, {NUMBERED},
m AS (SELECT doc_id, list_sort(list(nx))[CAST(floor(count(*)/2) AS BIGINT)+1] AS body_left FROM num WHERE NOT regexp_matches(text, '^\\s*[0-9]{{1,4}}\\s*$') GROUP BY doc_id)
SELECT doc_id, line_no, text FROM num LEFT JOIN m USING (doc_id) WHERE NOT (regexp_matches(text, '^\\s*[0-9]{{1,4}}\\s*$') AND nx < coalesce(body_left, 0) - 15)""")
def _(s, d):
    return layout.drop_margin_numbers(numbered(s, d)).select("doc_id", "line_no", "text")


@R.query("b9_minimum_support", f"{WITH} SELECT doc_id, line_no FROM line QUALIFY count(*) OVER (PARTITION BY doc_id) >= 5")
def _(s, d):
    return line(s, d).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("doc_id"))).where("n >= 5").select("doc_id", "line_no")


@R.query("b11_body_rects", f"{WITH} SELECT doc_id, line_no, y1 FROM line l WHERE length(text) >= 10 AND NOT EXISTS (SELECT 1 FROM line c WHERE c.doc_id = l.doc_id AND c.bold AND c.x0 = l.x0 AND c.y0 = l.y0 AND c.x1 = l.x1 AND c.y1 = l.y1)")
def _(s, d):
    x = line(s, d)
    caption = x.where("bold").select("doc_id", "x0", "y0", "x1", "y1")
    return x.where("length(text) >= 10").join(caption, ["doc_id", "x0", "y0", "x1", "y1"], "left_anti").select("doc_id", "line_no", "y1")


@R.query("b12_region_graphics", f"""{WITH}, r AS (SELECT doc_id, min(x0) AS rx0, min(y0) AS ry0, max(x1) AS rx1, min(y0) + 60 AS ry1 FROM line GROUP BY doc_id)
SELECT doc_id, count(*) FILTER (WHERE least(x1, rx1) - greatest(x0, rx0) > 2 AND least(y1, ry1) - greatest(y0, ry0) > 2) >= 5 AS has_graphics FROM line JOIN r USING (doc_id) GROUP BY doc_id""")
def _(s, d):
    x = line(s, d)
    region = x.groupBy("doc_id").agg(F.min("x0").alias("rx0"), F.min("y0").alias("ry0"), F.max("x1").alias("rx1"), (F.min("y0") + 60).alias("ry1"))
    meets = (F.least("x1", "rx1") - F.greatest("x0", "rx0") > 2) & (F.least("y1", "ry1") - F.greatest("y0", "ry0") > 2)
    return x.join(region, "doc_id").groupBy("doc_id").agg((F.sum(meets.cast("int")) >= 5).alias("has_graphics"))


SHOWN = f"""{WITH}, page AS (SELECT doc_id, max(x1) * max(y1) AS area FROM line GROUP BY 1),
region AS (SELECT doc_id, line_no // 10 AS region, min(x0) AS x0, min(y0) AS y0, CASE WHEN line_no // 10 % 5 = 3 THEN min(x0) ELSE max(x1) END AS x1, max(y1) AS y1 FROM line GROUP BY 1, 2),
image AS (SELECT doc_id, x0 + 30 AS x0, y0 - 20 AS y0, CASE WHEN length(text) % 2 = 0 THEN x1 ELSE x0 + 33 END AS x1, y1 + 30 AS y1 FROM line WHERE bold),
drawing AS (SELECT doc_id, x0 + 5 AS x0, y1 AS y0, x1 AS x1, CASE WHEN line_no % 2 = 0 THEN y1 ELSE y1 + 25 END AS y1 FROM line WHERE line_no % 3 > 0 UNION ALL SELECT doc_id, 0, 0, max(x1), max(y1) FROM line GROUP BY 1)"""


@R.query("b12_graphics_by_area", f"""{SHOWN}, i AS (SELECT DISTINCT r.doc_id, region FROM region r JOIN image i ON i.doc_id = r.doc_id AND least(i.x1, r.x1) >= greatest(i.x0, r.x0) AND least(i.y1, r.y1) >= greatest(i.y0, r.y0)
  AND (least(i.x1, r.x1) - greatest(i.x0, r.x0)) * (least(i.y1, r.y1) - greatest(i.y0, r.y0)) > (r.x1 - r.x0) * (r.y1 - r.y0) * 0.03::DOUBLE),
n AS (SELECT r.doc_id, region, count(*) AS n FROM region r JOIN drawing d ON d.doc_id = r.doc_id AND least(d.x1, r.x1) >= greatest(d.x0, r.x0) AND least(d.y1, r.y1) >= greatest(d.y0, r.y0) AND (least(d.x1, r.x1) - greatest(d.x0, r.x0) > 2 OR least(d.y1, r.y1) - greatest(d.y0, r.y0) > 2)
  JOIN page ON page.doc_id = r.doc_id WHERE (d.x1 - d.x0) * (d.y1 - d.y0) < area * 0.9::DOUBLE GROUP BY 1, 2)
SELECT doc_id, region, r.x1 > r.x0 AND r.y1 > r.y0 AND (i.doc_id IS NOT NULL OR coalesce(n, 0) >= 5) AS has_graphics FROM region r LEFT JOIN i USING (doc_id, region) LEFT JOIN n USING (doc_id, region)""")
def _(s, d):
    """Regions of ten lines (some without width), images at bold lines (every other one narrow), rules under lines, and the page's ground."""
    x = line(s, d)
    page = x.groupBy("doc_id").agg(F.max("x1").alias("w"), F.max("y1").alias("h"))
    ground = page.selectExpr("doc_id", "0.0D x0", "0.0D y0", "w x1", "h y1")
    region = x.groupBy("doc_id", F.expr("line_no div 10 region")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("r"), F.max("y1").alias("y1"))
    region = region.withColumn("x1", F.when(F.col("region") % 5 == 3, F.col("x0")).otherwise(F.col("r")))
    image = x.where("bold").selectExpr("doc_id", "x0 + 30 x0", "y0 - 20 y0", "case when length(text) % 2 = 0 then x1 else x0 + 33 end x1", "y1 + 30 y1")
    drawing = x.where("line_no % 3 > 0").selectExpr("doc_id", "x0 + 5 x0", "y1 y0", "x1", "case when line_no % 2 = 0 then y1 else y1 + 25 end y1").unionByName(ground)
    return tables.region_graphics(region, image, drawing, page.selectExpr("doc_id", "w * h area"))


@R.query("b13_mostly_figure", f"{WITH} SELECT doc_id, bool_or(bold AND length(text) > 80) OR (sum(length(text)) < 400 AND count(*) FILTER (WHERE bold) >= 1) AS mostly FROM line GROUP BY doc_id")
def _(s, d):
    image = F.bool_or(F.col("bold") & (F.length("text") > 80))
    few = (F.sum(F.length("text")) < 400) & (F.count(F.when(F.col("bold"), 1)) >= 1)
    return line(s, d).groupBy("doc_id").agg((image | few).alias("mostly"))


ALIGNED = """al AS (SELECT doc_id, count(*) AS columns FROM (SELECT doc_id, round_even(x0/8, 0) AS b, count(DISTINCT round_even((y0+y1)/2/4, 0)) AS n FROM line GROUP BY 1, 2 HAVING n >= 3) GROUP BY doc_id)"""


@R.query("b14_looks_like_table", f"{WITH}, {ALIGNED} SELECT doc_id, coalesce(columns, 0) >= 3 OR (count(*) >= 3 AND avg(CASE WHEN length(text) < 60 THEN 1 ELSE 0 END) >= 0.5) AS tabular FROM line LEFT JOIN al USING (doc_id) GROUP BY doc_id, columns")
def _(s, d):
    x = line(s, d)
    short = x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg((F.length("text") < 60).cast("int")).alias("short"))
    y = short.join(layout.aligned_columns(x), "doc_id", "left")
    return y.select("doc_id", ((F.coalesce("columns", F.lit(0)) >= 3) | ((F.col("n") >= 3) & (F.col("short") >= 0.5))).alias("tabular"))


@R.query("b15_region_drop", f"{WITH} SELECT doc_id, max(y1) - min(y0) AS height FROM line GROUP BY doc_id HAVING max(y1) - min(y0) >= 30")
def _(s, d):
    return line(s, d).groupBy("doc_id").agg((F.max("y1") - F.min("y0")).alias("height")).where("height >= 30")


@R.query("b20_first_prose_top", f"{WITH} SELECT doc_id, min(y0) AS top FROM (SELECT *, max(x1) OVER (PARTITION BY doc_id) AS width FROM line) WHERE length(text) >= 60 AND x1 - x0 >= 0.3::DOUBLE * width AND len(regexp_extract_all(text, '  +')) < 2 AND y0 > 80 GROUP BY doc_id")
def _(s, d):
    x = line(s, d).withColumn("width", F.max("x1").over(W.partitionBy("doc_id")))
    prose = (F.length("text") >= 60) & (F.col("x1") - F.col("x0") >= F.col("width") * 0.3) & (F.regexp_count("text", F.lit("  +")) < 2) & (F.col("y0") > 80)
    return x.where(prose).groupBy("doc_id").agg(F.min("y0").alias("top"))


BLOCKS = f"""{WITH}, ln AS (SELECT doc_id, line_no, line_no // 4 AS block, x0, y0, x1, y1, CASE WHEN line_no // 4 % 3 = 1 AND line_no % 4 < 2 THEN replace(text, ',', '   ') ELSE text END AS text FROM line),
page AS (SELECT doc_id, max(x1) - CASE WHEN doc_id % 2 = 0 THEN 200.0 ELSE 60.0 END AS width FROM line GROUP BY 1),
block AS (SELECT doc_id, block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, trim(string_agg(text, ' ' ORDER BY line_no)) AS text, count(*) FILTER (WHERE len(regexp_extract_all(text, '\\S {{2,}}\\S')) >= 2) AS gaps FROM ln GROUP BY 1, 2),
range AS (SELECT doc_id, block AS r, y0 - 10 * (block % 3) AS top, y0 + 150 AS bottom FROM block)"""
_COLUMNS = "(SELECT count(*) FROM (SELECT 1 FROM ln WHERE ln.doc_id = {r}.doc_id AND ln.y1 > {top} AND ln.y0 < {bottom} AND regexp_matches(text, '\\S') GROUP BY round_even(ln.x0 / 8, 0) HAVING count(DISTINCT round_even((ln.y0 + ln.y1) / 2 / 4, 0)) >= 3))"


def blocks(s, d):
    """Lines, blocks of four lines, pages and vertical ranges; every third block has lines whose commas have become gaps."""
    x = line(s, d).withColumn("block", F.expr("line_no div 4"))
    x = x.withColumn("text", F.when((F.col("block") % 3 == 1) & (F.col("line_no") % 4 < 2), F.replace("text", F.lit(","), F.lit("   "))).otherwise(F.col("text")))
    block = x.groupBy("doc_id", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_join(F.collect_list("text"), " ").alias("text"))
    page = x.groupBy("doc_id").agg(F.max("x1").alias("w")).selectExpr("doc_id", "w - case when doc_id % 2 = 0 then 200.0D else 60.0D end width")
    return x, block, page, block.selectExpr("doc_id", "block r", "y0 - 10 * (block % 3) top", "y0 + 150 bottom")


@R.query("b20_prose_in_ranges", f"""{BLOCKS}, prose AS (SELECT doc_id, y0 FROM block JOIN page USING (doc_id) WHERE length(block.text) >= 200 AND x1 - x0 >= greatest(width, 1) * 0.6::DOUBLE AND gaps < 2 AND {_COLUMNS.format(r='block', top='block.y0', bottom='block.y1')} < 3)
SELECT range.doc_id, r, min(y0) AS prose_top FROM range JOIN prose ON prose.doc_id = range.doc_id AND y0 >= top AND y0 < bottom GROUP BY 1, 2""")
def _(s, d):
    x, block, page, ranges = blocks(s, d)
    return tables.first_prose_top(ranges, block, x, page)


@R.query("b14_table_ranges", f"""{BLOCKS}, hit AS (SELECT range.doc_id, r, count(*) AS n, avg(CASE WHEN length(text) < 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS short FROM range JOIN block ON block.doc_id = range.doc_id AND y1 > top AND y0 < bottom AND regexp_matches(text, '\\S') GROUP BY 1, 2)
SELECT range.doc_id, range.r, {_COLUMNS.format(r='range', top='range.top', bottom='range.bottom')} >= 3 OR coalesce(n >= 3 AND short >= 0.5, false) AS tabular FROM range LEFT JOIN hit USING (doc_id, r)""")
def _(s, d):
    x, block, _, ranges = blocks(s, d)
    return tables.looks_like_table(ranges, block, x)


REGIONS = f"""{BLOCKS}, cells AS (SELECT doc_id, line_no, block, x0 + CASE WHEN line_no // 16 % 2 = 0 THEN line_no % 3 * 50 ELSE 0 END AS x0, y0, x1, y1, text FROM ln), pg AS (SELECT doc_id, max(x1) AS width, max(y1) + 40 AS height, max(x1) * max(y1) AS area FROM line GROUP BY 1),
drawing AS (SELECT doc_id, x0 + 5 AS x0, y1 AS y0, x1 + 20 AS x1, CASE WHEN line_no % 2 = 0 THEN y1 ELSE y1 + 25 END AS y1 FROM line WHERE line_no % 5 = 2 UNION ALL SELECT doc_id, 0, 0, max(x1), max(y1) FROM line GROUP BY 1),
ink AS (SELECT d.* FROM drawing d JOIN pg USING (doc_id) WHERE (x1 - x0) * (y1 - y0) < area * 0.9::DOUBLE)"""


def regions(s, d):
    """Lines (in every other stretch of sixteen shifted into three more columns), blocks, ranges, pages with their areas, and drawings: rules under every fifth line, and the ground."""
    x, block, _, ranges = blocks(s, d)
    x = x.withColumn("x0", F.col("x0") + F.when(F.expr("line_no div 16 % 2 = 0"), F.col("line_no") % 3 * 50).otherwise(0))
    page = line(s, d).groupBy("doc_id").agg(F.max("x1").alias("width"), F.max("y1").alias("h")).selectExpr("doc_id", "width", "h + 40 height", "width * h area")
    ground = page.selectExpr("doc_id", "0.0D x0", "0.0D y0", "width x1", "height - 40 y1")
    drawing = line(s, d).where("line_no % 5 = 2").selectExpr("doc_id", "x0 + 5 x0", "y1 y0", "x1 + 20 x1", "case when line_no % 2 = 0 then y1 else y1 + 25 end y1")
    return x, block, page, ranges, drawing.unionByName(ground)


_MEETS = "CASE WHEN b.x1 > a.x0 AND b.x0 < a.x1 AND b.y1 > a.y0 AND b.y0 < a.y1 THEN {'x0': least(a.x0, b.x0), 'y0': greatest(b.t, least(a.y0, b.y0)), 'x1': greatest(a.x1, b.x1), 'y1': least(b.b, greatest(a.y1, b.y1)), 't': b.t, 'b': b.b} ELSE a END"


@R.query("c11_graphics_of_ranges", f"""{REGIONS}, image AS (SELECT doc_id, x0 + 30 AS x0, y0 - 20 AS y0, x0 + 90 AS x1, y1 + 10 AS y1 FROM line WHERE bold AND line_no % 2 = 0),
rects AS (SELECT *, 1 AS image FROM image UNION ALL SELECT *, 0 FROM ink WHERE x1 - x0 > 2 OR y1 - y0 > 2),
seed AS (SELECT doc_id, r, top, bottom, {{'x0': min(x0), 'y0': greatest(top, min(y0)), 'x1': max(x1), 'y1': least(bottom, max(y1)), 't': top, 'b': bottom}} AS seed FROM range JOIN rects USING (doc_id) WHERE y1 > top AND y0 < bottom GROUP BY 1, 2, 3, 4 HAVING sum(image) > 0 OR count(*) >= 3),
txt AS (SELECT range.doc_id, r, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 't': top, 'b': bottom}} ORDER BY block) AS l FROM range JOIN block ON block.doc_id = range.doc_id AND y1 > top AND y0 < bottom GROUP BY 1, 2),
f AS (SELECT doc_id, r, list_reduce(list_prepend(seed, coalesce(l, [])), lambda a, b: {_MEETS}) AS b FROM seed LEFT JOIN txt USING (doc_id, r)) SELECT doc_id, r, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM f""")
def _(s, d):
    x, block, page, ranges, drawing = regions(s, d)
    image = line(s, d).where("bold and line_no % 2 = 0").selectExpr("doc_id", "x0 + 30 x0", "y0 - 20 y0", "x0 + 90 x1", "y1 + 10 y1")
    return tables.graphics_boxes(ranges, image, drawing, block, page)


_CELLS = _COLUMNS.replace("FROM ln ", "FROM cells ln ")


@R.query("e10_table_regions", f"""{REGIONS}, cap AS (SELECT doc_id, line_no AS caption, line_no % 32 < 16 AS is_table, y0, y1 FROM line WHERE line_no % 16 IN (1, 2)),
prose AS (SELECT doc_id, y0 FROM block JOIN pg USING (doc_id) WHERE length(block.text) >= 200 AND x1 - x0 >= greatest(width, 1) * 0.6::DOUBLE AND gaps < 2 AND {_CELLS.format(r='block', top='block.y0', bottom='block.y1')} < 3),
a AS (SELECT doc_id, caption, y1 + 2 AS top, least(height - 10, coalesce((SELECT min(o.y0) - 2 FROM cap o WHERE o.doc_id = cap.doc_id AND o.y0 > cap.y1 + 2), height - 10)) AS bottom FROM cap JOIN pg USING (doc_id) WHERE is_table),
p AS (SELECT a.*, (SELECT min(y0) FROM prose WHERE prose.doc_id = a.doc_id AND y0 >= top AND y0 < bottom) AS prose_top FROM a),
q AS (SELECT doc_id, caption, top, CASE WHEN prose_top - top >= 30 THEN prose_top - 2 ELSE bottom END AS bottom FROM p),
hit AS (SELECT q.doc_id, caption, count(*) AS n, avg(CASE WHEN length(text) < 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS short FROM q JOIN block ON block.doc_id = q.doc_id AND y1 > top AND y0 < bottom AND regexp_matches(text, '\\S') GROUP BY 1, 2),
t AS (SELECT q.* FROM q LEFT JOIN hit USING (doc_id, caption) WHERE bottom - top >= 30 AND ({_CELLS.format(r='q', top='q.top', bottom='q.bottom')} >= 3 OR coalesce(n >= 3 AND short >= 0.5, false))),
rects AS (SELECT doc_id, x0, y0, x1, y1 FROM block WHERE regexp_matches(text, '\\S') UNION ALL SELECT doc_id, x0, y0, x1, y1 FROM ink),
c AS (SELECT t.doc_id, caption, min(x0) AS x0, greatest(min(y0), max(top)) AS y0, max(x1) AS x1, least(max(y1), max(bottom)) AS y1 FROM t JOIN rects ON rects.doc_id = t.doc_id AND y1 > top AND y0 < bottom GROUP BY 1, 2)
SELECT doc_id, caption, greatest(0.0::DOUBLE, x0 - 6) AS x0, greatest(0.0::DOUBLE, y0 - 4) AS y0, least(width, x1 + 6) AS x1, least(height, y1 + 4) AS y1 FROM c JOIN pg USING (doc_id)""")
def _(s, d):
    """Captions every sixteenth line, by turns of tables and of figures, two beside each other: prose, columns and content decide where their tables are."""
    x, block, page, _, drawing = regions(s, d)
    caption = line(s, d).where("line_no % 16 in (1, 2)").selectExpr("doc_id", "line_no caption", "line_no % 32 < 16 is_table", "y0", "y1")
    return tables.table_regions(caption, block, x, drawing, page)


@R.query("b21_vertical_range", f"{WITH} SELECT doc_id, line_no FROM line WHERE y1 > 100 AND y0 < 200")
def _(s, d):
    return line(s, d).where("y1 > 100 and y0 < 200").select("doc_id", "line_no")


RANGES = """off AS (SELECT doc_id, line_no, x0, y0, x1, y1, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(text) - 1 AS ls, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS le FROM line),
sent AS (SELECT doc_id, k, k * 100 AS s, k * 100 + 130 AS e FROM (SELECT doc_id, unnest(range(0, CAST(ceil(max(le) / 100.0) AS BIGINT))) AS k FROM off GROUP BY doc_id))"""


def ranges(s, d):
    """Character ranges of the lines of a page, and sentences as ranges of 130 characters every 100."""
    end = F.sum(F.length("text") + 1).over(W.partitionBy("doc_id").orderBy("line_no"))
    off = line(s, d).select("doc_id", "line_no", "x0", "y0", "x1", "y1", (end - F.length("text") - 1).alias("ls"), (end - 1).alias("le"))
    sent = off.groupBy("doc_id").agg(F.max("le").alias("m")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / 100) - 1)).alias("k"))
    return off, sent.select("doc_id", "k", (F.col("k") * 100).alias("s"), (F.col("k") * 100 + 130).alias("e"))


@R.query("c4_interval_overlap", f"""{WITH}, {RANGES} SELECT doc_id, k, line_no, x0 + (x1-x0) * (CAST(greatest(s, ls) - ls AS DOUBLE) / CAST(le-ls AS DOUBLE)) AS rx0, x0 + (x1-x0) * (CAST(least(e, le) - ls AS DOUBLE) / CAST(le-ls AS DOUBLE)) AS rx1
FROM off JOIN sent USING (doc_id) WHERE NOT (le <= s OR ls >= e)""")
def _(s, d):
    off, sent = ranges(s, d)
    x = layout.overlapping(off, sent, "doc_id", "ls", "le", "s", "e", 200)
    at = lambda c: F.col("x0") + (F.col("x1") - F.col("x0")) * ((c - F.col("ls")).cast("double") / (F.col("le") - F.col("ls")).cast("double"))
    return x.select("doc_id", "k", "line_no", at(F.greatest("s", "ls")).alias("rx0"), at(F.least("e", "le")).alias("rx1"))


@R.query("c5_span_overlap", f"""{WITH}, {RANGES} SELECT doc_id, k, line_no, CAST(greatest(s, ls) - s AS BIGINT) AS span_start, CAST(least(e, le) - s AS BIGINT) AS span_end FROM off JOIN sent USING (doc_id) WHERE line_no % 3 = 0 AND NOT (le <= s OR ls >= e)""")
def _(s, d):
    off, sent = ranges(s, d)
    x = layout.overlapping(off.where("line_no % 3 = 0"), sent, "doc_id", "ls", "le", "s", "e", 200)
    return x.select("doc_id", "k", "line_no", (F.greatest("s", "ls") - F.col("s")).alias("span_start"), (F.least("e", "le") - F.col("s")).alias("span_end"))


@R.query("c6_line_numbers_of_rects", f"""{WITH}, num AS (SELECT doc_id, line_no AS n, (y0+y1)/2 + 0.5::DOUBLE AS mid FROM line WHERE line_no % 2 = 0)
SELECT l.doc_id, l.line_no, min(n) AS first, max(n) AS last FROM line l JOIN num USING (doc_id) WHERE mid BETWEEN y0 - 1 AND y1 + 1 GROUP BY 1, 2""")
def _(s, d):
    x = line(s, d)
    num = x.where("line_no % 2 = 0").select("doc_id", F.col("line_no").alias("n"), ((F.col("y0") + F.col("y1")) / 2 + 0.5).alias("mid"))
    band = lambda c: F.floor(c / 64)
    x = x.withColumn("band", F.explode(F.sequence(band(F.col("y0") - 1), band(F.col("y1") + 1))))
    hit = x.join(num.withColumn("band", band(F.col("mid"))), ["doc_id", "band"]).where(F.col("mid").between(F.col("y0") - 1, F.col("y1") + 1))
    return hit.groupBy("doc_id", "line_no").agg(F.min("n").alias("first"), F.max("n").alias("last"))


@R.query("c12_figure_tops", f"""{WITH} SELECT c.doc_id, c.line_no, c.y0 AS top, coalesce((SELECT max(b.y1) FROM line b WHERE b.doc_id = c.doc_id AND NOT b.bold AND b.y1 <= c.y0), 0.0::DOUBLE) AS above FROM line c WHERE c.bold""")
def _(s, d):
    x = line(s, d)
    return layout.figure_tops(x.where("bold"), x.where("not bold"))


@R.query("c13_table_bottoms", f"""{WITH}, page AS (SELECT *, max(y1) OVER (PARTITION BY doc_id) AS foot FROM line)
SELECT doc_id, line_no, y0, coalesce(lead(y0) OVER (PARTITION BY doc_id ORDER BY y0, line_no), foot) AS bottom FROM page WHERE bold""")
def _(s, d):
    """Down to the next caption, the last one's down to the foot of the page."""
    x = line(s, d).withColumn("foot", F.max("y1").over(W.partitionBy("doc_id"))).where("bold")
    return x.select("doc_id", "line_no", "y0", F.coalesce(F.lead("y0").over(W.partitionBy("doc_id").orderBy("y0", "line_no")), "foot").alias("bottom"))


CLUSTERS = """cl AS (SELECT doc_id, cluster, count(*) AS n, min(x0) AS low, avg(x0) AS centre FROM (SELECT doc_id, x0, sum(new) OVER (PARTITION BY doc_id ORDER BY x0, line_no ROWS UNBOUNDED PRECEDING) AS cluster FROM
 (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0, line_no) > 30 THEN 1 ELSE 0 END AS new FROM line)) GROUP BY 1, 2),
pg AS (SELECT doc_id, count(*) AS lines, max(x1) AS width FROM line GROUP BY 1),
mj AS (SELECT cl.*, width FROM cl JOIN pg USING (doc_id) WHERE lines >= 10 AND n >= greatest(5.0::DOUBLE, lines * 0.15::DOUBLE)),
two AS (SELECT doc_id FROM mj GROUP BY doc_id HAVING count(*) >= 2 AND max(low) - min(low) >= min(width) * 0.3::DOUBLE),
col AS (SELECT l.*, coalesce((SELECT k FROM (SELECT abs(m.centre - l.x0) AS d, row_number() OVER (ORDER BY m.cluster) - 1 AS k FROM mj m WHERE m.doc_id = l.doc_id AND m.doc_id IN (SELECT doc_id FROM two)) ORDER BY d, k LIMIT 1), 0) AS "column" FROM line l)"""


@R.query("e3_column_clusters", f"{WITH}, {CLUSTERS} SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, n, low, centre FROM cl")
def _(s, d):
    return layout.column_clusters(line(s, d)).withColumn("cluster", F.col("cluster").cast("long"))


@R.query("c14_nearest_column", f'{WITH}, {CLUSTERS} SELECT doc_id, line_no, CAST("column" AS BIGINT) AS col FROM col')
def _(s, d):
    return layout.columns(line(s, d)).select("doc_id", "line_no", F.col("column").alias("col"))


@R.query("f1_reading_order", f'{WITH}, {CLUSTERS} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY "column", round_even(y0, 1), x0, line_no) - 1 AS i FROM col')
def _(s, d):
    return layout.reading_order(layout.columns(line(s, d))).select("doc_id", "line_no", "i")


PARAGRAPH_SQL = f"""{CLUSTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "column", round_even(y0, 1), x0, line_no) - 1 AS i, line_no // 6 AS block FROM col),
pt AS (SELECT doc_id, "column", quantile_cont(p, 0.5) AS usual FROM (SELECT doc_id, "column", y - lag(y) OVER (PARTITION BY doc_id, "column" ORDER BY y) AS p FROM (SELECT DISTINCT doc_id, "column", round_even(y0, 1) AS y FROM o)) WHERE p > 0 AND p < 80 GROUP BY 1, 2),
x AS (SELECT o.*, coalesce(usual, 0) AS usual, max(x1) OVER c AS r, min(x0) OVER c AS l, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(size) OVER w AS psize, lag(bold) OVER w AS pbold, lag(text) OVER w AS ptext, lag(block) OVER w AS pblock
  FROM o LEFT JOIN pt USING (doc_id, "column") WINDOW c AS (PARTITION BY doc_id, "column"), w AS (PARTITION BY doc_id, "column" ORDER BY i)),
y AS (SELECT *, greatest(py1-py0, y1-y0, 6.0) AS h, y0 - py0 AS pitch, size/psize >= 1.18 OR size/psize <= 0.85 AS sb, pbold <> bold AND (length(trim(ptext)) < 100 OR length(trim(text)) < 100) AS bb FROM x),
z AS (SELECT *, CASE WHEN ptext IS NULL THEN 0 WHEN pblock <> block THEN CAST(NOT (NOT sb AND NOT bb AND (least(px1-px0, x1-x0) <= 0 OR least(px1, x1) - greatest(px0, x0) > least(px1-px0, x1-x0) * 0.5)
  AND NOT (regexp_matches(ptext, '[。！？]\\s*$') AND regexp_matches(text, '^[（(]?[０-９]{{1,2}}[)）．、.]'))
  AND ((NOT regexp_matches(ptext, '[.!?:;。！？]['||chr(39)||'"”’)\\]]?\\s*$') AND regexp_matches(text, '^\\s*[a-z(\\[]') AND (usual <= 0 OR (pitch > 0 AND pitch <= usual * 2.2)))
    OR (usual > 0 AND pitch > 0 AND pitch <= usual * 1.25 AND NOT px1 < r - greatest(24.0, h * 1.5) AND NOT x0 > l + 6))) AS INT)
  ELSE CAST(greatest(0, y0 - py1) > h * 0.55 OR sb OR bb AS INT) END AS new FROM y),
para AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, "column" ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM z)"""
PARAGRAPHS = f'{PARAGRAPH_SQL} SELECT doc_id, "column" AS col, i, p FROM para'


@R.query("e1_paragraphs", f"{WITH}, {PARAGRAPHS}")
def _(s, d):
    x = layout.reading_order(layout.columns(line(s, d))).withColumn("block", F.floor(F.col("line_no") / 6))
    return layout.paragraphs(x).select("doc_id", F.col("column").alias("col"), "i", "p")


#: Two spans to a line, cut after its tenth character; every third line's first span is in a bold font, others only say so by a flag.
SPANS = """SELECT doc_id, line_no, substr(text, 1, 10) AS text, CASE WHEN line_no % 3 = 0 THEN 'Times-Bold' ELSE 'Times' END AS font, size AS size FROM {line}
UNION ALL SELECT doc_id, line_no, substr(text, 11) AS text, CASE WHEN line_no % 4 = 0 THEN 'times-boldItalic' ELSE 'Times' END AS font, size + 1.0 AS size FROM {line}"""


@R.query("e19_harness_paragraphs", f"""WITH {LINE_SQL.replace("line AS (", "raw AS (", 1)}, span AS ({SPANS.format(line="raw")}),
seen AS (SELECT doc_id, line_no, coalesce(avg(size) FILTER (WHERE regexp_matches(text, '\\S')), 10.0::DOUBLE) AS size,
  CAST(coalesce(sum(length(text)) FILTER (WHERE regexp_matches(text, '\\S') AND contains(lower(font), 'bold')), 0) AS DOUBLE) / sum(length(text)) > 0.6::DOUBLE AS bold
  FROM span GROUP BY 1, 2 HAVING bool_or(regexp_matches(text, '\\S'))),
line AS (SELECT r.doc_id, r.line_no, r.text, x0, y0, x1, y1, seen.size, seen.bold FROM raw r JOIN seen USING (doc_id, line_no)), {PARAGRAPHS}""")
def _(s, d):
    x = line(s, d)
    spans = s.sql(SPANS.format(line="{line}"), line=x)
    x = x.drop("size", "bold").join(layout.plain_lines(spans), ["doc_id", "line_no"])
    x = layout.reading_order(layout.columns(x)).withColumn("block", F.floor(F.col("line_no") / 6))
    return layout.paragraphs(x).select("doc_id", F.col("column").alias("col"), "i", "p")


@R.query("e14_dehyphenated_text", f"""{WITH}, p AS (SELECT doc_id, line_no // 4 AS p, line_no AS i, CASE WHEN line_no % 3 = 0 THEN text || '-' ELSE lower(text) END AS text FROM line),
q AS (SELECT *, lag(rtrim(text)) OVER (PARTITION BY doc_id, p ORDER BY i) AS b FROM p)
SELECT doc_id, p, string_agg(CASE WHEN b IS NULL OR (regexp_matches(b, '[A-Za-z]-$') AND NOT regexp_matches(b, '--$') AND regexp_matches(ltrim(text), '^[a-z]')) THEN '' ELSE ' ' END || trim(text), '' ORDER BY i) AS joined, count(*) AS lines FROM q GROUP BY 1, 2""")
def _(s, d):
    x = line(s, d).selectExpr("doc_id", "0 column", "line_no div 4 p", "line_no i", "case when line_no % 3 = 0 then concat(text, '-') else lower(text) end text")
    return layout.joined_text(x).select("doc_id", "p", "joined", "lines")


@R.query("e15_line_offsets", f"{WITH} SELECT doc_id, line_no, CAST(sum(length(trim(text)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(trim(text)) - 1 AS BIGINT) AS start FROM line")
def _(s, d):
    end = F.sum(F.length(F.trim("text")) + 1).over(W.partitionBy("doc_id").orderBy("line_no"))
    return line(s, d).select("doc_id", "line_no", (end - F.length(F.trim("text")) - 1).cast("long").alias("start"))


#: Lines with other white space, a strange beginning (not found), a strange end (found by twenty characters), or nothing; the same expression in both dialects.
ALTERED = "CASE line_no % 7 WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN concat({tab}, text, ' ') WHEN 2 THEN concat('ZZ', text) WHEN 3 THEN concat(text, 'QQ') WHEN 4 THEN ' ' ELSE text END"


@R.query("e15_lines_found", f"""{WITH.replace("WITH", "WITH RECURSIVE")}, l AS (SELECT doc_id, line_no // 5 AS p, line_no, row_number() OVER (PARTITION BY doc_id, line_no // 5 ORDER BY line_no) AS k, text, trim(regexp_replace({ALTERED.format(tab="chr(9)")}, '[ \t\r\n]+', ' ', 'g')) AS t FROM line),
j AS (SELECT doc_id, p, string_agg(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), ' ' ORDER BY line_no) AS joined FROM l GROUP BY 1, 2),
walk AS (SELECT doc_id, p, 0::BIGINT AS k, 0::BIGINT AS cursor, NULL::BIGINT AS start FROM j
  UNION ALL SELECT doc_id, p, k, CASE WHEN pos > 0 THEN cursor + pos - 1 + n ELSE cursor END, CASE WHEN pos > 0 THEN cursor + pos - 1 END FROM (
    SELECT w.doc_id, w.p, l.k, cursor, length(t) AS n, CASE WHEN t = '' THEN 0 WHEN instr(joined[cursor + 1:], t) > 0 THEN instr(joined[cursor + 1:], t) WHEN length(t) >= 20 THEN instr(joined[cursor + 1:], t[1:20]) ELSE 0 END AS pos
    FROM walk w JOIN j USING (doc_id, p) JOIN l ON l.doc_id = w.doc_id AND l.p = w.p AND l.k = w.k + 1))
SELECT doc_id, p, line_no, start, start + length(t) AS "end" FROM walk JOIN l USING (doc_id, p, k) WHERE start IS NOT NULL""")
def _(s, d):
    x = line(s, d).selectExpr("doc_id", "line_no div 5 p", "line_no", "text", ALTERED.format(tab="'\t'") + " altered")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text", "altered")))
    para = x.groupBy("doc_id", "p").agg(rows.alias("rows"))
    joined = F.array_join(F.transform("rows", lambda r: F.trim(F.regexp_replace(r["text"], "[ \t\r\n]+", " "))), " ")
    return align.lines_in_paragraphs(para.select("doc_id", "p", joined.alias("joined"), F.transform("rows", lambda r: F.struct(r["line_no"], r["altered"].alias("text"))).alias("lines")))


NEAR = """greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 0.8::DOUBLE * greatest(least(a.y1-a.y0, b.y1-b.y0), 1.0::DOUBLE) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 1.5::DOUBLE * greatest(least(a.y1-a.y0, b.y1-b.y0), 1.0::DOUBLE)"""


@R.query("c17_near_boxes", f"{WITH} SELECT a.doc_id, a.line_no AS a, b.line_no AS b FROM line a JOIN line b ON a.doc_id = b.doc_id AND a.line_no < b.line_no AND {NEAR}")
def _(s, d):
    return layout.near_pairs(line(s, d))


@R.query("c11_graphics_bbox", f"""{WITH}, boxes AS (SELECT doc_id, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY line_no) AS l FROM line GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(list_prepend({{'x0': 72.0::DOUBLE, 'y0': 72.0::DOUBLE, 'x1': 100.0::DOUBLE, 'y1': 100.0::DOUBLE}}, l), lambda a, b:
  CASE WHEN b.x0 < a.x1 AND b.x1 > a.x0 AND b.y0 < a.y1 AND b.y1 > a.y0 THEN {{'x0': least(a.x0, b.x0), 'y0': least(a.y0, b.y0), 'x1': greatest(a.x1, b.x1), 'y1': greatest(a.y1, b.y1)}} ELSE a END) AS box FROM boxes)
SELECT doc_id, box.x0 AS x0, box.y0 AS y0, box.x1 AS x1, box.y1 AS y1 FROM f""")
def _(s, d):
    box = F.aggregate(
        F.array_sort(F.collect_list(F.struct("line_no", "x0", "y0", "x1", "y1"))),
        F.expr("struct(72.0D as x0, 72.0D as y0, 100.0D as x1, 100.0D as y1)"),
        lambda a, b: F.when((b["x0"] < a["x1"]) & (b["x1"] > a["x0"]) & (b["y0"] < a["y1"]) & (b["y1"] > a["y0"]), F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))).otherwise(a),
    )
    return line(s, d).groupBy("doc_id").agg(box.alias("box")).select("doc_id", "box.*")


@R.query("d1_left_margin", f"{WITH} SELECT doc_id, list_sort(list(x0))[CAST(floor(count(*)/2) AS BIGINT)+1] AS body_left FROM line WHERE NOT regexp_matches(text, '^\\s*[0-9]{{1,4}}\\s*$') GROUP BY doc_id")
def _(s, d):
    return layout.left_margin(line(s, d))


@R.query("d2_median_pitch", f"{WITH} SELECT doc_id, quantile_cont(p, 0.5) AS pitch FROM (SELECT doc_id, y - lag(y) OVER (PARTITION BY doc_id ORDER BY y) AS p FROM (SELECT DISTINCT doc_id, round_even(y0, 1) AS y FROM line)) WHERE p > 0 AND p < 80 GROUP BY doc_id")
def _(s, d):
    return layout.median_pitch(line(s, d))


@R.query("d3_extents", f"{WITH} SELECT doc_id, max(x1) AS right_edge, min(x0) AS left_edge FROM line GROUP BY doc_id")
def _(s, d):
    return line(s, d).groupBy("doc_id").agg(F.max("x1").alias("right_edge"), F.min("x0").alias("left_edge"))


@R.query("d4_weighted_size", f"{WITH} SELECT doc_id, coalesce(sum(CASE WHEN line_no % 5 <> 0 THEN size * length(text) END) / sum(CASE WHEN line_no % 5 <> 0 THEN length(text) END), avg(size), 10.0::DOUBLE) AS size FROM line GROUP BY doc_id")
def _(s, d):
    plain = F.col("line_no") % 5 != 0
    mean = F.sum(F.when(plain, F.col("size") * F.length("text"))) / F.sum(F.when(plain, F.length("text")))
    return line(s, d).groupBy("doc_id").agg(F.coalesce(mean, F.avg("size"), F.lit(10.0)).alias("size"))


@R.query("d5_bold_ratio", f"{WITH} SELECT doc_id, CAST(sum(CASE WHEN bold THEN length(text) ELSE 0 END) AS DOUBLE) / sum(length(text)) > 0.05::DOUBLE AS bold FROM line GROUP BY doc_id")
def _(s, d):
    share = F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)) / F.sum(F.length("text"))
    return line(s, d).groupBy("doc_id").agg((share > 0.05).alias("bold"))


@R.query("d6_union_box", f"{WITH} SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM line GROUP BY doc_id")
def _(s, d):
    return line(s, d).groupBy("doc_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@R.query("d7_text_length", f"{WITH} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n FROM line GROUP BY doc_id")
def _(s, d):
    return line(s, d).groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))


@R.query("d10_aligned_columns", f"{WITH}, {ALIGNED} SELECT * FROM al")
def _(s, d):
    return layout.aligned_columns(line(s, d))


@R.query("d11_short_fraction", f"{WITH} SELECT doc_id, avg(CASE WHEN length(text) < 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS short FROM line GROUP BY doc_id")
def _(s, d):
    return line(s, d).groupBy("doc_id").agg(F.avg((F.length("text") < 60).cast("double")).alias("short"))


@R.query("d15_gap_lines", f"{WITH} SELECT doc_id, line_no FROM line WHERE len(regexp_extract_all(replace(text, ',', '   '), '  +')) >= 2")
def _(s, d):
    return line(s, d).where(F.regexp_count(F.replace("text", F.lit(","), F.lit("   ")), F.lit("  +")) >= 2).select("doc_id", "line_no")


@R.query("d20_leading_caption", f"{WITH} SELECT doc_id, line_no, y0 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, line_no) AS rn FROM line WHERE bold) WHERE rn = 1 AND y0 < 0.4::DOUBLE * 500.0::DOUBLE")
def _(s, d):
    top = line(s, d).where("bold").groupBy("doc_id").agg(F.min(F.struct("y0", "line_no")).alias("m"))
    return top.select("doc_id", "m.line_no", "m.y0").where(F.col("y0") < F.lit(0.4) * F.lit(500.0))


@R.query("d22_widest_rect", f"{WITH} SELECT doc_id, line_no // 6 AS p, max(x1 - x0) AS width FROM line GROUP BY 1, 2")
def _(s, d):
    return line(s, d).groupBy("doc_id", F.expr("line_no div 6 p")).agg(F.max(F.col("x1") - F.col("x0")).alias("width"))


@R.query("d23_body_size", f"{WITH} SELECT doc_id, max(m) AS body FROM (SELECT doc_id, line_no // 6 AS p, list_sort(list(size))[CAST(floor(count(*)/2) AS BIGINT)+1] AS m FROM line WHERE NOT bold GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    by = line(s, d).where("not bold").groupBy("doc_id", F.expr("line_no div 6 p")).agg(layout.upper_median(F.col("size")).alias("m"))
    return by.groupBy("doc_id").agg(F.max("m").alias("body"))


@R.query("d24_all_bold", f"{WITH} SELECT doc_id, line_no // 3 AS p, bool_and(bold) AS every_line FROM line GROUP BY 1, 2")
def _(s, d):
    return line(s, d).groupBy("doc_id", F.expr("line_no div 3 p")).agg(F.every("bold").alias("every_line"))


@R.query("d25_stitched_table", f"""{WITH}, b AS (SELECT doc_id, line_no // 8 AS part, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h FROM line GROUP BY 1, 2),
c AS (SELECT *, max(w) OVER (PARTITION BY doc_id) AS common FROM b)
SELECT doc_id, max(common) AS width, CAST(sum(round_even(h * common / w, 0)) + 12 * (count(*) - 1) AS BIGINT) AS height, count(*) - 1 AS continuations FROM c GROUP BY doc_id""")
def _(s, d):
    part = line(s, d).groupBy("doc_id", F.expr("line_no div 8 part")).agg((F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"))
    part = part.withColumn("common", F.max("w").over(W.partitionBy("doc_id")))
    n = F.count(F.lit(1)) - 1
    return part.groupBy("doc_id").agg(F.max("common").alias("width"), (F.sum(F.bround(F.col("h") * F.col("common") / F.col("w"))) + 12 * n).cast("long").alias("height"), n.alias("continuations"))


@R.query("e8_caption_spread", f"{WITH}, x AS (SELECT *, CASE WHEN line_no = min(line_no) OVER (PARTITION BY doc_id) OR size <= first(size) OVER (PARTITION BY doc_id ORDER BY line_no) + 0.6 THEN 1 ELSE 0 END AS ok FROM line) SELECT doc_id, line_no FROM (SELECT *, min(ok) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM x) WHERE run = 1")
def _(s, d):
    order = W.partitionBy("doc_id").orderBy("line_no")
    x = line(s, d).withColumn("ok", (F.col("size") <= F.first("size").over(order) + 0.6).cast("int"))
    return x.withColumn("run", F.min("ok").over(order.rowsBetween(W.unboundedPreceding, 0))).where("run = 1").select("doc_id", "line_no")


#: Sentences of pages with several captions, titles inside captions, smaller and larger text; the same expressions in both dialects.
SPREAD_LABEL = "CASE WHEN line_no % 12 = 4 THEN 'caption' WHEN line_no % 24 IN (3, 5) THEN 'title' WHEN line_no % 30 = 22 THEN 'heading' WHEN line_no % 7 = 2 THEN '' END"
SPREAD_SIZE = "CASE (line_no {div} 3) % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 8.0 WHEN 2 THEN 9.0 - length(text) % 4 ELSE 7.0 + length(text) % 3 END"
SPREAD_SQL = f"""{WITH.replace("WITH", "WITH RECURSIVE")}, s AS (SELECT doc_id, line_no AS i, line_no // 3 AS p, {SPREAD_LABEL} AS label, CAST({SPREAD_SIZE.format(div='//')} AS DOUBLE) AS size, x1 - x0 AS width, x1 FROM line),
para AS (SELECT doc_id, p, list_sort(list(size))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS size, max(width) AS width, coalesce(bool_or(label = 'caption'), false) AS cap, bool_or(coalesce(label, '') <> '') AS lab FROM s GROUP BY 1, 2),
page AS (SELECT doc_id, list(p ORDER BY p) AS ps, list(size ORDER BY p) AS sizes, list(width ORDER BY p) AS widths, list(cap ORDER BY p) AS cap, list(lab ORDER BY p) AS lab, (SELECT max(x1) FROM s WHERE s.doc_id = para.doc_id) AS w FROM para GROUP BY doc_id),
walk AS (SELECT doc_id, 1 AS k, cap, lab, 0::BIGINT AS stop FROM page
  UNION ALL SELECT doc_id, k + 1, CASE WHEN cap[k] THEN [cap[x] OR (x > k AND x < stop) FOR x IN range(1, len(cap) + 1)] ELSE cap END, CASE WHEN cap[k] THEN [lab[x] OR x = k OR (x > k AND x < stop) FOR x IN range(1, len(cap) + 1)] ELSE lab END, stop FROM (
    SELECT walk.doc_id, k, walk.cap, walk.lab, coalesce(list_min([x FOR x IN range(k + 1, len(walk.cap) + 1) IF walk.lab[x] OR sizes[x] > sizes[k] + 0.6 OR CASE WHEN abs(sizes[x] - sizes[k]) <= 0.6
      THEN NOT sizes[k] < coalesce(list_max([sizes[y] FOR y IN range(1, len(walk.cap) + 1) IF NOT walk.lab[y] AND y <> k]), sizes[k]) - 0.5 ELSE widths[x] < w * 0.4 END]), len(walk.cap) + 1) AS stop FROM walk JOIN page USING (doc_id) WHERE k <= len(walk.cap))),
done AS (SELECT page.doc_id, unnest(ps) AS p, unnest(walk.cap) AS cap FROM walk JOIN page USING (doc_id) WHERE k = len(walk.cap) + 1)
SELECT doc_id, i, CASE WHEN cap AND coalesce(label, '') IN ('', 'title', 'subheading') THEN 'caption' ELSE label END AS label FROM s JOIN done USING (doc_id, p)"""


@R.query("e8_labels_after_spread", SPREAD_SQL)
def _(s, d):
    x = line(s, d).selectExpr("doc_id", "line_no i", "line_no div 3 p", f"{SPREAD_LABEL} label", f"cast({SPREAD_SIZE.format(div='div')} as double) size", "x1 - x0 width", "x1 right")
    return captions.spread_captions(x).select("doc_id", "i", "label")


@R.query("e10_table_continuation", f"""{WITH}, pg AS (SELECT doc_id, min(y0) AS top, min(x0) AS l, max(x1) AS r FROM line GROUP BY 1), y AS (SELECT *, CAST(top < 80 AND abs(l - 72) <= 20 AS INT) AS ok FROM pg),
z AS (SELECT *, doc_id // 50 AS g, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS n, min(ok) OVER (PARTITION BY doc_id // 50 ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM y) SELECT doc_id FROM z WHERE run = 1 AND n <= 20""")
def _(s, d):
    page = line(s, d).groupBy("doc_id").agg(F.min("y0").alias("top"), F.min("x0").alias("l")).withColumn("ok", ((F.col("top") < 80) & (F.abs(F.col("l") - 72) <= 20)).cast("int"))
    order = W.partitionBy(F.expr("doc_id div 50")).orderBy("doc_id")
    x = page.withColumn("n", F.row_number().over(order)).withColumn("run", F.min("ok").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return x.where("run = 1 and n <= 20").select("doc_id")


PAGES = f"""{WITH}, raw AS (SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(CASE WHEN length(text) < 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.5 AS tabular FROM line GROUP BY 1),
page AS (SELECT doc_id // 50 AS book, doc_id AS page_no, doc_id % 23 = 5 AS caption, CASE WHEN doc_id % 37 <> 9 THEN x0 END AS x0, y0, CASE WHEN doc_id % 4 > 0 THEN greatest(x1, 540.0::DOUBLE) ELSE x1 END AS x1, y1, 0.0::DOUBLE AS top,
  CASE WHEN doc_id % 29 = 4 THEN 280.0::DOUBLE ELSE 800.0::DOUBLE END AS height, CASE WHEN doc_id % 4 > 0 THEN 72.0::DOUBLE END AS rx0, CASE WHEN doc_id % 4 = 3 THEN 400.0::DOUBLE WHEN doc_id % 4 > 0 THEN 540.0::DOUBLE END AS rx1, tabular FROM raw)"""


@R.query("e10_tables_over_pages", f"""{PAGES}, t AS (SELECT book, page_no AS p, x0 AS l, x1 AS r FROM page WHERE page_no % 3 = 0 AND x0 IS NOT NULL), n AS (SELECT *, unnest(range(1, 22)) AS n FROM t),
x AS (SELECT n.*, CASE WHEN n > 20 THEN 'limit' WHEN page_no IS NULL THEN 'end' WHEN caption THEN 'caption' WHEN x0 IS NULL THEN 'empty' WHEN y0 > top + height * 0.25 THEN 'low' WHEN abs(x0 - l) > 20 OR abs(x1 - r) > 20 THEN 'width'
  WHEN NOT coalesce(abs(rx0 - l) <= 20 AND abs(rx1 - r) <= 20, false) AND NOT tabular THEN 'prose' END AS why FROM n LEFT JOIN page ON page.book = n.book AND page_no = p + n)
SELECT book, p AS page_no, min(n) FILTER (WHERE why IS NOT NULL) - 1 AS pages, first(why ORDER BY n) FILTER (WHERE why IS NOT NULL) AS stopped FROM x GROUP BY 1, 2""")
def _(s, d):
    """Pages of fifty to a book, three of four with a frame; some have captions, no content, content that begins low, or rules of another width."""
    x = line(s, d).groupBy("doc_id").agg(F.min("x0").alias("l"), F.min("y0").alias("y0"), F.max("x1").alias("r"), F.max("y1").alias("y1"), (F.avg((F.length("text") < 60).cast("double")) >= 0.5).alias("tabular"))
    page = x.selectExpr(
        "doc_id div 50 doc_id", "doc_id page_no", "doc_id % 23 = 5 caption", "case when doc_id % 37 <> 9 then l end x0", "y0", "case when doc_id % 4 > 0 then greatest(r, 540.0D) else r end x1", "y1", "0.0D top",
        "case when doc_id % 29 = 4 then 280.0D else 800.0D end height", "case when doc_id % 4 > 0 then 72.0D end rule_x0", "case when doc_id % 4 = 3 then 400.0D when doc_id % 4 > 0 then 540.0D end rule_x1", "tabular",
    )
    begun = page.where("page_no % 3 = 0 and x0 is not null").select("doc_id", "page_no", "x0", "x1")
    return tables.continuations(begun, page).selectExpr("doc_id book", "page_no", "pages", "stopped")


@R.query("e13_previous_bottom", f"{WITH} SELECT doc_id, line_no, lag(y1, 1, 0.0::DOUBLE) OVER (PARTITION BY doc_id ORDER BY y0, line_no) AS bottom FROM line WHERE bold")
def _(s, d):
    return line(s, d).where("bold").select("doc_id", "line_no", F.lag("y1", 1, 0.0).over(W.partitionBy("doc_id").orderBy("y0", "line_no")).alias("bottom"))


@R.query("f5_captions_top_down", f"{WITH} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, line_no) AS rank FROM line WHERE bold")
def _(s, d):
    return line(s, d).where("bold").select("doc_id", "line_no", F.row_number().over(W.partitionBy("doc_id").orderBy("y0", "x0", "line_no")).cast("long").alias("rank"))


@R.query("g1_all_regions", f"{WITH} SELECT doc_id, 'figure' AS kind, count(*) AS n FROM line WHERE bold GROUP BY 1 UNION ALL SELECT doc_id, 'table', count(*) FROM line WHERE size > 11 GROUP BY 1")
def _(s, d):
    x = line(s, d)
    part = lambda kind, cond: x.where(cond).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(kind).alias("kind"), "n")
    return part("figure", "bold").unionByName(part("table", "size > 11"))


ROOTS = f"""{WITH}, {EDGE_SQL},
ok AS (SELECT e.doc_id, e.a, e.b FROM edge e JOIN line l ON l.doc_id = e.doc_id AND l.line_no = e.b),
st AS (SELECT l.doc_id, l.line_no AS node, CASE WHEN ok.a IS NULL THEN l.line_no END AS begin FROM line l LEFT JOIN ok ON ok.doc_id = l.doc_id AND ok.b = l.line_no),
roots AS (SELECT doc_id, node, max(begin) OVER (PARTITION BY doc_id ORDER BY node ROWS UNBOUNDED PRECEDING) AS root FROM st)"""


def roots(s, d):
    x = line(s, d)
    return graph.merge_roots(s, x.select("doc_id", F.col("line_no").alias("node")), derived.merge_edges(x))


@R.query("g7_components", f"{ROOTS} SELECT doc_id, node, root FROM roots")
def _(s, d):
    return roots(s, d)


@R.query("g7_guarded_merge", f"{ROOTS} SELECT doc_id, node, CASE WHEN count(DISTINCT root) OVER (PARTITION BY doc_id) >= 0.8::DOUBLE * count(*) OVER (PARTITION BY doc_id) THEN root ELSE node END AS root FROM roots")
def _(s, d):
    return graph.guarded_merge(roots(s, d), 0.8)


@R.query("g8_box_clusters")
def _(s, d):
    return layout.merge_near_boxes(line(s, d))


@R.query("g9_singleton_demotion", f"{WITH} SELECT doc_id, line_no // 2 AS cluster, count(*) = 1 AND NOT bool_or(regexp_matches(text, '[=+*/]')) AS demoted FROM line WHERE line_no % 3 > 0 GROUP BY 1, 2")
def _(s, d):
    by = line(s, d).where("line_no % 3 > 0").groupBy("doc_id", F.expr("line_no div 2 cluster"))
    return by.agg(((F.count(F.lit(1)) == 1) & ~F.bool_or(F.col("text").rlike("[=+*/]"))).alias("demoted"))


#: Texts that take every branch of the cascade, by line number; the same expression in both dialects.
LABEL_TEXT = """CASE line_no % 17 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'Materials and  Methods.' WHEN 2 THEN concat('Fig. 3. ', text) WHEN 3 THEN 'Table S2'
  WHEN 4 THEN 'Correspondence: the authors' WHEN 5 THEN 'write to a.b@c.org' WHEN 6 THEN '¹ University of X' WHEN 7 THEN 'Ann Foo¹, Bo Bar², Cy Baz³'
  WHEN 8 THEN 'Foo encodes¹, Bar², Baz³' WHEN 9 THEN '†Faculté de Y' WHEN 10 THEN 'A part 示 B' WHEN 11 THEN 'Results should follow' WHEN 12 THEN 'Acknowledgements'
  WHEN 13 THEN '参考文献' WHEN 14 THEN 'Fig. 3 shows it' ELSE text END"""
_WORD_SQL = lambda words: f"'(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{words})(?:[^\\p{{L}}\\p{{N}}_]|$)'"
_RAISED = "[¹²³⁴⁵⁶⁷⁸⁹⁰]"


@R.query("h10_heading_labels", f"""{WITH}, m AS (SELECT doc_id, list_sort(list(size))[CAST(floor(count(*)/2) AS BIGINT)+1] AS med FROM line GROUP BY 1),
x AS (SELECT doc_id, line_no, size / med AS ratio, bold, regexp_replace({LABEL_TEXT}, '^\\s+|\\s+$', '', 'g') AS t FROM line JOIN m USING (doc_id)),
y AS (SELECT *, length(t) AS n, [w FOR w IN string_split_regex(regexp_replace(t, '{_RAISED}+', '', 'g'), '[\\s,]+') IF w <> ''] AS tokens FROM x)
SELECT doc_id, line_no, CASE WHEN n = 0 THEN NULL
  WHEN n <= 80 AND regexp_matches(t, '{labels.HEADINGS}') THEN CASE WHEN regexp_matches(t, '^(?i:abstract|要約|要旨)') THEN 'abstract_heading' ELSE 'heading' END
  WHEN regexp_matches(t, {HEAD}) THEN 'caption'
  WHEN ratio >= 1.05::DOUBLE AND bold THEN 'title' WHEN ratio >= 1.10::DOUBLE THEN 'title'
  WHEN bold AND n <= 60 AND NOT regexp_matches(t, '[.。:：]$') AND NOT regexp_matches(t, {_WORD_SQL(labels.HEADING_VERBS)}) THEN 'subheading'
  WHEN regexp_matches(t, '^(?i:correspond(ence|ing)|to\\s+whom\\s+correspondence|\\*\\s*corresponding)') THEN 'contact'
  WHEN n <= 80 AND regexp_matches(t, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+') THEN 'contact'
  WHEN regexp_matches(t, '^(?:{_RAISED}+|\\*|†|‡|§|¶)\\s*[A-Z]') AND regexp_matches(t, '(?i)(?:{labels.AFFILIATIONS})') THEN 'affiliation'
  WHEN len(regexp_extract_all(t, '{_RAISED}')) >= 3 AND len(regexp_extract_all(t, ',')) >= 2 AND n <= 400 AND NOT regexp_matches(t, {_WORD_SQL(labels.AUTHOR_VERBS)})
    AND len(tokens) > 0 AND CAST(len([w FOR w IN tokens IF regexp_matches(w, '^[A-Z]')]) AS DOUBLE) / len(tokens) >= 0.6::DOUBLE THEN 'authors' END AS label FROM y""")
def _(s, d):
    x = line(s, d)
    med = x.groupBy("doc_id").agg(layout.upper_median(F.col("size")).alias("med"))
    x = x.withColumn("text", F.expr(LABEL_TEXT)).join(med, "doc_id")
    return x.select("doc_id", "line_no", labels.font_labels(F.col("text"), F.col("size") / F.col("med"), F.col("bold")).alias("label"))


@R.query("h27_pixel_boxes", f"{WITH} SELECT doc_id, line_no, round_even(x0 * 150.0::DOUBLE / 72.0::DOUBLE, 1) AS px0, greatest(0.0::DOUBLE, least(y1 * 2.0::DOUBLE + 4.0::DOUBLE, 1600.0::DOUBLE)) AS py1 FROM line")
def _(s, d):
    return line(s, d).select("doc_id", "line_no", F.bround(F.col("x0") * 150.0 / 72.0, 1).alias("px0"), F.greatest(F.lit(0.0), F.least(F.col("y1") * 2.0 + 4.0, F.lit(1600.0))).alias("py1"))


@R.query("h28_page_pixels", f"{WITH} SELECT doc_id, CAST(round_even(max(x1) * 150.0::DOUBLE / 72.0::DOUBLE, 0) AS BIGINT) AS width FROM line GROUP BY 1")
def _(s, d):
    return line(s, d).groupBy("doc_id").agg(F.bround(F.max("x1") * 150.0 / 72.0).cast("long").alias("width"))
