"""Regions of tables and figures on pages: rectangles that meet, graphics, aligned columns, prose, tables over several pages.

A page is a doc_id. Boxes are x0, y0, x1, y1 with y downwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.layout import overlapping

#: A gap between two columns of a line that spaces align.
GAP = r"\S {2,}\S"


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def meeting_boxes(a: DataFrame, b: DataFrame, cell: float = 64.0) -> DataFrame:
    """Pairs of boxes of a page that overlap or touch: rows (doc_id, a, b) from (doc_id, a) and (doc_id, b), structs with a box.

    Both sides go to the cells of a grid that they cover and meet there; a pair counts in the cell in which the upper left corner of
    what they share lies, so it comes once and no page, row or column of it is compared as a whole. Null boxes meet nothing.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"{name}.{low}") / cell), F.floor(F.col(f"{name}.{high}") / cell)))
        good = df.where(" and ".join([f"{name}.{c} is not null" for c in ("x0", "y0", "x1", "y1")] + [f"{name}.x0 <= {name}.x1 and {name}.y0 <= {name}.y1"]))
        return good.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))

    both = dealt(a.select("doc_id", "a"), "a").join(dealt(b.select("doc_id", "b"), "b"), ["doc_id", "cx", "cy"])
    left, top = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    meets = (left <= F.least("a.x1", "b.x1")) & (top <= F.least("a.y1", "b.y1"))
    return both.where(meets & (F.col("cx") == F.floor(left / cell)) & (F.col("cy") == F.floor(top / cell))).select("doc_id", "a", "b")


def region_graphics(region: DataFrame, image: DataFrame, drawing: DataFrame, page: DataFrame, least: int = 5, share: float = 0.03) -> DataFrame:
    """Rows (doc_id, region, has_graphics) for regions (doc_id, region, x0, y0, x1, y1).

    A region has graphics if an image covers more than `share` of it, or if at least `least` drawings show in it with more than
    two points across or down; drawings of nine tenths of the page (doc_id, area) are its ground. An empty region has none.
    """
    box = lambda *more: F.struct(*more, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    inked = _inked(drawing, page)
    shown = image.select("doc_id", box(F.lit(True).alias("image")).alias("b")).unionByName(inked.select("doc_id", box(F.lit(False).alias("image")).alias("b")))
    pair = meeting_boxes(region.select("doc_id", box("region").alias("a")), shown)
    across, down = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0"), F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    covers = F.col("b.image") & (across * down > box_area(F.col("a")) * share)
    drawn = ~F.col("b.image") & ((across > 2) | (down > 2))
    found = pair.groupBy("doc_id", F.col("a.region").alias("region")).agg(F.bool_or(covers).alias("covered"), F.sum(drawn.cast("int")).alias("drawn"))
    full = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    has = full & (F.coalesce("covered", F.lit(False)) | (F.coalesce("drawn", F.lit(0)) >= least))
    return region.join(found, ["doc_id", "region"], "left").select("doc_id", "region", F.coalesce(has, F.lit(False)).alias("has_graphics"))


def aligned_in(ranges: DataFrame, line: DataFrame, step: float = 64.0) -> DataFrame:
    """D10 for vertical ranges (doc_id, r, top, bottom): rows (doc_id, r, columns) of the ranges that have any.

    A column is a left edge (in steps of 8) that stands in three or more bands (of 4) of height; of a page only lines in reach are looked at.
    """
    x = line.where(F.col("text").rlike(r"\S")).select("doc_id", "y0", "y1", F.bround(F.col("x0") / 8).alias("edge"), F.bround((F.col("y0") + F.col("y1")) / 2 / 4).alias("band"))
    hit = overlapping(ranges.select("doc_id", "r", "top", "bottom"), x, "doc_id", "top", "bottom", "y0", "y1", step)
    edge = hit.select("doc_id", "r", "edge", "band").distinct().groupBy("doc_id", "r", "edge").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return edge.groupBy("doc_id", "r").agg(F.count(F.lit(1)).alias("columns"))


def looks_like_table(ranges: DataFrame, block: DataFrame, line: DataFrame, step: float = 64.0) -> DataFrame:
    """B14 for vertical ranges: rows (doc_id, r, tabular). Three aligned columns, or three or more blocks of which half are short."""
    some = block.where(F.col("text").rlike(r"\S")).select("doc_id", "y0", "y1", F.length(F.trim("text")).alias("long"))
    hit = overlapping(ranges.select("doc_id", "r", "top", "bottom"), some, "doc_id", "top", "bottom", "y0", "y1", step)
    short = hit.groupBy("doc_id", "r").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("long") < 60).cast("double")).alias("short"))
    x = ranges.select("doc_id", "r").join(short, ["doc_id", "r"], "left").join(aligned_in(ranges, line, step), ["doc_id", "r"], "left")
    return x.select("doc_id", "r", (F.coalesce(F.col("columns") >= 3, F.lit(False)) | F.coalesce((F.col("n") >= 3) & (F.col("short") >= 0.5), F.lit(False))).alias("tabular"))


def first_prose_top(ranges: DataFrame, block: DataFrame, line: DataFrame, page: DataFrame, step: float = 64.0) -> DataFrame:
    """Rows (doc_id, r, prose_top) for vertical ranges (doc_id, r, top, bottom) in which a paragraph of prose begins.

    Prose is a block (doc_id, block, x0, y0, x1, y1) of 200 characters or more over 60 % of the page's width (doc_id, width), with fewer than two
    lines that spaces part into three columns, and fewer than three columns aligned over the block's own height. `line` has its block's
    number. The columns are counted only of blocks that pass the other tests.
    """
    text = line.groupBy("doc_id", "block").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda z: z["text"]), " ")).alias("text"),
        F.count(F.when(F.regexp_count("text", F.lit(GAP)) >= 2, 1)).alias("gaps"),
    )
    x = block.select("doc_id", "block", "x0", "y0", "x1", "y1").join(text, ["doc_id", "block"]).join(page.select("doc_id", "width"), "doc_id")
    x = x.where((F.length("text") >= 200) & (F.col("x1") - F.col("x0") >= F.greatest(F.col("width"), F.lit(1.0)) * 0.6) & (F.col("gaps") < 2))
    own = x.select("doc_id", F.col("block").alias("r"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    cells = aligned_in(own, line, step).where("columns >= 3").select("doc_id", F.col("r").alias("block"))
    prose = x.join(cells, ["doc_id", "block"], "left_anti").select("doc_id", "y0", F.floor(F.col("y0") / step).alias("step"))
    dealt = ranges.where("bottom > top").withColumn("step", F.explode(F.sequence(F.floor(F.col("top") / step), F.floor(F.col("bottom") / step))))
    inside = dealt.join(prose, ["doc_id", "step"]).where("y0 >= top and y0 < bottom")
    return inside.groupBy("doc_id", "r").agg(F.min("y0").alias("prose_top"))


def continuations(table: DataFrame, page: DataFrame, most: int = 20) -> DataFrame:
    """How tables go on over the next pages: rows (doc_id, page_no, pages, boxes, stopped), one to each table.

    `table` has (doc_id, page_no, x0, x1), `page` for each page (doc_id, page_no, caption, x0, y0, x1, y1, top, height, rule_x0, rule_x1, tabular): whether a
    caption stands on it, the box of its content and of its rules (null: none), its own top and height, whether it looks like a table.
    A page goes on with a table if it has no caption, its content begins in its first quarter, both edges are within 20 of the table's, and
    its rules too, or else it looks like a table. The first page that does not ends the table: `stopped` says why (caption, empty, low, width,
    prose), or that the document ended or `most` pages were reached. Runs of different tables may overlap. `boxes` holds the
    pages and the content's boxes.
    """
    ahead = table.select("doc_id", "page_no", F.col("x0").alias("left"), F.col("x1").alias("right"), F.explode(F.sequence(F.lit(1), F.lit(most + 1))).alias("n"))
    ahead = ahead.withColumn("at", F.col("page_no") + F.col("n"))
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= 20, F.lit(False))
    why = (
        F.when(F.col("n") > most, "limit")
        .when(F.col("caption").isNull(), "end")
        .when(F.col("caption"), "caption")
        .when(F.col("x0").isNull(), "empty")
        .when(F.col("y0") > F.col("top") + F.col("height") * 0.25, "low")
        .when(~near("x0", "left") | ~near("x1", "right"), "width")
        .when(~(near("rule_x0", "left") & near("rule_x1", "right")) & ~F.coalesce("tabular", F.lit(False)), "prose")
    )
    there = page.withColumnRenamed("page_no", "at").withColumn("caption", F.coalesce("caption", F.lit(False)))
    x = ahead.join(there, ["doc_id", "at"], "left").withColumn("why", why)
    key = W.partitionBy("doc_id", "page_no", "left", "right")  # a table's next pages
    x = x.withColumn("stop", F.min(F.when(F.col("why").isNotNull(), F.struct("n", "why"))).over(key)).where(F.col("n") <= F.col("stop.n"))
    box = F.when(F.col("n") < F.col("stop.n"), F.struct("at", "x0", "y0", "x1", "y1"))
    out = x.groupBy("doc_id", "page_no", "left", "right").agg(F.array_sort(F.collect_list(box)).alias("boxes"), F.max("stop").alias("stop"))
    return out.select("doc_id", "page_no", (F.col("stop.n") - 1).cast("long").alias("pages"), "boxes", F.col("stop.why").alias("stopped"))


def _inked(drawing: DataFrame, page: DataFrame) -> DataFrame:
    """Drawings without those that are a page's ground."""
    return drawing.join(page.select("doc_id", "area"), "doc_id").where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < F.col("area") * 0.9).drop("area")


def content_boxes(ranges: DataFrame, block: DataFrame, drawing: DataFrame, page: DataFrame, step: float = 64.0) -> DataFrame:
    """Rows (doc_id, r, x0, y0, x1, y1): the box of text and rules in vertical ranges (doc_id, r, top, bottom), cut to them; none where there is nothing."""
    box = ["doc_id", "x0", "y0", "x1", "y1"]
    rects = block.where(F.col("text").rlike(r"\S")).select(*box).unionByName(_inked(drawing, page).select(*box))
    hit = overlapping(ranges.select("doc_id", "r", "top", "bottom"), rects, "doc_id", "top", "bottom", "y0", "y1", step)
    return hit.groupBy("doc_id", "r").agg(F.min("x0").alias("x0"), F.greatest(F.min("y0"), F.max("top")).alias("y0"), F.max("x1").alias("x1"), F.least(F.max("y1"), F.max("bottom")).alias("y1"))


def graphics_boxes(ranges: DataFrame, image: DataFrame, drawing: DataFrame, block: DataFrame, page: DataFrame, step: float = 64.0) -> DataFrame:
    """C11: rows (doc_id, r, x0, y0, x1, y1): the box of what is drawn in vertical ranges, with the text that lies on it.

    One image is enough, drawings (more than two points wide or high, not the ground) count beside it, or alone if there are
    three. Blocks of text then extend the box one after the other, in order of their numbers: what overlaps the box so far is taken
    in, so the order matters; a range's blocks are folded together, as many as a page has. Boxes are cut to their range.
    """
    box = ["doc_id", "x0", "y0", "x1", "y1"]
    inked = _inked(drawing, page).where("x1 - x0 > 2 or y1 - y0 > 2")
    rects = image.select(*box, F.lit(1).alias("image")).unionByName(inked.select(*box, F.lit(0).alias("image")))
    span = ranges.where("bottom > top").select("doc_id", "r", "top", "bottom")
    seed = overlapping(span, rects, "doc_id", "top", "bottom", "y0", "y1", step).groupBy("doc_id", "r", "top", "bottom").agg(
        F.min("x0").alias("x0"), F.greatest(F.col("top"), F.min("y0")).alias("y0"), F.max("x1").alias("x1"), F.least(F.col("bottom"), F.max("y1")).alias("y1"), F.sum("image").alias("images"), F.count(F.lit(1)).alias("n")
    )
    seed = seed.where("images > 0 or n >= 3").select("doc_id", "r", "top", "bottom", F.struct("x0", "y0", "x1", "y1").alias("seed"))
    text = overlapping(span, block.select("block", *box), "doc_id", "top", "bottom", "y0", "y1", step)
    text = text.groupBy("doc_id", "r").agg(F.array_sort(F.collect_list(F.struct("block", "x0", "y0", "x1", "y1"))).alias("texts"))

    def extended(b: Column, t: Column) -> Column:
        on = (t["x1"] > b["x0"]) & (t["x0"] < b["x1"]) & (t["y1"] > b["y0"]) & (t["y0"] < b["y1"])
        grown = F.struct(F.least(b["x0"], t["x0"]).alias("x0"), F.greatest(F.col("top"), F.least(b["y0"], t["y0"])).alias("y0"), F.greatest(b["x1"], t["x1"]).alias("x1"), F.least(F.col("bottom"), F.greatest(b["y1"], t["y1"])).alias("y1"))
        return F.when(on, grown).otherwise(b)

    x = seed.join(text, ["doc_id", "r"], "left")
    return x.select("doc_id", "r", F.aggregate(F.coalesce("texts", F.array()), F.col("seed"), extended).alias("b")).select("doc_id", "r", "b.*")


def table_regions(caption: DataFrame, block: DataFrame, line: DataFrame, drawing: DataFrame, page: DataFrame) -> DataFrame:
    """Rows (doc_id, caption, x0, y0, x1, y1): the regions of tables under their captions.

    `caption` has (doc_id, caption, is_table, y0, y1), `page` (doc_id, width, height, area). Below a table's caption its region ends at
    the next caption that begins lower, or at the page's foot; before that where prose begins, if 30 points of room are left
    above it. A region of less than 30 points goes, and so does one that does not look like a table. What is left is cut to its
    content and widened by a margin inside the page.
    """
    asks = caption.select("doc_id", "caption", "is_table", (F.col("y1") + 2).alias("at"), F.lit(None).cast("double").alias("start"), F.lit(0).alias("kind"))
    starts = caption.select("doc_id", F.lit(None).cast(asks.schema["caption"].dataType).alias("caption"), F.lit(False).alias("is_table"), F.col("y0").alias("at"), F.col("y0").alias("start"), F.lit(1).alias("kind"))
    below = F.first("start", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("at", F.desc("kind")).rowsBetween(1, W.unboundedFollowing))
    x = asks.unionByName(starts).withColumn("below", below).where("kind = 0 and is_table").join(page, "doc_id")
    foot = F.col("height") - 10
    ranges = x.select("doc_id", F.col("caption").alias("r"), F.col("at").alias("top"), F.least(foot, F.coalesce(F.col("below") - 2, foot)).alias("bottom"))
    prose = first_prose_top(ranges, block, line, page)
    stop = F.when(F.col("prose_top") - F.col("top") >= 30, F.col("prose_top") - 2).otherwise(F.col("bottom"))
    ranges = ranges.join(prose, ["doc_id", "r"], "left").withColumn("bottom", stop).drop("prose_top").where("bottom - top >= 30")
    ranges = ranges.join(looks_like_table(ranges, block, line).where("tabular"), ["doc_id", "r"], "left_semi")
    found = content_boxes(ranges, block, drawing, page).join(page, "doc_id")
    return found.select("doc_id", F.col("r").alias("caption"), F.greatest(F.lit(0.0), F.col("x0") - 6).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - 4).alias("y0"), F.least(F.col("width"), F.col("x1") + 6).alias("x1"), F.least(F.col("height"), F.col("y1") + 4).alias("y1"))
