"""Nearest neighbours in an order of names, and the best match by common prefix with a second tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources.scratch import kept


def beside(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds to rows (key, name, ...) `below` and `above`: the listed (name, item) of the same key next to the name in code-point order.

    `above` may be the name itself, `below` is smaller; null if there is none. Both tables lie in one order of key and name, cut into ranges;
    within a range a window looks back and ahead, and over its borders one row to a range is carried: no key is gathered.
    """
    names = [c for c in asked.columns if c not in ("key", "name")]
    a = asked.select("key", "name", F.struct(*names).alias("row") if names else F.struct(F.lit(0).alias("none")).alias("row"), F.lit(None).cast(listed.schema["item"].dataType).alias("item"), F.lit(0).alias("mark"))
    b = listed.select("key", "name", F.lit(None).cast(a.schema["row"].dataType).alias("row"), "item", F.lit(1).alias("mark"))
    x = kept(a.unionByName(b).where("key is not null and name is not null").repartitionByRange("key", "name").withColumn("part", F.spark_partition_id()))
    order = ["key", "name", "mark", "item"]
    entry = F.when(F.col("mark") == 1, F.struct("key", "name", "item"))
    # ahead is looked for in the reverse order: a frame to the end of the range is read anew for every row
    before, after = (W.partitionBy("part").orderBy(*by).rowsBetween(W.unboundedPreceding, -1) for by in (order, map(F.desc, order)))
    back, ahead = F.last(entry, ignorenulls=True).over(before), F.last(entry, ignorenulls=True).over(after)
    ends = x.groupBy("part").agg(F.max(entry).alias("high"), F.min(entry).alias("low"))  # one row to a range
    low, high = (W.orderBy(by).rowsBetween(W.unboundedPreceding, -1) for by in (F.asc("part"), F.desc("part")))
    ends = ends.select("part", F.last("high", ignorenulls=True).over(low).alias("before"), F.last("low", ignorenulls=True).over(high).alias("after"))
    x = x.withColumns({"back": back, "ahead": ahead}).where("mark = 0").join(F.broadcast(ends), "part")
    own = lambda c: F.when(c["key"] == F.col("key"), F.struct(c["name"].alias("name"), c["item"].alias("item")))
    found = x.select("key", "name", "row", own(F.coalesce("back", "before")).alias("below"), own(F.coalesce("ahead", "after")).alias("above"))
    return found.select("key", "name", *[f"row.{c}" for c in names], "below", "above")


def longest_prefix(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds to rows (key, name, ...) the listed item of the key whose name has the longest prefix in common: `item` and `shared`, its length.

    In the order of names it stands next to the name. Of several the first name wins, then the least item: the first that is not less
    than the common prefix. A key without anything listed gives null.
    """
    rest = [c for c in asked.columns if c not in ("key", "name")]
    near = beside(asked, listed)
    common = lambda c: F.when(F.col(c).isNotNull(), T.common_prefix(F.col("name"), F.col(f"{c}.name")))
    near = near.withColumn("shared", F.greatest(common("below"), common("above"))).drop("below", "above")
    first = near.where("shared is not null").select("key", F.expr("substring(name, 1, cast(shared as int))").alias("name"), F.col("name").alias("whole"), "shared", *rest)
    hit = beside(first, listed).select("key", F.col("whole").alias("name"), *rest, F.col("above.item").alias("item"), "shared")
    none = near.where("shared is null").select("key", "name", *rest, F.lit(None).cast(listed.schema["item"].dataType).alias("item"), F.lit(None).cast("long").alias("shared"))
    return hit.unionByName(none)


def best_in_folders(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """The best match in a row's own folder, or else in the folder above it: rows (id, folder, name) get `item`, `shared` and `tier` (0 own, 1 above).

    Only rows whose folder lists nothing look one folder up. Null where both list nothing; tier is then null as well.
    """
    own = longest_prefix(asked.select(F.col("folder").alias("key"), "name", "id", "folder"), listed)
    up = own.where("item is null").select(F.regexp_replace("folder", "/?[^/]*$", "").alias("key"), "name", "id", "folder")
    above = longest_prefix(up, listed).withColumn("tier", F.when(F.col("item").isNotNull(), 1))
    return own.where("item is not null").withColumn("tier", F.lit(0)).unionByName(above).select("id", "folder", "name", "item", "shared", "tier")
