"""Merkle manifest of a dataset: ranks by radix histograms, a trie over the ranks' digits, proofs for every record.

Each group's leaves are ranked exactly without a global sort: rows are counted by the leading digits of their ids, only
groups of digits with many rows are counted by the next digit as well, and a row's rank is the number of rows in the
digits before its own, plus its place among the few rows that share all of its digits. A rank written in the base of the
fan-out is the leaf's key in a trie. Nodes of the longest keys are hashed first, by key without the last digit, up to the empty
key; groups of fewer digits join on the way. The groups' roots are ranked and reduced in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import Scratch

FANOUT = 16
#: Most rows that are ordered within a digit, bits of a digit, and rows and bytes of a table of counts that is broadcast.
MOST_ORDERED, BITS, MOST_ROWS, MOST_BYTES = 10_000, 10, 100_000, 8_000_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def record(*fields: Column) -> Column:
    """Hash of a record: each field `-` if null, else the bytes of its text, a colon and the text."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return digest(*told)


def group_key(group: Column) -> Column:
    """A string that orders as the group's UTF-8 does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


# --------------------------------------------------------------------------- ranks


def _hint(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcast for a written table whose rows and keys are few; else it is joined by shuffling."""
    n, size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("grp"))).first()
    return F.broadcast if n <= MOST_ROWS and (size or 0) <= MOST_BYTES else lambda x: x


def ranks(rows: DataFrame, digits: Callable[[int], Column], order: list[Column], scratch: Scratch, most: int = MOST_ORDERED) -> DataFrame:
    """Adds `size`, the rows of each `grp`, and `rank`, from 0 in the order of `order` within it.

    `digits(k)` is digit k (from 1) of that order; the digits of all k tell any two rows apart. The rows are a written table.
    """
    sizes = scratch.keep(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")))
    left = rows.join(_hint(sizes)(sizes), "grp").select("*", F.col("size").alias("here"), F.lit("").alias("path"), F.lit(0).cast("long").alias("base"))
    done, level, counts = [], 0, sizes.withColumnRenamed("size", "here")
    while True:
        done.append(left.where(F.col("here") <= most))
        if counts.where(F.col("here") > most).isEmpty():
            break
        level += 1
        left = left.where(F.col("here") > most).drop("here").withColumn("digit", digits(level))
        counts = left.groupBy("grp", "path", "digit").agg(F.count(F.lit(1)).alias("here"))
        before = F.sum("here").over(W.partitionBy("grp", "path").orderBy("digit")) - F.col("here")
        counts = scratch.keep(counts.withColumn("before", before))
        left = left.join(_hint(counts)(counts), ["grp", "path", "digit"]).withColumn("base", F.col("base") + F.col("before"))
        left = left.withColumn("path", F.concat_ws(".", "path", F.col("digit").cast("string"))).drop("digit", "before")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    place = F.row_number().over(W.partitionBy("grp", "path").orderBy(*order)) - 1
    return out.withColumn("rank", F.col("base") + place).drop("here", "path", "base")


def id_digits(low: int, high: int) -> Callable[[int], Column]:
    """Digits of (id, hash, row): of the id from the range's highest bits down, of the hash, and of the row's number. Null ids come first."""
    bits = max(1, (high - low).bit_length())
    shifts = [max(0, bits - BITS)]
    while shifts[-1]:
        shifts.append(max(0, shifts[-1] - BITS))

    def digit(k: int) -> Column:
        if k <= len(shifts):
            s = shifts[k - 1]
            part = F.shiftright("id", s) - F.lit(low >> s) if k == 1 else F.shiftright("id", s).bitwiseAND(F.lit((1 << (shifts[k - 2] - s)) - 1))
            return F.coalesce(part.cast("long"), F.lit(-1).cast("long"))
        k -= len(shifts)
        if k <= 21:  # 63 of the 64 characters of a hash, three at a time
            return F.conv(F.substring("hash", 3 * k - 2, 3), 16, 10).cast("long")
        return F.shiftright("row", max(0, 63 - BITS * (k - 21))).bitwiseAND(F.lit((1 << BITS) - 1)).cast("long")

    return digit


def name_digits(k: int) -> Column:
    """Byte k of a name's UTF-8; a name that ends before it comes first."""
    return F.coalesce(F.conv(F.nullif(F.hex(F.substring(F.encode("name", "UTF-8"), k, 1)), F.lit("")), 16, 10).cast("long"), F.lit(-1).cast("long"))


# --------------------------------------------------------------------------- the trie


def _keyed(ranked: DataFrame, fanout: int) -> DataFrame:
    """The rank's digits in the base of the fan-out, as many as the group's last rank has; a lone leaf has none."""
    in_base = lambda c: F.conv(c.cast("string"), 10, fanout)
    depth = F.when(F.col("size") > 1, F.length(in_base(F.col("size") - 1))).otherwise(0).cast("int")
    return ranked.withColumn("depth", depth).withColumn("key", F.when(F.col("depth") > 0, F.lpad(in_base(F.col("rank")), F.col("depth"), "0")).otherwise(""))


def _reduced(leaves: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Runs of siblings by the length of their keys (index 0: none), and the nodes of the empty key.

    `leaves` is a written table of (grp, key, hash, leaf) parted by depth; `leaf` is a struct, null for inner nodes.
    """
    longest = leaves.agg(F.max("depth")).first()[0] or 0
    runs, nodes = [None] * (longest + 1), None
    for length in range(longest, -1, -1):
        own = leaves.where(F.col("depth") == length).select("grp", "key", "hash", "leaf")
        nodes = own if nodes is None else nodes.unionByName(own)
        if length:
            kids = F.sort_array(F.collect_list(F.struct("key", "hash", "leaf")))
            run = nodes.groupBy("grp", F.substring("key", 1, length - 1).alias("parent")).agg(kids.alias("kids"))
            runs[length] = scratch.keep(run.withColumn("hash", F.sha2(F.array_join("kids.hash", ""), 256)))
            nodes = runs[length].select("grp", F.col("parent").alias("key"), "hash", F.lit(None).cast(leaves.schema["leaf"].dataType).alias("leaf"))
    return runs, nodes


def _descended(runs: list[DataFrame], top: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Leaves with their paths, a table for each length of keys. `top` has (grp, key, path, carried) of the empty key.

    A path holds, from the leaf up, the hashes left and right of one's own in each run.
    """
    out, above = [], top
    for length in range(1, len(runs)):
        both = runs[length].drop("hash").join(above.withColumnRenamed("key", "parent"), ["grp", "parent"])
        names = F.col("kids.hash")
        one = both.select("grp", "carried", "path", names.alias("names"), F.posexplode("kids").alias("at", "kid"))
        beside = F.struct(F.array_join(F.slice("names", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.expr("slice(names, at + 2, size(names))"), "").alias("right"))
        one = one.select("grp", "kid", "carried", F.concat(F.array(beside), "path").alias("path"))
        out.append(one.where("kid.leaf is not null").select("kid.leaf", "kid.hash", "carried", "path"))
        if length + 1 < len(runs):
            above = scratch.keep(one.where("kid.leaf is null").select("grp", "kid.key", "carried", "path"))
    return out


_PATH = "array<struct<left:string,right:string>>"


def manifest(records: DataFrame, scratch: Scratch, fanout: int = FANOUT, most: int = MOST_ORDERED) -> DataFrame:
    """Hash tree over records (id, grp, hash, rest): rows (id, hash, rest, subroot, root, path).

    `hash` is a record's hash as hex, `id` a long, `grp` a group's name, `rest` anything that is carried along, null included. In each group, records ascend by
    id (null first; ties by hash, equal hashes in any order); while several nodes remain, every `fanout` neighbours become
    the hash of their hashes. What remains is the group's subroot; the subroots, by name (null first, bytewise), give the root in the same
    way. `path` has for each level, from the record up, the hashes left and right of its own node, concatenated.

    Repeated rows are records of their own; a null group is a group; an empty table gives an empty result. `fanout` is 2 to 36. No group,
    run of ids or set of equal ids is ordered in one task: at most `most` rows are, and `fanout` nodes hashed together.
    """
    if not 2 <= fanout <= 36:
        raise ValueError("a fan-out is 2 to 36")
    rows = records.select("id", group_key(F.col("grp")).alias("grp"), "hash", F.struct("rest").alias("rest"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    ranked = ranks(rows, id_digits(low or 0, high or 0), [F.col("id").asc_nulls_first(), F.col("hash"), F.col("row")], scratch, most)
    leaves = _keep_by_depth(_keyed(ranked, fanout).select("grp", "key", "hash", "depth", F.struct("id", "rest").alias("leaf")), scratch)
    runs, tops = _reduced(leaves, scratch)
    tops = scratch.keep(tops)  # a row to each group
    scratch.drop(rows)

    names = tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash")
    ranked = ranks(scratch.keep(names), name_digits, [F.col("name")], scratch, most)
    roots = _keep_by_depth(_keyed(ranked, fanout).select("grp", "key", "hash", "depth", F.struct("name").alias("leaf")), scratch)
    top_runs, root = _reduced(roots, scratch)
    root = scratch.keep(root)
    above = root.select("grp", "key", F.array().cast(_PATH).alias("path"), F.struct(F.lit("").alias("subroot"), F.col("hash").alias("root")).alias("carried"))
    found = [x.select(F.col("leaf.name").alias("grp"), F.struct(F.col("hash").alias("subroot"), "carried.root").alias("carried"), "path") for x in _descended(top_runs, above, scratch)]
    lone = root.where("leaf is not null")  # a single group
    found.append(lone.select(F.col("leaf.name").alias("grp"), F.struct(F.col("hash").alias("subroot"), F.col("hash").alias("root")).alias("carried"), F.array().cast(_PATH).alias("path")))
    groups = found[0]
    for x in found[1:]:
        groups = groups.unionByName(x)
    groups = scratch.keep(groups)

    parts = _descended(runs, groups.withColumn("key", F.lit("")), scratch)
    parts.append(tops.where("leaf is not null").join(groups, "grp").select("leaf", "hash", "carried", "path"))  # groups of one record
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("leaf.id", "hash", "leaf.rest.rest", "carried.subroot", "carried.root", "path")


def _keep_by_depth(df: DataFrame, scratch: Scratch) -> DataFrame:
    path = scratch.path()
    df.write.option("compression", "zstd").partitionBy("depth").parquet(path)
    kind = df.schema
    return scratch.spark.read.schema(kind).parquet(path)


def siblings(path: Column) -> Column:
    """All hashes of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to along a path: another than the tree's if the record has changed."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["left"], h, p["right"]))
