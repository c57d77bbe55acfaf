"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, blocks_of

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents for each class, and least classes, into which the ranks of a source are counted before its cut is looked for in one of them.
CLASS_ROWS, CLASSES = 10_000, 4096
#: Most rows of chances (up to 63 to a source) that are broadcast; with more they are joined by shuffling.
MOST_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone: 48 bits of a digest, so that reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most_copies: int = 3) -> DataFrame:
    """Target words of each source: a table with a row for each (key, source, source_size, target).

    Sources in code point order, null last, have the given weights, repeating. Their targets share `share` of all
    words in proportion to the weights; none exceeds `most_copies` times its source, the excess goes to the others
    by weight until none is above. With the sources sorted by cap over weight, those that stop at their cap are a
    prefix, so the level of the others comes from running sums: one task over all sources, a row to each.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w)
    by = by.withColumn("cap", (F.lit(most_copies) * F.col("source_size")).cast("double"))
    run = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = run.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total, all_w = F.sum("source_size").over(all_rows) * F.lit(float(share)), F.sum("w").over(all_rows)
    left, left_w = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), all_w - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    by = by.withColumn("level", left / left_w).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    open_level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), "source", "level"))).over(all_rows)["level"]
    return by.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(open_level * F.col("w"))).select("source", "source_size", "target")


def measure(size: Column) -> Column:
    """What a document's chance of one more copy is in proportion to: the binary digits of its size, 0 for an empty one."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (key, m, whole, lacks, p): the chance p of one more copy for the documents of each source and measure m.

    `p = min(1, c * m)` with the c at which the expected words of the extra copies are what the source lacks. Of the
    measures from the largest down, those at p = 1 are a prefix, so c comes from running sums over a source's measures, of
    which there are at most 63.
    """
    by = sizes.groupBy("key", "m").agg(F.sum("size").alias("words")).join(targets, "key")
    down = W.partitionBy("key").orderBy(F.desc("m"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("m")).over(down.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("c", F.when(below > 0, (F.col("lacks") - above) / below).otherwise(0.0))
    by = by.withColumn("open", F.col("c") * F.col("m") < 1)
    level = F.max(F.when(F.col("open"), F.struct("m", "c"))).over(W.partitionBy("key"))["c"]
    return by.select("key", "m", "whole", "lacks", "source_size", "target", F.when(F.col("open"), F.greatest(level, F.lit(0.0)) * F.col("m")).otherwise(1.0).alias("p"))


def mix(docs: DataFrame, scratch: Scratch, seed: str = "mix-1", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most_copies: int = 3, row_col: str | None = None) -> DataFrame:
    """How often the mix takes each document: rows (doc_id, source, size, source_size, target, p, copies, taken).

    A source of ratio r = target / size gives every document floor(r) certain copies. For what is still lacking each
    document has its own inclusion probability p, in proportion to the binary digits of its size and 1 at most. Documents
    are ranked by random odds u/(1-u) over inclusion odds p/(1-p); those of p = 1 come first, and the smallest ranks are
    taken as far as their words come nearest to what the source lacks: a Pareto order sample of fixed size in words.
    The ranks of a source are first summed by class; only the class in which the cut falls is ordered row by row, some
    CLASS_ROWS documents, so no source is ordered in one task.

    Null text: size 0, taken 0. A null source is a source of its own. Ties in rank fall to the smaller doc_id; repeated
    rows count as documents of their own; to tell them apart, `row_col` names a column of row numbers, which comes back
    and to which ties of equal ids and sizes fall (it must not be named as one of the result's own columns, nor key, m, q or class). A source of size 0 has target 0. An empty table gives an empty result.
    """
    row = [row_col] if row_col else []
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # null is a source too
    sizes = docs.select("doc_id", "source", *row, n_words(F.col("text")).alias("size"))
    sizes = scratch.keep(sizes.withColumn("m", measure(F.col("size"))).withColumn("key", key))
    targets = scratch.keep(source_targets(sizes, weights, share, most_copies))
    targets = targets.select(key.alias("key"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("r"))
    targets = targets.withColumn("whole", F.least(F.floor("r"), F.lit(most_copies)).cast("long"))
    targets = targets.withColumn("lacks", F.col("target") - F.col("whole") * F.col("source_size"))
    chances = scratch.keep(inclusion(sizes, targets))
    few = chances.count() <= MOST_BROADCAST  # rows of sources and measures; the cuts are fewer. Without it a large source is left to Spark's skew join
    hint = F.broadcast if few else lambda x: x
    ranked = sizes.join(hint(chances), ["key", "m"])
    classes = max(CLASSES, blocks_of(sizes.count(), CLASS_ROWS))
    u = uniform(F.col("doc_id"), seed)
    odds = F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    ranked = ranked.withColumn("q", F.when(F.col("lacks") > 0, odds)).withColumn("class", F.floor(F.col("q") / (1 + F.col("q")) * classes).cast("int"))
    counts = ranked.where("q is not null").groupBy("key", "class").agg(F.sum("size").alias("words"), F.first("lacks").alias("lacks"))
    upto = W.partitionBy("key").orderBy("class")
    counts = counts.withColumn("end", F.sum("words").over(upto)).withColumn("begin", F.col("end") - F.col("words"))
    cut = counts.where("begin < lacks and end >= lacks").groupBy("key").agg(F.min(F.struct("class", "begin")).alias("c")).select("key", F.col("c.class").alias("cut"), "c.begin")
    ranked = ranked.join(hint(cut), "key", "left")
    edge = ranked.where("class = cut")
    inside = W.partitionBy("key").orderBy("q", "doc_id", "size", *row).rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("end", F.col("begin") + F.sum("size").over(inside))
    nearer = (F.col("end") - F.col("size") < F.col("lacks")) & ((F.col("end") <= F.col("lacks")) | (F.col("end") - F.col("lacks") <= F.col("lacks") - (F.col("end") - F.col("size"))))
    edge = edge.withColumn("extra", nearer)
    sure = ranked.where("class is null or cut is null or class <> cut").withColumn("extra", F.coalesce((F.col("class") < F.col("cut")) | (F.col("cut").isNull() & F.col("class").isNotNull()), F.lit(False)))
    cols = ["doc_id", "source", *row, "size", "source_size", "target", "p", "whole", "extra"]
    both = sure.select(cols).unionByName(edge.select(cols))
    copies = (F.col("whole") + F.col("extra").cast("long")).alias("copies")
    return both.select("doc_id", "source", *row, "size", "source_size", "target", "p", copies).withColumn("taken", F.col("copies") * F.col("size"))
