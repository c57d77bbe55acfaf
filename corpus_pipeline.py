"""The corpus pipeline: language ID, near-duplicate groups, substring dedup, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import langid, mixing, ngram_join
from vellum.llm.common import Scratch
from vellum.llm.queries import pack_documents
from vellum.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language is found or the best one's posterior is below this.
LEAST_SCORE = 0.5
#: A number for each row, made once, since ids may be null or repeat: with it the stages find a row again.
ROW = "row"


def with_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with the number that an earlier stage gave them, or else with one that is written first."""
    if ROW in docs.columns:
        return docs.select(*COLUMNS, ROW)
    return scratch.keep(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays open, go; so do null and empty texts, and all where nothing can be learned.

    Rows without an id, and repeated ones, are judged as any other. What stays is numbered by partition and place: nothing is shuffled
    between the scan and the numbers, so whoever reads the result twice sees the same ones. (A copy written for that alone would be
    two thirds of the input on disk.) Other columns than those of documents are left out; an empty table gives an empty result.
    """
    found = langid.identify(spark, docs.select(*COLUMNS))
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id())


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the smallest id, and of equal ids the smallest row number.

    A row without an id is in a group as any other and stays if no row of its group has an id before it; repeated rows are a group.
    """
    scratch = Scratch(spark, "groups")
    docs = with_rows(docs, scratch)
    groups = scratch.keep(ngram_join.ngram_components(docs, scratch, id_col=ROW).select(ROW, "component_id"))
    ids = docs.select(ROW, F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", ROW).alias("o"))
    first = groups.where("component_id is not null").join(ids, ROW).groupBy("component_id").agg(F.min("o").alias("o")).select(F.col(f"o.{ROW}").alias(ROW))
    kept = first.unionByName(groups.where("component_id is null").select(ROW))
    return docs.join(kept, ROW, "left_semi").select(*COLUMNS, ROW)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document has go; a document of which no word is left goes with them.

    A row without an id keeps all and removes nothing; rows of one id do not remove each other's passages. A null text comes back empty.
    """
    docs = with_rows(docs, Scratch(spark, "passages"))
    out = substring_dedup(docs, keep_unchanged=True).where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("rest.n_chars"))
    return out.select("doc_id", F.col("kept").alias("text"), "rest.lang", "rest.source", n_chars.alias("n_chars"), f"rest.{ROW}")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without an id and repeated ones count as documents of their own."""
    scratch = Scratch(spark, "mix")
    docs = with_rows(docs, scratch)
    copies = mixing.mix(docs, scratch, row_col=ROW).where("copies > 0").select(ROW, "copies")
    return docs.join(copies, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, repeated ones as documents of their own; a null or empty text is its end id. No rows give no pieces."""
    return pack_documents(spark, docs, Scratch(spark, "pack"))


STAGES = [
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", remove_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Naive Bayes and byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
