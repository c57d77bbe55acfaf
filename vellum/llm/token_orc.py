"""Token-ID output: ORC files with run-length coded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, blocks_of, encoder, release, slices, with_end

#: Characters of text to a file where there is enough for every core, and documents to a file where there is not.
FILE_CHARS, FILE_ROWS = 64_000_000, 5_000
#: ORC's stripe size, rows to a row-index entry and Bloom filter settings.
ORC = {
    "compression": "none",  # the run-length coded ids are dense already
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def encode(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Rows (doc_id, row, ids): the whole text's ids and the end id, and the row's number in its partition. A null text has the end id alone."""

    def run(batches):
        row = 0
        for b in batches:
            for s, e in slices(b["text"]):
                ids, n = encoder(tokenizer).encode(b["text"].slice(s, e - s).cast(pa.binary()).fill_null(b"").to_pylist())
                if end_id is not None:
                    ids, n = with_end(ids, n, end_id)
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(s, e - s), pa.array(np.arange(row, row + e - s)), pa.ListArray.from_arrays(at, pa.array(ids))], names=["doc_id", "row", "ids"])
                row += e - s
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, row long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0) -> None:
    """Writes (doc_id, row, ids) in ascending doc_id order: every file holds a range of ids, its stripes are sorted.

    The texts are dealt out by range of id and text's hash before they are encoded, so that rows without an id, or with one and
    the same, fill as many files as they need. Null ids come first; of equal ids the smaller hash comes first, repeated rows in any
    order. `row` is a row's place in its file. Other columns are not written. An empty table gives an empty folder of files.
    """
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    spread = docs.sparkSession.sparkContext.defaultParallelism * 8
    files = max(blocks_of(chars, FILE_CHARS), min(blocks_of(n, FILE_ROWS), spread))
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order)
    encode(ranged, tokenizer, end_id).write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, row, ids, file): Spark reads the stripes in parallel and prunes them by predicates on doc_id."""
    return spark.read.schema("doc_id long, row long, ids array<int>").orc(path).select("doc_id", "row", "ids", F.col("_metadata.file_path").alias("file"))


def positions(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files alone.

    A row's start is the ids of its file's rows before it and of the files of smaller ids: one row to a file of some 64
    million characters, which one task adds up; files of one id alone follow by name, which Spark numbers by range. The crc is of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for b in batches:
            ids = b["ids"]
            flat, at = ids.values.to_numpy(zero_copy_only=False).view("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], b["file"], pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "row", "file", "n_tokens", "ids_crc32"])

    rows = scratch.keep(read(spark, path).mapInArrow(run, "doc_id long, row long, file string, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"), F.count("doc_id").alias("known"))
    before = W.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    files = files.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "base")
    inside = W.partitionBy("file").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
