"""What the ORC files hold besides the ids, what a look-up reads of them, and a very long text."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import token_orc
from vellum.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def written(spark, df):
    path = Scratch(spark, "t").path()
    token_orc.write(df, path, PATH)
    return path


def read_rows(df):
    """Rows that the scan gives out for a look-up, and those that come back."""
    found = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value(), found


def test_bloom_filters_and_row_indexes_are_used(spark):
    docs = spark.range(0, 12_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    path = written(spark, docs.coalesce(1))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kinds = set()
    for name in spark.read.orc(path).inputFiles():
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        kinds |= {(s.getColumn(), s.getKind().toString()) for stripe in reader.getStripes() for s in rows.readStripeFooter(stripe).getStreamsList()}
        rows.close()
    assert (1, "ROW_INDEX") in kinds and {k for c, k in kinds if c == 1 and "BLOOM" in k}
    files = token_orc.read(spark, path)
    whole, _ = read_rows(files)
    one, found = read_rows(files.where("doc_id = 5000"))
    none, missing = read_rows(files.where("doc_id = 5001"))  # within a file's range: only the Bloom filter knows that it is not there
    assert whole == 6000 and len(found) == 1 and one <= 1000 and missing == [] and none == 0


def test_a_very_long_text(spark):
    long = "Many words, isn't it? " * 60_000
    docs = spark.createDataFrame([(2, long), (1, "short"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens) for r in token_orc.positions(spark, written(spark, docs), Scratch(spark, "t")).collect()}
    n = len(Tokenizer.from_file(PATH).encode(long, add_special_tokens=False).ids) + 1
    assert got == {1: (0, 2), 2: (2, n), 3: (2 + n, 1)}
