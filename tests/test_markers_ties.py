"""B17 against its SQL on answers that hold the operator's other markers; E12 and D21 on ids that repeat."""

import compare
import duckdb
import pytest

from vellum import plans
from vellum.functions import text as T

MARKED = "".join(f"One. Two. A piece says {m} here. Four. Five. Six. " for m in T.HALLUCINATION_MARKERS)


def written(spark, tmp_path, rows):
    x = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    x.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_only_the_marker_of_the_sql(spark, tmp_path):
    d = written(spark, tmp_path, [(0, MARKED), (1, "x" * 131 + " \t\n"), (2, "One. Two. " + " " * 200 + "x. y. ")])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    assert compare.difference(con, plans.oracle_sql()["b17_hallucinated"], plans.queries()["b17_hallucinated"](spark, d)) == ""


@pytest.mark.parametrize("name", ["e12_sentence_context", "d21_ordered_text"])
def test_ties_do_not_follow_the_order_of_rows(spark, tmp_path, name):
    rows = [(i, f"First {x}. Then {x}{x}. Last {x}. ") for x in "dacb" for i in (0, 1, None)]
    found = []
    for k, order in enumerate((rows, rows[::-1])):
        (tmp_path / str(k)).mkdir()
        found.append(sorted(map(repr, plans.queries()[name](spark, written(spark, tmp_path / str(k), order)).collect())))
    assert found[0] == found[1]
