"""H11 against its SQL: sizes of 0 and at the limit, odd ids below 0, values that are none or no number."""

import compare
import duckdb
import pytest

from vellum import plans

VALUES = [None, 0.0, -0.0, 3.99, 4.0, 6.0, 6.01, 7.79999999999999, 7.8, 7.800000000000001, 10.0, -1e300, float("nan"), float("inf"), float("-inf")]


@pytest.mark.parametrize("name", ["h11_span_styles", "h11_blank_spans"])
def test_same_rows_as_the_sql(spark, tmp_path, name):
    rows = [(i, kind, v) for i in [*range(-31, 32), None] for kind in ("click", "view", None) for v in VALUES]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert compare.difference(con, plans.oracle_sql()[name], plans.queries()[name](spark, str(tmp_path))) == ""
