"""H1 with all its branches against its SQL: stops in a row, closers with stops inside, odd spaces, marks, initials far back, null texts, ids that repeat."""

import compare
import duckdb

from vellum import plans

TEXTS = [
    "So. . . ! ? . . A. B. . C. x",
    "It ends.<sup>ab.Cd</sup> Then.<sup>a. B</sup>Up A.<sup>x. ! </sup> go. A.” ’x. (B.)\n-C.] end",
    "a.\x0b b. \x0bA.\x0bB. \x0b c.　d.  e。\x0bf！ 　g",
    "a\x01\x01b. \x01\x01A. \x01c \x01A\x01.\x01 \x01d. \x01",
    f"x A.{' ' * 147}y z A.{' ' * 148}y zA.{' ' * 148}y z A.{' ' * 149}y",
    "",
    "abc.Def “Ab.” É. x é. Ab.Cd. 終。",
    None,
]


def test_same_rows_as_the_sql(spark, tmp_path):
    rows = [(6 * i + kind, t) for i, t in enumerate(TEXTS) for kind in range(6)] + [(-7, TEXTS[0]), (-6, None)]
    rows += [(i, t) for i, t in [*rows, (None, TEXTS[0]), (None, TEXTS[0])] if i is None or i % 4 == 1]  # equal texts leave no order open
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.difference(con, plans.oracle_sql()["h1_all_cuts"], plans.queries()["h1_all_cuts"](spark, str(tmp_path))) == ""
