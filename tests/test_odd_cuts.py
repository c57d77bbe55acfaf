"""Queries on pieces against their SQL, on texts that test_first_cuts lacks: stops in a row, headings, odd spaces and letters, marks, no id."""

import compare
import duckdb
import pytest

from vellum import plans

TEXTS = [
    "So. . . ! ? . . ! . . it went, on. " * 3 + ". Yes, no. ",
    "One piece is long enough. . . References. Then methods are told. Appendix. And so on, to the end. Methods: none. End",
    "はい、Straße, ﬁne. はい Straße! ab\u3000,\u00a0. c,\u2003. d, e. " * 2,
    "A short piece 1234\u00a0. \u3000\u3000A short piece 12345. \x0b. \x0bA short piece 1\x0b\x0b\x0b\x0b. End then. ",
    "a\x01\x01\x01b. \x01c. \x01\x01\x01d e. ",
    "No id. It has. . five pieces. at. least. and. more",
    "\x0b. " + "\x0b" * 20 + ". " + "word " * 25 + "\x0b" * 8 + ". x. y",
]
NAMES = ["b16_untranslated", "b17_hallucinated", "b18_edit_validity", "b3_skip_translation", "b4_exclude_paragraphs", "d18_splitter_totals", "d21_ordered_text", "d8_sentences_by_paragraph", "d9_paragraph_histogram", "e11_paragraph_contexts", "e12_sentence_context", "e2_glued_sentences", "e4_reference_section"]


def rows():
    return [(None if t.startswith("No id") else i, t, "en", f"src{i}", len(t)) for i, t in enumerate(TEXTS)]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_the_sql(spark, tmp_path, name):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.difference(con, plans.oracle_sql()[name], plans.queries()[name](spark, str(tmp_path))) == ""
