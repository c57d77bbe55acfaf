"""Queries on pieces against their SQL, on texts that sf0.001 lacks: initials in a row, glued sentences, full-width stops, empty and null texts."""

import compare
import duckdb
import pytest

from vellum import plans

TEXTS = [
    "He is. A. A. A. A. A. A. A. Erth then. Met J. K. Smith (A. B. Cee) there. End.",
    "A. B. C. D. E. f. " * 6,
    "word.Next one. はい。次へ！ Then \"so.\" Yes.</i> (J.) K. then\x0b. On\x0b\x0bto.",
    "",
    None,
    "Reference list. x.\tMethods.\n\ny. <sup>1</sup> Z. U.S.A. policy",
]


@pytest.mark.parametrize("name", ["b10_minimum_length", "b16_untranslated", "b17_hallucinated", "b18_edit_validity", "b3_skip_translation", "b4_exclude_paragraphs", "d18_splitter_totals", "d21_ordered_text", "d8_sentences_by_paragraph", "d9_paragraph_histogram", "e12_sentence_context", "e4_reference_section", "e11_paragraph_contexts", "e2_glued_sentences"])
def test_same_pieces_as_the_sql(spark, tmp_path, name):
    rows = [(i, t, "en", f"src{i}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert compare.difference(con, plans.oracle_sql()[name], plans.queries()[name](spark, str(tmp_path))) == ""
