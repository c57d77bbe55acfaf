"""Positioned lines, captions, answer chunks and merge edges derived from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """One row to each non-empty text line of a document, laid out in two columns on one page."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("length(text) > 0")
    col, shift = "cast(72.0D + (pos % 2) * 240.0D + (doc_id % 3) * 0.5D as double)", "case when length(text) % 5 = 0 then 10.0D else 0.0D end"
    return cut.selectExpr(
        "doc_id",
        "cast(pos as bigint) line_no",
        "text",
        f"{col} x0",
        f"72.0D + floor(pos / 2) * 14.0D + {shift} y0",
        f"{col} + least(length(text), 90) * 2.5D x1",
        f"82.0D + floor(pos / 2) * 14.0D + {shift} y1",
        "10.0D + case when length(text) % 7 = 0 then 2.0D else 0.0D end size",
        "length(text) % 11 = 0 bold",
    )


def captions(part: DataFrame) -> DataFrame:
    """Caption-like texts, some of which are captions: rows (p_partkey, text)."""
    return part.selectExpr(
        "p_partkey",
        """concat(case p_partkey % 7 when 0 then 'Fig. ' when 1 then 'Table ' when 2 then 'Figure S' when 3 then 'Supplementary Fig. '
           when 4 then 'Scheme ' when 5 then 'Tab. ' else 'See Fig. ' end, p_partkey % 13 + 1,
           case p_partkey % 4 when 0 then '. ' when 1 then ': ' when 2 then ' ' else ' shows ' end, p_name) text""",
    )


def answers(conversations: DataFrame) -> DataFrame:
    """Model answers in marked sections with thinking inside: rows (conv_id, text)."""
    return conversations.where("turn = 0").selectExpr("conv_id", "concat('===BLOCK 0===', text, '<think>x', text, '</think>===BLOCK 1===tail') text")


def chunks(answer: DataFrame, size: int = 7) -> DataFrame:
    """A text in pieces of a few characters, as a stream sends it: rows (conv_id, seq, chunk)."""
    n = F.ceil(F.length("text") / F.lit(size)).cast("int")
    cut = answer.select("conv_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return cut.select("conv_id", F.col("seq").cast("long").alias("seq"), F.substring("text", F.col("seq") * size + 1, F.lit(size)).alias("chunk"))


def merge_edges(line: DataFrame) -> DataFrame:
    return line.where("length(text) % 3 = 0").selectExpr("doc_id", "line_no a", "line_no + 1 b")


#: The same tables for the SQL oracles.
LINE_SQL = """line AS (SELECT doc_id, line_no, text,
  CAST(72.0 + (line_no % 2)*240.0 + (doc_id % 3)*0.5 AS DOUBLE) AS x0,
  CAST(72.0 + floor(line_no/2)*14.0 + CASE WHEN length(text)%5=0 THEN 10.0 ELSE 0.0 END AS DOUBLE) AS y0,
  CAST(72.0 + (line_no % 2)*240.0 + (doc_id % 3)*0.5 + least(length(text),90)*2.5 AS DOUBLE) AS x1,
  CAST(82.0 + floor(line_no/2)*14.0 + CASE WHEN length(text)%5=0 THEN 10.0 ELSE 0.0 END AS DOUBLE) AS y1,
  CAST(10.0 + CASE WHEN length(text)%7=0 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS size, length(text) % 11 = 0 AS bold
  FROM (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(text) > 0)"""
CAPTION_SQL = """cap AS (SELECT p_partkey, concat(CASE p_partkey % 7 WHEN 0 THEN 'Fig. ' WHEN 1 THEN 'Table ' WHEN 2 THEN 'Figure S' WHEN 3 THEN 'Supplementary Fig. '
  WHEN 4 THEN 'Scheme ' WHEN 5 THEN 'Tab. ' ELSE 'See Fig. ' END, p_partkey % 13 + 1,
  CASE p_partkey % 4 WHEN 0 THEN '. ' WHEN 1 THEN ': ' WHEN 2 THEN ' ' ELSE ' shows ' END, p_name) AS text FROM part)"""
ANSWER_SQL = "ans AS (SELECT conv_id, '===BLOCK 0===' || text || '<think>x' || text || '</think>===BLOCK 1===tail' AS text FROM conversations WHERE turn = 0)"
EDGE_SQL = "edge AS (SELECT doc_id, line_no AS a, line_no + 1 AS b FROM line WHERE length(text) % 3 = 0)"
