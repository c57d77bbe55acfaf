"""Model calls as batches over a pluggable backend. A failing call gives an error in its row and ends nothing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.functions import text as T


class Backend(Protocol):
    def answer(self, prompts: list[str]) -> list[str]:
        """One answer to each prompt; raises if the batch fails."""


class Replay:
    """Answers from a fixed table, else by a rule on the prompt: for tests and reruns."""

    def __init__(self, known: dict[str, str] | None = None, rule=None) -> None:
        self.known, self.rule = known or {}, rule

    def answer(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            if p in self.known:
                out.append(self.known[p])
            elif self.rule:
                out.append(self.rule(p))
            else:
                raise KeyError("no recorded answer")
        return out


def ask(prompts: DataFrame, backend: Backend) -> DataFrame:
    """Adds answer and error to rows with a prompt. A batch that fails is asked row by row, so that one bad prompt costs one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["prompt"].tolist()
            try:
                answers, errors = backend.answer(texts), [None] * len(texts)
            except Exception:
                answers, errors = [], []
                for t in texts:
                    try:
                        answers.append(backend.answer([t])[0])
                        errors.append(None)
                    except Exception as e:
                        answers.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield f.assign(answer=answers, error=errors)

    schema = StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("error", StringType())])
    return prompts.mapInPandas(run, schema)


def split_by_model(pieces: DataFrame, backend: Backend) -> DataFrame:
    """Asks which pieces belong to the one before. Rows (doc_id, joins); documents of one piece are not asked."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda z: F.concat(F.lit("["), z["k"] + 1, F.lit("] "), F.trim(z["p"]))), "\n")
    asked = pieces.groupBy("doc_id").agg(listed.alias("list"), F.count(F.lit(1)).alias("n")).where("n > 1")
    prompt = F.concat(F.lit("Which numbers go on with the sentence before? Answer as JOIN: followed by the numbers.\n"), "list")
    answers = ask(asked.select("doc_id", prompt.alias("prompt")), backend)
    line = F.regexp_extract("answer", r"(?i)JOIN\s*:\s*([0-9,\s]*)", 1)
    return answers.select("doc_id", F.transform(F.regexp_extract_all(line, F.lit("[0-9]+"), 0), lambda x: x.cast("long")).alias("joins"), "error")


STRUCTURE = "exclude array<int>, merge array<array<int>>, join array<int>"


def page_structure(pieces: DataFrame, backend: Backend) -> DataFrame:
    """Asks once per page what to leave out, what to merge and what goes on: rows (doc_id, exclude, merge, join, error).

    The answer's first object counts, fenced or not; whatever cannot be read gives empty lists. Numbers that the page
    does not have are dropped.
    """
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda z: F.concat(F.lit("["), z["k"], F.lit("] "), F.trim(z["p"]))), "\n")
    asked = pieces.groupBy("doc_id").agg(listed.alias("list"), F.count(F.lit(1)).cast("int").alias("n"))
    prompt = F.concat(F.lit("Of these "), "n", F.lit(" numbered parts of a page, name those to leave out, pairs of one paragraph, and those that go on. Answer in JSON.\n"), "list")
    answers = ask(asked.select("doc_id", "n", prompt.alias("prompt")), backend)
    found = answers.withColumn("f", F.from_json(F.regexp_extract(T.strip_fence(F.col("answer")), r"(?s)\{.*\}", 0), STRUCTURE))
    known = lambda i: (i >= 0) & (i < F.col("n"))
    numbers = lambda c: F.coalesce(F.filter(c, known), F.array().cast("array<int>"))
    pairs = F.coalesce(F.filter("f.merge", lambda m: (F.size(m) == 2) & F.forall(m, known)), F.array().cast("array<array<int>>"))
    return found.select("doc_id", numbers("f.exclude").alias("exclude"), pairs.alias("merge"), numbers("f.join").alias("join"), "error")


def figure_numbers(captions: DataFrame, backend: Backend, key: str) -> DataFrame:
    """Asks for the number of a figure by its caption: rows (key, number), small letters and digits alone, null if none."""
    asked = captions.select(key, F.concat(F.lit("Which number has the figure of this caption? Answer as JSON with figure_number.\n"), "text").alias("prompt"))
    said = F.get_json_object(F.regexp_extract(T.strip_fence(F.col("answer")), r"(?s)\{.*?\}", 0), "$.figure_number")
    return ask(asked, backend).select(key, F.nullif(F.regexp_replace(F.lower(said), "[^a-z0-9]", ""), F.lit("")).alias("number"))


def answer_question(context: DataFrame, question: str, backend: Backend) -> DataFrame:
    """One answer from the cited sentences (tag, sentence, score) of a retrieval, best first; a row (answer, error).

    The context has as many rows as the retrieval's limit lets through.
    """
    parts = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "k", F.concat_ws(" ", "tag", "sentence").alias("t"))))
    listed = context.agg(F.array_join(F.transform(parts, lambda z: z["t"]), "\n").alias("t"))
    prompt = F.concat(F.lit("Answer from these sentences and cite their tags.\n"), "t", F.lit("\nQuestion: "), F.lit(question))
    return ask(listed.select(prompt.alias("prompt")), backend).select(T.strip_thinking(F.col("answer")).alias("answer"), "error")


def translate(sentences: DataFrame, backend: Backend, lang: str) -> DataFrame:
    """Rows (doc_id, k, p, label) with a target.

    Labels that are not translated keep their source; a failed, empty or invented answer becomes the failure mark.
    """
    fixed = F.coalesce(F.col("label").isin("references", "footnote", "authors", "affiliation", "contact", "formula"), F.lit(False))
    asked = sentences.where(~fixed).select("doc_id", "k", "p", F.concat(F.lit(f"Translate into {lang}:\n"), "p").alias("prompt"))
    got = ask(asked, backend).select("doc_id", "k", F.when(~T.hallucinated(F.col("answer"), F.length("p")), F.nullif(T.trim(F.col("answer")), F.lit(""))).alias("answer"))
    joined = sentences.join(got, ["doc_id", "k"], "left")
    return joined.withColumn("target", F.when(fixed, F.col("p")).otherwise(F.coalesce("answer", F.lit("[translation failed]")))).drop("answer")


def retranslate(rows: DataFrame, backend: Backend, lang_code: str, lang: str) -> DataFrame:
    """K2, K5 and K7: asks again for the rows whose target is still in the source's language; the others stay."""
    again = T.untranslated(F.col("target"), F.col("p"), F.lit(lang_code))
    fresh = translate(rows.where(again).drop("target"), backend, lang).select("doc_id", "k", F.col("target").alias("fresh"))
    return rows.join(fresh, ["doc_id", "k"], "left").withColumn("target", F.coalesce("fresh", "target")).drop("fresh")


def retranslate_chosen(rows: DataFrame, chosen: DataFrame, glossary: dict[str, str], backend: Backend, lang: str) -> DataFrame:
    """K2: asks again for chosen sentences (doc_id, k) with a glossary and the target to avoid; a failed or invented answer changes nothing."""
    words = "".join(f"{a} = {b}\n" for a, b in glossary.items())
    prompt = F.concat(F.lit(f"Translate into {lang}.\n{words}Do not answer as before: "), F.coalesce("target", F.lit("")), F.lit("\n"), "p")
    asked = rows.join(chosen.select("doc_id", "k").distinct(), ["doc_id", "k"], "left_semi").select("doc_id", "k", "p", prompt.alias("prompt"))
    good = F.when(~T.hallucinated(F.col("answer"), F.length("p")), F.nullif(T.trim(F.col("answer")), F.lit("")))
    fresh = ask(asked, backend).select("doc_id", "k", good.alias("fresh"))
    return rows.join(fresh, ["doc_id", "k"], "left").withColumn("target", F.coalesce("fresh", "target")).drop("fresh")
