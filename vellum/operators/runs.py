"""Window-shaped operators: runs, state machines, budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.greedy import SLICE_ROWS, chain
from vellum.sources.scratch import kept


def pieces(docs: DataFrame, places: bool = True, cut: Callable[[Column], Column] = T.sentence_pieces) -> DataFrame:
    """H1 and H2: rows (doc_id, k, p, start, end) of the sentence pieces that `cut` makes; places count characters from 0.

    Places need the pieces of a text in one partition: the texts are dealt out before they are cut, so that nothing moves
    after. Without them nothing moves at all.
    """
    docs = docs.select("doc_id", "text")
    x = (docs.repartition("doc_id") if places else docs).select("doc_id", F.posexplode(cut(F.col("text"))).alias("k", "p"))
    if not places:
        return x.withColumn("k", F.col("k").cast("long"))
    order = W.partitionBy("doc_id").orderBy("k")
    end = F.sum(F.length("p")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return x.select("doc_id", F.col("k").cast("long").alias("k"), "p", (end - F.length("p")).alias("start"), end.alias("end"))


def glue(piece: DataFrame, joined: str) -> DataFrame:
    """Pieces for which `joined` holds, and blank ones, go with the one before: rows (doc_id, s, start, end, text)."""
    order = W.partitionBy("doc_id").orderBy("k")
    begins = ~(F.expr(joined) | ~F.col("p").rlike(f"[^{T.SPACE}]")) | (F.col("k") == 0)
    x = piece.withColumn("s", F.sum(begins.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    parts = F.array_sort(F.collect_list(F.struct("k", "p")))
    return x.groupBy("doc_id", F.col("s").cast("long").alias("s")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(parts, lambda z: z["p"]), "").alias("text"))


def reference_section(rows: DataFrame, start: str = T.REFERENCES_START, end: str = T.REFERENCES_END) -> DataFrame:
    """Rows (doc_id, i, text, label) get the label references from a starting heading up to an ending one (patterns).

    The headings keep their labels, captions and footnotes too. The state goes on from page to page of a document.
    """
    start, end = F.col("text").rlike(start), F.col("text").rlike(end)
    mark = F.when(start, 1).when(end, 0)
    before = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(0)) == 1
    label = F.when(inside & ~end & ~F.coalesce(F.col("label").isin("caption", "footnote"), F.lit(False)), "references").otherwise(F.col("label"))
    return rows.withColumn("label", label)


def budgeted_prefix(rows: DataFrame, budget: int, each: int) -> DataFrame:
    """E5: rows (doc_id, k, p) as long as what came before is within the budget; each text cut off at `each`."""
    x = rows.withColumn("text", T.cut_off(F.col("p"), each))
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("kept", before <= budget)


def recent_history(turns: DataFrame, pairs: int = 4, answer: int = 1500, budget: int = 8000) -> DataFrame:
    """Of each conversation the latest question-answer pairs, newest first, until the budget is used; one at least."""
    order = W.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    x = x.where("role = 'user' and next_role = 'assistant'").withColumn("answer", F.substring("answer", 1, answer))
    x = x.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))).cast("long"))
    used = F.sum(F.length("text") + F.length("answer")).over(W.partitionBy("conv_id").orderBy("rn").rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("used", used).where((F.col("rn") <= pairs) & ((F.col("rn") == 1) | (F.col("used") <= budget))).select("conv_id", "turn", "rn", "used", F.col("text").alias("question"), "answer")


def sections(answers: DataFrame, closed_only: bool = False) -> DataFrame:
    """The marked sections of an answer, rows (conv_id, block, text); the last of equal numbers wins.

    A section ends at the next mark, the end mark or the end; with `closed_only` an unfinished last one is left out.
    """
    x = answers.select("conv_id", F.col("text").rlike(r"(?i)===\s*END\s*===").alias("ended"), F.posexplode(F.split("text", r"===\s*BLOCK\s+")).alias("k", "part")).where("k > 0")
    x = x.withColumn("last", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("k"))) == 1)
    number, body = F.regexp_extract("part", r"^([0-9]+)\s*===", 1), F.regexp_replace(F.regexp_replace("part", r"^[0-9]+\s*===", ""), r"(?is)===\s*END\s*===.*$", "")
    x = x.where(number != "").select("conv_id", "k", "last", "ended", number.cast("long").alias("block"), T.trim(body).alias("text"))
    if closed_only:
        x = x.where("not last or ended")
    newest = F.row_number().over(W.partitionBy("conv_id", "block").orderBy(F.desc("k")))
    return x.withColumn("rn", newest).where("rn = 1").select("conv_id", "block", "text")


def caption_runs(rows: DataFrame) -> DataFrame:
    """Rows that go on with a caption: from a caption head up to the next head or the end of its paragraph (doc_id, p)."""
    head = T.caption_head(F.col("text")).isNotNull()
    order = W.partitionBy("doc_id", "p").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    x = rows.withColumn("run", F.sum(head.cast("int")).over(order))
    return x.where("run > 0").withColumn("run", F.col("run").cast("long"))


def contexts(pages: DataFrame, chars: int = 700) -> DataFrame:
    """The end of the page before and the beginning of the page after."""
    order = W.orderBy("page_no") if "doc_id" not in pages.columns else W.partitionBy("doc_id").orderBy("page_no")
    return pages.withColumn("before", F.right(F.lag("text").over(order), F.lit(chars))).withColumn("after", F.left(F.lead("text").over(order), F.lit(chars)))


def paragraph_contexts(para: DataFrame, pages: DataFrame, chars: int = 700) -> DataFrame:
    """E11 for paragraphs (doc_id, page_no, p, ...): adds `before`, the end of the page before, to the first of each page, and `after`, the beginning
    of the page after, to the last; empty elsewhere. `pages` has (doc_id, page_no, text)."""
    page = W.partitionBy("doc_id", "page_no")
    x = para.withColumns({"first": F.min("p").over(page), "last": F.max("p").over(page)}).join(contexts(pages, chars).drop("text"), ["doc_id", "page_no"], "left")
    only = lambda c, end: F.when(F.col("p") == F.col(end), F.coalesce(c, F.lit(""))).otherwise("")
    return x.withColumns({"before": only("before", "first"), "after": only("after", "last")}).drop("first", "last")


def paragraph_batches(sentence: DataFrame, budget: int = 6500, each: int = 2500) -> DataFrame:
    """E5 in paragraphs: rows (doc_id, p, i, src, tgt, label) get `piece`, what is sent of a sentence, and `failed`, whether there was no room for it.

    Sentences that have a translation already, or a label that is not translated, are not sent: their piece is null. The others are cut
    off at `each` and sent under a head with their number, until the pieces so far exceed the budget; the one that crosses it is sent.
    """
    skip = F.coalesce(F.col("label").isin("references", "footnote", "authors", "affiliation", "contact", "formula"), F.lit(False))
    asks = (F.coalesce("tgt", F.lit("")) == "") & ~skip
    piece = F.when(asks, F.concat(F.lit("===INPUT BLOCK "), F.col("i"), F.lit("===\n"), T.cut_off(F.col("src"), each)))
    before = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy("doc_id", "p").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = sentence.withColumn("piece", piece).withColumn("used", before)
    failed = F.col("piece").isNotNull() & (F.col("used") > budget)
    return x.withColumn("failed", failed).withColumn("piece", F.when(~F.col("failed"), F.col("piece"))).drop("used")


#: Labels whose sentences don't go on over the page (fixed values).
NO_MERGE = ("title", "heading", "subheading", "abstract_heading", "authors", "affiliation", "contact", "keywords", "caption", "references", "footnote")


def page_stitches(sentence: DataFrame) -> DataFrame:
    """Rows (doc_id, page_no, i, mate_i, merged) where a page's last sentence goes on in the first of the next page.

    `sentence` has (doc_id, page_no, i, src, label). The last must not end a sentence, and both must be body text; a caption goes on too if it
    ends in mid-sentence and is no mere title, into body text or a caption, but not into the head of another figure.
    """
    last = sentence.groupBy("doc_id", "page_no").agg(F.max(F.struct("i", "src", "label")).alias("a"))
    first = sentence.groupBy("doc_id", (F.col("page_no") - 1).alias("page_no")).agg(F.min(F.struct("i", "src", "label")).alias("b"))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    x = last.join(first, ["doc_id", "page_no"]).withColumns({"end": F.regexp_replace(bare(F.col("a.src")), r"\s+$", ""), "begin": F.regexp_replace(bare(F.col("b.src")), r"^\s+", "")})
    label = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("body"))
    title = F.col("end").rlike(T.CAPTION_START) & (F.length("end") < 100) & ~F.contains("end", F.lit(","))
    goes_on = (label(F.col("a.label")) == "caption") & ~title & F.col("end").rlike(r"[a-z0-9,;:(\-–]$")
    open_end = (F.col("end") != "") & ~F.col("end").rlike("[.!?。！？]$") & (~label(F.col("a.label")).isin(*NO_MERGE) | goes_on)
    takes = (~label(F.col("b.label")).isin(*NO_MERGE) | (goes_on & (label(F.col("b.label")) == "caption"))) & ~(goes_on & F.col("begin").rlike(T.CAPTION_START))
    merged = F.concat(F.regexp_replace("a.src", r"\s+$", ""), F.lit(" "), F.regexp_replace("b.src", r"^\s+", ""))
    return x.where(open_end & takes).select("doc_id", "page_no", F.col("a.i").alias("i"), F.col("b.i").alias("mate_i"), merged.alias("merged"))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their number, from 1, in an order over all of them: ranks within ranges, after the rows of the ranges before.

    The ranges are written, lest another run cut them elsewhere.
    """
    x = kept(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row to a range
    base = x.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return x.withColumn(name, rank).join(F.broadcast(base), "part").withColumn(name, F.col(name) + F.col("base")).drop("part", "base")


def throttled(events: DataFrame, gap: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Of events (key, at, ...) those that a throttle lets through: the first at least `gap` after the key's beginning, then each at
    least `gap` after the one before it. The beginning is the key's first event. Of events at one time one is looked at, the least
    row; those without a time are left out.
    """
    rest = [c for c in events.columns if c not in ("key", "at")]
    one = events.where("at is not null").groupBy("key", "at").agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("rest"))
    begin = one.groupBy("key").agg((F.min("at") + gap).alias("from"))
    out = chain(one.select("key", F.col("at").alias("start"), (F.col("at") + gap).alias("end"), "rest"), slice_rows, begin)
    return out.select("key", F.col("start").alias("at"), *([f"rest.{c}" for c in rest]))


def first_spans(spans: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Of overlapping spans of a key, in order of start, the first wins; skipped ones do not count.

    Of the spans of one start that are not empty only the least can win, so one of them is looked at. Those without a start
    or an end are left out, and those that begin below 0. A key of many spans is worked out in slices: see `greedy.chain`.
    """
    spans = spans.select("key", "start", "end", "tag").where("start is not null and end is not null")
    some = F.col("end") > F.col("start")
    least = spans.where(some).groupBy("key", "start").agg(F.min(F.struct("end", "tag")).alias("s")).select("key", "start", "s.*")
    return chain(least.unionByName(spans.where(~some)), slice_rows).select("key", "start", "end", "tag")
