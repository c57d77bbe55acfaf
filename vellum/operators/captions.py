"""Captions and legends: spreading a caption's label over its paragraphs, finding legends by number, listing all legends."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.layout import upper_median

#: Sizes within this of the caption's count as the same; a body is larger by more than LARGER; narrower cells than SHARE of the page are no text.
SAME, LARGER, SHARE = 0.6, 0.5, 0.4


def spread(sizes: list[float], widths: list[float], captions: list[bool], labelled: list[bool], page: float) -> list[bool]:
    """Which paragraphs of a page are captions in the end, in order of the page.

    A caption goes on over the unlabelled paragraphs after it until one is larger, or of the same size where the caption is not
    smaller than the page's unlabelled text, or smaller and narrow. What one caption has taken is labelled for the next, and
    goes on as a caption itself. Linear but for a heap of the sizes that are still unlabelled.
    """
    captions, labelled = list(captions), list(labelled)
    rest = [(-s, k) for k, s in enumerate(sizes) if not labelled[k]]
    heapq.heapify(rest)
    for k, size in enumerate(sizes):
        if not captions[k]:
            continue
        labelled[k] = True
        while rest and labelled[rest[0][1]]:
            heapq.heappop(rest)
        smaller = bool(rest) and size < -rest[0][0] - LARGER
        for q in range(k + 1, len(sizes)):
            other = sizes[q]
            stops = (not smaller) if abs(other - size) <= SAME else widths[q] < page * SHARE
            if labelled[q] or other > size + SAME or stops:
                break
            captions[q] = labelled[q] = True
    return captions


def spread_captions(sentence: DataFrame) -> DataFrame:
    """Rows (doc_id, i, p, label, size, width, right, ...) of sentences with their labels after captions have spread.

    A page is a doc_id, `p` its paragraphs, in the order in which they begin; `width` is that of a sentence's widest line, `right` where its
    lines end. In a paragraph with a caption all that has no label, or is taken for a title or a subheading, becomes caption; what
    follows is in `spread`. Null and empty labels are none; null widths are 0.
    """
    has = F.coalesce(F.col("label"), F.lit("")) != ""
    para = sentence.groupBy("doc_id", "p").agg(
        F.min("i").alias("first"),
        upper_median(F.col("size")).cast("double").alias("size"),
        F.max(F.coalesce("width", F.lit(0.0))).cast("double").alias("width"),
        F.coalesce(F.bool_or(F.col("label") == "caption"), F.lit(False)).alias("caption"),
        F.bool_or(has).alias("labelled"),
        F.max("right").cast("double").alias("right"),
    )
    page = para.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "p", "size", "width", "caption", "labelled"))).alias("paras"), F.coalesce(F.max("right"), F.lit(1.0)).alias("right"))
    page = page.where(F.exists("paras", lambda x: x["caption"]))
    kind = {f.name: f.dataType.simpleString() for f in para.schema.fields}

    def run(batches):
        for b in batches:
            rows, found = [], []
            for n, (paras, right) in enumerate(zip(b["paras"].to_pylist(), b["right"].to_pylist(), strict=True)):
                now = spread(*([x[c] for x in paras] for c in ("size", "width", "caption", "labelled")), right)
                mine = [x["p"] for x, c in zip(paras, now, strict=True) if c]
                rows += [n] * len(mine)
                found += mine
            p = b.schema.field("paras").type.value_type.field("p").type
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(rows, pa.int64())), pa.array(found, p)], names=["doc_id", "p"])

    hit = page.mapInArrow(run, f"doc_id {kind['doc_id']}, p {kind['p']}").withColumn("hit", F.lit(True))
    free = ~has | F.col("label").isin("title", "subheading")
    return sentence.join(hit, ["doc_id", "p"], "left").withColumn("label", F.when(F.col("hit") & free, "caption").otherwise(F.col("label"))).drop("hit")


# --------------------------------------------------------------------------- legends

# What stands before a caption's number, its kinds of words, and what ends its head.
_BEFORE = r"(?:supplementary\s+|suppl?\.?\s+|補足\s*|副\s*)"
_WORDS = {"table": r"(?:Table|Tab\.?|表)", "figure": r"(?:Fig(?:ure)?\.?|図)"}
_END = r"(?:\s*[.:：|]|\s+(?=(?-i:[A-Z]))|$)"


def head(kind: str, text: Column) -> Column:
    """Struct (before, s, digits) of the head of a legend of this kind at the beginning of a text, small; null if there is none."""
    at = f"(?i)^({_BEFORE})?\\s*{_WORDS[kind]}\\s*(s?)([0-9]+)[a-z]?{_END}"
    part = lambda k: F.lower(F.regexp_extract(text, at, k))
    return F.when(text.rlike(at), F.struct((part(1) != "").alias("before"), (part(2) != "").alias("s"), part(3).alias("digits")))


def legends_of(sentence: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (doc_id, num, kind) the document's first legend: rows (doc_id, num, kind, legend).

    `sentence` has (doc_id, page_no, i, p, src, tgt): the translation, or else the source, of the first sentence that begins with
    the legend's head, and of the sentences after it up to the page's next paragraph or another head of the same kind, without
    markup, set apart by spaces. A number with S also stands for the same number without, where "supplementary" comes first; a
    number without S may have "supplementary" before it. Numbers whose head the document lacks give no row; a null number is none.

    Each sentence is matched once with its own number, not with each that is wanted; the runs are counted in one order of the
    pages, and only the runs that are wanted are put together.
    """
    bare = lambda c: T.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "<[^>]+>", ""))
    x = sentence.withColumn("bare", bare("src")).withColumn("said", F.when(F.coalesce("tgt", F.lit("")) != "", bare("tgt")).otherwise(F.col("bare")))
    page = W.partitionBy("doc_id", "page_no").orderBy("i")
    ends = F.lag("p").over(page).isNull() | ~F.lag("p").over(page).eqNullSafe(F.col("p"))
    x = x.withColumn("para", F.sum(ends.cast("int")).over(page.rowsBetween(W.unboundedPreceding, 0)))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), head(k, F.col("bare")).alias("head")) for k in _WORDS]))
    x = x.withColumn("k", kinds).select("doc_id", "page_no", "i", "para", "said", "k.kind", "k.head")
    run = F.count("head").over(W.partitionBy("doc_id", "kind", "page_no", "para").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("run", run).where("run > 0")
    h = F.col("head")
    keys = F.array_compact(
        F.array(
            F.when(~h["s"], h["digits"]),  # Figure 3, Supplementary Figure 3: number 3
            F.when(h["s"] | h["before"], F.concat(F.lit("s"), h["digits"])),  # Figure S3, Supplementary Figure 3: number S3
        )
    )
    heads = x.where("head is not null").select("doc_id", "page_no", "i", "para", "kind", "run", F.explode(keys).alias("key"))
    asked = wanted.where("num is not null").select("doc_id", "num", "kind", F.lower(F.col("num").cast("string")).alias("key")).distinct()
    first = asked.join(heads, ["doc_id", "kind", "key"]).groupBy("doc_id", "num", "kind").agg(F.min(F.struct("page_no", "i", "para", "run")).alias("at"))
    first = first.select("doc_id", "num", "kind", "at.page_no", "at.para", "at.run")
    parts = first.join(x, ["doc_id", "kind", "page_no", "para", "run"])
    said = F.array_sort(F.collect_list(F.struct("i", "said")))
    text = F.array_join(F.filter(F.transform(said, lambda z: z["said"]), lambda t: t != ""), " ")
    return parts.groupBy("doc_id", "num", "kind").agg(F.trim(text).alias("legend"))


_LEGEND = r"(?i)(?:supplementary\s+|suppl?\.?\s+|補足\s*|副\s*)?(Fig(?:ure)?s?\.?|Scheme|Table|Tab\.?|図|表)\s*(S?[0-9]+[A-Za-z]?)\s*[.:：]\s*"
_MARK = "\u0001"


def all_legends(block: DataFrame) -> DataFrame:
    """H7: all legends of the blocks of text of a document: rows (doc_id, kind, number, legend), the longest of each number.

    A block (doc_id, b, text) may hold several: each goes up to the next. Numbers are small, without a panel's letter. Of equally long
    texts the first stays, by block and place. A document's blocks are not gathered: candidates are compared as they come.
    """
    marked = F.regexp_replace(F.translate("text", _MARK, " "), f"({_LEGEND})", _MARK + "$1")
    part = block.select("doc_id", "b", F.posexplode(F.split(marked, _MARK)).alias("at", "part")).where("at > 0")
    word, number = F.lower(F.regexp_extract("part", _LEGEND, 1)), F.lower(F.regexp_extract("part", _LEGEND, 2))
    kind = F.when(word.startswith("tab") | (word == "表"), "table").otherwise("figure")
    x = part.select("doc_id", "b", "at", kind.alias("kind"), F.regexp_replace(number, "[a-z]$", "").alias("number"), T.trim(F.col("part")).alias("legend"))
    best = F.min(F.struct((-F.length("legend")).alias("long"), "b", "at", "legend"))
    return x.groupBy("doc_id", "kind", "number").agg(best["legend"].alias("legend"))
