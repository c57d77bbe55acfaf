"""The pipeline's rows against plain Python (and op2's SQL), stage by stage and as a whole; hard inputs for each stage."""

import random
import zlib
from collections import Counter

import corpus_pipeline as P
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellum.llm import langid
from vellum.llm.queries import OP2_SQL

KIND = "doc_id long, text string, lang string, source string, n_chars long"
FLAVOUR = {"en": ["the", "of", "and", "with", "house"], "de": ["der", "und", "nicht", "haus", "ß"], "fr": ["le", "et", "avec", "maison", "é"]}


def corpus(seed=11):
    """Three languages, copies, near copies, shared passages of 13 and more words, junk, nulls, a long text, several sources."""
    r = random.Random(seed)
    word = lambda la: r.choice(FLAVOUR[la]) + "".join(r.choices("abcdefgh" if la == "en" else "klmnopqr" if la == "de" else "stuvwxyz", k=r.randint(0, 4)))
    passage = {la: " ".join(word(la) for _ in range(30)) for la in FLAVOUR}
    rows = [(0, None, "en", "x", None), (1, "", "de", None, 0), (2, "1234 --- 5678", "en", "x", 13), (3, " \n ", "fr", "y", 3), (4, "zz", "en", "y", 2)]
    for i in range(90):
        la = r.choice(list(FLAVOUR))
        words = [word(la) for _ in range(r.choice([3, 20, 60, 150]))]
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[la].split()
        text = " ".join(words)
        rows.append((10 + 2 * i, text, None if i % 11 == 0 else la, r.choice(["a", "a", "b", "c", None]), len(text)))
        if i % 7 == 0:
            rows.append((500 + i, text.replace(" ", "  ", 3), la, "b", len(text)))
        if i % 9 == 0 and len(words) > 100:
            rows.append((700 + i, " ".join(["changed", *words]), la, "c", len(text)))
    rows.append((999, " ".join(word("en") for _ in range(9000)), "en", "a", 1))
    r.shuffle(rows)
    return rows


# --------------------------------------------------------------------------- plain forms of the stages


def known_language(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    n = {}
    for i, t, la, *_ in rows:
        if not held(i) and la is not None and t is not None:
            n.setdefault(la, np.full(langid.BUCKETS, 0.5))
            np.add.at(n[la], langid.features([t])[0].ravel(), 1)
    logp = {la: np.log(c / c.sum()).astype(np.float32) for la, c in n.items()}

    def stays(t):
        if t is None or not any(c.isalpha() for c in t):
            return False
        f = langid.features([t])[0].ravel()
        total = [float(p[f].astype(np.float64).sum()) for p in logp.values()]
        return 1 / sum(np.exp(x - max(total)) for x in total) >= P.LEAST_SCORE

    return [r for r in rows if stays(r[1])]


def one_of_each_group(rows):
    sets, to = [], list(range(len(rows)))
    for r in rows:
        w = "".join(c.lower() if c.isascii() else c for c in r[1] or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))

    def root(k):
        while to[k] != k:
            k = to[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                to[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def without_repeated_passages(rows):
    first, out = {}, []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            x = tuple(w[k : k + 13])
            first[x] = min(first.get(x, i), i)
    for i, t, la, so, n in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        if not gone.any():
            out.append((i, t, la, so, n))
        elif kept:
            out.append((i, kept, la, so, len(kept)))
    return out


def mixed(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    copies = dict(con.sql(OP2_SQL.replace("* size AS BIGINT) AS taken", "AS BIGINT) AS copies").replace("SELECT doc_id, size, source_size, target,", "SELECT doc_id,")).fetchall())
    return [r for r in rows for _ in range(copies[r[0]])]


def packed(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    out = []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        out += [(r[0], s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    return out


def documents(rows):
    return Counter(tuple(r)[:5] for r in rows)


def check_packing(got, want):
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    filled = sum(r.length for r in got)
    assert len(at) <= filled / 4096 * 1.3 + 2


def test_every_stage_and_the_whole(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = [known_language, one_of_each_group, without_repeated_passages, mixed]
    lost = 0
    for k, ((_, stage), brute) in enumerate(zip(P.STAGES[:-1], plain, strict=True)):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got, rows = docs.select(*P.COLUMNS).collect(), brute(rows)
        assert documents(got) == documents(rows), P.STAGES[k][0]
        assert set(P.COLUMNS) <= set(docs.columns)
        lost += len(rows) != len(corpus())
    assert lost == len(plain)  # each of them did something
    check_packing(P.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), packed(rows))
    check_packing(P.run(spark, str(tmp_path)).collect(), packed(rows))


HARD = {
    "empty table": [],
    "null texts": [(1, None, "en", "a", None), (2, None, None, None, None), (None, None, "en", "a", 0)],
    "a very long text": [(1, "the long house and the end " * 40_000, "en", "a", 1), (2, "the house", "en", "a", 9), (3, "the house", "de", None, 9), (None, "the house", "en", "b", 9)],
}


@pytest.mark.parametrize("case", HARD)
@pytest.mark.parametrize("k", range(5))
def test_hard_inputs(spark, case, k):
    """Each stage on inputs of its own, with columns that no stage knows and whose names it uses itself."""
    docs = spark.createDataFrame([(*r, 7, "x", 1.5) for r in HARD[case]], f"{KIND}, class int, rank string, copies double")
    out = P.STAGES[k][1](spark, docs, "").collect()
    rows = HARD[case]
    if k == 0:
        assert documents(out) == documents([r for r in rows if r[1]])
    elif k == 1:  # the three short texts are one group, of which the smallest id stays
        assert documents(out) == documents([r for r in rows if r[1] is None or r[0] in (1, 2)])
    elif k == 2:  # a null text comes back empty
        assert documents(out) == documents([(i, t or "", *more) for i, t, *more in rows])
    elif k == 3:
        assert not rows or {r.doc_id for r in out} <= {r[0] for r in rows}
    else:
        assert sum(r.start == 0 for r in out) == len(rows)
        check_packing(out, packed(rows))
