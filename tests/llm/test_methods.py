"""What each method promises beyond its result: chances, states, whole texts, broken files, and every query against its SQL."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import llm
from vellum.llm import chat, common, langid, matroska, mixing, near_vectors, ngram_join, token_orc
from vellum.llm.common import Scratch

DATA = "/root/testdata/sf0.001"


def test_word_hashes_are_of_words(monkeypatch):
    monkeypatch.setattr(common, "_GROUP", 2_000)
    r = random.Random(5)
    texts = [b"", b" \t", *(bytes(r.choice(b"abcde \n\x0b\x0c") for _ in range(r.choice([3, 50, 900, 7_000]))) for _ in range(100)), b"x" * 5_000 + b" y"]
    hashes, n = common.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    seen: dict[bytes, int] = {}
    assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)


# --------------------------------------------------------------------------- mixing


def test_mix_inclusion_follows_the_chances(spark):
    """Over 200 seeds the share of runs that take a document is its inclusion probability, which grows with its size."""
    r = random.Random(8)
    rows = [(i, "w " * r.choice([1, 3, 20, 150]), "a" if i % 3 else "b") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    seeds = spark.range(200).select(F.col("id").alias("run"))
    sizes = docs.select("doc_id", F.concat("source", F.lit("|")).alias("s"), "text").crossJoin(F.broadcast(seeds))
    # one source per seed: the key of the random number holds the seed
    many = sizes.select((F.col("doc_id") * 1000 + F.col("run")).alias("doc_id"), F.concat("s", F.col("run")).alias("source"), "text")
    out = mixing.mix(many, Scratch(spark, "t"), weights=(1.0,), share=0.4).where("p is not null").collect()
    took, chance = collections.Counter(), {}
    for x in out:
        took[x.doc_id // 1000] += x.copies
        chance[x.doc_id // 1000] = x.p
    assert len({round(p, 6) for p in chance.values()}) > 4
    assert all(abs(took[i] / 200 - p) < 5 * math.sqrt(max(p * (1 - p), 0.01) / 200) for i, p in chance.items())


def test_mix_takes_sure_documents_first(spark):
    rows = [(1, "w " * 4000, "a"), *((i, "w", "a") for i in range(2, 40)), *((100 + i, "w " * 3900, "b") for i in range(4))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix(df, Scratch(spark, "t"), weights=(1.0, 3.9)).collect()}
    assert out[1].p == 1.0 and out[1].copies == out[1].taken // out[1].size
    assert all(r.taken <= 3 * r.size for r in out.values())


# --------------------------------------------------------------------------- chat


def test_machine_decides_state_and_loss(spark):
    turns = [(c, k, role, f"{c}-{k}") for c, roles in {1: ["system", "user", "assistant", "user", "assistant"], 2: ["assistant", "user", "assistant"], 3: ["user", "user", "assistant"], 4: ["user", "tool", "assistant"], 5: ["user"]}.items() for k, role in enumerate(roles)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.state, r.out_of_order) for r in chat.format_chats(df).collect()}
    assert got == {1: (True, "answered", 0), 2: (False, "answered", 1), 3: (False, "answered", 1), 4: (False, "answered", 2), 5: (False, "asked", 0)}
    # another machine, other segments: only the answer to a second question bears the loss
    t = chat.Template(moves={("start", "user"): "first", ("first", "assistant"): "warm", ("warm", "user"): "second", ("second", "assistant"): "scored"}, entry={}, learn=("scored",), final=("scored",))
    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], str(k)) for k in range(5)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df, t).select("valid", "state", chat.loss_text(F.col("segments"), t).alias("loss")).first()
    assert (r.valid, r.state, r.loss) == (False, "other", "3")


def test_long_conversation(spark):
    df = spark.range(3000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "'t' text")
    r = chat.format_chats(df).select("valid", F.size("segments").alias("n")).first()
    assert (r.valid, r.n) == (True, 9000)


# --------------------------------------------------------------------------- language ID


def brute_bayes(rows, smoothing=0.5):
    """Multinomial naive Bayes with dictionaries, on the same hashed n-grams of 1 to 3 characters."""

    def grams(text):
        t = [ord(c) for c in text.lower()] + [10, 10, 10]
        for i in range(len(text.lower()) + 1):
            for order in langid.ORDERS:
                h = t[i] if i < len(t) else 10
                for j in range(1, order):
                    h = (h * 0x9E3779B1 + t[i + j]) & 0xFFFFFFFF
                h = ((h + order * 0x85EBCA6B) * 0xC2B2AE35) & 0xFFFFFFFF
                yield h >> (32 - langid.BITS)

    count: dict[str, collections.Counter] = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            count[lang].update(grams(text))
    out = {}
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            out[i] = ("und", 0.0)
            continue
        mine = collections.Counter(grams(text))
        sums = {la: math.fsum(n * float(np.float32(math.log((c[b] + smoothing) / (c.total() + smoothing * langid.BUCKETS)))) for b, n in mine.items()) for la, c in count.items()}
        best = min(sums, key=lambda la: (-sums[la], la))
        out[i] = (best, 1 / math.fsum(math.exp(s - sums[best]) for s in sums.values()))
    return out


@pytest.mark.parametrize("piece,cells", [(500_000, 1 << 22), (40, 64)])
def test_language_id_is_naive_bayes(spark, monkeypatch, piece, cells):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "CELLS", cells)
    r = random.Random(12)
    letters = {"en": "etaoinshr", "fr": "esaitnrué", "de": "enisratdü"}
    rows = [(i, " ".join("".join(r.choice(letters[la]) for _ in range(r.randint(1, 7))) for _ in range(r.choice([1, 2, 30, 200]))), la) for i, la in enumerate([*letters] * 25)]
    rows += [(500, None, "en"), (501, "12", "fr"), (502, "İstanbul ǅ", None), (503, "e", None), (504, "a\n\nb\n\n\nc", "de")]
    df = spark.createDataFrame([(*x, "clash", 2.0) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(2)
    got = {x.doc_id: x for x in langid.identify(spark, df).collect()}
    want = brute_bayes(rows)
    assert set(got) == set(want)
    for i, (lang, score) in want.items():
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-6, i


def test_language_id_is_right_on_held_out_rows(spark):
    out = llm.queries()["op4_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


# --------------------------------------------------------------------------- media


def test_packets_of_broken_files(spark):
    good = matroska.mux(matroska.padded("a text"))
    cases = [good, None, b"", b"\x00\x00", good[:50], good[:-700], good[: len(good) - 3], bytes(range(256))]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "clash") for i, x in enumerate(cases)], "doc_id long, media binary, error string")
    got = {r.doc_id: r for r in matroska.packets(df).collect()}
    assert len(got) == len(cases) and got[0].error is None and len(got[0].packets) == 1
    assert got[1].error == "no file" and got[2].error is None and got[2].packets == []
    for i in range(3, len(cases)):
        assert got[i].error and got[i].packets is None and got[i].payload is None and got[i].cues_hold is None


# --------------------------------------------------------------------------- other cases


def test_token_orc_with_repeated_and_null_ids(spark, tmp_path):
    import public_tokenizers

    rows = [(5, "b b"), (5, "a"), (5, "b b"), (None, "x y z"), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_orc.write(df, f"{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    back = token_orc.read(spark, f"{tmp_path}/ids").collect()
    at, want = 0, []
    for r in sorted(back, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.row)):
        want.append((r.doc_id, at, len(r.ids)))
        at += len(r.ids)
    got = [(r.doc_id, r.start, r.n_tokens) for r in token_orc.positions(spark, f"{tmp_path}/ids", Scratch(spark, "t")).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_near_vectors_in_tiles_and_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "TILE", 2)
    r = np.random.default_rng(3)
    centre = r.standard_normal(8)
    x = [(centre + s * r.standard_normal(8)).tolist() for s in (0.01, 0.02, 0.05, 0.1, 0.2) for _ in range(12)]
    df = spark.createDataFrame([(i, v, "l", 1, 2, 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string, block int, side int, copies int")
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    want = {i: int((u[i] @ u.T >= 0.98).sum()) - 1 for i in range(len(x))}
    assert {k.vec_id: k.n_links for k in near_vectors.near_vectors(df, Scratch(spark, "t")).collect()} == want


def test_ngram_tiles_across_size_bands(spark, monkeypatch):
    """Versions of growing length share a list; only those within a fifth in size link."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 1)
    monkeypatch.setattr(ngram_join, "TILE", 3)
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[:n])) for k, n in enumerate([40, 44, 48, 70, 84, 85, 120, 180, 200, 210, 300, 390])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    comp = {i: i for i in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df, Scratch(spark, "t")).collect()}
    assert got == comp


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_root(Session)


# --------------------------------------------------------------------------- every query

NAMES = sorted(llm.queries(), key=lambda n: int(n[2:].split("_")[0]))


def norm(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = llm.queries()[name](spark, DATA)
    got = [{c: norm(v) for c, v in r.asDict().items()} for r in df.collect()]
    assert got
    if name not in llm.oracle_sql():
        return
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(llm.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert set(cols) == set(df.columns)
    want = [dict(zip(cols, map(norm, r), strict=True)) for r in cur.fetchall()]
    key = lambda r: tuple(str(r[c]) for c in sorted(cols))
    assert sorted(got, key=key) == sorted(want, key=key)
