"""The operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import chat, common, langid, matroska, mixing, near_vectors, ngram_join, packing, suffix_dedup, token_orc
from vellum.llm.common import Scratch
from vellum.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, id string, label string"


def corpus(seed=7):
    """Shared passages, exact and near copies, blanks, nulls, a long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = text(90)
    texts = [None, "", " \n\t ", "one", "One", "a b c d", " ", text(12), text(13)]
    for i in range(40):
        t = text(r.randint(5, 160))
        texts.append(t)
        if i % 3 == 0:
            texts.append(t)
        if i % 2 == 0:
            words = t.split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = "changed"
            texts.append("  ".join(words))
        if i % 4 == 0:
            texts.append(f"{text(20)}\n{passage} {text(r.randint(0, 30))}")
    texts += [text(6000), "ab" * 900, "x" * 1300, passage + " " + passage]
    r.shuffle(texts)
    return [(i * 3 + 5, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 1, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def scratch(spark):
    return Scratch(spark, "test")


def brute_windows(rows):
    first, out = {}, {}
    for i, t, *_ in sorted(rows):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        mine = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        for k, x in enumerate(mine):
            if x in first:
                gone[k : k + 13] = True
        for x in mine:
            first.setdefault(x, i)
        out[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def test_substring_dedup(docs, rows, empty):
    want = brute_windows(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs).collect()}
    assert got == want and any(n for _, n, _ in want.values())
    many = substring_dedup(docs, block_chars=3_000, range_chars=200)  # most pairs of a block and a range have no hash
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in many.collect()} == want
    assert substring_dedup(empty).count() == 0
    same = {r.doc_id: r.kept for r in substring_dedup(docs, keep_unchanged=True).where("n_removed = 0").collect()}
    assert all(same[i] == (t or "") for i, t, *_ in rows if i in same)


def test_substring_dedup_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (9, t)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup(df).collect()) == [(False, 4, 0), (False, 4, 0), (False, 9, 30), (True, 0, 0)]


def brute_components(rows):
    tr = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(tr).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("short", [48, 1])
def test_ngram_join(spark, docs, rows, empty, monkeypatch, short):
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    monkeypatch.setattr(ngram_join, "TILE", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, scratch(spark)).collect()}
    assert got == brute_components(rows)
    assert ngram_join.ngram_components(empty, scratch(spark)).count() == 0


def test_ngram_join_family_without_a_centre(spark, monkeypatch):
    """A chain of versions: neighbours are similar, ends are not, and all share their rare words' lists."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 2)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for v in range(12):
        w = list(base)
        for k in range(v):
            w[k * 9 + 4] = f"z{k}"
        rows.append((100 - v, " ".join(w), None, None, 0, 0, "", ""))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, scratch(spark)).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) == 1


def brute_bytes(rows, n=400):
    count, text = collections.Counter(), {i: (t or "").encode() for i, t, *_ in rows}
    for t in text.values():
        count.update(t[k : k + n] for k in range(len(t) - n + 1))
    out = {}
    for i, t in text.items():
        step = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                step[k] += 1
                step[k + n] -= 1
        gone = np.cumsum(step[:-1]) > 0
        out[i] = (len(t), int(gone.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("most,chunk", [(20_000, 1 << 19), (1, 700)])
def test_suffix_dedup(spark, docs, rows, empty, monkeypatch, most, chunk):
    monkeypatch.setattr(suffix_dedup, "MOST_SORTED", most)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    want = brute_bytes(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, scratch(spark)).collect()}
    assert got == want and sum(n > 0 for _, n, _ in want.values()) > 5
    assert suffix_dedup.suffix_dedup(empty, scratch(spark)).count() == 0


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup_line_that_comes_again_nearby(spark, monkeypatch, most):
    """Each of a line's places lists the strings that hold both; those start at one place only and stay."""
    monkeypatch.setattr(suffix_dedup, "MOST_SORTED", most)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, tail = text(70), text(450)
    rows = [(1, text(300) + line + text(30) + line + text(300)), (2, text(200) + line + text(90) + line + text(50) + line + text(200)), (3, text(100) + line * 9), (4, text(90) + line + text(20) + line + tail), (5, line + tail)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, bytes(x.kept)) for x in suffix_dedup.suffix_dedup(df, scratch(spark)).collect()}
    assert got == brute_bytes(rows) and [got[i][1] for i in sorted(got)] == [0, 0, 630, 520, 520]


def test_suffix_sort_is_a_sort():
    r = random.Random(3)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(200)]
    group = np.sort(np.array([r.randrange(9) for _ in strings]))
    group = np.unique(group, return_inverse=True)[1]
    order = suffix_dedup._Suffixes(strings).sort(group)
    assert [strings[i] for i in order] == [s for _, s in sorted(zip(group.tolist(), strings, strict=True))]


def test_suffix_dedup_shared_ids(spark):
    t = "0123456789" * 60
    df = spark.createDataFrame([(1, t), (1, "q" + t), (None, "short")], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.suffix_dedup(df, scratch(spark)).collect()) == [0, 600, 600]


def test_mix(spark, docs, rows, empty):
    got = mixing.mix(docs, scratch(spark)).collect()
    assert len(got) == len(rows) and mixing.mix(empty, scratch(spark)).count() == 0
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 3 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
        assert v[0].target <= 3 * v[0].source_size + 1e-9
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5), scratch(spark)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(df, scratch(spark)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_language_id(spark, empty):
    words = {"en": "the and that with for this", "fr": "le la les une dans avec", "de": "der und nicht mit eine für"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(words[la].split()) for _ in range(20)), la) for i, la in enumerate(list(words) * 60)]
    rows += [(1000, None, "en"), (1001, "12 34 !", "en"), (1002, "", None), (None, "the that", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(spark, df).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.doc_id is not None and x.doc_id < 1000 and zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert len(held) > 30 and all(x.lang == x.lang_pred and 0 <= x.score <= 1 for x in held)
    assert {x.doc_id: (x.lang_pred, x.score) for x in got if x.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), ("und", 0.0))
    assert {x.lang_pred for x in langid.identify(spark, df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(spark, empty).count() == 0


def test_features_do_not_cross_texts():
    a, n = langid.features(["ab", "c", "déf"])
    b = [langid.features([t])[0] for t in ("ab", "c", "déf")]
    at = np.concatenate([[0], np.cumsum(n)])
    assert all((a[at[i] : at[i] + len(x)] == x).all() for i, x in enumerate(b))


def ids_of(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    r = random.Random(2)
    parts = [*"aB zZ..,,''\"  \n\t\r12½²٣éÉßçñ́ж中文　-_$", "'s", "'ll", " '", "foo", "<|endoftext|>", "</s>", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    ids, n = common.Encoder(public_tokenizers.path(name), most=500).encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    want = ids_of(name, texts, 0)
    assert all(ids[at[i] : at[i + 1]].tolist() == w[:-1] for i, w in enumerate(want))


def test_token_orc(spark, docs, rows, empty, monkeypatch, tmp_path):
    monkeypatch.setattr(token_orc, "FILE_ROWS", 20)
    path = f"{tmp_path}/ids"
    token_orc.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_orc.positions(spark, path, scratch(spark)).collect()}
    at, want = 0, {}
    ordered = sorted(rows)
    for r, ids in zip(ordered, ids_of("byte_bpe_50k.json", [r[1] for r in ordered], 0), strict=True):
        want[r[0]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    one = ordered[3][0]
    assert token_orc.read(spark, path).where(F.col("doc_id") == one).count() == 1
    token_orc.write(empty, f"{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_orc.positions(spark, f"{tmp_path}/none", scratch(spark)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("texts", [["\u3000"], ["\u2003\u2003", ""], ["", "\u00a0"], ["\0"], ["\u3000", "some words", "\u3000x"]])
def test_encoder_of_wide_white_space(name, texts):
    ids, n = common.Encoder(public_tokenizers.path(name)).encode(texts)
    want = ids_of(name, texts, 7)
    assert n.tolist() == [len(x) - 1 for x in want] and ids.tolist() == [i for x in want for i in list(x)[:-1]]


def test_packing(spark, docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(spark, packing.pieces(docs, path, 2), scratch(spark)).collect()
    ids = dict(zip([r[0] for r in rows], ids_of("word_bpe_49k.json", [r[1] for r in rows], 2), strict=True))
    parts, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert sum(n for _, n in parts[i]) == len(x) and [s for s, _ in sorted(parts[i])] == list(np.cumsum([0] + [n for _, n in sorted(parts[i])])[:-1])
    for x in sequences.values():
        assert [s for s, _ in sorted(x)] == list(np.cumsum([0] + [n for _, n in sorted(x)])[:-1]) and sum(n for _, n in x) <= 4096
    assert packing.pack(spark, packing.pieces(empty, path, 2), scratch(spark)).count() == 0


def test_plan_holds_the_demand():
    r = np.random.default_rng(4)
    for _ in range(5):
        demand = np.where(r.random(64) < 0.5, r.integers(0, 200, 64), 0)
        chosen = packing.plan(demand)
        assert (sum(p * n for p, n in chosen) >= demand).all() and all(p @ np.arange(1, 65) <= 64 for p, _ in chosen)
        free: list[int] = []  # first fit by decreasing length
        for item in sorted(np.repeat(np.arange(1, 65), demand), reverse=True):
            k = next((k for k, f in enumerate(free) if f >= item), len(free))
            free[k : k + 1] = [(free[k] if k < len(free) else 64) - item]
        used = sum(n for _, n in chosen)
        assert used <= len(free) and used <= packing.solve(demand)[1].sum() + 4
    assert packing.plan(np.zeros(64, int)) == []


def test_chat(spark):
    turns = [
        (1, 0, "system", "be <|im_end|>\nkind\\"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] ok [/INST]\\l\n"),
        (2, 0, "assistant", "first"), (3, None, None, "a"), (3, 1, "odd\nrole<", ""), (-1, 1, "user", "x"), (-1, 1, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumn("formatted", chat.formatted(F.col("segments")))
    got = {r.conv_id: r for r in out.select("conv_id", "valid", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for c in got:
        want = [(r or "", t or "") for i, k, r, t in sorted(turns, key=lambda x: (x[1] is not None, x[1], x[2] or "")) if i == c]
        assert [tuple(x) for x in got[c].turns] == want
        assert got[c].loss == "".join(t for r, t in want if r == "assistant")
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, -1: False}
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_matroska_lacing(lacing):
    sizes = [300] * 4 if lacing == 2 else [300, 255, 600, 40]
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    body = matroska.element(matroska.CLUSTER, matroska.element(matroska.TIMESTAMP, b"\x05") + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, matroska.block(3, 7, frames, lacing, 0))))
    data = matroska._HEADER + matroska.number(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + body  # a segment of unknown size
    packets, said = matroska.parse(data)
    assert [data[s:e] for _, _, s, e in packets] == frames and {t for t, *_ in packets} == {3}
    assert packets[0][1] == 12_000_000 and said["clusters"] == [0]


def test_matroska_round_trip(spark, docs, rows, empty):
    got = {r.doc_id: r for r in matroska.packets(matroska.media(docs)).collect()}
    for i, t, *_ in rows:
        want = matroska.padded(t)
        r = got[i]
        assert bytes(r.payload) == want and r.n_bytes == len((t or "").encode()) and r.cues_hold
        assert [p.ns for p in r.packets] == [12_000_000 * k for k in range(len(want) // 576)]
        assert hashlib.sha256(bytes(r.media)).digest() == hashlib.sha256(matroska.mux(want)).digest()
    assert matroska.packets(matroska.media(empty)).count() == 0


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "TILE", 3)
    r = np.random.default_rng(6)
    centre = r.standard_normal((30, 16))
    x = [(c + 0.05 * r.standard_normal(16)).tolist() for c in centre for _ in range(4)]
    rows = [(i, v, None if i % 17 == 0 else i % 2) for i, v in enumerate(x)]
    rows += [(200, x[1], 1), (201, [2 * a for a in x[1]], 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] + x[1][1:], 1), (205, [None] + x[1][1:], 1), (206, x[1][:8], 1), (207, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usable = {i: (np.array(v) / np.linalg.norm(v), la) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    link = {i: {j for j in usable if j != i and usable[i][1] == usable[j][1] and len(usable[i][0]) == len(usable[j][0]) and usable[i][0] @ usable[j][0] >= 0.98} for i in usable}
    comp = {i: i for i, *_ in rows}
    for _ in rows:
        comp = {i: min([comp[i], *(comp[j] for j in link.get(i, ()))]) for i in comp}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df, scratch(spark)).collect()}
    assert got == {i: (len(link.get(i, ())), comp[i], comp[i] == i) for i in comp} and any(link.values())
    assert near_vectors.near_vectors(df.limit(0), scratch(spark)).count() == 0


def test_packing_keeps_all_columns(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i % 3, "some words " * i) for i in range(9)], "doc_id long, text string")
    cut = packing.pieces(docs, path, 2).withColumns({c: F.lit(f"own {c}") for c in ("class", "rank", "part", "before", "place", "n", "other one", "offset", "sequence_id", "class_")})
    got = packing.pack(spark, cut, scratch(spark))
    assert sorted(got.columns) == sorted(cut.columns) and got.count() == 9
    assert all(r[c] == f"own {c}" for r in got.collect() for c in ("class", "rank", "part", "before", "place", "n", "other one", "class_"))
    assert dict(got.dtypes)["offset"] == dict(got.dtypes)["sequence_id"] == "bigint"


def test_more_languages_than_a_model_holds(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choices(chr(97 + la) + chr(98 + la) + "xyz", k=5)) for _ in range(20)), f"l{la:02d}") for i, la in enumerate(r.choices(range(23), k=240))] + [(900, None, "l01"), (901, "123", "l02")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_so_far", F.lit("mine"))
    one = {x.doc_id: (x.lang_pred, x.score, x.lang_so_far) for x in langid.identify(spark, docs).collect()}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 5)
    many = {x.doc_id: (x.lang_pred, x.score, x.lang_so_far) for x in langid.identify(spark, docs).collect()}
    assert one.keys() == many.keys() and all(a[0] == many[i][0] and a[2] == many[i][2] and abs(a[1] - many[i][1]) < 1e-9 for i, a in one.items())
    assert many[900][:2] == many[901][:2] == ("und", 0.0) and len({a for a, *_ in many.values()}) > 15


def test_files_of_one_id(spark):
    """All rows have one id, or none: they fill several files, and positions go on from file to file."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"text number {i} " * (i % 7) for i in range(400)]
    docs = spark.createDataFrame([(5 if i % 2 else None, t) for i, t in enumerate(texts)] + [(1, "first"), (9, "last")], "doc_id long, text string")
    made = common.Scratch(spark, "t").path()
    old, token_orc.FILE_ROWS = token_orc.FILE_ROWS, 40
    try:
        token_orc.write(docs, made, path)
    finally:
        token_orc.FILE_ROWS = old
    assert token_orc.read(spark, made).select("file").distinct().count() > 6
    got = sorted(token_orc.positions(spark, made, scratch(spark)).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == [None] * 200 + [1] + [5] * 200 + [9]
    lib = Tokenizer.from_file(path)
    assert collections.Counter(r.n_tokens for r in got) == collections.Counter(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in [*texts, "first", "last"])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges, scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}
