"""One query to each operator, with production parameters, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import chat, langid, manifest, matroska, mixing, near_vectors, ngram_join, packing, spelling, suffix_dedup, token_counts, token_orc
from vellum.llm.common import Scratch
from vellum.llm.substring_dedup import substring_dedup
from vellum.registry import Registry, table

REGISTRY = Registry()


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@REGISTRY.query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
s1 AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s0),
s2 AS (SELECT *, (CAST((SELECT sum(source_size) FROM s1) AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM s1) - coalesce(sum(w) OVER b, 0)) AS level FROM s1
  WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE w * (SELECT level FROM s2 WHERE NOT cap <= level * w ORDER BY cap / w, source NULLS LAST LIMIT 1) END AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM s3),
s5 AS (SELECT *, CAST(least(floor(r), 3) AS BIGINT) AS whole FROM s4),
s6 AS (SELECT *, target - whole * source_size AS lacks FROM s5),
dm AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS m FROM d),
m1 AS (SELECT source, m, CAST(sum(size) AS BIGINT) AS words FROM dm GROUP BY source, m),
m2 AS (SELECT m1.source, m, lacks, coalesce(sum(words) OVER (PARTITION BY m1.source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  sum(words * m) OVER (PARTITION BY m1.source ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM m1 JOIN s6 ON m1.source IS NOT DISTINCT FROM s6.source),
m3 AS (SELECT *, CASE WHEN below > 0 THEN (lacks - CAST(above AS DOUBLE)) / CAST(below AS DOUBLE) ELSE 0.0::DOUBLE END AS c FROM m2),
m4 AS (SELECT *, c * m < 1 AS open FROM m3),
m5 AS (SELECT source, m, CASE WHEN open THEN greatest((SELECT c FROM m4 x WHERE x.open AND x.source IS NOT DISTINCT FROM m4.source ORDER BY m DESC LIMIT 1), 0) * m ELSE 1.0::DOUBLE END AS p FROM m4),
u AS (SELECT dm.doc_id, dm.source, dm.size, source_size, target, whole, p, lacks,
  (CAST(('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM dm JOIN s6 ON dm.source IS NOT DISTINCT FROM s6.source JOIN m5 ON dm.source IS NOT DISTINCT FROM m5.source AND dm.m = m5.m),
q AS (SELECT *, CASE WHEN lacks > 0 THEN CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END END AS q FROM u),
e AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) END AS e FROM q)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN q IS NOT NULL AND e - size < lacks AND (e <= lacks OR e - lacks <= lacks - (e - size)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM e
"""


@REGISTRY.query("op2_source_mix", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@REGISTRY.query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


@REGISTRY.query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(spark, docs)
    return out.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


@REGISTRY.query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return out.select("doc_id", "n_bytes", "n_removed", F.expr("cast(size(removed) / 2 as long)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@REGISTRY.query("op6_token_orc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op6")
    path = scratch.path()
    token_orc.write(table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_orc.positions(spark, path, scratch)


OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (SELECT *, replace(replace(replace(text, '\', '\e'), '[', '\b'), '<', '\l') AS coded, replace(replace(replace(replace(role, '\', '\e'), '[', '\b'), '<', '\l'), chr(10), '\n') AS head,
  coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '^') || '>' || role AS move FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(head) + 1 + length(coded) + 11) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE move NOT IN ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user')) = 0 AND arg_max(role, (turn IS NOT NULL, turn, role, text)) = 'assistant' AS valid,
  CASE arg_max(role, (turn IS NOT NULL, turn, role, text)) WHEN 'system' THEN 'instructed' WHEN 'user' THEN 'asked' WHEN 'assistant' THEN 'answered' ELSE 'other' END AS state,
  count(*) FILTER (WHERE move NOT IN ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user')) AS out_of_order
FROM x GROUP BY conv_id
"""


@REGISTRY.query("op7_chat_format", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = f"values (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') as t(conv_id, turn, role, text)"
    out = Scratch(spark, "op7").keep(chat.format_chats(turns.unionByName(spark.sql(f"select * from {rows}"))))
    text, loss = chat.formatted(F.col("segments")), chat.loss_text(F.col("segments"))
    back = out.select("conv_id", "valid", "state", "out_of_order", text.alias("formatted"), loss.alias("loss")).withColumn("turns", chat.parse(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "state",
        "out_of_order",
    )


@REGISTRY.query("op8_matroska_packets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Scratch(spark, "op8").keep(matroska.media(table(spark, sf_dir, "documents")))

    found = matroska.packets(stored)
    feature = F.concat_ws(";", F.concat(F.lit("packets="), F.size("packets")), F.concat(F.lit("tracks="), F.size(F.array_distinct(F.transform("packets", lambda p: p["track"])))), F.concat(F.lit("last_ns="), F.array_max(F.transform("packets", lambda p: p["ns"]))), F.concat(F.lit("cues="), F.col("cues_hold")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


@REGISTRY.query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def pack_documents(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    cut = packing.pieces(docs, _tokenizer("word_bpe_49k.json"), end_id=2)
    return packing.pack(spark, cut, scratch).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@REGISTRY.query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))


#: A document with more tokens is over the limit.
TOKEN_LIMIT = 512


@REGISTRY.query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = token_counts.prefix_tables(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))
    return token_counts.token_counts(tables, TOKEN_LIMIT).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars", "fit_chars")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lookup of CRC-32 and the checksum of a text of single-byte characters, in DuckDB's terms.
CRC_SQL = """crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([CAST(i AS BIGINT)] || CAST(range(0, 8) AS BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
CRC = "xor(list_reduce([4294967295::BIGINT] || {bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars", text))) + ")"

OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, coalesce('=' || source, '-') AS src, {_LEAF("text")} AS leaf,
  CASE WHEN {CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))")} % 5 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM d),
up AS (SELECT src, 0 AS lvl, r, n, leaf AS h FROM r UNION ALL SELECT src, lvl + 1, r // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY r)) FROM up WHERE n > 1 GROUP BY src, lvl, n, r // 16),
s AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS r, count(*) OVER () AS n, h AS subroot FROM up WHERE n = 1),
top AS (SELECT 100 AS lvl, r, n, subroot AS h FROM s UNION ALL SELECT lvl + 1, r // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY r)) FROM top WHERE n > 1 GROUP BY lvl, n, r // 16),
node AS (SELECT src, lvl, r, h FROM up WHERE n > 1 UNION ALL SELECT src, lvl, top.r, h FROM top, (SELECT DISTINCT src FROM s) WHERE n > 1),
own AS (SELECT DISTINCT r.src, r.r AS doc, node.lvl, CASE WHEN node.lvl < 100 THEN r.r // CAST(pow(16, node.lvl) AS BIGINT) ELSE s.r // CAST(pow(16, node.lvl - 100) AS BIGINT) END AS pos FROM r JOIN s USING (src) JOIN (SELECT DISTINCT src, lvl FROM node) node USING (src)),
beside AS (SELECT own.src, doc, lvl, coalesce(string_agg(h, '' ORDER BY r) FILTER (WHERE r < pos), '') AS l, coalesce(string_agg(h, '' ORDER BY r) FILTER (WHERE r > pos), '') AS rt,
  row_number() OVER (PARTITION BY own.src, doc ORDER BY lvl) AS k FROM own JOIN node USING (src, lvl) WHERE r // 16 = pos // 16 GROUP BY own.src, doc, lvl),
proof AS (SELECT src, doc, sha256(string_agg(l || rt, '' ORDER BY k)) AS proof FROM beside GROUP BY src, doc),
fold AS (SELECT src, r AS doc, 0 AS k, coalesce(tampered, leaf) AS h FROM r UNION ALL SELECT fold.src, fold.doc, fold.k + 1, sha256(l || h || rt) FROM fold JOIN beside ON fold.src = beside.src AND fold.doc = beside.doc AND fold.k + 1 = beside.k),
last AS (SELECT src, doc, arg_max(h, k) AS h FROM fold GROUP BY src, doc)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, last.h AS folded_root, last.h = root AS verified
FROM r JOIN s USING (src) JOIN last ON r.src = last.src AND r.r = last.doc LEFT JOIN proof ON r.src = proof.src AND r.r = proof.doc, (SELECT h AS root FROM top WHERE n = 1)
"""


@REGISTRY.query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: manifest.record(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.translate("text", UPPER, LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(lowered))
    records = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), leaf(F.col("text")).alias("hash"), tampered.alias("rest"))
    out = manifest.manifest(records, Scratch(spark, "op12"))
    root = manifest.folded(F.coalesce("rest", "hash"), F.col("path"))
    out = out.select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
occ AS (SELECT w, CASE WHEN h % 97 = 0 THEN h % length(w) END AS k FROM (SELECT w, {CRC.format(bytes="flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) - 64 AS BIGINT)] END))")} AS h
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS w FROM documents), crc WHERE length(w) >= 5)),
word AS (SELECT w, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN w ELSE w[:k] || w[k + 2:] END AS w FROM occ) WHERE length(w) >= 5 GROUP BY w HAVING count(*) >= 3),
hole AS (SELECT w, n, i, w[:i - 1] AS l, w[i + 1:] AS r FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM word)),
less AS (SELECT DISTINCT w, n, l || r AS s FROM hole),
pair AS (SELECT a.w, a.n, b.w AS near, b.n AS near_n FROM hole a JOIN hole b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.w <> b.w
  UNION ALL SELECT less.w, less.n, word.w, word.n FROM less JOIN word ON s = word.w UNION ALL SELECT word.w, word.n, less.w, less.n FROM less JOIN word ON s = word.w),
best AS (SELECT w, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pair GROUP BY w),
f AS (SELECT word.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM word LEFT JOIN best USING (w)),
walk AS (SELECT w, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.w, f.form FROM walk JOIN f ON walk.at = f.w WHERE f.form IS NOT NULL),
root AS (SELECT walk.w, walk.at FROM walk JOIN f ON walk.at = f.w WHERE f.form IS NULL)
SELECT f.w AS word, form, coalesce(root.at, f.w) AS root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f LEFT JOIN root USING (w)
"""


@REGISTRY.query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id counts as one whose id is the empty text."""
    scratch = Scratch(spark, "op13")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]+"), F.lit(0))).alias("run"))
    runs = docs.where(F.length("run") >= 5).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")))
    gone = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % 97 == 0, F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))).otherwise(F.col("run"))
    return spelling.variants(spelling.word_counts(runs.select(word.alias("word")), 5, 3), scratch)


def queries() -> dict:
    return dict(REGISTRY.queries)


def oracle_sql() -> dict[str, str]:
    return dict(REGISTRY.oracles)
