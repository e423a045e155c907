"""The queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm import ball_trees, chat, matroska, merkle, mixing, packing, pii, quality, simhash, substring_dedup, token_files, toxicity, word_scoring
from phonolith.llm.store import gone_at_exit, shared_dir

#: The schema that the calls made of conversations are checked against.
REPLY_SCHEMA = [("reply", "size", "integer", True), ("reply", "number", "integer", True), ("reply", "text", "string", True), ("reply", "context", "object", False)]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeated_spans(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_of_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = spark.createDataFrame(REPLY_SCHEMA, "name string, parameter string, type string, required boolean")
    linked = chat.link_all(calls, results, schemas)
    return linked.select("conv_id", "call_id", "turn", "level", "status", F.array_join("errors", ", ").alias("errors"), "canonical")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = quality.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return held.select("doc_id", *(f"quality.{m}" for m in base), (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.V1).alias("kept"), F.col("quality.failures").alias("failures"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/phonolith/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), path, tokenizer("word_bpe_49k.json"), end_id=1)
    gone_at_exit(spark, path)
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["by_pattern"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = matroska.read_media(matroska.mux_texts(documents(spark, sf_dir)))
    tail = F.substring("payload", -16, 16)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target model is of the documents labelled as good and not toxic, the background model of all documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    # labels grow with the documents, so they are never broadcast
    docs = documents(spark, sf_dir).select("doc_id", "text").join(labels.withColumn("good", F.lit(True)).hint("shuffle_hash"), "doc_id", "left")
    text_bytes = documents(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0]
    return word_scoring.word_cross_entropy_difference(docs, "good", text_bytes=text_bytes)


def _remainder(n: int):
    """Remainder of the CRC-32 of the decimal doc_id; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(5) != 0).select("doc_id", "toxic")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    score = F.col("toxicity.score")
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(_remainder(2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proven = merkle.manifest(documents(spark, sf_dir), "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": tampered})
    return proven.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, centroids = ball_trees.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    named = ball_trees.by_centroid(centroids, lambda own: hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
    return ball_trees.with_inertia(clustered).withColumn("centroid_sha256", named)


QUERIES = {q.__name__: q for q in (op1_substring_dedup, op2_chat_formatting, op3_quality_rules, op4_simhash_near_dedup, op5_token_files, op6_source_mixing, op7_pii, op8_media_columns, op9_packing, op10_lm_scoring, op11_toxicity, op12_merkle_manifest, op13_centroid_clustering)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_FIELD = "coalesce(strlen(({0})::VARCHAR) || ':' || ({0}), '-')"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))


def _cluster_round(k: int) -> str:
    """Assignment a{k} to the centroids c{k}, and the centroids after it."""
    assigned = f"""a{k} AS (SELECT r, vec_id, p, c, d FROM (SELECT r, vec_id, p, c, list_sum(list_transform(list_zip(p, q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, c{k}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),"""
    moved = f"""s{k} AS (SELECT c, list(m ORDER BY j) AS q FROM (SELECT c, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT c, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM a{k}) GROUP BY c, j) GROUP BY c),
c{k + 1} AS (SELECT c, coalesce(s{k}.q, c{k}.q) AS q FROM c{k} LEFT JOIN s{k} USING (c)),"""
    return assigned + "\n" + (moved if k < 3 else "")


_CLUSTER_ROUNDS = "\n".join(_cluster_round(k) for k in range(4))

ORACLE_SQL = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, len({_WORDS}) AS n, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM documents),
g AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM w),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM g WHERE i + 12 <= n),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM m, range(13) r(k) WHERE m < doc_id),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone.i IS NOT NULL) AS r, string_agg(word, ' ' ORDER BY i) FILTER (gone.i IS NULL) AS kept FROM w LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)""",
    "op2_chat_formatting": r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS size FROM conversations),
u AS (SELECT * FROM t WHERE role = 'user'), e AS (SELECT conv_id, turn, min(size) AS size FROM u GROUP BY ALL),
k AS (SELECT conv_id, turn, size, CASE WHEN size % 23 = 6 THEN 0 ELSE turn END AS named, conv_id || ':' || CASE WHEN named % 4 = 2 THEN '"' || named || '"\' ELSE named::VARCHAR END AS id
  FROM (SELECT conv_id, turn, size FROM e UNION SELECT conv_id, turn, size FROM u UNION SELECT a.conv_id, a.turn - 1, 0 FROM t a LEFT JOIN e ON e.conv_id = a.conv_id AND e.turn = a.turn - 1 WHERE a.role = 'assistant' AND e.turn IS NULL)),
c AS (SELECT u.*, k.id, CASE WHEN u.size % 17 = 4 THEN k.id ELSE h.id END AS ref, CASE WHEN u.size % 11 = 3 THEN 'answer' ELSE 'reply' END AS name FROM u JOIN k USING (conv_id, turn, size)
  LEFT JOIN e ON e.conv_id = u.conv_id AND u.turn > 0 AND e.turn = u.turn // 2 LEFT JOIN k h ON h.conv_id = e.conv_id AND h.turn = e.turn AND h.size = e.size),
f AS (SELECT *, '{' || CASE WHEN ref IS NULL THEN '' ELSE '"context":{"$ref":' || to_json(ref) || '},' END || CASE WHEN size % 5 = 1 THEN '"note":true,' ELSE '' END
  || '"number":' || CASE WHEN size % 7 = 2 THEN '"' || turn || '"' ELSE turn::VARCHAR END || ',"size":' || size || CASE WHEN size % 13 = 5 THEN '' ELSE ',"text":' || to_json(text) END || '}' AS arguments,
  CASE WHEN name = 'answer' THEN 'no schema' ELSE concat_ws(', ', CASE WHEN size % 7 = 2 THEN 'not integer number' END, CASE WHEN size % 13 = 5 THEN 'missing text' END, CASE WHEN size % 5 = 1 THEN 'unknown note' END) END AS errors FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, name, arguments) AS n FROM f),
r AS (SELECT a.conv_id, a.turn AS result_turn, a.text AS content, k.id || CASE WHEN a.size % 29 = 8 THEN '?' ELSE '' END AS id, row_number() OVER (PARTITION BY a.conv_id, k.id, a.size % 29 = 8 ORDER BY a.turn, a.text) AS n
  FROM t a LEFT JOIN e ON e.conv_id = a.conv_id AND e.turn = a.turn - 1 JOIN k ON k.conv_id = a.conv_id AND k.turn = a.turn - 1 AND k.size = coalesce(e.size, 0) WHERE a.role = 'assistant'),
o AS (SELECT n.conv_id, n.id, p.id AS parent FROM n LEFT JOIN n p ON p.conv_id = n.conv_id AND p.id = n.ref AND p.n = 1 WHERE n.n = 1),
l AS (SELECT conv_id, id, 0 AS level FROM o WHERE parent IS NULL UNION ALL SELECT o.conv_id, o.id, l.level + 1 FROM o JOIN l ON o.conv_id = l.conv_id AND o.parent = l.id),
j AS (SELECT n.conv_id AS call_conv, coalesce(n.conv_id, r.conv_id) AS conv_id, coalesce(n.id, r.id) AS call_id, coalesce(n.n, r.n) AS n, coalesce(n.turn, r.result_turn) AS turn, n.name, n.arguments, coalesce(n.errors, '') AS errors, r.result_turn, r.content
  FROM n FULL JOIN r ON r.conv_id = n.conv_id AND r.id = n.id AND r.n = n.n),
w AS (SELECT j.*, CASE WHEN j.n = 1 AND call_conv IS NOT NULL THEN l.level END AS level FROM j LEFT JOIN l ON l.conv_id = j.conv_id AND l.id = j.call_id)
SELECT conv_id, call_id, turn, level, CASE WHEN n > 1 THEN 'repeated id' WHEN call_conv IS NULL THEN 'no call' WHEN level IS NULL THEN 'cycle' WHEN errors <> '' THEN 'invalid' WHEN result_turn IS NULL THEN 'no result' ELSE 'ok' END AS status, errors,
 '{' || concat_ws(',', '"arguments":' || arguments, '"id":' || to_json(call_id), '"level":' || level, '"name":"' || name || '"', '"result":' || to_json(content)) || '}' AS canonical FROM w""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
e AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER o8 AS g, coalesce(lag(word) OVER o = word, false) AS echo FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY i), o8 AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM e WHERE i + 7 <= n),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM t, range(8) x(k) WHERE c > 1 GROUP BY doc_id),
q AS (SELECT doc_id, count(*) FILTER (echo) AS n_echoes FROM e GROUP BY doc_id),
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
z AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM s WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_echoes, 0) AS n_echoes,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id) LEFT JOIN z USING (doc_id)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
  + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT + 32 * (2 * n_upper > n_letters AND n_letters > 0)::BIGINT + 128 * (2 * n_echoes > n_words)::BIGINT AS failures FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM b""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_FIELDS} AS others, text, list_reduce(flatten([[4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))]),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) & 1 = 0 AS odd FROM documents),
h AS (SELECT doc_id, source, sha256(others || {_FIELD.format("text")}) AS leaf, CASE WHEN odd THEN sha256(others || {_FIELD.format("text")}) ELSE sha256(others || {_FIELD.format("replace(text, chr(10), '')")}) END AS altered FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM h),
up AS (SELECT 0 AS l, s, i, leaf AS v, count(*) OVER (PARTITION BY s) AS n FROM g
  UNION ALL SELECT l + 1, s, i // 3, sha256(string_agg(v, '' ORDER BY i)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY l, s, i // 3, n),
subroots AS (SELECT s, v AS subroot FROM up WHERE n = 1),
top AS (SELECT 0 AS l, s AS i, subroot AS v, count(*) OVER () AS n FROM subroots UNION ALL SELECT l + 1, i // 3, sha256(string_agg(v, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, i // 3, n),
nodes AS (SELECT l, s, i, v, n FROM up WHERE n > 1 UNION ALL SELECT l + 1000, -1, i, v, n FROM top WHERE n > 1),
runs AS (SELECT l, s, i // 3 AS p, string_agg(v, '' ORDER BY i) AS vs FROM nodes GROUP BY ALL),
steps AS (SELECT l, s, i, substr(vs, 1, 64 * (i % 3)) AS before, substr(vs, 64 * (i % 3) + 65) AS after FROM nodes JOIN runs USING (l, s) WHERE p = i // 3),
walk AS (SELECT doc_id, s AS own, i AS own_i, 0 AS l, s, i, '' AS sibs, altered AS v FROM g
  UNION ALL SELECT doc_id, own, own_i, w.l + CASE WHEN t.l IS NULL THEN 1000 - w.l ELSE 1 END, CASE WHEN t.l IS NULL THEN -1 ELSE w.s END, CASE WHEN t.l IS NULL THEN w.s ELSE w.i // 3 END, sibs || coalesce(before || after, ''), CASE WHEN t.l IS NULL THEN w.v ELSE sha256(before || w.v || after) END
  FROM walk w LEFT JOIN steps t ON t.l = w.l AND t.s = w.s AND t.i = w.i WHERE t.l IS NOT NULL OR w.s >= 0),
ends AS (SELECT own, own_i, arg_max(sibs, l) AS sibs, arg_max(v, l) AS v FROM walk GROUP BY ALL)
SELECT doc_id, leaf, subroot, (SELECT v FROM top WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, ends.v AS folded_root, ends.v = (SELECT v FROM top WHERE n = 1) AS verified
FROM g JOIN subroots USING (s) JOIN ends ON own = s AND own_i = i""",
    "op13_centroid_clustering": rf"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), p) - 1)::INTEGER AS c, p AS q FROM v QUALIFY c < 16),
{_CLUSTER_ROUNDS}
z AS (SELECT vec_id, a.c AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256 FROM a3 a JOIN c3 USING (c))
SELECT * FROM z""",
}
