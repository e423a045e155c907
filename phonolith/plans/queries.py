"""Each operator on the driver's tables: a query and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonolith.functions import phones as P
from phonolith.operators import joins as J
from phonolith.operators import kernels as K
from phonolith.operators import metrics as M
from phonolith.operators import detector, evaluation, margins, models, reports, resampling, selection, sequences
from phonolith.operators import windows as N
from phonolith.plans import coach, experiments
from phonolith.sources.store import once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


@query(r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’][A-Za-z]+)*'), lambda w: replace(w, '’', '''')) AS ws FROM documents)
SELECT doc_id, len(ws)::INT AS n_tokens, len(list_distinct(ws))::INT AS n_distinct FROM t""")
def q01_tokenize(spark, d):
    words = table(spark, d, "documents").select("doc_id", P.tokenize(F.col("text")).alias("ws"))
    return words.select("doc_id", F.size("ws").alias("n_tokens"), F.size(F.array_distinct("ws")).alias("n_distinct"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE role IS DISTINCT FROM b""")
def q02_merge_repeats(spark, d):
    return N.collapse_repeats(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


_ALIAS, _SPLIT = {"view": "look", "error": "fail"}, {"click": ["press", "release"], "fail": ["stop", "report"]}


@query("""SELECT event_id, pos::INT AS pos, part FROM (SELECT event_id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT event_id,
CASE event_type WHEN 'click' THEN ['press', 'release'] WHEN 'error' THEN ['stop', 'report'] WHEN 'view' THEN ['look'] ELSE [event_type] END AS ps FROM events))""")
def q03_normalize(spark, d):
    parts = P.normalize(F.array("event_type"), _ALIAS, _SPLIT)
    return table(spark, d, "events").select("event_id", F.posexplode(parts).alias("pos", "part"))


@query("""SELECT a.o_orderstatus AS expected, b.l_linestatus AS heard, count(*) AS n, count(*) FILTER (a.o_orderstatus = b.l_linestatus OR (a.o_orderstatus = 'P' AND b.l_linestatus IN ('O', 'F')) OR (a.o_orderstatus = 'O' AND b.l_linestatus = 'P')) AS fine
FROM orders a JOIN lineitem b ON a.o_orderkey = b.l_orderkey GROUP BY ALL""")
def q04_is_acceptable(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    fine = P.is_acceptable(F.col("o_orderstatus"), F.col("l_linestatus"), F.lit(False), accept={"P": {"O", "F"}, "O": {"P"}})
    return both.groupBy(F.col("o_orderstatus").alias("expected"), F.col("l_linestatus").alias("heard")).agg(F.count("*").alias("n"), F.count_if(fine).alias("fine"))


@query("""SELECT p_brand, sum(levenshtein(p_type, p_name))::BIGINT AS edits, sum(length(p_type))::BIGINT AS length, round(sum(levenshtein(p_type, p_name)) / sum(length(p_type)), 6) AS per FROM part GROUP BY p_brand""")
def q05_phone_error_rate(spark, d):
    return M.phone_error_rate(table(spark, d, "part"), F.col("p_type"), F.col("p_name"), "p_brand").withColumn("per", r6("per"))


def _aligned_parts(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.split("p_type", "").alias("a"), F.split("p_name", "").alias("b"))
    return rows.withColumn("ops", sequences.align(F.col("a"), F.col("b")))


# the alignment as SQL: a row of the cost matrix for each step of the recursion, then the path back, ties in the kernel's order
_VOWEL = "contains('aeiouy', {})"
_LETTER_COST = f"CASE WHEN {{0}} = {{1}} THEN 0.0 WHEN {_VOWEL.format('{0}')} = {_VOWEL.format('{1}')} THEN 0.6 ELSE 1.2 END"
_NEXT_ROW = "list_reduce(list_concat([[h[1] + {gap}]], list_transform(range(1, len(b) + 1), lambda j: [least(h[j] + {cost}, h[j + 1] + {gap})])), lambda x, y: list_append(x, least(y[1], x[-1] + {gap})))"
_MATRIX_SQL = f"""m AS (SELECT id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda j: 1.0::DOUBLE * j) AS h FROM pairs
UNION ALL SELECT id, a, b, i + 1, {_NEXT_ROW.format(gap="1.0::DOUBLE", cost="(" + _LETTER_COST.format("a[i + 1]", "b[j]") + ")::DOUBLE")} FROM m WHERE i < len(a))"""
_PARTS_SQL = "pairs AS (SELECT p_partkey AS id, string_split(p_type, '') AS a, string_split(p_name, '') AS b FROM part)"


@query(f"WITH RECURSIVE {_PARTS_SQL}, {_MATRIX_SQL} SELECT id AS p_partkey, round(h[-1], 6) AS cost FROM m WHERE i = len(a)")
def q06_weighted_align(spark, d):
    return _aligned_parts(spark, d).select("p_partkey", r6(sequences.edit_cost(F.col("ops"))).alias("cost"))


@query(f"""WITH RECURSIVE {_PARTS_SQL}, {_MATRIX_SQL}, s AS (SELECT id, len(a) AS i, len(b) AS j, NULL::VARCHAR AS kind FROM pairs
UNION ALL SELECT id, i - (k <> 'ins')::INT, j - (k <> 'del')::INT, k FROM (SELECT s.id, s.i, s.j, CASE WHEN s.i = 0 THEN 'ins' WHEN s.j = 0 THEN 'del'
 WHEN u.h[s.j] + {_LETTER_COST.format("m.a[s.i]", "m.b[s.j]")} <= least(u.h[s.j + 1] + 1, m.h[s.j] + 1) THEN CASE WHEN m.a[s.i] = m.b[s.j] THEN 'match' ELSE 'sub' END
 WHEN u.h[s.j + 1] + 1 <= m.h[s.j] + 1 THEN 'del' ELSE 'ins' END AS k FROM s JOIN m ON m.id = s.id AND m.i = s.i LEFT JOIN m u ON u.id = s.id AND u.i = s.i - 1 WHERE s.i + s.j > 0))
SELECT p_brand, kind, count(*) AS n FROM s JOIN part ON p_partkey = id WHERE kind IS NOT NULL GROUP BY ALL""")
def q07_align_histogram(spark, d):
    ops = _aligned_parts(spark, d).select("p_brand", F.explode("ops").alias("o"))
    return ops.groupBy("p_brand", F.col("o.kind").alias("kind")).agg(F.count("*").alias("n"))


_TOKENS_SQL = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[''’][a-z]+)*')"


@query(f"""WITH RECURSIVE w AS (SELECT p_partkey, {_TOKENS_SQL.format("p_type")} AS ws, {_TOKENS_SQL.format("p_name")} AS hs FROM part),
pairs AS (SELECT (p_partkey, x, y) AS id, string_split(ws[x], '') AS a, string_split(hs[y], '') AS b FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS x FROM w), (SELECT unnest(range(1, 9)) AS y) WHERE y <= len(hs)), {_MATRIX_SQL},
c AS (SELECT id[1] AS p, list(list_value(id[2]::DOUBLE, id[3]::DOUBLE, h[-1] / greatest(len(a), len(b), 1))) AS cs FROM m WHERE i = len(a) GROUP BY 1),
t AS (SELECT p_partkey AS id, ws AS a, hs AS b, list_transform(range(1, len(ws) + 1), lambda x: list_transform(range(1, len(hs) + 1), lambda y: list_filter(cs, lambda k: k[1] = x AND k[2] = y)[1][3])) AS k FROM w LEFT JOIN c ON p = p_partkey),
n AS (SELECT id, a, b, k, 0 AS i, list_transform(range(len(b) + 1), lambda j: 0.5::DOUBLE * j) AS h FROM t UNION ALL SELECT id, a, b, k, i + 1, {_NEXT_ROW.format(gap="0.5::DOUBLE", cost="k[i + 1][j]")} FROM n WHERE i < len(a)),
s AS (SELECT id, len(a) AS i, len(b) AS j, 0 AS hit FROM t UNION ALL SELECT id, i - (z <> 'ins')::INT, j - (z <> 'del')::INT, (z = 'both')::INT FROM (SELECT s.id, s.i, s.j, CASE WHEN s.i = 0 THEN 'ins' WHEN s.j = 0 THEN 'del'
 WHEN u.h[s.j] + n.k[s.i][s.j] <= least(u.h[s.j + 1] + 0.5, n.h[s.j] + 0.5) THEN 'both' WHEN u.h[s.j + 1] + 0.5 <= n.h[s.j] + 0.5 THEN 'del' ELSE 'ins' END AS z FROM s JOIN n ON n.id = s.id AND n.i = s.i LEFT JOIN n u ON u.id = s.id AND u.i = s.i - 1 WHERE s.i + s.j > 0))
SELECT p_partkey, len(ws)::INT AS expected, (SELECT sum(hit) FROM s WHERE s.id = p_partkey)::INT AS matched FROM w""")
def q08_align_words(spark, d):
    """The words of a part's type against those of its name, letters as sounds."""
    words = lambda c: F.transform(P.tokenize(F.lower(c)), lambda w: F.split(w, ""))
    pairs = table(spark, d, "part").select("p_partkey", words("p_type").alias("a"), words("p_name").alias("b"))
    heard = sequences.align_words(F.col("a"), F.col("b"), F.transform("a", lambda w: F.lit(False)))
    return pairs.select("p_partkey", F.size("a").alias("expected"), F.size(F.filter(heard, lambda w: w.isNotNull())).alias("matched"))


def _utterances(spark, d):
    """Ten vectors in a row as the frames of an utterance: ``utt, log_probs`` (row-major, 64 tokens)."""
    frames = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("utt"), F.struct("vec_id", "embedding").alias("f"))
    return frames.groupBy("utt").agg(F.flatten(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["embedding"])).alias("log_probs"))


@query("""WITH e AS (SELECT vec_id // 10 AS utt, vec_id, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1 AS frame, list_position(embedding, list_max(embedding)) - 1 AS token FROM embeddings),
b AS (SELECT *, lag(token) OVER (PARTITION BY utt ORDER BY frame) AS p FROM e) SELECT utt, frame::INT AS frame, token::INT AS token FROM b WHERE token IS DISTINCT FROM p AND token NOT IN (0, 7)""")
def q09_greedy_decode(spark, d):
    runs = sequences.greedy_decode(F.col("log_probs"), F.lit(64), 0, (7,))
    return _utterances(spark, d).select("utt", F.explode(runs).alias("r")).select("utt", "r.frame", "r.token")


@query("""SELECT vec_id, round(list_max(k) - (list_max(k) + ln(list_sum(list_transform(k, lambda x: exp(x - list_max(k)))))), 6) AS best FROM
(SELECT vec_id, list_transform(embedding[9:], lambda x: x::DOUBLE) AS k FROM embeddings)""")
def q10_restrict(spark, d):
    allowed = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i >= 8)
    limited = P.log_softmax_over(F.transform("embedding", lambda x: x.cast("double")), allowed)
    return table(spark, d, "embeddings").select("vec_id", r6(F.array_max(limited)).alias("best"))


# the best path through the CTC graph of four targets as SQL: scores of all nine states by frame, and the way back
_CTC_SQL = """u AS (SELECT vec_id // 10 AS utt, list(list_transform(embedding, lambda x: x::DOUBLE) ORDER BY vec_id) AS f FROM embeddings GROUP BY 1),
l AS (SELECT [0, 5, 0, 9, 0, 9, 0, 3, 0] AS tok, [false, false, false, true, false, false, false, true, false] AS jump),
v AS (SELECT utt, 1 AS t, list_transform(range(1, 10), lambda s: CASE WHEN s <= 2 THEN f[1][tok[s] + 1] ELSE -1e30 END) AS sc, NULL::INT[] AS st FROM u, l
UNION ALL SELECT utt, t + 1, list_transform(o, lambda x: list_max(x[1:3]) + x[4]), list_transform(o, lambda x: (list_position(x[1:3], list_max(x[1:3])) - 1)::INT) FROM
(SELECT utt, t, list_transform(range(1, 10), lambda s: [sc[s], CASE WHEN s > 1 THEN sc[s - 1] ELSE -1e30 END, CASE WHEN s > 2 AND jump[s] THEN sc[s - 2] ELSE -1e30 END, f[t + 1][tok[s] + 1]]) AS o FROM v JOIN u USING (utt), l WHERE t < len(f))),
w AS (SELECT utt, t, CASE WHEN sc[9] >= sc[8] THEN 9 ELSE 8 END AS s FROM v JOIN u USING (utt) WHERE t = len(f) AND greatest(sc[8], sc[9]) > -5e29
UNION ALL SELECT w.utt, w.t - 1, w.s - v.st[w.s] FROM w JOIN v ON v.utt = w.utt AND v.t = w.t WHERE w.t > 1),
p AS (SELECT utt, s // 2 - 1 AS target, min(t) - 1 AS "start", max(t) - 1 AS "end" FROM w WHERE s % 2 = 0 GROUP BY 1, 2)"""
_TARGETS = (5, 9, 9, 3)


@query(f"""WITH RECURSIVE {_CTC_SQL} SELECT utt, target::INT AS target, "start"::INT AS "start", "end"::INT AS "end", round(max(own), 6) AS lpp, round(max(own - lead), 6) AS lpr FROM
(SELECT p.*, f[t][tok[(target + 1) * 2] + 1] AS own, list_max(f[t][2:]) AS lead FROM p JOIN u USING (utt), l, range(1, 1000) r(t) WHERE t - 1 BETWEEN "start" AND "end") GROUP BY ALL""")
def q11_viterbi(spark, d):
    """Utterances of ten frames aligned to four targets."""
    spans = sequences.forced_align(F.col("log_probs"), F.lit(64), F.array(*map(F.lit, _TARGETS)))
    return _utterances(spark, d).select("utt", F.posexplode(spans).alias("target", "s")).select("utt", "target", "s.start", "s.end", r6("s.lpp").alias("lpp"), r6("s.lpr").alias("lpr"))


@query("""WITH f AS (SELECT vec_id // 10 AS utt, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS t, embedding[6]::DOUBLE AS own, list_max(embedding[2:])::DOUBLE AS lead, embedding[8]::DOUBLE AS a, embedding[12]::DOUBLE AS b FROM embeddings),
g AS (SELECT utt, max(greatest(a, b) - own) AS margin, max(own) AS lpp, max(own - lead) AS lpr FROM f GROUP BY utt)
SELECT utt, round(lpp, 6) AS lpp, round(lpr, 6) AS lpr, round(margin, 6) AS margin, (SELECT arg_min(CASE WHEN a >= b THEN 7 ELSE 11 END, t) FROM f WHERE f.utt = g.utt AND greatest(a, b) - own = margin)::INT AS rival FROM g""")
def q12_gop_and_rivals(spark, d):
    rows = _utterances(spark, d).withColumn("span", F.struct(F.lit(0).alias("start"), (F.size("log_probs") / 64 - 1).cast("int").alias("end")))
    scores = sequences.gop_scores(F.col("log_probs"), F.lit(64), F.array(F.lit(5)), F.array("span"))[0]
    rival = sequences.rival_margin(F.col("log_probs"), F.lit(64), F.col("span"), F.lit(5), F.array(F.lit(7), F.lit(11)))
    found = rows.select("utt", scores.alias("g"), rival.alias("r"))
    return found.select("utt", r6("g.lpp").alias("lpp"), r6("g.lpr").alias("lpr"), r6("r.margin").alias("margin"), "r.rival")


@query("""SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
first_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events""")
def q13_nearest_known(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    found = N.nearest_known(events, F.when(F.col("event_type") != "error", F.col("event_type")), ["user_id"], ["ts", "event_id"], "before", "after")
    return found.select("event_id", "before", "after")


@query("""WITH w AS (SELECT *, CASE WHEN event_type <> 'error' THEN floor(value / 10)::BIGINT END AS word FROM events),
n AS (SELECT *, last_value(word IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(word IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM w)
SELECT event_id, CASE WHEN word IS NOT NULL THEN word WHEN b IS NULL THEN a WHEN a IS NULL OR a = b THEN b WHEN event_id % 2 = 0 THEN a ELSE b END AS target FROM n""")
def q14_assign_insertions(spark, d):
    rows = table(spark, d, "events").withColumn("word", F.when(F.col("event_type") != "error", F.floor(F.col("value") / 10)))
    return N.assign_insertions(rows, ["user_id"], ["ts", "event_id"], "word", F.col("event_id") % 2 == 0).select("event_id", "target")


@query("""SELECT l_returnflag, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dismissed FROM (SELECT l_returnflag, g IS NULL OR g < CASE WHEN l_linestatus = 'F' THEN -4 ELSE -6 END AS ok FROM
(SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = 7 THEN NULL ELSE -100 * l_discount END AS g FROM lineitem)) GROUP BY l_returnflag""")
def q15_gop_confirmation(spark, d):
    tip = F.when(F.col("l_linestatus") == "F", "t").alias("tip")
    rows = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 7, -100 * F.col("l_discount")).alias("gop"), F.struct(F.lit("sub").alias("kind"), tip).alias("i"))
    ok = selection.is_confirmed(F.col("i"), F.col("gop"), F.lit(-6.0), F.lit(-4.0))
    return rows.groupBy("l_returnflag").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dismissed"))


@query("""SELECT l_orderkey, l_returnflag, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount DESC, l_linenumber) AS k FROM lineitem
WHERE l_discount > CASE l_returnflag WHEN 'A' THEN 0.05 WHEN 'N' THEN 0.03 ELSE 0.07 END) WHERE k = 1""")
def q16_hidden_choice(spark, d):
    """The lines of an order as rivals: the flag is place and pattern, the discount the margin."""
    rival = F.struct(F.ascii("l_returnflag").alias("pos"), F.col("l_returnflag").alias("tip"), F.col("l_discount").alias("margin"), "l_linenumber")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", rival.alias("r")))).alias("x"))
    chosen = selection.chosen_hidden(F.transform("x", lambda x: x["r"]), {"A": 0.05, "N": 0.03, "R": 0.07})
    return rows.select("l_orderkey", F.explode(chosen).alias("r")).select("l_orderkey", F.col("r.tip").alias("l_returnflag"), "r.l_linenumber", F.col("r.margin").alias("l_discount"))


@query("""SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY n DESC, first_seen LIMIT 3""")
def q17_top_tips(spark, d):
    return M.top_k(table(spark, d, "events"), "event_type", "event_id", 3)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click'),
s AS (SELECT o_custkey AS u FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN (SELECT user_id, count(*) AS m FROM events WHERE event_type = 'click' GROUP BY 1) ON o_custkey = user_id AND n = m)
SELECT o_custkey AS u, k, o_orderkey, event_id FROM r JOIN e USING (k) WHERE o_custkey = user_id AND o_custkey IN (FROM s)""")
def q18_positional_join(spark, d):
    place = lambda key, order: F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint").alias("k")
    left = table(spark, d, "orders").select(F.col("o_custkey").alias("u"), place("o_custkey", "o_orderkey"), "o_orderkey")
    right = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("u"), place("user_id", "event_id"), "event_id")
    return J.positional_join(left, right, "u", "k")


@query("""SELECT coalesce(flag, 'ALL') AS flag, count(*) AS parts, count(a) AS with_a, round(avg(abs(a - r)), 6) AS gap FROM
(SELECT l_partkey, l_linestatus AS flag, max(l_quantity) FILTER (l_returnflag = 'A') AS a, max(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1, 2) GROUP BY ROLLUP (flag)
UNION ALL SELECT 'X', NULL, NULL, NULL""")
def q19_pair_table(spark, d):
    pairs = J.paired(table(spark, d, "lineitem"), ["l_partkey", "l_linestatus"], "l_returnflag", F.col("l_quantity"), ("A", "R"))
    summary = pairs.rollup("l_linestatus").agg(F.count("*").alias("parts"), F.count("A").alias("with_a"), r6(F.avg(F.abs(F.col("A") - F.col("R")))).alias("gap"))
    summary = summary.select(F.coalesce("l_linestatus", F.lit("ALL")).alias("flag"), "parts", "with_a", "gap")
    return J.in_fixed_order(summary, spark.createDataFrame([("F",), ("O",), ("X",), ("ALL",)], "flag string"), "flag")


_DETECTION = """SELECT {by}, tp, fp, fn, tn, tp + fp + fn + tn AS words, tp + fn AS expert_wrong, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS false_alarm, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM
(SELECT {by}, count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn, count(*) FILTER (quality = 1 AND toxic = 0) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY {by})"""


def _detection(spark, d, by):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", by), "doc_id")
    found = M.detection(rows, F.col("quality") == 0, F.col("toxic") == 1, by)
    return found.withColumns({c: r6(c) for c in ("false_alarm", "recall", "precision", "f1")})


@query(_DETECTION.format(by="lang"))
def q20_detection(spark, d):
    return _detection(spark, d, "lang")


@query(_DETECTION.format(by="source"))
def q21_confusion_units(spark, d):
    return _detection(spark, d, "source")


@query("""WITH a AS (SELECT l_orderkey, l_returnflag, count(*) AS a FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), b AS (SELECT l_orderkey, l_returnflag, count(*) AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
w AS (SELECT l_orderkey, sum(a) AS errors, sum(least(a, coalesce(b, 0))) AS found FROM a LEFT JOIN b USING (l_orderkey, l_returnflag) GROUP BY 1)
SELECT sum(errors)::BIGINT AS expert_errors, sum(found)::BIGINT AS caught, count(*) FILTER (errors >= 2) AS multi_words, count(*) FILTER (errors >= 2 AND found = errors) AS multi_all, count(*) FILTER (errors >= 2 AND found > 0 AND found < errors) AS multi_some, count(*) FILTER (errors >= 2 AND found = 0) AS multi_none,
round(sum(found) / sum(errors), 6) AS catch FROM w""")
def q22_error_catch(spark, d):
    lines = table(spark, d, "lineitem")
    words = M.found_errors(lines.where("l_linestatus = 'F'"), lines.where("l_linestatus = 'O'"), ["l_orderkey"], "l_returnflag")
    return M.catch_report(words).withColumn("catch", r6("catch"))


@query("""WITH t AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY x) + (count(*) OVER (PARTITION BY flag, x) - 1) / 2 AS x, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1) / 2 AS y FROM t)
SELECT 'pearson' AS kind, flag, count(*) AS n, round(corr(x, y), 6) AS correlation FROM t GROUP BY flag UNION ALL SELECT 'spearman', flag, count(*), round(corr(x, y), 6) FROM k GROUP BY flag UNION ALL SELECT 'constant', flag, count(*), 0 FROM t GROUP BY flag""")
def q23_correlation(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice", F.lit(0.1).alias("same"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "flag", "n", r6("correlation").alias("correlation"))
    parts = [named(M.pearson(rows, "l_quantity", "l_extendedprice", "flag"), "pearson"), named(M.spearman(rows, "l_quantity", "l_extendedprice", "flag"), "spearman"), named(M.pearson(rows, "l_quantity", "same", "flag"), "constant")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH c AS (SELECT l_returnflag AS flag, l_linestatus <> o_orderstatus AS bad, l_linestatus <> e AS said, o_orderstatus = e AS same FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'P' WHEN l_linenumber % 3 = 1 THEN o_orderstatus ELSE l_linestatus END AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
n AS (SELECT flag, count(*) FILTER (NOT bad AND NOT said) AS ta, count(*) FILTER (NOT bad AND said) AS fr, count(*) FILTER (bad AND NOT said) AS fa, count(*) FILTER (bad AND said) AS tr, count(*) FILTER (bad AND said AND same) AS diagnosed FROM c GROUP BY flag)
SELECT *, round(tr / (tr + fr), 6) AS precision, round(tr / (tr + fa), 6) AS recall, round(2 * tr / (2 * tr + fr + fa), 6) AS f1, round(diagnosed / tr, 6) AS diagnosis_accuracy, round(fr / (ta + fr), 6) AS false_rejection FROM n""")
def q24_mdd(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    guess = F.when(F.col("l_linenumber") % 3 == 0, "P").when(F.col("l_linenumber") % 3 == 1, F.col("o_orderstatus")).otherwise(F.col("l_linestatus"))
    found = M.mdd(rows.withColumnRenamed("l_returnflag", "flag"), F.col("l_linestatus"), F.col("o_orderstatus"), guess, "flag")
    return found.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "diagnosis_accuracy", "false_rejection")})


@query("""WITH t AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'sub' WHEN 1 THEN 'match' WHEN 2 THEN 'match' ELSE 'ins' END AS k, l_quantity AS q, -100 * l_discount AS s FROM lineitem)
SELECT l_orderkey, round(count(*) FILTER (k = 'match') / count(*), 6) AS phone_accuracy, round(count(*) FILTER (k = 'sub') / greatest(count(*) FILTER (k <> 'ins'), 1), 6) AS sub_rate, 0.0::DOUBLE AS del_rate, round(count(*) FILTER (k = 'ins') / greatest(count(*) FILTER (k <> 'ins'), 1), 6) AS ins_rate,
round(avg(q), 6) AS lpp_mean, min(q) AS lpp_min, round(avg(s), 6) AS lpr_mean, round(min(s), 6) AS lpr_min, round(quantile_cont(s, 0.1), 6) AS lpr_p10, round(avg((s < -2)::INT), 6) AS bad_frac FROM t GROUP BY l_orderkey""")
def q25_features(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("sub", "match", "match", "ins"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    found = M.utterance_features(table(spark, d, "lineitem"), "l_orderkey", kind, F.col("l_quantity"), -100 * F.col("l_discount"))
    return found.withColumns({c: r6(c) for c in found.columns if c not in ("l_orderkey", "lpp_min")})


@query("""WITH s AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, greatest(stddev_pop(p_retailprice), 0.25) AS s FROM part GROUP BY p_brand HAVING count(*) >= 80), a AS (SELECT avg(p_retailprice) AS m, greatest(stddev_pop(p_retailprice), 0.25) AS s FROM part)
SELECT p_partkey, round((p_retailprice - coalesce(s.m, a.m)) / coalesce(s.s, a.s), 6) AS z FROM part LEFT JOIN s USING (p_brand), a""")
def q26_z_scores(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return M.z_scores(parts, M.gop_stats(parts, "p_brand", "p_retailprice", 80), "p_brand", "p_retailprice").select("p_partkey", r6("z").alias("z"))


@query("""WITH t AS (SELECT *, epoch(ts) AS s FROM events), n AS (SELECT event_id, user_id, lag(value) OVER w AS prev_value, lead(value) OVER w AS next_value, lead(s) OVER w - s AS duration, min(value) OVER (PARTITION BY user_id) AS group_min FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, prev_value, next_value, round(duration, 3) AS duration, group_min, round(duration / avg(duration) OVER (PARTITION BY user_id), 6) AS duration_rel FROM n""")
def q27_neighbours(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    found = N.neighbour_features(rows, ["user_id"], ["ts", "event_id"], "value", "s")
    return found.select("event_id", "prev_value", "next_value", F.round("duration", 3).alias("duration"), "group_min", r6("duration_rel").alias("duration_rel"))


@query("""SELECT event_id, round(m, 6) AS moving FROM (SELECT event_id, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k >= 50""")
def q28_moving_mean(spark, d):
    return N.moving_mean(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value", 50).select("event_id", r6("moving").alias("moving"))


@query("""WITH s AS (SELECT round(value) AS v, count(*) FILTER (event_type = 'error') AS p, count(*) AS n FROM events GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY v DESC) AS tp, sum(n) OVER (ORDER BY v DESC) AS seen FROM s)
SELECT sum(p)::BIGINT AS pos, sum(n - p)::BIGINT AS neg, round(1 - sum(p * ((seen - tp) - (n - p) / 2)) / (sum(p) * sum(n - p)), 6) AS auc, round(sum(p * tp / seen) / sum(p), 6) AS ap FROM c""")
def q29_auc_ap(spark, d):
    rows = table(spark, d, "events").select(F.round("value").alias("score"), (F.col("event_type") == "error").alias("wrong"))
    return M.auc_and_ap(rows, "score", F.col("wrong")).select("pos", "neg", r6("auc").alias("auc"), r6("ap").alias("ap"))


def _word_eval(spark, d):
    """Lines as words: by priority Turkish or native, wrong by return flag, score by discount, one difference each."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.expr("l_orderkey = o_orderkey"))
    issue = F.struct(F.lit("sub").alias("kind"), F.lit("w").alias("expected"), F.lit("v").alias("heard"), F.when(F.col("l_linenumber") % 2 == 0, "w").alias("tip"), F.lit(False).alias("hidden"))
    return lines.select(
        F.concat(F.lit("s"), F.pmod("o_custkey", F.lit(40))).alias("speaker"), F.when(F.substring("o_orderpriority", 1, 1) < "3", "turkish").otherwise("english").alias("grp"),
        F.when(F.col("l_linenumber") < 7, F.col("l_returnflag") == "R").alias("expert_wrong"), F.when(F.col("l_linenumber") != 5, -100 * F.col("l_discount") - F.when(F.col("l_returnflag") == "R", 2.0).otherwise(0.0)).alias("gop"),
        F.when((F.col("l_returnflag") == "R") | (F.col("l_linenumber") == 3), F.array(issue)).otherwise(F.array().cast(f"array<{issue_type}>")).alias("our_errors"), F.array().cast(f"array<{issue_type}>").alias("expert_errors"), F.lit(None).cast("double").alias("w_margin"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("word_idx"),
    )


issue_type = "struct<kind:string,expected:string,heard:string,tip:string,hidden:boolean>"
_WORDS_SQL = """l AS (SELECT 's' || (o_custkey % 40) AS speaker, CASE WHEN o_orderpriority[1] < '3' THEN 'turkish' ELSE 'english' END AS grp, CASE WHEN l_linenumber < 7 THEN l_returnflag = 'R' END AS wrong,
CASE WHEN l_linenumber <> 5 THEN -100 * l_discount - CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END END AS gop, l_returnflag = 'R' OR l_linenumber = 3 AS issue, l_linenumber % 2 = 0 AS tip, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS word_idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT unnest(['inf'::DOUBLE, 0, -0.5, -1, -1.5, -2, -2.5, -3, -3.5, -4, -5, -6, -8, -10]) AS x), g AS (SELECT a.x AS t, b.x AS p FROM v a, v b WHERE b.x >= a.x)"""
_SCORE_SQL = """count(*) FILTER (turkish AND wrong AND f) AS tp, count(*) FILTER (turkish AND NOT wrong AND f) AS fp, count(*) FILTER (turkish AND wrong AND NOT f) AS fn, count(*) FILTER (NOT turkish AND NOT wrong AND f) AS ef, count(*) FILTER (NOT turkish AND NOT wrong) AS en"""


@query(f"""WITH {_WORDS_SQL}, c AS (SELECT t, p, wrong, grp = 'turkish' AS turkish, issue AND (gop IS NULL OR gop < CASE WHEN tip THEN p ELSE t END) AS f FROM l, g), s AS (SELECT t, p, {_SCORE_SQL} FROM c GROUP BY t, p),
r AS (SELECT t, p, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, ef / en AS fa FROM s) SELECT t, p, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fa, 6) AS english_false_alarm FROM r WHERE precision >= 0.6 AND fa <= 0.1 ORDER BY recall DESC, precision DESC, fa, t, p LIMIT 1""")
def q30_grid_selection(spark, d):
    best = selection.select_thresholds(_word_eval(spark, d), min_precision=0.6, max_false_alarm=0.1)
    return best.select("t", "p", *[r6(c).alias(c) for c in ("precision", "recall", "english_false_alarm")])


@query(f"""WITH {_WORDS_SQL}, m AS (SELECT DISTINCT speaker FROM l), o AS (SELECT speaker, (row_number() OVER (ORDER BY speaker) - 1) % 4 AS fold FROM m), h AS (SELECT DISTINCT fold AS held FROM o),
c AS (SELECT held, t, p, wrong, grp = 'turkish' AS turkish, issue AND (gop IS NULL OR gop < CASE WHEN tip THEN p ELSE t END) AS f FROM l JOIN o USING (speaker), g, h WHERE fold <> held), s AS (SELECT held, t, p, {_SCORE_SQL} FROM c GROUP BY ALL),
r AS (SELECT held, t, p, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, ef / en AS fa FROM s), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY recall DESC, precision DESC, fa, t, p) AS k FROM r WHERE precision >= 0.6 AND fa <= 0.1) WHERE k = 1)
SELECT fold::INT AS fold, count(*) AS words, count(*) FILTER (issue AND (gop IS NULL OR gop < CASE WHEN tip THEN coalesce(p, -1) ELSE coalesce(t, -2.5) END)) AS flagged FROM l JOIN o USING (speaker) LEFT JOIN b ON b.held = o.fold GROUP BY fold""")
def q31_cross_validation(spark, d):
    rows = _word_eval(spark, d)
    folds = N.deal_folds(rows.select(F.lit("all").alias("g"), "speaker"), "g", "speaker", 4).select("speaker", "fold")
    out = selection.cross_validate(rows, folds, min_precision=0.6, max_false_alarm=0.1)
    return out.groupBy("fold").agg(F.count("*").alias("words"), F.count_if("flagged").alias("flagged"))


@query("""WITH t AS (SELECT round(value) AS p, event_type = 'error' AS wrong, event_type = 'purchase' AS extra, user_id % 2 = 0 AS t FROM events), c AS (SELECT DISTINCT p FROM t UNION SELECT 1000),
s AS (SELECT c.p AS x, count(*) FILTER (t AND t.p >= c.p) AS tn, count(*) FILTER (t AND wrong AND t.p >= c.p) AS tw, count(*) FILTER (t AND (t.p >= c.p OR extra)) AS yn, count(*) FILTER (t AND wrong AND (t.p >= c.p OR extra)) AS yw,
count(*) FILTER (NOT t AND NOT wrong AND (t.p >= c.p OR extra)) AS ef, count(*) FILTER (NOT t AND NOT wrong) AS en FROM t, c GROUP BY 1), r AS (SELECT min(x) AS red FROM s WHERE tn > 0 AND tw / tn >= 0.21 AND ef / en <= 0.6)
SELECT coalesce(red, 1.01) AS red, coalesce((SELECT min(x) FROM s WHERE x <= coalesce(red, 1.01) AND yn > 0 AND yw / yn >= 0.1 AND ef / en <= 0.6), red, 1.01) AS yellow FROM r""")
def q32_bands(spark, d):
    rows = table(spark, d, "events").select(F.round("value").alias("p"), (F.col("event_type") == "error").alias("wrong"), (F.col("event_type") == "purchase").alias("extra"), F.when(F.col("user_id") % 2 == 0, "turkish").otherwise("english").alias("grp"))
    return selection.choose_bands(rows, red_precision=0.21, min_precision=0.1, max_false_alarm=0.6)


_DRAWS = """b AS (SELECT unnest(range(2000)) AS b), u AS (SELECT *, row_number() OVER (ORDER BY {unit}) - 1 AS k, count(*) OVER () AS n FROM units), s AS (SELECT b, k AS slot, n FROM u, b),
r AS (SELECT b, (((b * 1103515245 + slot * 12345 + 1 * 69069) % 2147483647) * 48271 % 2147483647) % n AS k FROM s)"""


@query(f"""WITH units AS (SELECT c_nationkey, sum(c_acctbal) AS total, count(*) AS size FROM customer GROUP BY 1), {_DRAWS.format(unit="c_nationkey")},
e AS (SELECT b, sum(total) / sum(size) AS s FROM r JOIN u USING (k) GROUP BY b) SELECT round(quantile_cont(s, 0.025), 4) AS low, round(quantile_cont(s, 0.975), 4) AS high FROM e""")
def q33_bootstrap(spark, d):
    units = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("total"), F.count("*").alias("size"))
    ci = resampling.bootstrap_ci(units, "c_nationkey", F.sum("total") / F.sum("size"))
    return ci.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(f"""WITH o AS (SELECT c_nationkey, year(o_orderdate) % 2 AS y, sum(o_totalprice) AS total, count(*) AS size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
units AS (SELECT c_nationkey, a.total AS xt, a.size AS xz, b.total AS bt, b.size AS bz FROM (SELECT * FROM o WHERE y = 0) a JOIN (SELECT * FROM o WHERE y = 1) b USING (c_nationkey)), {_DRAWS.format(unit="c_nationkey")},
e AS (SELECT b, sum(bt) / sum(bz) - sum(xt) / sum(xz) AS s FROM r JOIN u USING (k) GROUP BY b), c AS (SELECT quantile_cont(s, 0.025) AS low, quantile_cont(s, 0.975) AS high FROM e), f AS (SELECT sum(bt) / sum(bz) - sum(xt) / sum(xz) AS diff FROM units)
SELECT round(diff, 3) AS diff, round(low, 3) AS low, round(high, 3) AS high, low > 0 OR high < 0 AS real FROM c, f""")
def q34_paired_bootstrap(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).groupBy("c_nationkey", (F.year("o_orderdate") % 2).alias("y")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("size"))
    a, b = (rows.where(f"y = {y}").drop("y") for y in (0, 1))
    out = resampling.paired_bootstrap(a, b, "c_nationkey", lambda p: F.sum(f"{p}_total") / F.sum(f"{p}_size"))
    return out.select(*[F.round(c, 3).alias(c) for c in ("diff", "low", "high")], "real")


@query("""WITH v AS (SELECT user_id, floor(value / 20)::BIGINT AS word, min(value) AS s, max(value) AS e FROM events WHERE event_type = 'click' GROUP BY ALL), d AS (SELECT event_id, word, greatest(0, s - value, value - e) AS distance, s FROM events JOIN v USING (user_id))
SELECT event_id, word, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, s) AS k FROM d) WHERE k = 1""")
def q35_nearest_interval(spark, d):
    events = table(spark, d, "events")
    intervals = events.where("event_type = 'click'").groupBy("user_id", F.floor(F.col("value") / 20).alias("word")).agg(F.min("value").alias("s"), F.max("value").alias("e"))
    found = J.nearest_interval(events.select("event_id", "user_id", "value"), intervals, "user_id", "value", "s", "e", "word")
    return found.where("word is not null").select("event_id", "word", r6("distance").alias("distance"))


@query("""SELECT c_custkey, true AS known FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def q36_semi_anti(spark, d):
    customers, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(orders, "c_custkey", "left_semi").withColumn("known", F.lit(True)).unionByName(J.missing_keys(customers, orders, ["c_custkey"]).withColumn("known", F.lit(False)))


@query("""WITH a AS (SELECT DISTINCT year(o_orderdate) AS y, o_orderstatus AS s FROM orders), b AS (SELECT DISTINCT year(l_shipdate) AS y, l_linestatus AS s FROM lineitem)
SELECT 'union' AS op, y, s FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', y, s FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', y, s FROM (FROM a EXCEPT FROM b)""")
def q37_set_operations(spark, d):
    a = table(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"), F.col("o_orderstatus").alias("s"))
    b = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("y"), F.col("l_linestatus").alias("s"))
    named = lambda df, op: df.select(F.lit(op).alias("op"), "y", "s")
    return named(a.union(b).distinct(), "union").unionByName(named(a.intersect(b), "intersect")).unionByName(named(a.subtract(b), "except"))


@query("""SELECT doc_id, k <= round_even(n * 0.2, 0) AS held_out FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id * 48271 % 2147483647, doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)""")
def q38_stratified_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return resampling.stratified_split(docs, ["lang", "source"], "doc_id", F.pmod(F.col("doc_id") * 48271, F.lit(2147483647)), 0.2).select("doc_id", "held_out")


@query("""SELECT vec_id, round(1.0::DOUBLE / (count(*) OVER (PARTITION BY label) * (SELECT count(DISTINCT label) FROM embeddings)), 9) AS weight FROM embeddings""")
def q39_balanced_weights(spark, d):
    return resampling.balanced_weights(table(spark, d, "embeddings").select("vec_id", "label"), "label").select("vec_id", F.round("weight", 9).alias("weight"))


@query("""SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type""")
def q40_json_fields(spark, d):
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, regexp_replace(regexp_replace(url, '^https?://', '', 'g'), '[0-9]+', '#', 'g') AS shape FROM pages""")
def q41_slug_and_rules(spark, d):
    return table(spark, d, "pages").select("page_id", P.slug(F.col("url")).alias("slug"), P.apply_rules(F.col("url"), [("^https?://", ""), ("[0-9]+", "#")]).alias("shape"))


@query()
def q42_narrow_to_broad(spark, d):
    """All distinct words of all documents, taken as narrow transcription."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).alias("word"))
    distinct = words.groupBy("word").agg(F.count("*").alias("docs"))
    return distinct.select("word", "docs", F.array_join(sequences.narrow_to_broad(F.col("word")), " ").alias("broad"))


_SEARCH_SQL = """{name} AS (SELECT min(x) AS {name} FROM (SELECT c.x, count(*) FILTER (turkish AND tip = '{tip}' AND m > c.x) AS n, count(*) FILTER (turkish AND tip = '{tip}' AND m > c.x AND wrong) AS good,
count(*) FILTER (turkish AND wrong AND f) AS tp, count(*) FILTER (turkish AND NOT wrong AND f) AS fp FROM (SELECT z.*, c.x, issue OR (tip = '{tip}' AND m > c.x){more} AS f FROM z, c{join}) q JOIN c ON c.x = q.x GROUP BY c.x) WHERE n >= 10 AND good >= 0.3 * n AND tp >= 0.3 * (tp + fp))"""


@query(f"""WITH {_WORDS_SQL}, z AS (SELECT wrong, grp = 'turkish' AS turkish, issue, coalesce(gop, -9) + 3 AS m, CASE WHEN speaker[2:]::INT % 2 = 0 THEN 'w' ELSE 'th_voiced' END AS tip FROM l WHERE wrong IS NOT NULL), c AS (SELECT unnest([0, -1, -2, -3, -4, -5, -6, -7, -8])::DOUBLE AS x),
{_SEARCH_SQL.format(name="one", tip="w", more="", join="")}, {_SEARCH_SQL.format(name="two", tip="th_voiced", more=" OR (tip = 'w' AND m > coalesce(one, 1e9))", join=", one")}
SELECT 'w' AS tip, one AS threshold FROM one UNION ALL SELECT 'th_voiced', two FROM two""")
def q43_coordinate_search(spark, d):
    """Margins for two patterns, one after the other; each word has a rival of one of them."""
    rows = _word_eval(spark, d)
    pick = F.when(F.substring("speaker", 2, 9).cast("int") % 2 == 0, "w").otherwise("th_voiced")
    rival = F.struct(F.lit(0).alias("pos"), F.lit("w").alias("expected"), pick.alias("tip"), F.lit("v").alias("sound"), (F.coalesce("gop", F.lit(-9.0)) + 3).alias("margin"))
    truth = F.struct(F.lit("sub").alias("kind"), F.lit("w").alias("expected"), F.lit("v").alias("heard"), pick.alias("tip"), F.lit(False).alias("hidden"))
    rows = rows.withColumns({"rivals": F.array(rival), "expert_errors": F.when(F.col("expert_wrong"), F.array(truth)).otherwise(F.array().cast(f"array<{issue_type}>"))})
    chosen = selection.select_hidden(rows, patterns=["w", "th_voiced"], min_precision=0.3, max_false_alarm=1.0, min_diagnosis=0.3)
    return spark.createDataFrame(list(chosen.items()), "tip string, threshold double")


@query()
def q44_models(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_suppkey").alias("speaker"), (F.col("l_extendedprice") / 10_000).alias("accuracy"), (F.col("l_returnflag") == "R").alias("wrong"))
    features = ["l_quantity", "l_discount", "l_tax"]
    # both at once: each round of boosting is a few small jobs
    with ThreadPoolExecutor(2) as pool:
        trained = pool.submit(inheritable_thread_target(spark)(models.Detector(features, "speaker").fit), rows, "wrong")
        _, quality = models.fit_scorer(rows, features, "accuracy", "speaker")
        detector = trained.result()
    # equal features have equal probabilities
    p = detector.probabilities(rows.select(*features).distinct()).agg(F.min("p").alias("low"), F.max("p").alias("high")).first()
    return spark.createDataFrame([*((f"r2_{n}", float(v)) for n, v in quality.items()), ("p_low", p.low), ("p_high", p.high)], "name string, value double")


#: The 64 tokens of a frame: blank, three that are never heard, a sound for each letter, and others that are no sounds.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "æ b k d ɛ f ɡ h ɪ dʒ k l m n ʊ p k ɹ s t ʌ v w z iː z".split(), strict=True))
SOUNDS = list(dict.fromkeys(LETTERS.values()))
VOCABULARY = ["<pad>", "<s>", "</s>", "<unk>", *SOUNDS, *(f"<{k}>" for k in range(60 - len(SOUNDS)))]


#: Parts that meet one copy of a recording, and parts of a task.
_SHARE, _TASK = 128, 4096


def _recorded(spark, d, *carried: str):
    """Parts as recordings: the words of the name, a sound for each letter, said in 50 vectors in a row as frames. carried: further
    columns of the parts.

    Neither side is broadcast: a recording is copied for every ``_SHARE`` of its parts, and the tasks' number follows the parts'. The
    matrices don't cross the network again.
    """
    vectors = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("utt"), F.struct("vec_id", "embedding").alias("f"))
    frames = vectors.groupBy("utt").agg(F.flatten(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["embedding"])).alias("log_probs"))
    n, total = vectors.agg(F.max("utt") + 1).first()[0], table(spark, d, "part").count()
    copies = -(-total // (_SHARE * (n or 1))) or 1
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // _TASK))
    copied = frames.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint")))).repartition(tasks, "utt", "copy")
    parts = table(spark, d, "part").select("p_partkey", *carried, F.pmod("p_partkey", F.lit(n)).alias("utt"), F.pmod(F.floor(F.col("p_partkey") / n), F.lit(copies)).alias("copy"), P.tokenize(F.lower("p_name")).alias("words"))
    said = parts.repartition(tasks, "utt", "copy").hint("merge").join(copied, ["utt", "copy"])
    letters = P.literal_map(LETTERS)
    raw = F.transform("words", lambda w: F.transform(F.split(w, ""), lambda c: F.element_at(letters, c)))
    return said.withColumn("raw", raw).withColumn("seconds", F.size("log_probs") / 64 * K.FRAME_SECONDS).drop("utt", "copy")


_SOUND_COST = "CASE WHEN {0} = {1} THEN 0.0 WHEN list_contains(['æ', 'ɛ', 'ɪ', 'ʊ', 'ʌ', 'iː'], {0}) = list_contains(['æ', 'ɛ', 'ɪ', 'ʊ', 'ʌ', 'iː'], {1}) THEN 0.6 ELSE 1.2 END"
_SOUND_MATRIX_SQL = f"""m AS (SELECT id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda j: 1.0::DOUBLE * j) AS h FROM pairs
UNION ALL SELECT id, a, b, i + 1, {_NEXT_ROW.format(gap="1.0::DOUBLE", cost="(" + _SOUND_COST.format("a[i + 1]", "b[j]") + ")::DOUBLE")} FROM m WHERE i < len(a))"""


_ANALYSIS_SQL = f"""l AS (SELECT {list(LETTERS.values())} AS sounds, {["<pad>", "<s>", "</s>", "<unk>", *SOUNDS]} AS names, {len(SOUNDS)} + 4 AS last),
e AS (SELECT vec_id // 50 AS utt, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
r AS (SELECT utt, vec_id, list_concat(x[1:1], x[5:last]) AS x, last FROM e, l), q AS (SELECT utt, vec_id, list_transform(x, lambda y: y - list_max(x) - ln(list_sum(list_transform(x, lambda z: exp(z - list_max(x)))))) AS x, list_position(x, list_max(x)) AS best FROM r),
u AS (SELECT utt, list(x ORDER BY vec_id) AS f FROM q GROUP BY utt), k AS (SELECT *, lag(best) OVER (PARTITION BY utt ORDER BY vec_id) AS before FROM q),
h AS (SELECT utt, coalesce(list(names[best + 3] ORDER BY vec_id) FILTER (best <> 1 AND best IS DISTINCT FROM before), []) AS b FROM k, l GROUP BY utt),
n AS (SELECT DISTINCT p_name, p_partkey % (SELECT max(utt) + 1 FROM u) AS utt FROM part),
w AS (SELECT p_name, utt, list_transform(string_split(lower(p_name), ' '), lambda w: list_transform(string_split(w, ''), lambda c: sounds[ascii(c) - 96])) AS ws FROM n, l),
pairs AS (SELECT (p_name, utt) AS id, flatten(list_transform(ws, lambda w: list_filter(w, lambda c, i: i = 1 OR c <> w[i - 1]))) AS a, b, list_transform(flatten(ws), lambda c: list_position(names, c) - 3) AS t FROM w JOIN h USING (utt), l),
{_SOUND_MATRIX_SQL},
s AS (SELECT id, len(a) AS i, len(b) AS j, NULL::VARCHAR AS kind FROM pairs UNION ALL SELECT id, i - (k <> 'ins')::INT, j - (k <> 'del')::INT, k FROM (SELECT s.id, s.i, s.j, CASE WHEN s.i = 0 THEN 'ins' WHEN s.j = 0 THEN 'del'
 WHEN o.h[s.j] + {_SOUND_COST.format("m.a[s.i]", "m.b[s.j]")} <= least(o.h[s.j + 1] + 1, m.h[s.j] + 1) THEN CASE WHEN m.a[s.i] = m.b[s.j] THEN 'match' ELSE 'sub' END
 WHEN o.h[s.j + 1] + 1 <= m.h[s.j] + 1 THEN 'del' ELSE 'ins' END AS k FROM s JOIN m ON m.id = s.id AND m.i = s.i LEFT JOIN m o ON o.id = s.id AND o.i = s.i - 1 WHERE s.i + s.j > 0)),
y AS (SELECT id, count(*) FILTER (kind = 'match') / count(*) AS accuracy FROM s WHERE kind IS NOT NULL GROUP BY id),
c AS (SELECT id, list_transform(range(1, 2 * len(t) + 2), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE t[i // 2] END) AS tok, f FROM pairs JOIN u ON utt = id[2]),
v AS (SELECT id, 1 AS fr, list_transform(range(1, len(tok) + 1), lambda i: CASE WHEN i <= 2 THEN f[1][tok[i]] ELSE -1e30 END) AS sc, NULL::INT[] AS st FROM c
UNION ALL SELECT id, fr + 1, list_transform(o, lambda x: list_max(x[1:3]) + x[4]), list_transform(o, lambda x: (list_position(x[1:3], list_max(x[1:3])) - 1)::INT) FROM (SELECT v.id, fr, list_transform(range(1, len(tok) + 1),
 lambda i: [sc[i], CASE WHEN i > 1 THEN sc[i - 1] ELSE -1e30 END, CASE WHEN i % 2 = 0 AND i > 2 AND tok[i] <> tok[i - 2] THEN sc[i - 2] ELSE -1e30 END, f[fr + 1][tok[i]]]) AS o FROM v JOIN c ON c.id = v.id WHERE fr < len(f))),
z AS (SELECT v.id, fr, CASE WHEN sc[-1] >= sc[-2] THEN len(sc) ELSE len(sc) - 1 END AS i FROM v JOIN c ON c.id = v.id WHERE fr = len(f) AND greatest(sc[-1], sc[-2]) > -5e29
UNION ALL SELECT z.id, z.fr - 1, z.i - v.st[z.i] FROM z JOIN v ON v.id = z.id AND v.fr = z.fr WHERE z.fr > 1),
g AS (SELECT z.id, i, max(f[fr][tok[i]] - list_max(f[fr][2:])) AS lpr FROM z JOIN c ON c.id = z.id WHERE i % 2 = 0 GROUP BY ALL), p AS (SELECT id, avg(lpr) AS lpr FROM g GROUP BY id)"""


@query(f"""WITH RECURSIVE {_ANALYSIS_SQL}
SELECT p_partkey, array_to_string(b, ' ') AS heard, round(accuracy, 6) AS phone_accuracy, round(coalesce(lpr, -20), 6) AS lpr_mean, lpr IS NOT NULL AS aligned
FROM part JOIN pairs ON id = (p_name, p_partkey % (SELECT max(utt) + 1 FROM u)) JOIN y ON y.id = pairs.id LEFT JOIN p ON p.id = pairs.id""")
def q45_analyze(spark, d):
    """What was heard of each part's name, how much of it was right, and the mean score of its sounds."""
    found = sequences.analyze(_recorded(spark, d), VOCABULARY, wanted=["heard", "features", "phone_accuracy", "aligned"])
    return found.select("p_partkey", F.array_join("heard", " ").alias("heard"), r6("phone_accuracy").alias("phone_accuracy"), r6("features.gop_lpr_mean").alias("lpr_mean"), "aligned")


@query()
def q46_sound_features(spark, d):
    """The features of every expected sound, with scores standardised by the sounds said right."""
    rows = detector.sound_rows(once(sequences.analyze(_recorded(spark, d), VOCABULARY, sounds=True, wanted=["sounds"])), ["p_partkey"])
    rows = detector.standardized(rows, detector.sound_stats(rows, F.col("kind") == "match"))
    return rows.select("p_partkey", "word", "at", "phone", "kind", "heard", "top_other", *[r6(f).alias(f) for f in detector.FEATURES])


@query()
def q47_detector_feedback(spark, d):
    """Feedback from probabilities of sounds; here those of a fixed curve of the score."""
    found = once(sequences.analyze(_recorded(spark, d), VOCABULARY, sounds=True, wanted=["words", "sounds"]))
    p = detector.sound_rows(found, ["p_partkey"]).select("p_partkey", "at", (1 / (1 + F.exp(F.coalesce("lpr", F.lit(-20.0)) + 2))).alias("p"))
    judged = detector.decided(found, p, ["p_partkey"], red=0.7, yellow=0.3)
    return judged.select("p_partkey", F.array_join("tips", ",").alias("tips"), F.array_join(F.transform("words", lambda w: P.level_color(w["level"])), ",").alias("colors"), r6(reports.reported_accuracy(F.col("words"))).alias("accuracy"))


@query("""SELECT pair, count(*) AS n FROM (SELECT p_partkey, unnest(ws) AS pair, generate_subscripts(ws, 1) AS i FROM (SELECT p_partkey, string_split(p_type, ' ') AS ws FROM part)) GROUP BY pair ORDER BY n DESC, min((p_partkey, i)) LIMIT 7""")
def q48_top_pairs(spark, d):
    return reports.top_pairs(table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("ws")), "ws", "p_partkey", 7)


def _annotated(spark, d):
    """``_word_eval`` where the expert heard v for w in every wrong word."""
    truth = F.array(F.struct(F.lit("sub").alias("kind"), F.lit("w").alias("expected"), F.lit("v").alias("heard"), F.lit("w").alias("tip"), F.lit(False).alias("hidden")))
    none = F.array().cast(f"array<{issue_type}>")
    rows = _word_eval(spark, d).withColumn("expert_errors", F.when(F.coalesce("expert_wrong", F.lit(False)), truth).otherwise(none))
    return selection.apply_gop(rows, -4.0, -2.0)


_STANDS = "issue AND (gop IS NULL OR gop < CASE WHEN tip THEN -2 ELSE -4 END)"
_ANNOTATED_SQL = f"{_WORDS_SQL}, w AS (SELECT *, {_STANDS} AS f, grp = 'turkish' AS turkish FROM l)"


@query(f"""WITH {_ANNOTATED_SQL}, x AS (SELECT count(*) FILTER (wrong) AS errors, count(*) FILTER (wrong AND f) AS found, count(*) FILTER (f AND tip) AS reports, count(*) FILTER (f AND tip AND wrong) AS ok FROM w WHERE turkish AND wrong IS NOT NULL)
SELECT tip, ordinal::INT AS ordinal, CASE WHEN tip = 'w' THEN errors ELSE 0 END AS errors, CASE WHEN tip = 'w' THEN found ELSE 0 END AS found, CASE WHEN tip = 'w' THEN reports ELSE 0 END AS reports, CASE WHEN tip = 'w' THEN ok ELSE 0 END AS "right", 0::BIGINT AS hidden_reports, 0::BIGINT AS hidden_right
FROM x, (SELECT unnest({reports.I.TIP_ORDER}) AS tip, generate_subscripts({reports.I.TIP_ORDER}, 1) - 1 AS ordinal)""")
def q49_pattern_stats(spark, d):
    return reports.pattern_stats(_annotated(spark, d))


@query(f"""WITH {_ANNOTATED_SQL} SELECT 'w' AS tip, 2::INT AS ordinal, count(*) AS words, round(avg(f::INT), 6) AS word_caught, round(avg((f AND tip)::INT), 6) AS right_tip, count(*) AS errors, round(avg(f::INT), 6) AS error_caught, count(*) FILTER (issue AND NOT f) AS hidden_by_gop FROM w WHERE turkish AND wrong""")
def q50_pattern_table(spark, d):
    table_ = reports.pattern_table(_annotated(spark, d).where("grp = 'turkish' and expert_wrong is not null"))
    return table_.withColumns({c: r6(c) for c in ("word_caught", "right_tip", "error_caught")})


@query(f"""WITH {_ANNOTATED_SQL}, k AS (SELECT unnest([true, false]) AS t), x AS (SELECT t, count(*) FILTER (turkish AND f AND tip = t) AS words, count(*) FILTER (turkish AND f AND tip = t AND wrong) AS wrong_words, count(*) FILTER (NOT turkish AND NOT wrong AND f AND tip = t) AS native_words, count(*) FILTER (NOT turkish AND NOT wrong) AS native_correct_words FROM w, k WHERE wrong IS NOT NULL GROUP BY t)
SELECT CASE WHEN t THEN 'heard pattern' ELSE 'other difference' END AS type, words, wrong_words, words AS reports, wrong_words AS on_expert_sound, CASE WHEN t THEN wrong_words END AS right_pattern, native_words, native_correct_words FROM x
UNION ALL SELECT 'hidden pattern', 0, 0, 0, 0, 0, 0, native_correct_words FROM x WHERE t""")
def q51_report_types(spark, d):
    return reports.report_types(_annotated(spark, d))


_WITHIN = """b AS (SELECT unnest(range({n})) AS b), u AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {unit}) - 1 AS k, count(*) OVER (PARTITION BY {by}) AS n FROM units),
r AS (SELECT {by}, b, (((b * 1103515245 + k * 12345 + 1 * 69069) % 2147483647) * 48271 % 2147483647) % n AS k FROM u, b)"""
_RATE_SQL = "CASE WHEN sum({b}) = 0 THEN 0 ELSE sum({a}) / sum({b}) END"


@query(f"""WITH {_ANNOTATED_SQL}, labelled AS (SELECT 'main' AS version, grp, speaker, wrong, f FROM w UNION ALL SELECT 'raw', grp, speaker, gop < -5, f FROM w),
units AS (SELECT version, grp, speaker, count(*) FILTER (wrong AND f) AS tp, count(*) FILTER (NOT wrong AND f) AS fp, count(*) FILTER (wrong AND NOT f) AS fn, count(*) FILTER (NOT wrong AND NOT f) AS tn FROM labelled WHERE wrong IS NOT NULL GROUP BY ALL), {_WITHIN.format(n=2000, by="version, grp", unit="speaker")},
e AS (SELECT version, grp, b, {_RATE_SQL.format(a="tp", b="tp + fn")} AS x, {_RATE_SQL.format(a="tp", b="tp + fp")} AS y FROM r JOIN u USING (version, grp, k) GROUP BY version, grp, b),
c AS (SELECT version, grp, round(quantile_cont(x, 0.025), 6) AS recall_low, round(quantile_cont(x, 0.975), 6) AS recall_high, round(quantile_cont(y, 0.025), 6) AS precision_low, round(quantile_cont(y, 0.975), 6) AS precision_high FROM e GROUP BY ALL)
SELECT version, grp, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, count(*) AS speakers, round({_RATE_SQL.format(a="tp", b="tp + fn")}, 6) AS recall, any_value(recall_low) AS recall_low, any_value(recall_high) AS recall_high, any_value(precision_low) AS precision_low, any_value(precision_high) AS precision_high FROM units JOIN c USING (version, grp) GROUP BY version, grp""")
def q52_detection_intervals(spark, d):
    rows = _annotated(spark, d).withColumn("raw", F.col("gop") < -5)
    found = reports.detection_with_intervals(rows, {"main": "expert_wrong", "raw": "raw"})
    return found.select("version", "grp", "tp", "fp", "fn", "tn", "speakers", *[r6(c).alias(c) for c in ("recall", "recall_low", "recall_high", "precision_low", "precision_high")])


def _units(rows):
    """Units of two metrics: recall of Turkish words, false alarm of native ones."""
    metric = F.when(F.col("grp") == "turkish", "Turkish: recall").otherwise("English: false alarm")
    statistic = F.when(F.col("grp") == "turkish", "recall").otherwise("false_alarm")
    counts = M.confusion(rows.select(metric.alias("metric"), statistic.alias("statistic"), "speaker", "expert_wrong", "flagged"), F.col("expert_wrong"), F.col("flagged"), "metric", "statistic", "speaker")
    return counts.select("metric", "statistic", "speaker", *[F.col(c).alias(f"x{i}") for i, c in enumerate(("tp", "fp", "fn", "tn"))])


@query(f"""WITH {_WORDS_SQL}, w AS (SELECT *, issue AND (gop IS NULL OR gop < CASE WHEN tip THEN -4 ELSE -6 END) AS fa, issue AND (gop IS NULL OR gop < CASE WHEN tip THEN -2 ELSE -4 END) AS fb, wrong = (grp = 'turkish') AS base FROM l WHERE wrong IS NOT NULL),
units AS (SELECT CASE WHEN grp = 'turkish' THEN 'Turkish: recall' ELSE 'English: false alarm' END AS metric, speaker, count(*) FILTER (base AND fa) AS a, count(*) FILTER (base AND fb) AS x, count(*) FILTER (base) AS z FROM w GROUP BY ALL), {_WITHIN.format(n=2000, by="metric", unit="speaker")},
e AS (SELECT metric, b, {_RATE_SQL.format(a="x", b="z")} - {_RATE_SQL.format(a="a", b="z")} AS s FROM r JOIN u USING (metric, k) GROUP BY metric, b), c AS (SELECT metric, quantile_cont(s, 0.025) AS low, quantile_cont(s, 0.975) AS high FROM e GROUP BY metric)
SELECT metric, count(*) AS speakers, round(sum(x) / sum(z) - sum(a) / sum(z), 6) AS diff, round(any_value(low), 6) AS diff_low, round(any_value(high), 6) AS diff_high, any_value(low) > 0 OR any_value(high) < 0 AS real FROM units JOIN c USING (metric) GROUP BY metric""")
def q53_compare_systems(spark, d):
    rows = _word_eval(spark, d)
    found = reports.compare_systems(_units(selection.apply_gop(rows, -6.0, -4.0)), _units(selection.apply_gop(rows, -4.0, -2.0)))
    return found.select("metric", "speakers", *[r6(c).alias(c) for c in ("diff", "diff_low", "diff_high")], "real")


@query(f"""WITH t AS (SELECT user_id % 20 AS unit, round(value) AS x, event_type = 'error' AS wrong FROM events), units AS (SELECT DISTINCT unit FROM t), {_DRAWS.format(unit="unit")},
d AS (SELECT b, unit, count(*) AS w FROM r JOIN u USING (k) GROUP BY ALL UNION ALL SELECT -1, unit, 1 FROM units), steps AS (SELECT unit, x, count(*) FILTER (wrong) AS p, count(*) FILTER (NOT wrong) AS n FROM t GROUP BY ALL),
q AS (SELECT b, x, sum(p * w) AS p, sum(n * w) AS n FROM steps JOIN d USING (unit) GROUP BY ALL), o AS (SELECT *, sum(n) OVER (PARTITION BY b ORDER BY x) - n AS below FROM q), e AS (SELECT b, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auc FROM o GROUP BY b)
SELECT round(max(auc) FILTER (b < 0), 6) AS auc, round(quantile_cont(auc, 0.025) FILTER (b >= 0), 6) AS low, round(quantile_cont(auc, 0.975) FILTER (b >= 0), 6) AS high FROM e""")
def q54_auc_interval(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("unit"), F.round("value").alias("x"), (F.col("event_type") == "error").alias("wrong"))
    return resampling.auc_interval(rows, "unit", "x", F.col("wrong")).select(*[r6(c).alias(c) for c in ("auc", "low", "high")])


_HASHED = "{} * 48271 % 2147483647"


@query(f"""WITH c AS (SELECT count(DISTINCT label) AS c FROM embeddings), k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASHED.format("vec_id")}, vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n, 777 // c AS q FROM embeddings, c)
SELECT * FROM (SELECT vec_id, label, q // n + CASE WHEN k < q % n THEN 1 ELSE 0 END AS copies FROM k) WHERE copies > 0""")
def q55_balanced_draws(spark, d):
    return resampling.balanced_draws(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", F.pmod(F.col("vec_id") * 48271, F.lit(2147483647)), 777)


@query(f"""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_HASHED.format("doc_id")}, doc_id) <= 5""")
def q56_pick_per_stratum(spark, d):
    return resampling.pick_per_stratum(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", F.pmod(F.col("doc_id") * 48271, F.lit(2147483647)), 5)


@query("""SELECT g, count(*) AS recordings, round(sum(levenshtein(p_name, p_type)) / sum(length(p_name)), 6) AS per_vs_heard, round(sum(levenshtein(p_brand, p_type)) / sum(length(p_brand)), 6) AS per_vs_expected, round(sum(levenshtein(p_name, p_type)) / sum(length(p_name)) - sum(levenshtein(p_brand, p_type)) / sum(length(p_brand)), 6) AS gap FROM (SELECT *, p_size % 5 AS g FROM part) GROUP BY g""")
def q57_canonical_bias(spark, d):
    rows = table(spark, d, "part").select((F.col("p_size") % 5).alias("g"), *[F.split(c, "").alias(n) for c, n in (("p_type", "recognized"), ("p_name", "heard"), ("p_brand", "expected"))])
    return reports.canonical_bias(rows, "recognized", "heard", "expected", "g").withColumns({c: r6(c) for c in ("per_vs_heard", "per_vs_expected", "gap")})


@query("""WITH t AS (SELECT o_orderpriority AS l1, o_orderstatus AS e, ['O', 'F', 'P'][o_orderkey % 3 + 1] AS p, ['O', 'F', 'P'][o_custkey % 3 + 1] AS r FROM orders),
c AS (SELECT l1, count(*) AS sentences, round(avg((p <> r)::INT), 6) AS per, round(avg((e <> r)::INT), 6) AS per_vs_expected, count(*) FILTER (p = e AND r = e) AS ta, count(*) FILTER (p = e AND r <> e) AS fr, count(*) FILTER (p <> e AND r = e) AS fa, count(*) FILTER (p <> e AND r <> e) AS tr, count(*) FILTER (p <> e AND r = p) AS diagnosed FROM t GROUP BY ROLLUP (l1))
SELECT *, round(tr / (tr + fr), 6) AS precision, round(tr / (tr + fa), 6) AS recall, round(2 * tr / (2 * tr + fr + fa), 6) AS f1, round(diagnosed / tr, 6) AS diagnosis_accuracy, round(fr / (ta + fr), 6) AS false_rejection FROM c""")
def q58_recognizer_report(spark, d):
    pick = lambda key: F.array(F.element_at(F.array(*map(F.lit, "OFP")), (F.col(key) % 3 + 1).cast("int")))
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("l1"), F.array("o_orderstatus").alias("expected"), pick("o_orderkey").alias("perceived"), pick("o_custkey").alias("recognized"), F.array(F.lit(False)).alias("function"))
    found = reports.recognizer_report(rows)
    return found.withColumns({c: r6(c) for c in ("per", "per_vs_expected", "precision", "recall", "f1", "diagnosis_accuracy", "false_rejection")})


@query("""WITH e AS (SELECT l_orderkey, l_linenumber AS i, ['sub', 'del', 'ins'][l_linenumber % 3 + 1] AS kind, l_linestatus || ' → ' || CASE WHEN l_linenumber % 3 = 1 THEN '-' ELSE l_returnflag END AS pair FROM lineitem WHERE l_returnflag <> 'N')
SELECT 'kind' AS section, kind AS name, count(*) AS n FROM e GROUP BY kind UNION ALL (SELECT 'pair', pair, count(*) FROM e GROUP BY pair ORDER BY count(*) DESC, min((l_orderkey, i)) LIMIT 20) UNION ALL SELECT 'sentences', 'with errors', count(DISTINCT l_orderkey) FROM e""")
def q59_error_report(spark, d):
    """Orders as sentences, their lines with an error as annotations."""
    kind = F.element_at(F.array(*map(F.lit, ("sub", "del", "ins"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    error = F.array(kind, F.col("l_linestatus"), F.when(F.col("l_linenumber") % 3 != 1, F.col("l_returnflag")), F.lit(None).cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "N", F.struct("l_linenumber", error.alias("e"))))), lambda x: x["e"])
    found = reports.error_report(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(listed.alias("errors"), F.lit(1.0).alias("seconds")))
    named = lambda df, section, name: df.select(F.lit(section).alias("section"), name.alias("name"), "n")
    some = found["totals"].select(F.lit("sentences").alias("section"), F.lit("with errors").alias("name"), F.col("sentences_with_errors").alias("n"))
    return named(found["by_kind"], "kind", F.col("kind")).unionByName(named(found["top_pairs"], "pair", F.col("pair"))).unionByName(some)


@query("""WITH t AS (SELECT l_returnflag || l_linestatus AS phone, l_quantity AS lpp, l_discount * 100 AS lpr FROM lineitem WHERE l_linenumber < 5)
SELECT phone, grouping(phone)::TINYINT AS is_all, count(*) AS n, round(avg(lpp), 6) AS lpp_mean, round(greatest(stddev_pop(lpp), 0.25), 6) AS lpp_std, round(avg(lpr), 6) AS lpr_mean, round(greatest(stddev_pop(lpr), 0.25), 6) AS lpr_std FROM t GROUP BY ROLLUP (phone) HAVING grouping(phone) = 1 OR count(*) >= 20""")
def q60_sound_stats(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("phone"), F.col("l_quantity").alias("lpp"), (F.col("l_discount") * 100).alias("lpr"), "l_linenumber")
    found = detector.sound_stats(rows, F.col("l_linenumber") < 5)
    return found.withColumns({c: r6(c) for c in ("lpp_mean", "lpp_std", "lpr_mean", "lpr_std")})


@query(f"""WITH {_ANNOTATED_SQL} SELECT threshold, count(*) FILTER (gop + 1 > threshold AND coalesce(wrong, false)) AS "right", count(*) FILTER (gop + 1 > threshold) AS reports FROM w, (SELECT unnest([0, -2, -4, -6])::DOUBLE AS threshold) WHERE turkish GROUP BY threshold""")
def q61_hidden_w_precision(spark, d):
    return reports.hidden_w_precision(_annotated(spark, d).withColumn("w_margin", F.col("gop") + 1), [0, -2, -4, -6])


@query(f"""WITH {_WORDS_SQL} SELECT speaker, word_idx, gop FROM l WHERE grp = 'english' AND NOT wrong AND issue AND gop < CASE WHEN tip THEN -2 ELSE -4 END AND NOT gop < CASE WHEN tip THEN -4 ELSE -6 END ORDER BY speaker, word_idx LIMIT 10""")
def q62_new_false_alarms(spark, d):
    rows = _word_eval(spark, d)
    return reports.new_false_alarms(selection.apply_gop(rows, -6.0, -4.0), selection.apply_gop(rows, -4.0, -2.0), 10).select("speaker", "word_idx", "gop")


@query(f"""WITH {_ANNOTATED_SQL} SELECT speaker, count(*) FILTER (wrong AND f) AS found, count(*) FILTER (wrong) AS errors FROM w WHERE wrong IS NOT NULL GROUP BY speaker""")
def q63_error_units(spark, d):
    return reports.error_units(_annotated(spark, d))


_ERRORS_SQL = """e AS (SELECT l_orderkey AS k, l_returnflag AS f, 'x' || (min(l_linenumber) % 3) AS h FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), o AS (SELECT l_orderkey AS k, l_returnflag AS f, 'x' || (min(l_linenumber) % 3) AS h FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
j AS (SELECT e.*, (o.f IS NOT NULL)::INT AS found, coalesce(o.h = e.h, false)::INT AS exact FROM e LEFT JOIN o USING (k, f))"""


def _order_errors(spark, d):
    """Orders as words: an expert's error for each flag of shipped lines, a report for each flag of open ones."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_returnflag").agg(F.min("l_linenumber").alias("n"))
    tip = F.when(F.col("l_returnflag") != "N", F.lower("l_returnflag"))
    error = F.struct(F.lit("sub").alias("kind"), F.col("l_returnflag").alias("expected"), F.concat(F.lit("x"), F.col("n") % 3).alias("heard"), tip.alias("tip"), F.lit(False).alias("hidden"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == s, error)))
    return lines.groupBy("l_orderkey").agg(side("F").alias("expert_errors"), side("O").alias("our_errors"))


@query(f"""WITH {_ERRORS_SQL}, w AS (SELECT k, count(*) AS n, sum(found) AS s FROM j GROUP BY k) SELECT x.*, multi_error_words, multi_all, multi_some, multi_none FROM
(SELECT count(*) AS expert_errors, sum(found)::BIGINT AS found, sum(exact)::BIGINT AS found_exact, round(sum(found) / count(*), 6) AS catch, round(sum(exact) / count(*), 6) AS exact FROM j) x,
(SELECT count(*) FILTER (n >= 2) AS multi_error_words, count(*) FILTER (n >= 2 AND s = n) AS multi_all, count(*) FILTER (n >= 2 AND s > 0 AND s < n) AS multi_some, count(*) FILTER (n >= 2 AND s = 0) AS multi_none FROM w)""")
def q64_error_level_catch(spark, d):
    return evaluation.error_level_catch(_order_errors(spark, d)).withColumns({c: r6(c) for c in ("catch", "exact")})


@query(f"""WITH {_ERRORS_SQL} SELECT lower(f) AS tip, count(*) AS errors, count(*) FILTER (found = 1) AS found FROM j WHERE f <> 'N' GROUP BY f""")
def q65_catch_by_tip(spark, d):
    return evaluation.catch_by_tip(_order_errors(spark, d))


@query("""WITH u AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i, count(*) OVER () AS cs FROM (SELECT DISTINCT event_type FROM events)),
r AS (SELECT d, (((d * 1103515245 + 3 * 69069) % 2147483647) * 48271 % 2147483647) AS x, (((d * 1103515245 + 12345 + 3 * 69069) % 2147483647) * 48271 % 2147483647) AS y FROM (SELECT unnest(range(5000)) AS d))
SELECT d AS draw, event_id, event_type FROM r JOIN c ON r.x % c.cs = c.i JOIN u USING (event_type) WHERE r.y % u.n = u.k""")
def q66_balanced_sample(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    return resampling.balanced_sample(rows, "event_type", "event_id", 5000, 3).select("draw", "event_id", "event_type")


_SCORED_SQL = """s AS (SELECT o_custkey % 40 AS speaker, l_tax * 200 AS accuracy, l_quantity / 50 AS our_score, l_returnflag = 'R' AS flagged, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (FROM s WHERE last < 7)"""


def _scored_words(spark, d):
    """Orders as utterances and their lines as words; experts have scored the first six words only."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    issue = F.struct(F.lit("sub").alias("kind"), F.lit("w").alias("expected"), F.lit("v").alias("heard"), F.lit("w").alias("tip"), F.lit(False).alias("hidden"))
    issues = F.when(F.col("l_returnflag") == "R", F.array(issue)).otherwise(F.array().cast(f"array<{issue_type}>"))
    word = F.struct("l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("score"), issues.alias("issues"), (F.col("l_tax") * 200).alias("accuracy"))
    both = lines.groupBy("l_orderkey", F.pmod("o_custkey", F.lit(40)).alias("speaker")).agg(F.array_sort(F.collect_list(word)).alias("words"))
    human = both.withColumn("words", F.filter("words", lambda w: w["l_linenumber"] < 7))
    return evaluation.scored_words(both.drop("speaker"), human, ["l_orderkey"])


@query(f"""WITH {_SCORED_SQL}, c AS (SELECT count(*) FILTER (accuracy < 10 AND flagged) AS tp, count(*) FILTER (accuracy >= 10 AND flagged) AS fp, count(*) FILTER (accuracy < 10 AND NOT flagged) AS fn, count(*) FILTER (accuracy >= 10 AND NOT flagged) AS tn, round(corr(our_score, accuracy), 6) AS pcc FROM w)
SELECT *, tp + fp + fn + tn AS words, tp + fn AS expert_wrong, round(fp / (fp + tn), 6) AS false_alarm, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def q67_word_detection(spark, d):
    return evaluation.word_detection(_scored_words(spark, d)).withColumns({c: r6(c) for c in ("false_alarm", "recall", "precision", "f1", "pcc")})


@query(f"""WITH {_SCORED_SQL} SELECT speaker, count(*) FILTER (accuracy < 10 AND flagged) AS tp, count(*) FILTER (accuracy >= 10 AND flagged) AS fp, count(*) FILTER (accuracy < 10 AND NOT flagged) AS fn, count(*) FILTER (accuracy >= 10 AND NOT flagged) AS tn FROM w GROUP BY speaker""")
def q68_confusion_by_speaker(spark, d):
    return evaluation.confusion_by_speaker(_scored_words(spark, d))


_BANDS_SQL = """t AS (SELECT event_id, 's' || (user_id % 24) AS speaker, round(value) AS p, event_type = 'error' AS wrong, event_type = 'purchase' AS extra, user_id % 2 = 0 AS t FROM events), o AS (SELECT t, speaker, (row_number() OVER (PARTITION BY t ORDER BY speaker) - 1) % 6 AS fold FROM (SELECT DISTINCT t, speaker FROM t)),
x AS (SELECT t.*, fold FROM t JOIN o USING (t, speaker)), h AS (SELECT DISTINCT fold AS held FROM o), c AS (SELECT DISTINCT held, p FROM x, h WHERE fold <> held UNION SELECT held, 1.01 FROM h),
s AS (SELECT held, c.p AS x, count(*) FILTER (t AND x.p >= c.p) AS tn, count(*) FILTER (t AND wrong AND x.p >= c.p) AS tw, count(*) FILTER (t AND (x.p >= c.p OR extra)) AS yn, count(*) FILTER (t AND wrong AND (x.p >= c.p OR extra)) AS yw,
count(*) FILTER (NOT t AND NOT wrong AND (x.p >= c.p OR extra)) AS ef, count(*) FILTER (NOT t AND NOT wrong) AS en FROM x JOIN c ON fold <> held WHERE c.p <> 1.01 GROUP BY ALL), r AS (SELECT held, min(x) FILTER (tn > 0 AND tw / tn >= 0.21 AND ef / en <= 0.6) AS red FROM s GROUP BY held),
b AS (SELECT held, coalesce(any_value(red), 1.01) AS red, coalesce(min(x) FILTER (x <= coalesce(red, 1.01) AND yn > 0 AND yw / yn >= 0.1 AND ef / en <= 0.6), any_value(red), 1.01) AS yellow FROM s JOIN r USING (held) GROUP BY held)"""


@query(f"""WITH {_BANDS_SQL} SELECT fold::INT AS fold, red, yellow, count(*) AS words, count(*) FILTER (p >= yellow OR extra) AS flagged, count(*) FILTER (p >= red) AS red_flagged, count(*) FILTER (wrong AND (p >= yellow OR extra)) AS hits FROM x JOIN b ON held = fold GROUP BY ALL""")
def q69_held_out_bands(spark, d):
    grp = F.when(F.col("user_id") % 2 == 0, "turkish").otherwise("english")
    rows = table(spark, d, "events").select(grp.alias("grp"), F.concat(F.lit("s"), F.col("user_id") % 24).alias("speaker"), F.round("value").alias("p"), (F.col("event_type") == "error").alias("wrong"), (F.col("event_type") == "purchase").alias("extra"))
    out = evaluation.held_out_bands(rows, red_precision=0.21, min_precision=0.1, max_false_alarm=0.6)
    return out.groupBy("fold", "red", "yellow").agg(F.count("*").alias("words"), F.count_if("flagged").alias("flagged"), F.count_if("red_flagged").alias("red_flagged"), F.count_if(F.col("wrong") & F.col("flagged")).alias("hits"))


@query(f"""WITH RECURSIVE {_PARTS_SQL}, {_MATRIX_SQL}, s AS (SELECT id, len(a) AS i, len(b) AS j, NULL::VARCHAR AS kind FROM pairs
UNION ALL SELECT id, i - (k <> 'ins')::INT, j - (k <> 'del')::INT, k FROM (SELECT s.id, s.i, s.j, CASE WHEN s.i = 0 THEN 'ins' WHEN s.j = 0 THEN 'del'
 WHEN u.h[s.j] + {_LETTER_COST.format("m.a[s.i]", "m.b[s.j]")} <= least(u.h[s.j + 1] + 1, m.h[s.j] + 1) THEN CASE WHEN m.a[s.i] = m.b[s.j] THEN 'match' ELSE 'sub' END
 WHEN u.h[s.j + 1] + 1 <= m.h[s.j] + 1 THEN 'del' ELSE 'ins' END AS k FROM s JOIN m ON m.id = s.id AND m.i = s.i LEFT JOIN m u ON u.id = s.id AND u.i = s.i - 1 WHERE s.i + s.j > 0)),
g AS (SELECT count(*) FILTER (kind = 'match') AS ta, count(*) FILTER (kind IN ('sub', 'del')) + count(DISTINCT (id, i)) FILTER (kind = 'ins') AS fr FROM s)
SELECT (SELECT count(*) FROM part) AS sentences, round((SELECT sum(levenshtein(p_type, p_name)) / sum(length(p_type)) FROM part), 6) AS per, round(fr / (ta + fr), 6) AS false_rejection_rate FROM g""")
def q70_native_report(spark, d):
    """The letters of a part's type as a native sentence, those of its name as what was recognised: with additions."""
    rows = table(spark, d, "part").select(F.split("p_type", "").alias("expected"), F.split("p_name", "").alias("recognized"), F.lit(None).cast("array<boolean>").alias("function"))
    return evaluation.native_report(rows).withColumns({c: r6(c) for c in ("per", "false_rejection_rate")})


@query("""SELECT user_id, count(*) AS n, round(avg(value), 6) AS value_mean, min(value) AS value_min, max(value) AS value_max, round(avg((event_type = 'error')::INT), 6) AS share, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id""")
def q71_speaker_summary(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    summary = evaluation.speaker_summary(rows, ["user_id"], ["value"], F.col("event_type") == "error")
    first = evaluation.first_per(rows, "user_id", "event_id").select("user_id", F.col("event_type").alias("first_type"))
    return summary.join(first, "user_id").withColumns({c: r6(c) for c in ("value_mean", "share")})


@query("""WITH v AS (SELECT DISTINCT user_id, floor(value / 20)::BIGINT AS word FROM events WHERE event_type = 'click'), d AS (SELECT event_id, word, greatest(0, 20 * word - round(value), round(value) - 20 * word - 20) AS distance FROM events JOIN v USING (user_id))
SELECT event_id, word, distance::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, word) AS k FROM d) WHERE k = 1""")
def q72_shared_borders(spark, d):
    """Words that end where the next one starts, as in annotation grids; many points lie on a border."""
    events = table(spark, d, "events")
    words = events.where("event_type = 'click'").select("user_id", F.floor(F.col("value") / 20).alias("word")).distinct().withColumns({"s": 20.0 * F.col("word"), "e": 20.0 * F.col("word") + 20})
    found = J.nearest_interval(events.select("event_id", "user_id", F.round("value").alias("at")), words, "user_id", "at", "s", "e", "word")
    return found.where("word is not null").select("event_id", "word", F.col("distance").cast("double").alias("distance"))


#: What an expert heard in a third of the parts instead of some sounds.
_SAID = {"w": "v", "v": "w", "æ": "ɛ", "ɪ": "iː", "iː": "ɪ", "d": "t", "z": "s", "ɡ": "k"}
_PAIRS = "[('w', 'w', ['v', 'ɹ'], false), ('v', 'v', ['w'], false), ('iː', 'long_ee', ['ɪ'], false), ('ɪ', 'short_i', ['iː'], false), ('æ', 'ae', ['ɛ'], false), ('b', 'final_voicing', ['p'], true), ('d', 'final_voicing', ['t'], true), ('ɡ', 'final_voicing', ['k'], true), ('v', 'final_voicing', ['f'], true), ('z', 'final_voicing', ['s'], true)]"


@query(f"""WITH RECURSIVE {_ANALYSIS_SQL},
places AS (SELECT p_name, utt, unnest(ws) AS w, generate_subscripts(ws, 1) AS word FROM w),
sounds AS (SELECT p_name, utt, word, w, unnest(w) AS e, generate_subscripts(w, 1) AS i FROM places),
kept AS (SELECT p_name, utt, word, e, row_number() OVER (PARTITION BY p_name, utt ORDER BY word, i) - 1 AS pos, target, row_number() OVER (PARTITION BY p_name, utt, word ORDER BY i) - 1 AS place FROM
 (SELECT *, row_number() OVER (PARTITION BY p_name, utt ORDER BY word, i) AS target, i = 1 OR e <> w[i - 1] AS new FROM sounds) WHERE new),
finals AS (SELECT *, place >= coalesce(max(CASE WHEN e IN ('æ', 'ɛ', 'ɪ', 'ʊ', 'ʌ', 'iː') THEN place + 1 END) OVER (PARTITION BY p_name, utt, word), 0) AS final FROM kept),
pats AS (SELECT x[1] AS e, x[2] AS tip, x[3] AS rivals, x[4] AS at_end FROM (SELECT unnest(list_transform({_PAIRS}, lambda x: row(x[1], x[2], x[3], x[4]))) AS x)),
margin AS (SELECT k.p_name, k.utt, k.pos, k.e, k.final, tip, max(list_max(list_transform(rivals, lambda r: f[fr][list_position(names, r) - 3])) - f[fr][tok[i]]) AS margin
 FROM finals k JOIN pats USING (e) JOIN z ON z.id = (k.p_name, k.utt) AND i = 2 * target JOIN c ON c.id = z.id, l WHERE NOT at_end OR k.final GROUP BY ALL),
items AS (SELECT p_partkey, tip AS pattern, margin, CASE WHEN p_size % 5 < 2 THEN 'english' ELSE 'turkish' END || p_brand AS speaker, p_size % 5 < 2 AS native, EXISTS (FROM s WHERE s.id = (g.p_name, g.utt) AND s.kind = 'match' AND s.i = g.pos) AS greedy,
 CASE WHEN p_size % 3 > 0 OR m.said IS NULL THEN 0 WHEN p_size % 5 < 2 THEN NULL WHEN (tip = 'final_voicing') = (m.said IN ('t', 's', 'k')) AND (tip <> 'final_voicing' OR g.final) THEN 1 END AS label
 FROM part JOIN margin g ON g.p_name = part.p_name AND g.utt = p_partkey % (SELECT max(utt) + 1 FROM u) LEFT JOIN (SELECT unnest({list(_SAID)}) AS e, unnest({list(_SAID.values())}) AS said) m USING (e)),
good AS (FROM items WHERE label IS NOT NULL), cnt AS (SELECT pattern, count(*) FILTER (label = 1) AS errors, count(*) FILTER (label = 0 AND NOT native) AS right_turkish, count(*) FILTER (label = 0 AND native) AS right_native, count(*) FILTER (label = 1 AND greedy) AS missed FROM good GROUP BY pattern),
units AS (SELECT DISTINCT pattern, speaker FROM good), {_WITHIN.format(n=2000, by="pattern", unit="speaker")},
d AS (SELECT pattern, b, speaker, count(*) AS w FROM r JOIN u USING (pattern, k) GROUP BY ALL UNION ALL SELECT pattern, -1, speaker, 1 FROM units),
steps AS (SELECT pattern, speaker, margin AS x, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM good GROUP BY ALL),
q2 AS (SELECT pattern, b, x, sum(p * w) AS p, sum(n * w) AS n FROM steps JOIN d USING (pattern, speaker) GROUP BY ALL), o2 AS (SELECT *, sum(n) OVER (PARTITION BY pattern, b ORDER BY x) - n AS below FROM q2),
e2 AS (SELECT pattern, b, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (below + n / 2)) / (sum(p) * sum(n)) END AS auc FROM o2 GROUP BY ALL),
f2 AS (SELECT pattern, round(max(auc) FILTER (b < 0), 6) AS auc, round(quantile_cont(auc, 0.025) FILTER (b >= 0), 6) AS low, round(quantile_cont(auc, 0.975) FILTER (b >= 0), 6) AS high FROM e2 GROUP BY pattern)
SELECT pattern, ordinal::INT AS ordinal, coalesce(errors, 0) AS errors, coalesce(right_turkish, 0) AS right_turkish, coalesce(right_native, 0) AS right_native, coalesce(missed, 0) AS missed, auc, CASE WHEN auc IS NOT NULL THEN low END AS low, CASE WHEN auc IS NOT NULL THEN high END AS high
FROM (SELECT unnest({[t for t in reports.I.TIP_ORDER if t != "epenthesis"]}) AS pattern, generate_subscripts({[t for t in reports.I.TIP_ORDER if t != "epenthesis"]}, 1) - 1 AS ordinal) LEFT JOIN cnt USING (pattern) LEFT JOIN f2 USING (pattern)""".replace("u AS (SELECT *, row_number() OVER (PARTITION BY pattern", "u2 AS (SELECT *, row_number() OVER (PARTITION BY pattern").replace("FROM u, b)", "FROM u2, b)").replace("FROM r JOIN u USING (pattern, k)", "FROM r2 JOIN u2 USING (pattern, k)").replace("\nr AS (SELECT pattern", "\nr2 AS (SELECT pattern").replace("b AS (SELECT unnest(range(2000)) AS b)", "b2 AS (SELECT unnest(range(2000)) AS b)").replace("FROM u2, b)", "FROM u2, b2)"))
def q73_pattern_margins(spark, d):
    """Parts' names said in frames of vectors; of a third of them an expert heard other sounds, and two speakers of five are native."""
    said = P.literal_map(_SAID)
    merged = lambda w: F.filter(w, lambda c, i: (i == 0) | (c != F.get(w, i - 1)))
    other = F.transform("raw", lambda w: F.transform(merged(w), lambda c: F.when(F.col("p_size") % 3 == 0, F.coalesce(F.try_element_at(said, c), c)).otherwise(c)))
    rows = _recorded(spark, d, "p_size", "p_brand").withColumn("heard_by_expert", other)
    native = F.col("p_size") % 5 < 2
    labelled = margins.labelled_sounds(sequences.analyze(rows, VOCABULARY, margins=True, wanted=["words"]), ["p_partkey", "p_size", "p_brand"], F.col("heard_by_expert"), ~native)
    items = margins.sound_items(labelled).withColumn("speaker", F.concat(F.when(native, "english").otherwise("turkish"), "p_brand"))
    found = margins.in_pattern_order(margins.pattern_margins(once(items), "speaker", native))
    return found.select("pattern", "ordinal", "errors", "right_turkish", "right_native", "missed", *[r6(c).alias(c) for c in ("auc", "low", "high")])


@query()
def q74_permutation_importance(spark, d):
    """How much the average precision of a fixed curve of the lines' numbers falls without each of them."""
    lines = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "R").alias("wrong"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_extendedprice") / 100_000).alias("price"), "l_discount", "l_tax",
        (F.datediff("l_shipdate", F.lit("1995-01-01")) / 1000).alias("shipped"),
    )
    curve = lambda df: df.withColumn("p", F.round(1 / (1 + F.exp(F.col("shipped") + F.col("l_discount") - F.col("quantity") / 10)), 3))
    return models.importance(curve, lines, ["quantity", "price", "l_discount", "l_tax", "shipped"], "wrong", "id", top=12)


@query()
def q75_compare_runs(spark, d):
    """Two systems over the same recordings, whose words an expert has scored by the part's size: runs, units and comparison."""
    rows = _recorded(spark, d)
    size = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.size(P.tokenize(F.lower("p_name"))).alias("n"))
    score = lambda k: F.struct(F.pmod(F.col("p_size") * 7 + k * 3, F.lit(11)).cast("double").alias("accuracy"))
    human = size.select("p_partkey", F.col("p_brand").alias("speaker"), F.transform(F.sequence(F.lit(1), "n"), score).alias("words"))
    runs = [experiments.run_scored(coach.System(name, settings=given), rows, human, VOCABULARY, ["p_partkey"])[1] for name, given in (("default", {}), ("general", {"gop": 0.0, "pattern": float("inf"), "hidden": {"w": -4.0, "ae": -2.0}}))]
    found = experiments.compare(runs[:1], runs[1:])
    return found.select("metric", "ordinal", "speakers", *[r6(c).alias(c) for c in ("a", "b", "diff", "diff_low", "diff_high")], "real")
