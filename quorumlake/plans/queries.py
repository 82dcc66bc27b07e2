"""Registered queries over the driver tables, with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import text as T
from quorumlake.operators import consensus as C
from quorumlake.operators import intervals as I
from quorumlake.operators import joins as J
from quorumlake.operators import lineage as L
from quorumlake.operators import metrics as M
from quorumlake.operators import sampling as X
from quorumlake.operators import sets as U
from quorumlake.operators import validate as V
from quorumlake.operators.lineage import cut_lineage
from quorumlake.streaming import gate as R

from .base import CLIPS, HOPS, KEYWORDS, OBS, SPANS, UTTS, WITHOUT_LAST, clips, hops, observations, spans, table, utterances, with_vectors, without_last

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable) -> Callable:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    from . import exchange, jobs  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import exchange, jobs  # noqa: F401

    return dict(_SQL)


VOTES = f"""WITH {OBS}, per AS (SELECT clip_id, lang, norm_text, count(*) AS n FROM obs WHERE usable AND norm_text <> '' GROUP BY ALL),
best AS (SELECT clip_id, max(n) AS top_votes, sum(n) AS clean, arg_min(norm_text, (-n, norm_text)) AS top_text FROM per GROUP BY clip_id),
votes AS (SELECT c.clip_id, c.lang, c.family, coalesce(b.top_votes, 0) AS top_votes, coalesce(b.clean, 0) AS clean, b.top_text FROM clips c LEFT JOIN best b USING (clip_id)),
marks AS (SELECT clip_id, sum(contains(norm_text, 'the')::INT) AS k0, sum(contains(norm_text, 'que')::INT) AS k1 FROM obs GROUP BY clip_id),
decided AS (SELECT v.*, CASE WHEN clean < 3 THEN 'unusable' WHEN top_votes = 3 THEN 'all_equal' WHEN top_votes < 2 THEN 'no_majority'
  WHEN (k0 > 0 AND k0 < 3) OR (k1 > 0 AND k1 < 3) THEN 'keyword_split' ELSE 'majority' END AS reason FROM votes v JOIN marks USING (clip_id)),
labels3 AS (SELECT *, reason IN ('all_equal', 'majority') AS mask, CASE reason WHEN 'all_equal' THEN 'three' WHEN 'majority' THEN 'two' ELSE 'uncertain' END AS tier FROM decided)"""


@query(f"{VOTES} SELECT lang, tier, reason, count(*) AS clips FROM labels3 GROUP BY ALL")
def a1_consensus_by_lang(spark, d):
    got = C.strict_quorum(observations(spark, d), KEYWORDS)
    return got.join(clips(spark, d).select("clip_id", "lang"), "clip_id").groupBy("lang", "tier", "reason").agg(F.count("*").alias("clips"))


#: Every 29th clip has a second row of its first observer.
AGAIN = "again AS (SELECT * FROM obs UNION ALL SELECT * FROM obs WHERE clip_id % 29 = 0 AND model = 0)"


def voted_again(spark, d):
    obs = observations(spark, d)
    return obs.unionByName(obs.where("clip_id % 29 = 0 and model = 0"))


@query(f"{VOTES} SELECT clip_id, mask AND clip_id % 29 <> 0 AS mask, CASE WHEN mask AND clip_id % 29 <> 0 THEN top_text END AS full_text, CASE WHEN clip_id % 29 = 0 THEN 0.0 WHEN reason = 'all_equal' THEN 1.0 WHEN reason = 'majority' THEN 0.5 ELSE 0.0 END::DOUBLE AS weight, CASE WHEN clip_id % 29 = 0 THEN 'model_roster' ELSE reason END AS reason FROM labels3")
def a1_strict_quorum(spark, d):
    return C.strict_quorum(voted_again(spark, d), KEYWORDS, roster=[0, 1, 2]).select("clip_id", "mask", "full_text", "weight", "reason")


INTENTS = ["positive", "near_miss", "hard_negative", "partial", "speech_negative", "song"]


@query(f"""WITH {OBS}, {AGAIN}, per AS (SELECT clip_id, norm_text, count(*) AS n FROM again WHERE usable AND norm_text <> '' GROUP BY ALL),
best AS (SELECT clip_id, max(n) AS top_votes, arg_min(norm_text, (-n, norm_text)) AS top_text FROM per GROUP BY clip_id),
k AS (SELECT clip_id, count(*) > count(DISTINCT model) AS twice, coalesce(bool_or((usable OR clip_id % 5 = 0) AND norm_text <> '' AND (regexp_matches(norm_text, 'q.*u.*e.*e.*n') OR regexp_matches(norm_text, 'z.*b.*l.*e'))), false) AS path FROM again GROUP BY clip_id),
i AS (SELECT clip_id, ['positive', 'near_miss', 'hard_negative', 'partial', 'speech_negative', 'song'][clip_id % 6 + 1] AS intent, CASE WHEN clip_id % 4 = 0 THEN 'zble' WHEN clip_id % 9 = 0 THEN 'other' ELSE 'queen' END AS keyword, clip_id % 19 <> 0 AS gen, frames < 100 AS flag FROM clips),
r AS (SELECT *, CASE WHEN twice THEN 'model_roster' WHEN NOT gen THEN 'generation_failed' WHEN coalesce(top_votes, 0) < 2 THEN 'no_quorum' WHEN flag THEN 'audio_flag'
 WHEN intent = 'positive' AND NOT (keyword <> 'other' AND contains(top_text, keyword)) THEN 'positive_unconfirmed' WHEN intent <> 'positive' AND path THEN 'negative_has_path'
 WHEN intent = 'song' THEN 'unsupported_intent' ELSE 'accepted' END AS reason FROM i JOIN k USING (clip_id) LEFT JOIN best USING (clip_id))
SELECT clip_id, reason, CASE WHEN reason <> 'accepted' THEN 0.0 WHEN top_votes = 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, CASE WHEN reason = 'accepted' THEN contains(top_text, 'queen')::INT END AS target_0 FROM r""")
def a2_intent_quorum(spark, d):
    at = F.col("clip_id")
    kind = F.get(F.array(*[F.lit(x) for x in INTENTS]), (at % 6).cast("int"))
    word = F.when(at % 4 == 0, "zble").when(at % 9 == 0, "other").otherwise("queen")
    intents = clips(spark, d).select("clip_id", kind.alias("intent"), word.alias("keyword"), (at % 19 != 0).alias("generated"), (F.col("frames") < 100).alias("flagged"))
    obs = voted_again(spark, d).withColumn("complete", at % 5 == 0)
    return C.intent_quorum(obs, intents, ["queen", "zble"], roster=[0, 1, 2]).select("clip_id", "reason", "weight", "target_0")


@query(f"""WITH {OBS}, {AGAIN} SELECT clip_id, count(norm_text) AS seen, sum((usable AND norm_text = spoken)::INT)::BIGINT AS hits,
CASE WHEN clip_id % 29 = 0 THEN 'model_roster' WHEN count(norm_text) < 3 THEN 'hold' WHEN sum((usable AND norm_text = spoken)::INT) = 3 THEN 'match' WHEN sum((usable AND norm_text = spoken)::INT) = 2 THEN 'review' ELSE 'mismatch' END AS state
FROM again WHERE NOT (clip_id % 11 = 0 AND model = 2) GROUP BY clip_id""")
def a3_exact_screen(spark, d):
    obs = voted_again(spark, d).where(~((F.col("clip_id") % 11 == 0) & (F.col("model") == 2)))
    return C.exact_screen(obs, clips(spark, d).select("clip_id", F.col("spoken").alias("target"))).select("clip_id", "seen", "hits", "state")


@query(f"""WITH {OBS}, p AS (SELECT clip_id, any_value(spoken) AS s, count(DISTINCT norm_text) AS k, min(norm_text) AS lo FROM obs GROUP BY clip_id)
SELECT CASE WHEN k = 1 AND lo = s THEN 'match_request' WHEN k = 1 THEN 'agree_other' WHEN k < 3 THEN 'two_agree' ELSE 'all_differ' END AS agreement, count(*) AS n FROM p GROUP BY 1""")
def a4_agreement_class(spark, d):
    return C.agreement_class(observations(spark, d), clips(spark, d).select("clip_id", F.col("spoken").alias("target"))).groupBy("agreement").agg(F.count("*").alias("n"))


@query(f"""WITH {OBS}, w AS (SELECT clip_id, any_value(spoken) AS s, max(norm_text) FILTER (WHERE model = 0) AS a, max(norm_text) FILTER (WHERE model = 1) AS b, bool_and(usable) FILTER (WHERE model < 2) AS ok FROM obs GROUP BY clip_id)
SELECT clip_id, CASE WHEN NOT ok THEN 'unresolved' WHEN a = b AND a = s THEN 'match' WHEN a = b THEN 'agree_mismatch' ELSE 'dispute' END AS state FROM w""")
def a5_two_model_state(spark, d):
    return C.two_model_state(observations(spark, d), clips(spark, d).select("clip_id", F.col("spoken").alias("target")), (0, 1)).select("clip_id", "state")


@query(f"""{VOTES}, h AS (SELECT clip_id, keyword, sum((usable AND contains(norm_text, keyword))::INT)::BIGINT AS hits FROM obs, (VALUES ('the'), ('que')) k(keyword) GROUP BY ALL)
SELECT keyword, CASE WHEN mask THEN CASE WHEN contains(top_text, keyword) THEN 'present' ELSE 'absent' END WHEN hits = 3 THEN 'present' ELSE 'unknown' END AS status, count(*) AS n, sum(hits)::BIGINT AS hits FROM h JOIN labels3 USING (clip_id) GROUP BY ALL""")
def a6_keyword_presence(spark, d):
    obs = observations(spark, d)
    words = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    got = C.keyword_presence(obs, C.strict_quorum(obs, KEYWORDS), words)
    return got.groupBy("keyword", "status").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


@query(f"""WITH {OBS}, pat(class, pattern, om) AS (VALUES (1, 'the.*', false), (1, 'th.* o.*', true), (2, '.*que.*', false), (2, 'a.*', true)),
v AS (SELECT clip_id, any_value(spoken) AS ph, sum((usable AND norm_text <> spoken AND norm_text LIKE '%zz%')::INT) AS rivals FROM obs GROUP BY clip_id),
m AS (SELECT clip_id, count(*) AS matches, min(class) AS class, bool_or(om) AS om FROM v JOIN pat ON regexp_full_match(ph, pattern) GROUP BY clip_id),
al AS (SELECT clip_id, count(*) AS votes FROM obs WHERE usable AND norm_text = spoken GROUP BY clip_id)
SELECT CASE WHEN rivals > 0 THEN 'competing_word' WHEN matches IS NULL THEN 'no_pattern' WHEN matches > 1 THEN 'ambiguous_pattern' WHEN om AND coalesce(votes, 0) < 3 THEN 'onset_needs_three' WHEN coalesce(votes, 0) < 2 THEN 'too_few_votes' ELSE 'admitted' END AS reason, count(*) AS n
FROM v LEFT JOIN m USING (clip_id) LEFT JOIN al USING (clip_id) GROUP BY 1""")
def a7_blind_admission(spark, d):
    obs = observations(spark, d)
    patterns = spark.createDataFrame([(1, "the.*", False), (1, "th.* o.*", True), (2, ".*que.*", False), (2, "a.*", True)], "class int, pattern string, onset_missing boolean")
    # here every spoken text is its own alias, under either class
    votes = obs.withColumn("norm_text", F.when(F.col("norm_text") == F.col("spoken"), "alias").otherwise(F.concat(F.lit("x"), "norm_text"))).withColumn("phones", F.col("spoken"))
    aliases = spark.createDataFrame([(1, "alias"), (2, "alias")], "class int, alias string")
    return C.blind_admission(votes, patterns, aliases, "zz").groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS has FROM lineitem GROUP BY 1), r AS (SELECT l.l_orderkey, l_shipdate < TIMESTAMP '1996-01-01' AS early, has FROM lineitem l JOIN g USING (l_orderkey))
SELECT CASE WHEN early THEN 'train' ELSE 'dev' END AS role, CASE WHEN has = ['A', 'N', 'R'] THEN 'kept' ELSE 'group_incomplete' END AS reason, count(*) AS n FROM r GROUP BY ALL""")
def a8_balanced_groups(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_returnflag").alias("label"), F.when(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"), "train").otherwise("dev").alias("role"))
    return C.balanced_groups(rows, ["A", "N", "R"]).groupBy("role", "reason").agg(F.count("*").alias("n"))


@query("""WITH g(lang, quality) AS (SELECT * FROM (VALUES ('en'), ('de'), ('fr'), ('es')) a(l), (VALUES (0), (1)) b(q) UNION ALL SELECT 'xx', 1), r AS (SELECT lang, quality, count(*) AS rows, count(DISTINCT source) AS families FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality)
SELECT lang, quality, coalesce(rows, 0) AS rows, coalesce(families, 0) AS families, coalesce(rows, 0) >= 20 AND coalesce(families, 0) >= 10 AS enough FROM g LEFT JOIN r USING (lang, quality)""")
def a9_minimum_counts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    cells = [(lang, q, 20, 10) for lang in ("en", "de", "fr", "es") for q in (0, 1)] + [("xx", 1, 20, 10)]
    want = spark.createDataFrame(cells, "lang string, quality int, min_rows int, min_families int")
    got = C.minimum_counts(rows, want, ["lang", "quality"], "source")
    return got.select("lang", "quality", "rows", "families", "enough")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count_if(o_totalprice > 200000) AS large FROM orders GROUP BY ALL")
def a10_status_counts(spark, d):
    return C.status_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"large": F.col("o_totalprice") > 200000})


@query("""SELECT event_type, CASE WHEN grouping(user_id) = 0 THEN 'user_id' WHEN grouping(k) = 0 THEN 'k' ELSE 'all' END AS "by", user_id, k, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, event_id % 4 AS k FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, user_id), (event_type, k))""")
def a11_event_rollup(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.col("event_id") % 4)
    return M.event_rollup(rows, ["event_type"], ["user_id", "k"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})


@query(f"""WITH {HOPS}, c AS (SELECT case_id, best, count(*) AS events, max(p) AS p FROM hops GROUP BY ALL)
SELECT best, count(*) AS cases, count_if(p >= 0.9) AS hits, count_if(p < 0.9) AS misses, count_if(events > 20) AS wrong, sum(greatest(events - 1, 0))::BIGINT AS extra FROM c GROUP BY best""")
def a12_outcome_counts(spark, d):
    per = hops(spark, d).groupBy("case_id", "best").agg(F.count("*").alias("events"), F.max("p").alias("p"))
    return M.outcome_counts(per, ["best"], F.col("p") >= 0.9, F.col("events") > 20, "events")


@query(f"""{VOTES}, h AS (SELECT v.*, CASE WHEN NOT mask THEN 'unknown' WHEN contains(top_text, 'the') THEN 'positive' ELSE 'negative' END AS state, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unknown' END AS human FROM labels3 v LEFT JOIN labels l ON v.clip_id = l.doc_id),
c AS (SELECT lang, count_if(human = 'positive' AND state = 'positive') AS tp, count_if(human = 'positive' AND state = 'negative') AS fn, count_if(human = 'negative' AND state = 'negative') AS tn, count_if(human = 'negative' AND state = 'positive') AS fp, count_if(human = 'positive' AND state = 'unknown') AS unknown_pos, count_if(human = 'negative' AND state = 'unknown') AS unknown_neg FROM h GROUP BY lang)
SELECT lang, tp, fn, tn, fp, unknown_pos, unknown_neg, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + fn + tn + fp) / nullif(tp + fn + tn + fp + unknown_pos + unknown_neg, 0), 6) AS coverage FROM c""")
def a13_known_confusion(spark, d):
    got = M.known_confusion(_human(spark, d), ["lang"], "state", "human")
    return got.select("lang", "tp", "fn", "tn", "fp", "unknown_pos", "unknown_neg", F.round("recall", 6).alias("recall"), F.round("coverage", 6).alias("coverage"))


@query(f"""{VOTES}, h AS (SELECT v.*, CASE WHEN NOT mask THEN 'unknown' WHEN contains(top_text, 'the') THEN 'positive' ELSE 'negative' END AS state, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'unknown' END AS human FROM labels3 v LEFT JOIN labels l ON v.clip_id = l.doc_id)
SELECT lang, clip_id, CASE state WHEN 'negative' THEN 'false_negative' ELSE 'false_positive' END AS error FROM h WHERE state <> human AND state <> 'unknown' AND human <> 'unknown'""")
def a13_known_errors(spark, d):
    return M.known_errors(_human(spark, d), ["lang"], "state", "human", "clip_id")


def _human(spark, d) -> DataFrame:
    votes = C.strict_quorum(observations(spark, d), KEYWORDS).join(clips(spark, d).select("clip_id", "lang"), "clip_id")
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("clip_id"), "quality")
    state = F.when(~F.col("mask"), "unknown").when(F.contains("full_text", F.lit("the")), "positive").otherwise("negative")
    human = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("unknown")
    return votes.join(gold, "clip_id", "left").withColumns({"state": state, "human": human})


@query(f"""WITH {OBS}, s AS (SELECT clip_id, lang, max(CASE WHEN NOT usable THEN 'unknown' WHEN contains(norm_text, 'the') THEN 'positive' ELSE 'negative' END) FILTER (WHERE model = 0) AS a, max(CASE WHEN NOT usable THEN 'unknown' WHEN contains(norm_text, 'an') THEN 'positive' ELSE 'negative' END) FILTER (WHERE model = 1) AS b FROM obs GROUP BY ALL),
h AS (SELECT s.*, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS human FROM s JOIN labels ON clip_id = doc_id WHERE quality IN (0, 1))
SELECT lang, count_if(a <> 'unknown' AND b <> 'unknown') AS both_known, count_if(a <> 'unknown' AND b <> 'unknown' AND a <> human AND b <> human) AS both_wrong, count_if(a <> 'unknown' AND b <> 'unknown' AND a <> b) AS disagree, count_if((a <> 'unknown') <> (b <> 'unknown')) AS one_unknown, count_if(a = 'unknown' AND b = 'unknown') AS both_unknown FROM h GROUP BY lang""")
def a14_paired_known(spark, d):
    obs = observations(spark, d)
    state = lambda m, w: F.max(F.when(F.col("model") == m, F.when(~F.col("usable"), "unknown").when(F.contains("norm_text", F.lit(w)), "positive").otherwise("negative")))
    both = obs.groupBy("clip_id", "lang").agg(state(0, "the").alias("a"), state(1, "an").alias("b"))
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("clip_id"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("human"))
    return M.paired_known(both.join(gold, "clip_id"), ["lang"], "a", "b", "human")


@query("""WITH p AS (SELECT l_shipmode AS m, l_returnflag AS c, 1 - avg((l_quantity >= 10)::INT::DOUBLE) AS miss, sum((l_discount > 0.05)::INT) AS f FROM (SELECT *, l_suppkey % 5 AS l_shipmode FROM lineitem) GROUP BY ALL),
q AS (SELECT m, sum(f)::BIGINT AS false_events, max(miss) AS a, avg(miss) AS b FROM p GROUP BY m) SELECT m AS model, false_events, round(a, 6) AS max_miss, round(b, 6) AS mean_miss, row_number() OVER (ORDER BY false_events, a, b, m) AS place FROM q""")
def a15_miss_key(spark, d):
    rows = table(spark, d, "lineitem").withColumn("model", F.col("l_suppkey") % 5).withColumn("f", (F.col("l_discount") > 0.05).cast("int"))
    got = M.miss_key(rows, "model", "l_returnflag", F.col("l_quantity") >= 10, "f")
    return got.select("model", "false_events", F.round("max_miss", 6).alias("max_miss"), F.round("mean_miss", 6).alias("mean_miss"), "place")


@query("""SELECT l_suppkey % 5 AS model, l_returnflag AS word, round(sum((l_discount > 0.05)::INT) / sum(l_quantity), 6) AS far_per_hour, round(sum((l_tax > 0.04)::INT) / count(*), 6) AS frr FROM lineitem GROUP BY ALL""")
def a16_far_frr(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("model"), F.col("l_returnflag").alias("word"), (F.col("l_discount") > 0.05).cast("int").alias("fa"), "l_quantity", (F.col("l_tax") > 0.04).cast("int").alias("miss"), F.lit(1).alias("one"))
    got = M.far_frr(rows, "model", "word", "fa", "l_quantity", "miss", "one")
    return got.select("model", "word", F.round("far_per_hour", 6).alias("far_per_hour"), F.round("frr", 6).alias("frr"))


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS "max", round(sum(value) / sum(user_id + 1), 6) AS rtf FROM events GROUP BY event_type""")
def a17_latency_summary(spark, d):
    got = M.latency_summary(table(spark, d, "events").withColumn("audio", F.col("user_id") + 1), ["event_type"], "value", "audio")
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "max", F.round("rtf", 6).alias("rtf"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a FROM embeddings), e AS (SELECT abs(a - round(a, 3)) AS e, a FROM x)
SELECT count(*) AS elements, count_if(e > 0.0004 + 0.0001 * abs(a)) AS violations, round(max(e), 9) AS max_error FROM e""")
def a18_numeric_parity(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = rows.select("vec_id", F.transform("v", lambda x: F.round(x, 3)).alias("v"))
    return M.numeric_parity(rows, other, ["vec_id"], "v", 0.0004, 0.0001).select("elements", "violations", F.round("max_error", 9).alias("max_error"))


@query(f"""WITH {SPANS}, o AS (SELECT *, max("end") OVER (PARTITION BY parent ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY parent ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM o), u AS (SELECT parent, g, max("end") - min(start) AS n FROM i GROUP BY ALL),
t AS (SELECT parent, sum(n)::BIGINT AS d FROM u GROUP BY parent), r AS (SELECT parent, sum("end" - start)::BIGINT AS p FROM spans GROUP BY parent)
SELECT parent, p AS processed, d AS "distinct", p - d AS overlap FROM t JOIN r USING (parent)""")
def a19_coverage_totals(spark, d):
    return I.coverage_totals(spans(spark, d), ["parent"], "start", "end")


@query("SELECT sha256(text) AS pcm_sha256, count(*) AS members, min(doc_id) AS first, max(doc_id) AS last, count(DISTINCT source) AS owners FROM documents GROUP BY 1 HAVING count(*) > 1")
def a20_identity_groups(spark, d):
    return M.identity_groups(clips(spark, d), "pcm_sha256", "clip_id", "family")


@query("SELECT sha256(text) AS pcm_sha256, count(DISTINCT source) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def a21_cross_owner_audio(spark, d):
    return M.identity_groups(clips(spark, d), "pcm_sha256", "clip_id", "family").where("owners > 1").select("pcm_sha256", "owners")


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS median, min(p_retailprice) AS least, max(p_retailprice) AS greatest, count_if(p_retailprice > 1000) AS flagged FROM part GROUP BY p_brand")
def a22_ratio_summary(spark, d):
    return M.ratio_summary(table(spark, d, "part"), ["p_brand"], "p_retailprice", 1000.0).withColumn("median", F.round("median", 6))


@query(f"WITH {OBS} SELECT lang, count(DISTINCT clip_id) AS cases, count_if(model = 0 AND norm_text = spoken) AS hits_0, count_if(model = 2 AND norm_text = spoken) AS hits_2, count_if(model = 0 AND norm_text = spoken) - count_if(model = 2 AND norm_text = spoken) AS net_new_misses FROM obs GROUP BY lang")
def a23_hits_by_condition(spark, d):
    return M.hits_by_condition(observations(spark, d), "lang", "model", [0, 2], F.col("norm_text") == F.col("spoken"), "clip_id")


@query(f"""WITH {HOPS}, e AS (SELECT case_id, min(sample) FILTER (WHERE p >= 0.9 AND best = 1) AS old, min(sample) FILTER (WHERE p >= 0.8 AND best = 2) AS new FROM hops GROUP BY case_id)
SELECT CASE WHEN old IS NULL AND new IS NULL THEN 'neither' WHEN old IS NULL THEN 'rescued' WHEN new IS NULL THEN 'regressed' ELSE 'matched' END AS kind, new - old AS shift, count(*) AS n FROM e GROUP BY ALL""")
def a24_shift_histogram(spark, d):
    first = lambda k, p: F.min(F.when((F.col("p") >= p) & (F.col("best") == k), F.col("sample")))
    return M.shift_histogram(hops(spark, d).groupBy("case_id").agg(first(1, 0.9).alias("old"), first(2, 0.8).alias("new")), "old", "new")


@query("""WITH a AS (SELECT o_orderpriority AS stage, CASE WHEN o_orderkey % 11 = 0 THEN 'planned' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'started' ELSE 'failed' END AS s FROM orders)
SELECT stage, count_if(s = 'completed') AS completed, count_if(s = 'failed') AS failed, count_if(s = 'started') AS unknown, count_if(s = 'planned') AS not_run, count_if(s IN ('completed', 'failed')) AS calls_at_least, count_if(s <> 'planned') AS calls_at_most FROM a GROUP BY stage""")
def a25_ledger_counts(spark, d):
    state = F.when(F.col("o_orderkey") % 11 == 0, "planned").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "started").otherwise("failed")
    return M.ledger_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("stage"), state.alias("s")), ["stage"], "s")


@query("""WITH s AS (SELECT lang, n_chars AS x, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), r AS (SELECT a.lang, sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END) AS w FROM s a JOIN s b ON a.lang = b.lang AND a.pos AND NOT b.pos GROUP BY 1),
c AS (SELECT lang, count_if(pos) AS positives, count_if(NOT pos) AS negatives, min(x) FILTER (WHERE pos) > max(x) FILTER (WHERE NOT pos) AS separated FROM s GROUP BY lang)
SELECT lang, positives, negatives, separated, round((w / (positives * negatives))::DOUBLE, 6) AS fraction FROM c LEFT JOIN r USING (lang)""")
def a26_rank_fraction(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return M.rank_fraction(rows, ["lang"], "n_chars", F.col("quality") == 1).withColumn("fraction", F.round("fraction", 6))


@query("""WITH c AS (SELECT doc_id, sha256(text) AS h, source <> 'src3' AS ok FROM documents), n AS (SELECT h, count(*) AS n FROM c GROUP BY h) SELECT doc_id AS clip_id, ok AS was_eligible, ok AND n = 1 AS eligible, CASE WHEN n > 1 THEN n ELSE 0 END AS duplicates FROM c JOIN n USING (h)""")
def a27_demote_duplicates(spark, d):
    rows = clips(spark, d).withColumn("eligible", F.col("family") != "src3")
    return C.demote_duplicates(rows, "pcm_sha256").select("clip_id", "was_eligible", "eligible", "duplicates")


@query(f"""WITH {HOPS} SELECT case_id, count(*) AS frames, count_if(best = 0) AS token_0, count_if(best = 1) AS token_1, count_if(best = 2) AS token_2 FROM hops GROUP BY case_id""")
def a28_token_histogram(spark, d):
    v = with_vectors(hops(spark, d))
    return M.token_histogram(v, ["case_id"], F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1, [0, 1, 2])


@query("""WITH p AS (SELECT p_type AS mode, ascii(p_type) * 1000 + length(p_type) AS ord, count(DISTINCT CASE WHEN p_size > 48 THEN p_brand END) AS balanced FROM part GROUP BY ALL), b AS (SELECT arg_min(mode, ord) AS m FROM p WHERE balanced >= 3)
SELECT mode, balanced, coalesce(mode = m, false) AS chosen FROM p, b""")
def a29_first_passing(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("mode"), (F.ascii("p_type") * 1000 + F.length("p_type")).alias("ord"), (F.col("p_size") > 48).alias("ok"), F.col("p_brand").alias("voice"))
    return C.first_passing(rows, "mode", "ord", "ok", "voice").select("mode", "balanced", "chosen")


@query(f"""WITH {HOPS}, k AS (SELECT case_id, best, p, (1 - p) / 2 AS r FROM hops) SELECT case_id, round(avg(p * (ln(p) - ln(1.0/3)) + 2 * (r * (ln(r) - ln(1.0/3)))), 6) AS kl FROM k GROUP BY case_id""")
def a30_kl_divergence(spark, d):
    third = F.array(*[F.lit(1.0 / 3)] * 3)
    rows = with_vectors(hops(spark, d))
    return rows.groupBy("case_id").agg(F.round(F.avg(M.kl_divergence(F.col("probabilities"), third)), 6).alias("kl"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS spent, o_totalprice <= 400000 AND round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) <= 1000000 AS within FROM orders""")
def a31_running_budget(spark, d):
    got = M.running_budget(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 400000, 1000000)
    return got.select("o_orderkey", F.round("spent", 2).alias("spent"), "within")


# --- validation -----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, concat_ws(',', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source' END) AS reasons FROM documents""")
def v1_rule_reasons(spark, d):
    rules = [(F.col("n_chars") >= 200, "short"), (F.col("lang").isin("en", "de"), "language"), (F.col("source").rlike("^src[0-9]$"), "source")]
    return V.rule_reasons(table(spark, d, "documents"), rules).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def v2_duplicate_keys(spark, d):
    return V.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT coalesce(doc_id, k) AS doc_id, CASE WHEN k IS NULL THEN 'left' ELSE 'right' END AS side FROM documents FULL JOIN (SELECT doc_id + 5 AS k FROM labels) ON doc_id = k WHERE doc_id IS NULL OR k IS NULL")
def v3_roster_difference(spark, d):
    return V.roster_difference(table(spark, d, "documents"), table(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id")), ["doc_id"])


@query("""SELECT o.o_orderkey, CASE WHEN o_orderstatus <> s AND o_custkey <> c THEN 'o_orderstatus,o_custkey' WHEN o_orderstatus <> s THEN 'o_orderstatus' ELSE 'o_custkey' END AS fields
FROM orders o JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey END AS c FROM orders) n USING (o_orderkey) WHERE o_orderstatus <> s OR o_custkey <> c""")
def v4_disagreements(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    n = o.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_custkey": F.when(F.col("o_orderkey") % 11 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))})
    return V.disagreements(o, n, ["o_orderkey"], ["o_orderstatus", "o_custkey"]).withColumn("fields", F.array_join("fields", ","))


@query("SELECT p_name, count(DISTINCT (p_brand, p_type)) AS tuples FROM part GROUP BY p_name HAVING count(DISTINCT (p_brand, p_type)) > 1")
def v5_broken_dependency(spark, d):
    return V.broken_dependency(table(spark, d, "part"), ["p_name"], ["p_brand", "p_type"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)")
def v6_orphans(spark, d):
    known = table(spark, d, "customer").where(F.col("c_custkey") % 10 != 3).select(F.col("c_custkey").alias("o_custkey"))
    return V.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, ["o_custkey"])


@query("""WITH g AS (SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS cells, count_if(l_linenumber > 3) AS extra, 3 - count(DISTINCT CASE WHEN l_linenumber <= 3 THEN l_linenumber END) AS missing FROM lineitem GROUP BY 1)
SELECT * FROM g WHERE missing > 0 OR extra > 0 OR rows <> cells""")
def v7_incomplete_groups(spark, d):
    return V.incomplete_groups(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", [1, 2, 3]).withColumn("missing", F.size("missing").cast("long"))


@query(f"""WITH {HOPS}, c AS (SELECT case_id, CASE WHEN event_id % 97 = 0 THEN sample + 1280 WHEN event_id % 101 = 0 THEN sample + 640 ELSE sample END AS sample FROM hops),
l AS (SELECT *, sample - lag(sample) OVER (PARTITION BY case_id ORDER BY sample) AS step FROM c)
SELECT fault, count(*) AS n FROM (SELECT CASE WHEN step IS NULL AND sample <> 1280 THEN 'start' WHEN step = 0 THEN 'repeat' WHEN step <> 1280 THEN 'gap' END AS fault FROM l) WHERE fault IS NOT NULL GROUP BY fault""")
def v8_clock_faults(spark, d):
    bent = F.when(F.col("event_id") % 97 == 0, F.col("sample") + 1280).when(F.col("event_id") % 101 == 0, F.col("sample") + 640).otherwise(F.col("sample"))
    return V.clock_faults(hops(spark, d).withColumn("sample", bent), "case_id", "sample", 1280, 1280).groupBy("fault").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE event_id % 13 = 0")
def v9_not_probabilities(spark, d):
    h = with_vectors(hops(spark, d))
    bent = h.withColumn("probabilities", F.when(F.col("event_id") % 13 == 0, F.transform("probabilities", lambda x: x * 1.1)).otherwise(F.col("probabilities")))
    return V.not_probabilities(bent, "probabilities").select("event_id")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') AND lang <> 'es'")
def v10_allowed(spark, d):
    denied = spark.createDataFrame([("source", "src1"), ("source", "src2"), ("lang", "es")], "kind string, value string")
    return V.allowed(table(spark, d, "documents"), denied, ["source", "lang"]).select("doc_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'removed' ELSE 'changed' END AS state FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 19 = 0")
def v11_changed_rows(spark, d):
    old = table(spark, d, "part")
    new = old.where(F.col("p_partkey") % 17 != 0).withColumn("p_size", F.when(F.col("p_partkey") % 19 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return V.changed_rows(old, new, ["p_partkey"])


@query("SELECT CASE WHEN s % 9 = 0 THEN 'removed' WHEN s % 7 = 0 THEN 'changed' ELSE 'kept' END AS state, count(*) AS n FROM (SELECT s_suppkey AS s FROM supplier) GROUP BY 1 UNION ALL SELECT 'added', count(*) FROM supplier WHERE s_suppkey % 9 = 0")
def v12_inventory_diff(spark, d):
    old = table(spark, d, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("h"))
    new = old.where(F.col("s_suppkey") % 9 != 0).withColumn("h", F.when(F.col("s_suppkey") % 7 == 0, F.lit("x")).otherwise(F.col("h")))
    new = new.unionByName(old.where(F.col("s_suppkey") % 9 == 0).withColumn("s_suppkey", F.col("s_suppkey") + 10_000_000))
    return V.inventory_diff(old, new, ["s_suppkey"], "h").groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) AS number FROM documents), f AS (SELECT source, min(number) AS number FROM p GROUP BY source),
k AS (SELECT (SELECT max(number) FROM (SELECT number FROM p WHERE lang = 'de' ORDER BY number LIMIT 3) HAVING count(*) = 3) AS de_at, (SELECT max(number) FROM (SELECT number FROM p WHERE n_chars > 9000 ORDER BY number LIMIT 2) HAVING count(*) = 2) AS long_at, (SELECT max(number) FROM (SELECT number FROM f ORDER BY number LIMIT 4) HAVING count(*) = 4) AS families_at,
 (SELECT count(*) FROM p WHERE lang = 'de' AND number <= 25) AS de_in_first, (SELECT count(*) FROM p WHERE n_chars > 9000 AND number <= 25) AS long_in_first, (SELECT count(*) FROM f WHERE number <= 25) AS families_in_first)
SELECT *, array_to_string(list_sort(list_filter([CASE WHEN de_in_first < 3 THEN 'MISSING_DE' END, CASE WHEN long_in_first < 2 THEN 'MISSING_LONG' END, CASE WHEN families_in_first < 4 THEN 'INSUFFICIENT_FAMILIES' END], lambda x: x IS NOT NULL)), ',') AS gaps, CASE WHEN greatest(de_at, long_at, families_at) <= 500 THEN greatest(de_at, long_at, families_at) END AS smallest FROM k""")
def v13_covering_prefix(spark, d):
    plan = I.numbered(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), [F.col("source"), F.col("doc_id")])
    needs = {"de": (F.col("lang") == "de", 3), "long": (F.col("n_chars") > 9000, 2)}
    return V.covering_prefix(plan, "number", needs, "source", 4, 25, 500).withColumn("gaps", F.array_join("gaps", ","))


@query("SELECT doc_id, CASE WHEN toxic <> 0 THEN 'claims_toxic' ELSE '' END AS reasons FROM labels")
def v14_promotion_guard(spark, d):
    rows = table(spark, d, "labels").withColumn("toxic", F.col("toxic") != 0)
    return V.rule_reasons(rows, V.stay_false(["toxic"])).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


# --- joins ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def j1_review_join(spark, d):
    return J.checked_join(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'missing_right' ELSE 'paired' END AS fault, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def j2_split_coverage(spark, d):
    got = J.covered_one_to_one(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])
    return got.groupBy(F.coalesce("fault", F.lit("paired")).alias("fault")).agg(F.count("*").alias("n"))


@query("""SELECT n_name, r_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def j3_three_way(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    got = J.checked_join(J.checked_join(s, table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), ["n_nationkey"]), table(spark, d, "region"), ["r_regionkey"])
    return got.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query(f"WITH {OBS} SELECT clip_id, max(norm_text) FILTER (WHERE model = 0) AS text_0, max(norm_text) FILTER (WHERE model = 1) AS text_1, max(norm_text) FILTER (WHERE model = 2) AS text_2 FROM obs GROUP BY clip_id")
def j4_by_model(spark, d):
    return J.by_model(clips(spark, d).select("clip_id"), observations(spark, d), [0, 1, 2])


@query("SELECT d.doc_id, b.text AS reference_text, CASE WHEN b.item_id IS NULL THEN 'unknown' ELSE 'known' END AS text_status FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id * 3")
def j5_attach_text(spark, d):
    texts = table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("doc_id"), F.col("text").alias("reference_text"))
    return J.attach_text(table(spark, d, "documents").select("doc_id"), texts, ["doc_id"])


@query("SELECT c_custkey, p AS o_orderpriority, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' ELSE 'seen' END AS status FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) LEFT JOIN (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) o ON c_custkey = o_custkey AND p = o_orderpriority")
def j6_keep_missing(spark, d):
    o = table(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").agg(F.count("*").alias("n"), F.lit("seen").alias("status"))
    got = J.keep_missing(table(spark, d, "customer"), o.select("o_orderpriority").distinct(), per, "c_custkey", "o_orderpriority")
    return got.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j7_unused(spark, d):
    used = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.unused(table(spark, d, "customer").select("c_custkey"), used, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_discount >= 0.02))")
def j8_qualified_groups(spark, d):
    return J.in_qualified_groups(table(spark, d, "lineitem"), "l_orderkey", F.bool_and(F.col("l_discount") >= 0.02)).select("l_orderkey", "l_linenumber")


@query("SELECT a.p_brand, a.p_size AS left_size, b.p_size AS right_size, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size = a.p_size + 7 WHERE a.p_size <= 5 GROUP BY ALL")
def j9_variant_pairs(spark, d):
    contrasts = spark.createDataFrame([(i, i + 7) for i in range(1, 6)], "left_variant int, right_variant int")
    got = J.variant_pairs(table(spark, d, "part"), "p_brand", "p_size", contrasts, ["p_partkey"])
    return got.groupBy("p_brand", F.col("left_variant").alias("left_size"), F.col("right_variant").alias("right_size")).agg(F.count("*").alias("n"))


@query(f"""WITH {HOPS}, w AS (SELECT l_suppkey AS case_id, l_linenumber * 1280 AS a, l_linenumber * 1280 + l_quantity::BIGINT * 128 AS b, l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, case_id, count(*) AS hops, max(p) AS peak FROM w JOIN hops USING (case_id) WHERE a < sample AND sample <= b GROUP BY ALL""")
def j11_range_join(spark, d):
    w = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_linenumber") * 1280).cast("long").alias("a"), (F.col("l_linenumber") * 1280 + F.col("l_quantity").cast("long") * 128).alias("b"), "l_orderkey", "l_linenumber")
    got = J.range_join(hops(spark, d), w, "case_id", "sample", "a", "b", width=12_800)
    return got.groupBy("l_orderkey", "l_linenumber", "case_id").agg(F.count("*").alias("hops"), F.max("p").alias("peak"))


@query(f"""WITH {SPANS} SELECT i.l_orderkey, i.l_linenumber, i.parent, i.start, count(*) AS outers FROM spans i JOIN spans o ON i.parent = o.parent AND o.start <= i.start AND i."end" <= o."end" GROUP BY ALL""")
def j12_contained(spark, d):
    s = spans(spark, d)
    got = J.contained(s, s.select("parent", F.col("start").alias("os"), F.col("end").alias("oe")), "parent", "start", "end", "os", "oe")
    return got.groupBy("l_orderkey", "l_linenumber", "parent", "start").agg(F.count("*").alias("outers"))


@query("SELECT a.conv_id, a.turn, a.role, length(b.text) AS first_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 0 WHERE a.turn > 0")
def j13_parent_child(spark, d):
    c = table(spark, d, "conversations")
    first = c.where("turn = 0").groupBy("conv_id").agg(F.first(F.length("text").cast("long")).alias("first_chars"))
    return J.checked_join(c.where("turn > 0").select("conv_id", "turn", "role"), first, ["conv_id"])


@query("""WITH pool AS (SELECT n_regionkey AS role, n_nationkey AS item, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, count(*) OVER (PARTITION BY n_regionkey) AS size FROM nation),
h AS (SELECT doc_id, (doc_id % 5)::INT AS role, ('0x' || substr(sha256('noise|' || doc_id), 1, 16))::UBIGINT AS h FROM documents) SELECT doc_id, item FROM h JOIN pool USING (role) WHERE r = h % size""")
def j14_assign_by_hash(spark, d):
    pool = table(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("role"), F.col("n_nationkey").alias("item"))
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("role"))
    return J.assign_by_hash(rows, pool, "doc_id", "role", "item", "noise").select("doc_id", "item")


@query("SELECT c_custkey, n_name, r AS repetition FROM customer CROSS JOIN nation CROSS JOIN (VALUES (0), (1)) v(r)")
def j15_request_grid(spark, d):
    return J.request_grid([table(spark, d, "customer").select("c_custkey"), table(spark, d, "nation").select("n_name")], 2)


@query(f"""WITH {CLIPS}, t AS (SELECT clip_id, unnest(string_split(spoken, ' ')) AS token FROM clips) SELECT token IN ('the', 'of', 'and', 'que', 'der') AS known, count(*) AS n, count(DISTINCT clip_id) AS clips FROM t GROUP BY 1""")
def j16_lexicon_lookup(spark, d):
    lex = spark.createDataFrame([(t, [t]) for t in ("the", "of", "and", "que", "der")], "token string, readings array<string>")
    got = J.lexicon_lookup(clips(spark, d), lex, "clip_id", F.split("spoken", " "))
    return got.groupBy((~F.col("oov")).alias("known")).agg(F.count("*").alias("n"), F.count_distinct("clip_id").alias("clips"))


#: A segment from every tenth hop on; every seventh one is so long that the next begins inside it.
SEGMENTS = """segments AS (SELECT case_id, case_id * 1000000 + sample // 12800 AS segment, sample AS a, sample + CASE WHEN (sample // 12800) % 7 = 0 THEN 14000 ELSE 6400 END AS b FROM hops WHERE sample % 12800 = 0)"""


def segments_of(h):
    number = F.expr("sample div 12800")
    return h.where("sample % 12800 = 0").select("case_id", (F.col("case_id") * 1_000_000 + number).alias("segment"), F.col("sample").alias("a"), (F.col("sample") + F.when(number % 7 == 0, 14_000).otherwise(6_400)).alias("b"))


@query(f"""WITH {HOPS}, {SEGMENTS}, n AS (SELECT event_id, count(segment) AS n, min(segment) AS segment FROM hops h LEFT JOIN segments s ON h.case_id = s.case_id AND a <= sample AND sample < b + 2560 GROUP BY event_id)
SELECT event_id, CASE WHEN n = 1 THEN segment END AS segment, n > 1 AS ambiguous FROM n""")
def j17_attribute_points(spark, d):
    h = hops(spark, d)
    return J.attribute_points(h.select("event_id", "case_id", "sample"), segments_of(h), "case_id", "sample", "segment", "a", "b", 2_560).select("event_id", "segment", "ambiguous")


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'undecided' WHEN o_orderkey % 5 = 0 THEN 'refused' ELSE 'imported' END AS state, count(*) AS n FROM orders GROUP BY 1""")
def j18_import_decisions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    dec = o.where(F.col("o_orderkey") % 4 != 0).select("o_orderkey", F.lit("yes").alias("decision"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return J.import_decisions(o, dec, "o_orderkey", ["o_custkey"]).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {HOPS}, r AS (SELECT case_id, count(*) * 1280 AS n FROM hops GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r)
SELECT case_id, (off + sample - 1280)::BIGINT AS global_sample, sample - 1280 AS local_sample, sample = 1280 AS gap FROM hops JOIN o USING (case_id)""")
def j19_align_stream(spark, d):
    h = hops(spark, d)
    roster = h.groupBy("case_id").agg((F.count("*") * 1280).alias("samples"))
    roster = I.stream_layout(roster, [], ["case_id"], "samples", 0, 0).select("case_id", F.col("start").alias("offset"), "samples")
    stream = h.join(roster.hint("merge"), "case_id").select((F.col("offset") + F.col("sample") - 1280).alias("global_sample"))
    return J.align_stream(stream, roster, "case_id", "offset", "samples", "global_sample")


# --- intervals, ranks and orders ------------------------------------------------------------------------------------

_MERGED = """o AS (SELECT *, max("end") OVER (PARTITION BY parent ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum((reach IS NULL OR start {op} reach)::INT) OVER (PARTITION BY parent ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT parent, min(start) AS start, max("end") AS "end", count(*) AS members FROM i GROUP BY parent, g"""


@query(f"WITH {SPANS}, " + _MERGED.replace("{op}", ">"))
def w1_interval_union(spark, d):
    return I.merge_intervals(spans(spark, d), ["parent"], "start", "end")


@query(f"WITH {SPANS}, " + _MERGED.replace("{op}", ">="))
def w1_strict_union(spark, d):
    return I.merge_intervals(spans(spark, d), ["parent"], "start", "end", touching=False)


@query(f"""WITH {HOPS}, n AS (SELECT case_id, max(sample) AS frames FROM hops GROUP BY 1), spans AS (SELECT h.case_id AS parent, greatest(0, sample - 1600) AS start, least(frames, sample + 1600) AS "end", sample FROM hops h JOIN n USING (case_id) WHERE p >= 0.9), {_MERGED.replace("{op}", ">=").replace("AS members", "AS members, min(sample) AS first_seed, max(sample) AS last_seed")}""")
def w2_candidate_windows(spark, d):
    h = hops(spark, d)
    seeds = h.where("p >= 0.9").join(h.groupBy("case_id").agg(F.max("sample").alias("frames")), "case_id")
    got = I.candidate_windows(seeds, "case_id", "sample", F.col("frames"), 1600, 1600)
    return got.select(F.col("case_id").alias("parent"), "start", "end", "members", "first_seed", "last_seed")


@query(f"""WITH {HOPS}, f AS (SELECT *, p >= 0.7 AS ok FROM hops), g AS (SELECT *, sample / 1280 - row_number() OVER (PARTITION BY case_id ORDER BY sample) AS z, row_number() OVER (PARTITION BY case_id, ok ORDER BY sample) - row_number() OVER (PARTITION BY case_id ORDER BY sample) AS isl FROM f),
r AS (SELECT case_id, ok, isl, count(*) AS n FROM g GROUP BY ALL) SELECT case_id, coalesce(max(n) FILTER (WHERE ok), 0) AS longest, count_if(ok) AS runs FROM r GROUP BY case_id""")
def w3_longest_run(spark, d):
    return I.longest_run(hops(spark, d), ["case_id"], "sample", F.col("p") >= 0.7, 1280)


@query(f"""WITH {HOPS}, t AS (SELECT case_id, sample, least(p, lag(p, 1) OVER w, lag(p, 2) OVER w) AS low, lag(p, 2) OVER w IS NOT NULL AS whole FROM hops WINDOW w AS (PARTITION BY case_id ORDER BY sample))
SELECT case_id, max(low) AS best, arg_max(sample, (low, -sample)) AS "at" FROM t WHERE whole GROUP BY case_id""")
def w4_best_triplet(spark, d):
    return I.best_triplet(hops(spark, d), ["case_id"], "sample", "p", 1280)


@query(f"WITH {HOPS} SELECT case_id, best, max(p) AS peak, arg_max(sample, (p, -sample)) AS \"at\" FROM hops GROUP BY ALL")
def w5_peak(spark, d):
    return I.peak(hops(spark, d), ["case_id", "best"], "sample", "p")


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY abs(n_chars - 1500), sha256(doc_id::VARCHAR)) = 1")
def w6_top_per_group(spark, d):
    order = [F.abs(F.col("n_chars") - 1500), F.sha2(F.col("doc_id").cast("string"), 256)]
    return I.top_per_group(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], order).select("doc_id", "source", "lang")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity) AS k FROM lineitem),
t AS (SELECT *, row_number() OVER (ORDER BY x DESC, l_orderkey, l_linenumber) AS g FROM r WHERE k <= 2)
SELECT CASE WHEN r.k > 2 THEN 'EXCLUDED_PER_SOURCE_CAP' WHEN g > 32 THEN 'EXCLUDED_GLOBAL_CAP' ELSE 'SELECTED' END AS state, count(*) AS n, round(sum(r.x), 2) AS total FROM r LEFT JOIN t USING (l_orderkey, l_linenumber, l_suppkey, k) GROUP BY 1""")
def w7_two_level_cap(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", F.col("l_extendedprice").alias("x"))
    order = [F.desc("x"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")]]
    got = I.capped(rows, "l_suppkey", order, ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "x"], 2, 32)
    return got.groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit' || doc_id)) AS turn FROM documents) SELECT doc_id, lang, turn FROM r ORDER BY turn, lang LIMIT 40""")
def w8_round_robin(spark, d):
    return I.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", I.hash_order("audit", F.col("doc_id")), 40)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('d' || doc_id)) AS turn, sha256('s' || source) AS sh FROM documents) SELECT doc_id, source, turn FROM r ORDER BY turn, sh LIMIT 50""")
def w9_depth_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source")
    got = I.round_robin(rows, "source", I.hash_order("d", F.col("doc_id")), 50, [I.hash_order("s", F.col("source"))])
    return got


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS number FROM orders")
def w10_review_order(spark, d):
    return I.numbered(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [F.col("o_orderstatus"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "number")


@query("SELECT c_custkey, upper(c_mktsegment) || '-' || upper(n_name) || '-' || lpad(row_number() OVER (PARTITION BY c_mktsegment, n_name ORDER BY c_custkey)::VARCHAR, greatest(2, length(row_number() OVER (PARTITION BY c_mktsegment, n_name ORDER BY c_custkey)::VARCHAR))::INT, '0') AS alias FROM customer JOIN nation ON c_nationkey = n_nationkey")
def w11_aliases(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return I.aliases(rows, "c_mktsegment", "n_name", "c_custkey").select("c_custkey", "alias")


@query(f"""WITH {UTTS}, c AS (SELECT spoken, string_split(spoken, 'an') AS q FROM utts) SELECT CASE WHEN len(q) = 1 THEN 'absent' WHEN len(q) > 2 THEN 'repeated' WHEN spoken = 'an' THEN 'isolated' WHEN q[1] = '' THEN 'prefix' WHEN q[2] = '' THEN 'suffix' ELSE 'middle' END AS context, count(*) AS n FROM c GROUP BY 1""")
def w12_keyword_context(spark, d):
    return utterances(spark, d).groupBy(I.keyword_context(F.col("spoken"), "an").alias("context")).agg(F.count("*").alias("n"))


@query(f"""WITH {UTTS}, c AS (SELECT utt, string_split(spoken, 'an') AS q FROM utts), p AS (SELECT utt, unnest(range(len(q) - 1)) AS i, q FROM c WHERE len(q) > 1)
SELECT utt, count(*) AS matches, sum(length(array_to_string(q[1:i + 1], 'an')))::BIGINT AS total FROM p GROUP BY utt""")
def w12_keyword_offsets(spark, d):
    at = utterances(spark, d).select("utt", I.keyword_offsets(F.col("spoken"), "an").alias("at")).where(F.size("at") > 0)
    return at.select("utt", F.size("at").cast("long").alias("matches"), F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""WITH s AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation), p AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS j, count(*) OVER () AS n FROM region) SELECT n_name, r_name, ((j - i) % n + n) % n AS turn FROM s, p""")
def w13_latin_order(spark, d):
    return I.latin_order(table(spark, d, "nation"), table(spark, d, "region"), "n_name", "r_name")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('shuffle' || doc_id)) AS number FROM documents")
def w14_hash_shuffle(spark, d):
    return I.numbered(table(spark, d, "documents").select("doc_id"), [I.hash_order("shuffle", F.col("doc_id"))])


@query(f"""WITH {UTTS} SELECT utt, list_reduce(list_concat([0::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(spoken, '')]), lambda a, x: (a * 131 + x) % 4294967296) AS hash FROM utts""")
def w14_rolling_hash(spark, d):
    return utterances(spark, d).select("utt", I.rolling_hash(F.col("spoken")).alias("hash"))


@query(f"""WITH {CLIPS} SELECT clip_id, coalesce(sum(frames + 160) OVER (PARTITION BY family ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, (coalesce(sum(frames + 160) OVER (PARTITION BY family ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + frames + 80)::BIGINT AS grace_end FROM clips""")
def w16_stream_layout(spark, d):
    return I.stream_layout(clips(spark, d).select("clip_id", "family", "frames"), ["family"], ["clip_id"], "frames", 160, 80).select("clip_id", "start", "grace_end")


@query(f"""WITH {CLIPS}, k AS (SELECT clip_id, family, frames, (clip_id % 3 = 0)::INT AS kind FROM clips), t AS (SELECT *, row_number() OVER (PARTITION BY family, kind ORDER BY clip_id) AS turn FROM k),
o AS (SELECT 'mixed' AS layout, *, row_number() OVER (PARTITION BY family ORDER BY turn, kind) AS place FROM t UNION ALL SELECT 'reverse', *, row_number() OVER (PARTITION BY family ORDER BY turn DESC, kind DESC) FROM t UNION ALL SELECT 'ordinary_only', *, row_number() OVER (PARTITION BY family ORDER BY turn) FROM t WHERE kind = 0)
SELECT layout, clip_id, (500 + coalesce(sum(frames + 160) OVER (PARTITION BY layout, family ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM o""")
def w16_mixed_layouts(spark, d):
    rows = clips(spark, d).select("clip_id", "family", "frames", (F.col("clip_id") % 3 == 0).cast("int").alias("kind"))
    out = [I.mixed_layout(rows, "family", "kind", "clip_id", k, "frames", 160, 80, 500).select(F.lit(k).alias("layout"), "clip_id", "start") for k in ("mixed", "reverse", "ordinary_only")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT s_suppkey FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) WHERE k <= 3")
def w17_first_of_groups(spark, d):
    return I.top_per_group(table(spark, d, "supplier"), ["s_nationkey"], [F.col("s_suppkey")], 3).select("s_suppkey")


@query(f"""WITH {HOPS}, f AS (SELECT case_id, sample / 1280 AS frame, best FROM hops), c AS (SELECT *, (best IS DISTINCT FROM lag(best) OVER (PARTITION BY case_id ORDER BY frame))::INT AS ch FROM f), g AS (SELECT *, sum(ch) OVER (PARTITION BY case_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT case_id, run::BIGINT AS run, best AS token, min(frame)::BIGINT * 1280 AS from_sample, max(frame)::BIGINT * 1280 + 35200 AS to_sample FROM g GROUP BY case_id, run, best""")
def w18_argmax_runs(spark, d):
    frames = with_vectors(hops(spark, d)).withColumn("frame", F.expr("sample div 1280"))
    got = I.argmax_runs(frames, ["case_id"], "frame", "probabilities", 1280, 35_200)
    return got.select("case_id", "run", F.col("token").cast("int").alias("token"), "from_sample", "to_sample")


@query(f"""WITH {HOPS}, s AS (SELECT case_id, sample, avg(p) OVER w AS m, count(*) OVER w AS n FROM hops WINDOW w AS (PARTITION BY case_id ORDER BY sample ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) SELECT case_id, sample, round(m, 6) AS mean_p FROM s WHERE n = 16""")
def w19_trailing_stack(spark, d):
    got = I.trailing_stack(hops(spark, d), "case_id", "sample", "p", 16, 1280)
    return got.select("case_id", "sample", F.round(F.aggregate("stack", F.lit(0.0), lambda a, x: a + x) / 16, 6).alias("mean_p"))


@query("WITH n AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS shard FROM orders) SELECT shard, count(*) AS n FROM n GROUP BY shard")
def w20_shards(spark, d):
    rows = I.numbered(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    return I.shards(rows, "number", 1000).groupBy("shard").agg(F.count("*").alias("n"))


# --- sampling, plans and weights ------------------------------------------------------------------------------------


_REGISTRY = """o AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal FROM customer WHERE c_custkey % 3 = 0),
n AS (SELECT c_custkey AS k, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0), e AS (FROM o UNION ALL FROM n)"""


def _registry(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("speaker"))
    old = I.numbered(c.where("speaker % 3 = 0"), [F.col("speaker")], "ordinal", 0)
    old = old.select("speaker", F.col("ordinal").cast("long").alias("ordinal"), F.when(F.col("ordinal") % 4 == 3, "dev").otherwise("train").alias("role"), F.substring(F.sha2(F.col("speaker").cast("string"), 256), 1, 32).alias("speaker_id"))
    return c, L.extend_registry(old, c.where("speaker % 5 <> 0 or speaker % 3 = 0"), "speaker")


@query(f"WITH {_REGISTRY} SELECT k AS speaker, ordinal, CASE WHEN ordinal % 4 = 3 THEN 'dev' ELSE 'train' END AS role FROM e")
def w15_extend_registry(spark, d):
    return _registry(spark, d)[1].select("speaker", "ordinal", "role")


@query(f"WITH {_REGISTRY} SELECT c_custkey AS speaker, ordinal, CASE WHEN k IS NULL THEN 'not_registered' END AS reason FROM customer LEFT JOIN e ON c_custkey = k")
def l6_registry_lookup(spark, d):
    c, registry = _registry(spark, d)
    return L.registry_lookup(registry, c, "speaker").select("speaker", "ordinal", "reason")


@query(f"""WITH {_REGISTRY}, b AS (SELECT k, ordinal, CASE WHEN ordinal % 4 = 3 AND k % 7 <> 0 THEN 'dev' ELSE 'train' END AS role FROM e), r AS (SELECT * FROM b UNION ALL SELECT k, -ordinal - 1, role FROM b WHERE k % 50 = 3)
SELECT 'role_changed' AS fault, k::VARCHAR AS value FROM r WHERE role <> CASE WHEN (ordinal % 4 + 4) % 4 = 3 THEN 'dev' ELSE 'train' END UNION ALL SELECT 'ordinal_out_of_range', k::VARCHAR FROM r WHERE ordinal < 0
UNION ALL SELECT 'repeated_key', k::VARCHAR FROM e WHERE k % 50 = 3 UNION ALL SELECT 'shared_id', substr(sha256(k::VARCHAR), 1, 32) FROM e WHERE k % 50 = 3""")
def l6_registry_faults(spark, d):
    registry = _registry(spark, d)[1]
    bent = registry.withColumn("role", F.when(F.col("speaker") % 7 == 0, "train").otherwise(F.col("role")))
    again = bent.where("speaker % 50 = 3").withColumn("ordinal", -F.col("ordinal") - 1)
    return L.registry_faults(bent.unionByName(again), "speaker")


@query("""WITH RECURSIVE s AS (SELECT -1::BIGINT AS position, '' AS class, 0::BIGINT AS draw, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c
UNION ALL SELECT position + 1, pick, CASE pick WHEN 'positive' THEN a WHEN 'ordinary' THEN b ELSE c END, a + (pick = 'positive')::INT, b + (pick = 'ordinary')::INT, c + (pick = 'near')::INT
FROM (SELECT *, CASE WHEN x >= greatest(y, z) THEN 'positive' WHEN y >= z THEN 'ordinary' ELSE 'near' END AS pick FROM (SELECT *, CASE WHEN a < 1000 THEN 1000 * (position + 2) - a * 2000 ELSE -10000000 END AS x, CASE WHEN b < 900 THEN 900 * (position + 2) - b * 2000 ELSE -10000000 END AS y, CASE WHEN c < 100 THEN 100 * (position + 2) - c * 2000 ELSE -10000000 END AS z FROM s)) WHERE position < 1999),
r AS (SELECT doc_id, source, CASE WHEN quality = 0 THEN 'near' WHEN lang = 'en' THEN 'ordinary' ELSE 'positive' END AS class FROM documents JOIN labels USING (doc_id)),
i AS (SELECT *, dense_rank() OVER (PARTITION BY class ORDER BY source) - 1 AS f, row_number() OVER (PARTITION BY class, source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY class, source) AS n FROM r), m AS (SELECT class, count(DISTINCT source) AS m FROM r GROUP BY class)
SELECT position, class, draw, source, doc_id FROM s JOIN m USING (class) JOIN i USING (class) WHERE i.f = s.draw % m.m AND i.k = (s.draw // m.m) % i.n""")
def x1_exposure_plan(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.when(F.col("quality") == 0, "near").when(F.col("lang") == "en", "ordinary").otherwise("positive").alias("kind"))
    return X.exposure_plan(rows, {"positive": 1000, "ordinary": 900, "near": 100}, "kind", "source", "doc_id")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT step, lang, doc_id FROM range(500) s(step), r WHERE i = step % n""")
def x2_step_draws(spark, d):
    return X.step_draws(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 500)


@query("""WITH r AS (SELECT l_returnflag AS c, l_suppkey AS g, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT c, count(*) AS m FROM r GROUP BY c), w AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey, l_quantity / (3 * m * n) AS w FROM lineitem JOIN r ON c = l_returnflag AND g = l_suppkey JOIN k USING (c))
SELECT l_returnflag, l_suppkey, round(sum(w / (SELECT sum(w) FROM w)), 9) AS weight FROM w GROUP BY ALL""")
def x3_bag_weights(spark, d):
    got = X.bag_weights(table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity"), "l_returnflag", "l_suppkey", "l_quantity")
    return got.groupBy("l_returnflag", "l_suppkey").agg(F.round(F.sum("weight"), 9).alias("weight"))


@query("""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN sha256('route' || doc_id) <= repeat('3', 64) THEN 'sample' END AS route FROM documents""")
def x4_selective_route(spark, d):
    doubts = [(F.col("n_chars") < 200, "short"), (F.col("lang") != "en", "language")]
    return X.selective_route(table(spark, d, "documents"), doubts, I.hash_order("route", F.col("doc_id"))).select("doc_id", "route")


@query("""SELECT c_custkey, 'bulk-' || substr(sha256(c_name || '|' || c_mktsegment), 1, 24) AS id, ('0x' || substr(sha256(c_name || '|' || c_mktsegment), 1, 8))::BIGINT AS seed FROM customer""")
def x5_stable_ids(spark, d):
    parts = [F.col("c_name"), F.col("c_mktsegment")]
    return table(spark, d, "customer").select("c_custkey", X.stable_id("bulk-", *parts).alias("id"), X.stable_seed(*parts).alias("seed"))


@query("SELECT substr(sha256('blind' || doc_id), 1, 16) AS pseudonym, lang FROM documents")
def x6_blind_table(spark, d):
    return X.blind_tables(table(spark, d, "documents"), "blind", "doc_id", ["lang"])[0]


@query("SELECT source, r_name FROM (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0), region")
def x7_refinement(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return X.refinement(rows, F.col("quality") == 0, "source", table(spark, d, "region").select("r_name"))


@query("SELECT lang, source, count(*) AS rows, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY ALL")
def x8_groups_by_class(spark, d):
    return X.groups_by_class(table(spark, d, "documents"), "lang", "source", "doc_id")


# --- splits, leakage and lineage ------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS role, sha256(text) AS pcm, source || ':' || (doc_id // 40) AS speaker FROM documents), l AS (SELECT 'pcm' AS kind, pcm AS value, role FROM r UNION ALL SELECT 'speaker', speaker, role FROM r)
SELECT kind, value, count(DISTINCT role) AS roles FROM l GROUP BY ALL HAVING count(DISTINCT role) > 1""")
def l1_role_leaks(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train").alias("role"), F.sha2("text", 256).alias("pcm"), F.concat_ws(":", "source", F.expr("doc_id div 40")).alias("speaker"))
    return L.role_leaks(rows, "role", {"pcm": "pcm", "speaker": "speaker"}).select("kind", "value", "roles")


@query("SELECT lang || ':' || source AS value, count(DISTINCT doc_id % 3) AS roles FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")
def l2_speaker_generator_leaks(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 3).alias("role"), F.concat_ws(":", "lang", "source").alias("speaker"))
    return L.role_leaks(rows, "role", {"speaker": "speaker"}).select("value", "roles")


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice").cast("string")).alias("price"), F.when(F.col("p_partkey") % 7 == 1, F.concat_ws(":", "p_brand", "p_size")).alias("brand"), F.when(F.col("p_partkey") % 2 == 0, "dev").otherwise("train").alias("split"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'dev' ELSE 'train' END AS split, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 7 = 1 THEN p_brand || ':' || p_size END AS brand FROM part),
h AS (SELECT k, min(k) OVER (PARTITION BY price) AS m FROM p WHERE price IS NOT NULL UNION SELECT k, min(k) OVER (PARTITION BY brand) FROM p WHERE brand IS NOT NULL), e AS (SELECT k AS a, m AS b FROM h WHERE k <> m UNION SELECT m, k FROM h WHERE k <> m),
r AS (SELECT k AS node, k AS root FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b), c AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT min(k::VARCHAR) AS component, count(DISTINCT split) AS splits, count(*) AS rows FROM p JOIN c ON node = k GROUP BY c.component HAVING count(DISTINCT split) > 1""")
def l3_split_components(spark, d):
    return L.split_leaks(L.identity_components(_parts(spark, d), "p_partkey", {"price": "price", "brand": "brand"}), "split")


@query("""WITH d AS (SELECT 'd' || doc_id AS key, source, doc_id % 10 <> 0 AS train, min('d' || doc_id) OVER (PARTITION BY text) AS component FROM documents), b AS (SELECT DISTINCT 'd' || item_id AS key FROM benchmark),
c AS (SELECT component, bool_or(b.key IS NOT NULL AND b.key < 'd2') AS exposed, bool_or(b.key IS NOT NULL AND b.key >= 'd38') AS banned, count(DISTINCT train) AS roles, count(DISTINCT source) AS sources FROM d LEFT JOIN b USING (key) GROUP BY component), g AS (SELECT source, count(DISTINCT component) AS comps FROM d GROUP BY source)
SELECT key, component, exposed, CASE WHEN banned THEN 'banned_member' WHEN exposed AND NOT train THEN 'exposed_not_train' WHEN roles > 1 THEN 'role_clash' WHEN sources > 1 OR comps > 1 THEN 'group_not_component' END AS violation FROM d JOIN c USING (component) JOIN g USING (source)""")
def l4_lineage_groups(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("source").alias("group"), F.when(F.col("doc_id") % 10 == 0, "heldout").otherwise("train").alias("role"), F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("key").alias("left"), F.count("*").alias("n")).where("n > 1")
    edges = docs.join(first, "h").where("key <> left").select("left", F.col("key").alias("right"))
    bench = table(spark, d, "benchmark").select(F.concat(F.lit("d"), "item_id").alias("key"))
    got = L.lineage_groups(docs, edges, bench.where("key < 'd2'"), bench.where("key >= 'd38'"), "key", "role", "group")
    return got.select("key", "component", "exposed", "violation")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'speaker:' || c_custkey ELSE 'file:00' || c_custkey END AS key FROM customer""")
def l5_typed_key(spark, d):
    ns = F.when(F.col("c_custkey") % 2 == 0, " Speaker").otherwise("file")
    return table(spark, d, "customer").select("c_custkey", L.typed_key(ns, F.concat(F.lit("00"), F.col("c_custkey").cast("string"))).alias("key"))


@query("SELECT CASE WHEN p IN ('test', 'heldout') THEN 'refused' WHEN p = 'dev' THEN 'dev' WHEN p = 'train' THEN 'train' ELSE 'unknown' END AS role, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'heldout' WHEN 2 THEN 'dev' WHEN 3 THEN 'train' ELSE 'other' END AS p FROM documents) GROUP BY 1")
def l7_partition_role(spark, d):
    names = F.element_at(F.array(*[F.lit(x) for x in ("TEST", "heldout ", "Dev", "train", "other")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").groupBy(L.partition_role(names).alias("role")).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id FROM documents d WHERE sha256(d.text) IN (SELECT sha256(text) FROM documents WHERE source = 'src4') AND source <> 'src4'")
def l8_history_overlap(spark, d):
    c = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("fp"))
    return L.history_overlap(c.where("source <> 'src4'"), c.where("source = 'src4'"), "fp").select("doc_id")


@query("""SELECT o_custkey AS speaker FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def l9_shared_train(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("speaker"), F.when(F.col("o_orderstatus") == "F", "train").otherwise("dev").alias("role"), "o_orderkey", "o_orderstatus")
    return L.shared_train(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), o.where("o_orderstatus = 'P'"), "speaker", "role")


# --- sets -----------------------------------------------------------------------------------------------------------


@query("SELECT batch, count(*) AS n FROM (SELECT 'a' AS batch FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'b' FROM documents WHERE doc_id % 2 = 0) GROUP BY batch")
def u1_concat_batches(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    rows, _ = U.concat_batches({"a": docs.where("doc_id % 3 = 0"), "b": docs.where("doc_id % 2 = 0")}, "doc_id")
    return rows.groupBy("batch").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part")
def u2_add_references(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return U.add_references(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_partkey")


@query("""SELECT place, count(*) AS n FROM (SELECT CASE WHEN l.k IS NULL THEN 'left' WHEN d.k IS NULL THEN 'right' ELSE 'both' END AS place FROM (SELECT doc_id AS k FROM documents WHERE lang = 'en') d FULL JOIN (SELECT doc_id AS k FROM labels) l ON d.k = l.k) GROUP BY 1""")
def u3_key_sets(spark, d):
    got = U.key_sets(table(spark, d, "documents").where("lang = 'en'"), table(spark, d, "labels"), "doc_id")
    return got.groupBy("place").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS k FROM part), b AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS k FROM part WHERE p_partkey NOT IN (1990, 1995)) SELECT coalesce(a.i, b.i) AS number, a.k AS left_key, b.k AS right_key FROM a FULL JOIN b USING (i) WHERE a.k IS DISTINCT FROM b.k""")
def u4_order_difference(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    number = lambda df: I.numbered(df, [F.col("p_partkey")])
    return U.order_difference(number(p), number(p.where("p_partkey not in (1990, 1995)")), "number", "p_partkey")


# --- text and sequences ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(text, '[^ -~]', 'x', 'g')), '[^a-z0-9'']+', ' ', 'g'))) AS norm FROM documents")
def t1_normal_forms(spark, d):
    plain = F.regexp_replace("text", "[^ -~]", "x")
    ascii_only = F.regexp_replace(plain, "[^A-Za-z0-9']", ".")
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm_reference(ascii_only)).alias("norm"))


@query(f"WITH {UTTS} SELECT utt, spoken AS phones FROM utts")
def t2_phones(spark, d):
    return utterances(spark, d).select("utt", T.norm_phones(F.transform(F.split("spoken", " "), lambda w: F.concat(w, F.lit("ˈː")))).alias("phones"))


@query("SELECT count_if(contains(text, 'idiot')) AS hits, count(*) AS n FROM documents")
def t3_presence(spark, d):
    return table(spark, d, "documents").agg(F.count_if(T.present(F.col("text"), F.lit("idiot"))).alias("hits"), F.count("*").alias("n"))


@query(f"""WITH {UTTS} SELECT utt, (length(spoken) - length(replace(spoken, 'er', ''))) // 2 AS hits, (instr(spoken, 'er') - 1)::INT AS first FROM utts WHERE contains(spoken, 'er')""")
def t4_positions(spark, d):
    got = utterances(spark, d).select("utt", T.positions(T.characters(F.col("spoken")), ["e", "r"]).alias("at")).where(F.size("at") > 0)
    return got.select("utt", F.size("at").cast("long").alias("hits"), F.get("at", F.lit(0)).alias("first"))


@query(f"WITH {UTTS} SELECT lang, count_if(regexp_matches(spoken, 'a.*n.*d')) AS ordered, count_if(regexp_matches(spoken, '\\bthe\\b')) AS whole FROM utts GROUP BY lang")
def t5_t6_phrases(spark, d):
    return utterances(spark, d).groupBy("lang").agg(F.count_if(T.contains_in_order(F.col("spoken"), "and")).alias("ordered"), F.count_if(T.whole_phrase(F.col("spoken"), "the")).alias("whole"))


@query(f"""WITH {UTTS}, p(name, pattern) AS (VALUES ('the', '.*\\bthe\\b.*'), ('que', '.*que.*'), ('ing', '.*ing')), m AS (SELECT utt, count(*) AS matches, min(name) AS name FROM utts JOIN p ON regexp_full_match(spoken, pattern) GROUP BY 1)
SELECT utt, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN name END AS only FROM utts LEFT JOIN m USING (utt)""")
def t7_pattern_matches(spark, d):
    p = spark.createDataFrame([("the", r".*\bthe\b.*"), ("que", ".*que.*"), ("ing", ".*ing")], "name string, pattern string")
    return T.pattern_matches(utterances(spark, d), p, "utt", "spoken", full=True)


@query(f"""WITH {UTTS} SELECT utt, levenshtein(translate(spoken, ' ', ''), translate({WITHOUT_LAST}, ' ', ''))::BIGINT AS distance FROM utts""")
def t8_token_distance(spark, d):
    close = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return utterances(spark, d).select("utt", T.token_distance(close(F.col("spoken")), close(without_last(F.col("spoken")))).alias("distance"))


@query(f"""WITH {UTTS}, a AS (SELECT utt, spoken, unnest(range(1, length(spoken) + 1)) AS a FROM utts), s AS (SELECT utt, a, n, substr(spoken, a::BIGINT, n::BIGINT) AS span FROM a, (VALUES (3), (4), (5)) v(n) WHERE a + n - 1 <= length(spoken)) SELECT utt, (a - 1)::INT AS "at", span, levenshtein(span, 'tion')::INT AS distance FROM s WHERE NOT contains(span, ' ') AND levenshtein(span, 'tion') <= 1""")
def t9_near_spans(spark, d):
    return T.near_spans(utterances(spark, d), "utt", "spoken", "tion")


@query(f"""WITH {UTTS} SELECT CASE WHEN length(spoken) < 12 THEN 'unknown' WHEN contains(spoken, 'the') THEN 'positive' WHEN regexp_matches(spoken, 't.?e') THEN 'unknown' ELSE 'negative' END AS state, count(*) AS n FROM utts GROUP BY 1""")
def t12_presence_state(spark, d):
    s = F.col("spoken")
    state = T.presence_state(F.length(s) < 12, s.contains("the"), s.rlike("t.?e"), F.lit(False))
    return utterances(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"""WITH {HOPS}, c AS (SELECT case_id, sample, best, lag(best) OVER (PARTITION BY case_id ORDER BY sample) AS prev FROM hops) SELECT case_id, string_agg(best::VARCHAR, '' ORDER BY sample) AS path FROM c WHERE best <> 0 AND best IS DISTINCT FROM prev GROUP BY case_id""")
def t13_ctc_collapse(spark, d):
    got = I.collapsed(hops(spark, d), "case_id", "sample", F.col("best"), [0])
    paths = got.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("first", "value"))).alias("path"))
    return paths.select("case_id", F.array_join(F.transform("path", lambda x: x["value"].cast("string")), "").alias("path"))


@query(f"""WITH {HOPS}, c AS (SELECT case_id, sample, best, lag(best) OVER (PARTITION BY case_id ORDER BY sample) AS prev FROM hops), k AS (SELECT * FROM c WHERE best <> 0 AND best IS DISTINCT FROM prev), n AS (SELECT case_id, best AS a, lead(best, 1) OVER w AS b, lead(best, 2) OVER w AS e FROM k WINDOW w AS (PARTITION BY case_id ORDER BY sample)) SELECT case_id, count_if(a = 1 AND b = 2 AND e = 1) AS hits FROM n GROUP BY case_id""")
def t14_ctc_events(spark, d):
    path = cut_lineage(I.collapsed(hops(spark, d), "case_id", "sample", F.col("best"), [0]))
    hits = I.sequence_hits(path, "case_id", "first", "value", [1, 2, 1]).groupBy("case_id").agg(F.count("*").alias("hits"))
    return path.select("case_id").distinct().join(hits.hint("merge"), "case_id", "left").fillna(0, ["hits"])


@query(f"""WITH {UTTS}, c AS (SELECT utt, unnest(string_split(spoken, '')) AS t, unnest(range(len(string_split(spoken, '')))) AS i FROM utts), v AS (SELECT utt, i, t, ascii(t) - 96 AS id, lag(t) OVER (PARTITION BY utt ORDER BY i) AS prev FROM c)
SELECT utt, count(*) + count(*) FILTER (WHERE t = prev AND t <> ' ' AND t <> 'x') AS min_frames, count_if(t = ' ' OR t = 'x') > 0 AS unsupported FROM v GROUP BY utt""")
def t15_vocabulary_ids(spark, d):
    vocab = spark.createDataFrame([(chr(97 + i), i + 1) for i in range(26) if chr(97 + i) != "x"], "token string, id int")
    got = T.vocabulary_ids(utterances(spark, d), vocab, "utt", T.characters(F.col("spoken")))
    return got.select("utt", F.col("min_frames").cast("long").alias("min_frames"), (F.size("unsupported") > 0).alias("unsupported"))


@query(f"""WITH {UTTS}, t AS (SELECT utt, CASE WHEN length(spoken) % 13 <> 0 THEN replace(spoken, ' ', '') END AS x, length(spoken) * 200 AS frames FROM utts),
c AS (SELECT utt, unnest(string_split(x, '')) AS t, unnest(range(length(x))) AS i FROM t WHERE x <> ''), v AS (SELECT *, lag(t) OVER (PARTITION BY utt ORDER BY i) AS prev FROM c), n AS (SELECT utt, count(*) + coalesce(count_if(t = prev), 0) AS least, bool_or(t = 'x') AS oov FROM v GROUP BY utt)
SELECT utt, CASE WHEN x IS NULL THEN 'no_full_transcript' WHEN oov THEN 'out_of_vocabulary' WHEN (CASE WHEN frames < 400 THEN 0 ELSE 1 + (frames - 400) // 320 END) < least THEN 'insufficient_frames' END AS reason, CASE WHEN frames < 400 THEN 0 ELSE 1 + (frames - 400) // 320 END AS steps FROM t JOIN n USING (utt) UNION ALL SELECT utt, 'no_full_transcript', CASE WHEN frames < 400 THEN 0 ELSE 1 + (frames - 400) // 320 END FROM t WHERE x IS NULL""")
def t15_ctc_targets(spark, d):
    vocab = spark.createDataFrame([("x", 0), *[(chr(97 + i), i + 1) for i in range(26) if chr(97 + i) != "x"]], "token string, id int")
    n = F.length("spoken")
    rows = utterances(spark, d).select("utt", F.when(n % 13 != 0, F.translate("spoken", " ", "")).alias("text"), (n * 200).alias("frames"))
    return T.ctc_targets(rows, vocab, "utt", "text", "frames", 2).select("utt", "reason", "steps")


@query(f"""WITH {UTTS}, c AS (SELECT utt, unnest(string_split(spoken, '')) AS t, unnest(range(len(string_split(spoken, '')))) AS i FROM utts), v AS (SELECT *, lead(t) OVER (PARTITION BY utt ORDER BY i) AS nxt FROM c) SELECT utt, count(*) FILTER (WHERE t = nxt) AS repeats FROM v GROUP BY utt""")
def t16_repetition(spark, d):
    return utterances(spark, d).select("utt", T.repetition(F.col("spoken")).cast("long").alias("repeats"))


@query("SELECT (props::JSON ->> 'k')::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def m2_json_fields(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH x AS (SELECT vec_id, [CAST(round(v::DOUBLE * 20000) AS INT) FOR v IN embedding] AS s FROM embeddings) SELECT vec_id, round(sqrt(list_sum([(v * v)::DOUBLE FOR v IN s]) / len(s)) / 32768, 9) AS rms, round(list_max([abs(v) FOR v IN s]) / 32768, 9) AS peak FROM x""")
def m1_signal_measures(spark, d):
    from quorumlake.operators.signal import signal_measures

    s = F.transform("embedding", lambda v: F.round(v.cast("double") * 20000).cast("int"))
    m = table(spark, d, "embeddings").select("vec_id", s.alias("s")).select("vec_id", signal_measures(F.col("s")).alias("m"))
    return m.select("vec_id", F.round("m.rms", 9).alias("rms"), F.round("m.peak", 9).alias("peak"))


# --- streams --------------------------------------------------------------------------------------------------------

POLICY = R.GatePolicy(threshold=0.6, confirmations=2, block_samples=5_120, warm_hops=3)


GATED = f"""{HOPS}, n AS (SELECT case_id, sample, best, p::FLOAT AS p, row_number() OVER (PARTITION BY case_id ORDER BY sample) AS i FROM hops),
g AS (SELECT case_id, 0::BIGINT AS i, NULL::BIGINT AS sample, -1 AS label, 0 AS seen, -1::BIGINT AS until, NULL::INT AS hit FROM n WHERE i = 1
UNION ALL SELECT case_id, i, sample, CASE WHEN ok AND c < 2 THEN best ELSE -1 END, CASE WHEN ok AND c < 2 THEN c ELSE 0 END, CASE WHEN ok AND c = 2 THEN sample + 5120 ELSE until END, CASE WHEN ok AND c = 2 THEN best END
FROM (SELECT n.case_id, n.i, n.sample, n.best, g.until, n.i > 3 AND n.sample >= g.until AND n.best <> 0 AND n.p >= 0.6::FLOAT AS ok, CASE WHEN n.best = g.label THEN g.seen + 1 ELSE 1 END AS c FROM g JOIN n ON n.case_id = g.case_id AND n.i = g.i + 1))"""


def _gated(spark, d) -> DataFrame:
    return R.gate_events(with_vectors(hops(spark, d)), policy=POLICY)


@query(f"WITH RECURSIVE {GATED} SELECT case_id::VARCHAR AS case_id, sample, hit AS event_class FROM g WHERE hit IS NOT NULL")
def r1_event_gate(spark, d):
    return _gated(spark, d)


def _cases(spark, d) -> DataFrame:
    """A clip in each case; some start on the clock of a hop. Cases of class 0 have none."""
    last = hops(spark, d).groupBy("case_id").agg(F.max("sample").alias("last")).withColumn("weak_class", F.col("case_id") % 3)
    return last.select("case_id", "weak_class", F.when(F.col("weak_class") > 0, F.expr("last div 4 div 1280 * 1280")).alias("clip_start"), F.when(F.col("weak_class") > 0, F.expr("last div 2")).alias("clip_eof"))


_MATCHED = """c AS (SELECT case_id, case_id % 3 AS weak_class, CASE WHEN case_id % 3 > 0 THEN max(sample) // 4 // 1280 * 1280 END AS clip_start, CASE WHEN case_id % 3 > 0 THEN max(sample) // 2 END AS clip_eof FROM hops GROUP BY case_id),
e AS (SELECT c.*, sample, best, coalesce(sample <= clip_start, false) AS prefix FROM c LEFT JOIN (SELECT * FROM hops WHERE p >= 0.9) h USING (case_id)),
k AS (SELECT *, sample IS NOT NULL AND weak_class > 0 AND NOT coalesce(prefix, false) AND best = weak_class AS own FROM e),
m AS (SELECT *, own AND sample < clip_eof + {low} AS early, own AND sample > clip_eof + {high} AS late FROM k),
r AS (SELECT case_id, any_value(weak_class) AS weak_class, count(sample) AS events, count_if(prefix) AS prefix_events, count_if(own AND NOT early AND NOT late) AS matches, count_if(early) AS early_events, count_if(late) AS late_events,
 count_if(sample IS NOT NULL AND weak_class > 0 AND NOT coalesce(prefix, false) AND best <> weak_class) AS wrong_events, count_if(sample IS NOT NULL AND weak_class = 0) AS negative_events, min(sample) FILTER (WHERE own AND NOT early AND NOT late) - any_value(clip_eof) AS lag_samples FROM m GROUP BY case_id)
SELECT case_id, events, prefix_events, matches, early_events, late_events, wrong_events, negative_events, greatest(matches - 1, 0) AS extra_events, weak_class > 0 AND matches = 0 AS missing, lag_samples,
 prefix_events + early_events + late_events + wrong_events + negative_events + greatest(matches - 1, 0) > 0 OR (weak_class > 0 AND matches = 0) AS error FROM r"""
_SUMMARY = ["case_id", "events", "prefix_events", "matches", "early_events", "late_events", "wrong_events", "negative_events", "extra_events", "missing", "lag_samples", "error"]


@query(f"WITH {HOPS}, " + _MATCHED.format(low="-1000000000000", high="1000000000000"))
def r2_evaluate_events(spark, d):
    e = hops(spark, d).where("p >= 0.9").select("case_id", "sample", "best")
    return R.evaluate_events(e, _cases(spark, d), "case_id", "sample", "best").select(*_SUMMARY)


@query(f"WITH {HOPS}, " + _MATCHED.format(low="128", high="16000"))
def r3_windowed_match(spark, d):
    return R.windowed_match(hops(spark, d).where("p >= 0.9"), _cases(spark, d), "case_id", "sample", "best").select(*_SUMMARY)


@query(f"""WITH RECURSIVE {GATED}, e AS (SELECT case_id::VARCHAR AS case_id, sample, hit AS event_class FROM g WHERE hit IS NOT NULL)
SELECT *, 'derived' AS side FROM e WHERE sample % 3 = 0 UNION ALL SELECT case_id, sample + 1, event_class, 'stored' FROM e WHERE sample % 7 = 0""")
def r4_event_consistency(spark, d):
    e = _gated(spark, d)
    moved = e.where(F.col("sample") % 7 == 0).withColumn("sample", F.col("sample") + 1)
    stored = e.where(F.col("sample") % 3 != 0).unionByName(moved)
    return R.event_consistency(e, stored, ["case_id", "sample", "event_class"])


@query(f"WITH {HOPS} SELECT case_id, count(*) AS windows, count_if(sample > 19200) AS ready, count_if(p >= 0.9) AS events, max(sample) AS last_sample FROM hops GROUP BY case_id")
def r5_trace_summary(spark, d):
    return R.trace_summary(hops(spark, d).withColumn("ready", F.col("sample") > 19_200), "case_id", "sample", "ready", F.col("p") >= 0.9)


_LOG = """l AS (SELECT user_id * 100 + event_id % 100 AS slot, event_id, CASE event_type WHEN 'view' THEN 'planned' WHEN 'click' THEN 'started' WHEN 'error' THEN 'failed' ELSE 'completed' END AS s FROM events),
c AS (SELECT slot, CASE WHEN arg_max(s, event_id) = 'started' THEN 'unknown' ELSE arg_max(s, event_id) END AS state, count_if(s = 'started') AS attempts, bool_or(s IN ('started', 'completed', 'failed')) AS consumed,
 coalesce(min(event_id) FILTER (WHERE s IN ('completed', 'failed')) < coalesce(min(event_id) FILTER (WHERE s = 'started'), 1e18), false) AS early FROM l GROUP BY slot)"""


def _claims(spark, d):
    s = F.when(F.col("event_type") == "view", "planned").when(F.col("event_type") == "click", "started").when(F.col("event_type") == "error", "failed").otherwise("completed")
    log = table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("slot"), "event_id", s.alias("s"))
    return R.claim_state(log.unionByName(log.where("event_id % 7 = 0")), "slot", "event_id", "s")


@query(f"WITH {_LOG} SELECT slot, state, attempts, consumed, array_to_string(list_filter([CASE WHEN early THEN 'outcome_without_claim' END, CASE WHEN attempts > 1 THEN 'claimed_again' END], lambda x: x IS NOT NULL), ',') AS faults FROM c")
def r7_claim_state(spark, d):
    return _claims(spark, d).withColumn("faults", F.array_join("faults", ","))


@query(f"""WITH {_LOG}, p AS (SELECT DISTINCT user_id * 100 + event_id % 90 AS slot FROM events), b AS (SELECT coalesce(p.slot, c.slot) AS slot, p.slot AS position, coalesce(attempts, 0) AS attempts, coalesce(state, 'not_run') AS state FROM p FULL JOIN c ON p.slot = c.slot), g AS (SELECT min(position) AS gap FROM b WHERE attempts = 0)
SELECT slot, state, attempts, CASE WHEN position IS NULL THEN 'unplanned' WHEN attempts > 0 AND position > gap THEN 'claim_after_gap' END AS fault FROM b, g""")
def r7_attempted_prefix(spark, d):
    plan = table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 90).alias("slot")).distinct().withColumn("position", F.col("slot"))
    return R.attempted_prefix(plan, _claims(spark, d), "slot", "position").select("slot", "state", "attempts", "fault")


@query("""WITH a AS (SELECT conv_id, turn, CASE WHEN turn >= conv_id % 4 THEN md5(text) || 'x' ELSE md5(text) END AS y, md5(text) AS x FROM conversations), f AS (SELECT conv_id, count(*) AS hops, min(turn) FILTER (WHERE x <> y) AS f, min(turn) AS lo FROM a GROUP BY conv_id) SELECT conv_id, hops, coalesce(f - lo, hops) AS prefix FROM f""")
def r8_shared_prefix(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.md5("text")).alias("h"))
    bent = c.withColumn("h", F.when(F.col("turn") >= F.col("conv_id") % 4, F.concat("h", F.lit("x"))).otherwise(F.col("h")))
    return R.shared_prefix(c, bent, "conv_id", "turn", "h")


@query(f"""WITH RECURSIVE {HOPS}, t AS (SELECT case_id, sample AS clock, event_id % 4 AS t, lag(event_id % 4) OVER (PARTITION BY case_id ORDER BY sample) AS prev FROM hops),
k AS (SELECT case_id, clock, t, row_number() OVER (PARTITION BY case_id ORDER BY clock) AS i FROM t WHERE t IS DISTINCT FROM prev),
s AS (SELECT case_id, gap, 0::BIGINT AS i, 0 AS seen, 0::BIGINT AS first, 0::BIGINT AS second, NULL::BIGINT AS third FROM k, (VALUES (1280::BIGINT), (2560), (5120), (12800)) v(gap) WHERE i = 1
UNION ALL SELECT case_id, gap, i, CASE WHEN t = held + 1 THEN (held + 1) % 3 WHEN t = 1 THEN 1 ELSE held END, CASE WHEN t = 1 THEN clock ELSE first END, CASE WHEN t = 2 AND held = 1 THEN clock ELSE second END, CASE WHEN t = 3 AND held = 2 THEN clock END
FROM (SELECT k.case_id, s.gap, k.i, k.t, k.clock, s.first, s.second, CASE WHEN k.clock - CASE s.seen WHEN 1 THEN s.first ELSE s.second END > s.gap THEN 0 ELSE s.seen END AS held FROM s JOIN k ON k.case_id = s.case_id AND k.i = s.i + 1))
SELECT case_id::VARCHAR AS case_id, gap, first, second, third FROM s WHERE third IS NOT NULL""")
def r9_token_sequences(spark, d):
    frames = hops(spark, d).withColumn("token", (F.col("event_id") % 4).cast("int"))
    return R.token_sequences(frames, "case_id", "sample", "token", [1_280, 2_560, 5_120, 12_800])


@query("""WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 49 THEN 'open' WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 = 0 THEN 'clash' WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'prior' ELSE 'returned' END AS outcome FROM orders), f AS (SELECT min(k) AS f FROM p WHERE outcome = 'open')
SELECT outcome, k < f AS in_prefix, count(*) AS n FROM p, f GROUP BY ALL""")
def r10_reconcile(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    used = o.where("o_orderkey % 50 <> 49")
    outcomes = {"failed": used.where("o_orderkey % 3 = 0"), "prior": used.where("o_orderkey % 7 = 0"), "returned": used.where("o_orderkey % 3 <> 0 and o_orderkey % 7 <> 0")}
    return R.reconcile(o, outcomes, "o_orderkey", "o_orderkey").groupBy("outcome", "in_prefix").agg(F.count("*").alias("n"))


@query(f"""WITH {HOPS}, {SEGMENTS}, e AS (SELECT row_number() OVER () AS row, first, second, third, case_id FROM (@R9@) WHERE gap = 12800),
l AS (SELECT row, case_id::BIGINT AS case_id, unnest([0, 1, 2]) AS i, unnest([first, second, third]) AS clock FROM e),
t AS (SELECT row, i, CASE WHEN count(segment) = 1 THEN min(segment) END AS segment, count(segment) > 1 AS many FROM l LEFT JOIN segments s ON l.case_id = s.case_id AND a <= clock AND clock < b + 2560 GROUP BY row, i),
p AS (SELECT row, max(segment) FILTER (WHERE i = 0) AS s0, max(segment) FILTER (WHERE i = 1) AS s1, max(segment) FILTER (WHERE i = 2) AS s2, bool_or(many) AS ambiguous FROM t GROUP BY row)
SELECT case_id, first, third, s0 AS first_segment, s2 AS third_segment, coalesce(s0 = s1 AND s1 = s2, false) AS same, NOT coalesce(s0 = s1 AND s1 = s2, false) AS cross, ambiguous FROM e JOIN p USING (row)""".replace("@R9@", _SQL["r9_token_sequences"]))
def j17_anchor_origin(spark, d):
    h = hops(spark, d)
    found = R.token_sequences(h.withColumn("token", (F.col("event_id") % 4).cast("int")), "case_id", "sample", "token", [12_800])
    seg = segments_of(h).withColumn("case_id", F.col("case_id").cast("string"))
    got = J.anchor_origin(found, ["first", "second", "third"], seg, "case_id", "segment", "a", "b", 2_560)
    return got.select("case_id", "first", "third", "first_segment", "third_segment", "same", "cross", "ambiguous")
