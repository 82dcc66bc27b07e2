"""End-user jobs: thin compositions of operators, each a function of tables, and their registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlake.functions import text as T
from quorumlake.functions.phonetic import target_doubt
from quorumlake.operators import consensus as C
from quorumlake.operators import draws as D
from quorumlake.operators import intervals as I
from quorumlake.operators import joins as J
from quorumlake.operators import lineage as L
from quorumlake.operators import metrics as M
from quorumlake.operators import sampling as X
from quorumlake.operators import signal as G
from quorumlake.operators import validate as V
from quorumlake.operators.sizes import sized
from quorumlake.sources import writers as O

from .base import CLIPS, HOPS, KEYWORDS, OBS, TARGET, clips, evidence_sql, hops, lexicon, observations, table, with_vectors
from .queries import VOTES, query

# --- jobs -----------------------------------------------------------------------------------------------------------


def verify_catalog(catalog: DataFrame, reviews: DataFrame, splits: DataFrame, rules: list[tuple[Column, str]], key: str) -> DataFrame:
    """One row for each finding: failed rules, repeated keys, reviews and splits that do not pair, and leaks across splits."""
    say = lambda df, code, c: df.select(F.col(c).cast("string").alias("item"), F.lit(code).alias("finding"))
    failed = V.rule_reasons(catalog, rules).select(F.col(key).cast("string").alias("item"), F.explode("reasons").alias("finding"))
    twice = say(V.duplicate_keys(catalog, [key]), "repeated_key", key)
    alone = V.roster_difference(catalog, splits, [key]).select(F.col(key).cast("string").alias("item"), F.concat(F.lit("split_only_"), "side").alias("finding"))
    orphan = say(V.orphans(reviews, catalog, [key]), "review_without_clip", key)
    leaks = say(L.role_leaks(catalog.join(splits, key), "split", {"pcm_sha256": "pcm"}), "pcm_in_two_splits", "value")
    return O.union_all([failed, twice, alone, orphan, leaks])


def weak_view(obs: DataFrame, intents: DataFrame, keywords: list[str]) -> DataFrame:
    """Accepted clips with keyword targets and masks, and the exports each row belongs to; refused ones keep their reason."""
    voted = C.intent_quorum(obs, intents, keywords)
    kinds = {"all": F.lit(True), "machine_candidate": F.col("accepted"), "uncertain": ~F.col("accepted"), "disagreement": F.coalesce("top_votes", F.lit(0)) < 3}
    return O.tagged_exports(voted, kinds)


def natural_view(windows: DataFrame, obs: DataFrame, keywords: list[str], parent: str) -> DataFrame:
    """Votes for windows of parent recordings, without any request; by parent: windows, decided ones, and distinct coverage."""
    voted = C.strict_quorum(obs, keywords)
    both = windows.join(voted, "clip_id", "left")
    cover = I.coverage_totals(windows, [parent], "start", "end")
    per = both.groupBy(parent).agg(F.count("*").alias("windows"), F.count_if("mask").alias("decided"), F.sum("weight").alias("weight"))
    return per.join(cover, parent)


def replay_difference(stored: DataFrame, rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stored view that a rebuild does not give back unchanged, and rows that only the rebuild has."""
    cols = sorted(set(stored.columns) - set(keys))
    digest = lambda df: df.select(*keys, V.row_digest(cols).alias("digest"))
    return V.inventory_diff(digest(stored), digest(rebuilt), keys, "digest").where("state <> 'kept'")


def context_view(obs: DataFrame, requests: DataFrame, keyword: str) -> DataFrame:
    """P5: the heard context of the keyword by quorum against the requested one."""
    votes = C.vote_counts(obs).where("top_votes >= 2").select("clip_id", I.keyword_context(F.col("top_text"), keyword).alias("heard"))
    out = requests.join(votes, "clip_id", "left")
    return out.withColumn("state", F.when(F.col("heard").isNull(), "no_quorum").when(F.col("heard") == F.col("requested"), "confirmed").otherwise("other_context"))


def keyword_projection(obs: DataFrame, keywords: DataFrame, lang: str = "lang") -> DataFrame:
    """Per clip and keyword of its language: how many clean observers have it, and present / absent / unknown counts."""
    words = keywords.select(F.col("lang").alias(lang), "keyword")
    hits = obs.join(sized(words), lang).groupBy("clip_id", lang, "keyword").agg(F.count_if("usable").alias("clean"), F.count_if(F.col("usable") & F.contains("norm_text", "keyword")).alias("hits"))
    status = F.when((F.col("clean") == 3) & (F.col("hits") == 3), "present").when((F.col("clean") == 3) & (F.col("hits") == 0), "unheard").otherwise("unknown")
    return hits.withColumn("status", status)


def reference_selection(recordings: DataFrame, speaker: str, seconds: Column, digest: str, wanted: float = 5.0) -> DataFrame:
    """For each speaker the clip closest to the wanted length (ties by digest), without audio that two speakers share."""
    shared = M.identity_groups(recordings, digest, digest, speaker).where("owners > 1").select(digest)
    clean = recordings.join(shared, digest, "left_anti")
    return I.top_per_group(clean, [speaker], [F.abs(seconds - wanted), F.col(digest)])


def campaign(axes: list[DataFrame], repetitions: int, id_parts: list[str], history: DataFrame | None = None) -> DataFrame:
    """Planned requests with stable ids and seeds; those already in the history are refused."""
    out = J.request_grid(axes, repetitions)
    parts = [F.col(c).cast("string") for c in (*id_parts, "repetition")]
    out = out.withColumn("request_id", X.stable_id("req-", *parts)).withColumn("seed", X.stable_seed(*parts))
    if history is None:
        return out.withColumn("state", F.lit("planned"))
    seen = history.select("request_id").distinct().withColumn("_h", F.lit(True))
    return out.join(seen, "request_id", "left").withColumn("state", F.when(F.col("_h"), "refused").otherwise("planned")).drop("_h")


def collection_audit(plan: DataFrame, received: DataFrame, key: str, faults: list[tuple[Column, str]]) -> DataFrame:
    """P10: each planned slot: missing, repeated, faulty or good; and recordings without a slot."""
    per = V.rule_reasons(received, faults).groupBy(key).agg(F.count("*").alias("n"), F.max(F.size("reasons")).alias("_bad"))
    both = plan.select(key, F.lit(True).alias("_p")).join(per, key, "full")
    state = C.first_reason([(F.col("_p").isNull(), "unplanned"), (F.col("n").isNull(), "missing"), (F.col("n") > 1, "repeated"), (F.col("_bad") > 0, "faulty")], "good")
    return both.select(key, state.alias("state"))


def panel_assessment(rows: DataFrame, source: str, cell: str, required: list, role: str) -> DataFrame:
    """Each source: complete or not, conflicting roles, and whether it may be used."""
    broken = V.incomplete_groups(rows, source, cell, required).select(source, F.lit(True).alias("_i"))
    roles = rows.groupBy(source).agg(F.count_distinct(role).alias("roles"), F.count("*").alias("rows"))
    out = roles.join(broken, source, "left")
    state = C.first_reason([(F.col("roles") > 1, "split_conflict"), (F.coalesce("_i", F.lit(False)), "incomplete")], "usable")
    return out.withColumn("state", state).drop("_i")


def review_queue(texts: DataFrame, acoustic: DataFrame, phones: DataFrame, key: str) -> DataFrame:
    """Three kinds of evidence on one cell, ordered for review: largest edit of the tokens heard against those of the target, then difference, then flags.

    The tokens stay behind; only their edit is joined and sorted."""
    edit = texts.withColumn("edit", T.token_distance(F.col("heard"), F.col("target"))).drop("heard", "target")
    both = J.checked_join(J.checked_join(edit, acoustic, [key]), phones, [key])
    return I.numbered(both, [F.desc("edit"), F.desc("difference"), F.desc("flags"), F.col(key)])


def balanced_admission(rows: DataFrame, blind: DataFrame, required: list, group: str, role: str, min_groups: int) -> DataFrame:
    """Blind classes of all planned rows, then only whole groups; the result has every planned row."""
    return C.balanced_groups(rows.join(blind, "clip_id", "left"), required, group, "class", role, min_groups)


def intake_guard(rows: DataFrame, denied: DataFrame, keys: list[str], earlier: DataFrame, id_: str) -> DataFrame:
    """Rows refused by the denylist or because an earlier version had other values; the rest are accepted."""
    ok = V.allowed(rows, denied, keys).select(id_, F.lit(True).alias("_ok"))
    moved = V.changed_rows(earlier, rows.select(earlier.columns), [id_]).select(id_, F.col("state").alias("_s"))
    out = rows.join(ok, id_, "left").join(moved, id_, "left")
    return out.withColumn("state", F.when(F.col("_ok").isNull(), "denied").when(F.col("_s").isNotNull(), "changed").otherwise("accepted")).drop("_ok", "_s")


def paired_gate(old: DataFrame, new: DataFrame, keys: list[str], condition: str, errors: list[str], rescue_in: list[str], min_cases: int) -> DataFrame:
    """Two models on the same cases (keys, condition, hit, and counts of event errors); one row a condition.

    regressed: hits that are lost; rescued: earlier misses that are hit; new_errors: cases with more errors of a kind than before, bad ones too. `code` is what speaks
    against the new model in this condition. It is accepted if no condition has a code, one of rescue_in has a rescue, and each has
    min_cases cases; `reasons` lists what is not so, the same for every row.
    """
    both = old.select(*keys, condition, F.col("hit").alias("_o"), *[F.col(e).alias(f"_o_{e}") for e in errors]).join(new.select(*keys, F.col("hit").alias("_n"), *[F.col(e).alias(f"_n_{e}") for e in errors]).hint("merge"), keys)
    worse = F.lit(False)
    for e in errors:
        worse = worse | (F.col(f"_n_{e}") > F.col(f"_o_{e}"))
    out = both.groupBy(condition).agg(F.count("*").alias("cases"), F.count_if(~F.col("_o") & F.col("_n")).alias("rescued"), F.count_if(F.col("_o") & ~F.col("_n")).alias("regressed"), F.count_if(worse).alias("new_errors"))
    name = F.upper(F.col(condition).cast("string"))
    out = out.withColumn("code", F.when(F.col("regressed") > 0, F.concat(name, F.lit("_CASE_REGRESSION"))).when(F.col("new_errors") > 0, F.concat(name, F.lit("_NEW_EVENT_ERROR"))).when(F.col("cases") < min_cases, F.concat(name, F.lit("_COVERAGE_INSUFFICIENT"))))
    rescues = F.coalesce(F.sum(F.when(F.col(condition).isin(*rescue_in), F.col("rescued"))), F.lit(0))
    whole = out.agg(F.array_sort(F.array_compact(F.concat(F.collect_list("code"), F.array(F.when(rescues < 1, F.lit("NO_MISS_RESCUED")))))).alias("reasons"))
    return out.crossJoin(F.broadcast(whole)).withColumn("accepted", F.size("reasons") == 0)


def recogniser_scores(obs: DataFrame, human: DataFrame, target: str, lexicon: DataFrame) -> DataFrame:
    """Presence states of each model against human labels: the confusion readout.

    A literal target is positive; near, boundary-separated and phonetic candidates and texts without a token in the lexicon are unknown (T9, T10, T12).
    Only texts without the target are looked into, each in its row, up to the first evidence.
    """
    t = F.col("norm_text")
    literal = F.contains(t, F.lit(target))
    rows = obs.withColumn("_open", F.when(F.col("usable") & ~literal, t))
    rows = target_doubt(rows, lexicon, "_open", target, "_doubt")
    state = T.presence_state(~F.col("usable") | t.isNull(), literal, F.coalesce("_doubt", F.lit(False)), F.lit(False))
    states = rows.select("clip_id", "model", state.alias("state"))
    return M.known_confusion(states.join(human.hint("merge"), "clip_id"), ["model"], "state", "human")


def two_arms(rows: DataFrame, model: str, word: str, control: str, treatment: str, max_far: float, budgets: dict[str, float]) -> DataFrame:
    """Rates of both arms under a shared gate and budgets, and whether the treatment dominates.

    rows: model, word, false_alarms, hours, misses, positives and the resources, summed up here.
    """
    arms = rows.groupBy(model).agg(*[F.sum(c).alias(c) for c in ("false_alarms", "hours", *budgets)])
    words = rows.groupBy(model, word).agg(F.sum("misses").alias("misses"), F.sum("positives").alias("positives"))
    return M.shared_gate(arms, words, model, word, control, treatment, max_far, budgets)


def snapshot_union(snapshots: dict[str, DataFrame], identity: str, families: list[str]) -> DataFrame:
    """P20: rows of all snapshots with eligibility derived again: whole duplicate groups lose it; counts by snapshot and family."""
    rows = O.union_all([df.withColumn("snapshot", F.lit(n)) for n, df in snapshots.items()])
    out = C.demote_duplicates(rows, identity)
    return out.groupBy("snapshot", *families).agg(F.count("*").alias("rows"), F.count_if("was_eligible").alias("were_eligible"), F.count_if("eligible").alias("eligible"))


def rescreen(rows: DataFrame, retired: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """An older corpus under new verdicts; retired cells are skipped but listed."""
    gone = retired.select(key).distinct().withColumn("_r", F.lit(True))
    out = rows.join(gone, key, "left").join(verdicts, key, "left")
    return out.withColumn("outcome", F.when(F.col("_r"), "retired").otherwise(F.coalesce("verdict", F.lit("unobserved")))).drop("_r", "verdict")


# --- queries --------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, sha256(text) AS h, n_chars, lang FROM documents WHERE doc_id % 13 <> 0 OR doc_id % 10 = 0)
SELECT finding, count(*) AS n FROM (SELECT 'short' AS finding FROM documents WHERE n_chars < 200 UNION ALL SELECT 'language' FROM documents WHERE lang = 'es' UNION ALL SELECT 'split_only_left' FROM documents WHERE doc_id % 13 = 0 AND doc_id % 10 <> 0
UNION ALL SELECT 'pcm_in_two_splits' FROM s GROUP BY h HAVING count(DISTINCT split) > 1) GROUP BY finding""")
def p1_verify_catalog(spark, d):
    c = clips(spark, d)
    splits = c.where("clip_id % 13 <> 0 or clip_id % 10 = 0").select("clip_id", F.when(F.col("clip_id") % 10 == 0, "dev").otherwise("train").alias("split"))
    reviews = table(spark, d, "labels").select(F.col("doc_id").alias("clip_id"))
    rules = [(F.col("frames") >= 200, "short"), (F.col("lang") != "es", "language")]
    return verify_catalog(c, reviews, splits, rules, "clip_id").groupBy("finding").agg(F.count("*").alias("n"))


@query(f"""{VOTES}, p AS (SELECT clip_id, coalesce(bool_or(usable AND norm_text <> '' AND (regexp_matches(norm_text, 'v.*o.*u.*s') OR regexp_matches(norm_text, 't.*h.*e.*r'))), false) AS path FROM obs GROUP BY clip_id),
a AS (SELECT *, CASE WHEN top_votes < 2 THEN 'no_quorum' WHEN clip_id % 2 = 0 AND NOT contains(top_text, 'ther') THEN 'positive_unconfirmed' WHEN clip_id % 2 = 1 AND path THEN 'negative_has_path' ELSE 'accepted' END AS r FROM votes JOIN p USING (clip_id)),
e AS (SELECT *, unnest(list_filter(['all', CASE WHEN r = 'accepted' THEN 'machine_candidate' ELSE 'uncertain' END, CASE WHEN top_votes < 3 THEN 'disagreement' END], lambda x: x IS NOT NULL)) AS export_kind FROM a)
SELECT export_kind, r AS reason, count(*) AS n, coalesce(sum(CASE WHEN r = 'accepted' THEN contains(top_text, 'vous')::INT END), 0)::BIGINT AS with_vous FROM e GROUP BY ALL""")
def p2_weak_view(spark, d):
    intents = clips(spark, d).select("clip_id", F.when(F.col("clip_id") % 2 == 1, "near_miss").otherwise("positive").alias("intent"), F.lit("ther").alias("keyword"), F.lit(True).alias("generated"), F.lit(False).alias("flagged"))
    got = weak_view(observations(spark, d).withColumn("complete", F.lit(False)), intents, ["vous", "ther"])
    return got.groupBy("export_kind", "reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("target_0"), F.lit(0)).cast("long").alias("with_vous"))


@query(f"""{VOTES}, w AS (SELECT clip_id, family, (clip_id // 20) * 700 AS start, (clip_id // 20) * 700 + c.frames AS "end" FROM clips c),
o AS (SELECT *, max("end") OVER (PARTITION BY family ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), i AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY family ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM o),
u AS (SELECT family, sum(n)::BIGINT AS "distinct" FROM (SELECT family, g, max("end") - min(start) AS n FROM i GROUP BY ALL) GROUP BY family)
SELECT w.family, count(*) AS windows, count_if(mask) AS decided, sum(CASE reason WHEN 'all_equal' THEN 1.0 WHEN 'majority' THEN 0.5 ELSE 0 END)::DOUBLE AS weight, sum("end" - start)::BIGINT AS processed, any_value("distinct") AS "distinct", (sum("end" - start) - any_value("distinct"))::BIGINT AS overlap FROM w JOIN labels3 USING (clip_id) JOIN u ON u.family = w.family GROUP BY w.family""")
def p3_natural_view(spark, d):
    windows = clips(spark, d).select("clip_id", "family", (F.expr("clip_id div 20") * 700).alias("start"), (F.expr("clip_id div 20") * 700 + F.col("frames")).alias("end"))
    return natural_view(windows, observations(spark, d), KEYWORDS, "family")


@query("SELECT doc_id AS clip_id, CASE WHEN doc_id % 31 = 0 THEN 'removed' ELSE 'changed' END AS state FROM documents WHERE doc_id % 31 = 0 OR doc_id % 37 = 0")
def p4_replay_difference(spark, d):
    c = clips(spark, d)
    again = c.where("clip_id % 31 <> 0").withColumn("frames", F.when(F.col("clip_id") % 37 == 0, F.col("frames") + 1).otherwise(F.col("frames")))
    return replay_difference(c, again, ["clip_id"])


@query(f"""{VOTES}, h AS (SELECT clip_id, top_votes, string_split(top_text, 'an') AS q, top_text AS t FROM votes), k AS (SELECT clip_id, CASE WHEN top_votes >= 2 THEN CASE WHEN len(q) = 1 THEN 'absent' WHEN len(q) > 2 THEN 'repeated' WHEN t = 'an' THEN 'isolated' WHEN q[1] = '' THEN 'prefix' WHEN q[2] = '' THEN 'suffix' ELSE 'middle' END END AS heard FROM h)
SELECT CASE WHEN heard IS NULL THEN 'no_quorum' WHEN heard = CASE clip_id % 3 WHEN 0 THEN 'middle' WHEN 1 THEN 'absent' ELSE 'prefix' END THEN 'confirmed' ELSE 'other_context' END AS state, count(*) AS n FROM k GROUP BY 1""")
def p5_context_view(spark, d):
    asked = clips(spark, d).select("clip_id", F.when(F.col("clip_id") % 3 == 0, "middle").when(F.col("clip_id") % 3 == 1, "absent").otherwise("prefix").alias("requested"))
    return context_view(observations(spark, d), asked, "an").groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {OBS}, h AS (SELECT clip_id, o.lang, keyword, count_if(usable) AS clean, count_if(usable AND contains(norm_text, keyword)) AS hits FROM obs o JOIN (VALUES ('en', 'the'), ('en', 'an'), ('fr', 'que')) k(lang, keyword) ON o.lang = k.lang GROUP BY ALL)
SELECT lang, keyword, CASE WHEN clean = 3 AND hits = 3 THEN 'present' WHEN clean = 3 AND hits = 0 THEN 'unheard' ELSE 'unknown' END AS status, count(*) AS n FROM h GROUP BY ALL""")
def p6_keyword_projection(spark, d):
    words = spark.createDataFrame([("en", "the"), ("en", "an"), ("fr", "que")], "lang string, keyword string")
    return keyword_projection(observations(spark, d), words).groupBy("lang", "keyword", "status").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT doc_id, source || ':' || lang AS speaker, sha256(text) AS h, n_chars / 160.0 AS s FROM documents), bad AS (SELECT h FROM c GROUP BY h HAVING count(DISTINCT speaker) > 1)
SELECT speaker, doc_id AS clip_id FROM c WHERE h NOT IN (SELECT h FROM bad) QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY abs(s - 5), h) = 1""")
def p7_reference_selection(spark, d):
    c = clips(spark, d).withColumn("speaker", F.concat_ws(":", "family", "lang"))
    return reference_selection(c, "speaker", F.col("frames") / 160.0, "pcm_sha256").select("speaker", "clip_id")


@query(f"WITH {OBS} SELECT clip_id, count(*) AS models, count_if(norm_text = spoken) AS matches, bool_and(norm_text = spoken) AS all_match FROM obs GROUP BY clip_id")
def p8_content_check(spark, d):
    return C.unanimous_content(observations(spark, d), clips(spark, d).select("clip_id", F.col("spoken").alias("reference_text")))


@query("""WITH g AS (SELECT p_partkey, r_name, rep FROM part CROSS JOIN region CROSS JOIN (VALUES (0), (1)) v(rep)) SELECT 'req-' || substr(sha256(p_partkey || '|' || r_name || '|' || rep), 1, 24) AS request_id, CASE WHEN r_name = 'ASIA' AND rep = 1 THEN 'refused' ELSE 'planned' END AS state FROM g""")
def p9_campaign(spark, d):
    axes = [table(spark, d, "part").select("p_partkey"), table(spark, d, "region").select("r_name")]
    first = campaign(axes, 2, ["p_partkey", "r_name"])
    return campaign(axes, 2, ["p_partkey", "r_name"], first.where("r_name = 'ASIA' and repetition = 1")).select("request_id", "state")


@query("""WITH p AS (SELECT o_orderkey * 8 + n AS slot FROM orders, range(1, 5) r(n)), r AS (SELECT l_orderkey * 8 + l_linenumber AS slot, count(*) AS n, max((l_quantity < 2)::INT) AS bad FROM lineitem GROUP BY 1)
SELECT CASE WHEN p.slot IS NULL THEN 'unplanned' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN bad = 1 THEN 'faulty' ELSE 'good' END AS state, count(*) AS n FROM p FULL JOIN r ON p.slot = r.slot GROUP BY 1""")
def p10_collection_audit(spark, d):
    plan = table(spark, d, "orders").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).select((F.col("o_orderkey") * 8 + F.col("n")).cast("long").alias("slot"))
    got = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("slot"), "l_quantity")
    return collection_audit(plan, got, "slot", [(F.col("l_quantity") >= 2, "short")]).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag = 'A') AS roles, count(*) AS rows, count(DISTINCT l_linenumber) AS cells, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)
SELECT CASE WHEN roles > 1 THEN 'split_conflict' WHEN NOT (rows = cells AND cells = 2 AND hi = 2) THEN 'incomplete' ELSE 'usable' END AS state, count(*) AS n FROM g GROUP BY 1""")
def p11_panel_assessment(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").alias("role"))
    return panel_assessment(rows, "l_orderkey", "l_linenumber", [1, 2], "role").groupBy("state").agg(F.count("*").alias("n"))


@query(f"""{VOTES}, q AS (SELECT c.clip_id, len(regexp_extract_all(spoken, '[a-z]+')) - len(regexp_extract_all(coalesce(top_text, ''), '[a-z]+')) AS edit, (c.frames % 97)::INT AS difference, coalesce(quality, 2)::INT AS flags FROM clips c JOIN votes USING (clip_id) LEFT JOIN labels ON doc_id = c.clip_id) SELECT clip_id, edit::BIGINT AS edit, row_number() OVER (ORDER BY edit DESC, difference DESC, flags DESC, clip_id) AS number FROM q""")
def p12_review_queue(spark, d):
    c = clips(spark, d)
    texts = c.join(C.vote_counts(observations(spark, d)).select("clip_id", "top_text").hint("merge"), "clip_id").select("clip_id", T.latin_words(F.col("spoken")).alias("target"), T.latin_words(F.coalesce("top_text", F.lit(""))).alias("heard"))
    acoustic = c.select("clip_id", (F.col("frames") % 97).cast("int").alias("difference"))
    phones = c.join(table(spark, d, "labels").select(F.col("doc_id").alias("clip_id"), "quality").hint("merge"), "clip_id", "left").select("clip_id", F.coalesce("quality", F.lit(2)).alias("flags"))
    return review_queue(texts, acoustic, phones, "clip_id").select("clip_id", "edit", "number")


@query(f"""{VOTES}, b AS (SELECT clip_id, family, CASE WHEN top_votes = 3 THEN lang END AS class, lang AS role FROM votes), g AS (SELECT family, list_sort(list(DISTINCT class) FILTER (WHERE class IS NOT NULL)) AS has FROM b GROUP BY 1)
SELECT CASE WHEN class IS NULL THEN 'not_admitted' WHEN has IS DISTINCT FROM ['de', 'en', 'es', 'fr'] THEN 'group_incomplete' ELSE 'kept' END AS reason, count(*) AS n FROM b JOIN g USING (family) GROUP BY 1""")
def p13_balanced_admission(spark, d):
    c = clips(spark, d)
    blind = C.vote_counts(observations(spark, d)).join(c.select("clip_id", "lang"), "clip_id").select("clip_id", F.when(F.col("top_votes") == 3, F.col("lang")).alias("class"))
    got = balanced_admission(c.select("clip_id", "family", "lang"), blind, ["en", "de", "fr", "es"], "family", "lang", 1)
    return got.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN source = 'src5' OR lang = 'es' THEN 'denied' WHEN doc_id % 23 = 0 THEN 'changed' ELSE 'accepted' END AS state, count(*) AS n FROM documents GROUP BY 1")
def p14_intake_guard(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    denied = spark.createDataFrame([("source", "src5"), ("lang", "es")], "kind string, value string")
    earlier = docs.select("doc_id", F.when(F.col("doc_id") % 23 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return intake_guard(docs, denied, ["source", "lang"], earlier, "doc_id").groupBy("state").agg(F.count("*").alias("n"))


@query(f"""WITH {OBS}, w AS (SELECT clip_id, lang, bool_or(norm_text = spoken) FILTER (WHERE model = 0) AS o, bool_or(norm_text = spoken) FILTER (WHERE model = 1) AS n, clip_id % 7 // 6 AS oe, clip_id % 9 // 8 AS ne FROM obs GROUP BY ALL),
c AS (SELECT lang, count(*) AS cases, count_if(NOT o AND n) AS rescued, count_if(o AND NOT n) AS regressed, count_if(ne > oe) AS new_errors FROM w GROUP BY lang),
k AS (SELECT *, CASE WHEN regressed > 0 THEN upper(lang) || '_CASE_REGRESSION' WHEN new_errors > 0 THEN upper(lang) || '_NEW_EVENT_ERROR' WHEN cases < 10 THEN upper(lang) || '_COVERAGE_INSUFFICIENT' END AS code FROM c),
r AS (SELECT list_sort(list_filter(list(code) || [CASE WHEN coalesce(sum(rescued) FILTER (WHERE lang = 'en'), 0) < 1 THEN 'NO_MISS_RESCUED' END], lambda x: x IS NOT NULL)) AS reasons FROM k)
SELECT lang, cases, rescued, regressed, new_errors, code, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted FROM k, r""")
def p15_paired_gate(spark, d):
    obs = observations(spark, d).withColumn("hit", F.col("norm_text") == F.col("spoken"))
    old = obs.where("model = 0").withColumn("wrong_events", F.expr("clip_id % 7 div 6"))
    new = obs.where("model = 1").withColumn("wrong_events", F.expr("clip_id % 9 div 8"))
    return paired_gate(old, new, ["clip_id"], "lang", ["wrong_events"], ["en"], 10).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {OBS}, {evidence_sql("SELECT DISTINCT sha256(norm_text) AS digest, norm_text AS text FROM obs WHERE usable", "digest")},
s AS (SELECT model, CASE WHEN NOT usable THEN 'unknown' ELSE state END AS state, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS human FROM obs JOIN labels ON clip_id = doc_id LEFT JOIN (SELECT digest, state FROM evidence) ON digest = sha256(norm_text))
SELECT model, count_if(human = 'positive' AND state = 'positive') AS tp, count_if(human = 'positive' AND state = 'negative') AS fn, count_if(human = 'negative' AND state = 'negative') AS tn, count_if(human = 'negative' AND state = 'positive') AS fp FROM s GROUP BY model""")
def p16_recogniser_scores(spark, d):
    human = table(spark, d, "labels").select(F.col("doc_id").alias("clip_id"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("human"))
    return recogniser_scores(observations(spark, d), human, TARGET, lexicon(spark)).select("model", "tp", "fn", "tn", "fp")


@query("""WITH a AS (SELECT sum((l_discount > 0.05)::INT) / sum(l_quantity) AS c, sum((l_discount > 0.06)::INT) / sum(l_quantity) AS t, sum(l_linenumber) AS s, sum(l_linenumber) + count(*) AS s2 FROM lineitem), w AS (SELECT l_returnflag AS w, sum((l_tax > 0.04)::INT) AS c, sum((l_tax > 0.05)::INT) AS t FROM lineitem GROUP BY 1)
SELECT round(a.c, 9) AS control_far, round(a.t, 9) AS treatment_far, a.c <= 0.02 AND s <= 1e7 AS control_eligible, a.t <= 0.02 AND s2 <= 1e7 AS treatment_eligible, (SELECT count(*) FROM w) AS words, '' AS faults, a.c <= 0.02 AND a.t <= 0.02 AND s2 <= 1e7 AND (SELECT bool_and(w.t <= w.c) AND bool_or(w.t < w.c) FROM w) AS dominates FROM a""")
def p17_two_arms(spark, d):
    l = table(spark, d, "lineitem")
    arm = lambda name, alarm, miss, more: l.select(F.lit(name).alias("model"), F.col("l_returnflag").alias("word"), (F.col("l_discount") > alarm).cast("int").alias("false_alarms"), F.col("l_quantity").alias("hours"), (F.col("l_tax") > miss).cast("int").alias("misses"), F.lit(1).alias("positives"), (F.col("l_linenumber") + more).alias("seconds"))
    got = two_arms(arm("control", 0.05, 0.04, 0).unionByName(arm("treatment", 0.06, 0.05, 1)), "model", "word", "control", "treatment", 0.02, {"seconds": 1e7})
    return got.withColumns({"control_far": F.round("control_far", 9), "treatment_far": F.round("treatment_far", 9), "faults": F.array_join("faults", ",")})


@query("SELECT user_id, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS \"max\" FROM events GROUP BY user_id")
def p18_latency_report(spark, d):
    got = M.latency_summary(table(spark, d, "events"), ["user_id"], "value")
    return got.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "max")


def _draw_tables(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("role"), "n_chars", (1 + F.col("doc_id") % 60).alias("used"))
    pool = table(spark, d, "supplier").select((F.col("s_suppkey") % 5).cast("int").alias("role"), F.col("s_suppkey").alias("track"), (200 + F.col("s_suppkey") * 7919 % 9000).alias("frames"))
    return rows, pool


_POOL = "t AS (SELECT (s_suppkey % 5)::INT AS role, s_suppkey AS track, 200 + s_suppkey * 7919 % 9000 AS frames FROM supplier)"


def _drawn(i: int, condition: str) -> str:
    """SQL of one condition's draws: the track used before and those of earlier conditions are left out."""
    gone = "".join(f" AND (p.doc_id, track) NOT IN (SELECT (doc_id, track) FROM c{k})" for k in range(i))
    number = lambda at: f"('0x' || substr(sha256('mix/{condition}/' || p.doc_id), {at}, 16))::UBIGINT::HUGEINT"
    return f"""e{i} AS (SELECT p.doc_id, '{condition}' AS condition, n_chars, track, frames, {number(1)} AS h, {number(17)} AS h2, row_number() OVER (PARTITION BY p.doc_id ORDER BY track) - 1 AS r, count(*) OVER (PARTITION BY p.doc_id) AS n FROM p JOIN t ON t.role = p.role AND frames >= n_chars AND track <> used{gone}),
c{i} AS (SELECT doc_id, condition, track, (h2 % (frames - n_chars + 1))::BIGINT AS "offset" FROM e{i} WHERE r = h % n)"""


CONDITIONS = ["near", "far", "street"]


@query(f"""WITH {_POOL}, p AS (SELECT doc_id, (doc_id % 5)::INT AS role, n_chars, 1 + doc_id % 60 AS used FROM documents), {", ".join(_drawn(i, c) for i, c in enumerate(CONDITIONS))}, a AS (FROM c0 UNION ALL FROM c1 UNION ALL FROM c2)
SELECT p.doc_id, k.condition, track, "offset", CASE WHEN track IS NULL THEN 'no_track_left' END AS reason FROM p CROSS JOIN (VALUES ('near'), ('far'), ('street')) k(condition) LEFT JOIN a ON a.doc_id = p.doc_id AND a.condition = k.condition""")
def p19_condition_table(spark, d):
    rows, pool = _draw_tables(spark, d)
    return D.draw_conditions(rows, pool, CONDITIONS, "doc_id", "role", "n_chars", "track", "frames", "mix", "used").select("doc_id", "condition", "track", "offset", "reason")


@query(f"""WITH {_POOL}, p AS (SELECT doc_id, (doc_id % 5)::INT AS role, n_chars FROM documents), e AS (SELECT doc_id, n_chars, track, frames, ('0x' || substr(sha256('snr/' || doc_id), 1, 16))::UBIGINT AS h, ('0x' || substr(sha256('snr/' || doc_id), 17, 16))::UBIGINT AS h2, row_number() OVER (PARTITION BY doc_id ORDER BY track) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM p JOIN t ON t.role = p.role AND frames >= n_chars)
SELECT p.doc_id, track, (h2 % (frames - e.n_chars + 1)::UBIGINT)::BIGINT AS "offset", CASE WHEN track IS NULL THEN 'no_track_left' END AS reason FROM p LEFT JOIN e ON e.doc_id = p.doc_id AND r = h % n""")
def j14_eligible_draws(spark, d):
    rows, pool = _draw_tables(spark, d)
    return D.draw_tracks(rows, pool, "doc_id", "role", "n_chars", "track", "frames", "snr").select("doc_id", "track", "offset", "reason")


@query("""WITH r AS (SELECT 'old' AS snapshot, lang, sha256(text) AS h, source <> 'src3' AS ok FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'new', lang, sha256(text), source <> 'src3' FROM documents WHERE doc_id % 3 = 0), n AS (SELECT h, count(*) AS n FROM r GROUP BY h)
SELECT snapshot, lang, count(*) AS rows, count_if(ok) AS were_eligible, count_if(ok AND n = 1) AS eligible FROM r JOIN n USING (h) GROUP BY ALL""")
def p20_snapshot_union(spark, d):
    c = clips(spark, d).select("clip_id", "lang", "pcm_sha256", (F.col("family") != "src3").alias("eligible"))
    return snapshot_union({"old": c.where("clip_id % 2 = 0"), "new": c.where("clip_id % 3 = 0")}, "pcm_sha256", ["lang"])


@query(f"""{VOTES} SELECT CASE WHEN family = 'src2' THEN 'retired' WHEN reason = 'unusable' THEN 'unobserved' ELSE reason END AS outcome, count(*) AS n FROM labels3 GROUP BY 1""")
def p21_rescreen(spark, d):
    c = clips(spark, d)
    verdicts = C.strict_quorum(observations(spark, d), KEYWORDS).where("reason <> 'unusable'").select("clip_id", F.col("reason").alias("verdict"))
    return rescreen(c, c.where("family = 'src2'"), verdicts, "clip_id").groupBy("outcome").agg(F.count("*").alias("n"))


# --- sources, digests and signal jobs over the given tables ----------------------------------------------------------


@query("SELECT count(*) AS rows, count(DISTINCT p_partkey) AS keys FROM part")
def io11_table_digest(spark, d):
    p = table(spark, d, "part")
    a, b = O.table_digest(p), O.table_digest(p.orderBy(F.desc("p_partkey")).select(*reversed(p.columns)))
    same = a.join(b.withColumnRenamed("rows", "rows_b"), "digest")
    return same.crossJoin(p.agg(F.count_distinct("p_partkey").alias("keys"))).select("rows", "keys")


@query("SELECT export_kind, lang, count(*) AS n FROM (SELECT lang, unnest(CASE WHEN n_chars > 2000 THEN ['all', 'long'] ELSE ['all'] END) AS export_kind FROM documents) GROUP BY ALL")
def io9_tagged_exports(spark, d):
    rows = O.tagged_exports(table(spark, d, "documents"), {"all": F.lit(True), "long": F.col("n_chars") > 2000})
    return rows.groupBy("export_kind", "lang").agg(F.count("*").alias("n"))


def _waves(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("clip"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


@query("""WITH v AS (SELECT vec_id::VARCHAR AS clip, CASE vec_id % 20 WHEN 3 THEN list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 'nan'::DOUBLE ELSE x::DOUBLE END) WHEN 4 THEN list_transform(embedding, lambda x: x::DOUBLE * 40) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS x FROM embeddings),
r AS (SELECT *, CASE WHEN list_bool_or(list_transform(x, lambda v: isnan(v))) THEN 'nonfinite' END AS reason FROM v)
SELECT clip, reason, CASE WHEN reason IS NULL THEN list_sum([greatest(-32768, least(32767, round_even(v * 32768, 0)))::BIGINT FOR v IN x])::BIGINT END AS total, CASE WHEN reason IS NULL THEN len(list_filter(x, lambda v: round_even(v * 32768, 0) > 32767 OR round_even(v * 32768, 0) < -32768)) END AS saturated FROM r""")
def g1_quantise(spark, d):
    w = _waves(spark, d).withColumn("k", F.col("clip").cast("long") % 20)
    bent = F.when(F.col("k") == 3, F.transform("x", lambda v: F.when(v > F.lit(0.1), float("nan")).otherwise(v))).when(F.col("k") == 4, F.transform("x", lambda v: v * 40)).otherwise(F.col("x"))
    got = G.quantise(w.withColumn("x", bent), "clip", "x", least=1)
    return got.select("clip", "reason", F.aggregate("pcm", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), "saturated")


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE * CASE WHEN vec_id % 10 = 0 THEN 10 ELSE 20000 END * CASE WHEN unnest(range(len(embedding))) % 24 BETWEEN 8 AND 14 THEN 0.001 ELSE 1 END AS x, unnest(range(len(embedding))) AS i FROM embeddings), f AS (SELECT vec_id, i // 4 AS f, sqrt(sum(x * x) / 4) AS rms FROM v GROUP BY ALL HAVING count(*) = 4), m AS (SELECT vec_id, max(rms) AS top, count(*) AS n FROM f GROUP BY vec_id),
l AS (SELECT vec_id, f, f - lag(f) OVER (PARTITION BY vec_id ORDER BY f) - 1 AS quiet FROM f JOIN m USING (vec_id) WHERE top >= 100 AND rms > 0.01 * top)
SELECT e.vec_id::VARCHAR AS clip, 10 * coalesce(min(f), 0) AS lead_ms, 10 * coalesce(any_value(n) - 1 - max(f), 0) AS tail_ms, 10 * CASE WHEN any_value(top) < 100 THEN any_value(n) ELSE coalesce(max(quiet), 0) END AS inner_ms FROM embeddings e LEFT JOIN m USING (vec_id) LEFT JOIN l USING (vec_id) GROUP BY e.vec_id""")
def g2_silence(spark, d):
    w = _waves(spark, d).withColumn("loud", F.when(F.col("clip").cast("long") % 10 == 0, 10).otherwise(20_000))
    bent = F.transform("x", lambda v, i: v * F.col("loud") * F.when((i % 24 >= 8) & (i % 24 <= 14), 0.001).otherwise(1))
    return G.silence(w.withColumn("x", bent), "clip", "x", rate=400)


@query()
def g3_log_mel(spark, d):
    long = F.flatten(F.array_repeat(F.transform("x", lambda v: v * 20000), 10))
    got = G.log_mel(_waves(spark, d).select("clip", long.alias("x")), "clip", "x", bands=20)
    return got.select("clip", F.size("features").alias("frames"), F.size(F.get("features", F.lit(0))).alias("bands"))


def _matrices(spark, d) -> DataFrame:
    rows = with_vectors(hops(spark, d))
    return rows.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample", "probabilities"))), lambda x: x["probabilities"]).alias("m"))


@query()
def g4_dtw_pairs(spark, d):
    m = _matrices(spark, d)
    pairs = m.join(m.select((F.col("case_id") - 1).alias("case_id"), F.col("m").alias("n")), "case_id")
    return G.dtw_pairs(pairs, ["case_id"], "m", "n").withColumn("distance", F.round("distance", 9))


@query()
def g5_ctc_scores(spark, d):
    m = _matrices(spark, d).select(F.col("case_id").cast("string").alias("case_id"), F.transform("m", lambda r: F.transform(r, lambda x: F.ln(x))).alias("m"))
    return G.ctc_scores(m, "case_id", "m", {"one": [1], "two": [2], "one_two": [1, 2], "two_one": [2, 1]})


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 20000) AS c, list_transform(list_reverse(embedding), lambda x: x::DOUBLE * 9000) AS n FROM embeddings),
g AS (SELECT *, list_sum(list_transform(c, lambda x: x * x)) AS pc, list_sum(list_transform(n, lambda x: x * x)) AS pn FROM v), a AS (SELECT *, CASE WHEN pc > 0 AND pn > 0 THEN sqrt(pc / pn / 10) END AS gain FROM g),
o AS (SELECT *, list_transform(list_zip(c, n), lambda z: round_even(z[1] + gain * z[2], 0)) AS pcm FROM a)
SELECT vec_id::VARCHAR AS clip, CASE WHEN gain IS NOT NULL AND list_max(list_transform(pcm, lambda x: abs(x))) <= 32767 THEN list_sum(pcm)::BIGINT END AS total, round(gain, 9) AS gain, CASE WHEN gain IS NULL THEN 'silent' WHEN list_max(list_transform(pcm, lambda x: abs(x))) > 32767 THEN 'no_headroom' END AS reason FROM o""")
def g6_mix_snr(spark, d):
    w = _waves(spark, d).select("clip", F.transform("x", lambda v: v * 20000).alias("x"), F.transform(F.reverse("x"), lambda v: v * 9000).alias("noise"), F.lit(10.0).alias("snr"))
    total = F.aggregate("pcm", F.lit(0).cast("long"), lambda a, v: a + v)
    return G.mix_snr(w, "clip", "x", "noise", "snr").select("clip", total.alias("total"), F.round("gain", 9).alias("gain"), "reason")


@query()
def g7_add_context(spark, d):
    w = _waves(spark, d).select("clip", F.transform("x", lambda v: v * 20000).alias("x"))
    return G.add_context(w, "clip", "x", 32, 16, 40.0).select("clip", F.size("pcm").alias("samples"), "clip_start")


@query("SELECT vec_id::VARCHAR AS clip, g AS gain, list_sum([greatest(-32768, least(32767, round_even(round_even(v::DOUBLE * 20000, 0) * g, 0)))::BIGINT FOR v IN embedding])::BIGINT AS total FROM embeddings, (VALUES (0.5::DOUBLE), (2.0::DOUBLE), (8.0::DOUBLE)) t(g)")
def g8_gain_variants(spark, d):
    gains = spark.createDataFrame([(0.5,), (2.0,), (8.0,)], "gain double")
    w = _waves(spark, d).select("clip", F.transform("x", lambda v: F.rint(v * 20000)).alias("x"))
    return G.gain_variants(w, "x", gains).select("clip", "gain", F.aggregate("pcm", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) >= 240 + 2 * (doc_id % 9) THEN sha256(from_hex(substr(hex(encode(text)), 81 + 4 * (doc_id % 9), 400))) END AS window_sha256 FROM documents")
def g9_slice_windows(spark, d):
    at = (20 + F.col("doc_id") % 9).cast("int")
    rows = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("pcm"), at.alias("a"), (at + 100).alias("b"))
    return G.slice_windows(rows, "pcm", "a", "b").select("doc_id", "window_sha256")


@query("SELECT vec_id::VARCHAR AS clip, (vec_id % 40)::BIGINT AS start, (vec_id % 40 + 1 + label % 5)::BIGINT AS \"end\" FROM embeddings UNION ALL SELECT vec_id::VARCHAR, 64, 66 FROM embeddings")
def g10_sample_difference(spark, d):
    at = F.col("clip").cast("long") % 40
    bent = F.concat(F.transform("x", lambda v, i: F.when((i >= at) & (i <= at + F.col("label") % 5), v + 1).otherwise(v)), F.array(F.lit(0.0), F.lit(0.0)))
    return G.sample_difference(_waves(spark, d).withColumn("y", bent), "clip", "x", "y")


@query("SELECT l_orderkey, l_linenumber, len(list_filter(range(0, 100000, 1280), lambda e: e - 35200 <= l_quantity * 700 AND e >= l_quantity * 700 + l_linenumber * 2000)) AS ends FROM lineitem")
def g11_covering_ends(spark, d):
    at = (F.col("l_quantity") * 700).cast("long")
    ends = G.covering_ends(F.lit(0).cast("long"), F.lit(1280).cast("long"), F.lit(99_999).cast("long"), F.lit(35_200), at, at + F.col("l_linenumber") * 2000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(ends).cast("long").alias("ends"))


@query(f"""WITH {HOPS}, {CLIPS}, n AS (SELECT case_id, max(sample) AS frames FROM hops GROUP BY 1), spans AS (SELECT h.case_id AS parent, greatest(0, sample - 3200) AS start, least(frames, sample + 3200) AS "end", p, sample FROM hops h JOIN n USING (case_id) WHERE p >= 0.97),
o AS (SELECT *, max("end") OVER (PARTITION BY parent ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), i AS (SELECT *, sum((reach IS NULL OR start >= reach)::INT) OVER (PARTITION BY parent ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM o),
w AS (SELECT parent, min(start) AS a, max("end") AS b, count(*) AS seeds FROM i GROUP BY parent, g), e AS (SELECT parent, a, b, seeds, max(p) AS peak FROM w JOIN hops ON case_id = parent AND a < sample AND sample <= b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY peak DESC, a) AS k FROM e), t AS (SELECT parent, a, row_number() OVER (ORDER BY peak DESC, a, parent) AS q FROM r WHERE k <= 2)
SELECT r.parent AS case_id, r.a AS start, r.b AS "end", seeds, peak, CASE WHEN k > 2 THEN 'EXCLUDED_PER_SOURCE_CAP' WHEN q > 32 THEN 'EXCLUDED_GLOBAL_CAP' ELSE 'SELECTED' END AS state FROM r LEFT JOIN t USING (parent, a)""")
def r6_hard_negatives(spark, d):
    """Windows around high hops, their peak, and the two caps."""
    h = hops(spark, d)
    seeds = h.where("p >= 0.97").join(h.groupBy("case_id").agg(F.max("sample").alias("frames")), "case_id")
    w = I.candidate_windows(seeds, "case_id", "sample", F.col("frames"), 3200, 3200).withColumnRenamed("members", "n_seeds")
    scored = J.range_join(h.select("case_id", "sample", "p"), w.select("case_id", "start", "end", "n_seeds"), "case_id", "sample", "start", "end", width=128_000)
    per = scored.groupBy("case_id", "start", "end", F.col("n_seeds").alias("seeds")).agg(F.max("p").alias("peak"))
    return I.capped(per, "case_id", [F.desc("peak"), F.col("start"), F.col("case_id")], ["case_id", "start"], 2, 32).select("case_id", "start", "end", "seeds", "peak", "state")
