"""Votes of several observers on a clip, and the admissions built on them. Observations are long: one row per (clip, model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import contains_in_order

from .sizes import sized


def first_reason(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The code of the first rule that holds."""
    out = F
    for cond, code in rules:
        out = out.when(cond, F.lit(code))
    return out.otherwise(F.lit(default)) if rules else F.lit(default)


def vote_counts(obs: DataFrame, key: str = "clip_id", text: str = "norm_text", usable: str = "usable", flags: dict[str, Column] | None = None, model: str | None = None) -> DataFrame:
    """Per clip: observers, clean ones, the most frequent clean text (ties: the least) and its votes; and, for each flag, how
    many observations it holds for. With a model column also `models`, the set of observers: it is smaller than `observed` where one has two rows.

    Two levels of partial aggregation in one pass over the observations: no list of rows is built and nothing is joined.
    """
    flags = flags or {}
    clean = F.col(usable) & F.col(text).isNotNull() & (F.col(text) != "")
    sets = [F.collect_set(F.col(model).cast("string")).alias("_m")] if model else []
    texts = obs.groupBy(key, F.when(clean, F.col(text)).alias("_t")).agg(F.count("*").alias("_n"), *[F.count_if(c).alias(f) for f, c in flags.items()], *sets)
    best = F.min(F.when(F.col("_t").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_t").alias("t"))))
    models = [F.array_distinct(F.flatten(F.collect_list("_m"))).alias("models")] if model else []
    out = texts.groupBy(key).agg(F.sum("_n").alias("observed"), F.sum(F.when(F.col("_t").isNotNull(), F.col("_n")).otherwise(0)).alias("clean"), F.count("_t").alias("distinct_texts"), best.alias("_b"), *[F.sum(f).alias(f) for f in flags], *models)
    return out.select(key, "observed", "clean", "distinct_texts", *flags, *(["models"] if model else []), F.col("_b.t").alias("top_text"), F.coalesce(-F.col("_b.n"), F.lit(0)).cast("long").alias("top_votes"))


def roster_fault(roster: list | None = None) -> Column:
    """The rows of a clip are not one a model (a model may not vote twice), or a model is not on the roster. For columns of vote_counts."""
    out = F.size("models") < F.col("observed")
    if roster is not None:
        out = out | (F.size(F.array_except("models", F.array(*[F.lit(str(m)) for m in roster]))) > 0)
    return F.coalesce(out, F.lit(False))


def strict_quorum(obs: DataFrame, keywords: list[str], key: str = "clip_id", text: str = "norm_text", usable: str = "usable", observers: int = 3, model: str = "model", roster: list | None = None) -> DataFrame:
    """A1: all observers clean; all equal gives weight 1; all but one equal, with every keyword present in all or in none, 0.5; else uncertain."""
    both = vote_counts(obs, key, text, usable, {f"_k{i}": F.contains(F.col(text), F.lit(k)) for i, k in enumerate(keywords)}, model)
    split = F.lit(False)
    for i in range(len(keywords)):
        split = split | ((F.col(f"_k{i}") > 0) & (F.col(f"_k{i}") < observers))
    reason = first_reason(
        [
            (roster_fault(roster), "model_roster"),
            (F.col("observed") != observers, "incomplete"),
            (F.col("clean") < observers, "unusable"),
            (F.col("top_votes") == observers, "all_equal"),
            (F.col("top_votes") < observers - 1, "no_majority"),
            (split, "keyword_split"),
        ],
        "majority",
    )
    out = both.withColumn("reason", reason)
    good = F.col("reason").isin("all_equal", "majority")
    weight = F.when(F.col("reason") == "all_equal", 1.0).when(F.col("reason") == "majority", 0.5).otherwise(0.0)
    tier = F.when(F.col("reason") == "all_equal", "three").when(F.col("reason") == "majority", "two").otherwise("uncertain")
    return out.select(key, F.when(good, F.col("top_text")).alias("full_text"), good.alias("mask"), weight.alias("weight"), tier.alias("tier"), "reason")


#: Intents that A2 may label, besides "positive".
NEGATIVE_INTENTS = ("near_miss", "hard_negative", "partial", "speech_negative")


def intent_quorum(obs: DataFrame, intents: DataFrame, keywords: list[str], key: str = "clip_id", text: str = "norm_text", usable: str = "usable", complete: str = "complete", model: str = "model", roster: list | None = None, observers: int = 3) -> DataFrame:
    """A2: two or more equal clean texts, then vetoes by what was asked for; the request only ever vetoes.

    intents: key, intent ("positive" or one of NEGATIVE_INTENTS), keyword (the one intended, for positives), generated (bool), flagged (bool).
    In this order: a repeated or unknown model, a failed generation, no two equal texts, a flagged signal; a positive whose own keyword is not in the
    agreed text; a negative where any usable or complete observation, not only an agreeing one, has the letters of a keyword in
    order; any other intent. An accepted clip has weight 1 if all observers agree, else 0.5, and a target (0 or 1) for each keyword.
    """
    seen = (F.col(usable) | F.coalesce(F.col(complete), F.lit(False))) & F.col(text).isNotNull() & (F.col(text) != "")
    path = F.lit(False)
    for k in keywords:
        path = path | contains_in_order(F.col(text), k)
    both = vote_counts(obs, key, text, usable, {"_paths": seen & path}, model).join(intents.hint("merge"), key, "right")
    top = F.col("top_text")
    positive = F.col("intent").eqNullSafe("positive")
    reason = first_reason(
        [
            (roster_fault(roster), "model_roster"),
            (~F.coalesce("generated", F.lit(False)), "generation_failed"),
            (F.coalesce("top_votes", F.lit(0)) < 2, "no_quorum"),
            (F.coalesce("flagged", F.lit(False)), "audio_flag"),
            (positive & ~F.coalesce(F.col("keyword").isin(*keywords) & F.contains(top, F.col("keyword")), F.lit(False)), "positive_unconfirmed"),
            (~positive & (F.col("_paths") > 0), "negative_has_path"),
            (~positive & ~F.coalesce(F.col("intent").isin(*NEGATIVE_INTENTS), F.lit(False)), "unsupported_intent"),
        ],
        "accepted",
    )
    out = both.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted")
    out = out.withColumn("weight", F.when(~F.col("accepted"), 0.0).when(F.col("top_votes") == observers, 1.0).otherwise(0.5))
    return out.withColumns({f"target_{i}": F.when(F.col("accepted"), F.contains(top, F.lit(k)).cast("int")) for i, k in enumerate(keywords)}).drop("_paths")


def exact_screen(obs: DataFrame, targets: DataFrame, key: str = "clip_id", text: str = "norm_text", usable: str = "usable", observers: int = 3, model: str = "model") -> DataFrame:
    """A3: how many observers heard the target exactly: all, all but one (review), fewer; `hold` while observations lack, `model_roster` where a model has two."""
    heard = F.count_if(F.col(usable) & (F.col(text) == F.col("target")))
    models = F.size(F.collect_set(F.col(model).cast("string")))
    out = targets.hint("merge").join(obs.withColumn("_o", F.lit(1)), key, "left").groupBy(key, "target").agg(F.count("_o").alias("_rows"), models.alias("_models"), F.count(text).alias("seen"), heard.alias("hits"))
    state = first_reason([(F.col("_models") < F.col("_rows"), "model_roster"), (F.col("seen") < observers, "hold"), (F.col("hits") == observers, "match"), (F.col("hits") == observers - 1, "review")], "mismatch")
    return out.withColumn("state", state).drop("_rows", "_models")


def agreement_class(obs: DataFrame, targets: DataFrame, key: str = "clip_id", text: str = "norm_text") -> DataFrame:
    """A4: all match the request, all agree on another text, two agree, or three disagree."""
    per = obs.groupBy(key).agg(F.count_distinct(text).alias("kinds"), F.min(text).alias("low"), F.max(text).alias("high"), F.count("*").alias("n"))
    out = per.join(targets, key)
    kind = first_reason([((F.col("kinds") == 1) & (F.col("low") == F.col("target")), "match_request"), (F.col("kinds") == 1, "agree_other"), (F.col("kinds") < F.col("n"), "two_agree")], "all_differ")
    return out.select(key, "target", kind.alias("agreement"))


def two_model_state(obs: DataFrame, targets: DataFrame, models: tuple[str, str], key: str = "clip_id", model: str = "model", text: str = "norm_text", usable: str = "usable") -> DataFrame:
    """A5: match, agree_mismatch, dispute or unresolved for two models, with every reason for quarantine."""
    one = lambda m, c: F.max(F.when(F.col(model) == m, F.col(c)))
    cols = [one(m, c).alias(f"{c}_{i}") for i, m in enumerate(models) for c in (text, usable)]
    out = targets.join(obs.groupBy(key).agg(*cols), key, "left")
    ok = [F.coalesce(f"{usable}_{i}", F.lit(False)) & F.col(f"{text}_{i}").isNotNull() for i in (0, 1)]
    t0, t1 = F.col(f"{text}_0"), F.col(f"{text}_1")
    state = first_reason([(~(ok[0] & ok[1]), "unresolved"), ((t0 == t1) & (t0 == F.col("target")), "match"), (t0 == t1, "agree_mismatch")], "dispute")
    reasons = F.array_compact(F.array(*[F.when(~ok[i], F.lit(f"unusable_{i}")) for i in (0, 1)], F.when(F.length("target") == 0, F.lit("empty_target"))))
    return out.select(key, "target", state.alias("state"), reasons.alias("reasons"))


def keyword_presence(obs: DataFrame, decisions: DataFrame, keywords: DataFrame, key: str = "clip_id", text: str = "norm_text", usable: str = "usable", observers: int = 3) -> DataFrame:
    """Per clip and keyword: the full-text decision if there is one; else present only on clean hits of every observer; else unknown."""
    grid = decisions.select(key, "mask", "full_text").crossJoin(sized(keywords))
    hits = obs.join(sized(keywords), F.contains(F.col(text), F.col("keyword")) & F.col(usable)).groupBy(key, "keyword").agg(F.count("*").alias("hits"))
    out = grid.join(hits, [key, "keyword"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    inherited = F.col("mask") & F.col("full_text").isNotNull()
    target = F.when(inherited, F.contains("full_text", "keyword").cast("int")).when(F.col("hits") == observers, 1)
    status = F.when(inherited, F.when(F.contains("full_text", "keyword"), "present").otherwise("absent")).when(F.col("hits") == observers, "present").otherwise("unknown")
    return out.select(key, "keyword", "hits", status.alias("status"), target.alias("target"), target.isNotNull().alias("known"))


def blind_admission(obs: DataFrame, patterns: DataFrame, aliases: DataFrame, competing: str, key: str = "clip_id", text: str = "norm_text", usable: str = "usable", phones: str = "phones") -> DataFrame:
    """A clip gets a class when its phones match exactly one pattern in full and two observers or more used an alias of
    that class, with no competing word; a pattern marked `onset_missing` needs three such votes. Else a reason.

    patterns: class, pattern, onset_missing; aliases: class, alias. obs carries one row per observer, phones per clip.
    """
    clips = obs.groupBy(key).agg(F.max(phones).alias("_p"), F.count_if(F.col(usable) & F.col(text).rlike(competing)).alias("rivals"))
    match = clips.join(sized(patterns), F.rlike(F.col("_p"), F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))))
    unique = match.groupBy(key).agg(F.count("*").alias("matches"), F.min("class").alias("class"), F.bool_or("onset_missing").alias("onset_missing"))
    votes = obs.where(F.col(usable)).join(sized(aliases.withColumnRenamed("class", "_c")), F.col(text) == F.col("alias")).groupBy(key, F.col("_c").alias("class")).agg(F.count("*").alias("votes"))
    out = clips.join(unique, key, "left").join(votes, [key, "class"], "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    reason = first_reason(
        [
            (F.col("rivals") > 0, "competing_word"),
            (F.coalesce("matches", F.lit(0)) == 0, "no_pattern"),
            (F.col("matches") > 1, "ambiguous_pattern"),
            (F.col("onset_missing") & (F.col("votes") < 3), "onset_needs_three"),
            (F.col("votes") < 2, "too_few_votes"),
        ],
        "admitted",
    )
    return out.select(key, F.when(reason == "admitted", F.col("class")).alias("class"), "votes", reason.alias("reason"))


def balanced_groups(rows: DataFrame, required: list, group: str = "group", label: str = "label", role: str = "role", min_groups: int = 1) -> DataFrame:
    """Groups whose admitted labels are exactly `required` stay; rows of others lose theirs with a reason; then roles with too few groups."""
    own = rows.groupBy(group).agg(F.sort_array(F.collect_set(label)).alias("_has"))
    out = rows.join(own, group)
    whole = F.col("_has") == F.array(*[F.lit(x) for x in sorted(required)])
    per_role = out.where(whole).groupBy(role).agg(F.count_distinct(group).alias("_groups"))
    out = out.join(sized(per_role), role, "left")
    reason = first_reason([(F.col(label).isNull(), "not_admitted"), (~whole, "group_incomplete"), (F.coalesce("_groups", F.lit(0)) < min_groups, "role_too_small")], "kept")
    return out.withColumn("reason", reason).withColumn("admitted", F.col("reason") == "kept").drop("_has", "_groups")


def minimum_counts(rows: DataFrame, thresholds: DataFrame, keys: list[str], family: str) -> DataFrame:
    """Rows and families of each cell against the least counts wanted; cells without rows appear with 0."""
    got = rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(family).alias("families"))
    out = thresholds.join(got, keys, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rows", "families")})
    return out.withColumn("enough", (F.col("rows") >= F.col("min_rows")) & (F.col("families") >= F.col("min_families")))


def status_counts(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """A10: counts by status, reason and tier, with conditional counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def demote_duplicates(rows: DataFrame, identity: str, eligible: str = "eligible") -> DataFrame:
    """Every member of a group with the same identity loses eligibility; its earlier status stays in was_eligible. Null is no identity.

    The counts are a pre-aggregated join, so a hot identity is not one window partition.
    """
    dup = rows.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.count("*").alias("_n")).where("_n > 1")
    out = rows.withColumn("was_eligible", F.col(eligible)).join(dup, identity, "left")
    return out.withColumn(eligible, F.col(eligible) & F.col("_n").isNull()).withColumn("duplicates", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")


def first_passing(rows: DataFrame, mode: str, order: str, passed: str, voice: str, least: int = 3) -> DataFrame:
    """Per mode, distinct balanced voices; `chosen` marks the first mode in order with at least `least`."""
    per = rows.groupBy(mode, order).agg(F.count_distinct(F.when(F.col(passed), F.col(voice))).alias("balanced"))
    best = per.where(F.col("balanced") >= least).agg(F.min_by(mode, order).alias("_m"))
    return per.crossJoin(F.broadcast(best)).withColumn("chosen", F.col(mode).eqNullSafe(F.col("_m"))).drop("_m")


def unanimous_content(obs: DataFrame, reference: DataFrame, key: str = "clip_id", text: str = "norm_text", model: str = "model") -> DataFrame:
    """Every observer's text equals the publisher's (P8's core): one row per clip with models, matches and the verdict."""
    both = reference.join(obs, key, "left")
    same = F.coalesce(F.col(text) == F.col("reference_text"), F.lit(False))
    return both.groupBy(key).agg(F.count(model).alias("models"), F.count_if(same).alias("matches"), F.bool_and(same).alias("all_match"))
