"""Aggregates for evaluation: counts, confusions, paired comparisons, latency and parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import meet, running


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def event_rollup(events: DataFrame, fixed: list[str], dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """The same facts by all, and by each dimension alone: grouping sets in one pass."""
    sets = [[F.col(c) for c in fixed]] + [[F.col(c) for c in (*fixed, d)] for d in dims]
    out = events.groupingSets(sets, *[F.col(c) for c in (*fixed, *dims)]).agg(F.grouping_id().alias("_g"), *[c.alias(k) for k, c in measures.items()])
    name = F.lit("all")
    n = len(dims)
    for i, d in enumerate(dims):
        mask = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        name = F.when(F.col("_g") == mask, F.lit(d)).otherwise(name)
    return out.withColumn("by", name).drop("_g")


def outcome_counts(df: DataFrame, keys: list[str], hit: Column, wrong: Column, events: str) -> DataFrame:
    """Hits, misses, wrong and extra events."""
    return df.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count_if(wrong).alias("wrong"), F.sum(F.greatest(F.col(events) - 1, F.lit(0))).cast("long").alias("extra"))


def known_confusion(df: DataFrame, keys: list[str], state: str, human: str) -> DataFrame:
    """Confusion against human labels (positive, negative; unknown is in no denominator). known_errors has the rows behind fn and fp.

    state: positive, negative or unknown.
    """
    pos, neg = F.col(human) == "positive", F.col(human) == "negative"
    s = lambda v: F.col(state) == v
    agg = {"tp": pos & s("positive"), "fn": pos & s("negative"), "tn": neg & s("negative"), "fp": neg & s("positive"), "unknown_pos": pos & s("unknown"), "unknown_neg": neg & s("unknown")}
    out = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in agg.items()])
    total = sum((F.col(k) for k in agg), F.lit(0))
    known = F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
    return out.withColumns({"recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp")), "coverage": ratio(known, total)})


def known_errors(df: DataFrame, keys: list[str], state: str, human: str, item: str) -> DataFrame:
    """Every item whose state is the opposite of its human label: false_negative or false_positive."""
    kind = F.when((F.col(human) == "positive") & (F.col(state) == "negative"), "false_negative").when((F.col(human) == "negative") & (F.col(state) == "positive"), "false_positive")
    return df.select(*keys, item, kind.alias("error")).where("error is not null")


def paired_known(df: DataFrame, keys: list[str], first: str, second: str, human: str) -> DataFrame:
    """Two models on bits with a human label: both known, both wrong, definite disagreement, one or both unknown."""
    ok = F.col(human).isin("positive", "negative")
    a, b = F.col(first), F.col(second)
    ka, kb = a != "unknown", b != "unknown"
    agg = {"both_known": ka & kb, "both_wrong": ka & kb & (a != F.col(human)) & (b != F.col(human)), "disagree": ka & kb & (a != b), "one_unknown": ka != kb, "both_unknown": ~ka & ~kb}
    return df.where(ok).groupBy(*keys).agg(*[F.count_if(c).alias(k) for k, c in agg.items()])


def miss_key(df: DataFrame, model: str, label: str, hit: Column, false_events: str) -> DataFrame:
    """Per model: false events, worst and mean miss rate over classes, and its place by (false, worst, mean)."""
    per = df.groupBy(model, label).agg((1 - F.avg(hit.cast("double"))).alias("miss"), F.sum(false_events).alias("false"))
    out = per.groupBy(model).agg(F.sum("false").cast("long").alias("false_events"), F.max("miss").alias("max_miss"), F.avg("miss").alias("mean_miss"))
    return out.withColumn("place", F.row_number().over(W.orderBy("false_events", "max_miss", "mean_miss", model)).cast("long"))


def far_frr(df: DataFrame, model: str, word: str, false_alarms: str, hours: str, misses: str, positives: str) -> DataFrame:
    """False alarms an hour and the share of misses, by model and word."""
    sums = [F.sum(c).alias(f"_{i}") for i, c in enumerate((false_alarms, hours, misses, positives))]
    return df.groupBy(model, word).agg(*sums).select(model, word, ratio(F.col("_0"), F.col("_1")).alias("far_per_hour"), ratio(F.col("_2"), F.col("_3")).alias("frr"))


def dominates(rates: DataFrame, model: str, word: str, better: str, other: str) -> DataFrame:
    """Whether `better` is nowhere worse and somewhere better than `other`, over all words."""
    side = lambda m, p: rates.where(F.col(model) == m).select(word, F.col("far_per_hour").alias(f"{p}_far"), F.col("frr").alias(f"{p}_frr"))
    both = side(better, "a").join(side(other, "b"), word, "full")
    le = (F.col("a_far") <= F.col("b_far")) & (F.col("a_frr") <= F.col("b_frr"))
    lt = (F.col("a_far") < F.col("b_far")) | (F.col("a_frr") < F.col("b_frr"))
    return both.agg(F.bool_and(F.coalesce(le, F.lit(False))).alias("not_worse"), F.bool_or(F.coalesce(lt, F.lit(False))).alias("better")).withColumn("dominates", F.col("not_worse") & F.col("better"))


def shared_gate(arms: DataFrame, words: DataFrame, arm: str, word: str, control: str, treatment: str, max_far: float, budgets: dict[str, float]) -> DataFrame:
    """Two arms under one false-alarm gate and the same budgets, as one row.

    arms: arm, false_alarms, hours and a column for each budget; words: arm, word, misses, positives. An arm is eligible if its false alarms an hour are within
    max_far and every resource within its budget. The treatment dominates if both are eligible, it misses no word more often, and one less often.
    `faults` forbid any comparison: an arm or a word is missing, is there twice or has no positives; hours or positives of the arms are not the same.
    """
    fits = F.col("false_alarms") / F.col("hours") <= max_far
    for c, most in budgets.items():
        fits = fits & (F.col(c) > 0) & (F.col(c) <= most)
    side = lambda m, p: arms.where(F.col(arm) == m).agg(F.count("*").alias(f"{p}_rows"), F.max(F.col("false_alarms") / F.col("hours")).alias(f"{p}_far"), F.max("hours").alias(f"_{p}_hours"), F.bool_and(F.coalesce(fits, F.lit(False))).alias(f"{p}_eligible"))
    two = side(control, "control").crossJoin(F.broadcast(side(treatment, "treatment")))
    of = lambda m, p: words.where(F.col(arm) == m).groupBy(word).agg(F.count("*").alias(f"_{p}_n"), F.max("misses").alias(f"_{p}_miss"), F.max("positives").alias(f"_{p}_pos"))
    pairs = of(control, "c").join(of(treatment, "t").hint("merge"), word, "full")
    c, t = F.col("_c_miss") / F.col("_c_pos"), F.col("_t_miss") / F.col("_t_pos")
    good = (F.col("_c_n") == 1) & (F.col("_t_n") == 1) & (F.col("_c_pos") > 0)
    per = pairs.agg(F.count("*").alias("words"), F.bool_and(F.coalesce(good, F.lit(False))).alias("_good"), F.bool_and(F.coalesce(F.col("_c_pos") == F.col("_t_pos"), F.lit(False))).alias("_equal"), F.bool_and(t <= c).alias("_not_worse"), F.bool_or(t < c).alias("_better"))
    both = two.crossJoin(F.broadcast(per))
    faults = F.array_compact(F.array(
        F.when((F.col("control_rows") != 1) | (F.col("treatment_rows") != 1), F.lit("two_arms_required")),
        F.when(~F.coalesce("_good", F.lit(False)), F.lit("word_missing")),
        F.when(~F.coalesce(F.col("_control_hours") == F.col("_treatment_hours"), F.lit(False)), F.lit("unequal_hours")),
        F.when(~F.coalesce("_equal", F.lit(False)), F.lit("unequal_positives")),
    ))
    both = both.withColumn("faults", faults)
    dominant = (F.size("faults") == 0) & F.col("control_eligible") & F.col("treatment_eligible") & F.col("_not_worse") & F.col("_better")
    return both.select("control_far", "treatment_far", "control_eligible", "treatment_eligible", "words", "faults", F.coalesce(dominant, F.lit(False)).alias("dominates"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of the non-null values by key, interpolated linearly, a column for each share.

    From counts per value and their running sums, so no task holds the values of a key.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running(per, keys, [value], _below=F.col("_n"))
    placed = meet(placed, placed.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
    place = {name: F.lit(q) * (F.col("_all") - 1) for name, q in shares.items()}
    at = lambda i: F.max(F.when((F.col("_below") <= i) & (i < F.col("_below") + F.col("_n")), F.col(value).cast("double")))
    ends = [c for n, p in place.items() for c in (at(F.floor(p)).alias(f"_{n}_0"), at(F.ceil(p)).alias(f"_{n}_1"), F.max(p - F.floor(p)).alias(f"_{n}_f"))]
    mid = lambda n: F.col(f"_{n}_0") + (F.col(f"_{n}_1") - F.col(f"_{n}_0")) * F.col(f"_{n}_f")
    return placed.groupBy(*keys).agg(*ends).select(*keys, *[mid(n).alias(n) for n in shares])


def latency_summary(df: DataFrame, keys: list[str], time: str, audio: str | None = None) -> DataFrame:
    """Exact linear-interpolated p50, p95, p99, the maximum and the real-time factor."""
    shares = {f"p{round(q * 100)}": q for q in (0.5, 0.95, 0.99)}
    rtf = [ratio(F.sum(time), F.sum(audio)).alias("rtf")] if audio else []
    out = meet(df.groupBy(*keys).agg(F.count(time).alias("n"), F.max(time).alias("max"), *rtf), quantiles(df, keys, time, shares), keys, "left")
    return out.select(*keys, "n", *shares, "max", *(["rtf"] if audio else []))


def numeric_parity(left: DataFrame, right: DataFrame, key: list[str], values: str, atol: float, rtol: float) -> DataFrame:
    """Element by element: count, violations of atol + rtol * |x|, the greatest error, and the first violation."""
    side = lambda df, n: df.select(*key, F.col(values).alias(n))
    pairs = F.zip_with(F.coalesce("_x", F.array().cast("array<double>")), F.coalesce("_y", F.array().cast("array<double>")), lambda x, y: F.struct(F.abs(x - y).alias("e"), F.coalesce(F.abs(x - y) > atol + rtol * F.abs(x), F.lit(True)).alias("bad")))
    both = side(left, "_x").join(side(right, "_y"), key, "full").select(*key, pairs.alias("_z"))
    first = F.min(F.when(F.exists("_z", lambda z: z["bad"]), F.struct(*key, (F.array_position(F.transform("_z", lambda z: z["bad"]), True) - 1).cast("int").alias("_pos"))))
    bad = F.size(F.filter("_z", lambda z: z["bad"])).cast("long")
    return both.agg(F.sum(F.size("_z").cast("long")).alias("elements"), F.sum(bad).alias("violations"), F.max(F.array_max(F.transform("_z", lambda z: z["e"]))).alias("max_error"), first.alias("first"))


def identity_groups(df: DataFrame, identity: str, member: str, owner: str | None = None) -> DataFrame:
    """Identities held by several members: how many members (and owners), and the least and greatest member."""
    more = [F.count_distinct(owner).alias("owners")] if owner else []
    return df.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.count("*").alias("members"), F.min(member).alias("first"), F.max(member).alias("last"), *more).where("members > 1")


def ratio_summary(df: DataFrame, keys: list[str], value: str, limit: float) -> DataFrame:
    """Exact median, least and greatest, and how many are over the limit."""
    out = df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.count_if(F.col(value) > limit).alias("flagged"))
    return meet(out, quantiles(df, keys, value, {"median": 0.5}), keys, "left").select(*keys, "median", "least", "greatest", "flagged")


def hits_by_condition(df: DataFrame, condition: str, model: str, models: list[str], hit: Column, case: str) -> DataFrame:
    """Hits by condition, a column for each model, and the net new misses of the last against the first."""
    out = df.groupBy(condition).agg(F.count_distinct(case).alias("cases"), *[F.count_if((F.col(model) == m) & hit).alias(f"hits_{m}") for m in models])
    return out.withColumn("net_new_misses", F.col(f"hits_{models[0]}") - F.col(f"hits_{models[-1]}"))


def shift_histogram(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """How many matched events moved by how much; rescued (only new) and regressed (only old) under null shift."""
    kind = F.when(F.col(old).isNull() & F.col(new).isNull(), "neither").when(F.col(old).isNull(), "rescued").when(F.col(new).isNull(), "regressed").otherwise("matched")
    return pairs.groupBy(kind.alias("kind"), (F.col(new) - F.col(old)).alias("shift")).agg(F.count("*").alias("n"))


def ledger_counts(attempts: DataFrame, keys: list[str], state: str, started: str = "started", completed: str = "completed", failed: str = "failed") -> DataFrame:
    """An attempt has one row; by keys (a stage is one of them) how many completed, failed or are unknown (started, without an outcome), and how many calls
    were made at least (those with an outcome) and at most (all that started). Other states have not been attempted."""
    s = F.col(state)
    out = attempts.groupBy(*keys).agg(F.count_if(s == completed).alias("completed"), F.count_if(s == failed).alias("failed"), F.count_if(s == started).alias("unknown"), F.count_if(~s.isin(started, completed, failed) | s.isNull()).alias("not_run"))
    return out.withColumn("calls_at_least", F.col("completed") + F.col("failed")).withColumn("calls_at_most", F.col("calls_at_least") + F.col("unknown"))


def token_histogram(frames: DataFrame, keys: list[str], token: Column, tokens: list[int]) -> DataFrame:
    """Frames by best token, a column for each token."""
    return frames.withColumn("_t", token).groupBy(*keys).agg(F.count("*").alias("frames"), *[F.count_if(F.col("_t") == t).alias(f"token_{t}") for t in tokens])


def nested_histogram(df: DataFrame, outer: list[str], inner: str) -> DataFrame:
    """A map from inner value to count, by the outer keys."""
    per = df.groupBy(*outer, inner).agg(F.count("*").alias("_n"))
    return per.groupBy(*outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "_n")))).alias("counts"))


def kl_divergence(p: Column, q: Column) -> Column:
    """Sum p * ln(p / q); terms with p = 0 are skipped."""
    terms = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.ln(a) - F.ln(b))).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def running_budget(df: DataFrame, queue: str, order: list, cost: str, per_job: float, total: float) -> DataFrame:
    """Cost so far in each queue, in exact millionths, and whether the job and the running sum stay inside their bounds."""
    out = running(df, [queue], order, spent=F.col(cost).cast("decimal(28,6)"))
    out = out.withColumn("spent", (F.col("spent") + F.col(cost).cast("decimal(28,6)")).cast("double"))
    return out.withColumn("within", (F.col(cost) <= per_job) & (F.col("spent") <= total))


def rank_fraction(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive scores higher, ties by half; and strict separation.

    From counts per score and a running sum over the distinct scores of a key, never the pairs.
    """
    per = df.groupBy(*keys, score).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    wins = running(per, keys, [score], _below=F.col("_n")).withColumn("_w", F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    out = wins.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.min(F.when(F.col("_p") > 0, F.col(score))).alias("_low"), F.max(F.when(F.col("_n") > 0, F.col(score))).alias("_high"))
    return out.withColumn("fraction", ratio(F.col("_w"), F.col("positives") * F.col("negatives"))).withColumn("separated", F.col("_low") > F.col("_high")).drop("_w", "_low", "_high")
