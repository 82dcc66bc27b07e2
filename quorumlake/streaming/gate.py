"""Event gates on score streams in batch; streams.py has them on Structured Streaming, with the same transition functions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GatePolicy:
    """Numbers of the gate. Class 0 is background; the threshold is compared as a 32-bit float."""

    threshold: float = 0.8
    confirmations: int = 3
    block_samples: int = 16_640
    warm_hops: int = 15

    @property
    def least(self) -> float:
        return float(np.float32(self.threshold))


#: state: hops seen, class being confirmed, its count, first sample after the block
START = (0, -1, 0, -1)


def gate_step(state: tuple[int, int, int, int], sample: int, best: int, top: float, policy: GatePolicy) -> tuple[tuple[int, int, int, int], int | None]:
    """The next state and the class of an event at this hop, if there is one. best: class of the largest probability; top: that, as a 32-bit float.

    Warm-up, background, a low best class or a blocked hop resets the count; another class starts it at one.
    """
    hops, label, count, until = state
    if hops < policy.warm_hops or sample < until or best == 0 or top < policy.least:
        return (hops + 1, -1, 0, until), None
    count = count + 1 if best == label else 1
    if count < policy.confirmations:
        return (hops + 1, best, count, until), None
    return (hops + 1, -1, 0, sample + policy.block_samples), best


def best_of(scores: DataFrame, keep: list[Column], probabilities: str = "probabilities") -> DataFrame:
    """The kept columns with the best class (ties: the first) and its probability, as 32-bit floats."""
    p = F.col(probabilities).cast("array<float>")
    return scores.select(*keep, (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("best"), F.array_max(p).alias("top"))


def gate_events(scores: DataFrame, case: str = "case_id", sample: str = "sample", probabilities: str = "probabilities", policy: GatePolicy = GatePolicy()) -> DataFrame:
    """R1 in batch: events (case, sample, class). Rows are dealt and sorted by case; a task carries one small state, so a
    long case needs no more memory than a short one. streams.gate_stream is the same on a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, START
        for b in batches:
            out = []
            for c, s, best, top in zip(b["c"].tolist(), b["s"].tolist(), b["best"].tolist(), b["top"].tolist()):
                if c != now:
                    now, state = c, START
                state, hit = gate_step(state, s, best, top, policy)
                if hit is not None:
                    out.append((c, s, hit))
            yield pd.DataFrame(out, columns=["c", "s", "k"])

    rows = best_of(scores, [F.col(case).cast("string").alias("c"), F.col(sample).cast("long").alias("s")], probabilities)
    out = rows.repartition("c").sortWithinPartitions("c", "s").mapInPandas(run, "c string, s long, k int")
    return out.select(F.col("c").alias(case), F.col("s").alias(sample), F.col("k").alias("event_class"))


def event_summary(both: DataFrame, keys: list[str], sample: str, label: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """R2, R3 over rows of cases with one event each, or with a null one; grouped by keys, of which weak_class, clip_start and clip_eof are three.

    An event up to and with clip_start is a prefix event (none without a clip_start). Later ones of the expected class match; with low and high only
    from clip_eof + low to clip_eof + high, and are early or late else. Later ones of another class are wrong. Where nothing is expected (class 0) all
    events are negative events, and none of these. `missing` is a case without a match: censored at the observed end, not a rejection.
    """
    at = F.col(sample)
    seen, wanted = at.isNotNull(), F.col("weak_class") > 0
    prefix = seen & F.coalesce(at <= F.col("clip_start"), F.lit(False))
    own = seen & ~prefix & wanted & (F.col(label) == F.col("weak_class"))
    wrong = seen & ~prefix & wanted & (F.col(label) != F.col("weak_class"))
    early = own & (at < F.col("clip_eof") + low) if low is not None else F.lit(False)
    late = own & (at > F.col("clip_eof") + high) if high is not None else F.lit(False)
    match = own & ~early & ~late
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = both.groupBy(*keys).agg(
        count(seen).alias("events"), count(prefix).alias("prefix_events"), count(match).alias("matches"), count(early).alias("early_events"), count(late).alias("late_events"),
        count(wrong).alias("wrong_events"), count(seen & ~wanted).alias("negative_events"), F.min(F.when(match, at)).alias("matched_at"),
    )
    out = out.withColumns({"extra_events": F.greatest(F.col("matches") - 1, F.lit(0).cast("long")), "missing": (F.col("weak_class") > 0) & (F.col("matches") == 0), "lag_samples": F.col("matched_at") - F.col("clip_eof")})
    bad = F.col("prefix_events") + F.col("early_events") + F.col("late_events") + F.col("wrong_events") + F.col("negative_events") + F.col("extra_events")
    return out.withColumn("error", (bad > 0) | F.col("missing"))


def evaluate_events(events: DataFrame, cases: DataFrame, case: str, sample: str, label: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """R2, and with low and high R3 (128 and 16,000 by default there): one row a case, see event_summary.

    cases: case, weak_class (0: none expected), clip_start and clip_eof (null where nothing is expected).
    """
    both = cases.select(case, "weak_class", "clip_start", "clip_eof").join(events.select(case, sample, label).hint("merge"), case, "left")
    return event_summary(both, [case, "weak_class", "clip_start", "clip_eof"], sample, label, low, high)


#: Samples after the end of a clip from which, and up to which, an event counts as its match in R3.
MATCH_LOW, MATCH_HIGH = 128, 16_000


def windowed_match(events: DataFrame, cases: DataFrame, case: str, sample: str, label: str, low: int = MATCH_LOW, high: int = MATCH_HIGH) -> DataFrame:
    """evaluate_events with the match window. Early and late are labels; nothing is dropped. streams.match_stream is the same on two streams."""
    return evaluate_events(events, cases, case, sample, label, low, high)


def event_consistency(derived: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Events that only the frames, or only the store, give."""
    a, b = derived.select(*keys).withColumn("_a", F.lit(1)), stored.select(*keys).withColumn("_b", F.lit(1))
    return a.join(b, keys, "full").where(F.col("_a").isNull() | F.col("_b").isNull()).withColumn("side", F.when(F.col("_b").isNull(), "derived").otherwise("stored")).drop("_a", "_b")


def trace_summary(hops: DataFrame, case: str, sample: str, ready: str, event: Column) -> DataFrame:
    """Hops, ready outputs, events and the last sample of each case; works on a stream too."""
    return hops.groupBy(case).agg(F.count("*").alias("windows"), F.count_if(ready).alias("ready"), F.count_if(event).alias("events"), F.max(sample).alias("last_sample"))


#: States of a slot that consume it, and those that say how it ended.
CONSUMED, ENDED = ("started", "completed", "failed"), ("completed", "failed")


def claim_state(log: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Per slot the latest state, how many attempts it had, whether it may never be issued again, and what is wrong with its log:
    an outcome without a claim before it, or a second claim. A record that is there twice (same slot and order) counts once."""
    s = F.col(state)
    once = log.select(key, order, state).dropDuplicates([key, order])
    first = lambda c: F.min(F.when(c, F.col(order)))
    out = once.groupBy(key).agg(F.max_by(state, order).alias("state"), F.count_if(s == "started").alias("attempts"), F.bool_or(s.isin(*CONSUMED)).alias("consumed"), first(s == "started").alias("_claim"), first(s.isin(*ENDED)).alias("_end"))
    early = F.col("_end").isNotNull() & (F.col("_claim").isNull() | (F.col("_end") < F.col("_claim")))
    faults = F.array_compact(F.array(F.when(early, F.lit("outcome_without_claim")), F.when(F.col("attempts") > 1, F.lit("claimed_again"))))
    return out.withColumn("state", F.when(F.col("state") == "started", "unknown").otherwise(F.col("state"))).withColumn("faults", faults).drop("_claim", "_end")


def attempted_prefix(plan: DataFrame, states: DataFrame, key: str, position: str) -> DataFrame:
    """Every planned slot with its state (not_run if it has none) and the fault of a claim after a slot that was never claimed; and slots that
    no plan knows (unplanned). plan: key, position. Claims must form a prefix of the plan."""
    both = plan.select(key, position).join(states.select(key, "state", "attempts").hint("merge"), key, "full")
    gap = both.where(F.col(position).isNotNull() & (F.coalesce("attempts", F.lit(0)) == 0)).agg(F.min(position).alias("_gap"))
    fault = F.when(F.col(position).isNull(), "unplanned").when((F.col("attempts") > 0) & (F.col(position) > F.col("_gap")), "claim_after_gap")
    out = both.crossJoin(F.broadcast(gap)).withColumn("fault", fault).drop("_gap")
    return out.withColumn("state", F.coalesce("state", F.lit("not_run"))).withColumn("attempts", F.coalesce("attempts", F.lit(0).cast("long")))


def shared_prefix(left: DataFrame, right: DataFrame, parent: str, hop: str, digest: str) -> DataFrame:
    """Per parent: hops compared, and leading hops that are identical in both streams."""
    both = left.select(parent, hop, F.col(digest).alias("_x")).join(right.select(parent, hop, F.col(digest).alias("_y")), [parent, hop], "full")
    out = both.groupBy(parent).agg(F.count("*").alias("hops"), F.min(F.when(~F.col("_x").eqNullSafe(F.col("_y")), F.col(hop))).alias("_first"), F.min(hop).alias("_low"))
    return out.withColumn("prefix", F.when(F.col("_first").isNull(), F.col("hops")).otherwise(F.col("_first") - F.col("_low"))).drop("_first", "_low")


def token_step(state: tuple[int | None, list[list[int]]], at: int, token: int, gaps: list[int], sequence: tuple[int, ...]) -> tuple[tuple[int | None, list[list[int]]], list[tuple]]:
    """The next state (last token; for each gap the clocks of the sequence begun) and the sequences (gap, clocks) that this frame completes."""
    last, begun = state
    if token == last:
        return state, []
    done, now = [], []
    for gap, seen in zip(gaps, begun):
        seen = [] if seen and at - seen[-1] > gap else list(seen)
        if token == sequence[len(seen)]:
            seen.append(at)
        elif token == sequence[0]:
            seen = [at]
        if len(seen) == len(sequence):
            done.append((gap, *seen))
            seen = []
        now.append(seen)
    return (token, now), done


def token_sequences(frames: DataFrame, case: str, clock: str, token: str, gaps: list[int], sequence: tuple[int, int, int] = (1, 2, 3)) -> DataFrame:
    """Three tokens in order, each a change of the best token, each at most `gap` samples after the one before; one row for
    each gap policy and completed sequence with its anchor clocks. All gaps are scored in one pass over the sorted frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for c, at, t in zip(b["c"].tolist(), b["at"].tolist(), b["t"].tolist()):
                if c != now:
                    now, state = c, (None, [[] for _ in gaps])
                state, done = token_step(state, at, t, gaps, sequence)
                out += [(c, *x) for x in done]
            yield pd.DataFrame(out, columns=["c", "gap", "first", "second", "third"])

    rows = frames.select(F.col(case).cast("string").alias("c"), F.col(clock).cast("long").alias("at"), F.col(token).cast("int").alias("t"))
    out = rows.repartition("c").sortWithinPartitions("c", "at").mapInPandas(run, "c string, gap long, first long, second long, third long")
    return out.withColumnRenamed("c", case)


def reconcile(plan: DataFrame, outcomes: dict[str, DataFrame], key: str, order: str) -> DataFrame:
    """Every planned cell with its one outcome (`open` if none, `clash` if several), and whether it lies in the consumed prefix."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [df.select(key, F.lit(name).alias("outcome")) for name, df in outcomes.items()])
    per = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min("outcome").alias("_o"))
    out = plan.join(per, key, "left").withColumn("outcome", F.when(F.col("_n") > 1, "clash").otherwise(F.coalesce("_o", F.lit("open"))))
    first_open = out.agg(F.min(F.when(F.col("outcome") == "open", F.col(order))).alias("_open"))
    out = out.crossJoin(F.broadcast(first_open))
    return out.withColumn("in_prefix", F.col("_open").isNull() | (F.col(order) < F.col("_open"))).drop("_n", "_o", "_open")
