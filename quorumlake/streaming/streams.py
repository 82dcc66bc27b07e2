"""Event gates, token sequences, claims, matches and mined windows on Structured Streaming.

Rows of a case are taken in event-time order whatever order they come in: a list state holds them until the watermark has passed, and a timer there
wakes the case. The step functions are those of the batch forms in gate.py. They need the RocksDB state store
(spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .gate import CONSUMED, ENDED, MATCH_HIGH, MATCH_LOW, START, GatePolicy, best_of, event_summary, gate_step, token_step


class Ordered(StatefulProcessor):
    """Rows of a key in the order of (ms, clock), once the watermark has passed them, through step(state, *values) -> (state, results).

    held: rows that may still be preceded by others; state: the step's state as JSON and the time of the key's last row. A key without rows for idle_ms
    of event time after its last one is forgotten.
    """

    def __init__(self, step: Callable, start, values: list[str], kinds: list[str], columns: list[str], idle_ms: int):
        self.step, self.start, self.values, self.kinds, self.columns, self.idle_ms = step, start, values, kinds, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ms long, " + ", ".join(f"{v} {k}" for v, k in zip(self.values, self.kinds)))
        self.state = handle.getValueState("state", "json string, last long")

    def flush(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        due = sorted(r for r in rows if r[0] <= watermark)
        if due:
            known = self.state.get() if self.state.exists() else None
            state, out = (json.loads(known[0]) if known else self.start), []
            for r in due:
                state, done = self.step(state, *r[1:])
                out += [(*key, *d) for d in done]
            self.state.update((json.dumps(state), due[-1][0]))
            if later := [r for r in rows if r[0] > watermark]:
                self.held.put(later)
            else:
                self.held.clear()
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(x) for b in rows for x in b[["ms", *self.values]].itertuples(index=False)]
        new = [tuple(v.item() if hasattr(v, "item") else v for v in x) for x in new]
        self.held.appendList(new)
        last = max(x[0] for x in new)
        self.handle.registerTimer(last)
        self.handle.registerTimer(last + self.idle_ms)
        yield from self.flush(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self.flush(key, watermark)
        if not self.held.exists() and self.state.exists() and self.state.get()[1] + self.idle_ms <= watermark:
            self.state.clear()

    def close(self) -> None:
        pass


def ordered(rows: DataFrame, key: str, time: str, values: list[str], step: Callable, start, result: str, delay: str | None, idle_ms: int) -> DataFrame:
    """Rows of a stream through Ordered: `values` (the first one the clock) are what the step takes, `result` the columns after the key that it gives; without a delay the rows have their watermark."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    marked = (rows.withWatermark(time, delay) if delay else rows).withColumn("ms", F.unix_millis(time))
    shape = f"{key} {kinds[key]}, {result}"
    processor = Ordered(step, start, values, [kinds[v] for v in values], [c.split()[0] for c in shape.split(", ")], idle_ms)
    return marked.groupBy(key).transformWithStateInPandas(processor, shape, "append", "EventTime")


def _gate(policy: GatePolicy, state, sample: int, best: int, top: float):
    state, hit = gate_step(tuple(state), sample, best, top, policy)
    return state, [] if hit is None else [(sample, hit)]


def gate_stream(scores: DataFrame, time: str = "at", delay: str = "10 seconds", policy: GatePolicy = GatePolicy(), idle_ms: int = 60_000) -> DataFrame:
    """R1 on a stream of (case_id, sample, probabilities, time): events (case_id, sample, event_class), each once the watermark has passed it. In a case the
    clock grows with the time. Rows that are later than the delay are dropped by Spark, and counted in its metrics."""
    rows = best_of(scores, [F.col("case_id").cast("string").alias("case_id"), F.col(time), F.col("sample").cast("long").alias("sample")])
    return ordered(rows, "case_id", time, ["sample", "best", "top"], partial(_gate, policy), list(START), "sample long, event_class int", delay, idle_ms)


def _tokens(gaps: list[int], sequence: tuple[int, ...], state, at: int, token: int):
    return token_step((state[0], state[1]), at, token, gaps, sequence)


def sequence_stream(frames: DataFrame, clock: str, token: str, gaps: list[int], sequence: tuple[int, int, int] = (1, 2, 3), time: str = "at", delay: str = "10 seconds", idle_ms: int = 60_000) -> DataFrame:
    """R9 on a stream of (case_id, clock, token, time): the sequences of token_sequences, each once the watermark has passed its last anchor."""
    rows = frames.select(F.col("case_id").cast("string").alias("case_id"), F.col(time), F.col(clock).cast("long").alias("clock"), F.col(token).cast("int").alias("token"))
    start = [None, [[] for _ in gaps]]
    return ordered(rows, "case_id", time, ["clock", "token"], partial(_tokens, gaps, sequence), start, "gap long, first long, second long, third long", delay, idle_ms)


def _claim(state, order: int, new: str):
    last, attempts, consumed = state
    if order == last:
        return state, []
    faults = ["outcome_without_claim"] if new in ENDED and not attempts else ["claimed_again"] if new == "started" and attempts else []
    attempts, consumed = attempts + (new == "started"), consumed or new in CONSUMED
    return [order, attempts, consumed], [(order, "unknown" if new == "started" else new, attempts, consumed, f) for f in faults or [None]]


def claim_stream(log: DataFrame, time: str = "at", delay: str = "10 seconds", idle_ms: int = 86_400_000) -> DataFrame:
    """R7 on a stream of (slot, record, state, time), record being the place in the slot's log: the slot's state after each record, with its fault if it has one.
    A record that comes twice within the delay counts once. The last row of a slot is that of claim_state."""
    rows = log.select(F.col("slot"), F.col(time), F.col("record").cast("long").alias("record"), F.col("state")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["slot", "record"])
    return ordered(rows, "slot", time, ["record", "state"], _claim, [-1, 0, False], "record long, state string, attempts long, consumed boolean, fault string", None, idle_ms)


def match_stream(events: DataFrame, clips: DataFrame, rate: int = 16_000, low: int = MATCH_LOW, high: int = MATCH_HIGH, delay: str = "10 seconds") -> DataFrame:
    """R3 on two streams: events (case_id, sample, event_class, at) and clips (case_id, weak_class, clip_start, clip_eof, ended_at). One row a clip, as
    windowed_match gives it, once both watermarks have passed all that may still match.

    Time bounds in the join condition let Spark drop old rows of either side: an event may come up to one clip before the clip's end and `high` samples
    and a second after it, and a clip is at most 60 seconds long. Clips without an event come through the outer side.
    """
    e = events.withWatermark("at", delay).select(F.col("case_id").alias("_case"), "sample", "event_class", "at")
    c = clips.withWatermark("ended_at", delay)
    after = f"INTERVAL {high / rate + 1} SECONDS"
    near = F.expr(f"case_id = _case AND at >= ended_at - INTERVAL 60 SECONDS AND at <= ended_at + {after}")
    keys = ["case_id", "weak_class", "clip_start", "clip_eof", "ended_at"]
    return event_summary(c.join(e, near, "left"), keys, "sample", "event_class", low, high)


def mined_windows(hops: DataFrame, prob: Column, least: float, case: str = "case_id", sample: str = "sample", time: str = "at", before: int = 3200, after: int = 3200, rate: int = 16_000, delay: str = "10 seconds") -> DataFrame:
    """R6 on a stream: windows around hops with a probability of `least` or more, merged where they strictly overlap, with their seeds and peak, each closed by the
    watermark. A seed outranks every other hop of its window, so seeds give the peak. Windows are not yet clipped to the end of their recording."""
    gap = f"{(before + after) * 1_000_000 // rate - 1} microseconds"  # two windows overlap if their seeds are closer than both contexts
    seeds = hops.where(prob >= least).withWatermark(time, delay).select(F.col(case), F.col(time), F.col(sample), prob.alias("_p"))
    per = seeds.groupBy(case, F.session_window(time, gap).alias("_s")).agg(F.min(sample).alias("_first"), F.max(sample).alias("_last"), F.count("*").alias("seeds"), F.max("_p").alias("peak"))
    return per.select(case, F.greatest(F.col("_first") - before, F.lit(0)).alias("start"), (F.col("_last") + after).alias("end"), "seeds", "peak")
