"""Operator 4, mixing sources to target weights: Pfair windows, earliest deadline first."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ranked, table

#: Slots that a task schedules at least, slices that a schedule is cut into (but for the ends of phases), and slots that a task schedules at most.
SLICE, SLICES, MOST = 1 << 16, 2048, 1 << 22
#: What the query and the pipeline aim at: the square root of the size of each source.
TARGET = "sqrt"


def exact_shares(weights: list) -> list[int]:
    """Whole shares in the exact proportion of the weights, which are taken as the decimals they are written as. Weights must be positive."""
    exact = [Fraction(str(w)) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("weights must be positive")
    scale = math.lcm(*[w.denominator for w in exact])
    whole = [int(w * scale) for w in exact]
    return [w // math.gcd(*whole) for w in whole]


def tightest(shares: np.ndarray, total: int, due_by: np.ndarray, last: int, slot: int, firsts: np.ndarray) -> np.ndarray:
    """For each interval of slots after `last` that ends with one of firsts: the least number of slots that are left, from a slot of it on up to
    `slot`, beside the blocks that are released and due there."""
    low = -(-shares * (last + 1) // total)  # the first block released after last
    many = np.maximum(due_by - low, 0).astype(np.int64)
    of = np.repeat(np.arange(len(shares)), many)
    block = low[of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    release = (block * total // shares[of]).astype(np.int64)
    starts = np.bincount(release - last - 1, minlength=slot - last - 1)
    left = np.arange(slot - last - 1, 0, -1) - np.cumsum(starts[::-1])[::-1]
    return np.minimum.reduceat(left[: firsts[-1] - last], np.concatenate([[0], firsts[:-1] - last]))


def given_by(shares: np.ndarray, total: int, slot: int, last: int, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What each source has given at a slot, as (blocks that are due by then, whether also the next one, early).

    A source with share k of n has k * slot / n blocks due, rounded down, and one more released unless that is whole. The slots that are left go to the
    released ones with the earliest deadlines, as they would if each slot went to the earliest deadline; but not to more of those released from a slot
    `a` on than the slots from a on leave beside the blocks that are due. An early block of the slot before (`last`) stays given. So all windows between
    the two slots can be kept, whatever comes before and after.
    """
    due_by = shares * slot // total
    open_ = shares * slot % total > 0
    kept = before[1] & (before[0] == due_by) & open_
    need = slot - int(due_by.sum()) - int(kept.sum())
    able = np.flatnonzero(open_ & ~kept)
    due, release = -(-(due_by[able] + 1) * total // shares[able]), due_by[able] * total // shares[able]
    firsts = np.unique(release[release > last])
    slack = tightest(shares, total, due_by, last, slot, firsts.astype(np.int64)) if len(firsts) else np.zeros(0, np.int64)
    chosen: list[int] = []
    for x in sorted(range(len(able)), key=lambda x: (due[x], able[x])):
        if len(chosen) == need:
            break
        upto = int(np.searchsorted(firsts, release[x], side="right"))
        if upto and slack[:upto].min() < 1:
            continue
        slack[:upto] -= 1
        chosen.append(x)
    if len(chosen) < need:
        raise AssertionError("no schedule keeps all windows")
    early = kept.copy()
    early[able[chosen]] = True
    return due_by, early


def slices(blocks: list[int], weights: list, size: int | None = None) -> Iterator[dict]:
    """The schedule as slices that tasks can work on alone: phase, the slot of the phase's start, first and end slot in the phase, total share, and for
    each source with blocks in the slice its place in the input, share, first and end block in the phase, and blocks given in earlier phases.

    A phase ends at the slot at which a source has no block left; the rest go on in proportion.
    """
    whole = np.array(exact_shares(weights) if weights else [], dtype=object)
    size = size or min(max(SLICE, -(-sum(blocks) // SLICES)), MOST)
    left, used, at, phase = np.array(blocks, dtype=object), np.zeros(len(blocks), dtype=object), 0, 0
    while len(active := np.flatnonzero(left > 0)):
        shares = whole[active] // math.gcd(*whole[active])
        total = int(shares.sum())
        if total * (int(left.sum()) + total) < 1 << 62:
            shares = shares.astype(np.int64)
        end = int((left[active] * total // shares).min())  # up to here no source is asked for more than it has
        given, last = (np.zeros(len(active), dtype=shares.dtype), np.zeros(len(active), bool)), 0
        cuts = [*range(size, end, size), end]
        for cut in cuts:
            now, more = given_by(shares, total, cut, last, given), 0
            before, after = given[0] + given[1], now[0] + now[1]
            if cut == end and not (after == left[active]).any():
                # the next slot goes to the one last block that is due at its end
                ends = -(-(after + 1) * total // shares)
                mine = np.flatnonzero((after + 1 == left[active]) & (ends == end + 1))
                after[mine[0]] += 1
                more = 1
            own = np.flatnonzero(after > before)
            yield {"phase": phase, "at": at, "start": last, "end": cut + more, "total": str(total), "source": active[own].tolist(), "share": [str(x) for x in shares[own]], "first": [int(x) for x in before[own]], "last": [int(x) for x in after[own]], "used": [int(x) for x in used[active[own]]]}
            given, last = now, cut
        used[active] += after
        left[active] -= after
        at, phase = at + end + more, phase + 1


def scheduled(part: dict) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(source, block, phase, release, deadline, slot) of the blocks of a slice: each slot goes to the released block with the earliest deadline (ties: the earlier source).

    Block j (from 0) of a source with share k of n is released at floor(j*n/k) and due by ceil((j+1)*n/k), so at every slot a source has given less than one
    block more or less than its due. A missed deadline raises.
    """
    total, at, start, end = int(part["total"]), part["at"], part["start"], part["end"]
    share = [int(x) for x in part["share"]]
    release = lambda i, j: j * total // share[i]
    due = lambda i, j: -(-(j + 1) * total // share[i])
    waiting = [(max(start, release(i, j)), i, j) for i, j in enumerate(part["first"])]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(start, end):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (min(end, due(i, j)), i, j))
        latest, i, j = heapq.heappop(ready)
        if slot >= latest:
            raise AssertionError("a deadline was missed")
        yield part["source"][i], part["used"][i] + j, part["phase"], at + release(i, j), at + due(i, j), at + slot
        if j + 1 < part["last"][i]:
            heapq.heappush(waiting, (max(start, release(i, j + 1)), i, j + 1))


def schedule(spark: SparkSession, blocks: list[int], weights: list) -> DataFrame:
    """(source, block, phase, release, deadline, slot) of all blocks; a task makes a slice. source is a place in the input."""
    shape = "phase int, at long, start long, end long, total string, source array<int>, share array<string>, first array<long>, last array<long>, used array<long>"
    parts = [tuple(p.values()) for p in slices(blocks, weights)]
    columns = [c.split()[0] for c in shape.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame(scheduled(dict(zip(columns, r))), columns=["source", "block", "phase", "release", "deadline", "slot"])

    rows = spark.createDataFrame(parts, shape)
    return rows.repartition(max(1, min(len(parts), SLICES)), "phase", "start").mapInPandas(run, "source int, block long, phase int, release long, deadline long, slot long")


def source_key(name: str | None) -> str:
    return "null" if name is None else f"={name}"


def mix(docs: DataFrame, weights: dict[str, float] | str | None = None, block_rows: int = 16, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The interleaving order of docs: doc_id, source, block, in_block, phase, release, deadline, slot, position.

    Rows of a source are put in hash order and cut into blocks of block_rows; blocks go out by the Pfair schedule
    of the target weights (default: equal; "size": the shares of the sources in all blocks, so that all last to the
    end; "sqrt": the square roots of these, in thousandths). While no source is exhausted, the blocks given by each source up to any slot differ from
    weight x slots by less than one, for any weights, any number of slots and any number of sources. When a source has no block left, the rest go on by
    their weights in a new phase; every row has a place. `slot` numbers the blocks and `position` the rows of the whole order, both gapless.
    Nulls: a null source is a source of its own, apart from ""; its weight goes under None. Rows with null ids or texts
    have a place. Repeated rows each have a place; rows with the same id, source and text are interchangeable. No rows: no
    result rows. A source without a weight has the least weight given; zero and negative weights raise.
    The driver sees the row counts of the sources and, for each cut between slices, what each source has given by then; tasks make the slices. It takes
    time and memory in proportion to the sources and, but for "size", to their square, as each source's end begins a phase.
    A hot source is ranked in parts. Other columns of docs are not read.
    """
    if isinstance(weights, dict):
        exact_shares(list(weights.values()) or [1])  # refuses weights that are not positive
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("_s"), F.col(source).alias("source"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_t"))
    rows = materialise(rows)
    counts = rows.groupBy("_s").count().orderBy("_s").collect()
    names, numbers = [r["_s"] for r in counts], [r["count"] for r in counts]
    blocks = [-(-n // block_rows) for n in numbers]
    if weights == "size":
        given = dict(zip(names, blocks))
    elif weights == "sqrt":
        given = {s: math.isqrt(10**6 * b) for s, b in zip(names, blocks)}
    else:
        given = {source_key(s): w for s, w in (weights or {}).items()}
    least = min(given.values(), default=1)
    known = spark.createDataFrame([(i, s, -(-n // block_rows) - 1, -n % block_rows) for i, (s, n) in enumerate(zip(names, numbers))], "source int, _s string, end long, lack int")
    at = schedule(spark, blocks, [given.get(s, least) for s in names]).join(F.broadcast(known) if len(names) <= 200_000 else known.hint("merge"), "source").drop("source")
    at = materialise(at)
    short = sorted((r["slot"], r["lack"]) for r in at.where("block = end and lack > 0").select("slot", "lack").collect())  # a row a source at most
    ends, lacks = np.array([s for s, _ in short], np.int64), np.cumsum([0, *[n for _, n in short]])

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of a block's first row: block_rows for each slot before, less what the short last blocks among them lack."""
        for b in batches:
            slot = b.column("slot").to_numpy()
            first = slot * block_rows - lacks[np.searchsorted(ends, slot)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first)], [*b.schema.names, "_first"])

    columns = ["_s", "block", "phase", "release", "deadline", "slot"]
    at = at.select(*columns).mapInArrow(first_rows, "_s string, block long, phase int, release long, deadline long, slot long, _first long")
    order = ranked(rows, ["_s"], [F.col("doc_id"), F.col("_t")], "_rank", group=["_s"])
    placed = order.withColumn("block", F.expr(f"_rank div {block_rows}")).withColumn("in_block", F.expr(f"_rank % {block_rows}").cast("int"))
    placed = placed.join(at.hint("merge"), ["_s", "block"]).withColumn("position", F.col("_first") + F.col("in_block"))
    return placed.select("doc_id", "source", "block", "in_block", "phase", "release", "deadline", "slot", "position", F.col("_t").alias("text_crc32"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), TARGET)
