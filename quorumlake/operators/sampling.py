"""Hash-based sampling, exposure plans and weights. Choices are made by hash, never by chance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import running
from .sizes import sized


def class_schedule(quotas: dict[str, int], start: int, stop: int, used: dict[str, int], batch: int = 10_000) -> Iterator[pd.DataFrame]:
    """Classes at positions start to stop - 1: the one with the largest quota * (position + 1) - used * total, ties in dict order. `used` is updated."""
    total = sum(quotas.values())
    rows = []
    for place in range(start, stop):
        pick = max((c for c in quotas if used[c] < quotas[c]), key=lambda c: quotas[c] * (place + 1) - used[c] * total)
        rows.append((place, pick, used[pick]))
        used[pick] += 1
        if len(rows) == batch or place == stop - 1:
            yield pd.DataFrame(rows, columns=["position", "class", "draw"])
            rows = []


def fair_share(quotas: dict[str, int], place: int) -> dict[str, int]:
    """A guess at what each class has used before a position: its share rounded down, and one more for the largest remainders."""
    total = sum(quotas.values())
    used = {c: q * place // total for c, q in quotas.items()}
    for c in sorted(quotas, key=lambda c: -(quotas[c] * place % total))[: place - sum(used.values())]:
        used[c] += 1
    return used


#: Least positions of a slice, most slices, and the positions before a slice from which its start is guessed.
SLICE, SLICES, BEFORE = 50_000, 1_000, 1_000


def _cuts(total: int, slice_rows: int) -> list[int]:
    return [*range(0, total, max(slice_rows, -(-total // SLICES), 1)), total]


def slice_starts(spark: SparkSession, quotas: dict[str, int], slice_rows: int = SLICE) -> list[dict[str, int]]:
    """What each class has used where each slice of the schedule starts; exact.

    Every slice runs from a guess made a little earlier. A start that is not the end of the slice before is put right and its slice runs again,
    until all meet; the slices up to the first wrong one are right, so each round puts at least one more right. The driver holds a few counters a slice.
    """
    classes, total = list(quotas), sum(quotas.values())
    cuts = _cuts(total, slice_rows)
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    todo: dict[int, list[int] | None] = {i: [0] * len(classes) if i == 0 else None for i in range(len(cuts) - 1)}
    while todo:
        given = dict(todo)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for i in (int(i) for b in batches for i in b["id"]):
                if i not in given:
                    continue
                used, at = given[i], cuts[i]
                if used is None:
                    at = max(0, cuts[i] - BEFORE)
                    guess = fair_share(quotas, at)
                    for _ in class_schedule(quotas, at, cuts[i], guess):
                        pass
                    used = [guess[c] for c in classes]
                state = dict(zip(classes, used))
                for _ in class_schedule(quotas, cuts[i], cuts[i + 1], state):
                    pass
                yield pd.DataFrame({"i": [i], "start": [used], "end": [[state[c] for c in classes]]})

        for r in spark.range(0, len(cuts) - 1, 1, len(cuts) - 1).mapInPandas(run, "i long, start array<long>, end array<long>").collect():
            starts[r.i], ends[r.i] = list(r.start), list(r.end)
        todo = {i: ends[i - 1] for i in starts if i and starts[i] != ends[i - 1]}
    return [dict(zip(classes, starts[i])) for i in range(len(cuts) - 1)]


def schedule(spark: SparkSession, quotas: dict[str, int], slice_rows: int = SLICE) -> DataFrame:
    """Position, class and draw of a class (from 0); slices are made in parallel. A quota of 0 gets no place."""
    cuts = _cuts(sum(quotas.values()), slice_rows)
    if len(cuts) < 2:
        return spark.createDataFrame([], "position long, class string, draw long")
    starts = [dict.fromkeys(quotas, 0)] if len(cuts) == 2 else slice_starts(spark, quotas, slice_rows)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for i in (int(i) for b in batches for i in b["id"]):
            yield from class_schedule(quotas, cuts[i], cuts[i + 1], dict(starts[i]))

    return spark.range(0, len(cuts) - 1, 1, len(cuts) - 1).mapInPandas(rows, "position long, class string, draw long")


def exposure_plan(rows: DataFrame, quotas: dict[str, int], label: str, family: str, item: str) -> DataFrame:
    """An ordered plan of draws. The k-th draw of a class takes family k mod F (in order), then its row floor(k / F) mod R.

    The class order comes in slices made in parallel (schedule); the rows come by equi joins.
    """
    plan = schedule(rows.sparkSession, quotas)
    per = rows.groupBy(F.col(label).alias("class"), F.col(family).alias("_f")).agg(F.count("*").alias("_rows"))
    fam = per.withColumn("_fi", F.row_number().over(W.partitionBy("class").orderBy("_f")).cast("long") - 1)
    sizes = per.groupBy("class").agg(F.count("*").alias("_fams"))
    placed = running(rows.select(F.col(label).alias("class"), F.col(family).alias("_f"), item), ["class", "_f"], [item], _ri=F.lit(1))
    out = plan.join(sized(sizes), "class").withColumn("_fi", F.pmod("draw", F.col("_fams")))
    out = out.join(fam.hint("merge"), ["class", "_fi"]).withColumn("_ri", F.pmod(F.expr("draw div _fams"), F.col("_rows")))
    return out.join(placed.hint("merge"), ["class", "_f", "_ri"]).select("position", "class", "draw", F.col("_f").alias(family), item)


def step_draws(rows: DataFrame, group: list[str], item: str, steps: int) -> DataFrame:
    """For each step and group, the row at step mod size, in item order."""
    placed = running(rows.select(*group, item), group, [item], _i=F.lit(1))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")))).withColumn("_i", F.pmod("step", F.col("_n")))
    return draws.join(placed.hint("merge"), [*group, "_i"]).select("step", *group, item)


def bag_weights(rows: DataFrame, label: str, group: str, tier: str, classes: int = 3) -> DataFrame:
    """Tier / (classes * groups of the class * rows of the group), scaled to a sum of 1. Counts are joined, not windowed."""
    per_group = rows.groupBy(label, group).agg(F.count("*").alias("_rows"))
    per_class = per_group.groupBy(label).agg(F.count("*").alias("_groups"))
    out = rows.join(per_group, [label, group]).join(sized(per_class), label)
    raw = F.col(tier) / (classes * F.col("_groups") * F.col("_rows"))
    total = per_group.join(sized(per_class), label).join(rows.groupBy(label, group).agg(F.sum(tier).alias("_tier")), [label, group]).agg(F.sum(F.col("_tier") / (classes * F.col("_groups") * F.col("_rows"))).alias("_total"))
    return out.crossJoin(F.broadcast(total)).withColumn("weight", raw / F.col("_total")).drop("_rows", "_groups", "_total")


def selective_route(df: DataFrame, doubts: list[tuple[Column, str]], digest: Column) -> DataFrame:
    """Rows with a doubt go to the third model with the first reason; of the rest, those whose digest is in the lowest fifth."""
    out = F
    for cond, code in doubts:
        out = out.when(cond, F.lit(code))
    route = out.when(digest <= F.lit("3" * 64), F.lit("sample"))
    return df.withColumn("route", route)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 24 hex digits of a SHA-256 over the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def stable_seed(*parts: Column) -> Column:
    """32-bit seed from the same digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def blind_tables(df: DataFrame, salt: str, key: str, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table that reviewers see (pseudonym, shown columns) and the owner's (pseudonym, all columns)."""
    named = df.withColumn("pseudonym", F.substring(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), 1, 16))
    return named.select("pseudonym", *shown), named


def refinement(rows: DataFrame, rejected: Column, voice: str, requests: DataFrame) -> DataFrame:
    """One more round for every voice with a rejected row: each voice with all of the small request table."""
    return rows.where(rejected).select(voice).distinct().crossJoin(sized(requests))


def groups_by_class(rows: DataFrame, label: str, group: str, item: str) -> DataFrame:
    """Rows of each class and group: how many, and the least and greatest item."""
    return rows.groupBy(label, group).agg(F.count("*").alias("rows"), F.min(item).alias("first"), F.max(item).alias("last"))
