"""Draws without replacement from a pool of tracks, by hash and among the tracks that are long enough.

The k-th eligible track in id order is an order statistic over two orders: tracks are ranked by id and by length, and a search over the bits of the id rank counts, in
one sweep for each four bits, the eligible tracks with a smaller rank. Rows and tracks are never joined with each other, so the pool may be of any size.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .scan import running


def hash_part(text: Column, part: int) -> Column:
    """The part-th 16 hex digits of a SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 16 * part + 1, 16), 16, 10).cast("decimal(20,0)")


def modulo(number: Column, n: Column) -> Column:
    return F.pmod(number, n.cast("decimal(20,0)")).cast("long")


def ranked_tracks(pool: DataFrame, role: str, item: str, frames: str) -> DataFrame:
    """Tracks (role, item, frames) with their place by id (_rank) and by falling length (_place) in the role, both from 0."""
    rows = running(pool.select(role, item, F.col(frames).cast("long").alias(frames)), [role], [item], _rank=F.lit(1))
    return cut_lineage(running(rows, [role], [F.desc(frames), F.col(item)], _place=F.lit(1)))


def eligible(rows: DataFrame, tracks: DataFrame, role: str, length: str, frames: str) -> DataFrame:
    """rows (_row, role, length) with _n, how many tracks of the role are at least so long: these have a _place below _n."""
    t = tracks.select(role, (-F.col(frames)).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_row"))
    r = rows.select(role, (-F.col(length).cast("long")).alias("_at"), F.lit(1).alias("_kind"), "_row")
    return running(t.unionByName(r), [role], ["_at", "_kind"], _n=1 - F.col("_kind")).where("_kind = 1").select("_row", role, "_n")


#: Bits of the id rank that a sweep decides. A sweep keeps a running count for each value of them but the last.
BITS = 4


def search(rows: DataFrame, tracks: DataFrame, role: str, target: str | None = None) -> DataFrame:
    """For rows (_row, role, _n, _k): _found, the id rank of the eligible track number _k. With a target, a column of id ranks: _found counts the eligible tracks of
    smaller rank than it instead."""
    bits, most = (tracks.agg(F.max("_rank")).first()[0] or 0).bit_length(), (1 << BITS) - 1
    keep = ["_row", role, "_n", *([target] if target else ["_k"])]
    now = rows.select(*keep, F.lit(0).cast("long").alias("_low"), F.lit(0).cast("long").alias("_count"))
    names = [c for c in now.columns if c not in (role, "_n")]
    digit = lambda rank, b: F.shiftright(rank, b).bitwiseAND(F.lit(most)).cast("int")
    for b in reversed(range(0, bits, BITS)):
        t = tracks.select(role, F.shiftright("_rank", b + BITS).alias("_node"), F.col("_place").alias("_at"), F.lit(1).alias("_kind"), digit("_rank", b).alias("_digit"), *[F.lit(None).cast("long").alias(c) for c in names])
        r = now.select(role, F.shiftright("_low", b + BITS).alias("_node"), F.col("_n").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("_digit"), *names)
        upto = {f"_upto{v}": (F.col("_digit") <= v).cast("int") for v in range(most)}
        told = running(t.unionByName(r), [role, "_node"], ["_at", "_kind"], **upto).where("_kind = 0").withColumnRenamed("_at", "_n")
        step = digit(target, b) if target else reduce(add, [(F.col("_k") >= F.col(c)).cast("int") for c in upto])
        told = told.withColumn("_step", step)
        told = told.withColumn("_left", F.coalesce(F.get(F.array(*upto), F.col("_step") - 1), F.lit(0).cast("long")))
        moved = {"_low": F.col("_low") + F.shiftleft(F.col("_step").cast("long"), b), "_count": F.col("_count") + F.col("_left")}
        now = told.withColumns(moved if target else moved | {"_k": F.col("_k") - F.col("_left")}).select(*keep, "_low", "_count")
    return now.select("_row", role, F.col("_count" if target else "_low").alias("_found"))


def draw_tracks(rows: DataFrame, pool: DataFrame, key: str, role: str, length: str, item: str, frames: str, salt: str) -> DataFrame:
    """Each row with one track of its role that is at least as long, and an offset at which it fits: the first 16 hex digits of SHA-256(salt/key) choose
    among the eligible tracks in id order, the next 16 among the offsets. Rows without an eligible track keep the reason."""
    return draw_conditions(rows, pool, [None], key, role, length, item, frames, salt).drop("condition")


def draw_conditions(rows: DataFrame, pool: DataFrame, conditions: list, key: str, role: str, length: str, item: str, frames: str, salt: str, used: str | None = None) -> DataFrame:
    """Every row under every condition with a track and an offset as draw_tracks chooses them, from SHA-256(salt/condition/key); the track in the
    column `used` is left out, and so are those that earlier conditions of the row drew. Reason: no_track_left."""
    tracks = ranked_tracks(pool, role, item, frames)
    numbered = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    placed = eligible(numbered, tracks, role, length, frames)
    out = numbered.join(placed.select("_row", "_n").hint("merge"), "_row", "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
    taken = F.expr("cast(array() as array<bigint>)")
    if used:
        old = numbered.select("_row", role, F.col(used).alias(item), length).join(tracks.hint("merge"), [role, item]).where(F.col(frames) >= F.col(length)).select("_row", F.col("_rank").alias("_old"))
        with_old = placed.join(old.hint("merge"), "_row")
        out = out.join(search(with_old, tracks, role, "_old").select("_row", F.col("_found").alias("_used")).hint("merge"), "_row", "left")
        taken = F.array_compact(F.array("_used"))
    text = lambda c: F.concat_ws("/", F.lit(salt), *([F.lit(c)] if c is not None else []), F.col(key).cast("string"))
    for i, c in enumerate(conditions):
        gone = F.array_sort(F.array_compact(F.concat(taken, *([F.array(*[F.col(f"_pick{j}") for j in range(i)])] if i else []))))
        left = F.col("_n") - F.size(gone)
        pick = F.when(left > 0, F.aggregate(gone, modulo(hash_part(text(c), 0), F.when(left > 0, left)), lambda k, g: k + (g <= k).cast("long")))
        out = out.withColumn(f"_pick{i}", pick)
    each = F.explode(F.array(*[F.struct(F.lit(c).cast("string").alias("condition"), F.col(f"_pick{i}").alias("_k"), hash_part(text(c), 1).alias("_h")) for i, c in enumerate(conditions)]))
    long = cut_lineage(out.select(*rows.columns, "_n", each.alias("_c")).select(*rows.columns, "_n", "_c.*").withColumn("_row", F.monotonically_increasing_id()))
    found = search(long.where("_k is not null"), tracks, role).join(tracks.select(role, F.col("_rank").alias("_found"), item, frames).hint("merge"), [role, "_found"]).select("_row", item, F.col(frames).alias("_frames"))
    both = long.join(found.hint("merge"), "_row", "left")
    offset = modulo(F.col("_h"), F.col("_frames") - F.col(length) + 1)
    return both.withColumn("offset", offset).withColumn("reason", F.when(F.col(item).isNull(), "no_track_left")).select(*rows.columns, "condition", item, "offset", "reason")
