"""Segmented scans: what earlier rows of a key come to, where one key may hold any share of all rows.

Rows are dealt by ranges of (key, order). A range works on its own rows first; what it passes on to the later ranges of its last key is
one row a range, whatever the carry is: a sum, the furthest end, or the last open piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .sizes import sized


def meet(df: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df with the other columns of side, joined on keys where null equals null; side is broadcast if a count finds it small."""
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return df.alias("d").join(sized(side).alias("s"), same, how).select("d.*", *[F.col(f"s.{c}") for c in side.columns if c not in keys])


def ranges(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df dealt by ranges of (key, order), with the number of its range as _range."""
    return df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id())


def in_range(key: list[str], order: list[str]) -> W:
    """The window of a key's rows in one range."""
    return W.partitionBy(*key, "_range").orderBy(*order)


def earlier(key: list[str]) -> W:
    """For rows of a key and a range: those of the earlier ranges."""
    return W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)


def passed_on(per_range: DataFrame, key: list[str], **carry: Column) -> DataFrame:
    """The carry that each range after a key's first one starts with: at most one row a range, as only its first key began before it."""
    first = F.min("_range").over(W.partitionBy(*key))
    return per_range.select(*key, "_range", *[c.alias(n) for n, c in carry.items()], (F.col("_range") > first).alias("_later")).where("_later").drop("_later")


def carried(df: DataFrame, side: DataFrame, key: list[str]) -> DataFrame:
    """df with the carry of its key and range; null in a key's first range. The side has a row a range at most, so it is broadcast."""
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*key, "_range"]]
    return df.alias("d").join(F.broadcast(side.alias("s")), same, "left").select("d.*", *[F.col(f"s.{c}") for c in side.columns if c not in [*key, "_range"]])


def running(df: DataFrame, key: list[str], order: list[str], **sums: Column) -> DataFrame:
    """Add, for each name, the sum over the earlier rows of the key (0 for the first one): exact for whole numbers and decimals.

    F.lit(1) numbers the rows of a key from 0. All columns are shuffled and written, so leave out of df what can be joined or is not needed.
    """
    rows = cut_lineage(ranges(df, key, order)).withColumns({f"_{n}": c for n, c in sums.items()})
    per = rows.groupBy(*key, "_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    out = carried(rows, passed_on(per, key, **{f"_{n}_at": F.sum(f"_{n}").over(earlier(key)) for n in sums}), key)
    inside = in_range(key, order).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    kind = lambda n: "long" if rows.schema[f"_{n}"].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint") else rows.schema[f"_{n}"].dataType.simpleString()
    out = out.withColumns({n: (zero(F.col(f"_{n}_at")) + zero(F.sum(f"_{n}").over(inside))).cast(kind(n)) for n in sums})
    return out.drop("_range", *[c for n in sums for c in (f"_{n}", f"_{n}_at")])


def stitched(pieces: DataFrame, key: list[str], joined: Column, aggregates: list[Column]) -> DataFrame:
    """Aggregate pieces (key, _range, _piece, ...) that belong together over ranges: a piece for which `joined` holds goes on with the last piece
    of the earlier ranges that is not joined itself. Joined pieces come before all others of their range."""
    name = F.struct("_range", "_piece")
    rows = pieces.withColumn("_joined", F.coalesce(joined, F.lit(False)))
    own = rows.groupBy(*key, "_range").agg(F.max(F.when(~F.col("_joined"), name)).alias("_own"))
    rows = carried(rows, passed_on(own, key, _open=F.max("_own").over(earlier(key))), key)
    return rows.groupBy(*key, F.when(F.col("_joined"), F.col("_open")).otherwise(name).alias("_whole")).agg(*aggregates).drop("_whole")
