"""Set operations over batches and rosters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_batches(batches: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all batches with `batch`, and the keys found more than once."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("batch", F.lit(name)) for name, df in batches.items()])
    return rows, rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def add_references(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new references; an overlap raises when it is read."""
    known = old.select(key).distinct().withColumn("_o", F.lit(True))
    marked = new.join(known, key, "left")
    ok = F.when(F.col("_o").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("already there: "), F.col(key).cast("string"))).cast("boolean"))
    return old.unionByName(marked.where(ok).drop("_o").select(old.columns))


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each distinct key with `place`: left, right or both."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    place = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return a.join(b, key, "full").select(key, place.alias("place"))


def order_difference(left: DataFrame, right: DataFrame, position: str, key: str) -> DataFrame:
    """U4: positions at which two ordered rosters differ or one ends."""
    a, b = left.select(position, F.col(key).alias("left_key")), right.select(position, F.col(key).alias("right_key"))
    return a.join(b, position, "full").where(~F.col("left_key").eqNullSafe(F.col("right_key")))
