"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of characters that are neither a space nor tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """A folder for this application in the one that spark.checkpoint.dir names, which all executors share.

    Where the setting is absent, a local folder serves a local session; any other session raises.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_dir(app)
    return f"{root.rstrip('/')}/{app}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, any executor can reread it."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that materialise wrote for this application; store the results that read them first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, max_rows: int = 200_000) -> DataFrame:
    """Join a materialised right side: broadcast if it holds at most max_rows rows, else by sort-merge (AQE splits skew)."""
    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def boxed(df: DataFrame, **keys: Column) -> DataFrame:
    """The rows of df as one struct column `row` beside the given columns, so that no name in df can clash with an operator's own."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def unboxed(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The fields `columns` of `row`, then the added columns, which replace fields of their names in place at the end."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in added], *[c.alias(k) for k, c in added.items()])


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column, chunk: int = 256) -> Column:
    """Sums of all earlier elements, for an array of longs; by chunks, so that the cost is not square in its size."""
    none = F.expr("cast(array() as array<bigint>)")

    def within(xs):
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        return F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step)

    def chunked(xs):
        firsts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        parts = F.transform(firsts, lambda i: within(F.slice(xs, i * chunk + 1, chunk)))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, within(F.transform(ps, lambda p: p["at"]))["out"], lambda p, base: F.transform(p["out"], lambda x: x + base))))

    return let(lengths, chunked)


def ranked(df: DataFrame, cells: list[str], within: list[Column], name: str, group: list[str] | None = None, first: Column | None = None) -> DataFrame:
    """Add `name`: the 0-based gapless rank of each row in its group (default: all rows), by cells, then a hash of `within`, then `within`.

    `first` stands for the hash where an order is given: a long from 0 to 2^31 - 1, spread over that range.

    `group` is a leading part of `cells`. A cell that holds many rows is cut by ranges of the hash into
    buckets of like size, so no task sorts a hot cell. Offsets are sums over the cells of a group (a row each), then
    over the buckets of a cell (at most max(4096, rows / 100,000)). Null cells form a cell of their own.
    """
    group = group or []
    df = df.withColumn("_u", F.pmod(F.xxhash64(*within), F.lit(1 << 31)) if first is None else first).withColumns({f"_c{i}": F.col(c) for i, c in enumerate(cells)})
    keys = [f"_c{i}" for i in range(len(cells))]
    before = lambda part, order, c: F.coalesce(F.sum(c).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = materialise(df.groupBy(*keys).agg(F.count("*").alias("_n")))
    total = sizes.agg(F.sum("_n"), F.count("*")).first()
    sizes = materialise(sizes.withColumn("_base", before([f"_c{cells.index(g)}" for g in group], keys, "_n")))
    target = max(64, min(100_000, math.ceil((total[0] or 0) / 4096)))
    side = F.broadcast(sizes.alias("s")) if total[1] <= 200_000 else sizes.alias("s").hint("merge")
    cut = df.alias("d").join(side, same_all("d", "s", keys), "inner").select("d.*", "s._n", "s._base")
    cut = cut.withColumn("_b", F.floor(F.col("_u") * F.ceil(F.col("_n") / target) / F.lit(1 << 31)).cast("long")).drop("_n")
    offsets = materialise(cut.groupBy(*keys, "_b").agg(F.count("*").alias("_m")).withColumn("_at", before(keys, ["_b"], "_m")).drop("_m"))
    rows = cut.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_u", *within)))
    joined = rows.alias("d").join(offsets.alias("s").hint("merge"), same_all("d", "s", [*keys, "_b"]), "inner")
    return joined.select("d.*", (F.col("d._base") + F.col("s._at") + F.col("d._r") - 1).cast("long").alias(name)).drop("_u", "_b", "_r", "_base", *keys)


def value_ranks(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(value, r) for the distinct non-null values of a column, r from 0 in their order, and how many there are.

    Values are dealt by ranges and numbered by the counts of the ranges, so no task sees them all.
    """
    one = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialise(one.repartitionByRange("value").sortWithinPartitions("value").select("value", F.spark_partition_id().alias("p"), place.alias("i")))
    sizes = rows.groupBy("p").agg(F.count("*").alias("n"))
    offsets = sizes.select("p", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    return materialise(rows.join(F.broadcast(offsets), "p").select("value", (F.col("at") + F.col("i")).cast("long").alias("r"))), rows.count()


def same_all(left: str, right: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


#: Edges from which on a node counts as a hub.
HUB = 1000


def with_least(edges: DataFrame, count: int) -> DataFrame:
    """Edges (a, b) with m, the least of a and its neighbours. The edges of hubs meet their m by broadcast, so no task reads a whole hub."""
    limit = max(HUB, count // 50_000)
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    if count <= limit:
        return edges.join(least.drop("n").hint("merge"), "a")
    least = materialise(least)
    hubs = F.broadcast(least.where(F.col("n") > limit).select("a", "m"))  # at most 50,000 rows
    rest = edges.join(hubs, "a", "left_anti").join(least.where(F.col("n") <= limit).select("a", "m").hint("merge"), "a")
    return edges.join(hubs, "a").unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) where root is the smallest node reachable; a root has no row.

    Alternates the large-star and small-star steps on hash-partitioned edges; each round is written to
    the shared folder. Edge count never grows; a hub's neighbours are pre-aggregated by min only.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * now.count()).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct())
        small = with_least(large, large.count()).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = materialise(small.where("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        last = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
