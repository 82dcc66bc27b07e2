"""Identity, split leaks and lineage components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def identity_rows(df: DataFrame, role: str, kinds: dict[str, str]) -> DataFrame:
    """Long (kind, value, role) of identity columns; columns given the same kind share a namespace; null is no identity."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for c, k in kinds.items()])
    return df.select(F.col(role).alias("role"), F.explode(pairs).alias("p")).select("p.kind", "p.value", "role").where(F.col("value").isNotNull())


def role_leaks(df: DataFrame, role: str, kinds: dict[str, str]) -> DataFrame:
    """L1, L2: identities seen under more than one role."""
    out = identity_rows(df, role, kinds).groupBy("kind", "value").agg(F.count_distinct("role").alias("roles"), F.min("role").alias("first_role"), F.max("role").alias("last_role"))
    return out.where("roles > 1")


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that spark.checkpoint.dir names; without that, a local one for a local session only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_dir(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/lineage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; store the results that read it first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Edges from which on a node counts as a hub.
HUB = 1000


def with_least(edges: DataFrame, count: int) -> DataFrame:
    """Edges (a, b) with m, the least of a and its neighbours. The edges of hubs meet their m by broadcast, so no task reads a whole hub."""
    limit = max(HUB, count // 50_000)
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    if count <= limit:
        return edges.join(least.drop("n").hint("merge"), "a")
    least = cut_lineage(least)
    hubs = F.broadcast(least.where(F.col("n") > limit).select("a", "m"))  # at most 50,000 rows
    rest = edges.join(hubs, "a", "left_anti").join(least.where(F.col("n") <= limit).select("a", "m").hint("merge"), "a")
    return edges.join(hubs, "a").unionByName(rest)


#: Edges up to which a graph is contracted in one task, which then holds about 200 bytes a node.
LOCAL = 500_000


def joined_locally(edges: DataFrame) -> DataFrame:
    """Connected components of at most LOCAL edges (a, b) by union-find in one task: rows (node, root) where root is the least node reachable."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(x), root(y)
                above[max(x, y)] = min(x, y)
        rows = [(x, r) for x in above if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if kind == "string" else None) if rows else pa.array([], pa.string() if kind == "string" else pa.int64()) for i in (0, 1)], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def stars(edges: DataFrame, max_rounds: int = 60, local: int | None = None) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) where root is the least node reachable; a root has no row.

    Alternates the large-star and small-star steps on hash-partitioned edges; each round is written to the shared
    folder. The number of edges never grows, and a hub's neighbours are aggregated by min before they are shuffled.
    Ends when the large-star step changes nothing and every node has one edge to a smaller one. Graphs of at most `local` (default: LOCAL) edges of strings or longs,
    at the start or after a round, are finished in one task, with the same result.
    """
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    local = LOCAL if local is None else local
    simple = edges.schema["a"].dataType.simpleString() in ("string", "bigint")
    for _ in range(max_rounds):
        before = state(now)
        if simple and before[0] <= local:
            return cut_lineage(joined_locally(now))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct())
        if state(large) == before and large.groupBy("a").count().where("count > 1").isEmpty():
            return large.select(F.col("a").alias("node"), F.col("b").alias("root"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = with_least(large, before[0]).select(F.explode(pairs).alias("e")).select("e.a", "e.b")
        now = cut_lineage(small.where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components: (node, component) for every node of an edge, with the least node as the component's name."""
    edges = cut_lineage(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(stars(edges).hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def identity_components(df: DataFrame, row_id: str, kinds: dict[str, str]) -> DataFrame:
    """L3: rows with the component they share through any identity; a row without identities is its own."""
    pairs = F.array(*[F.concat_ws(":", F.lit(k), F.when(F.col(c).isNotNull(), F.col(c).cast("string"))) for c, k in kinds.items()])
    known = F.filter(pairs, lambda p: F.contains(p, F.lit(":")))
    edges = df.select(F.concat(F.lit("row:"), F.col(row_id).cast("string")).alias("x"), F.explode(known).alias("y"))
    comp = connected(edges, "x", "y").where(F.col("node").startswith("row:")).select(F.substring("node", 5, 1 << 30).alias("_id"), "component")
    low = comp.groupBy("component").agg(F.min("_id").alias("_low"))
    out = df.join(comp.join(low, "component").select("_id", "_low"), F.col(row_id).cast("string") == F.col("_id"), "left")
    return out.withColumn("component", F.coalesce("_low", F.col(row_id).cast("string"))).drop("_id", "_low")


def split_leaks(df: DataFrame, split: str, component: str = "component") -> DataFrame:
    """L3: components whose rows lie in more than one split."""
    out = df.groupBy(component).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows"))
    return out.where("splits > 1")


def lineage_groups(sources: DataFrame, edges: DataFrame, exposed: DataFrame, banned: DataFrame, key: str, role: str, group: str) -> DataFrame:
    """L4: every source with its canonical group (least member), whether the group is exposed, and the violation, if any:
    banned_member, exposed_not_train, role_clash, or group_not_component (named groups and components are not one to one)."""
    comp = connected(edges, "left", "right").withColumnRenamed("node", key)
    out = sources.join(comp.hint("merge"), key, "left").withColumn("component", F.coalesce("component", key))
    marks = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(True))
    out = out.join(marks(exposed, "_e"), key, "left").join(marks(banned, "_b"), key, "left")
    per = out.groupBy("component").agg(F.bool_or(F.col("_e").isNotNull()).alias("exposed"), F.bool_or(F.col("_b").isNotNull()).alias("_banned"), F.count_distinct(role).alias("_roles"), F.count_distinct(group).alias("_groups"))
    named = out.groupBy(group).agg(F.count_distinct("component").alias("_comps"))
    out = out.drop("_e", "_b").join(per, "component").join(named, group)
    fault = F.when(F.col("_banned"), "banned_member").when(F.col("exposed") & (F.col(role) != "train"), "exposed_not_train").when(F.col("_roles") > 1, "role_clash").when((F.col("_groups") > 1) | (F.col("_comps") > 1), "group_not_component")
    return out.withColumn("violation", fault).drop("_banned", "_roles", "_groups", "_comps")


def typed_key(namespace: Column, value: Column) -> Column:
    """Namespace:id; a numeric speaker id loses its leading zeros."""
    ns = F.lower(F.trim(namespace))
    number = F.regexp_extract(value, r"^\s*0*(\d+)\s*$", 1)
    return F.concat(ns, F.lit(":"), F.when((ns == "speaker") & (number != ""), number).otherwise(F.trim(value)))


def extend_registry(registry: DataFrame, new: DataFrame, key: str, every: int = 4) -> DataFrame:
    """Append unseen keys (in key order); every fourth registration is `dev`, the rest `train`; old roles never change.

    registry: key, ordinal, role, speaker_id. The id is a hash, so reruns agree.
    """
    from .intervals import numbered

    at = registry.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("_at"))
    fresh = new.select(key).distinct().join(registry.select(key), key, "left_anti")
    rows = numbered(fresh, [F.col(key)], "_n", 0).crossJoin(F.broadcast(at)).withColumn("ordinal", F.col("_at") + F.col("_n")).drop("_at", "_n")
    role = F.when(F.pmod("ordinal", F.lit(every)) == every - 1, "dev").otherwise("train")
    rows = rows.withColumn("role", role).withColumn("speaker_id", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 32))
    return registry.unionByName(rows.select(registry.columns))


def registry_faults(registry: DataFrame, key: str, every: int = 4) -> DataFrame:
    """What is wrong with a registry: a key or a speaker_id that is there twice, an ordinal that is repeated or beyond the number of rows, and a role that
    is not the one of its ordinal. No row: the registry is valid."""
    twice = lambda c, code: registry.groupBy(F.col(c).cast("string").alias("value")).count().where("count > 1").select(F.lit(code).alias("fault"), "value")
    size = registry.agg(F.count("*").alias("_size"))
    rows = registry.crossJoin(F.broadcast(size))
    role = F.when(F.pmod("ordinal", F.lit(every)) == every - 1, "dev").otherwise("train")
    row = lambda cond, code: rows.where(F.coalesce(cond, F.lit(True))).select(F.lit(code).alias("fault"), F.col(key).cast("string").alias("value"))
    out = twice(key, "repeated_key").unionByName(twice("speaker_id", "shared_id")).unionByName(twice("ordinal", "repeated_ordinal"))
    return out.unionByName(row((F.col("ordinal") < 0) | (F.col("ordinal") >= F.col("_size")), "ordinal_out_of_range")).unionByName(row(F.col("role") != role, "role_changed"))


def registry_lookup(registry: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Every wanted key once, with its entry, or the reason not_registered."""
    found = wanted.select(key).distinct().join(registry.hint("merge"), key, "left")
    return found.withColumn("reason", F.when(F.col("speaker_id").isNull(), "not_registered"))


def partition_role(partition: Column) -> Column:
    """Test and heldout partitions are refused, dev partitions never train."""
    p = F.lower(F.trim(partition))
    return F.when(p.isin("test", "heldout"), "refused").when(p.isin("dev", "development", "validation"), "dev").when(p == "train", "train").otherwise("unknown")


def history_overlap(requests: DataFrame, history: DataFrame, fingerprint: str) -> DataFrame:
    """Requests whose fingerprint is in the history; must be empty."""
    return requests.join(history.select(fingerprint).distinct(), fingerprint, "left_semi")


def shared_train(first: DataFrame, second: DataFrame, consumed: DataFrame, speaker: str, role: str) -> DataFrame:
    """Speakers that both splits have in train, less the consumed."""
    t = lambda df: df.where(F.col(role) == "train").select(speaker)
    return t(first).intersect(t(second)).join(consumed.select(speaker).distinct(), speaker, "left_anti")
