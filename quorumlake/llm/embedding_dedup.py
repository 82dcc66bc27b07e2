"""Operator 9, embedding near-dedup: collision counting over one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, components, materialise, table, unboxed

#: Rows of a bucket that one task compares at once; a larger bucket is compared chunk by chunk.
CHUNK = 1024


def plan(n: int, cosine: float, miss: float = 1e-4, windows: int = 24, width: float = 2.5) -> dict:
    """Numbers of the method, from the row count and the cosine to be found.

    cuts: projections cut at zero that make up a sorted key; orders: keys, so that a pair at that cosine shares
    none with probability `miss`; windows: projections whose query-centred windows are counted; half: half a
    window in units of the projection's spread of such a pair; least: the count that such a pair passes with
    probability 1 - miss / 100 (a binomial tail).
    """
    cuts = min(62, max(8, math.ceil(math.log2(max(n, 2))) + 3))
    share = (1 - math.acos(min(1.0, cosine)) / math.pi) ** cuts
    orders = math.ceil(math.log(miss) / math.log1p(-share)) if share < 1 else 1
    inside = math.erf(width / math.sqrt(2))
    tail, least = 0.0, windows
    for k in range(windows):
        tail += math.comb(windows, k) * inside**k * (1 - inside) ** (windows - k)
        if tail > miss / 100:
            least = k
            break
    return {"cuts": cuts, "orders": orders, "windows": windows, "width": width, "least": least}


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    g = np.random.default_rng(seed).standard_normal((dim, count))
    return g / np.linalg.norm(g, axis=0)


def unit(vector) -> np.ndarray | None:
    """The unit vector in double precision; None for a vector that links with nothing."""
    if vector is None or len(vector) == 0:
        return None
    x = np.asarray(vector, dtype=np.float64)  # a null component becomes NaN
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def representatives(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """A row for each distinct vector: rid (its smallest id), weight (ids that hold it) and embedding."""
    one = vectors.where(F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).alias("id")).agg(F.min(embedding).alias("embedding"))
    return one.groupBy("embedding").agg(F.min("id").alias("rid"), F.count("*").alias("weight"))


def key_type(p: dict) -> np.dtype:
    """The smallest whole type that holds a key."""
    return np.dtype(np.int32 if p["cuts"] < 32 else np.int64)


def with_keys(reps: DataFrame, p: dict, seed: int) -> DataFrame:
    """rid, weight, dim, x (unit vector, in the precision of the input) and keys (one for each order) of the vectors that can link."""
    cuts, orders, kind = p["cuts"], p["orders"], key_type(p)
    single = reps.schema["embedding"].dataType.elementType.simpleString() == "float"

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bit, known = (1 << np.arange(cuts, dtype=np.int64)).astype(kind), {}
        for b in batches:
            xs = [unit(v) for v in b["embedding"]]
            for dim in {len(x) for x in xs if x is not None}:
                at = [i for i, x in enumerate(xs) if x is not None and len(x) == dim]
                x = np.array([xs[i] for i in at])
                if dim not in known:
                    known[dim] = directions(dim, cuts * orders, seed)
                keys = np.stack([(x @ known[dim][:, o * cuts : (o + 1) * cuts] > 0).astype(kind) @ bit for o in range(orders)], 1)
                own = [np.asarray(b["embedding"].iat[i], dtype=np.float32) if single else x[k] for k, i in enumerate(at)]
                yield pd.DataFrame({"rid": b["rid"].to_numpy()[at], "weight": b["weight"].to_numpy()[at], "dim": np.int32(dim), "x": [v.tobytes() for v in own], "keys": [k.tobytes() for k in keys]})

    return reps.mapInPandas(emit, "rid long, weight long, dim int, x binary, keys binary")


def units(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision of stored vectors of one length."""
    kind = np.float32 if len(raw[0]) == 4 * dim else np.float64
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def key_rows(keyed: DataFrame, p: dict) -> DataFrame:
    """(dim, ord, key, rid): one row for each vector and order."""
    orders, kind = p["orders"], key_type(p)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = np.frombuffer(b"".join(b["keys"]), dtype=kind).reshape(len(b), orders)
            for o in range(orders):
                yield pd.DataFrame({"dim": b["dim"], "ord": np.int32(o), "key": keys[:, o].astype(np.int64), "rid": b["rid"]})

    return keyed.select("rid", "dim", "keys").mapInPandas(emit, "dim int, ord int, key long, rid long")


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable place of each of n places under links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def count_collisions(p: dict, cosine: float, seed: int):
    """The function that compares sorted groups: counts window collisions of each pair, verifies those that pass."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for b in batches:
            b = b if left is None else pd.concat([left, b], ignore_index=True)
            g = b[["dim", "ord", "key", "lo", "hi"]].to_numpy()
            new = np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1
            cut = new[-1] if len(new) else 0
            left = b.iloc[cut:]
            if cut:
                yield b.iloc[:cut].reset_index(drop=True)
        if left is not None and len(left):
            yield left.reset_index(drop=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {}
        for b in groups(batches):
            for dim, d in b.groupby("dim"):
                if dim not in known:
                    known[dim] = directions(dim, p["windows"], seed + 1)
                yield from links(d.reset_index(drop=True), dim, known[dim])

    def links(d: pd.DataFrame, dim: int, r: np.ndarray) -> Iterator[pd.DataFrame]:
        """Pairs of a group by their distance in it. A pair counts in the first order in which its keys agree only."""
        half = p["width"] * math.sqrt(2 - 2 * cosine) / math.sqrt(dim)
        x = units(list(d["x"]), dim)
        keys = np.frombuffer(b"".join(d["keys"]), dtype=key_type(p)).reshape(len(d), -1)
        at = (x @ r).astype(np.float32)
        rid, weight, order, side = (d[c].to_numpy() for c in ("rid", "weight", "ord", "side"))
        cross = (d["lo"] != d["hi"]).to_numpy()
        g = d[["ord", "key", "lo", "hi"]].to_numpy()
        group = np.concatenate([[0], np.cumsum((g[1:] != g[:-1]).any(1))])
        found_i, found_j = [], []
        for gap in range(1, np.bincount(group).max()):
            i = np.flatnonzero(group[:-gap] == group[gap:])
            j = i + gap
            ok = ~cross[i] | (side[i] != side[j])
            i, j = i[ok], j[ok]
            ok = (np.abs(at[i] - at[j]) <= half).sum(1) >= p["least"]
            i, j = i[ok], j[ok]
            if len(i):
                first = (keys[i] == keys[j]).argmax(1)
                ok = (first == order[i]) & (np.einsum("nd,nd->n", x[i], x[j]) >= cosine)
                found_i.append(i[ok])
                found_j.append(j[ok])
        if found_i:
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            n = np.bincount(i, weights=weight[j], minlength=len(d)) + np.bincount(j, weights=weight[i], minlength=len(d))
            has = n > 0
            yield pd.DataFrame({"rid": rid[has], "links": n[has].astype(np.int64), "root": rid[local_roots(len(d), i, j)][has]})

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 11) -> DataFrame:
    """Add n_links, component_id and kept to vectors: links are pairs with cosine >= `cosine`, in double precision.

    Distinct vectors are sorted by keys of one-dimensional projections cut at zero; inside a run of equal keys the
    collisions of each pair in query-centred windows of further projections are counted, and pairs that reach the
    calibrated count are verified. A pair exactly at the threshold is missed with a chance of about 1e-4 (see plan).
    Equal vectors are one node with a weight, so a group of copies costs nothing; larger runs are compared
    chunk by chunk, with counts and a spanning set of links as output, never the pairs.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing: n_links 0,
    component_id their own id, kept. A row with a null id has n_links 0, a null component_id and is not kept. Of
    rows that share an id, the least embedding counts. Vectors of different lengths never link. Columns of the added names are
    replaced; others keep their values whatever their names.
    """
    reps = materialise(representatives(vectors, vec_id, embedding))
    p = plan(reps.count(), cosine)
    keyed = materialise(with_keys(reps, p, seed))
    light = key_rows(keyed, p)
    sizes = light.groupBy("dim", "ord", "key").agg(F.count("*").alias("n")).where("n > 1")
    run = light.join(sizes.hint("merge"), ["dim", "ord", "key"])
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    run = run.withColumn("side", F.pmod(F.xxhash64("rid"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    run = run.select("dim", "ord", "key", F.least("side", "o").alias("lo"), F.greatest("side", "o").alias("hi"), "side", "rid")
    groups = ["dim", "ord", "key", "lo", "hi"]
    full = run.join(keyed.select("rid", "weight", "x", "keys").hint("merge"), "rid").repartition(*groups).sortWithinPartitions(*groups, "rid")
    found = materialise(full.mapInPandas(count_collisions(p, cosine, seed), "rid long, links long, root long"))
    linked = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    nodes = reps.join(keyed.select("rid", F.lit(True).alias("able")).hint("merge"), "rid", "left").join(linked.hint("merge"), "rid", "left").join(roots.withColumnRenamed("node", "rid").hint("merge"), "rid", "left")
    nodes = nodes.select(F.col("embedding").alias("_e"), "rid", F.coalesce("able", F.lit(False)).alias("able"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "rid").alias("root"))
    ids = vectors.where(F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).alias("id")).agg(F.min(embedding).alias("v"))
    named = ids.join(nodes.hint("merge"), F.col("v").eqNullSafe(F.col("_e")))
    named = named.select(F.col("id").alias("of"), F.when(F.col("able"), F.col("links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("able"), F.col("root")).otherwise(F.col("id")).alias("component_id"))
    out = boxed(vectors, id=F.col(vec_id)).join(named.hint("merge"), F.col("id") == F.col("of"), "left")
    n_links = F.coalesce("n_links", F.lit(0).cast("long"))
    return unboxed(out, vectors.columns, n_links=n_links, component_id=F.col("component_id"), kept=F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")
