"""Operator 10, sharding: Hilbert-curve ordering over quantised metadata, then equal runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialise, ranked, table, value_ranks

BITS = 6


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell with the given axis coordinates (0 .. 2**bits - 1).

    Skilling's transpose form ("Programming the Hilbert curve", 2004) as a fold over (bit, axis) steps;
    built-in array functions only.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x, s):
        p, first, own = s["q"] - 1, x[0], F.get(x, s["i"])
        swap = (first.bitwiseXOR(own)).bitwiseAND(p)
        flip = own.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, k: F.when(flip, F.when(k == 0, v.bitwiseXOR(p)).otherwise(v)).when((k == 0) | (k == s["i"]), v.bitwiseXOR(swap)).otherwise(v))

    def gray(x):
        out = [x[0]]
        for i in range(1, n):
            out.append(x[i].bitwiseXOR(out[-1]))
        return F.array(*out)

    def parity(x):
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(x[n - 1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    def weave(x):
        h = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                h = F.shiftleft(h, 1).bitwiseOR(F.shiftright(x[i], b).bitwiseAND(F.lit(1)).cast("long"))
        return h

    start = F.array(*[a.cast("int") for a in axes])
    return let(F.aggregate(steps, start, undo), lambda x: let(gray(x), lambda g: let(parity(g), weave)))


def value_codes(df: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """Add _code_<col>: the rank of a value among the sorted distinct values, spread evenly over the axis; null has 0.

    The code never falls as the value grows, however many values there are. Up to 200,000 values are broadcast.
    """
    cells = 1 << bits
    ranks, n = value_ranks(df, col)
    codes = ranks.select("value", F.expr(f"cast((r + 1) * {cells} div {n + 1} as int)").alias("code"))
    out = df.join(F.broadcast(codes) if n <= 200_000 else codes.hint("merge"), F.col(col) == F.col("value"), "left")
    return out.withColumn(f"_code_{col}", F.coalesce("code", F.lit(0))).drop("value", "code")


def shard_by_hilbert(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", dims: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Order rows along a Hilbert curve over (dims..., log2 of the size) and cut the order into `shards` equal runs.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, the dims and `keep` columns, hilbert, rank, shard and slot.
    The law is `rows`: shard sizes differ by one at most, slot counts from 0 in each shard. A shard covers a
    short run of the curve, so min/max statistics of every dimension prune files (see write_shards).
    Nulls: a null text has size 1 and the checksum of the empty text; a null dimension sorts at 0. Repeated
    rows each get a slot. An empty table gives no rows. Only key columns are shuffled, never texts. Columns that
    neither dims nor keep name are not read; dims and keep must not name a result column.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + F.lit(1)).cast("long")
    cols = {doc_id: F.col(doc_id), "size": size, "text_crc32": F.crc32(body.cast("binary"))} | {c: F.col(c) for c in (*dims, *keep)}
    rows = docs.select(*[e.alias(k) for k, e in cols.items()])
    rows = materialise(rows)  # keys only
    for d in dims:
        rows = value_codes(rows, d)
    scale = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.col("size").cast("double")) * 2)).cast("int")
    rows = rows.withColumn("hilbert", hilbert_index([*[F.col(f"_code_{d}") for d in dims], scale])).drop(*[f"_code_{d}" for d in dims])
    rows = materialise(rows)  # the codes come by joins
    total = rows.count()
    out = ranked(rows, ["hilbert"], [F.col(doc_id), F.col("text_crc32"), F.col("size")], "rank")
    if total == 0:
        return out.withColumn("shard", F.lit(0)).withColumn("slot", F.col("rank"))
    wide, base = total % shards, total // shards  # the first `wide` shards hold base + 1 rows
    edge = wide * (base + 1)
    low = F.col("rank") < edge
    out = out.withColumn("shard", F.when(low, F.expr(f"rank div {base + 1}")).otherwise(F.lit(wide) + F.expr(f"(rank - {edge}) div {max(base, 1)}")).cast("int"))
    start = F.when(F.col("shard") <= wide, F.col("shard").cast("long") * (base + 1)).otherwise(F.lit(edge) + (F.col("shard").cast("long") - wide) * base)
    return out.withColumn("slot", (F.col("rank") - start).cast("long"))


def write_shards(rows: DataFrame, path: str, shards: int = 16) -> None:
    """Write rows of shard_by_hilbert as Parquet, a folder and a file for each shard, in slot order."""
    rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_hilbert(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
