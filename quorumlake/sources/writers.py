"""Writers: tagged exports, manifests, digests and flat traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators.validate import row_digest


def tagged_exports(rows: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """IO9: one row for each export that a row belongs to, with `export_kind`."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return rows.withColumn("export_kind", F.explode(tags))


def write_exports(rows: DataFrame, kinds: dict[str, Column], path: str, partition: list[str]) -> None:
    """IO9: the tagged table as Parquet, partitioned by kind and `partition`."""
    tagged_exports(rows, kinds).write.partitionBy("export_kind", *partition).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """IO10: path, bytes and SHA-256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_summary(files: DataFrame) -> DataFrame:
    """IO10: files, bytes and one digest of a manifest, whatever its order."""
    out = _folded(files.select(F.col("sha256").alias("h"), "bytes"), F.sum("bytes").alias("bytes"))
    return out.agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), _digest().alias("digest"))


def table_digest(df: DataFrame) -> DataFrame:
    """IO11: one digest of a table whatever its order; repeated rows count."""
    return _folded(df.select(row_digest(df.columns).alias("h"))).agg(F.sum("n").alias("rows"), _digest().alias("digest"))


def _folded(digests: DataFrame, *more: Column, buckets: int = 256) -> DataFrame:
    """Sums of the hex digests `h` in buckets (b, n, s): whole numbers, so partial aggregation holds no list of digests."""
    part = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    bucket = F.pmod(F.crc32(F.col("h").cast("binary")), F.lit(buckets)).alias("b")
    return digests.groupBy(bucket).agg(F.count("*").alias("n"), F.concat_ws(":", *[part(i) for i in range(8)]).alias("s"), *more)


def _digest() -> Column:
    """One digest over the buckets of `_folded`."""
    rows = F.sort_array(F.collect_list(F.struct("b", "s")))
    return F.sha2(F.concat_ws("\n", F.transform(rows, lambda x: F.concat_ws("=", x["b"].cast("string"), x["s"]))), 256)


def write_flat_trace(hops: DataFrame, metadata: DataFrame, summary: DataFrame, path: str) -> None:
    """IO12: hop rows as JSON lines, with the metadata and summary as sibling tables."""
    for name, df in (("hops", hops), ("metadata", metadata), ("summary", summary)):
        df.write.json(f"{path}/{name}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
