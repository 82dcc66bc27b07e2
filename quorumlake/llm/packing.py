"""Operator 8, packing: length buckets with the least padding, and token-budget batches inside each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, ranked, table, words


def best_bounds(counts: dict[int, int], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets that minimise total padding, by dynamic programming.

    counts: number of pieces by length. Bounds are lengths that occur; the last is the longest.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    n = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    many, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * lengths)])
    m = len(lengths)
    best = np.full(m + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    picks = []
    for _ in range(min(buckets, m)):
        new, pick = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (many[j] - many[:j]) - (total[j] - total[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], pick[j] = cost[i], i
        best = new
        picks.append(pick)
    bounds, j = [], m
    for pick in reversed(picks):
        if j and pick[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(pick[j])
    return bounds[::-1]


def token_counts(text: str, tokenizer_file: str | None):
    """Tokens of the whole text: words, or ids of the tokenizer in tokenizer_file (a path that every executor sees)."""
    if tokenizer_file is None:
        return F.size(words(F.col(text))).cast("long")

    @F.pandas_udf("long")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        t.encode_special_tokens = True
        for b in batches:
            yield pd.Series([len(e) for e in t.encode_batch(b.tolist(), add_special_tokens=False)], dtype="int64")

    return encode(F.coalesce(F.col(text), F.lit("")))


def placed_rows(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns with _file and _row: the place of a row in the files of docs or, where docs is not read from files, in its partitions."""
    try:
        return docs.select(*columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.select(*columns, F.format_string("%010d", F.spark_partition_id()).alias("_file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row"))


def row_numbers(rows: DataFrame) -> tuple[DataFrame, int]:
    """Add _at, the number of a row of placed_rows in the order of files and rows, from the counts of the files; and the number of rows."""
    sizes = materialise(rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n")))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(F.length("_file"), "_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = rows.join(F.broadcast(offsets), "_file").withColumn("_at", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
    return numbered, sizes.agg(F.sum("_n")).first()[0] or 0


def pack(docs: DataFrame, max_len: int = 2048, buckets: int = 8, budget: int = 16_384, tokenizer_file: str | None = None, text: str = "text", doc_id: str = "doc_id", ordered: bool = False) -> DataFrame:
    """doc_id, part, start, n_tokens, bucket, bucket_len, batch, slot and padding: where each piece of each text goes.

    A text of more than max_len tokens is cut into pieces of max_len and a rest, so all of it is packed. The bounds
    of the buckets come from the histogram of all pieces (at most max_len rows reach the driver). A batch of a bucket
    holds budget // bucket_len pieces (one, over the budget, where the budget is less than the bucket's length), in hash
    order of their documents; batch numbers are gapless over all buckets.
    ordered: pieces keep the order of the rows of docs (by file name and row in it, if docs is read from files) instead.
    Nulls: a null or wordless text is one row with n_tokens 0 and no bucket, batch or slot. Rows with a null doc_id
    and repeated rows are packed like others. Other columns of docs are not read. No rows: no result rows. A bucket that holds a third of all pieces is ranked in parts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(doc_id).alias("doc_id"), F.crc32(body.cast("binary")).alias("text_crc32"), token_counts(text, tokenizer_file).alias("n")]
    rows = materialise(placed_rows(docs, columns) if ordered else docs.select(*columns))
    order, first, at = [F.col("doc_id"), F.col("text_crc32"), F.col("part")], None, []
    if ordered:
        rows, total = row_numbers(rows)
        order, first, at = [F.col("_at"), F.col("part")], F.expr(f"cast(_at * {1 << 31} div {max(1, total)} as long)"), ["_at"]
    parts = rows.where("n > 0").withColumn("part", F.explode(F.expr(f"sequence(0, cast((n - 1) div {max_len} as int))")))
    parts = parts.select("doc_id", "text_crc32", "part", (F.col("part").cast("long") * max_len).alias("start"), F.expr(f"least({max_len}, n - part * {max_len})").cast("int").alias("n_tokens"), *at)
    counts = {r["n_tokens"]: r["count"] for r in parts.groupBy("n_tokens").count().collect()}
    bounds = best_bounds(counts, buckets)
    shape = "doc_id {}, part int, start long, n_tokens int, bucket int, bucket_len int, batch long, slot int, padding int".format(rows.schema["doc_id"].dataType.simpleString())
    bare = rows.where("n = 0").selectExpr("doc_id", "0 as part", "0L as start", "0 as n_tokens", "cast(null as int) as bucket", "cast(null as int) as bucket_len", "cast(null as long) as batch", "cast(null as int) as slot", "0 as padding")
    if not bounds:
        return bare
    firsts, batch, low = [], 0, 0
    for b in bounds:
        n = sum(c for length, c in counts.items() if low < length <= b)
        firsts.append(batch)
        batch += -(-n // max(1, budget // b))
        low = b
    pick = lambda xs, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col("bucket"))
    lows = F.array(*[F.lit(b) for b in bounds])
    parts = parts.withColumn("bucket", F.size(F.filter(lows, lambda b: b < F.col("n_tokens"))))
    placed = ranked(parts, ["bucket"], order, "_rank", group=["bucket"], first=first)
    placed = placed.withColumn("bucket_len", pick(bounds, "int")).withColumn("_per", pick([max(1, budget // b) for b in bounds], "long")).withColumn("_batch", pick(firsts, "long"))
    placed = placed.withColumns({"batch": F.expr("_batch + _rank div _per"), "slot": F.expr("cast(_rank % _per as int)"), "padding": F.col("bucket_len") - F.col("n_tokens")})
    return placed.select(*[f.split()[0] for f in shape.split(", ")]).unionByName(bare)


def op8_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
