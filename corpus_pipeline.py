"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing over documents.

Each stage reads what its predecessor kept. All but the last return the columns of documents; nulls, repeated
rows and empty tables are treated as the operator of the stage says in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlake.llm.common import boxed, materialise, table, unboxed
from quorumlake.llm.line_dedup import line_dedup
from quorumlake.llm.mixing import TARGET, mix
from quorumlake.llm.near_dedup import near_unique
from quorumlake.llm.packing import pack
from quorumlake.llm.quality_rules import quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the scores are written before they are filtered, so each text is scored once."""
    return materialise(quality_rules(docs, table(spark, sf_dir, "labels")).select(*docs.columns, "kept")).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the cross-site lines; text and n_chars change."""
    return line_dedup(docs).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, in one row; null ids count as the largest."""
    return near_unique(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files ordered by the mixing position: sources go by the square roots of their sizes.

    Rows get their places by id and checksum; only rows that share both are numbered first.
    """
    order = materialise(mix(docs, TARGET).select(F.col("doc_id").alias("of"), F.col("text_crc32").alias("sum"), "position"))
    many = materialise(order.groupBy(F.col("of").alias("same"), F.col("sum").alias("crc")).count().where("count > 1").drop("count"))
    repeated = F.broadcast(many) if many.limit(200_001).count() <= 200_000 else many.hint("merge")
    rows = boxed(docs, id=F.col("doc_id"), t=F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    among = lambda i, t: F.col(i).eqNullSafe(F.col("same")) & (F.col(t) == F.col("crc"))
    place = F.col("id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("sum"))
    once = rows.join(order.join(repeated, among("of", "sum"), "left_anti").hint("merge"), place)
    k = lambda df, i, t: df.withColumn("k", F.row_number().over(W.partitionBy(i, t).orderBy(t)))
    twice = k(rows.join(repeated, among("id", "t"), "left_semi"), "id", "t").alias("d")
    places = k(order.join(repeated, among("of", "sum"), "left_semi"), "of", "sum").alias("o")
    twice = twice.join(places.hint("merge"), place & (F.col("d.k") == F.col("o.k")))
    both = once.select("row", "position").unionByName(twice.select("row", "position"))
    return unboxed(both.repartitionByRange("position").sortWithinPartitions("position"), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bucket, batch and slot; batches follow the mixing order."""
    return pack(docs, ordered=True)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express register banding, the Pfair schedule or the bucket search; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
