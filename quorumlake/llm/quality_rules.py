"""Operator 2, quality rules: base rules and a hashed n-gram log-likelihood ratio per document."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, boxed, let, materialise, sized_join, table, unboxed, words

#: Fixed-point scale of the weights: sums of whole numbers do not depend on their order.
SCALE = 1 << 20


def adjacent(xs: Column, gap: int) -> Column:
    """Hashes of xs[i] with xs[i + gap]."""
    m = F.greatest(F.size(xs) - gap, F.lit(0))
    return F.zip_with(F.slice(xs, 1, m), F.slice(xs, gap + 1, m), lambda a, b: F.xxhash64(a, b))


def repeated_words(bigrams: Column) -> Column:
    """Words that lie in an 8-word window found twice or more; from the hashes of word pairs."""

    def count(h8):
        placed = F.sort_array(F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(let(placed, twin), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        cover = F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + p + 8 - F.greatest(p, a["end"])).alias("n"), (p + 8).alias("end")))
        return F.when(F.size(h8) > F.size(F.array_distinct(h8)), cover["n"]).otherwise(F.lit(0)).cast("long")

    return let(adjacent(let(bigrams, lambda b: adjacent(b, 2)), 4), count)


def ngram_weights(docs: DataFrame, trusted: DataFrame, buckets: int, text: str, doc_id: str, prior: float) -> list[int]:
    """Fixed-point log ratios of the two multinomials by bucket: trusted documents against all documents.

    Counts cover the words and word pairs of all documents; they are combined in each task before the
    shuffle, which moves at most `buckets` rows from each. Only these `buckets` numbers reach the driver.
    """
    marked = sized_join(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), materialise(trusted.withColumn("t", F.lit(1))), ["id"], "left")
    marked = marked.select("t", words(F.col("text")).alias("w"))
    places = marked.where(F.size("w") > 0).select("w", F.coalesce("t", F.lit(0)).alias("t"), F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    one, two = F.xxhash64(F.get("w", F.col("i"))), F.xxhash64(F.get("w", F.col("i")), F.get("w", F.col("i") + 1))
    hashed = places.select("t", F.explode(F.when(F.col("i") < F.size("w") - 1, F.array(one, two)).otherwise(F.array(one))).alias("h"))
    counts = hashed.groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("t").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw), sum(target)
    if not n_target:
        return [0] * buckets
    ratio = lambda t, r: math.log((t + prior * n_target / n_raw) / (n_target + prior * buckets * n_target / n_raw)) - math.log((r + prior) / (n_raw + prior * buckets))
    return [round(SCALE * ratio(t, r)) for t, r in zip(target, raw)]


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = 1 << 15, threshold: float = -0.1, prior: float = 10.0) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and llr to docs.

    llr is the mean, over the words and word pairs of the text, of log p_trusted - log p_raw of the hashed
    n-gram; kept is `not base_failed and llr >= threshold`, the same rule for each document, with no draw.
    Trusted documents are all that `labels` marks quality 1; the raw counts cover all of docs. With no trusted
    document llr is 0 and the base rules decide alone.
    Nulls: a null text has no words, so it fails the base rules; rows with a null doc_id are scored too.
    Repeated rows are scored alike. Columns of the added names are replaced; others keep their values whatever their
    names. A filter on the result should read it from a written table: pushed below the scores it splits each text again.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
    weights = ngram_weights(docs, trusted, buckets, text, doc_id, prior)
    weigh = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # a constant for the optimizer
    body = F.coalesce("text", F.lit(""))
    out = boxed(docs, text=F.col(text)).withColumn("w", words(F.col("text"))).withColumn("b", adjacent(F.col("w"), 1))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.get(weigh, F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))
    total = total + F.aggregate("b", F.lit(0).cast("long"), lambda a, h: a + F.get(weigh, F.pmod(h, F.lit(buckets)).cast("int")))
    out = out.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length(body) - F.char_length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("b")).alias("n_repeat_words"),
        F.when(F.size("w") > 0, total / (F.size("w") + F.size("b")) / SCALE).otherwise(0.0).alias("llr"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    return unboxed(out, docs.columns, **counts, base_failed=failed, kept=~failed & (F.col("llr") >= threshold), llr=F.col("llr"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
