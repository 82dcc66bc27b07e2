"""Operator 6, language ID: the language whose zstandard dictionary compresses a text best."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import boxed, table, unboxed

LETTER = r"\p{L}"


def letters(text: Column) -> Column:
    """The text in lower case with each run of other characters than letters and marks as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def learn_dictionaries(rows: DataFrame, text: str, lang: str, order: list[Column], max_docs: int, dict_bytes: int, all_bytes: int) -> tuple[list[str], list[bytes]]:
    """For each language the concatenation of the letters of texts, at most max_docs of them and dict_bytes bytes.

    Every language is learned: texts are whole, and of one that alone exceeds the bytes the first words are taken. Where there are more than
    all_bytes / dict_bytes languages, each gets an even part of all_bytes. Languages come in order of their number of rows. A hash bound keeps
    about four times max_docs rows of a language before they are ranked, so no task sorts a whole language, and a
    running sum of bytes cuts them before they reach the driver.
    """
    able = rows.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER))
    counts = able.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()
    if not counts:
        return [], []
    room = min(dict_bytes, max(1024, all_bytes // len(counts)))
    first = F.substring(F.col(text), 1, room // 4)  # of a longer text its first whole words
    able = able.withColumn(text, F.when(F.octet_length(text) <= room, F.col(text)).otherwise(F.coalesce(F.nullif(F.regexp_replace(first, r"\s\S*$", ""), F.lit("")), first))).where(F.col(text).rlike(LETTER))
    fit = able.groupBy(lang).count().withColumn("_most", F.least(F.lit(1 << 31), F.expr(f"({4 * max_docs + 64}L << 31) div count"))).drop("count")
    u = F.pmod(F.xxhash64(*order), F.lit(1 << 31))
    few = able.select(lang, letters(F.col(text)).alias(text), u.alias("_u")).join(F.broadcast(fit), lang).where(F.col("_u") < F.col("_most"))
    w = W.partitionBy(lang).orderBy("_u", text)
    few = few.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_docs)
    few = few.withColumn("_sum", F.sum(F.octet_length(text) + 1).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("_sum") <= room + 1)
    found = defaultdict(list)
    for r in few.orderBy(lang, "_r").select(lang, text).toLocalIterator():
        found[r[lang]].append(r[text].encode())
    names = [r[lang] for r in counts if r[lang] in found]
    return names, [b"\n".join(found[n]) for n in names]


def compressed_sizes(body: bytes, compressors: list, piece: int) -> list[int]:
    """Bytes of the whole text under each dictionary; long texts go piece by piece, or they would teach the compressor."""
    pieces = [body[i : i + piece] for i in range(0, len(body), piece)]
    return [sum(len(c.compress(p)) for p in pieces) for c in compressors]


def language_id(docs: DataFrame, names: list[str], dicts: list[bytes], text: str = "text", level: int = 3, piece: int = 2048, min_margin: float = 0.01) -> DataFrame:
    """Add lang_pred, score, margin and rejected to docs.

    lang_pred is the language whose dictionary gives the fewest bytes for the letters of the whole text (ties: the language with more training
    rows); margin is the saving against the second best, over the second best; score is
    0.5 + min(0.5, 5 * margin); rejected is true where the margin is under min_margin. A text that is null or has
    no letter is `und`, with score 0 and rejected; so is every text if no language was learned. Repeated rows are
    predicted alike. Columns of the added names are replaced; others keep their values whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, dicts))

    @F.pandas_udf("lang string, score double, margin double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, raw = shared.value
        compressors = []
        for d in raw:
            known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            compressors.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        for batch in batches:
            out = []
            for body in batch:
                sizes = compressed_sizes(body.encode(), compressors, piece)
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=0)
                margin = (second - sizes[best]) / second if second else 0.0
                out.append((langs[best], 0.5 + min(0.5, 5 * margin), margin))
            yield pd.DataFrame(out, columns=["lang", "score", "margin"])

    readable = F.coalesce(F.col("text").rlike(LETTER), F.lit(False)) & F.lit(bool(names))
    found = boxed(docs, text=F.col(text)).withColumn("p", F.when(readable, classify(F.when(readable, letters(F.col("text"))).otherwise(""))))
    margin = F.coalesce("p.margin", F.lit(0.0))
    return unboxed(found, docs.columns, lang_pred=F.coalesce("p.lang", F.lit("und")), score=F.coalesce("p.score", F.lit(0.0)), margin=margin, rejected=margin < min_margin)


def fit_and_identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 5, max_docs: int = 64, dict_bytes: int = 112_000, all_bytes: int = 64 << 20) -> DataFrame:
    """Learn from rows outside fold 0 and predict every row of docs; see language_id.

    At most max_docs texts and dict_bytes bytes of each language are learned, and all_bytes of all languages: the
    bounds of the labelled sample that is fitted. Rows with a null id or language are predicted but not learned from.
    """
    train = docs.where(fold(F.col(doc_id), folds) != 0).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    names, dicts = learn_dictionaries(train, "text", "lang", [F.col("id"), F.col("text")], max_docs, dict_bytes, all_bytes)
    return language_id(docs.withColumn("held_out", F.coalesce(fold(F.col(doc_id), folds) == 0, F.lit(False))), names, dicts, text)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fit_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
