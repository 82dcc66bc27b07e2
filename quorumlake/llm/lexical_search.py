"""Operator 13, ranked lexical search: one automaton of all item terms reads the term frequencies off each text."""

from __future__ import annotations

import math
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term is a run of digits, ASCII letters and characters past ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes: what is no part of a term becomes a space, and A-Z lower case. All bytes past ASCII belong to terms.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: Column) -> Column:
    """The terms of a text in order; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


@lru_cache(maxsize=1)
def _automaton(terms: tuple[bytes, ...]) -> ahocorasick.Automaton:
    """Matches ` term ` for each term, so that a match is always a whole term; its value is the term's place."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        out.add_word(f" {t.decode('latin-1')} ", i)
    out.make_automaton()
    return out


def term_counts(docs: DataFrame, text: str, doc_id: str, terms: list[str]) -> DataFrame:
    """(doc_id, n, t, c) of each text with a term: its number of terms, the places of item terms in it, and their counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tuple(t.encode() for t in terms))
    shape = pa.schema([("n", pa.int64()), ("t", pa.list_(pa.int32())), ("c", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            find, keep, n, t, c = _automaton(shared.value), [], [], [], []
            for i, body in enumerate(b.column(1)):
                body = (body.as_py() or b"").translate(PLAIN)
                if not (size := len(body.split())):
                    continue
                hits = np.fromiter((v for _, v in find.iter(f" {body.decode('latin-1')} ")), dtype=np.int32)
                places, counts = np.unique(hits, return_counts=True)
                keep.append(i), n.append(size), t.append(places), c.append(counts.astype(np.int32))
            kinds = [shape.field(k).type for k in ("n", "t", "c")]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *[pa.array(x, k) for x, k in zip((n, t, c), kinds)]], ["doc_id", "n", "t", "c"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, t array<int>, c array<int>")


def best_in_parts(counts: DataFrame, ptr: np.ndarray, item: np.ndarray, weight: np.ndarray, items: int, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each partition of term_counts, scores in whole numbers.

    Term t belongs to item[ptr[t]:ptr[t + 1]], with its weight times its repeats there.
    """
    kind = counts.schema["doc_id"].dataType.simpleString()
    shared = counts.sparkSession.sparkContext.broadcast((ptr, item, weight))

    def score(n: int, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        ptr, item, weight = shared.value
        m = 25 + 75 * n * total // length
        x = 1_000_000_000 * c // (1000 * c + 8 * m)
        many = ptr[t + 1] - ptr[t]
        at = np.repeat(ptr[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out = np.zeros(items, np.int64)
        np.add.at(out, item[at], weight[at] * np.repeat(x, many))
        return out

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = defaultdict(list)  # item -> (-score, no id, id), k at most
        least = np.ones(items, np.int64)
        id_type = None
        for b in batches:
            ids, id_type = b.column(0).to_pylist(), b.column(0).type
            for i, n in enumerate(b.column(1).to_pylist()):
                t, c = b.column(2)[i].values, b.column(3)[i].values
                if not len(t):
                    continue
                scores = score(n, t.to_numpy(), c.to_numpy().astype(np.int64))
                for j in np.flatnonzero(scores >= least).tolist():
                    insort(best[j], (-int(scores[j]), ids[i] is None, ids[i]))
                    if len(best[j]) > k:
                        best[j].pop()
                    if len(best[j]) == k:
                        least[j] = -best[j][-1][0]
        rows = [(j, i, -s) for j, found in best.items() for s, _, i in found]
        if rows:
            js, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(js, pa.int32()), pa.array(ids, id_type), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return counts.mapInArrow(rank, f"item int, doc_id {kind}, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 8 << 20, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the highest scores above 0, best first.

    A score is a sum over the item's terms (repeats count) of the term's weight, from its document frequency, times its saturated
    and length-normalised frequency in the document; all in 64-bit whole numbers but for the logarithm. Equal scores go by ascending doc_id.

    The items are cut into blocks of about block_bytes of terms (at least an item each); a block's terms make one automaton,
    which is broadcast and counts them in one pass over all whole texts. No index of the documents is made. Counts of a
    document's item terms are written to the shared folder and scored there; each task keeps k rows an item, and
    the last ranking goes over two levels of them.
    Nulls: a null or termless text is no document. A null doc_id comes after all others in a tie. Rows with the same
    item_id, null too, are one item with the terms of all its distinct texts; an item without terms has no rows. Repeated
    documents each have a rank. No documents or no items: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    long = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct().select("item_id", F.explode(terms_of(F.col("text"))).alias("term"))
    pairs = materialise(long.groupBy("item_id", "term").agg(F.count("*").alias("times")))
    size = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    ranked_rows, kind = [], docs.schema[doc_id].dataType.simpleString()
    for block in range(blocks if size else 0):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("term", "item_id").collect()
        terms = sorted({r["term"] for r in mine})
        if not terms:
            continue
        names = list(dict.fromkeys(r["item_id"] for r in mine))
        counts = materialise(term_counts(docs, text, doc_id, terms))
        total, length = counts.agg(F.count("*"), F.sum("n")).first()
        if not total:
            continue
        df = {r["t"]: r["count"] for r in counts.select(F.explode("t").alias("t")).groupBy("t").count().collect()}
        w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(i, 0) + 1))) for i, t in enumerate(terms)}
        place, number = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(names)}
        of = sorted((place[r["term"]], number[r["item_id"]], w[r["term"]] * r["times"]) for r in mine)
        ptr = np.searchsorted(np.array([x[0] for x in of]), np.arange(len(terms) + 1))
        best = best_in_parts(counts, ptr, np.array([x[1] for x in of], np.int32), np.array([x[2] for x in of], np.int64), len(names), total, length, k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        best = best.withColumn("part", F.spark_partition_id() % 64)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        known = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {items.schema[item_id].dataType.simpleString()}")
        ranked_rows.append(best.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score"))
    if not ranked_rows:
        return spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {kind}, score long")
    out = ranked_rows[0]
    for more in ranked_rows[1:]:
        out = out.unionByName(more)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""WITH docs AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
sizes AS (SELECT doc_id, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0),
totals AS (SELECT count(*)::HUGEINT AS big_n, sum(n)::HUGEINT AS big_l FROM sizes),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
items AS (SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL),
places AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM places WHERE rank <= 10"""
