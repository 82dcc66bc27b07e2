"""Operator 7, quality classifier: positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, table, unboxed
from .language_id import fold

GRAMS = 1024
DENSE = 9


def features(text: str) -> np.ndarray:
    """Square roots of hashed byte-trigram frequencies of the whole text, then DENSE ratios; zeros for an empty text."""
    x = np.zeros(GRAMS + DENSE, dtype=np.float32)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(raw)
    if not n:
        return x
    if n > 2:
        h = raw[:-2].astype(np.uint32)
        h *= 257
        h += raw[1:-1]
        h *= 257
        h += raw[2:]
        h *= np.uint32(2654435761)
        h >>= np.uint32(22)  # the highest 10 bits
        x[:GRAMS] = np.sqrt(np.bincount(h, minlength=GRAMS) / (n - 2))
    kinds = np.bincount(KIND[raw], minlength=5)
    ws = text.split()
    m = max(1, len(ws))
    fours = set(zip(ws, ws[1:], ws[2:], ws[3:]))
    twins = sum(map(str.__eq__, ws, ws[1:]))
    x[GRAMS:] = (*(kinds[1:5] / n), twins / m, 1 - len(fours) / max(1, len(ws) - 3), len(set(ws)) / m, np.log1p(n / m), np.log1p(m))
    return x


KIND = np.zeros(256, dtype=np.uint8)  # 1 upper case, 2 digit, 3 sentence mark, 4 other mark
for _c in range(33, 127):
    KIND[_c] = 1 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 3 if chr(_c) in ".,;:'\"-()?" else 4 if not chr(_c).isalpha() else 0


def descend(xp: np.ndarray, xu: np.ndarray, prior: float | None, seed: int = 7, epochs: int = 100, batch: int = 512, rate: float = 0.005, decay: float = 1e-2) -> np.ndarray:
    """Weights (the last is the bias) by Adam on logistic loss, averaged over the second half of the epochs.

    With a prior: prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]); a step on a batch whose
    bracket is negative goes up that bracket instead. With none: positives against unlabelled rows.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(xp.shape[1] + 1)
    m, v, mean, t, kept = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), 0, 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    add = lambda x, c: np.append(c.astype(np.float32) @ x, c.sum())
    for epoch in range(epochs):
        for _ in range(max(1, (len(xp) + len(xu)) // (2 * batch))):
            p, u = xp[rng.integers(len(xp), size=batch)], xu[rng.integers(len(xu), size=batch)]
            w32 = w[:-1].astype(np.float32)
            gp, gu = (p @ w32).astype(float) + w[-1], (u @ w32).astype(float) + w[-1]
            up, down_p, down_u = -sigmoid(-gp) / batch, sigmoid(gp) / batch, sigmoid(gu) / batch
            if prior is None:
                g = add(p, up) + add(u, down_u)
            else:
                bracket = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                rest = add(u, down_u) - prior * add(p, down_p)
                g = prior * add(p, up) + rest if bracket >= 0 else -rest
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            if epoch >= epochs // 2:
                kept += 1
                mean += (w - mean) / kept
    return mean


def tails(counts: np.ndarray) -> np.ndarray:
    """Share of a histogram in each bin and those above it."""
    return counts[::-1].cumsum()[::-1] / max(1, counts.sum())


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among unlabelled rows, from two histograms over the same bins of a score.

    The least ratio of the tails above a score, with a confidence term (best bin).
    """
    qp, qu = tails(p), tails(u)
    slack = np.sqrt(np.log(20) / (2 * max(1, u.sum()))) + np.sqrt(np.log(20) / (2 * max(1, p.sum())))
    able = qp > 0.05
    best = np.argmin((qu[able] + slack) / qp[able])
    return float(np.clip(qu[able][best] / qp[able][best], 0.05, 0.99))


#: Bins of a raw score between -CLIP and CLIP.
BINS, CLIP = 4096, 30.0


def bins_of(z: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, ((np.clip(z, -CLIP, CLIP) + CLIP) * (BINS / (2 * CLIP))).astype(np.int64))


def scaling(xp: np.ndarray, xu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of all rows, which are scaled in place."""
    n = len(xp) + len(xu)
    mean = (xp.sum(0, dtype=np.float64) + xu.sum(0, dtype=np.float64)) / n
    square = (np.einsum("nd,nd->d", xp, xp, dtype=np.float64) + np.einsum("nd,nd->d", xu, xu, dtype=np.float64)) / n
    std = np.sqrt(np.maximum(square - mean**2, 0)) + 1e-3
    for x in (xp, xu):
        x -= mean.astype(np.float32)
        x /= std.astype(np.float32)
    return mean, std


def fit(xp: np.ndarray, xu: np.ndarray, count) -> dict:
    """Class prior and weights from positive and unlabelled feature rows.

    A first model of positives against unlabelled rows is fitted to every second row. Its scores of the other positives, and
    of all rows of the corpus, which count(w, b) gives as a histogram by bins_of, yield the prior; then the risk is minimised.
    """
    mean, std = scaling(xp, xu)
    raw = lambda w: (w[:-1] / std, w[-1] - float((mean / std) @ w[:-1]))
    half = descend(xp[::2], xu[::2], None)
    mine = np.bincount(bins_of(xp[1::2] @ half[:-1] + half[-1]), minlength=BINS)
    prior = estimate_prior(mine, count(*raw(half)))
    w, b = raw(descend(xp, xu, prior))
    return {"prior": prior, "w": w, "b": b}


def learn_quality(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, folds: int, max_positive: int, max_unlabelled: int) -> dict | None:
    """Fit on at most max_positive trusted rows and max_unlabelled rows whose labels are not looked at, one row an id; None without
    positives. The class prior comes from the scores of all rows outside fold 1."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(fold(F.col("id"), folds) != 1)
    first = lambda df, n: df.distinct().orderBy(F.xxhash64("id", F.lit(7)), "id").limit(n)
    good = labels.select(F.col("doc_id").alias("id"), "quality").where((fold(F.col("id"), folds) != 1) & (F.col("quality") == 1)).drop("quality")
    wanted = first(good, max_positive).withColumn("p", F.lit(1)).union(first(rows.select("id"), max_unlabelled).withColumn("p", F.lit(0)))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": b["p"], "x": [features(s).tobytes() for s in b["text"]]})

    def count(w: np.ndarray, c: float) -> np.ndarray:
        @F.pandas_udf("long")
        def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series([int(bins_of(features(s) @ w + c)) for s in b], dtype="int64")

        out = np.zeros(BINS)
        for r in rows.select(place("text").alias("bin")).groupBy("bin").count().collect():
            out[r["bin"]] = r["count"]
        return out

    texts = rows.join(F.broadcast(wanted), "id").groupBy("id", "p").agg(F.min("text").alias("text")).orderBy("id", "p").select("p", "text")
    got = texts.mapInPandas(encode, "p int, x binary").toPandas()
    p = got["p"].to_numpy() == 1
    xp, xu = np.empty((p.sum(), GRAMS + DENSE), np.float32), np.empty(((~p).sum(), GRAMS + DENSE), np.float32)
    for x, part in ((xp, got["x"][p]), (xu, got["x"][~p])):
        for i, raw in enumerate(part):
            x[i] = np.frombuffer(raw, dtype=np.float32)
    del got
    return fit(xp, xu, count) if len(xp) > 1 and len(xu) > 1 else None


def quality_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 3, max_positive: int = 4000, max_unlabelled: int = 8000) -> DataFrame:
    """Add held_out, score and predicted to docs; labels of fold 1 are not read.

    The model is linear in features(text) of the whole text. Its risk is minimised on a sample: max_positive trusted rows and
    max_unlabelled other rows of the training folds, by hash order; the class prior is counted over all of their rows.
    A null text counts as empty. Without two trusted positives every score is 0.5. Rows with a null doc_id are scored and
    never learned from; repeated rows are scored alike, and of rows that share an id the least text is learned from. Columns
    of the added names are replaced; others keep their values whatever their names.
    """
    model = learn_quality(docs, labels, text, doc_id, folds, max_positive, max_unlabelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for b in batches:
            if m is None:
                yield pd.Series([0.5] * len(b))
            else:
                yield pd.Series([float(1 / (1 + np.exp(-np.clip(features(s) @ m["w"] + m["b"], -30, 30)))) for s in b], dtype=float)

    held = F.coalesce(fold(F.col("id"), folds) == 1, F.lit(False))
    out = boxed(docs, id=F.col(doc_id), text=F.coalesce(F.col(text), F.lit(""))).select("row", held.alias("held_out"), rate("text").alias("score"))
    return unboxed(out, docs.columns, held_out=F.col("held_out"), score=F.col("score"), predicted=(F.col("score") >= 0.5).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
