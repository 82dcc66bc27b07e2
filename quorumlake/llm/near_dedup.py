"""Operator 5, MinHash near-dedup: SetSketch registers, banded; likelihood estimates; exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, components, materialise, table, unboxed

WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Base of the register scale: neighbouring register values stand for minima that differ by this factor.
BASE = 1.02
SHIFT, TOP = 160, 1400
#: Log-likelihood by which a similarity of 0.75 may fall short of the best one before a pair is given up.
SLACK = 12.0
#: Members of a star, or of a side of a bucket, that one task compares with each other.
STAR, CHUNK = 256, 1024
#: Bytes of shingle sets that one side may hold; longer texts are cut into more chunks.
CHUNK_BYTES = 64 << 20

_rng = np.random.default_rng(5)
_A = (_rng.integers(1 << 31, size=REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_C = (_rng.integers(1 << 31, size=REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def split_words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z in lower case."""
    return [] if text is None else text.encode().lower().split()


def shingle_set(ws: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence, if it is shorter."""
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    if len(ws) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    s = h[: len(h) - WORDS + 1].copy()
    for k in range(1, WORDS):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
        s += h[k : len(h) - WORDS + 1 + k]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s)


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers: floor(1 - log_BASE(least exponential variate)), truncated to 0 .. TOP."""
    x = ((s ^ (s >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 512):
        y = x[i : i + 512, None] * _A
        y ^= y >> np.uint32(15)
        y *= _C
        y ^= y >> np.uint32(16)
        np.minimum(low, y.min(0), out=low)
    e = -np.log1p(-(low.astype(np.float64) + 0.5) / 4294967296.0)
    return np.clip(np.floor(1 - np.log(e) / math.log(BASE)) + SHIFT, 0, TOP).astype(np.uint16)


def may_link(n1: np.ndarray, k1: np.ndarray, n2: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a similarity of 0.75 is likely enough, and the likeliest similarity.

    The joint likelihood of the counts of greater, smaller and equal registers, given both set sizes, over a
    grid of similarities up to the largest that the sizes allow.
    """
    more, less = (k1 > k2).sum(1)[:, None], (k1 < k2).sum(1)[:, None]
    same = k1.shape[1] - more - less
    u = (n1 / (n1 + n2))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    floor = PERCENT / 100
    grid = np.concatenate([np.linspace(0, floor, 31)[:-1], np.linspace(floor, 1, 21)])[None, :]
    j = np.minimum(grid, top)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    like = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-9, 1))
    able = 100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)
    return able & (like[:, 30:].max(1) >= like.max(1) - SLACK), j[np.arange(len(j)), like.argmax(1)]


def sketches(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, body (hash of the text), cls (hash of the word sequence), n (set size) and regs of every row."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                ws = split_words(t)
                s = shingle_set(ws)
                out.append((xxhash.xxh3_128_hexdigest(b" ".join(ws)), len(s), registers(s).tobytes() if len(s) else b""))
            cls, n, regs = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "body": b["body"], "cls": cls, "n": np.array(n, dtype=np.int64), "regs": regs})

    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    return named.mapInPandas(emit, "doc_id long, body long, cls string, n long, regs binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(band, key, rid, n): the register values of each band, packed, and the set size."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = np.frombuffer(b"".join(b["regs"]), dtype=np.int64).reshape(len(b), BANDS)
            yield pd.DataFrame({"band": np.tile(np.arange(BANDS, dtype=np.int16), len(b)), "key": keys.ravel(), "rid": np.repeat(b["rid"].to_numpy(), BANDS), "n": np.repeat(b["n"].to_numpy(), BANDS)})

    return reps.select("rid", "n", "regs").mapInPandas(emit, "band short, key long, rid long, n long")


def likely(n1: pd.Series, r1: pd.Series, n2: pd.Series, r2: pd.Series) -> pd.Series:
    """The likeliest similarity of a pair, or null where 0.75 is out of reach."""
    load = lambda r: np.frombuffer(b"".join(r), dtype=np.uint16).reshape(len(r), REGISTERS)
    if not len(n1):
        return pd.Series([], dtype=float)
    ok, j = may_link(n1.to_numpy(), load(r1), n2.to_numpy(), load(r2))
    return pd.Series(np.where(ok, j, np.nan)).where(ok, None)


def estimate(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) that may link, with the estimate j."""
    left = reps.select(F.col("rid").alias("a"), F.col("n").alias("n1"), F.col("regs").alias("r1"))
    right = reps.select(F.col("rid").alias("b"), F.col("n").alias("n2"), F.col("regs").alias("r2"))
    rate = F.pandas_udf(likely, "double")
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", rate("n1", "r1", "n2", "r2").alias("j")).where(F.col("j").isNotNull() & ~F.isnan("j"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(rid, set): the full shingle sets, as sorted hashes, of the wanted texts (rid, id, body)."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rid": b["rid"], "set": [shingle_set(split_words(t)).tobytes() for t in b["text"]]})

    named = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_body"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    found = named.join(wanted.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_body") == F.col("body")))
    return found.groupBy("rid").agg(F.min("text").alias("text")).mapInPandas(emit, "rid long, set binary")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach PERCENT.

    Each a is sent once to every group of about STAR of its partners, and each partner once a pair.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, None
        for batch in batches:
            a, b = [], []
            for h, m, raw in zip(batch["a"], batch["b"], batch["set"]):
                s = np.frombuffer(raw, dtype=np.uint64)
                if h == m:
                    hub, own = h, s
                elif h == hub and linked(own, s):
                    a.append(h)
                    b.append(m)
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    pairs = pairs.select("a", "b")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("_s"))
    salted = pairs.join(sizes.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_s")).alias("salt"))
    hubs = salted.select("a", F.col("a").alias("b"), "salt").distinct()
    rows = salted.unionByName(hubs).join(sets.withColumnRenamed("rid", "b").hint("merge"), "b")
    rows = rows.select("a", "salt", (F.col("a") != F.col("b")).alias("member"), "b", "set").repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "b")
    return rows.select("a", "b", "set").mapInPandas(emit, "a long, b long")


def within_buckets(rest: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components of a bucket, chunk against chunk.

    A pair is looked at in the first band that it shares; if the likelihood leaves it open, it is verified on full sets.
    Components that a task has joined are one from then on, so it gives fewer links than it sees components.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for b in batches:
            b = b if left is None else pd.concat([left, b], ignore_index=True)
            g = b[["band", "key", "lo", "hi"]].to_numpy()
            cut = np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1
            at = cut[-1] if len(cut) else 0
            left = b.iloc[at:].reset_index(drop=True)
            if at:
                yield links(b.iloc[:at].reset_index(drop=True))
        if left is not None and len(left):
            yield links(left)

    def links(d: pd.DataFrame) -> pd.DataFrame:
        g = d[["band", "key", "lo", "hi"]].to_numpy()
        group = np.concatenate([[0], np.cumsum((g[1:] != g[:-1]).any(1))])
        k = np.frombuffer(b"".join(d["regs"]), dtype=np.uint16).reshape(len(d), REGISTERS)
        keys = k.view(np.int64)
        rid, comp, n, side, band = (d[c].to_numpy() for c in ("rid", "comp", "n", "side", "band"))
        cross = (d["lo"] != d["hi"]).to_numpy()
        found = []
        for gap in range(1, np.bincount(group).max()):
            i = np.flatnonzero((group[:-gap] == group[gap:]) & (comp[:-gap] != comp[gap:]))
            i = i[~cross[i] | (side[i] != side[i + gap])]
            for part in (i[s : s + 4096] for s in range(0, len(i), 4096)):
                part = part[(keys[part] == keys[part + gap]).argmax(1) == band[part]]
                if len(part):
                    ok, j = may_link(n[part], k[part], n[part + gap], k[part + gap])
                    found.append(np.stack([part[ok], part[ok] + gap, (1e9 * j[ok]).astype(np.int64)]))
        a, b, up = [], [], {}

        def top(c):
            while up.get(c, c) != c:
                up[c] = c = up.get(up[c], up[c])
            return c

        if found:
            x, y, j = np.concatenate(found, 1)
            for p in np.argsort(-j, kind="stable"):
                u, v = int(x[p]), int(y[p])
                cu, cv = top(comp[u]), top(comp[v])
                if cu != cv and linked(np.frombuffer(d["set"].iat[u], dtype=np.uint64), np.frombuffer(d["set"].iat[v], dtype=np.uint64)):
                    up[cu] = cv
                    a.append(rid[u])
                    b.append(rid[v])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    chunks = F.ceil(F.greatest(F.col("size") / CHUNK, F.col("held") * 8 / CHUNK_BYTES)).cast("int")
    cut = rest.withColumn("side", F.pmod(F.xxhash64("rid"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cut = cut.select("band", "key", F.least("side", "o").alias("lo"), F.greatest("side", "o").alias("hi"), "side", "rid", "comp")
    known = reps.select("rid", "n", "regs").join(sets.hint("merge"), "rid")
    rows = cut.join(known.hint("merge"), "rid").repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi", "rid")
    return rows.mapInPandas(emit, "a long, b long")


def link(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, body, n_shingles, component_id, lead, first) for every row of docs; see near_dedup.

    The nodes are the word sequences, named by a hash, so texts that share an id or have none are told apart. The row that
    stands for a component has its least (id, word sequence, text), null ids last: `lead` marks the rows with its words, and
    `first` those with its id and text too. Rows without words are all both.
    """
    rows = materialise(sketches(docs, text, doc_id))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min(place).alias("p"), F.min("n").alias("n"), F.min("regs").alias("regs"))
    reps = materialise(classes.select("cls", F.xxhash64("cls").alias("rid"), F.col("p.doc_id").alias("id"), F.col("p.body").alias("body"), "n", "regs"))
    bands = band_rows(reps)
    hubs = bands.groupBy("band", "key").agg(F.min("rid").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = materialise(bands.join(hubs.hint("merge"), ["band", "key"]))
    wanted = reps.select("rid", "id", "body").join(members.select("rid").distinct().hint("merge"), "rid", "left_semi")
    sets = materialise(shingle_sets(docs, wanted, text, doc_id))

    shared = members.where("rid <> hub").groupBy("rid", "hub").agg(F.count("*").alias("bands"))
    best = shared.groupBy(F.col("rid").alias("b")).agg(F.max_by("hub", F.struct("bands", -F.col("hub"))).alias("a"))
    links = materialise(verify(estimate(best, reps), sets))
    comp = components(links)

    label = members.join(comp.select(F.col("node").alias("rid"), F.col("root").alias("comp")).hint("merge"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    label = materialise(label.select("band", "key", "rid", "n", "comp"))
    mixed = label.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size"), F.sum("n").alias("held")).where("x <> y")
    rest = label.drop("n").join(mixed.select("band", "key", "size", "held").hint("merge"), ["band", "key"])
    comp = components(links.unionByName(materialise(within_buckets(rest, reps, sets))))

    roots = reps.select("cls", "rid", "id", "body").join(comp.withColumnRenamed("node", "rid").hint("merge"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    roots = materialise(roots.drop("rid"))
    least = roots.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "cls", "body")).alias("p"))
    roots = roots.drop("id", "body").join(least.hint("merge"), "root").select("cls", "p.id", F.col("p.body").alias("at"), (F.col("cls") == F.col("p.cls")).alias("lead"))
    out = rows.select("doc_id", "body", "cls", F.col("n").alias("n_shingles")).join(roots.hint("merge"), "cls", "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "body", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col("id"))).alias("component_id"),
        (alone | F.col("lead")).alias("lead"),
        (alone | (F.col("lead") & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("at")))).alias("first"),
    )


def near_unique(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of docs for each group of near duplicates, and for each distinct (id, text) without words.

    The row is that of the least (id, word sequence, text), null ids last: a text without an id stays where it duplicates
    nothing that has one, and different texts of one id all stay.
    """
    rows = link(docs, text, doc_id).where("first")
    marks = materialise(rows.groupBy(F.col("doc_id").alias("one"), F.col("body").alias("of")).agg(F.count("*").alias("n")))
    keyed = boxed(docs, id=F.col(doc_id).cast("long"), body=F.xxhash64(text))
    same = F.col("id").eqNullSafe(F.col("one")) & (F.col("body") == F.col("of"))
    many = marks.where("n > 1")  # only repeated rows are dealt out once more
    many = F.broadcast(many) if many.limit(200_001).count() <= 200_000 else many.hint("merge")
    out = keyed.join(marks.where("n = 1").hint("merge"), same, "left_semi")
    return unboxed(out.unionByName(keyed.join(many, same, "left_semi").dropDuplicates(["id", "body"])), docs.columns)


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add n_shingles, component_id and kept to docs.

    Documents link when the sets of their 5-word shingles share 75 % of the union or more. Documents with the
    same words are one node. Candidates share a band of SetSketch registers (a pair at 0.75 is missed with a
    chance of about 2e-7); each is verified against one hub, and where a bucket still holds several
    components, its pairs across components are estimated and verified in it, so a group of n copies costs about n
    comparisons, and no link between components is left untested. Links are confirmed on full sets.
    Nulls and texts without words: n_shingles 0, linked with nothing. A row with a null doc_id has a null
    component and is not kept, but is linked like others; near_unique keeps it where it duplicates nothing. Different
    texts that share a doc_id are nodes of their own; component_id is the least id of a component, and all rows of that id in it are kept (near_unique keeps one). Repeated rows are marked
    alike. An empty table gives no rows. Columns of the added names are replaced; others keep their values.
    """
    marks = link(docs, text, doc_id).groupBy(F.col("doc_id").alias("one"), F.col("body").alias("of")).agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    keyed = boxed(docs, id=F.col(doc_id).cast("long"), body=F.xxhash64(text))
    out = keyed.join(marks.hint("merge"), F.col("id").eqNullSafe(F.col("one")) & (F.col("body") == F.col("of")), "left")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return unboxed(out, docs.columns, n_shingles=F.col("n_shingles"), component_id=F.col("component_id"), kept=kept)


def op5_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
