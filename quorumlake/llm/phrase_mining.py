"""Operator 11, phrase collocation mining: n-gram counts in weighted acyclic automata, one a shard, united by ranges of prefixes."""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, sized_join, table

#: UTF-8 bytes: A-Z in lower case, what ends a piece as a line feed, tabs as spaces. Bytes past ASCII belong to words.
PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256)).lower()
#: Bytes of whole texts of a language that make a shard, slots in one block of a filter, and the power of two of occurrences from which a word has ranges of its own.
SHARD, BLOCK, HEAVY = 24 << 20, 1 << 16, 17
#: Bytes of text for each range of prefixes.
RANGE_BYTES = 1 << 20
#: Odd multipliers that mix the hashes of two words.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

State = tuple[tuple[str, int, int], ...]


def transducer(grams: Iterable[tuple[tuple[str, ...], int]]) -> list[State]:
    """The count transducer of sorted n-grams, built incrementally: states of arcs (word, count, target), the last one is the start.

    The count on an arc is that of all n-grams that start with the words up to it. A state is frozen when the next n-gram leaves it;
    equal states are one, and all targets come before the states that lead to them. State 0 has no arcs.
    """
    states: list[State] = [()]
    known: dict[State, int] = {(): 0}
    arcs: list[list] = [[]]  # finished arcs of the states on the path of the last n-gram
    path: list[list] = []  # its words and their counts so far

    def frozen(state: State) -> int:
        if state not in known:
            known[state] = len(states)
            states.append(state)
        return known[state]

    def leave(depth: int) -> None:
        while len(path) > depth:
            word, count = path.pop()
            target = frozen(tuple(arcs.pop()))
            arcs[-1].append((word, count, target))

    for words, count in grams:
        same = 0
        while same < min(len(path), len(words)) and path[same][0] == words[same]:
            same += 1
        leave(same)
        for w in words[same:]:
            path.append([w, 0])
            arcs.append([])
        for step in path:
            step[1] += count
    leave(0)
    states.append(tuple(arcs[0]))
    return states


def unite(tree: dict, states: list[State], at: int = -1) -> None:
    """Add a transducer to a united one, which is a tree of word -> [count, tree]."""
    for word, count, target in states[at]:
        branch = tree.setdefault(word, [0, {}])
        branch[0] += count
        if target:
            unite(branch[1], states, target)


def frequent(tree: dict, least: int, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], int]]:
    """The n-grams with a count of at least `least`. What starts with a rarer one is rarer still."""
    for word, (count, branch) in tree.items():
        if count >= least:
            yield (*path, word), count
            yield from frequent(branch, least, (*path, word))


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """(lang, names, word, piece) of rows (lang, text in bytes): the distinct words and, for all word occurrences in order, their place and piece."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)

    def cut(lang: str):
        body = pa.array([b" \n ".join(held.pop(lang))], pa.large_binary())
        size.pop(lang)
        coded = pc.split_pattern(body, b" ").flatten().dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        blank = np.array([w in (b"", b"\n") for w in names], bool)
        ends = np.array([w == b"\n" for w in names], bool)
        real = ~blank[at]
        return lang, names, at[real], np.cumsum(ends[at], dtype=np.int32)[real]

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if body := text.as_py():
                held[lang].append(body.translate(PLAIN).replace(b"\n", b" \n "))
                size[lang] += len(body)
                if size[lang] >= most:
                    yield cut(lang)
    for lang in list(held):
        yield cut(lang)


def slots_of(lang: str, names: list[bytes], word: np.ndarray, piece: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter's slot of each distinct word, and of each occurrence with the next one; -1 where a piece ends between them."""
    seed, shift = zlib.crc32(lang.encode()), np.uint64(64 - bits)
    h = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in names], np.uint64)
    pairs = ((h * MIX[0])[word[:-1]] + (h * MIX[1])[word[1:]]) >> shift
    return (h >> shift).astype(np.int64), np.where(piece[:-1] == piece[1:], pairs.astype(np.int64), -1)


def slot_weights(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """For each of 2**bits slots the power of two in its number of occurrences of words and word pairs, by hash; 0 under `least`.

    Each task counts into one array and sends it by blocks; blocks are summed where they meet.
    """
    blocks = (1 << bits) // BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for lang, names, word, piece in shards(batches, SHARD):
            words, pairs = slots_of(lang, names, word, piece, bits)
            for slots in (words[word], pairs[pairs >= 0]):
                found, n = np.unique(slots, return_counts=True)
                total[found] += n.astype(np.uint32)
        sent = [(i, x) for i, x in enumerate(total.reshape(blocks, BLOCK)) if x.any()]
        small = lambda x: x.astype(np.uint8 if x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.uint32)
        packed = [zlib.compress(small(x).tobytes(), 1) for _, x in sent]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sent], pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, packed in zip(b.column(0).to_pylist(), b.column(1)):
                raw = zlib.decompress(packed.as_py())
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, f"u{len(raw) // BLOCK}").astype(np.int64)
        power = lambda x: np.where(x >= least, np.maximum(np.log2(np.maximum(x, 1)), 1), 0).astype(np.uint8)
        packed = [zlib.compress(power(x).tobytes(), 1) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["block", "weights"])

    out = np.zeros((blocks, BLOCK), np.uint8)
    for r in rows.mapInArrow(count, "block int, counts binary").repartition(blocks, "block").mapInArrow(add, "block int, weights binary").collect():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["weights"]), np.uint8)
    return out.reshape(-1)


def prefix_rows(rows: DataFrame, weight: np.ndarray, bits: int, ranges: int, longest: int) -> DataFrame:
    """(lang, range, part, n, tail): for each shard and range of first words a pickled pair: the number of occurrences of each frequent word of the
    range, and the count transducer of all windows that begin with one.

    Windows have at most `longest` words. A window ends with its piece and before a pair whose slot has no weight, as no frequent phrase goes on
    there. Ranges are by the hash of the first word. A heavy word has a range of its own, in parts by the hash of the second word, so ranges stay small; the
    numbers of words stand in the first part. The number n of all words of the shard has a row without a range.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weight)
    shape = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("tail", pa.binary())])

    def windows(word: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Sorted windows as rows of places, -1 where a window has ended."""
        runs = np.zeros(len(word), np.int8)
        for _ in range(longest - 1):
            runs[:-1] = np.where(joined, runs[1:] + 1, 0)
        starts = np.flatnonzero(runs)
        padded = np.concatenate([word, np.full(longest, -1, word.dtype)])
        out = np.stack([np.where(runs[starts] >= k, padded[starts + k], -1) for k in range(longest)], axis=1)
        return out[np.lexsort(out.T[::-1])]

    def tails(lang: str, names: list[bytes], word: np.ndarray, piece: np.ndarray) -> Iterator[tuple]:
        words, pairs = slots_of(lang, names, word, piece, bits)
        power = shared.value[words].astype(np.int64)
        times = np.bincount(word, minlength=len(names))
        often = np.flatnonzero((times > 0) & (power > 0))
        heavy = power > HEAVY
        of = np.where(heavy, -1 - words, words % ranges).tolist()
        by_range = np.array(sorted(often.tolist(), key=lambda i: (of[i], names[i])), np.int64)
        order = np.full(len(names), -1, np.int32)  # places among the shard's frequent words, by range and bytes
        order[by_range] = np.arange(len(by_range), dtype=np.int32)
        joined = (pairs >= 0) & (shared.value[np.maximum(pairs, 0)] > 0) & (order[word[:-1]] >= 0) & (order[word[1:]] >= 0)
        found = windows(order[word], joined)
        new = np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)]) if len(found) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        count, grams = np.diff(np.append(at, len(found))).tolist(), found[at].tolist()
        label = [names[i].decode() for i in by_range.tolist()]
        parts = np.where(heavy, 1 << np.maximum(power - HEAVY, 0), 1)[by_range].tolist()
        hashed, total, yet = words[by_range].tolist(), times[by_range].tolist(), 0
        yield lang, None, 0, len(word), None
        for r, group in groupby(range(len(label)), key=lambda w: of[by_range[w]]):
            known: dict[str, int] = {}
            dealt: dict[int, list] = {0: []}
            for w in group:
                known[label[w]] = total[w]
                while yet < len(grams) and grams[yet][0] == w:
                    g = grams[yet]
                    dealt.setdefault(hashed[g[1]] % parts[w], []).append((tuple(label[x] for x in g if x >= 0), count[yet]))
                    yet += 1
            for part, mine in dealt.items():
                yield lang, r, part, 0, pickle.dumps(({} if part else known, transducer(mine)), protocol=5)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, SHARD):
            rows = tails(*shard)
            while out := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    return rows.mapInArrow(build, "lang string, range long, part long, n long, tail binary")


def united(shard_rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, f): words and phrases with f >= least, and the number of words of each lang under size 0.

    The transducers of one range of prefixes (lang, range, part) meet and follow each other in a task, which unites them and holds one range at a
    time. A range has at most one row a shard.
    """
    shape = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])

    def whole(now: list, total: int, known: Counter, tree: dict) -> Iterator[tuple]:
        lang, of, _ = now
        if of is None:
            yield lang, "", 0, total
        yield from ((lang, word, 1, f) for word, f in known.items() if f >= least)
        for word, (_, branch) in tree.items():
            for words, f in frequent(branch, least, (word,)):
                yield lang, " ".join(words), len(words), f

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, total, known, tree = None, 0, Counter(), {}
            for b in batches:
                for *key, n, tail in zip(*[c.to_pylist() for c in b.columns]):
                    if key != now:
                        if now:
                            yield from whole(now, total, known, tree)
                        now, total, known, tree = key, 0, Counter(), {}
                    total += n
                    if tail is not None:
                        more, states = pickle.loads(tail)
                        known.update(more)
                        unite(tree, states)
            if now:
                yield from whole(now, total, known, tree)

        rows = found()
        while out := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)

    keys = ["lang", "range", "part"]
    return shard_rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, "lang string, phrase string, size int, f long")


def phrase_collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, most_bits: int = 25, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` best collocations of 2 to `longest` words of each language.

    A phrase lies within a piece of a text, counts a >= least times, and scores floor(1000 * a * n / (l * r)) at its weakest cut into a first
    part of count l and a rest of count r, n being all words of its language. A phrase inside a longer one that is as frequent is left out.
    Products are decimals of 38 digits, so scores are exact.

    Texts are read twice. The first time, words and word pairs are counted by hash in 2**bits slots, bits growing with the
    text up to most_bits; a slot under `least` shows that its words and pairs are rare, and hash collisions only let more through. The second
    time each shard sorts its windows of pairs that may be frequent into count transducers, one for each range of prefixes: some first words, or a part
    of the windows of a common one. The transducers of a range are united and their counts summed, and those under `least` fall away. The parts of phrases are
    looked up by sorted joins of phrases with the united counts, as each part is as frequent as its phrase. The slots decide only what is sent.
    Nulls: a null text is empty, a null lang is "und". Repeated rows count. Empty tables and languages without phrases give no rows.
    Ties in score and a go by the phrase in bytes. Other columns are not read; neither are ids.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = min(most_bits, max(16, math.ceil(math.log2(size / 64 + 1))))
    ranges = max(1, size // RANGE_BYTES)
    counts = materialise(united(prefix_rows(rows, slot_weights(rows, bits, least), bits, ranges, longest), least))
    words = F.split("phrase", " ")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    part = lambda a, b: F.array_join(F.slice(words, a, b), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"first": part(1, F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    of = lambda p, f: counts.where("size > 0").select("lang", F.col("phrase").alias(p), F.col("f").alias(f)).hint("merge")
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    cuts = sized_join(cuts, counts.where("size = 0").select("lang", F.col("f").alias("n")), ["lang"], "inner")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(top div bottom as bigint)")
    cuts = cuts.withColumns({"top": (big("a") * big("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "bottom": (big("l") * big("r")).cast("decimal(38,0)")}).withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "n", "m.score", "m.l", "m.r")
    inner = found.where("size > 2").select("lang", "a", F.explode(F.array(part(1, F.col("size") - 1), part(2, F.col("size") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer")).hint("merge")
    kept = weakest.join(inner, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(table(spark, sf_dir, "documents"))


SQL = r"""WITH pieces AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, phrase, k, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (SELECT lang, phrase, k AS size, f AS a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1)),
scored AS (SELECT c.lang, c.phrase, c.size, c.a, c.cut, x.f AS l, y.f AS r, n.n, ((1000 * c.a::HUGEINT * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN n ON n.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT w.* FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = w.lang AND x.k > w.size AND contains(' ' || x.phrase || ' ', ' ' || w.phrase || ' ') AND 100 * x.f >= 100 * w.a))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000"""
