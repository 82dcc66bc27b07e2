"""Operator 12, best-fit packing: pieces of texts share sequences under capacities of tokens, documents and attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ranked, table

#: White space in Unicode other than space and line feed.
OTHER_SPACE = [chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Words that a Python worker remembers, and words that are encoded in one call.
KNOWN, CALL = 1_500_000, 50_000


def plainly_spaced(text: str) -> bool:
    """White space is single spaces and line feeds between other characters, so byte-level pre-tokenisation cuts before each space."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(pair in text for pair in ("  ", " \n", "\n ", "\n\n")) and not any(c in text for c in OTHER_SPACE)


class Encoder:
    """Ids of whole texts. Plainly spaced ones are cut before spaces, and the ids of each distinct word are found once and remembered."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each token: one character of its name for each
        for name, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(name)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # word -> its place in start and size
        self.start, self.size, self.store = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def learn(self, new: list[str]) -> None:
        """Encode new words, each with the space before it. They are encoded as one text, whose ids are dealt to the words by bytes."""
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            last = np.searchsorted(np.cumsum(self.sizes[ids]), ends)  # the last token of each word
            if (np.cumsum(self.sizes[ids])[last] != ends).any():
                raise AssertionError("a token spans two words")
            first = np.concatenate([[0], last[:-1] + 1])
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
            self.start = np.concatenate([self.start, first + len(self.store)])
            self.size = np.concatenate([self.size, last + 1 - first])
            self.store = np.concatenate([self.store, ids])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of plainly spaced texts: of the first word of each, then those of its further words in order."""
        cut = pc.split_pattern(texts, " ", max_splits=1)
        firsts = self.whole(pc.list_element(cut, 0).to_pylist())
        more = pc.split_pattern(pc.if_else(pc.greater(pc.list_value_length(cut), 1), pc.list_slice(cut, 1, 2), pa.scalar([], cut.type)).flatten(), " ")
        coded = more.flatten().dictionary_encode()
        if len(self.number) > KNOWN:
            self.forget()
        names = coded.dictionary.to_pylist()
        self.learn([w for w in names if w not in self.number])
        word = np.array([self.number[w] for w in names], np.int64)[coded.indices.to_numpy()]
        size = self.size[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.store[np.repeat(self.start[word] - ends[:-1], size) + np.arange(ends[-1])]
        edges = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(more).to_numpy())])] if len(more) else [0]
        rest, out = iter(zip(edges, edges[1:])), []
        for first, n in zip(firsts, pc.list_value_length(cut).to_pylist()):
            a, b = next(rest) if n > 1 else (0, 0)
            out.append(np.concatenate([first, ids[a:b]]))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = [plainly_spaced(t) for t in texts]
        found = iter(self.plain(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string())))
        others = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        return [next(found if p else others) for p in plain]


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str) -> Encoder:
    return Encoder(tokenizer_file)


def pieces_of(docs: DataFrame, tokenizer_file: str, most: int, end: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and one id `end`, cut into pieces of `most` after a first one with the rest."""
    shape = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows = [], []
            for at in range(0, len(b), 4096):  # so many whole texts at a time
                texts = [t or "" for t in b.column(1).slice(at, 4096).to_pylist()]
                for i, ids in enumerate(_encoder(tokenizer_file).ids(texts), at):
                    body = np.append(ids, end).astype("<u4").tobytes()
                    n = len(body) // 4
                    edges = [0, *range(n % most or most, n + 1, most)]
                    for p, (x, y) in enumerate(zip(edges, edges[1:])):
                        of.append(i), rows.append((p, x, y - x, zlib.crc32(body[4 * x : 4 * y])))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), shape)] if rows else [pa.array([], f.type) for f in shape]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *columns], ["doc_id", *shape.names])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the pieces of each length go, and the number of sequences: rows (length, first, end, sequence, offset).

    Pieces first .. end - 1 of a length go to consecutive sequences from `sequence` on, at that offset. counts: pieces by length. A piece takes (length, 1, length squared) of
    the capacities of tokens, documents and attention cost. Pieces go in order of falling length, each to an open sequence in which
    it fits under all three: "norm" takes the one with the least weighted norm of what would be left of it, "dot" the one
    with the largest weighted dot product of the piece and what is left; shares of the capacities are compared. All sequences with the same
    residuals as that one take a piece of this length each, while there are any, before sequences are compared again. A new one is
    opened for each piece left where none fits.

    Sequences with the same residuals are one state, kept as runs of numbers, so the work depends on the lengths and not
    on the pieces: an added length makes at most two more runs, one by opening and one by splitting.
    """
    full, w = np.array(capacity, np.int64), np.array(weights) / np.square(np.array(capacity, float))
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    left = np.empty((0, 3), np.int64)
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        need, todo, first = np.array([length, 1, length * length]), counts[length], 0
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                rest = left[fits]
                best = ((rest - need) ** 2 @ w).argmin() if rule == "norm" else (rest * need @ w).argmax()
                state = tuple(left[fits[best]].tolist())
                runs = states.pop(state)
                left = np.delete(left, fits[best], axis=0)
            else:
                state, runs = capacity, [(opened, opened + todo)]
                opened += todo
            taken = []
            while runs and todo:
                a, b = runs.pop()
                n = min(todo, b - a)
                plan.append((length, first, first + n, a, capacity[0] - state[0]))
                taken.append((a, a + n))
                todo, first = todo - n, first + n
                if a + n < b:
                    runs.append((a + n, b))
            for key, found in ((state, runs), (tuple((np.array(state) - need).tolist()), taken)):
                if found and key not in states:
                    states[key] = found
                    left = np.vstack([left, key])
                elif found:
                    states[key] += found
    return plan, opened


def vector_pack(docs: DataFrame, tokenizer_file: str, capacity: tuple[int, int, int] = (2048, 2048, 2048 * 2048), weights: tuple[float, float, float] | None = None, rule: str | None = None, end: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each whole text lies.

    capacity: tokens, documents (pieces) and attention cost (sum of squared piece lengths) of a sequence; the defaults of the last
    two never bind. A text is its ids and the id `end`. Only texts longer than the tokens of a sequence are cut, into pieces
    of that length and, first, one with the rest. Where the attention cost allows no piece of that length, texts are cut at the longest
    piece that fits. Without weights or a rule, several are tried on the histogram of lengths and the plan with the fewest sequences is taken.

    The histogram (a row a length, at most capacity[0]) is all the driver sees. The plan names pieces by their rank among those of the same
    length, which is found in parts where a length is common; it has at most 2 * capacity[0] runs of sequences with as many
    steps as a sequence holds pieces, and is broadcast. Offsets in a sequence are gapless, sequence numbers too.
    Nulls: a null or empty text is one piece, the id `end`. Rows with a null doc_id and repeated rows are packed like others; rows equal in all
    columns of the result but the last two are interchangeable. No rows: no result rows. Other columns are not read.
    tokenizer_file is a path that every executor sees; strings of its special tokens in a text become those tokens.
    """
    most = min(capacity[0], int(capacity[2] ** 0.5))
    rows = materialise(pieces_of(docs, tokenizer_file, most, end, text, doc_id))
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    tries = product([weights] if weights else [(1.0, 0.0, 0.0), (1.0, 0.1, 0.1), (1.0, 1.0, 1.0)], [rule] if rule else ["norm", "dot"])
    plan, _ = min((best_fit(counts, capacity, w, r) for w, r in tries), key=lambda x: x[1])
    steps: dict[int, list] = {}
    for length, *step in plan:
        steps.setdefault(length, []).append(step)
    shared = docs.sparkSession.sparkContext.broadcast({length: np.array(s, np.int64).T for length, s in steps.items()})
    numbered = ranked(rows, ["length"], [F.col("doc_id"), F.col("ids_crc32"), F.col("piece")], "rank", group=["length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for x in np.unique(length):
                first, _, base, used = shared.value[int(x)]
                mine = length == x
                step = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = base[step] + rank[mine] - first[step], used[step]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select(*names, "rank").mapInArrow(place, shape)


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return vector_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
