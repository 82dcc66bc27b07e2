"""Best-fit packing: exact round trips of ids, capacities, and the plan against packing piece by piece."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quorumlake.llm import vector_packing as VP

from .test_llm import docs_of

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def check(got, docs, tokenizer, capacity=(2048, 2048, 2048 * 2048), end=0):
    """Every id of every document lies in one piece; sequences are gapless and within all capacities. Gives the number of sequences."""
    most, want = min(capacity[0], int(capacity[2] ** 0.5)), Counter()
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        edges = [0, *range(len(ids) % most or most, len(ids) + 1, most)]
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity[0] and len(parts) <= capacity[1] and sum(n * n for _, n in parts) <= capacity[2]
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def test_whole_table(spark, sf_dir, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = VP.op12_vector_packing(spark, sf_dir).collect()
    n = check(got, docs, tokenizer)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 2048) + 1


def test_odd_rows_and_clashing_names(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "no id"), (None, None), (3, "the same"), (3, "the same"), (4, "word " * 9000 + "\n\n end "), (5, " \t"), (6, "中文 é <|endoftext|> x"), (7, "a\nb c d"), *[(i, "short one") for i in range(100, 400)]]
    df = docs_of(spark, [(i, t, "en", "a") for i, t in rows]).selectExpr("*", "1 as piece", "2 as start", "3 as length", "4 as rank", "5 as body", "6 as sequence_id")
    check(VP.vector_pack(df.repartition(3), FILE).collect(), rows, tokenizer)
    assert VP.vector_pack(df.limit(0), FILE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(64, 3, 4096), (64, 64, 900), (50, 4, 1200)])
def test_every_capacity_holds(spark, tokenizer, rule, capacity):
    random.seed(5)
    rows = [(i, "word " * random.randint(0, 90)) for i in range(150)]
    got = VP.vector_pack(docs_of(spark, [(i, t, "en", "a") for i, t in rows]), FILE, capacity=capacity, rule=rule, end=7).collect()
    check(got, rows, tokenizer, capacity, end=7)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_equals_packing_piece_by_piece(rule):
    """The states of sequences give as many sequences as choosing one for each single piece by the rule."""
    random.seed(3)
    for capacity, weights in [((100, 100, 10_000), (1.0, 0.0, 0.0)), ((100, 4, 10_000), (1.0, 0.5, 0.2)), ((100, 9, 4000), (1.0, 1.0, 1.0))]:
        counts = Counter(min(random.randint(1, 70), int(capacity[2] ** 0.5)) for _ in range(400))
        plan, opened = VP.best_fit(counts, capacity, weights, rule)
        fill = defaultdict(list)
        for length, first, end, base, offset in plan:
            for k in range(end - first):
                assert sum(fill[base + k]) == offset
                fill[base + k].append(length)
        assert len(fill) == opened and Counter(x for xs in fill.values() for x in xs) == counts
        w, left, todo = np.array(weights) / np.square(np.array(capacity, float)), [], Counter(counts)
        for length in sorted(todo, reverse=True):
            need = np.array([length, 1, length * length])
            score = lambda r: -((r - need) ** 2 @ w) if rule == "norm" else r * need @ w
            while todo[length]:
                fits = [i for i, r in enumerate(left) if (r >= need).all()]
                if not fits:
                    left += [np.array(capacity)] * todo[length]
                    fits = range(len(left) - todo[length], len(left))
                best = left[max(fits, key=lambda i: score(left[i]))]
                for i in [i for i in fits if (left[i] == best).all()][: todo[length]]:
                    left[i] = left[i] - need
                    todo[length] -= 1
        assert abs(len(left) - opened) <= 1  # states with equal scores may be taken in another order


def test_plan_does_not_grow_with_the_pieces():
    random.seed(4)
    counts = Counter(random.randint(1, 2048) for _ in range(3000))
    few, n = VP.best_fit(counts, (2048, 2048, 1 << 22), (1.0, 0.0, 0.0), "norm")
    many, m = VP.best_fit({k: v * 10**9 for k, v in counts.items()}, (2048, 2048, 1 << 22), (1.0, 0.0, 0.0), "norm")
    assert len(many) <= 2 * len(few) and m <= n * 10**9


def test_words_and_white_space_equal_the_tokenizer(tokenizer):
    random.seed(1)
    pieces = ["a", "b", " ", "  ", "\n", " \n", "\t", " ", "é", "中", "'s", "'", "1", "!", "\x1c", "\x85", "<|endoftext|>", "😀"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 12))) for _ in range(20_000)]
    got, want = VP.Encoder(FILE).ids(texts), tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]
    assert 1000 < sum(map(VP.plainly_spaced, texts)) < 19_000
