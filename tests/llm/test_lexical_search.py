"""Ranked lexical search against its SQL and plain Python, and on odd rows."""

import math
import re
from collections import Counter, defaultdict

import pytest

from quorumlake.llm import lexical_search as LS

from .test_llm import docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Ranking rows (item_id, rank, doc_id, score) by the definition."""
    docs = [(i, Counter(ts), len(ts)) for i, text in docs if (ts := terms(text))]
    total, length, df = len(docs), sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(Counter)
    for i, text in dict.fromkeys(items):
        asked[i].update(terms(text))
    out = []
    for item, want in asked.items():
        scored = []
        for i, c, n in docs:
            m = 25 + 75 * n * total // length
            s = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in want.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[-1], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_of(spark, pairs):
    return spark.createDataFrame(pairs, "item_id long, text string")


def test_scores_and_ties(spark):
    """Terms past ASCII, digits, upper case beyond A-Z, shared separators, ties by id with null last, more ties than places."""
    docs = [(i, "The same words here") for i in range(30, 5, -1)] + [(None, "the SAME words here"), (40, "É é É99 the_the the"), (41, "É É é"), (42, "...\n\t"), (43, None), (44, ""), (45, "a b-a  a\x00b" * 40), (45, "a b-a  a\x00b" * 40)]
    items = [(1, "same words"), (2, "É the the"), (3, "a"), (4, "b a b\x7fa"), (5, "missing"), (6, None), (7, "..."), (None, "é"), (3, "É"), (3, "É")]
    got = rows(LS.lexical_search(docs_of(spark, [(i, t, "en", "a") for i, t in docs]), items_of(spark, items)))
    assert got == brute(docs, items)
    assert [r[2] for r in got if r[0] == 1] and {r[2] for r in got if r[0] == 1} == set(range(6, 16))


@pytest.mark.parametrize("block_bytes", [8 << 20, 2000])
def test_real_tables_in_blocks(spark, sf_dir, block_bytes):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(LS.lexical_search(docs.repartition(7), items, block_bytes=block_bytes)) == want


def test_empty_and_clashing(spark):
    docs, items = docs_of(spark, [(1, "one two", "en", "a")]), items_of(spark, [(1, "two")])
    assert LS.lexical_search(docs.limit(0), items).count() == LS.lexical_search(docs, items.limit(0)).count() == LS.lexical_search(docs, items_of(spark, [(1, "?")])).count() == 0
    clash = lambda df: df.selectExpr("*", "1 as n", "2 as t", "3 as c", "4 as rank", "5 as item", "6 as score", "7 as body", "8 as part")
    assert rows(LS.lexical_search(clash(docs), clash(items))) == brute([(1, "one two")], [(1, "two")])


def test_very_long_text(spark):
    docs = [(1, "needle " + "hay " * 300_000 + "needle"), (2, "needle hay")]
    assert rows(LS.lexical_search(docs_of(spark, [(i, t, "en", "a") for i, t in docs]), items_of(spark, [(1, "needle")]))) == brute(docs, [(1, "needle")])
