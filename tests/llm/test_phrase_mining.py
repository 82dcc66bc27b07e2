"""Phrase collocations against SQL and plain Python, the automata, and odd rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quorumlake.llm import phrase_mining as PM

from .test_llm import docs_of


def brute(docs, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    good = {g: a for g, a in f.items() if a >= least}
    out = []
    for (lang, *ws), a in good.items():
        k = len(ws)
        inside = any(g[0] == lang and len(g) - 1 > k and any(list(g[1 + i : 1 + i + k]) == ws for i in range(len(g) - k)) and x >= a for g, x in good.items())
        if k > 1 and not inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, *ws[:c]] * f[lang, *ws[c:]]), c, f[lang, *ws[:c]], f[lang, *ws[c:]]) for c in range(1, k))
            out.append((lang, -score, -a, " ".join(ws).encode(), left, right, n[lang]))
    rows, rank = [], Counter()
    for lang, s, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -s))
    return rows


def rows(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_real_table_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(f"select lang, rank, phrase, a, l, r, n, score from ({PM.SQL.replace('count(*) >= 100', 'count(*) >= 4')})").fetchall())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    assert len(want) > 300 and rows(PM.phrase_collocations(docs, least=4)) == want


@pytest.mark.parametrize("bits", [16, 25])
def test_small_vocabulary(spark, monkeypatch, bits):
    """Overlaps, repeats, ties, hot words and pairs, many shards; a full filter changes nothing."""
    random.seed(2)
    words = ["a", "a", "a", "B", "b", "é", "É", "x'y", "\x01", "c-d", "word"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ? "]
    docs = [("".join(random.choice(words) + random.choice(gaps) for _ in range(random.randint(0, 60))), random.choice(["en", "en", "de", None, "und", ""])) for _ in range(120)]
    docs += [("new york city hall now", "en")] * 40 + [("a a a a a a a a", "en")] * 30 + [(None, "en"), ("", "en"), (" .. ", "xx"), ("x", None)]
    monkeypatch.setattr(PM, "SHARD", 300)
    monkeypatch.setattr(PM, "HEAVY", 7)  # common first words have several ranges
    monkeypatch.setattr(PM, "RANGE_BYTES", 2000)
    got = rows(PM.phrase_collocations(docs_of(spark, [(i, t, lang, "a") for i, (t, lang) in enumerate(docs)]).repartition(3), least=20, most_bits=bits))
    assert got == sorted(brute(docs, 20)) and {r[0] for r in got} >= {"en", "und"}
    assert ("en", "new york city hall now") in {(r[0], r[2]) for r in got}
    assert rows(PM.phrase_collocations(docs_of(spark, [(i, t, lang, "a") for i, (t, lang) in enumerate(docs)]), least=20, top=3)) == sorted(brute(docs, 20, 3))


def test_empty_and_clashing(spark):
    docs = docs_of(spark, [(i, "one two three", "en", "a") for i in range(4)])
    assert PM.phrase_collocations(docs.limit(0), least=2).count() == 0
    assert PM.phrase_collocations(docs_of(spark, [(1, None, None, None), (2, "...", "en", "a")]), least=1).count() == 0
    clash = docs.selectExpr("*", "1 as phrase", "2 as a", "3 as l", "4 as w1", "5 as f", "6 as size", "7 as rank", "8 as body", "9 as part")
    assert rows(PM.phrase_collocations(clash, least=2)) == brute([("one two three", "en")] * 4, 2)


def test_transducers():
    """Counts of all prefixes, shared states, and unions that equal one transducer of everything."""
    random.seed(6)
    grams = Counter(tuple(random.choice("abcd") for _ in range(random.randint(1, 3))) for _ in range(600))
    halves = [Counter(), Counter()]
    for g, c in grams.items():
        part = random.randint(0, c)
        halves[0][g] += part
        halves[1][g] += c - part
    tree = {}
    for h in halves:
        PM.unite(tree, PM.transducer(sorted((g, c) for g, c in h.items() if c)))
    prefixes = Counter()
    for g, c in grams.items():
        for k in range(1, len(g) + 1):
            prefixes[g[:k]] += c
    assert dict(PM.frequent(tree, 1, ())) == prefixes
    assert dict(PM.frequent(tree, 20, ())) == {g: c for g, c in prefixes.items() if c >= 20}
    same = PM.transducer(sorted(((x, y, z), 2) for x in "ab" for y in "cd" for z in "ef"))
    assert len(same) == 4  # no arcs, z, y, start: equal states are one


def test_slots_only_let_more_through(spark):
    docs = docs_of(spark, [(i, f"rare{i} often pair", "en", "a") for i in range(50)]).selectExpr("lang", "cast(text as binary) as body")
    weight = PM.slot_weights(docs.repartition(4), 18, 50)
    words, pairs = PM.slots_of("en", [b"often", b"pair", b"rare1"], np.array([0, 1, 2, 0]), np.array([0, 0, 1, 1]), 18)
    assert weight[words].tolist() == [5, 5, 0] and weight[pairs[0]] == 5 and pairs[1] == -1 and weight[pairs[2]] == 0
