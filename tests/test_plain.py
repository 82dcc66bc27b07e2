"""Registered queries that SQL can't state, against plain Python on the given tables."""

import collections
import math

import numpy as np
import pytest

from quorumlake.plans import queries as plans

QUERIES = plans.queries()


@pytest.fixture(scope="module")
def cases(spark, sf_dir):
    """Hops of each case in clock order: sample, best class, its probability, event id."""
    out = collections.defaultdict(list)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["user_id", "ts", "event_id"])
    for r in rows.itertuples():
        best = 0 if r.event_type == "view" else 1 if r.event_type in ("click", "purchase") else 2
        out[r.user_id].append((1280 * (len(out[r.user_id]) + 1), best, 0.5 + (r.event_id % 50) / 100, r.event_id))
    return out


def gate(hops, threshold=0.6, confirm=2, block=5120, warm=3):
    events, label, count, until = [], None, 0, -1
    for n, (sample, best, p, _) in enumerate(hops):
        if n < warm or sample < until or best == 0 or np.float32(p) < np.float32(threshold):
            label, count = None, 0
            continue
        label, count = best, count + 1 if best == label else 1
        if count == confirm:
            events.append((sample, best))
            label, count, until = None, 0, sample + block
    return events


def test_event_gate_and_consistency(spark, sf_dir, cases):
    want = {(str(c), s, k) for c, hops in cases.items() for s, k in gate([(s, b if p > (1 - p) / 2 else 0, p, e) for s, b, p, e in hops])}
    assert want
    assert {tuple(r) for r in QUERIES["r1_event_gate"](spark, sf_dir).select("case_id", "sample", "event_class").collect()} == want
    lost = {(c, s, k, "derived") for c, s, k in want if s % 3 == 0} | {(c, s + 1, k, "stored") for c, s, k in want if s % 7 == 0}
    assert {tuple(r) for r in QUERIES["r4_event_consistency"](spark, sf_dir).select("case_id", "sample", "event_class", "side").collect()} == lost


def test_token_sequences(spark, sf_dir, cases):
    want = collections.Counter()
    for c, hops in cases.items():
        changes, last = [], None
        for s, _, _, e in hops:
            if e % 4 != last:
                changes.append((s, e % 4))
            last = e % 4
        for gap in (1280, 2560, 5120, 12800):
            seen = []
            for s, t in changes:
                if seen and s - seen[-1] > gap:
                    seen = []
                if t == len(seen) + 1:
                    seen.append(s)
                elif t == 1:
                    seen = [s]
                if len(seen) == 3:
                    want[str(c), gap, *seen] += 1
                    seen = []
    got = collections.Counter(tuple(r) for r in QUERIES["r9_token_sequences"](spark, sf_dir).select("case_id", "gap", "first", "second", "third").collect())
    assert got == want and want


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    return {n: find(n) for n in nodes}


def test_split_components(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    named = collections.defaultdict(list)
    for r in rows:
        if r.p_partkey % 3 == 0:
            named["price", r.p_retailprice].append(r.p_partkey)
        if r.p_partkey % 7 == 1:
            named["brand", r.p_brand, r.p_size].append(r.p_partkey)
    root = roots([(k[0], x) for k in named.values() for x in k[1:]], [r.p_partkey for r in rows])
    groups = collections.defaultdict(set)
    sizes = collections.Counter(root.values())
    for r in rows:
        groups[root[r.p_partkey]].add("dev" if r.p_partkey % 2 == 0 else "train")
    want = sorted((2, sizes[g]) for g, s in groups.items() if len(s) == 2)
    got = QUERIES["l3_split_components"](spark, sf_dir).collect()
    assert sorted((r.splits, r.rows) for r in got) == want


def test_lineage_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    bench = {f"d{r.item_id}" for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    by_text = collections.defaultdict(list)
    for r in docs:
        by_text[r.text].append(f"d{r.doc_id}")
    root = roots([(k[0], x) for k in by_text.values() for x in k[1:]], [f"d{r.doc_id}" for r in docs])
    members = collections.defaultdict(set)
    for k, c in root.items():
        members[c].add(k)
    got = {r.key: (r.component, r.exposed) for r in QUERIES["l4_lineage_groups"](spark, sf_dir).collect()}
    assert got == {k: (c, any(m in bench and m < "d2" for m in members[c])) for k, c in root.items()}


def test_exposure_plan(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    groups = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        kind = "near" if r.quality == 0 else "ordinary" if docs[r.doc_id].lang == "en" else "positive"
        groups[kind][docs[r.doc_id].source].append(r.doc_id)
    quotas, used, want = {"positive": 1000, "ordinary": 900, "near": 100}, collections.Counter(), []
    for place in range(2000):
        c = max((c for c in quotas if used[c] < quotas[c]), key=lambda c: quotas[c] * (place + 1) - used[c] * 2000)
        families = sorted(groups[c])
        rows = sorted(groups[c][families[used[c] % len(families)]])
        want.append((place, c, used[c], families[used[c] % len(families)], rows[used[c] // len(families) % len(rows)]))
        used[c] += 1
    got = QUERIES["x1_exposure_plan"](spark, sf_dir).orderBy("position").collect()
    assert [tuple(r) for r in got] == want


def test_signal_queries(spark, sf_dir):
    waves = {str(r.vec_id): np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    for r in QUERIES["g2_silence"](spark, sf_dir).collect():
        x = [v * (10 if int(r.clip) % 10 == 0 else 20_000) * (0.001 if 8 <= i % 24 <= 14 else 1) for i, v in enumerate(waves[r.clip])]
        levels = [math.sqrt(sum(v * v for v in x[i : i + 4]) / 4) for i in range(0, len(x) - 3, 4)]
        if max(levels) < 100:
            assert (r.lead_ms, r.tail_ms, r.inner_ms) == (0, 0, 10 * len(levels))
            continue
        loud = [i for i, level in enumerate(levels) if level > 0.01 * max(levels)]
        inner = max([b - a - 1 for a, b in zip(loud, loud[1:])], default=0)
        assert (r.lead_ms, r.tail_ms, r.inner_ms) == (10 * loud[0], 10 * (len(levels) - 1 - loud[-1]), 10 * inner)
    for r in QUERIES["g6_mix_snr"](spark, sf_dir).collect():
        c, n = waves[r.clip] * 20000, waves[r.clip][::-1] * 9000
        assert abs(r.gain - math.sqrt((c**2).mean() / (n**2).mean() / 10)) < 1e-8
    for r in QUERIES["g7_add_context"](spark, sf_dir).collect():
        assert (r.samples, r.clip_start) == (len(waves[r.clip]) + 48, 32)
