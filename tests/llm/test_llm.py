"""Training-data operators against plain Python, and on nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quorumlake.llm import embedding_dedup as E
from quorumlake.llm import language_id as LI
from quorumlake.llm import line_dedup as LD
from quorumlake.llm import mixing as MX
from quorumlake.llm import near_dedup as ND
from quorumlake.llm import packing as PK
from quorumlake.llm import quality_classifier as QC
from quorumlake.llm import quality_rules as QR
from quorumlake.llm import secret_scan as SS
from quorumlake.llm import sharding as SH
from quorumlake.llm import common as C
from quorumlake.llm.common import components, prefix_sums, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None), (None, "some text here", "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "b"), (4, long, "en", None), (5, "the same row", "en", "a"), (5, "the same row", "en", "a"), (6, "password = hunter22", "fr", "a")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


# --- helpers


def test_prefix_sums(spark):
    xs = list(range(1, 700))
    df = spark.createDataFrame([(xs,), ([],)], "xs array<long>")
    got = [r.s for r in df.select(prefix_sums(F.col("xs")).alias("s")).collect()]
    assert got == [list(itertools.accumulate([0, *xs[:-1]])), []]


def test_ranked_is_gapless_in_hot_groups(spark):
    df = spark.createDataFrame([(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 5}", i) for i in range(900)], "g string, id long")
    got = ranked(df, ["g"], [F.col("id")], "rank", group=["g"]).toPandas()
    assert len(got) == 900
    for _, part in got.groupby(got.g.fillna("-")):
        assert sorted(part["rank"]) == list(range(len(part)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}  # a root has no row


# --- 1


def test_lines_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(LD.SQL).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in LD.op1_line_dedup(spark, sf_dir).collect()}
    assert got == want


def test_line_spread_and_first_occurrence(spark):
    rows = [(i, f"own {i}\nshared line\nown again {i}", "en", f"s{i}") for i in range(5)] + [(9, "few\nshared line", "en", "s0")] + [(20 + i, "few", "en", "s1") for i in range(9)]
    got = {r.doc_id: r.text for r in LD.line_dedup(docs_of(spark, rows), min_sites=5).collect()}
    assert got[0] == "own 0\nshared line\nown again 0" and got[3] == "own 3\nown again 3" and got[9] == "few" and got[25] == "few"


def test_long_lines_need_fewer_sites_and_copies_count_once(spark):
    long = "a passage " * 20
    rows = [(i, f"own {i}\n{long}\nshort one", "en", f"s{i}") for i in range(4)]
    rows += [(10 + i, f"copied\n{long}\nonly here", "en", f"s{i}") for i in range(9)]  # one text on nine sites
    got = {r.doc_id: (r.text, r.n_removed) for r in LD.line_dedup(docs_of(spark, rows)).collect()}
    assert got[0] == (rows[0][1], 0) and got[3] == ("own 3\nshort one", 1)
    assert {got[10 + i] for i in range(9)} == {("copied\nonly here", 1)}  # copies stay copies


def test_estimates_near_the_threshold_are_counted_exactly(spark, monkeypatch):
    """With sketches of 16 registers the estimate is far off; the exact count decides inside its band of errors."""
    rows = [(100 * k + i, f"line number {k}\nown {k} {i}", "en", f"s{i}") for k in range(30) for i in range(28 + k % 4)]
    got = LD.line_dedup(docs_of(spark, rows), min_sites=30, lg_k=4).collect()
    for r in got:
        k, i = divmod(r.doc_id, 100)
        assert r.n_removed == (k % 4 >= 2 and i > 0), (k, i)


def clashing(df):
    """Columns with the names that operators use inside."""
    names = ["row", "doc", "body", "_doc", "_body", "_gone", "gone", "site", "id", "_id", "_p", "p", "_w", "_b", "w", "b", "h", "len", "first", "one", "of", "lead", "llr0", "_metadata", "_file", "a.b"]
    return df.withColumns({n: F.lit(n) for n in names}), names


def test_user_columns_keep_their_values(spark, odd, labels):
    df, names = clashing(odd)
    vec, _ = clashing(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>"))
    outs = [LD.line_dedup(df), QR.quality_rules(df, labels), LI.fit_and_identify(df), QC.quality_classifier(df, labels), ND.near_dedup(df), ND.near_unique(df), E.embedding_dedup(vec)]
    for out in outs:
        for r in out.collect():
            assert all(r[n] == n for n in names)
    assert MX.mix(df).count() == SS.secret_scan(df).count() == SH.shard_by_hilbert(df).count() == 8
    assert PK.pack(df, ordered=True).count() == PK.pack(odd).count()


def test_lines_odd(spark, odd, empty):
    got = LD.line_dedup(odd.withColumn("n_removed", F.lit(7)), min_sites=2).collect()
    assert len(got) == 8 and [r.text for r in got if r.doc_id == 1] == [None] and all(r.n_removed == 0 for r in got)
    assert LD.line_dedup(empty).count() == 0


# --- 2


def base_rules(s):
    s = s or ""
    w, seen, cover = WORDS.findall(s), {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(p for i in at for p in range(i, i + 8))
    lines = [x for x in s.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_against_python(spark, real, labels):
    docs, gold = real.toPandas(), labels.toPandas()
    got = QR.quality_rules(real, labels).toPandas().set_index("doc_id")
    B, prior = 1 << 15, 10.0
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    h1 = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed=seed)
    grams = {}
    for r in docs.itertuples():
        w = WORDS.findall(r.text)
        grams[r.doc_id] = [signed(h1(x)) % B for x in w] + [signed(h1(y, h1(x))) % B for x, y in zip(w, w[1:])]
    good = set(gold[gold.quality == 1].doc_id)
    raw, target = np.zeros(B), np.zeros(B)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(target, g, 1)
    share = target.sum() / raw.sum()
    w = np.array([round(QR.SCALE * x) for x in np.log((target + prior * share) / (target.sum() + prior * B * share)) - np.log((raw + prior) / (raw.sum() + prior * B))])
    for r in docs.itertuples():
        x = got.loc[r.doc_id]
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_rules(r.text)
        llr = w[grams[r.doc_id]].mean() / QR.SCALE if grams[r.doc_id] else 0.0
        assert abs(x.llr - llr) < 1e-6
        failed = x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words
        assert x.base_failed == failed and x.kept == (not failed and x.llr >= -0.1)


def test_quality_odd(spark, odd, empty, labels):
    got = QR.quality_rules(odd.withColumn("kept", F.lit("clash")), labels.limit(0)).collect()
    assert len(got) == 8 and {r.llr for r in got} == {0.0}
    assert [(r.n_words, r.kept) for r in got if r.doc_id in (1, 2, 3)] == [(0, False)] * 3
    assert [r.kept for r in got if r.doc_id == 4] == [True]
    assert QR.quality_rules(empty, labels).count() == 0


# --- 3

KINDS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(s):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(KINDS) for m in p.finditer(s or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_secrets_against_python(spark):
    hexed = "0123456789abcdef" * 2
    texts = ["é password: abc123 secret=token:abcdef TOKEN = 'x1y2z3'", f"AKIA{'A1' * 9} {hexed}", f"token={hexed}", "api_key: short", None, "", "Api_Key=\"abc.def-ghi\" ApiKey:=abcdefg", "AKIAshort", "😀 secret = 12345678\n" * 600]
    texts += [f"example zZ9xY8wV7uT6sR5qP4oN3 {hexed[::-1]}"] * 4 + ["mine aB3dE5fG7hJ9kL1mN3pQ5"]
    df = docs_of(spark, [(i, t, "en", f"s{i}") for i, t in enumerate(texts)])
    for r in SS.secret_scan(df).collect():
        assert r.base == base_spans(texts[r.doc]), texts[r.doc]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(r.base.count(k) for k in ("assign", "access", "hex"))
        verdicts = {x.verdict for x in r.found}
        if 9 <= r.doc <= 12:
            assert verdicts == {"example"} and "loose" not in r.spans
        if r.doc == 13:
            assert verdicts == {"live"} and "loose:5:26" in r.spans


def test_verdicts_weigh_owners_and_repositories(spark):
    value = lambda k: f"zZ9xY8wV7uT6sR5qP4oN{k}"
    rows = [(i, f"here {value(1)}", "en", "one") for i in range(40)]  # many repositories of one owner: its own
    rows += [(100 + i, f"here {value(2)}", "en", f"s{i % 2}") for i in range(8)]  # two owners, eight repositories: copied
    rows += [(200 + i, f"here {value(3)}", "en", f"s{i % 2}") for i in range(4)]  # two owners, four repositories: live
    rows += [(300 + i, f"here {value(4)}", "en", f"s{i}") for i in range(3)] * 2  # three owners, repeated rows
    got = SS.secret_scan(docs_of(spark, rows)).collect()
    verdict = {r.doc // 100: {(x.verdict, x.owners, x.repos) for q in got if q.doc // 100 == r.doc // 100 for x in q.found} for r in got}
    assert verdict == {0: {("live", 1, 40)}, 1: set(), 2: {("live", 2, 4)}, 3: set()}


def test_secrets_in_a_dense_long_text(spark):
    text = "token=abcdef12 " * 5000 + "0123456789abcdef01234567 " * 2000
    r = SS.secret_scan(docs_of(spark, [(1, text, "en", "s")])).first()
    assert r.n_assign == 5000 and r.n_hex == 2000 and r.base == base_spans(text)


def test_secrets_query_shape(spark, sf_dir, odd, empty):
    r = SS.op3_secret_scan(spark, sf_dir).first()
    assert re.fullmatch("[0-9a-f]{64}", r.base_sha256)
    got = SS.secret_scan(odd).collect()
    assert len(got) == 8 and [x.spans for x in got if x.doc == 6] == ["assign:0:19"]
    assert SS.secret_scan(empty).count() == 0


# --- 4


def check_schedule(blocks, weights, size):
    """Every block inside its window in a slot of its own, in order; and while no source is exhausted, less than one block off at every slot."""
    slots = {}
    for part in MX.slices(blocks, weights, size):
        for source, block, phase, release, deadline, slot in MX.scheduled(part):
            assert release <= slot < deadline and slot not in slots
            slots[slot] = (source, block)
    assert sorted(slots) == list(range(sum(blocks)))
    seen, total = [0] * len(blocks), sum(Fraction(str(w)) for w in weights)
    share = [Fraction(str(w)) / total for w in weights]
    exhausted = False
    for t in range(len(slots)):
        source, block = slots[t]
        assert block == seen[source]
        seen[source] += 1
        exhausted = exhausted or any(n == b for n, b in zip(seen, blocks))
        if not exhausted:
            assert all(abs(n - w * (t + 1)) < 1 for n, w in zip(seen, share))


def test_schedules_in_slices_keep_every_window():
    random.seed(1)
    for _ in range(60):
        m = random.randint(1, 12)
        blocks = [random.choice([1, 3, 20, random.randint(1, 50)]) for _ in range(m)]
        weights = [random.choice([1, 2, 0.5, 0.001, 7, round(random.random(), 6)]) for _ in range(m)]
        for size in (1, 2, 7, 16, 1000):
            check_schedule(blocks, weights, size)


@pytest.mark.parametrize(("blocks", "weights", "size"), [([9] * 250, [1] * 250, 300), ([1 + i % 23 for i in range(260)], "size", 137), ([700, 1100, 3000], [0.123456789012345, 0.4, 7e-12], 64), ([2000, 3], [0.99999, 0.00001], 500)])
def test_many_sources_and_long_fractions(blocks, weights, size):
    check_schedule(blocks, blocks if weights == "size" else weights, size)


def test_shares_are_exact_beyond_a_million_slots():
    """Cuts of a long schedule are exact: what is given by them differs from the true weights by less than one block."""
    blocks, weights = [3_000_000, 2_000_000, 1_500_001, 77], [0.123, 0.456, 0.421, 0.0000001]
    total = sum(Fraction(str(w)) for w in weights)
    given = [0] * 4
    for part in itertools.takewhile(lambda p: p["phase"] == 0, MX.slices(blocks, weights)):
        for i, n in zip(part["source"], part["last"]):
            given[i] = n
        if part["end"] % MX.SLICE == 0:
            assert all(abs(n - Fraction(str(w)) / total * part["end"]) < 1 for n, w in zip(given, weights))
    assert max(given) > 1_600_000


def test_weights_must_be_positive(odd):
    for bad in (0, -1.0):
        with pytest.raises(ValueError):
            MX.mix(odd, {"a": 1.0, "b": bad})
    got = MX.mix(docs_of(odd.sparkSession, [(i, "t", "en", None if i % 2 else "") for i in range(40)]), {None: 3.0, "": 1.0}, block_rows=2).toPandas()
    first = got[got.slot < 12].drop_duplicates("slot")
    assert (first.source.isna().sum(), (first.source == "").sum()) == (9, 3)  # a null source is apart from ""


def test_mixing_places_every_row(spark):
    rows = [(i, f"t{i}", "en", None if i % 40 == 0 else "hot" if i % 3 else f"s{i % 4}") for i in range(1000)]
    got = MX.mix(docs_of(spark, rows), {"hot": 2.0, "s0": 1.0}, block_rows=7).toPandas().sort_values("position")
    assert list(got.position) == list(range(1000)) and ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    blocks = got.drop_duplicates("slot")
    assert list(blocks.slot) == list(range(len(blocks)))
    assert (got.groupby("slot").source.nunique(dropna=False) == 1).all()


def test_mixing_odd(odd, empty):
    assert sorted(r.position for r in MX.mix(odd).collect()) == list(range(8))
    assert MX.mix(empty).count() == 0


def test_size_weights_last_to_the_end(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 == 0 else f"s{i % 10}") for i in range(6000)]
    got = MX.mix(docs_of(spark, rows), "size").toPandas().sort_values("position")
    assert list(got.position) == list(range(6000))
    share = got.source.value_counts(normalize=True)
    for part in np.array_split(got.source.to_numpy(), 6):  # the hot source never runs alone
        assert all(abs((part == s).mean() - share[s]) < 0.05 for s in share.index)


@pytest.mark.parametrize("weights", [None, "size", "sqrt", {"s1": 3.0, "hot": 2.0}])
def test_mixing_in_slices(spark, weights, monkeypatch):
    monkeypatch.setattr(MX, "SLICE", 32)
    monkeypatch.setattr(MX, "SLICES", 9)
    rows = [(i, f"t{i}", "en", "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i * i % 61}") for i in range(2000)]
    got = MX.mix(docs_of(spark, rows), weights, block_rows=4).toPandas().sort_values("position")
    assert sorted(got.doc_id) == list(range(2000)) and list(got.position) == list(range(2000))
    assert ((got.slot >= got.release) & (got.slot < got.deadline)).all() and got.slot.is_monotonic_increasing
    blocks = got.drop_duplicates("slot")
    assert list(blocks.slot) == list(range(len(blocks)))
    assert (got.groupby("slot").source.nunique(dropna=False) == 1).all()
    if weights == "size":
        hot = (blocks.source == "hot").to_numpy()
        assert np.abs(hot.cumsum() - hot.mean() * np.arange(1, len(hot) + 1)).max() < 1
    if weights == "sqrt":  # a target apart from the supply: the hot source, a third of all blocks, starts with a far smaller share
        first = blocks[blocks.phase == 0]
        assert (blocks.source == "hot").mean() > 0.3 > 0.2 > (first.source == "hot").mean() and blocks.phase.nunique() > 3


# --- 5


def shingles(s):
    w = [] if s is None else s.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(root), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in root}


def test_near_dedup_against_all_pairs(spark, real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    rng = np.random.default_rng(0)
    base = [f"x{i}" for i in range(120)]
    for k in range(60):  # mutants around the threshold
        w = list(base)
        for p in rng.choice(120, size=int(rng.integers(1, 9)), replace=False):
            w[p] = f"m{k}_{p}"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, "One two"), (20_001, "oNE  two"), (20_002, "one two three"), (20_003, ""), (20_004, None)]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    got = ND.near_dedup(df.withColumn("kept", F.lit(1))).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_sizes_and_odd(spark, sf_dir, real, odd, empty):
    got = {r.doc_id: r.n_shingles for r in ND.op5_setsketch_dedup(spark, sf_dir).collect()}
    assert got == {r.doc_id: len(shingles(r.text)) for r in real.collect()}
    out = ND.near_dedup(odd).collect()
    assert len(out) == 8 and [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, False)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id == 5] == [(5, True)] * 2
    assert ND.near_dedup(empty).count() == 0


def test_near_dedup_in_small_stars_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ND, "STAR", 4)
    monkeypatch.setattr(ND, "CHUNK", 8)
    monkeypatch.setattr(C, "HUB", 5)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(40):
            w = list(base)
            for p in rng.choice(100, size=int(rng.integers(0, 4)), replace=False):
                w[p] = f"m{g}_{k}_{p}"
            rows.append((1000 * g + k, " ".join(w)))
    got = ND.near_dedup(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(7, text("a")), (7, text("b")), (3, text("b") + " more"), (7, text("c")), (7, text("c") + " more"), (7, ""), (None, text("d")), (None, text("d")), (None, text("a")), (None, text("e")), (9, text("e") + " more"), (None, "")]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    got = {(r.doc_id, r.text): (r.component_id, r.kept) for r in ND.near_dedup(df).collect()}
    assert got[7, text("a")] == (7, True) and got[7, text("b")] == (3, False) and got[3, text("b") + " more"] == (3, True)
    assert [got[7, text("c") + x] for x in ("", " more")] == [(7, True)] * 2  # the contract: kept where the id is that of the component
    kept = [(r.doc_id, r.text) for r in ND.near_unique(df).collect()]
    want = {(7, text("a")), (3, text("b") + " more"), (7, ""), (None, text("d")), (9, text("e") + " more"), (None, "")}
    assert set(kept) - want < {(7, text("c")), (7, text("c") + " more")} and want < set(kept) and len(kept) == len(want) + 1


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.8, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        a = rng.integers(1 << 63, size=2 * n - both, dtype=np.uint64)
        x, y = a[:n], a[n - both :]
        ok, est = ND.may_link(np.array([n]), ND.registers(x)[None], np.array([n]), ND.registers(y)[None])
        assert abs(est[0] - j) < 0.15 and ok[0] == (j > 0.6)
    u, v = rng.integers(1 << 63, size=(2, 500), dtype=np.uint64)
    assert (np.maximum(ND.registers(u), ND.registers(v)) == ND.registers(np.concatenate([u, v]))).all()  # mergeable


# --- 6 and 7


def test_language_accuracy_and_odd(spark, sf_dir, real, odd, empty):
    got = LI.op6_language_id(spark, sf_dir).toPandas().merge(real.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out.to_numpy() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.8 and got.score.between(0, 1).all()
    out = LI.fit_and_identify(odd.withColumn("score", F.lit("x"))).collect()
    assert len(out) == 8 and {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert LI.fit_and_identify(empty).count() == 0


def test_language_against_plain_python(spark, real):
    """The query's predictions from the learned dictionaries, by a compressor a text and language, with ties and rejection."""
    import unicodedata

    import zstandard

    train = real.where(LI.fold(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("id"), "text", "lang")
    names, dicts = LI.learn_dictionaries(train, "text", "lang", [F.col("id"), F.col("text")], 64, 112_000, 64 << 20)
    assert sorted(names) == sorted({r.lang for r in train.where("lang is not null").select("lang").distinct().collect()})
    known = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in dicts]

    def sizes(text):
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
        body = " ".join(kept.split()).encode()
        make = lambda k: zstandard.ZstdCompressor(level=3, dict_data=k, write_content_size=False, write_checksum=False, write_dict_id=False)
        return [sum(len(make(k).compress(body[i : i + 2048])) for i in range(0, len(body), 2048)) for k in known]

    got = {r.doc_id: r for r in LI.fit_and_identify(real).collect()}
    for r in real.collect():
        x, s = got[r.doc_id], sizes(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert x.lang_pred == "und" and x.rejected
            continue
        best, second = sorted(s)[:2]
        assert x.lang_pred == names[s.index(best)] and abs(x.margin - (second - best) / second) < 1e-9
        assert x.rejected == ((second - best) / second < 0.01)
    tie = LI.language_id(docs_of(spark, [(1, "abc", None, None)]), ["xx", "yy"], [b"zzzzzzzz", b"zzzzzzzz"]).first()
    assert (tie.lang_pred, tie.margin, tie.rejected) == ("xx", 0.0, True)


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i % 600} text of lang{i % 600}", f"l{i % 600:03}", "s") for i in range(1200)]
    train = docs_of(spark, rows).select(F.col("doc_id").alias("id"), "text", "lang")
    names, dicts = LI.learn_dictionaries(train, "text", "lang", [F.col("id"), F.col("text")], 64, 112_000, 1 << 20)
    assert len(names) == 600 and sum(map(len, dicts)) <= 1 << 20


def test_language_labels_of_held_out_rows_do_not_matter(spark, real):
    held = LI.fold(F.col("doc_id"), 5) == 0
    other = real.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a, b = (LI.fit_and_identify(d).select("doc_id", "lang_pred").toPandas().sort_values("doc_id") for d in (real, other))
    assert a.lang_pred.tolist() == b.lang_pred.tolist()


def test_classifier(spark, odd, empty):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = QC.quality_classifier(real, labels)
    rows = got.toPandas()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    held = LI.fold(F.col("doc_id"), 3) == 1
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = QC.quality_classifier(real, other).toPandas()
    assert np.allclose(rows.sort_values("doc_id").score, again.sort_values("doc_id").score)
    assert (rows.held_out.to_numpy() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    gold = rows.merge(labels.toPandas(), on="doc_id")
    held = gold[gold.held_out]
    assert (held.predicted == held.quality).mean() > 0.85
    hi, lo = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert ((hi[:, None] > lo).mean() + 0.5 * (hi[:, None] == lo).mean()) > 0.9  # area under the curve
    model = QC.learn_quality(real, labels, "text", "doc_id", 3, 4000, 8000)
    texts = {r.doc_id: r.text or "" for r in real.collect()}
    plain = [1 / (1 + math.exp(-float(QC.features(texts[i]) @ model["w"] + model["b"]))) for i in rows.doc_id]
    assert np.allclose(rows.score, plain, atol=1e-4)
    twice = QC.quality_classifier(real.union(real), labels).toPandas()
    assert len(twice) == 2 * len(rows) and twice.groupby("doc_id").score.nunique().max() == 1
    out = QC.quality_classifier(odd, labels.limit(0)).collect()
    assert len(out) == 8 and {r.score for r in out} == {0.5}
    assert QC.quality_classifier(empty, labels).count() == 0


def test_nonnegative_risk_separates():
    rng = np.random.default_rng(1)
    xp = rng.normal(1, 1, (600, 4)).astype(np.float32)
    xu = np.vstack([rng.normal(1, 1, (700, 4)), rng.normal(-1, 1, (300, 4))]).astype(np.float32)
    m = QC.fit(xp.copy(), xu.copy(), lambda w, b: np.bincount(QC.bins_of(xu @ w + b), minlength=QC.BINS))
    assert 0.55 < m["prior"] < 0.9
    z = xu @ m["w"] + m["b"]
    assert ((z > 0) == (np.arange(1000) < 700)).mean() > 0.9


# --- 8


def test_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        c = {int(x): int(rng.integers(1, 9)) for x in rng.choice(30, 8, replace=False) + 1}
        lengths = sorted(c)
        padding = lambda bounds: sum(n * (min(b for b in bounds if b >= k) - k) for k, n in c.items())
        for k in (1, 2, 3, 9):
            best = min(padding((*p, lengths[-1])) for p in itertools.combinations(lengths[:-1], min(k, 8) - 1))
            assert padding(PK.best_bounds(c, k)) == best


def test_a_budget_below_the_bucket_gives_single_pieces(spark):
    got = PK.pack(docs_of(spark, [(i, "w " * 50, "en", "s") for i in range(4)]), max_len=64, budget=10).toPandas()
    assert sorted(got.batch) == [0, 1, 2, 3] and set(got.slot) == {0}


def test_packing_keeps_every_token(spark, real, odd, empty):
    for df in (real, odd):
        got = PK.pack(df, max_len=64, buckets=4, budget=512).toPandas()
        want = sorted(len(WORDS.findall(r.text or "")) for r in df.collect())
        full = got[got.n_tokens > 0]
        assert full.n_tokens.sum() == sum(want) and (got.n_tokens == 0).sum() == want.count(0)
        assert not full[["batch", "slot"]].duplicated().any() and (full.n_tokens <= full.bucket_len).all()
        assert (full.groupby("batch").bucket_len.agg(["nunique", "count"])["nunique"] == 1).all()
        assert (full.groupby("batch").bucket_len.sum() <= 512).all()
        assert sorted(full.batch.unique()) == list(range(full.batch.nunique()))
    assert PK.pack(empty).count() == 0


def test_packing_counts_tokenizer_ids(spark):
    files = pytest.importorskip("public_tokenizers")
    df = docs_of(spark, [(1, "hello world <|endoftext|>", "en", "s"), (2, None, "en", "s")])
    got = {r.doc_id: r.n_tokens for r in PK.pack(df, tokenizer_file=files.path("byte_bpe_50k.json")).collect()}
    assert got[1] > 3 and got[2] == 0


# --- 9


def brute_links(rows, cosine=0.95):
    ids, ok = [], {}
    for i, v in rows:
        ids.append(i)
        x = np.array([np.nan if c is None else c for c in v], dtype=float) if v else np.array([])
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            ok[i] = x / np.linalg.norm(x)
    n, root = dict.fromkeys(ids, 0), {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(ok), 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
            n[a] += 1
            n[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (n[i], find(i)) for i in ids}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    for i in range(80):
        rows.append((200 + i, (np.array(rows[i % 9][1]) + rng.normal(size=16) * 0.18).tolist()))
    rows += [(400 + i, rows[3][1]) for i in range(40)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = E.embedding_dedup(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_large_runs_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.1).tolist()) for i in range(120)]
    got = E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)


def test_pairs_near_the_threshold_in_64_dimensions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64)) for i in range(400)]
    for i in range(400):  # partners at cosines around 0.95
        v = rows[i][1] / np.linalg.norm(rows[i][1])
        o = rng.normal(size=64)
        o -= (o @ v) * v
        c = rng.uniform(0.94, 0.97)
        rows.append((1000 + i, c * v + math.sqrt(1 - c * c) * o / np.linalg.norm(o)))
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in rows]
    got = E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute_links(rows)
    assert sum(n for n, _ in want.values()) > 300
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_embeddings_odd(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.embedding_dedup(none).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in E.embedding_dedup(rows).collect()) == [(0, 0, False), (1, 0, True), (1, 0, True)]


# --- 10


def test_curve_steps_to_neighbours(spark):
    cells = spark.createDataFrame(list(itertools.product(range(8), repeat=3)), "x int, y int, z int")
    got = cells.select("*", SH.hilbert_index([F.col(c) for c in "xyz"], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(got, got[1:]))


def test_shards_are_even_runs_of_the_curve(spark, sf_dir, real):
    got = SH.op10_hilbert_sharding(spark, sf_dir).toPandas().sort_values(["shard", "slot"])
    texts = {r.doc_id: (r.text or "").encode() for r in real.collect()}
    assert sorted(got.doc_id) == sorted(texts)
    assert (got["size"].to_numpy() == [len(texts[i]) + 1 for i in got.doc_id]).all() and (got.text_crc32.to_numpy() == [zlib.crc32(texts[i]) for i in got.doc_id]).all()
    n = got.groupby("shard").slot.agg(["min", "max", "count"])
    assert n["count"].max() - n["count"].min() <= 1 and (n["min"] == 0).all() and (n["max"] == n["count"] - 1).all()
    assert got.hilbert.is_monotonic_increasing and set(got.law) == {"rows"}


@pytest.mark.parametrize("n", [70, 10_000])
def test_axis_codes_follow_the_values(spark, n):
    df = spark.createDataFrame([(i, f"v{i * 7919 % n:05}") for i in range(n)] + [(-1, None)], "doc_id long, v string")
    got = SH.value_codes(df, "v").orderBy("v").collect()
    codes = [r._code_v for r in got]
    assert codes == sorted(codes) and codes[0] == 0 and max(codes) == 63 and len(set(codes)) == 64


def test_written_shards_prune(spark, tmp_path):
    """A filter on any dimension opens few shards by the files' statistics; shards by hash would all be opened."""
    import pyarrow.parquet as pq

    rows = [(i, "t" * int(2 ** (i * 37 % 14)), f"l{i * 31 % 40:02}", f"s{i * 17 % 90:02}") for i in range(6000)]
    SH.write_shards(SH.shard_by_hilbert(docs_of(spark, rows)), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("shard=*/*.parquet"))
    assert len(files) == 16
    spans = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        col = {meta.schema.column(j).name: [meta.row_group(g).column(j).statistics for g in range(meta.num_row_groups)] for j in range(meta.num_columns)}
        spans.append({c: (min(s.min for s in col[c]), max(s.max for s in col[c])) for c in ("lang", "source", "size")})
    for c, values in (("lang", [f"l{k:02}" for k in range(40)]), ("source", [f"s{k:02}" for k in range(90)]), ("size", [2**k + 1 for k in range(14)])):
        opened = [sum(a <= v <= b for a, b in (s[c] for s in spans)) for v in values]
        assert np.mean(opened) < 11, (c, np.mean(opened))
    both = [sum(s["lang"][0] <= f"l{k % 40:02}" <= s["lang"][1] and s["source"][0] <= f"s{k:02}" <= s["source"][1] for s in spans) for k in range(90)]
    assert np.mean(both) < 6


def test_shards_odd(spark, odd, empty):
    got = SH.shard_by_hilbert(odd, shards=3).toPandas()
    assert sorted(got.groupby("shard").size()) == [2, 3, 3]
    assert SH.shard_by_hilbert(empty).count() == 0
def test_a_language_of_long_texts_only_is_learned(spark):
    """All texts of `xx` exceed the bytes of a dictionary; one is a single word."""
    words = {"xx": "zuk vex qyl ", "yy": "mama papa dodo "}
    rows = [(i, words[lang] * (400 if lang == "xx" else 3), lang, "s") for i, lang in enumerate(["xx", "yy"] * 12)] + [(99, "k" * 5000, "zz", "s")]
    train = docs_of(spark, rows)
    names, dicts = LI.learn_dictionaries(train, "text", "lang", [F.col("doc_id"), F.col("text")], 64, 2_000, 64 << 20)
    assert set(names) == {"xx", "yy", "zz"} and all(0 < len(d) <= 2_001 for d in dicts)
    got = {r.doc_id: r.lang_pred for r in LI.language_id(train, names, dicts).collect()}
    assert (got[0], got[1]) == ("xx", "yy")


"""Training-data operators against plain Python, and on nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quorumlake.llm import embedding_dedup as E
from quorumlake.llm import language_id as LI
from quorumlake.llm import line_dedup as LD
from quorumlake.llm import mixing as MX
from quorumlake.llm import near_dedup as ND
from quorumlake.llm import packing as PK
from quorumlake.llm import quality_classifier as QC
from quorumlake.llm import quality_rules as QR
from quorumlake.llm import secret_scan as SS
from quorumlake.llm import sharding as SH
from quorumlake.llm import common as C
from quorumlake.llm.common import components, prefix_sums, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None), (None, "some text here", "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "b"), (4, long, "en", None), (5, "the same row", "en", "a"), (5, "the same row", "en", "a"), (6, "password = hunter22", "fr", "a")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


# --- helpers


def test_prefix_sums(spark):
    xs = list(range(1, 700))
    df = spark.createDataFrame([(xs,), ([],)], "xs array<long>")
    got = [r.s for r in df.select(prefix_sums(F.col("xs")).alias("s")).collect()]
    assert got == [list(itertools.accumulate([0, *xs[:-1]])), []]


def test_ranked_is_gapless_in_hot_groups(spark):
    df = spark.createDataFrame([(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 5}", i) for i in range(900)], "g string, id long")
    got = ranked(df, ["g"], [F.col("id")], "rank", group=["g"]).toPandas()
    assert len(got) == 900
    for _, part in got.groupby(got.g.fillna("-")):
        assert sorted(part["rank"]) == list(range(len(part)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}  # a root has no row


# --- 1


def test_lines_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(LD.SQL).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in LD.op1_line_dedup(spark, sf_dir).collect()}
    assert got == want


def test_line_spread_and_first_occurrence(spark):
    rows = [(i, f"own {i}\nshared line\nown again {i}", "en", f"s{i}") for i in range(5)] + [(9, "few\nshared line", "en", "s0")] + [(20 + i, "few", "en", "s1") for i in range(9)]
    got = {r.doc_id: r.text for r in LD.line_dedup(docs_of(spark, rows), min_sites=5).collect()}
    assert got[0] == "own 0\nshared line\nown again 0" and got[3] == "own 3\nown again 3" and got[9] == "few" and got[25] == "few"


def test_long_lines_need_fewer_sites_and_copies_count_once(spark):
    long = "a passage " * 20
    rows = [(i, f"own {i}\n{long}\nshort one", "en", f"s{i}") for i in range(4)]
    rows += [(10 + i, f"copied\n{long}\nonly here", "en", f"s{i}") for i in range(9)]  # one text on nine sites
    got = {r.doc_id: (r.text, r.n_removed) for r in LD.line_dedup(docs_of(spark, rows)).collect()}
    assert got[0] == (rows[0][1], 0) and got[3] == ("own 3\nshort one", 1)
    assert {got[10 + i] for i in range(9)} == {("copied\nonly here", 1)}  # copies stay copies


def test_estimates_near_the_threshold_are_counted_exactly(spark, monkeypatch):
    """With sketches of 16 registers the estimate is far off; the exact count decides inside its band of errors."""
    rows = [(100 * k + i, f"line number {k}\nown {k} {i}", "en", f"s{i}") for k in range(30) for i in range(28 + k % 4)]
    got = LD.line_dedup(docs_of(spark, rows), min_sites=30, lg_k=4).collect()
    for r in got:
        k, i = divmod(r.doc_id, 100)
        assert r.n_removed == (k % 4 >= 2 and i > 0), (k, i)


def clashing(df):
    """Columns with the names that operators use inside."""
    names = ["row", "doc", "body", "_doc", "_body", "_gone", "gone", "site", "id", "_id", "_p", "p", "_w", "_b", "w", "b", "h", "len", "first", "one", "of", "lead", "llr0", "_metadata", "_file", "a.b"]
    return df.withColumns({n: F.lit(n) for n in names}), names


def test_user_columns_keep_their_values(spark, odd, labels):
    df, names = clashing(odd)
    vec, _ = clashing(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>"))
    outs = [LD.line_dedup(df), QR.quality_rules(df, labels), LI.fit_and_identify(df), QC.quality_classifier(df, labels), ND.near_dedup(df), ND.near_unique(df), E.embedding_dedup(vec)]
    for out in outs:
        for r in out.collect():
            assert all(r[n] == n for n in names)
    assert MX.mix(df).count() == SS.secret_scan(df).count() == SH.shard_by_hilbert(df).count() == 8
    assert PK.pack(df, ordered=True).count() == PK.pack(odd).count()


def test_lines_odd(spark, odd, empty):
    got = LD.line_dedup(odd.withColumn("n_removed", F.lit(7)), min_sites=2).collect()
    assert len(got) == 8 and [r.text for r in got if r.doc_id == 1] == [None] and all(r.n_removed == 0 for r in got)
    assert LD.line_dedup(empty).count() == 0


# --- 2


def base_rules(s):
    s = s or ""
    w, seen, cover = WORDS.findall(s), {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(p for i in at for p in range(i, i + 8))
    lines = [x for x in s.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_against_python(spark, real, labels):
    docs, gold = real.toPandas(), labels.toPandas()
    got = QR.quality_rules(real, labels).toPandas().set_index("doc_id")
    B, prior = 1 << 15, 10.0
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    h1 = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed=seed)
    grams = {}
    for r in docs.itertuples():
        w = WORDS.findall(r.text)
        grams[r.doc_id] = [signed(h1(x)) % B for x in w] + [signed(h1(y, h1(x))) % B for x, y in zip(w, w[1:])]
    good = set(gold[gold.quality == 1].doc_id)
    raw, target = np.zeros(B), np.zeros(B)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(target, g, 1)
    share = target.sum() / raw.sum()
    w = np.array([round(QR.SCALE * x) for x in np.log((target + prior * share) / (target.sum() + prior * B * share)) - np.log((raw + prior) / (raw.sum() + prior * B))])
    for r in docs.itertuples():
        x = got.loc[r.doc_id]
        assert tuple(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base_rules(r.text)
        llr = w[grams[r.doc_id]].mean() / QR.SCALE if grams[r.doc_id] else 0.0
        assert abs(x.llr - llr) < 1e-6
        failed = x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words
        assert x.base_failed == failed and x.kept == (not failed and x.llr >= -0.1)


def test_quality_odd(spark, odd, empty, labels):
    got = QR.quality_rules(odd.withColumn("kept", F.lit("clash")), labels.limit(0)).collect()
    assert len(got) == 8 and {r.llr for r in got} == {0.0}
    assert [(r.n_words, r.kept) for r in got if r.doc_id in (1, 2, 3)] == [(0, False)] * 3
    assert [r.kept for r in got if r.doc_id == 4] == [True]
    assert QR.quality_rules(empty, labels).count() == 0


# --- 3

KINDS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def base_spans(s):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(KINDS) for m in p.finditer(s or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_secrets_against_python(spark):
    hexed = "0123456789abcdef" * 2
    texts = ["é password: abc123 secret=token:abcdef TOKEN = 'x1y2z3'", f"AKIA{'A1' * 9} {hexed}", f"token={hexed}", "api_key: short", None, "", "Api_Key=\"abc.def-ghi\" ApiKey:=abcdefg", "AKIAshort", "😀 secret = 12345678\n" * 600]
    texts += [f"example zZ9xY8wV7uT6sR5qP4oN3 {hexed[::-1]}"] * 4 + ["mine aB3dE5fG7hJ9kL1mN3pQ5"]
    df = docs_of(spark, [(i, t, "en", f"s{i}") for i, t in enumerate(texts)])
    for r in SS.secret_scan(df).collect():
        assert r.base == base_spans(texts[r.doc]), texts[r.doc]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(r.base.count(k) for k in ("assign", "access", "hex"))
        verdicts = {x.verdict for x in r.found}
        if 9 <= r.doc <= 12:
            assert verdicts == {"example"} and "loose" not in r.spans
        if r.doc == 13:
            assert verdicts == {"live"} and "loose:5:26" in r.spans


def test_verdicts_weigh_owners_and_repositories(spark):
    value = lambda k: f"zZ9xY8wV7uT6sR5qP4oN{k}"
    rows = [(i, f"here {value(1)}", "en", "one") for i in range(40)]  # many repositories of one owner: its own
    rows += [(100 + i, f"here {value(2)}", "en", f"s{i % 2}") for i in range(8)]  # two owners, eight repositories: copied
    rows += [(200 + i, f"here {value(3)}", "en", f"s{i % 2}") for i in range(4)]  # two owners, four repositories: live
    rows += [(300 + i, f"here {value(4)}", "en", f"s{i}") for i in range(3)] * 2  # three owners, repeated rows
    got = SS.secret_scan(docs_of(spark, rows)).collect()
    verdict = {r.doc // 100: {(x.verdict, x.owners, x.repos) for q in got if q.doc // 100 == r.doc // 100 for x in q.found} for r in got}
    assert verdict == {0: {("live", 1, 40)}, 1: set(), 2: {("live", 2, 4)}, 3: set()}


def test_secrets_in_a_dense_long_text(spark):
    text = "token=abcdef12 " * 5000 + "0123456789abcdef01234567 " * 2000
    r = SS.secret_scan(docs_of(spark, [(1, text, "en", "s")])).first()
    assert r.n_assign == 5000 and r.n_hex == 2000 and r.base == base_spans(text)


def test_secrets_query_shape(spark, sf_dir, odd, empty):
    r = SS.op3_secret_scan(spark, sf_dir).first()
    assert re.fullmatch("[0-9a-f]{64}", r.base_sha256)
    got = SS.secret_scan(odd).collect()
    assert len(got) == 8 and [x.spans for x in got if x.doc == 6] == ["assign:0:19"]
    assert SS.secret_scan(empty).count() == 0


# --- 4


def check_schedule(blocks, weights, size):
    """Every block inside its window in a slot of its own, in order; and while no source is exhausted, less than one block off at every slot."""
    slots = {}
    for part in MX.slices(blocks, weights, size):
        for source, block, phase, release, deadline, slot in MX.scheduled(part):
            assert release <= slot < deadline and slot not in slots
            slots[slot] = (source, block)
    assert sorted(slots) == list(range(sum(blocks)))
    seen, total = [0] * len(blocks), sum(Fraction(str(w)) for w in weights)
    share = [Fraction(str(w)) / total for w in weights]
    exhausted = False
    for t in range(len(slots)):
        source, block = slots[t]
        assert block == seen[source]
        seen[source] += 1
        exhausted = exhausted or any(n == b for n, b in zip(seen, blocks))
        if not exhausted:
            assert all(abs(n - w * (t + 1)) < 1 for n, w in zip(seen, share))


def test_schedules_in_slices_keep_every_window():
    random.seed(1)
    for _ in range(60):
        m = random.randint(1, 12)
        blocks = [random.choice([1, 3, 20, random.randint(1, 50)]) for _ in range(m)]
        weights = [random.choice([1, 2, 0.5, 0.001, 7, round(random.random(), 6)]) for _ in range(m)]
        for size in (1, 2, 7, 16, 1000):
            check_schedule(blocks, weights, size)


@pytest.mark.parametrize(("blocks", "weights", "size"), [([9] * 250, [1] * 250, 300), ([1 + i % 23 for i in range(260)], "size", 137), ([700, 1100, 3000], [0.123456789012345, 0.4, 7e-12], 64), ([2000, 3], [0.99999, 0.00001], 500)])
def test_many_sources_and_long_fractions(blocks, weights, size):
    check_schedule(blocks, blocks if weights == "size" else weights, size)


def test_shares_are_exact_beyond_a_million_slots():
    """Cuts of a long schedule are exact: what is given by them differs from the true weights by less than one block."""
    blocks, weights = [3_000_000, 2_000_000, 1_500_001, 77], [0.123, 0.456, 0.421, 0.0000001]
    total = sum(Fraction(str(w)) for w in weights)
    given = [0] * 4
    for part in itertools.takewhile(lambda p: p["phase"] == 0, MX.slices(blocks, weights)):
        for i, n in zip(part["source"], part["last"]):
            given[i] = n
        if part["end"] % MX.SLICE == 0:
            assert all(abs(n - Fraction(str(w)) / total * part["end"]) < 1 for n, w in zip(given, weights))
    assert max(given) > 1_600_000


def test_weights_must_be_positive(odd):
    for bad in (0, -1.0):
        with pytest.raises(ValueError):
            MX.mix(odd, {"a": 1.0, "b": bad})
    got = MX.mix(docs_of(odd.sparkSession, [(i, "t", "en", None if i % 2 else "") for i in range(40)]), {None: 3.0, "": 1.0}, block_rows=2).toPandas()
    first = got[got.slot < 12].drop_duplicates("slot")
    assert (first.source.isna().sum(), (first.source == "").sum()) == (9, 3)  # a null source is apart from ""


def test_mixing_places_every_row(spark):
    rows = [(i, f"t{i}", "en", None if i % 40 == 0 else "hot" if i % 3 else f"s{i % 4}") for i in range(1000)]
    got = MX.mix(docs_of(spark, rows), {"hot": 2.0, "s0": 1.0}, block_rows=7).toPandas().sort_values("position")
    assert list(got.position) == list(range(1000)) and ((got.slot >= got.release) & (got.slot < got.deadline)).all()
    blocks = got.drop_duplicates("slot")
    assert list(blocks.slot) == list(range(len(blocks)))
    assert (got.groupby("slot").source.nunique(dropna=False) == 1).all()


def test_mixing_odd(odd, empty):
    assert sorted(r.position for r in MX.mix(odd).collect()) == list(range(8))
    assert MX.mix(empty).count() == 0


def test_size_weights_last_to_the_end(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 == 0 else f"s{i % 10}") for i in range(6000)]
    got = MX.mix(docs_of(spark, rows), "size").toPandas().sort_values("position")
    assert list(got.position) == list(range(6000))
    share = got.source.value_counts(normalize=True)
    for part in np.array_split(got.source.to_numpy(), 6):  # the hot source never runs alone
        assert all(abs((part == s).mean() - share[s]) < 0.05 for s in share.index)


@pytest.mark.parametrize("weights", [None, "size", "sqrt", {"s1": 3.0, "hot": 2.0}])
def test_mixing_in_slices(spark, weights, monkeypatch):
    monkeypatch.setattr(MX, "SLICE", 32)
    monkeypatch.setattr(MX, "SLICES", 9)
    rows = [(i, f"t{i}", "en", "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i * i % 61}") for i in range(2000)]
    got = MX.mix(docs_of(spark, rows), weights, block_rows=4).toPandas().sort_values("position")
    assert sorted(got.doc_id) == list(range(2000)) and list(got.position) == list(range(2000))
    assert ((got.slot >= got.release) & (got.slot < got.deadline)).all() and got.slot.is_monotonic_increasing
    blocks = got.drop_duplicates("slot")
    assert list(blocks.slot) == list(range(len(blocks)))
    assert (got.groupby("slot").source.nunique(dropna=False) == 1).all()
    if weights == "size":
        hot = (blocks.source == "hot").to_numpy()
        assert np.abs(hot.cumsum() - hot.mean() * np.arange(1, len(hot) + 1)).max() < 1
    if weights == "sqrt":  # a target apart from the supply: the hot source, a third of all blocks, starts with a far smaller share
        first = blocks[blocks.phase == 0]
        assert (blocks.source == "hot").mean() > 0.3 > 0.2 > (first.source == "hot").mean() and blocks.phase.nunique() > 3


# --- 5


def shingles(s):
    w = [] if s is None else s.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(root), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in root}


def test_near_dedup_against_all_pairs(spark, real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    rng = np.random.default_rng(0)
    base = [f"x{i}" for i in range(120)]
    for k in range(60):  # mutants around the threshold
        w = list(base)
        for p in rng.choice(120, size=int(rng.integers(1, 9)), replace=False):
            w[p] = f"m{k}_{p}"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, "One two"), (20_001, "oNE  two"), (20_002, "one two three"), (20_003, ""), (20_004, None)]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    got = ND.near_dedup(df.withColumn("kept", F.lit(1))).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_sizes_and_odd(spark, sf_dir, real, odd, empty):
    got = {r.doc_id: r.n_shingles for r in ND.op5_setsketch_dedup(spark, sf_dir).collect()}
    assert got == {r.doc_id: len(shingles(r.text)) for r in real.collect()}
    out = ND.near_dedup(odd).collect()
    assert len(out) == 8 and [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, False)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id == 5] == [(5, True)] * 2
    assert ND.near_dedup(empty).count() == 0


def test_near_dedup_in_small_stars_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ND, "STAR", 4)
    monkeypatch.setattr(ND, "CHUNK", 8)
    monkeypatch.setattr(C, "HUB", 5)
    rng = np.random.default_rng(1)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(40):
            w = list(base)
            for p in rng.choice(100, size=int(rng.integers(0, 4)), replace=False):
                w[p] = f"m{g}_{k}_{p}"
            rows.append((1000 * g + k, " ".join(w)))
    got = ND.near_dedup(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(7, text("a")), (7, text("b")), (3, text("b") + " more"), (7, text("c")), (7, text("c") + " more"), (7, ""), (None, text("d")), (None, text("d")), (None, text("a")), (None, text("e")), (9, text("e") + " more"), (None, "")]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    got = {(r.doc_id, r.text): (r.component_id, r.kept) for r in ND.near_dedup(df).collect()}
    assert got[7, text("a")] == (7, True) and got[7, text("b")] == (3, False) and got[3, text("b") + " more"] == (3, True)
    assert [got[7, text("c") + x] for x in ("", " more")] == [(7, True)] * 2  # the contract: kept where the id is that of the component
    kept = [(r.doc_id, r.text) for r in ND.near_unique(df).collect()]
    want = {(7, text("a")), (3, text("b") + " more"), (7, ""), (None, text("d")), (9, text("e") + " more"), (None, "")}
    assert set(kept) - want < {(7, text("c")), (7, text("c") + " more")} and want < set(kept) and len(kept) == len(want) + 1


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.8, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        a = rng.integers(1 << 63, size=2 * n - both, dtype=np.uint64)
        x, y = a[:n], a[n - both :]
        ok, est = ND.may_link(np.array([n]), ND.registers(x)[None], np.array([n]), ND.registers(y)[None])
        assert abs(est[0] - j) < 0.15 and ok[0] == (j > 0.6)
    u, v = rng.integers(1 << 63, size=(2, 500), dtype=np.uint64)
    assert (np.maximum(ND.registers(u), ND.registers(v)) == ND.registers(np.concatenate([u, v]))).all()  # mergeable


# --- 6 and 7


def test_language_accuracy_and_odd(spark, sf_dir, real, odd, empty):
    got = LI.op6_language_id(spark, sf_dir).toPandas().merge(real.select("doc_id", "lang", "text").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out.to_numpy() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.8 and got.score.between(0, 1).all()
    out = LI.fit_and_identify(odd.withColumn("score", F.lit("x"))).collect()
    assert len(out) == 8 and {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    assert LI.fit_and_identify(empty).count() == 0


def test_language_against_plain_python(spark, real):
    """The query's predictions from the learned dictionaries, by a compressor a text and language, with ties and rejection."""
    import unicodedata

    import zstandard

    train = real.where(LI.fold(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("id"), "text", "lang")
    names, dicts = LI.learn_dictionaries(train, "text", "lang", [F.col("id"), F.col("text")], 64, 112_000, 64 << 20)
    assert sorted(names) == sorted({r.lang for r in train.where("lang is not null").select("lang").distinct().collect()})
    known = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in dicts]

    def sizes(text):
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
        body = " ".join(kept.split()).encode()
        make = lambda k: zstandard.ZstdCompressor(level=3, dict_data=k, write_content_size=False, write_checksum=False, write_dict_id=False)
        return [sum(len(make(k).compress(body[i : i + 2048])) for i in range(0, len(body), 2048)) for k in known]

    got = {r.doc_id: r for r in LI.fit_and_identify(real).collect()}
    for r in real.collect():
        x, s = got[r.doc_id], sizes(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert x.lang_pred == "und" and x.rejected
            continue
        best, second = sorted(s)[:2]
        assert x.lang_pred == names[s.index(best)] and abs(x.margin - (second - best) / second) < 1e-9
        assert x.rejected == ((second - best) / second < 0.01)
    tie = LI.language_id(docs_of(spark, [(1, "abc", None, None)]), ["xx", "yy"], [b"zzzzzzzz", b"zzzzzzzz"]).first()
    assert (tie.lang_pred, tie.margin, tie.rejected) == ("xx", 0.0, True)


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i % 600} text of lang{i % 600}", f"l{i % 600:03}", "s") for i in range(1200)]
    train = docs_of(spark, rows).select(F.col("doc_id").alias("id"), "text", "lang")
    names, dicts = LI.learn_dictionaries(train, "text", "lang", [F.col("id"), F.col("text")], 64, 112_000, 1 << 20)
    assert len(names) == 600 and sum(map(len, dicts)) <= 1 << 20


def test_language_labels_of_held_out_rows_do_not_matter(spark, real):
    held = LI.fold(F.col("doc_id"), 5) == 0
    other = real.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a, b = (LI.fit_and_identify(d).select("doc_id", "lang_pred").toPandas().sort_values("doc_id") for d in (real, other))
    assert a.lang_pred.tolist() == b.lang_pred.tolist()


def test_classifier(spark, odd, empty):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = QC.quality_classifier(real, labels)
    rows = got.toPandas()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    held = LI.fold(F.col("doc_id"), 3) == 1
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = QC.quality_classifier(real, other).toPandas()
    assert np.allclose(rows.sort_values("doc_id").score, again.sort_values("doc_id").score)
    assert (rows.held_out.to_numpy() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    gold = rows.merge(labels.toPandas(), on="doc_id")
    held = gold[gold.held_out]
    assert (held.predicted == held.quality).mean() > 0.85
    hi, lo = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert ((hi[:, None] > lo).mean() + 0.5 * (hi[:, None] == lo).mean()) > 0.9  # area under the curve
    model = QC.learn_quality(real, labels, "text", "doc_id", 3, 4000, 8000)
    texts = {r.doc_id: r.text or "" for r in real.collect()}
    plain = [1 / (1 + math.exp(-float(QC.features(texts[i]) @ model["w"] + model["b"]))) for i in rows.doc_id]
    assert np.allclose(rows.score, plain, atol=1e-4)
    twice = QC.quality_classifier(real.union(real), labels).toPandas()
    assert len(twice) == 2 * len(rows) and twice.groupby("doc_id").score.nunique().max() == 1
    out = QC.quality_classifier(odd, labels.limit(0)).collect()
    assert len(out) == 8 and {r.score for r in out} == {0.5}
    assert QC.quality_classifier(empty, labels).count() == 0


def test_nonnegative_risk_separates():
    rng = np.random.default_rng(1)
    xp = rng.normal(1, 1, (600, 4)).astype(np.float32)
    xu = np.vstack([rng.normal(1, 1, (700, 4)), rng.normal(-1, 1, (300, 4))]).astype(np.float32)
    m = QC.fit(xp.copy(), xu.copy(), lambda w, b: np.bincount(QC.bins_of(xu @ w + b), minlength=QC.BINS))
    assert 0.55 < m["prior"] < 0.9
    z = xu @ m["w"] + m["b"]
    assert ((z > 0) == (np.arange(1000) < 700)).mean() > 0.9


# --- 8


def test_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        c = {int(x): int(rng.integers(1, 9)) for x in rng.choice(30, 8, replace=False) + 1}
        lengths = sorted(c)
        padding = lambda bounds: sum(n * (min(b for b in bounds if b >= k) - k) for k, n in c.items())
        for k in (1, 2, 3, 9):
            best = min(padding((*p, lengths[-1])) for p in itertools.combinations(lengths[:-1], min(k, 8) - 1))
            assert padding(PK.best_bounds(c, k)) == best


def test_a_budget_below_the_bucket_gives_single_pieces(spark):
    got = PK.pack(docs_of(spark, [(i, "w " * 50, "en", "s") for i in range(4)]), max_len=64, budget=10).toPandas()
    assert sorted(got.batch) == [0, 1, 2, 3] and set(got.slot) == {0}


def test_packing_keeps_every_token(spark, real, odd, empty):
    for df in (real, odd):
        got = PK.pack(df, max_len=64, buckets=4, budget=512).toPandas()
        want = sorted(len(WORDS.findall(r.text or "")) for r in df.collect())
        full = got[got.n_tokens > 0]
        assert full.n_tokens.sum() == sum(want) and (got.n_tokens == 0).sum() == want.count(0)
        assert not full[["batch", "slot"]].duplicated().any() and (full.n_tokens <= full.bucket_len).all()
        assert (full.groupby("batch").bucket_len.agg(["nunique", "count"])["nunique"] == 1).all()
        assert (full.groupby("batch").bucket_len.sum() <= 512).all()
        assert sorted(full.batch.unique()) == list(range(full.batch.nunique()))
    assert PK.pack(empty).count() == 0


def test_packing_counts_tokenizer_ids(spark):
    files = pytest.importorskip("public_tokenizers")
    df = docs_of(spark, [(1, "hello world <|endoftext|>", "en", "s"), (2, None, "en", "s")])
    got = {r.doc_id: r.n_tokens for r in PK.pack(df, tokenizer_file=files.path("byte_bpe_50k.json")).collect()}
    assert got[1] > 3 and got[2] == 0


# --- 9


def brute_links(rows, cosine=0.95):
    ids, ok = [], {}
    for i, v in rows:
        ids.append(i)
        x = np.array([np.nan if c is None else c for c in v], dtype=float) if v else np.array([])
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            ok[i] = x / np.linalg.norm(x)
    n, root = dict.fromkeys(ids, 0), {i: i for i in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(ok), 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
            n[a] += 1
            n[b] += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (n[i], find(i)) for i in ids}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    for i in range(80):
        rows.append((200 + i, (np.array(rows[i % 9][1]) + rng.normal(size=16) * 0.18).tolist()))
    rows += [(400 + i, rows[3][1]) for i in range(40)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = E.embedding_dedup(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_large_runs_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.1).tolist()) for i in range(120)]
    got = E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)


def test_pairs_near_the_threshold_in_64_dimensions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64)) for i in range(400)]
    for i in range(400):  # partners at cosines around 0.95
        v = rows[i][1] / np.linalg.norm(rows[i][1])
        o = rng.normal(size=64)
        o -= (o @ v) * v
        c = rng.uniform(0.94, 0.97)
        rows.append((1000 + i, c * v + math.sqrt(1 - c * c) * o / np.linalg.norm(o)))
    rows = [(i, [float(x) for x in v.astype(np.float32)]) for i, v in rows]
    got = E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute_links(rows)
    assert sum(n for n, _ in want.values()) > 300
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_embeddings_odd(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.embedding_dedup(none).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in E.embedding_dedup(rows).collect()) == [(0, 0, False), (1, 0, True), (1, 0, True)]


# --- 10


def test_curve_steps_to_neighbours(spark):
    cells = spark.createDataFrame(list(itertools.product(range(8), repeat=3)), "x int, y int, z int")
    got = cells.select("*", SH.hilbert_index([F.col(c) for c in "xyz"], 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(512))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(got, got[1:]))


def test_shards_are_even_runs_of_the_curve(spark, sf_dir, real):
    got = SH.op10_hilbert_sharding(spark, sf_dir).toPandas().sort_values(["shard", "slot"])
    texts = {r.doc_id: (r.text or "").encode() for r in real.collect()}
    assert sorted(got.doc_id) == sorted(texts)
    assert (got["size"].to_numpy() == [len(texts[i]) + 1 for i in got.doc_id]).all() and (got.text_crc32.to_numpy() == [zlib.crc32(texts[i]) for i in got.doc_id]).all()
    n = got.groupby("shard").slot.agg(["min", "max", "count"])
    assert n["count"].max() - n["count"].min() <= 1 and (n["min"] == 0).all() and (n["max"] == n["count"] - 1).all()
    assert got.hilbert.is_monotonic_increasing and set(got.law) == {"rows"}


@pytest.mark.parametrize("n", [70, 10_000])
def test_axis_codes_follow_the_values(spark, n):
    df = spark.createDataFrame([(i, f"v{i * 7919 % n:05}") for i in range(n)] + [(-1, None)], "doc_id long, v string")
    got = SH.value_codes(df, "v").orderBy("v").collect()
    codes = [r._code_v for r in got]
    assert codes == sorted(codes) and codes[0] == 0 and max(codes) == 63 and len(set(codes)) == 64


def test_written_shards_prune(spark, tmp_path):
    """A filter on any dimension opens few shards by the files' statistics; shards by hash would all be opened."""
    import pyarrow.parquet as pq

    rows = [(i, "t" * int(2 ** (i * 37 % 14)), f"l{i * 31 % 40:02}", f"s{i * 17 % 90:02}") for i in range(6000)]
    SH.write_shards(SH.shard_by_hilbert(docs_of(spark, rows)), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("shard=*/*.parquet"))
    assert len(files) == 16
    spans = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        col = {meta.schema.column(j).name: [meta.row_group(g).column(j).statistics for g in range(meta.num_row_groups)] for j in range(meta.num_columns)}
        spans.append({c: (min(s.min for s in col[c]), max(s.max for s in col[c])) for c in ("lang", "source", "size")})
    for c, values in (("lang", [f"l{k:02}" for k in range(40)]), ("source", [f"s{k:02}" for k in range(90)]), ("size", [2**k + 1 for k in range(14)])):
        opened = [sum(a <= v <= b for a, b in (s[c] for s in spans)) for v in values]
        assert np.mean(opened) < 11, (c, np.mean(opened))
    both = [sum(s["lang"][0] <= f"l{k % 40:02}" <= s["lang"][1] and s["source"][0] <= f"s{k:02}" <= s["source"][1] for s in spans) for k in range(90)]
    assert np.mean(both) < 6


def test_shards_odd(spark, odd, empty):
    got = SH.shard_by_hilbert(odd, shards=3).toPandas()
    assert sorted(got.groupby("shard").size()) == [2, 3, 3]
    assert SH.shard_by_hilbert(empty).count() == 0
