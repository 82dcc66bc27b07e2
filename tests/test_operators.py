"""Hand fixtures for operators: golden cases and failing rows."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quorumlake.functions import phonetic as PH
from quorumlake.functions import text as T
from quorumlake.operators import consensus as C
from quorumlake.operators import intervals as I
from quorumlake.operators import joins as J
from quorumlake.operators import lineage as L
from quorumlake.operators import metrics as M
from quorumlake.operators import sampling as X
from quorumlake.operators import sets as U
from quorumlake.operators import signal as G
from quorumlake.operators import validate as V
from quorumlake.streaming import gate as R


def obs(spark, rows):
    return spark.createDataFrame([(c, m, t, u) for c, texts in rows.items() for m, (t, u) in enumerate(texts)], "clip_id string, model int, norm_text string, usable boolean")


def test_votes_keep_unknown_apart_from_negative(spark):
    cases = {"".join("p" if x else "n" for x in bits): [(("xx key " + "abc"[i]) if x else f"other {'abc'[i]}", True) for i, x in enumerate(bits)] for bits in itertools.product([True, False], repeat=3)}
    o = obs(spark, cases)
    words = spark.createDataFrame([("key",)], "keyword string")
    got = {r.clip_id: (r.status, r.target) for r in C.keyword_presence(o, C.strict_quorum(o, ["key"]), words).collect()}
    assert got.pop("ppp") == ("present", 1)
    assert set(got.values()) == {("unknown", None)}


def test_two_equal_texts_but_a_keyword_split_is_uncertain(spark):
    o = obs(spark, {"a": [("one key", True), ("one key", True), ("one", True)], "b": [("one", True), ("one", True), ("two", True)], "c": [("x", True)] * 3, "d": [("x", True), ("x", False), ("x", True)]})
    got = {r.clip_id: (r.tier, r.weight, r.reason) for r in C.strict_quorum(o, ["key"]).collect()}
    assert got == {"a": ("uncertain", 0.0, "keyword_split"), "b": ("two", 0.5, "majority"), "c": ("three", 1.0, "all_equal"), "d": ("uncertain", 0.0, "unusable")}


def test_two_merge_rules(spark):
    df = spark.createDataFrame([("p", 0, 5), ("p", 5, 8), ("p", 10, 12)], "k string, s long, e long")
    spans = lambda touching: sorted((r.s, r.e) for r in I.merge_intervals(df, ["k"], "s", "e", touching).collect())
    assert spans(True) == [(0, 8), (10, 12)]
    assert spans(False) == [(0, 5), (5, 8), (10, 12)]


def hops(spark, n, first, label=1, p=0.9):
    rows = [("c", 16_000 + 1280 * i, [1 - p, p, 0.0] if i >= first and label == 1 else [0.9, 0.1, 0.0]) for i in range(n)]
    return spark.createDataFrame(rows, "case_id string, sample long, probabilities array<double>")


def test_gate_confirms_blocks_and_warms_up(spark):
    got = sorted((r.sample - 16_000) // 1280 for r in R.gate_events(hops(spark, 33, 15)).collect())
    assert got == [17, 32]
    assert R.gate_events(hops(spark, 33, 15, p=0.79)).count() == 0


def test_exposure_plan_keeps_positive_draws(spark):
    rows = spark.createDataFrame([(f"{k}{f}{i}", f"f{f}", k) for k in ("positive", "ordinary", "near") for f in range(3) for i in range(4)], "id string, family string, kind string")
    plan = lambda near: X.exposure_plan(rows, {"positive": 100, "ordinary": 100 - near, "near": near}, "kind", "family", "id").collect()
    plans = {n: plan(n) for n in (0, 10, 20)}
    for n, p in plans.items():
        assert sorted(r.position for r in p) == list(range(200))
        assert sum(r["class"] == "near" for r in p) == n
    draws = lambda p: sorted((r.draw, r.id) for r in p if r["class"] == "positive")
    assert draws(plans[0]) == draws(plans[10]) == draws(plans[20])


def test_route_threshold_is_a_fifth(spark):
    df = spark.createDataFrame([("3" * 64,), ("3" * 63 + "4",)], "h string")
    assert [r.route for r in X.selective_route(df, [(F.lit(False), "never")], F.col("h")).orderBy("h").collect()] == ["sample", None]


def test_leaks_and_components(spark):
    df = spark.createDataFrame([(1, "train", "x", None), (2, "dev", "x", None), (3, "dev", None, "s"), (4, "dev", None, "s"), (5, "train", None, None)], "id int, role string, pcm string, speaker string")
    assert [(r.kind, r.value) for r in L.role_leaks(df, "role", {"pcm": "pcm", "speaker": "speaker"}).collect()] == [("pcm", "x")]
    comp = {r.id: r.component for r in L.identity_components(df, "id", {"pcm": "pcm", "speaker": "speaker"}).collect()}
    assert comp == {1: "1", 2: "1", 3: "3", 4: "3", 5: "5"}


def test_lineage_violations(spark):
    src = spark.createDataFrame([("a", "train", "g1"), ("b", "heldout", "g1"), ("c", "train", "g2"), ("d", "heldout", "g3")], "key string, role string, grp string")
    edges = spark.createDataFrame([("a", "b")], "left string, right string")
    none = spark.createDataFrame([], "key string")
    seen = spark.createDataFrame([("d",)], "key string")
    got = {r.key: r.violation for r in L.lineage_groups(src, edges, seen, none, "key", "role", "grp").collect()}
    assert got == {"a": "role_clash", "b": "role_clash", "c": None, "d": "exposed_not_train"}


def test_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    got = L.connected(edges, "a", "b")
    assert {r.component for r in got.collect()} == {0} and got.count() == 201


def test_text_forms(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(T.norm_reference, "the rapist") != one(T.norm_reference, "therapist")
    assert one(T.norm_reference, "你 好") == one(T.norm_reference, "你好") == "你好"
    assert one(T.norm_reference, "It’s  ＡＢＣ, ok!") == "it's abc ok"
    assert one(T.norm_compact, "Ａ b，c") == "Abc"
    assert one(lambda c: T.positions(T.characters(c), ["a", "a"]), "aaa") == [0, 1]
    assert one(lambda c: I.keyword_offsets(c, "aa"), "aaa") == [0]
    assert one(lambda c: I.keyword_context(c, "aa"), "aa") == "isolated"
    assert one(lambda c: I.rolling_hash(c), "ab") == 97 * 131 + 98
    assert one(lambda c: T.repetition(c), "aabbb") == 3


def test_phonetic_spans(spark):
    lex = spark.createDataFrame([("你", ["ni3"]), ("好", ["hao3", "hao4"]), ("号", ["hao4"])], "token string, readings array<string>")
    rows = spark.createDataFrame([("c", "好你号x")], "id string, text string")
    long = J.lexicon_lookup(rows, lex, "id", T.characters(F.col("text")))
    got = {(r["from"], r.size, r.distance) for r in PH.phonetic_spans(long, "id", [["ni3"], ["hao3"]], tones=True).collect()}
    assert (1, 2, 1) in got and (2, 2, 1) in got
    assert (1, 2, 0) in {(r["from"], r.size, r.distance) for r in PH.phonetic_spans(long, "id", [["ni3"], ["hao3"]], tones=False).collect()}


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 4.0)], "k string, x double")
    r = M.latency_summary(df, ["k"], "x").first()
    assert (r.p50, round(r.p95, 6)) == (2.0, 3.8)


def test_two_level_cap(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(5)] + [("t", 9, 9.0)], "src string, id int, p double")
    got = {r.id: r.state for r in I.capped(df, "src", [F.desc("p")], ["id"], 2, 2).collect()}
    assert got == {9: "SELECTED", 4: "SELECTED", 3: "EXCLUDED_GLOBAL_CAP", 2: "EXCLUDED_PER_SOURCE_CAP", 1: "EXCLUDED_PER_SOURCE_CAP", 0: "EXCLUDED_PER_SOURCE_CAP"}


def test_unknown_human_rows_are_in_no_denominator(spark):
    df = spark.createDataFrame([("m", 1, "positive", "positive"), ("m", 2, "negative", "positive"), ("m", 3, "positive", "unknown"), ("m", 4, "unknown", "negative")], "m string, id int, state string, human string")
    r = M.known_confusion(df, ["m"], "state", "human").first()
    assert (r.tp, r.fn, r.tn, r.fp, r.unknown_neg, r.recall, r.coverage) == (1, 1, 0, 0, 1, 0.5, 2 / 3)
    assert [tuple(x) for x in M.known_errors(df, ["m"], "state", "human", "id").collect()] == [("m", 2, "false_negative")]


def test_checks_fail_closed(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    with pytest.raises(V.ConstraintError):
        V.require_empty(V.duplicate_keys(df, ["k"]), "keys")
    assert V.broken_dependency(df, ["k"], ["v"]).collect()[0].k == "a"
    assert [r.reasons for r in V.rule_reasons(df, [(F.col("v") > 1, "small")]).collect()] == [["small"], [], ["small"]]
    with pytest.raises(PySparkException):
        J.checked_join(df.select("k").distinct(), df, ["k"]).collect()
    with pytest.raises(PySparkException):
        U.add_references(df, df, "k").collect()
    clock = spark.createDataFrame([("c", i, s) for i, s in enumerate([0, 10, 10, 40, 30])], "c string, seq int, s long")
    assert [r.fault for r in V.clock_faults(clock, "c", "s", 10, 0).orderBy("seq").collect()] == ["repeat", "gap", "order"]
    p = spark.createDataFrame([([0.5, 0.5, 0.0],), ([0.5, 0.6, 0.0],), ([1.0, float("nan"), 0.0],), ([1.0],), (None,)], "p array<double>")
    assert V.not_probabilities(p, "p").count() == 4
    assert V.incomplete_groups(spark.createDataFrame([("g", 1), ("g", 3), ("h", 1), ("h", 2)], "g string, c int"), "g", "c", [1, 2]).collect()[0].g == "g"


def test_missing_stays_a_row(spark):
    clips = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    models = spark.createDataFrame([(0,), (1,)], "model int")
    o = spark.createDataFrame([("a", 0, "ok")], "clip_id string, model int, status string")
    got = sorted((r.clip_id, r.model, r.status) for r in J.keep_missing(clips, models, o).collect())
    assert got == [("a", 0, "ok"), ("a", 1, "missing"), ("b", 0, "missing"), ("b", 1, "missing")]


def test_range_join_is_the_same_with_cells(spark):
    pts = spark.createDataFrame([("k", i * 7) for i in range(60)], "k string, t long")
    spans = spark.createDataFrame([("k", 5, 50), ("k", 49, 300), ("k", 400, 410)], "k string, a long, b long")
    plain = sorted((r.t, r.a) for r in J.range_join(pts, spans, "k", "t", "a", "b").collect())
    assert plain == sorted((r.t, r.a) for r in J.range_join(pts, spans, "k", "t", "a", "b", width=20).collect())


def test_registry_roles_never_change(spark):
    old = spark.createDataFrame([("z", 0, "train", "i")], "key string, ordinal long, role string, speaker_id string")
    more = spark.createDataFrame([("z",), ("a",), ("b",), ("c",)], "key string")
    got = {r.key: (r.ordinal, r.role) for r in L.extend_registry(old, more, "key").collect()}
    assert got == {"z": (0, "train"), "a": (1, "train"), "b": (2, "train"), "c": (3, "dev")}


def test_rank_fraction_against_pairs(spark):
    rows = [("k", float(x % 7), x % 3 == 0) for x in range(40)]
    df = spark.createDataFrame(rows, "k string, s double, pos boolean")
    pos, neg = [s for _, s, p in rows if p], [s for _, s, p in rows if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(M.rank_fraction(df, ["k"], "s", F.col("pos")).first().fraction - want) < 1e-12


def test_signal_jobs(spark):
    import numpy as np

    w = spark.createDataFrame([("c", [0.0] * 160 + [500.0] * 160 + [0.0] * 320 + [500.0] * 160)], "k string, x array<double>")
    r = G.silence(w, "k", "x").first()
    assert (r.lead_ms, r.tail_ms, r.inner_ms) == (10, 0, 20)
    q = G.quantise(spark.createDataFrame([("c", [1.5, -2.0, 0.5])], "k string, x array<double>"), "k", "x", least=1).first()
    assert (q.pcm, q.saturated) == ([32767, -32768, 16384], 2)
    d = G.sample_difference(spark.createDataFrame([("c", [1, 2, 3], [1, 9, 3, 4])], "k string, a array<int>, b array<int>"), "k", "a", "b").collect()
    assert sorted((x.start, x.end) for x in d) == [(1, 2), (3, 4)]
    logp = np.log(np.array([[0.2, 0.8], [0.6, 0.4], [0.1, 0.9]]))
    brute = sum(np.prod([np.exp(logp[t, s]) for t, s in enumerate(path)]) for path in itertools.product([0, 1], repeat=3) if [k for k, _ in itertools.groupby(path) if k] == [1])
    assert abs(np.exp(G.ctc_log_probability(logp, [1])) - brute) < 1e-12
    assert G.dtw(np.zeros((3, 2)), np.zeros((4, 2))) == 0
    mixed = G.mix_snr(spark.createDataFrame([("a", [100.0, -100.0], [10.0, 10.0], 20.0), ("b", [1.0], [], 0.0)], "k string, c array<double>, n array<double>, s double"), "k", "c", "n", "s").orderBy("k").collect()
    assert (mixed[0].pcm, mixed[1].reason) == ([110, -90], "noise_short")


def test_token_sequences_by_gap(spark):
    frames = spark.createDataFrame([("c", t, k) for t, k in [(0, 0), (10, 1), (20, 1), (30, 2), (70, 3), (80, 1)]], "case string, t long, token int")
    got = {(r.gap, r.first, r.second, r.third) for r in R.token_sequences(frames, "case", "t", "token", [20, 50]).collect()}
    assert got == {(50, 10, 30, 70)}


def test_normaliser_registry(spark):
    rows = spark.createDataFrame([("Ｏk then", "en"), ("Ｏk then", "en"), ("你 好!", "zh"), (None, "en")], "t string, lang string")
    got = {r.t: r.norm_text for r in T.normalised_dimension(rows, "t", "by_language", "lang").collect()}
    assert got == {"Ｏk then": "ok then", "你 好!": "你好"}
    assert T.normalised_dimension(rows, "t", "reference").count() == 2


def test_evidence_package_round_trip(spark, tmp_path):
    from quorumlake.sources import writers as O

    rows = spark.createDataFrame([("a", True, "x"), ("b", False, "y")], "clip_id string, accepted boolean, split string")
    O.write_exports(rows, {"all": F.lit(True), "machine_candidate": F.col("accepted")}, str(tmp_path / "out"), ["split"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.export_kind, r.clip_id) for r in back.collect()) == [("all", "a"), ("all", "b"), ("machine_candidate", "a")]
    O.write_flat_trace(rows, rows.limit(1), rows.agg(F.count("*").alias("n")), str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace/summary")).first().n == 2


def test_running_sums_and_quantiles_over_a_hot_key(spark):
    rows = [("hot" if i % 3 else None, i, float(i % 17)) for i in range(600)] + [("none", 600, None)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(7)
    got = {r.i: (r.at, r.n) for r in I.running(df, ["k"], ["i"], at=F.col("i"), n=F.lit(1)).collect()}
    seen = collections.defaultdict(lambda: (0, 0))
    for k, i, _ in rows:
        assert got[i] == seen[k]
        seen[k] = (seen[k][0] + i, seen[k][1] + 1)
    for r in M.latency_summary(df, ["k"], "x").collect():
        xs = [x for k, _, x in rows if k == r.k and x is not None]
        want = [float(np.quantile(xs, q)) for q in (0.5, 0.95, 0.99)] if xs else [None] * 3
        assert r.n == len(xs) and [r.p50, r.p95, r.p99] == (pytest.approx(want) if xs else want)


def test_hub_and_chain_components(spark, monkeypatch):
    monkeypatch.setattr(L, "HUB", 3)
    monkeypatch.setattr(L, "LOCAL", 0)
    edges = [("hub", f"n{i:03}") for i in range(300)] + [(f"n{i:03}", f"z{i:03}") for i in range(0, 300, 7)] + [("p", "p"), ("q", "r"), (None, "q")]
    got = {r.node: r.component for r in L.connected(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {got[n] for n in got if n not in "pqr"} == {"hub"} and (got["p"], got["q"], got["r"]) == ("p", "q", "q")
    assert len(got) == 1 + 300 + 43 + 3


def test_signal_odd_clips(spark):
    w = spark.createDataFrame([("empty", []), ("null", None), ("short", [0.5]), ("still", [0.0] * 320), ("ends", [0.0] * 160 + [1e3] * 160 + [0.0] * 160 + [1e3] * 160 + [0.0] * 320)], "k string, x array<double>")
    s = {r.k: (r.lead_ms, r.tail_ms, r.inner_ms) for r in G.silence(w, "k", "x").collect()}
    assert s == {"empty": (0, 0, 0), "null": (0, 0, 0), "short": (0, 0, 0), "still": (0, 0, 20), "ends": (10, 20, 10)}
    q = {r.k: (r.pcm, r.saturated, r.max_error) for r in G.quantise(w.where("k in ('empty', 'null', 'short')"), "k", "x", least=0).collect()}
    assert q == {"empty": ([], 0, 0.0), "null": (None, None, None), "short": ([16384], 0, 0.0)}
    pairs = [("both", [], None), ("tail", [1], [1, 2, 3]), ("null", [None, 1], [None, 2]), ("ends", [9, 1, 9], [1, 1, 1])]
    d = G.sample_difference(spark.createDataFrame(pairs, "k string, a array<int>, b array<int>"), "k", "a", "b").collect()
    assert sorted(map(tuple, d)) == [("ends", 0, 1), ("ends", 2, 3), ("null", 1, 2), ("tail", 1, 3)]
    mixes = [("loud", [32767.0, -1.0], [9.0, 9.0], 0.0), ("none", None, [1.0], 0.0), ("still", [0.0, 0.0], [1.0, 1.0], 0.0)]
    m = {r.k: (r.pcm, r.reason) for r in G.mix_snr(spark.createDataFrame(mixes, "k string, c array<double>, n array<double>, s double"), "k", "c", "n", "s").collect()}
    assert m == {"loud": (None, "no_headroom"), "none": (None, "silent"), "still": (None, "silent")}


def test_target_evidence_against_every_window(spark):
    """Brute force over all windows, with boundaries, unknown and ambiguous tokens, ties, an empty and a null text."""
    readings = {"a": ["xa1"], "b": ["xb1", "xa2"], "c": ["xc3"], "d": ["xd4", "xc3"], "e": ["xa1"]}
    lex = spark.createDataFrame(list(readings.items()), "token string, readings array<string>")
    rng, target = np.random.default_rng(5), "abc"
    texts = ["", None, "abc", "a,b c", "???", "zz", "z", "ebd", "abbc", "ac", "a-z-c", "ab", "bc", "é abc", " ", "aebdc" * 40]
    texts += ["".join(rng.choice(list("abcdez ,"), int(rng.integers(1, 25)))) for _ in range(150)]
    plain = lambda rs: {r[:-1] for r in rs}
    want_plain, want_toned = [plain(readings[c]) for c in target], [set(readings[c]) for c in target]

    def cost(window, same):
        row = list(range(len(target) + 1))
        for i, x in enumerate(window, 1):
            row, old = [i], row
            for j in range(1, len(target) + 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (not same(x, j - 1))))
        return row[-1]

    def brute(text):
        edge = lambda c: c in " ,-?"
        heard = lambda c, j: c not in readings or bool(plain(readings[c]) & want_plain[j])
        out, kept = [], [c for c in text if not edge(c)]
        for k in (2, 3, 4):
            for i in range(len(text) - k + 1):
                w = text[i:i + k]
                at = len([c for c in text[:i] if not edge(c)])
                if any(map(edge, w)):
                    continue
                if w != target and cost(w, lambda c, j: c == target[j]) <= 1:
                    out.append(("text", at, k, 1))
                if k == 3 and all(c in readings for c in w):
                    exact = all(set(readings[c]) & t for c, t in zip(w, want_toned))
                    apart = sum(not plain(readings[c]) & t for c, t in zip(w, want_plain))
                    if exact or apart <= 1:
                        out.append(("dictionary", at, k, 0 if exact else apart))
            out += [("local", i, k, cost(kept[i:i + k], heard)) for i in range(len(kept) - k + 1) if cost(kept[i:i + k], heard) <= 1]
        return sorted(out)

    clips = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = collections.defaultdict(list)
    for r in PH.evidence_spans(clips, lex, ["id"], "text", target).collect():
        got[r.id].append((r.kind, r.start, r.size, r.distance))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == brute(t or ""), t
    rows = {r.id: r for r in PH.target_evidence(clips, lex, ["id"], "text", target).collect()}
    assert len(rows) == len(texts) and [rows[i].state for i in (0, 1, 2, 3, 4, 5, 6)] == ["negative", "unknown", "positive", "unknown", "negative", "unknown", "unknown"]
    assert rows[3].boundary_separated and rows[5].blockers == ["insufficient_lexical_evidence", "confusable_or_partial_target"]
    assert rows[6].blockers == ["insufficient_lexical_evidence"]
    with pytest.raises(ValueError):
        PH.target_evidence(clips, lex, ["id"], "text", "az")


@pytest.mark.parametrize("quotas", [{"p": 5_000, "o": 4_500, "n": 500}, {"a": 1, "b": 1, "c": 9_998}, {"a": 3_333, "b": 3_333, "c": 3_334, "d": 0, "e": 1}, {c: 7 * i * i + 1 for i, c in enumerate("abcdefghij")}])
def test_schedule_in_slices_is_the_recurrence(spark, quotas):
    total, used, want = sum(quotas.values()), dict.fromkeys(quotas, 0), []
    for place in range(total):
        c = max((c for c in quotas if used[c] < quotas[c]), key=lambda c: quotas[c] * (place + 1) - used[c] * total)
        want.append((place, c, used[c]))
        used[c] += 1
    for rows in (97, total // 3):
        got = X.schedule(spark, quotas, rows)
        assert got.rdd.getNumPartitions() == -(-total // rows)
        assert sorted(map(tuple, got.collect())) == want


def test_schedule_of_a_million_draws(spark):
    quotas = {"positive": 333_333, "ordinary": 600_001, "near": 66_666}
    got = X.schedule(spark, quotas, 62_500).cache()
    assert got.rdd.getNumPartitions() == 16 and got.agg(F.count_distinct("position"), F.max("position")).first()[:] == (1_000_000, 999_999)
    assert {r["class"]: (r.n, r.top) for r in got.groupBy("class").agg(F.count("*").alias("n"), F.max("draw").alias("top")).collect()} == {c: (n, n - 1) for c, n in quotas.items()}
    off = F.max(F.abs(F.col("draw") - F.col("position") * F.when(F.col("class") == "positive", 333_333).when(F.col("class") == "ordinary", 600_001).otherwise(66_666) / 1_000_000))
    assert got.agg(off).first()[0] < 2
    assert X.schedule(spark, {}).count() == 0 and X.schedule(spark, {"a": 0}).count() == 0


def test_collapsed_path_and_its_sequences(spark):
    """One case holds nearly all frames; blanks part repeats, nulls are dropped with them."""
    rng = np.random.default_rng(3)
    cases = {1: [int(x) for x in rng.integers(0, 3, 5_000)], 2: [0, 0, 0], 3: [1, 1, 0, 1, 2, 1, 2, 1]}
    frames = spark.createDataFrame([(k, i * 10, v) for k, vs in cases.items() for i, v in enumerate(vs)], "case long, clock long, best int").repartition(5)
    path = I.collapsed(frames, "case", "clock", F.col("best"), [0])
    got, want = collections.defaultdict(list), {}
    for r in path.orderBy("case", "first").collect():
        got[r.case].append(r.value)
    for k, vs in cases.items():
        want[k] = [v for i, v in enumerate(vs) if v and (i == 0 or vs[i - 1] != v)]
    assert dict(got) == {k: v for k, v in want.items() if v}
    hits = {(r.case, r.start) for r in I.sequence_hits(path, "case", "first", "value", [1, 2, 1]).collect()}
    assert hits == {(k, i) for k, v in want.items() for i in range(len(v) - 2) if v[i:i + 3] == [1, 2, 1]}


def test_positions_in_a_long_text(spark):
    long = "orre " * 20_000
    rows = spark.createDataFrame([(long,), ("rr",), ("",), (None,), ("rrr",)], "t string")
    got = [r.at for r in rows.select(T.positions(T.characters(F.col("t")), ["r", "r"]).alias("at")).collect()]
    assert got == [list(range(1, 100_000, 5)), [0], [], None, [0, 1]]


def test_trailing_stacks_over_blocks(spark):
    """One recording with gaps and negative clocks, in blocks of any length; nulls part stacks."""
    rng = np.random.default_rng(8)
    clocks = [int(c) * 10 for c in range(-60, 300) if rng.random() < 0.93]
    rows = [("a", c, None if c == 500 else float(c)) for c in clocks] + [("b", c, float(c)) for c in range(0, 30, 10)]
    df = spark.createDataFrame(rows, "case string, clock long, v double").repartition(4)
    at = {k: {c: v for case, c, v in rows if case == k} for k in "ab"}
    want = {(k, c): [at[k][c - 10 * j] for j in range(3, -1, -1)] for k in "ab" for c in at[k] if all(at[k].get(c - 10 * j) is not None for j in range(4))}
    for block in (1, 5, 64, 4_096):
        got = [((r.case, r.clock), r.stack) for r in I.trailing_stack(df, "case", "clock", "v", 4, 10, block).collect()]
        assert len(got) == len(want) and dict(got) == want
