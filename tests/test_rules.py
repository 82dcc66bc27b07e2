"""Rules of single operators, hot keys over many ranges, and long texts."""

import collections
import hashlib
import itertools
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlake.functions import phonetic as PH
from quorumlake.functions import text as T
from quorumlake.operators import consensus as C
from quorumlake.operators import draws as D
from quorumlake.operators import intervals as I
from quorumlake.operators import joins as J
from quorumlake.operators import lineage as L
from quorumlake.operators import metrics as M
from quorumlake.operators import scan as S
from quorumlake.operators import signal as G
from quorumlake.operators import validate as V
from quorumlake.plans import jobs as P
from quorumlake.plans.base import utterances
from quorumlake.streaming import gate as R


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_any_tokens():
    random.seed(2)
    for _ in range(400):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 25))] for _ in range(2))
        assert T.edits(list(a), list(b)) == plain_distance(a, b)
    for n in (60, 90):  # more edits than diagonals are followed for
        a, b = ([random.choice("abcdefgh") for _ in range(n)] for _ in range(2))
        assert T.edits(list(a), list(b)) == plain_distance(a, b) > T.FEW_EDITS
    many = [f"token {i}" for i in range(70_000)]
    assert T.edits(list(many), [*many[:20_000], "x", *many[20_001:40_000], *many[40_003:]]) == 4


def test_long_sentences(spark):
    """100,000 characters without the last letter asked for; few and many edits in 33,000."""
    long = "anana orre " * 9_100
    df = spark.createDataFrame([(1, long), (2, "a.n.d"), (3, "dna"), (4, ""), (5, None)], "id int, t string")
    began = time.time()
    got = {r.id: r.x for r in df.select("id", T.contains_in_order(F.col("t"), "and").alias("x")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: None} and time.time() - began < 30
    rng = random.Random(4)
    words = [rng.choice(["orre", "an", "e", "the"]) for _ in range(6_600)]
    pairs = spark.createDataFrame([(words, [*words[:3000], "x", *words[3002:], "y"]), (words, words[::-1]), (None, words), ([], words)], "a array<string>, b array<string>")
    began = time.time()
    got = [r.d for r in pairs.select(T.token_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == 3 and got[1] > 1000 and got[2] is None and got[3] == 6_600 and time.time() - began < 60


def test_near_spans_of_a_long_text(spark):
    text = "nation tion tio xtion " * 400 + "tioon"
    df = spark.createDataFrame([("k", text), ("e", ""), ("n", None)], "k string, t string")
    want = {(i, text[i : i + n]) for n in (3, 4, 5) for i in range(len(text) - n + 1) if " " not in text[i : i + n] and plain_distance(text[i : i + n], "tion") <= 1}
    assert {(r.at, r.span) for r in T.near_spans(df, "k", "t", "tion").collect()} == want


def test_in_order_takes_any_character(spark):
    df = spark.createDataFrame([("a]x^y\n-z",), ("]a",), ("-^]",)], "t string")
    assert [r.x for r in df.select(T.contains_in_order(F.col("t"), "]^-").alias("x")).collect()] == [True, False, False]


# --- votes


def obs(spark, rows):
    return spark.createDataFrame([(c, m, t, u, k) for c, votes in rows.items() for m, t, u, k in votes], "clip_id string, model string, norm_text string, usable boolean, complete boolean")


def test_a_model_votes_once(spark):
    same = [("m1", "key word", True, True)] * 3
    three = [(m, "key word", True, True) for m in ("m1", "m2", "m3")]
    o = obs(spark, {"twice": same, "ok": three, "other": [*three[:2], ("m9", "key word", True, True)]})
    targets = spark.createDataFrame([(c, "key word") for c in ("twice", "ok", "other")], "clip_id string, target string")
    assert {r.clip_id: r.reason for r in C.strict_quorum(o, ["key"], roster=["m1", "m2", "m3"]).collect()} == {"twice": "model_roster", "ok": "all_equal", "other": "model_roster"}
    assert {r.clip_id: r.state for r in C.exact_screen(o, targets).collect()} == {"twice": "model_roster", "ok": "match", "other": "match"}


def test_intent_vetoes_in_order(spark):
    """One case a rule; each would be vetoed by a later rule too, or is accepted."""
    eq = lambda t, n=2: [("m1", t, True, True), ("m2", t, True, True), ("m3", t if n == 3 else "quite other", True, True)]
    rows = {
        "roster": eq("k")[:1] * 2, "failed": eq("key"), "quorum": [("m1", "a", True, True), ("m2", "b", True, True), ("m3", "c", True, True)], "flag": eq("none"), "unconfirmed": eq("no such"),
        "confirmed": eq("a key here", 3), "letters": [*eq("nothing")[:2], ("m3", "k..e..y", False, True)], "lost": [*eq("nothing")[:2], ("m3", "k..e..y", False, False)], "song": eq("plain"), "near": eq("plain"),
    }
    kind = {"failed": "positive", "flag": "positive", "unconfirmed": "positive", "confirmed": "positive", "song": "song"}
    intents = spark.createDataFrame([(c, kind.get(c, "near_miss"), "key", c != "failed", c in ("flag", "quorum")) for c in rows], "clip_id string, intent string, keyword string, generated boolean, flagged boolean")
    got = {r.clip_id: (r.reason, r.weight, r.target_0) for r in C.intent_quorum(obs(spark, rows), intents, ["key"]).collect()}
    no = lambda reason: (reason, 0.0, None)
    assert got == {
        "roster": no("model_roster"), "failed": no("generation_failed"), "quorum": no("no_quorum"), "flag": no("audio_flag"), "unconfirmed": no("positive_unconfirmed"), "confirmed": ("accepted", 1.0, 1),
        "letters": no("negative_has_path"), "lost": ("accepted", 0.5, 0), "song": no("unsupported_intent"), "near": ("accepted", 0.5, 0),
    }


# --- scans


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def union(spans, touching):
    out = []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] if touching else a < out[-1][1]):
            out[-1] = [out[-1][0], max(out[-1][1], b), out[-1][2] + 1]
        else:
            out.append([a, b, 1])
    return [tuple(x) for x in out]


def test_a_hot_key_over_many_ranges(spark, many_ranges):
    """One key has most rows, an interval of it reaches over several ranges; runs and sums go on from range to range."""
    random.seed(6)
    spans = {"hot": [(a, a + random.choice([0, 1, 5, 9])) for a in random.sample(range(20_000), 3000)] + [(4_000, 9_500), (9_500, 9_501)], None: [(1, 2), (2, 3)], "b": [(5, 6)]}
    df = spark.createDataFrame([(k, a, b) for k, xs in spans.items() for a, b in xs], "k string, s long, e long")
    sizes = [r.n for r in S.ranges(df, ["k"], ["s", "e"]).groupBy("_range").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 600  # no task reads the hot key
    for touching in (True, False):
        got = collections.defaultdict(list)
        for r in I.merge_intervals(df, ["k"], "s", "e", touching).collect():
            got[r.k].append((r.s, r.e, r.members))
        assert {k: sorted(v) for k, v in got.items()} == {k: union(v, touching) for k, v in spans.items()}
    values = [(i // 1500 if i < 6000 else i % 3) for i in range(8000)]
    frames = spark.createDataFrame([("hot", 10 * i, v, 1) for i, v in enumerate(values) if i != 700], "k string, t long, v int, one int")
    got = sorted((r.first, r.last, r.value, r.length) for r in I.runs(frames, ["k"], "t", F.col("v"), 10).collect())
    want = []
    for v, group in itertools.groupby([(i, v) for i, v in enumerate(values) if i != 700], key=lambda x: (x[1], x[0] > 700)):
        part = [i for i, _ in group]
        want.append((10 * part[0], 10 * part[-1], v[0], len(part)))
    assert got == sorted(want)
    got = S.running(frames, ["k"], ["t"], n=F.lit(1), s=F.col("v")).orderBy("t").collect()
    kept = [v for i, v in enumerate(values) if i != 700]
    assert [r.n for r in got] == list(range(7999)) and [r.s for r in got] == list(itertools.accumulate([0, *kept[:-1]]))
    faults = V.clock_faults(frames.withColumnRenamed("t", "sample"), "k", "sample", 10, 0).collect()
    assert [(r.sample, r.fault) for r in faults] == [(7010, "gap")]


def test_containment_of_all_in_all(spark):
    random.seed(8)
    spans = [(random.choice("ab"), a, a + random.choice([0, 1, 2, 7, 30, 64, 65, 900])) for a in [random.randint(-500, 2000) for _ in range(300)]]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "i int, k string, s long, e long")
    outer = df.select(F.col("i").alias("o"), "k", F.col("s").alias("os"), F.col("e").alias("oe"))
    got = collections.Counter((r.i, r.o) for r in J.contained(df, outer, "k", "s", "e", "os", "oe").collect())
    assert got == collections.Counter((i, o) for i, (k, s, e) in enumerate(spans) for o, (q, a, b) in enumerate(spans) if k == q and a <= s and e <= b)


def test_attribution_and_anchors(spark, many_ranges):
    random.seed(10)
    segs = [(c, f"{c}{i}", a, a + random.choice([3, 8, 20])) for c in ("x", "y") for i, a in enumerate(random.sample(range(400), 25))]
    points = [(c, t) for c in ("x", "y", "z", None) for t in range(0, 420, 3)] + [("x", None), ("x", 6), ("x", 6)]
    s, p = spark.createDataFrame(segs, "c string, seg string, a long, b long"), spark.createDataFrame(points, "c string, t long")
    hits = lambda c, t: [q for k, q, a, b in segs if c == k and t is not None and a <= t < b + 2]
    want = collections.Counter((c, t, h[0] if len(h) == 1 else None, len(h) > 1) for c, t in points for h in [hits(c, t)])
    got = collections.Counter((r.c, r.t, r.seg, r.ambiguous) for r in J.attribute_points(p, s, "c", "t", "seg", "a", "b", 2).collect())
    assert got == want
    rows = [("x", random.randint(0, 400)) for _ in range(120)]
    rows = [(c, t, t + random.randint(0, 4), t + random.randint(0, 9)) for c, t in rows]
    one = lambda c, t: (lambda h: h[0] if len(h) == 1 else None)(hits(c, t))
    want = collections.Counter((*r, one(r[0], r[1]) is not None and len({one(r[0], t) for t in r[1:]}) == 1, any(len(hits(r[0], t)) > 1 for t in r[1:])) for r in rows)
    got = J.anchor_origin(spark.createDataFrame(rows, "c string, t0 long, t1 long, t2 long"), ["t0", "t1", "t2"], s, "c", "seg", "a", "b", 2).collect()
    assert collections.Counter((r.c, r.t0, r.t1, r.t2, r.same, r.ambiguous) for r in got) == want and {r.same for r in got} == {True, False} and all(r.same != r.cross for r in got)


def test_mixed_layouts(spark):
    df = spark.createDataFrame([("c", f"n{i}", 0, 10 + i) for i in range(4)] + [("c", f"p{i}", 1, 20) for i in range(2)], "case string, name string, kind int, len long")
    order = lambda k: [(r.name, r.start) for r in I.mixed_layout(df, "case", "kind", "name", k, "len", 5, 0, 100).orderBy("start").collect()]
    assert order("mixed") == [("n0", 100), ("p0", 115), ("n1", 140), ("p1", 156), ("n2", 181), ("n3", 198)]
    assert [n for n, _ in order("reverse")] == ["n3", "n2", "p1", "n1", "p0", "n0"] and [n for n, _ in order("ordinary_only")] == ["n0", "n1", "n2", "n3"]


def test_layouts_write_no_text(spark, monkeypatch):
    """Layouts of clips shuffle and write names, kinds and lengths only."""
    from quorumlake.plans import queries as Q

    written, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    for q in (Q.w16_mixed_layouts, Q.w16_stream_layout):
        q(spark, "/root/testdata/sf0.001").collect()
    assert len(written) == 7 and not {"spoken", "pcm_sha256", "lang", "__turn", "_start"} & {c for cs in written for c in cs}


# --- draws, prefixes, gates


def drawn(key, tracks, length, salt, condition, gone):
    pool = sorted(t for t, n in tracks if n >= length and t not in gone)
    if not pool:
        return None, None
    h = hashlib.sha256("/".join(x for x in (salt, condition, str(key)) if x).encode()).hexdigest()
    track = pool[int(h[:16], 16) % len(pool)]
    return track, int(h[16:32], 16) % (dict(tracks)[track] - length + 1)


def test_draws_without_replacement(spark):
    random.seed(12)
    tracks = {r: [(f"{r}{i:03}", random.choice([10, 10, 50, 200, 1000])) for i in range(n)] for r, n in (("a", 37), ("b", 3), ("c", 1))}
    rows = [(i, random.choice(["a", "b", "c", "none"]), random.choice([1, 10, 11, 200, 1001])) for i in range(150)]
    rows = [(i, r, n, random.choice(tracks.get(r, [("?", 0)]))[0] if i % 3 else None) for i, r, n in rows]
    pool = spark.createDataFrame([(r, t, n) for r, ts in tracks.items() for t, n in ts], "role string, track string, frames int")
    df = spark.createDataFrame(rows, "id int, role string, len int, old string")
    got = {(r.id, r.condition): (r.track, r.offset, r.reason) for r in D.draw_conditions(df, pool, ["p", "q", "r"], "id", "role", "len", "track", "frames", "salt", "old").collect()}
    for i, role, n, old in rows:
        gone = {old}
        for c in ("p", "q", "r"):
            track, offset = drawn(i, tracks.get(role, []), n, "salt", c, gone)
            assert got[i, c] == (track, offset, None if track else "no_track_left")
            gone.add(track)
    got = {r.id: (r.track, r.offset) for r in D.draw_tracks(df, pool, "id", "role", "len", "track", "frames", "salt").collect()}
    assert got == {i: drawn(i, tracks.get(role, []), n, "salt", None, ()) for i, role, n, _ in rows}
    assert D.draw_tracks(df, pool.limit(0), "id", "role", "len", "track", "frames", "salt").where("reason = 'no_track_left'").count() == 150


def test_draws_take_four_bits_of_the_rank_a_sweep(spark, monkeypatch):
    """300 tracks are found in three sweeps, after three that rank them and count the eligible ones."""
    written, cut = [], S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: written.append(1) or cut(df))
    tracks = [(f"t{i:03}", 10 + i * 7919 % 311) for i in range(300)]
    pool = spark.createDataFrame([("a", *t) for t in tracks], "role string, track string, frames int")
    rows = spark.range(200).select("id", F.lit("a").alias("role"), (F.col("id") * 5 % 340).cast("int").alias("len"))
    got = {r.id: (r.track, r.offset) for r in D.draw_tracks(rows, pool, "id", "role", "len", "track", "frames", "salt").collect()}
    assert got == {i: drawn(i, tracks, i * 5 % 340, "salt", None, ()) for i in range(200)} and len(written) == 6


def test_prefix_that_covers_all_needs(spark):
    rows = [(1, "f1", "kw"), (2, "f1", "neg"), (3, "f2", "x"), (4, None, "kw"), (5, "f3", "x"), (6, "f1", "neg")]
    df = spark.createDataFrame(rows, "n int, fam string, kind string")
    cover = lambda first, most, fams=2: V.covering_prefix(df, "n", {"kw": (F.col("kind") == "kw", 2), "neg": (F.col("kind") == "neg", 1)}, "fam", fams, first, most).first()
    r = cover(3, 10)
    assert (r.kw_at, r.neg_at, r.families_at, r.smallest, r.kw_in_first, r.families_in_first, r.gaps) == (4, 2, 3, 4, 1, 2, ["MISSING_KW"])
    assert cover(4, 10).gaps == [] and cover(1, 3).smallest is None and cover(9, 10).gaps == ["OVER_BUDGET"]
    r = cover(6, 10, 4)
    assert (r.families_at, r.smallest, r.gaps) == (None, None, ["INSUFFICIENT_FAMILIES"])


def test_shared_gate(spark):
    arms = lambda **kw: spark.createDataFrame([("c", 2, 10.0, 5), ("t", kw.get("fa", 2), kw.get("h", 10.0), kw.get("sec", 5))], "arm string, false_alarms int, hours double, seconds int")
    words = lambda t: spark.createDataFrame([("c", "u", 3, 10), ("c", "v", 2, 8), *[("t", w, m, n) for w, m, n in t]], "arm string, word string, misses int, positives int")
    run = lambda a, t: M.shared_gate(a, words(t), "arm", "word", "c", "t", 0.3, {"seconds": 5.0}).first()
    good = [("u", 3, 10), ("v", 1, 8)]
    assert run(arms(), good).dominates and not run(arms(), [("u", 4, 10), ("v", 0, 8)]).dominates and not run(arms(), [("u", 3, 10), ("v", 2, 8)]).dominates
    assert not run(arms(fa=4), good).dominates and not run(arms(sec=6), good).dominates  # the gate, and the budget
    assert run(arms(h=11.0), good).faults == ["unequal_hours"] and run(arms(), [("u", 3, 10)]).faults == ["word_missing", "unequal_positives"]


def test_paired_gate_codes(spark):
    case = lambda cases: spark.createDataFrame(cases, "id int, cond string, hit boolean, wrong int")
    old = [(1, "clean", True, 0), (2, "noisy", False, 1), (3, "noisy", False, 0)]
    run = lambda new: P.paired_gate(case(old), case(new), ["id"], "cond", ["wrong"], ["noisy"], 1)
    assert {r.accepted for r in run([(1, "clean", True, 0), (2, "noisy", True, 1), (3, "noisy", False, 0)]).collect()} == {True}
    assert run([(1, "clean", False, 0), (2, "noisy", True, 1), (3, "noisy", False, 0)]).first().reasons == ["CLEAN_CASE_REGRESSION"]
    assert run([(1, "clean", True, 0), (2, "noisy", True, 2), (3, "noisy", False, 0)]).first().reasons == ["NOISY_NEW_EVENT_ERROR"]  # more errors in a case that was bad
    assert run([(1, "clean", True, 0), (2, "noisy", False, 1), (3, "noisy", False, 0)]).first().reasons == ["NO_MISS_RESCUED"]


def test_event_on_the_clip_start_is_a_prefix_event(spark):
    cases = spark.createDataFrame([("a", 1, 100, 200), ("n", 0, None, None)], "case_id string, weak_class int, clip_start long, clip_eof long")
    events = spark.createDataFrame([("a", 100, 1), ("a", 101, 1), ("n", 50, 1), ("n", 60, 2)], "case_id string, sample long, k int")
    got = {r.case_id: (r.prefix_events, r.matches, r.wrong_events, r.negative_events, r.missing) for r in R.evaluate_events(events, cases, "case_id", "sample", "k").collect()}
    assert got == {"a": (1, 1, 0, 0, False), "n": (0, 0, 0, 2, False)}


def test_audio_that_is_not_finite_is_refused(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("ok", [0.5, -2.0]), ("nan", [0.1, nan]), ("inf", [inf]), ("none", None), ("zero", [0.0]), ("empty", [])], "id string, x array<double>")
    got = {r.id: (r.reason, r.pcm, r.flags) for r in G.quantise(df, "id", "x", least=1).collect()}
    assert got == {"ok": (None, [16384, -32768], ["saturation"]), "nan": ("nonfinite", None, None), "inf": ("nonfinite", None, None), "none": ("no_audio", None, None), "zero": (None, [0], ["no_nonzero_samples"]), "empty": ("extent", None, None)}


def test_silence_against_the_loudest_frame(spark):
    frame = lambda v: [float(v)] * 4
    df = spark.createDataFrame([("gap", frame(500) + frame(5) * 3 + frame(400)), ("quiet", frame(99) * 3), ("edge", frame(1) + frame(1000) + frame(10) + [1.0])], "id string, x array<double>")
    got = {r.id: (r.lead_ms, r.tail_ms, r.inner_ms) for r in G.silence(df, "id", "x", rate=400).collect()}
    assert got == {"gap": (0, 0, 30), "quiet": (0, 0, 30), "edge": (10, 10, 0)}


def test_calls_between_bounds(spark):
    df = spark.createDataFrame([("tts", s) for s in ("started", "completed", "failed", "planned", None)] + [("asr", "completed")], "stage string, s string")
    got = {r.stage: (r.completed, r.failed, r.unknown, r.not_run, r.calls_at_least, r.calls_at_most) for r in M.ledger_counts(df, ["stage"], "s").collect()}
    assert got == {"tts": (1, 1, 1, 2, 2, 3), "asr": (1, 0, 0, 0, 1, 1)}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_components_in_one_task_equal_those_by_stars(spark, kind):
    random.seed(14)
    pairs = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    df = spark.createDataFrame(pairs, "a long, b long").select(*[F.col(c).cast(kind).alias(c) for c in "ab"])
    one, many = (sorted(map(tuple, L.stars(df, local=n).collect())) for n in (10**6, 0))
    assert one == many and len(one) > 60
    assert L.stars(df.limit(0)).count() == 0


def test_evidence_of_texts_shuffles_no_character(spark):
    """Spans, counts and doubts are found in the row of a text; so are near spans."""
    lex = spark.createDataFrame([(c, [f"x{c}1"]) for c in "abc"], "token string, readings array<string>")
    clips = spark.createDataFrame([(1, "a😀b c" * 2_000)], "id long, text string")
    for got in (PH.evidence_spans(clips, lex, ["id"], "text", "abc"), PH.target_evidence(clips, lex, ["id"], "text", "abc"), PH.target_doubt(clips, lex, "text", "abc", "doubt")):
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert PH.target_doubt(clips, lex, "text", "abc", "doubt").first().doubt


def test_ids_of_tokens_stay_in_their_row(spark):
    """No token is a row of its own; the ids are those of a join."""
    rows = spark.createDataFrame([(1, ["a", "b", "b", None, "z"]), (2, []), (3, None), (4, ["x", "y", "x"])], "k long, t array<string>")
    for words in ([], list("abxé"), [f"w{i}" for i in range(999)] + list("axy")):
        vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token string, id int")
        got = T.vocabulary_ids(rows, vocabulary, "k", F.col("t"))
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T._joined_ids(rows, vocabulary, "k", F.col("t")).select(got.columns).collect()))


def test_ids_are_looked_up_by_the_batch(spark):
    """No row carries the vocabulary, and letters of sentences are made once; tokens with one id repeat each other, null tokens and lists do not."""
    rows = spark.createDataFrame([(1, ["a", "b", "z", None, "é", "z", "b", "b"]), (2, None), (3, ["b", None, "b"])], "k long, t array<string>")
    vocabulary = spark.createDataFrame([("a", 7), ("b", 7), ("c", 1), ("z", None)], "token string, id int")
    got = T.vocabulary_ids(rows, vocabulary, "k", F.col("t"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.unsupported, r.ids, r.min_frames) for r in got.collect()) == [(1, ["z", "é"], [7, 7, None, None, None, None, 7, 7], 10), (3, [], [7, None, 7], 3)]
    assert utterances(spark, "/root/testdata/sf0.001").select("utt", "spoken")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_distance_of_texts_and_by_pieces(spark, monkeypatch):
    """Texts are compared by their characters without a list of them, in Arrow batches; pieces of a batch give what the whole gives."""
    random.seed(17)
    text = lambda: None if random.random() < 0.05 else "".join(random.choice("abé😀") for _ in range(random.randint(0, 12)))
    rows = [(i, a, text() if i % 2 or not a else a[:3] + "x" + a[4:]) for i, a in enumerate(text() for _ in range(400))]
    want = [None if a is None or b is None else plain_distance(a, b) for _, a, b in rows]
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", T.token_distance(F.col("a"), F.col("b")).alias("d"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString() and [r.d for r in got.orderBy("i").collect()] == want
    monkeypatch.setattr(T, "PIECE", 40)
    a, b = (pa.array([None if r[k] is None else list(r[k]) for r in rows], pa.list_(pa.string())) for k in (1, 2))
    cut = T._by_pieces(T._lengths(a) + T._lengths(b), lambda at, n: T._distances(a.slice(at, n), b.slice(at, n)))
    assert cut.to_pylist() == want


def test_phonetic_spans_with_the_number_of_tokens(spark):
    """With `of`, tokens that match nothing are not shuffled: one exchange, and the same spans."""
    words = spark.createDataFrame([(k, "the an tho x an".split()) for k in range(3)], "id long, t array<string>").select("id", F.size("t").alias("of"), F.posexplode("t").alias("pos", "token"))
    words = words.withColumn("readings", F.array("token"))
    got, want = (PH.phonetic_spans(w, "id", [["the"], ["an"]]) for w in (words, words.drop("of")))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 3


def test_normal_forms_hold_few_texts_in_python(spark):
    """Texts go through Python some at a time, not as a whole batch of objects."""
    texts = [None, "", "ﬁ ẞ", "é", "abC"] * 50
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).select("i", T.nfkc(F.col("t"), fold=True).alias("n"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString() and "pandas" not in T._normal_form.__code__.co_names
    assert [r.n for r in got.orderBy("i").collect()] == [None, "", "fi ss", "é", "abc"] * 50


def test_recogniser_scores_shuffle_no_text(spark):
    """P16 joins states with labels: texts are neither grouped nor written."""
    lex = spark.createDataFrame([(c, [f"x{c}1"]) for c in "abc"], "token string, readings array<string>")
    texts = ["abc", "ab c", "b", "???", None, "zzz"]
    obs = spark.createDataFrame([(i, 0, t, i != 2) for i, t in enumerate(texts)], "clip_id long, model int, norm_text string, usable boolean")
    human = spark.createDataFrame([(i, "positive" if i < 3 else "negative") for i in range(6)], "clip_id long, human string")
    got = P.recogniser_scores(obs, human, "abc", lex)
    r = got.first()
    assert (r.tp, r.fn, r.tn, r.fp, r.unknown_pos, r.unknown_neg) == (1, 0, 1, 0, 2, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "SortAggregate" not in plan


def test_review_queue_sorts_no_tokens(spark):
    texts = spark.createDataFrame([(1, ["a"], ["a"]), (2, ["a", "b"], ["c"])], "k long, target array<string>, heard array<string>")
    got = P.review_queue(texts, spark.createDataFrame([(1, 0), (2, 0)], "k long, difference int"), spark.createDataFrame([(1, 0), (2, 0)], "k long, flags int"), "k")
    assert "heard" not in got.columns and sorted((r.k, r.edit, r.number) for r in got.collect()) == [(1, 0, 2), (2, 2, 1)]
