"""Streams in several micro-batches, with rows out of order, equal the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from quorumlake.operators import intervals as I
from quorumlake.streaming import gate as R
from quorumlake.streaming import streams as S

STORE = "spark.sql.streaming.stateStore.providerClass"
AT = "timestamp_micros(1700000000000000 + cast(sample * 1000000 / 16000 as bigint)) as at"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STORE)


def write_files(df, path, parts):
    """Rows as files that are read one a micro-batch: each row in the file of its number in parts."""
    for k in sorted(set(parts)):
        df.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(path))


def disordered(rows, kinds, spark, clock, files=6, near=8):
    """Rows in files by their clock, but each up to `near` places off; a far row of another key ends the stream."""
    random.seed(7)
    order = sorted(rows, key=lambda r: r[clock])
    shuffled = [r for _, r in sorted((i + random.uniform(-near, near), r) for i, r in enumerate(order))]
    parts = [i * files // len(shuffled) for i in range(len(shuffled))]
    return spark.createDataFrame([(*r, p) for r, p in zip(shuffled, parts)], f"{kinds}, part int"), parts


def run(stream, tmp_path, name, spark):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    return progress


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def score_rows(spark):
    random.seed(3)
    rows, end = [], 0
    for c in "abc":
        for i in range(60):
            p = random.choice([0.1, 0.85, 0.9, 0.95])
            k = random.choice([1, 1, 2])
            rows.append((c, 1280 * (i + 1), [1 - p, p, 0.0] if k == 1 else [1 - p, 0.0, p]))
            end = 1280 * (i + 1)
    return rows, end


POLICY = R.GatePolicy(confirmations=2, block_samples=3_840, warm_hops=3)


def test_gate_in_any_order_with_a_restart(spark, tmp_path):
    rows, end = score_rows(spark)
    df, parts = disordered(rows, "case_id string, sample long, probabilities array<double>", spark, 1)
    df = df.selectExpr("case_id", "sample", "probabilities", AT, "part")
    want = {tuple(r) for r in R.gate_events(df.drop("part", "at"), policy=POLICY).collect()}
    plain = df.drop("part")
    stream = lambda: S.gate_stream(source(spark, plain, tmp_path / "in"), delay="1 second", policy=POLICY)
    write_files(df.where("part < 3"), tmp_path / "in", [p for p in parts if p < 3])
    run(stream(), tmp_path, "out", spark)
    early = spark.read.parquet(str(tmp_path / "out")).count()
    write_files(df.where("part >= 3"), tmp_path / "in", [p for p in parts if p >= 3])
    far = spark.createDataFrame([("z", 10**9, [1.0, 0.0, 0.0])], "case_id string, sample long, probabilities array<double>").selectExpr("*", AT)
    far.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    progress = run(stream(), tmp_path, "out", spark)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert want and 0 < early < len(got) and sorted(got) == sorted(want)  # each event once, over the restart too
    assert progress["stateOperators"][0]["numRowsTotal"] <= 4  # of the far row only


def test_sequences_in_any_order(spark, tmp_path):
    random.seed(5)
    rows = [(c, 1280 * (i + 1), random.choice([0, 1, 1, 2, 3])) for c in "ab" for i in range(90)]
    df, parts = disordered(rows, "case_id string, sample long, token int", spark, 1)
    df = df.selectExpr("case_id", "sample", "token", AT, "part")
    gaps = [1_280, 3_840, 12_800]
    want = sorted(tuple(r) for r in R.token_sequences(df, "case_id", "sample", "token", gaps).collect())
    write_files(df, tmp_path / "in", parts)
    spark.createDataFrame([("z", 10**9, 0)], "case_id string, sample long, token int").selectExpr("*", AT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(S.sequence_stream(source(spark, df.drop("part"), tmp_path / "in"), "sample", "token", gaps, delay="3 seconds"), tmp_path, "out", spark)
    assert want and sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_claims_in_any_order_and_twice(spark, tmp_path):
    random.seed(9)
    rows = []
    for slot in range(12):
        states = {0: ["started", "completed"], 1: ["completed"], 2: ["started", "started", "failed"], 3: ["planned"], 4: ["planned", "started"]}[slot % 5]
        rows += [(slot, 16_000 * (slot + 3 * i), 10 * slot + i, s) for i, s in enumerate(states)]
    rows += random.sample(rows, 8)
    df, parts = disordered(rows, "slot int, sample long, record long, state string", spark, 1, near=2)
    df = df.selectExpr("slot", "record", "state", AT, "part")
    want = {r.slot: (r.state, r.attempts, r.consumed, set(r.faults)) for r in R.claim_state(df, "slot", "record", "state").collect()}
    write_files(df, tmp_path / "in", parts)
    spark.createDataFrame([(99, 10**9, 0, "planned")], "slot int, sample long, record long, state string").selectExpr("slot", "record", "state", AT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(S.claim_stream(source(spark, df.drop("part"), tmp_path / "in"), delay="10 seconds"), tmp_path, "out", spark)
    got, faults = {}, {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.record):
        faults.setdefault(r.slot, set()).update([r.fault] if r.fault else [])
        got[r.slot] = (r.state, r.attempts, r.consumed, faults[r.slot])
    assert got == want and any(x[3] for x in want.values())


def test_claims_form_a_prefix(spark):
    plan = spark.createDataFrame([(s, i) for i, s in enumerate("abcde")], "slot string, position int")
    log = spark.createDataFrame([("a", 1, "started"), ("a", 2, "completed"), ("b", 3, "started"), ("d", 4, "started"), ("x", 5, "started")], "slot string, record long, state string")
    got = {r.slot: (r.state, r.fault) for r in R.attempted_prefix(plan, R.claim_state(log, "slot", "record", "state"), "slot", "position").collect()}
    assert got == {"a": ("completed", None), "b": ("unknown", None), "c": ("not_run", None), "d": ("unknown", "claim_after_gap"), "e": ("not_run", None), "x": ("unknown", "unplanned")}


def test_matches_of_two_streams(spark, tmp_path):
    """Prefix, wrong, early, late, extra, missing and negative events; clips without any event."""
    clips, events = [], []
    for i in range(14):
        start, eof = 320_000 * i + 16_000, 320_000 * i + 48_000
        clips.append((f"c{i}", i % 3, start, eof))
        offsets = [[], [(-32_000, 1)], [(1_000, 1)], [(1_000, 2), (2_000, 1)], [(100, 1)], [(17_000, 1)], [(128, 1), (16_000, 1)]][i % 7]
        events += [(f"c{i}", eof + o, k) for o, k in offsets]
    ended = "timestamp_micros(1700000000000000 + cast(clip_eof * 1000000 / 16000 as bigint)) as ended_at"
    c = spark.createDataFrame(clips, "case_id string, weak_class int, clip_start long, clip_eof long")
    want = {tuple(r) for r in R.windowed_match(spark.createDataFrame(events, "case_id string, sample long, event_class int"), c, "case_id", "sample", "event_class").select("case_id", "events", "prefix_events", "matches", "early_events", "late_events", "wrong_events", "negative_events", "extra_events", "missing", "error").collect()}
    e, parts = disordered(events, "case_id string, sample long, event_class int", spark, 1, near=1)
    e = e.selectExpr("case_id", "sample", "event_class", AT, "part")
    write_files(e, tmp_path / "events", parts)
    cs, cparts = disordered(clips, "case_id string, weak_class int, clip_start long, clip_eof long", spark, 3, near=1)
    cs = cs.selectExpr("case_id", "weak_class", "clip_start", "clip_eof", ended, "part")
    write_files(cs, tmp_path / "clips", cparts)
    for shift in (0, 1):
        spark.createDataFrame([("z", 10**9 + shift, 1)], "case_id string, sample long, event_class int").selectExpr("*", AT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        spark.createDataFrame([("z", 1, 10**9, 10**9 + shift)], "case_id string, weak_class int, clip_start long, clip_eof long").selectExpr("*", ended).coalesce(1).write.mode("append").parquet(str(tmp_path / "clips"))
    stream = S.match_stream(source(spark, e.drop("part"), tmp_path / "events"), source(spark, cs.drop("part"), tmp_path / "clips"), delay="60 seconds")
    run(stream, tmp_path, "out", spark)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("case_id <> 'z'").select("case_id", "events", "prefix_events", "matches", "early_events", "late_events", "wrong_events", "negative_events", "extra_events", "missing", "error").collect()}
    assert got == want and len(want) == 14


def test_mined_windows_are_closed_by_the_watermark(spark, tmp_path):
    """Overlap is transitive and strict: windows that only touch stay apart."""
    random.seed(8)
    rows = [(c, 1280 * i, random.choice([0.2, 0.96, 0.98, 0.3, 0.1])) for c in "ab" for i in range(3, 80)] + [("t", s, 0.99) for s in (6_400, 12_800, 19_199)]
    df, parts = disordered(rows, "case_id string, sample long, p double", spark, 1)
    df = df.selectExpr("case_id", "sample", "p", AT, "part")
    seeds = df.where("p >= 0.95")
    want = {(r.case_id, r.start, r.end, r.members) for r in I.candidate_windows(seeds, "case_id", "sample", F.lit(10**9), 3_200, 3_200).collect()}
    write_files(df, tmp_path / "in", parts)
    for shift in (0, 10**6):
        spark.createDataFrame([("z", 10**9 + shift, 0.99)], "case_id string, sample long, p double").selectExpr("*", AT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(S.mined_windows(source(spark, df.drop("part"), tmp_path / "in"), F.col("p"), 0.95, delay="3 seconds"), tmp_path, "out", spark)
    got = {(r.case_id, r.start, r.end, r.seeds) for r in spark.read.parquet(str(tmp_path / "out")).where("case_id <> 'z'").collect()}
    assert got == want and {(r[1], r[3]) for r in got if r[0] == "t"} == {(3_200, 1), (9_600, 2)}
