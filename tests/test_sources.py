"""Readers and writers on files made here."""

import io
import json
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quorumlake.sources import readers as S
from quorumlake.sources import writers as O


def wav(samples, rate=16_000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.array(samples, dtype="<i2").tobytes())
    return out.getvalue()


def float_wav(xs):
    data = np.array(xs, dtype="<f4").tobytes()
    fmt = struct.pack("<HHIIHH", 3, 1, 16_000, 64_000, 4, 32)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_json_rows_fail_fast(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n')
    assert S.read_rows(spark, str(tmp_path / "a.jsonl"), "id int, t string").collect()[0].t == "x"
    (tmp_path / "b.jsonl").write_text('{"id": "no"}\n')
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        S.read_rows(spark, str(tmp_path / "b.jsonl"), "id int, t string").collect()


def test_document_rows(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"rows": [{"id": 1}, {"id": 2}]}))
    assert [(r.place, r.id) for r in S.read_document_rows(spark, str(tmp_path / "d.json"), "rows", "id: int").orderBy("place").collect()] == [(0, 1), (1, 2)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a.wav\t今 jin1 天 tian1\nb.wav\tx y\nb.wav\tz w\nbad\n")
    got = {(r.key, r.text, r.fault) for r in S.read_transcripts(spark, str(tmp_path / "t.txt"), "pairs").collect()}
    assert got == {("a.wav", "今天", None), ("b.wav", "x", "duplicate_key"), ("b.wav", "z", "duplicate_key"), ("bad", None, "bad_line")}


def test_wav_scan(spark, tmp_path):
    files = {"good.wav": wav([1, 2, 3]), "empty.wav": wav([]), "cut.wav": wav([1, 2, 3])[:-2], "nan.wav": float_wav([0.0, float("nan")]), "f.wav": float_wav([0.5])}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    got = {r.path.rsplit("/", 1)[1]: r for r in S.scan_wav(spark, str(tmp_path)).collect()}
    assert (got["good.wav"].frames, got["good.wav"].rate, got["good.wav"].fault, len(got["good.wav"].pcm_sha256)) == (3, 16_000, None, 64)
    assert (got["empty.wav"].fault, got["nan.wav"].fault, got["f.wav"].encoding) == ("empty", "not_finite", "float")
    assert got["cut.wav"].fault.startswith("unreadable")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/1.wav", b"one"), z.writestr("x/2.txt", b"two")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("3.wav")
        info.size = 5
        t.addfile(info, io.BytesIO(b"three"))
    (tmp_path / "c.zip").write_bytes(b"nonsense")
    got = {(r.archive.rsplit("/", 1)[1], r.member, r.bytes, r.fault is None) for r in S.scan_archives(spark, str(tmp_path), "*.wav").collect()}
    assert got == {("a.zip", "x/1.wav", 3, True), ("b.tar.gz", "3.wav", 5, True), ("c.zip", None, None, False)}


def test_traces_and_arrays(spark, tmp_path):
    # a hop written field by field: number, count and clock of each stage, then its floats
    def hop(i, ready, event, p, clock=None):
        out = b""
        for stage, count in ((1, 3104), (2, 2432), (3, 96), (4, 8)):
            head = [float(ready), float(event), 0.0, 0.0, 0.0, *p] if stage == 4 else [0.5] * count
            out += struct.pack("<IIQ", stage, count, clock or 16_000 + 1280 * i) + struct.pack(f"<{count}f", *head)
        return out

    none, p = [0.0] * 3, [0.5, 0.25, 0.25]
    good = b"EFFTR01\0" + b"".join(hop(i, i > 14, 2 * (i == 18), p if i > 14 else none) for i in range(20))
    bad = {"cut": good[:-3], "mark": b"X" + good[1:], "clock": b"EFFTR01\0" + hop(0, 0, 0, none, 17_000), "warm": b"EFFTR01\0" + hop(0, 0, 0, p), "ready": b"EFFTR01\0" + hop(0, 1, 0, p), "sum": good + hop(20, 1, 0, [0.5, 0.5, 0.5]), "nan": good + hop(20, 1, 0, [float("nan"), 0.5, 0.5]), "event": good + hop(20, 1, 3, p)}
    for name, data in {"a": good, "none": b"EFFTR01\0", **bad}.items():
        (tmp_path / f"{name}.trace").write_bytes(data)
    got = S.read_traces(spark, str(tmp_path)).orderBy("path", "sample").collect()
    faults = {r.path.rsplit("/", 1)[1][:-6]: r.fault for r in got if r.fault}
    assert faults == {"cut": "truncated", "mark": "bad_mark", "clock": "bad_clock", "warm": "bad_warm_up", "ready": "bad_ready", "sum": "bad_probabilities", "nan": "not_finite", "event": "bad_event"}
    assert [(r.sample, r.ready, r.event, r.probabilities) for r in got if not r.fault] == [(16_000 + 1280 * i, i > 14, 2 * (i == 18), p if i > 14 else none) for i in range(20)]
    assert S.write_trace([none] * 15 + [p] * 5, [0] * 18 + [2, 0])[-32:] == good[-32:]
    np.savez(tmp_path / "x.npz", m=np.arange(6).reshape(2, 3))
    assert [r["values"] for r in S.read_arrays(spark, str(tmp_path)).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_digest_ignores_order_and_sees_changes(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i) if i else None) for i in range(50)], "a int, b string")
    d = O.table_digest(df).first().digest
    assert d == O.table_digest(df.orderBy(df.a.desc()).select("b", "a")).first().digest
    assert d != O.table_digest(df.where("a < 49").union(df.where("a = 48"))).first().digest
    df.write.json(str(tmp_path / "out"))
    m = O.manifest_summary(O.manifest(spark, str(tmp_path / "out"))).first()
    assert m.files >= 1 and m.bytes > 0 and len(m.digest) == 64


def test_traces_of_more_than_two_gigabytes_in_one_partition(spark):
    """A task's traces together exceed any buffer; each is made, passed on and read alone."""
    p = F.array_repeat(F.array(*[F.lit(x) for x in (0.5, 0.25, 0.25)]), 66)
    files = S.trace_files(spark.range(0, 1500, 1, 1).select(F.concat(F.lit("t"), "id").alias("path"), p.alias("probabilities")))
    r = files.agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("bytes")).first()
    assert (r.n, r.bytes) == (1500, 1500 * (8 + 66 * S.TRACE_RECORD.itemsize))
    S.register_trace_hops(spark)
    got = spark.sql("SELECT h.ready, count(*) AS n, max(h.sample) AS last FROM {f} f, LATERAL trace_hops(f.content) h GROUP BY 1", f=files.limit(20))
    assert {(r.ready, r.n, r.last) for r in got.collect()} == {(False, 300, 16_000 + 1280 * 14), (True, 1020, 16_000 + 1280 * 65)}
