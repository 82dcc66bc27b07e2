"""Readers: record files, transcripts, audio, archives, score traces and numeric arrays, each as a table."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import struct
import tarfile
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO1: JSON lines with an explicit schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document_rows(spark: SparkSession, path: str, field: str, row_schema: str) -> DataFrame:
    """IO2: documents that hold an array of rows, flattened, with the file and the place in the array."""
    docs = spark.read.schema(f"{field} array<struct<{row_schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select(F.col("_metadata.file_name").alias("file"), F.posexplode(field).alias("place", "row")).select("file", "place", "row.*")


def read_transcripts(spark: SparkSession, path: str, layout: str = "plain") -> DataFrame:
    """IO3: key<TAB>text lines. layout `pairs`: tokens alternate character and reading, and only the characters stay.

    Adds `fault`: bad_line, empty_text or duplicate_key; null for a good row.
    """
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("key"), F.get(parts, 1).alias("raw"))
    pairs = F.array_join(F.filter(F.split(F.trim("raw"), r"\s+"), lambda x, i: i % 2 == 0), "")
    rows = rows.withColumn("text", pairs if layout == "pairs" else F.trim("raw"))
    twice = rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    fault = F.when(F.col("raw").isNull() | (F.col("key") == ""), "bad_line").when(F.col("text") == "", "empty_text").when(F.col("_n").isNotNull(), "duplicate_key")
    return rows.join(twice, "key", "left").select("key", "text", fault.alias("fault"))


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content")


def riff_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of a RIFF/WAVE file; raises where it is truncated."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > len(data):
            raise ValueError("truncated chunk")
        yield name, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def wav_row(data: bytes) -> dict:
    """Header fields, PCM digest and fault of one WAV file (16-bit PCM or 32-bit float)."""
    out = {"rate": None, "channels": None, "width": None, "encoding": None, "frames": None, "pcm_sha256": None, "fault": None}
    try:
        chunks = dict(riff_chunks(data))
        tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
        pcm = chunks[b"data"]
        if tag == 0xFFFE:
            tag = struct.unpack_from("<H", chunks[b"fmt "], 24)[0]
        out |= {"rate": rate, "channels": channels, "width": bits // 8, "encoding": {1: "pcm", 3: "float"}.get(tag, "other"), "frames": len(pcm) // max(block, 1), "pcm_sha256": hashlib.sha256(pcm).hexdigest()}
        if not pcm:
            out["fault"] = "empty"
        elif len(pcm) % max(block, 1):
            out["fault"] = "partial_frame"
        elif tag == 3 and not np.isfinite(np.frombuffer(pcm, dtype="<f4")).all():
            out["fault"] = "not_finite"
    except (ValueError, KeyError, struct.error) as e:
        out["fault"] = f"unreadable: {e}"
    return out


def wav_bytes(samples: list[int], rate: int = 16_000) -> bytes:
    """A mono 16-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.array(samples, dtype="<i2").tobytes())
    return out.getvalue()


def wav_table(files: DataFrame) -> DataFrame:
    """IO4, IO5: a row for each WAV file of (path, content): path, bytes, file and PCM digests, header fields and fault."""
    names = ["path", "bytes", "file_sha256", "rate", "channels", "width", "encoding", "frames", "pcm_sha256", "fault"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p, "bytes": len(c), "file_sha256": hashlib.sha256(c).hexdigest()} | wav_row(bytes(c)) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return files.select("path", "content").mapInPandas(run, "path string, bytes long, file_sha256 string, rate int, channels int, width int, encoding string, frames long, pcm_sha256 string, fault string")


def scan_wav(spark: SparkSession, path: str, glob: str | None = "*.wav") -> DataFrame:
    """IO4, IO5: the table of the WAV files under a folder; each file is read once."""
    return wav_table(_files(spark, path, glob))


def scan_archives(spark: SparkSession, path: str, pattern: str = "*", glob: str | None = None, keep_content: bool = True) -> DataFrame:
    """IO6: a row for each file member of zip and tar archives whose name matches: archive, member, bytes, digest, content and fault."""

    def members(name: str, data: bytes) -> Iterator[tuple]:
        try:
            if zipfile.is_zipfile(io.BytesIO(data)):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, pattern))
            else:
                with tarfile.open(fileobj=io.BytesIO(data)) as t:
                    yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile() and fnmatch.fnmatch(m.name, pattern))
        except (zipfile.BadZipFile, tarfile.TarError, EOFError) as e:
            yield None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows = [(p, m, None, None, None, d) if m is None else (p, m, len(d), hashlib.sha256(d).hexdigest(), d if keep_content else None, None) for m, d in members(p, bytes(c))]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "sha256", "content", "fault"]).astype({"bytes": "Int64"})

    return _files(spark, path, glob).mapInPandas(run, "archive string, member string, bytes long, sha256 string, content binary, fault string")


# A trace is this mark, then for each hop four stages of so many 32-bit floats; a stage starts with its number,
# its count and the clock, which is 16,000 at the first hop and 1,280 more at each next one.
TRACE_MARK = b"EFFTR01\0"
TRACE_STAGES = {1: 3104, 2: 2432, 3: 96, 4: 8}
TRACE_FIRST, TRACE_HOP, TRACE_WARM = 16_000, 1_280, 15

#: One hop of a trace as it lies in the file.
TRACE_RECORD = np.dtype([(f"{name}{k}", kind, shape) for k, n in TRACE_STAGES.items() for name, kind, shape in (("stage", "<u4", ()), ("count", "<u4", ()), ("clock", "<u8", ()), ("values", "<f4", (n,)))])


def trace_chunks(data: bytes, size: int = 4096) -> Iterator[tuple[int, np.ndarray]]:
    """The records of a trace, some at a time, with the number of the first one."""
    r = np.frombuffer(data, dtype=TRACE_RECORD, offset=8)
    for at in range(0, len(r), size):
        yield at, r[at : at + size]


def trace_fault(data: bytes) -> str | None:
    """The first fault of a trace, if it has one. The last stage holds the ready flag, the event, three logits and three probabilities; all but the flag
    are zero in the warm-up."""
    if data[:8] != TRACE_MARK:
        return "bad_mark"
    if (len(data) - 8) % TRACE_RECORD.itemsize:
        return "truncated"
    good: dict[str, bool] = {}
    for at, r in trace_chunks(data):
        clock = TRACE_FIRST + TRACE_HOP * np.arange(at, at + len(r), dtype=np.uint64)
        head = r["values4"]
        ready, event, p = head[:, 0], head[:, 1], head[:, 5:8]
        warm = np.arange(at, at + len(r)) < TRACE_WARM
        checks = {
            "bad_stage": all((r[f"stage{k}"] == k).all() and (r[f"count{k}"] == n).all() for k, n in TRACE_STAGES.items()),
            "bad_clock": all((r[f"clock{k}"] == clock).all() for k in TRACE_STAGES),
            "not_finite": all(np.isfinite(r[f"values{k}"]).all() for k in TRACE_STAGES),
            "bad_ready": bool((ready == ~warm).all()),
            "bad_event": bool(np.isin(event, (0, 1, 2)).all()),
            "bad_warm_up": not head[warm, 1:].any(),
            "bad_probabilities": bool((((p >= 0) & (p <= 1)).all(1) & (np.abs(p.astype(np.float64).sum(1) - 1) <= 2e-6) | warm).all()),
        }
        good = {name: good.get(name, True) and ok for name, ok in checks.items()}
    return next((name for name, ok in good.items() if not ok), None)


def trace_hops(data: bytes) -> Iterator[tuple]:
    """(sample, ready, event, logits, probabilities) of each hop of a sound trace; some records are held at a time."""
    for at, r in trace_chunks(data):
        head = r["values4"]
        samples = (TRACE_FIRST + TRACE_HOP * np.arange(at, at + len(r))).tolist()
        yield from zip(samples, (head[:, 0] != 0).tolist(), head[:, 1].astype(int).tolist(), head[:, 2:5].tolist(), head[:, 5:8].tolist())


def trace_rows(data: bytes) -> tuple[list[tuple], str | None]:
    """The rows of trace_hops, or the first fault of the trace."""
    fault = trace_fault(data)
    return ([] if fault else list(trace_hops(data))), fault


class TraceHops:
    """A table function for SQL: the hop rows of one trace, or one row with its fault. Rows leave it as they are read."""

    def eval(self, content: bytes):
        if content is None or (fault := trace_fault(content)):
            yield None, None, None, None, None, "no_content" if content is None else fault
        else:
            for row in trace_hops(content):
                yield *row, None


def register_trace_hops(spark: SparkSession, name: str = "trace_hops") -> None:
    """IO7: make the function known to SQL: SELECT f.path, h.* FROM files f, LATERAL trace_hops(f.content) h.

    Traces reach it by Arrow, whose batches are bounded in bytes; pickled rows come by the hundred, however large they are.
    """
    shape = "sample long, ready boolean, event int, logits array<double>, probabilities array<double>, fault string"
    spark.udtf.register(name, F.udtf(TraceHops, returnType=shape, useArrow=True))


def write_trace(probabilities: list, events: list[int] | None = None) -> bytes:
    """A trace of the given vectors, with zeros for features and logits; the warm-up hops carry none of them."""
    r = np.zeros(len(probabilities), dtype=TRACE_RECORD)
    for k, n in TRACE_STAGES.items():
        r[f"stage{k}"], r[f"count{k}"], r[f"clock{k}"] = k, n, TRACE_FIRST + TRACE_HOP * np.arange(len(r))
    if len(r) > TRACE_WARM:
        r["values4"][TRACE_WARM:, 0] = 1
        r["values4"][TRACE_WARM:, 5:] = np.array([np.asarray(p, dtype=np.float32) for p in probabilities[TRACE_WARM:]])
        r["values4"][TRACE_WARM:, 1] = 0 if events is None else events[TRACE_WARM:]
    return TRACE_MARK + r.tobytes()


def trace_files(rows: DataFrame) -> DataFrame:
    """A trace (path, content) for each row (path, probabilities, in order of the clock). Each leaves Python as it is made: one is held at a time, however small the vectors are beside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, p in zip(b["path"], b["probabilities"]):
                yield pd.DataFrame({"path": [path], "content": [write_trace(p)]})

    return rows.select("path", "probabilities").mapInPandas(run, "path string, content binary")


def trace_table(files: DataFrame) -> DataFrame:
    """IO7: hop rows (path, sample, ready, event, logits, probabilities) of the traces of (path, content); a broken one gives one row with its fault."""
    names = ["path", "sample", "ready", "event", "logits", "probabilities", "fault"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rows, fault = trace_rows(bytes(c))
                rows = [(p, *r, None) for r in rows] if fault is None else [(p, None, None, None, None, None, fault)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"sample": "Int64", "event": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, sample long, ready boolean, event int, logits array<double>, probabilities array<double>, fault string")


def read_traces(spark: SparkSession, path: str, glob: str = "*.trace") -> DataFrame:
    """IO7: the hop rows of the trace files under a folder."""
    return trace_table(_files(spark, path, glob))


def read_arrays(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> DataFrame:
    """IO8: rows (path, name, row, values) of the 1-D and 2-D arrays in npy and npz files; pickled arrays are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                got = np.load(io.BytesIO(bytes(c)), allow_pickle=False)
                for name, a in got.items() if hasattr(got, "items") else [("", got)]:
                    a = np.atleast_2d(a.astype(np.float64))
                    yield pd.DataFrame({"path": p, "name": name, "row": np.arange(len(a)), "values": list(a)})

    return _files(spark, path, glob).mapInPandas(run, "path string, name string, row long, values array<double>")


def pcm_frames(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (first channel) of a 16-bit WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        return w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")[:: w.getnchannels()]
