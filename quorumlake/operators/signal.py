"""Signal jobs: each is a stage over a clip table, many clips to a task, with a plain table as its result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import sized


def clip_job(clips: DataFrame, columns: list[str], one: Callable, schema: str) -> DataFrame:
    """Rows `one(*columns)` gives for each clip, batch by batch."""
    names = [f.strip().split()[0] for f in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for row in zip(*(b[c] for c in columns)) for r in one(*row)]
            yield pd.DataFrame(out, columns=names).astype(object)

    return clips.select(*columns).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def signal_measures(samples: Column, full: float = 32768.0, quiet_rms: float = 0.001, clip_share: float = 0.001) -> Column:
    """M1: RMS, peak and clipped share of 16-bit samples in an array, with flags; Spark functions only."""
    n = F.size(samples)
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top = F.aggregate(samples, F.lit(0), lambda a, x: F.greatest(a, F.abs(x.cast("int"))))
    clipped = F.size(F.filter(samples, lambda x: F.abs(x.cast("int")) >= 32767)) / n
    rms = F.sqrt(square / n) / full
    flags = F.array_compact(F.array(F.when(n == 0, "empty"), F.when(rms < quiet_rms, "quiet"), F.when(clipped > clip_share, "clipped")))
    return F.struct(rms.alias("rms"), (top / full).alias("peak"), clipped.alias("clipped"), flags.alias("flags"))


def quantise(clips: DataFrame, key: str, samples: str, least: int = 400, most: int = 480_000) -> DataFrame:
    """G1: floats to 16-bit integers, nearest even, saturating; with how many saturated, the greatest error, peak and RMS of the floats, and flags.

    A null clip, one with a sample that is null, NaN or infinite, and one that is too short or too long are refused: reason no_audio, nonfinite or extent,
    and no samples.
    """
    x = F.col("_x")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    reason = F.when(x.isNull(), "no_audio").when((F.size(x) < least) | (F.size(x) > most), "extent").when(bad, "nonfinite")
    rows = clips.select(key, F.col(samples).alias("_x")).withColumn("reason", reason).withColumn("_x", F.when(F.col("reason").isNull(), x))
    wide = F.transform(x, lambda v: F.rint(v * 32768))
    pcm = F.transform(wide, lambda v: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), v)).cast("int"))
    saturated = F.size(F.filter(wide, lambda v: (v > 32767) | (v < -32768))).cast("long")
    out = rows.select(key, "_x", "reason", pcm.alias("pcm"), F.when(x.isNotNull(), saturated).alias("saturated"))
    error = F.aggregate(F.zip_with("pcm", "_x", lambda q, v: F.abs(q / 32768 - v)), F.lit(0.0), lambda a, e: F.greatest(a, e))
    flags = F.array_compact(F.array(F.when(~F.exists("pcm", lambda v: v != 0), F.lit("no_nonzero_samples")), F.when(F.col("saturated") > 0, F.lit("saturation"))))
    rms = F.sqrt(F.try_divide(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v), F.size("_x")))
    return out.select(key, "reason", "pcm", "saturated", error.alias("max_error"), F.array_max(F.transform("_x", lambda v: F.abs(v))).alias("peak"), rms.alias("rms"), F.when(F.col("reason").isNull(), flags).alias("flags"))


def silence(clips: DataFrame, key: str, samples: str, rate: int = 16_000, share: float = 0.01, floor: float = 100.0) -> DataFrame:
    """Leading, trailing and longest internal silence in ms, from whole 10 ms frames of 16-bit samples.

    A frame is loud if its RMS is over `share` of that of the loudest frame. A clip whose loudest frame is under `floor` is silent from end to end, which counts as
    internal; a null clip, or one under a frame, has no silence.
    """
    size = rate // 100
    frames = F.greatest(F.coalesce(F.floor(F.size(F.col(samples)) / size).cast("int"), F.lit(0)), F.lit(0))
    rms = lambda f: F.sqrt(F.aggregate(F.slice("_x", f * size + 1, F.lit(size)), F.lit(0.0), lambda a, v: a + v * v) / size)
    levels = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), rms)).otherwise(F.expr("cast(array() as array<double>)"))
    rows = clips.select(key, F.col(samples).alias("_x"), frames.alias("_n")).select(key, "_n", levels.alias("_levels")).withColumn("_top", F.array_max("_levels"))
    marked = F.filter(F.transform("_levels", lambda v, i: F.when(v > share * F.col("_top"), i)), lambda i: i.isNotNull())
    silent = F.coalesce(F.col("_top") < floor, F.lit(False))
    rows = rows.withColumn("_loud", F.when(silent, F.expr("cast(array() as array<int>)")).otherwise(marked))
    gaps = F.transform("_loud", lambda f, i: F.when(i > 0, f - F.get("_loud", i - 1) - 1).otherwise(0))
    ms = lambda c: (10 * F.coalesce(c, F.lit(0))).cast("long")
    inner = F.when(silent, F.col("_n")).otherwise(F.array_max(gaps))
    return rows.select(key, ms(F.get("_loud", F.lit(0))).alias("lead_ms"), ms(F.col("_n") - 1 - F.array_max("_loud")).alias("tail_ms"), ms(inner).alias("inner_ms"))


def mel_bank(bands: int, size: int, rate: int, low: float = 20.0, high: float | None = None) -> np.ndarray:
    """Triangles even on the mel scale, over the bins of a real FFT."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high or rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, size // 2 + 1)[None, :]
    a, b, c = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f - a) / (b - a), (c - f) / (c - b)), 0, None)


def log_mel(clips: DataFrame, key: str, samples: str, rate: int = 16_000, bands: int = 40) -> DataFrame:
    """A row for each clip with its log-mel frames (25 ms, hop 10 ms), trimmed at 40 dB under the loudest, each band centred and scaled."""

    def one(k, x):
        x = np.asarray(x, dtype=np.float64) / 32768
        size, hop = rate // 40, rate // 100
        if len(x) < size:
            return [(k, [])]
        at = np.arange(0, len(x) - size + 1, hop)[:, None] + np.arange(size)
        power = np.abs(np.fft.rfft(x[at] * np.hanning(size), 512)) ** 2
        energy = 10 * np.log10(power.sum(1) + 1e-12)
        keep = np.flatnonzero(energy >= energy.max() - 40)
        feats = np.log(power[keep[0] : keep[-1] + 1] @ mel_bank(bands, 512, rate).T + 1e-10)
        return [(k, ((feats - feats.mean(0)) / (feats.std(0) + 1e-6)).tolist())]

    return clip_job(clips, [key, samples], one, f"{key} string, features array<array<double>>")


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Mean cost of the best alignment under Euclidean frame distance; infinite if one is empty."""
    if not len(a) or not len(b):
        return float("inf")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    acc = np.full((len(a) + 1, len(b) + 1), np.inf)
    acc[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            acc[i + 1, j + 1] = d[i, j] + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
    return float(acc[-1, -1] / (len(a) + len(b)))


def dtw_pairs(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """The distance of each pair of feature matrices; pairs come from a join blocked by voice."""
    mat = lambda m: np.array([np.asarray(r, dtype=np.float64) for r in m])
    one = lambda *row: [(*row[:-2], dtw(mat(row[-2]), mat(row[-1])))]
    return clip_job(pairs.select(*[F.col(k).cast("string").alias(k) for k in keys], left, right), [*keys, left, right], one, ", ".join(f"{k} string" for k in keys) + ", distance double")


def ctc_log_probability(logp: np.ndarray, ids: list[int], blank: int = 0) -> float:
    """Log-probability that a CTC output reads as ids: the forward sum over all alignments."""
    ext = [blank]
    for i in ids:
        ext += [i, blank]
    a = np.full(len(ext), -np.inf)
    a[0] = logp[0, blank]
    if len(ext) > 1:
        a[1] = logp[0, ext[1]]
    for row in logp[1:]:
        stay = np.logaddexp(a, np.concatenate([[-np.inf], a[:-1]]))
        skip = np.concatenate([[-np.inf, -np.inf], a[:-2]])
        may = np.array([j > 1 and ext[j] != blank and ext[j] != ext[j - 2] for j in range(len(ext))])
        a = np.where(may, np.logaddexp(stay, skip), stay) + row[ext]
    return float(np.logaddexp(a[-1], a[-2]) if len(ext) > 1 else a[-1])


def ctc_scores(clips: DataFrame, key: str, logits: str, candidates: dict[str, list[int]], blank: int = 0) -> DataFrame:
    """The best candidate of each clip, its log-probability and its margin over the second."""

    def one(k, m):
        x = np.array([np.asarray(r, dtype=np.float64) for r in m])
        x = x - np.logaddexp.reduce(x, axis=1, keepdims=True)
        got = sorted(((ctc_log_probability(x, ids, blank), name) for name, ids in candidates.items()), key=lambda t: (-t[0], t[1]))
        margin = got[0][0] - got[1][0] if len(got) > 1 else None
        return [(k, got[0][1], got[0][0], margin)]

    return clip_job(clips, [key, logits], one, f"{key} string, best string, log_probability double, margin double")


def mix_snr(rows: DataFrame, key: str, clip: str, noise: str, snr_db: str) -> DataFrame:
    """Clip plus noise at a signal-to-noise ratio; silent inputs, short noise and results without headroom keep a reason and no samples."""
    power = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    n = F.slice(noise, F.lit(1), F.size(clip))
    sound = rows.select(key, F.col(clip).alias("_c"), n.alias("_n"), (F.size(noise) < F.size(clip)).alias("_short"), power(F.col(clip)).alias("_pc"), power(n).alias("_pn"), F.col(snr_db).alias("_snr"))
    gain = F.sqrt(F.col("_pc") / F.col("_pn") / F.pow(F.lit(10.0), F.col("_snr") / 10))
    mixed = sound.withColumn("gain", F.when(~F.col("_short") & (F.col("_pc") > 0) & (F.col("_pn") > 0), gain))
    mixed = mixed.withColumn("_out", F.when(F.col("gain").isNotNull(), F.zip_with("_c", "_n", lambda c, v: F.rint(c + F.col("gain") * v))))
    reason = F.when(F.col("_short"), "noise_short").when(F.col("gain").isNull(), "silent").when(F.exists("_out", lambda v: F.abs(v) > 32767), "no_headroom")
    return mixed.withColumn("reason", reason).select(key, F.when(F.col("reason").isNull(), F.transform("_out", lambda v: v.cast("int"))).alias("pcm"), "gain", "reason")


def add_context(clips: DataFrame, key: str, samples: str, before: int, after: int, level: float) -> DataFrame:
    """Seeded noise before and after a clip, scaled down together if it would clip; the seed comes from the key."""

    def one(k, x):
        rng = np.random.default_rng(int(hashlib.sha256(k.encode()).hexdigest()[:16], 16))
        out = np.concatenate([rng.normal(0, level, before), np.asarray(x, dtype=np.float64), rng.normal(0, level, after)])
        gain = min(1.0, 32767 / max(1.0, np.abs(out).max()))
        return [(k, np.rint(out * gain).astype(int).tolist(), float(gain), before)]

    return clip_job(clips, [key, samples], one, f"{key} string, pcm array<int>, gain double, clip_start long")


def gain_variants(clips: DataFrame, samples: str, gains: DataFrame) -> DataFrame:
    """Every clip at every gain (a small table with `gain`), rounded to nearest even and clipped."""
    return clips.crossJoin(sized(gains)).withColumn("pcm", F.transform(samples, lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.rint(x * F.col("gain")).cast("int")))))


def slice_windows(windows: DataFrame, pcm: str, start: str, end: str) -> DataFrame:
    """16-bit samples [start, end) of a mono recording's bytes, with their digest; null where the window leaves the recording."""
    ok = (F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) * 2 <= F.length(pcm))
    part = F.substring(F.col(pcm), (F.col(start) * 2 + 1).cast("int"), ((F.col(end) - F.col(start)) * 2).cast("int"))
    return windows.withColumn("window", F.when(ok, part)).withColumn("window_sha256", F.sha2("window", 256))


def sample_difference(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Half-open ranges in which two sample arrays differ (the longer one's tail differs); null equals null, a null array is empty."""
    x, y = F.coalesce(left, F.array()), F.coalesce(right, F.array())
    rows = pairs.select(key, x.alias("_x"), y.alias("_y"), F.greatest(F.size(x), F.size(y)).alias("_n"))
    beyond = lambda i: (i >= F.size("_x")) | (i >= F.size("_y"))
    differs = lambda i: (i >= 0) & (i < F.col("_n")) & (beyond(i) | ~F.get("_x", i).eqNullSafe(F.get("_y", i)))
    edges = lambda step: F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: differs(i) & ~differs(i + step))
    ranges = F.zip_with(edges(-1), edges(1), lambda a, b: F.struct(a.cast("long").alias("start"), (b + 1).cast("long").alias("end")))
    return rows.where("_n > 0").select(key, F.explode(ranges).alias("r")).select(key, "r.start", "r.end")


def covering_ends(first: Column, hop: Column, last: Column, support: Column, start: Column, end: Column) -> Column:
    """Hop ends whose support (e - support, e] covers a clip [start, end)."""
    ends = F.when(last >= first, F.sequence(first, last, hop)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.filter(ends, lambda e: (e - support <= start) & (e >= end))
