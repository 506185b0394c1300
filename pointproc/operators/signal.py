"""Operators on chunked sample tables (recording_id, channel, chunk_no, start_idx, fs, v)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointproc.functions.quantile import percentile_mid
from pointproc.operators.ordered import div_floor, with_neighbours
from pointproc.params import FilterParams, SpikeParams
from pointproc.schema import require_columns

SERIES = ["recording_id", "channel"]


def explode_samples(samples: DataFrame) -> DataFrame:
    """One row per sample: recording_id, channel, n (0-based index), fs, x, t_us."""
    require_columns(samples, *SERIES, "start_idx", "fs", "v", what="samples")
    out = samples.select(*SERIES, "start_idx", "fs", F.posexplode("v").alias("p", "x"))
    n = F.col("start_idx") + F.col("p")
    return out.select(*SERIES, n.alias("n"), "fs", "x", F.round(n * 1e6 / F.col("fs")).cast("bigint").alias("t_us"))


def durations(samples: DataFrame) -> DataFrame:
    """Samples and seconds per series, from the chunk sizes alone."""
    return samples.groupBy(*SERIES).agg(
        F.sum(F.size("v")).cast("bigint").alias("n_samples"),
        (F.sum(F.size("v")) / F.max("fs")).alias("duration_sec"))


def time_slice(samples: DataFrame, t0: float, t1: float) -> DataFrame:
    """Samples round(t0*fs)+1 .. round(t1*fs), 1-based, chunks outside pruned first."""
    lo, hi = F.floor(F.lit(t0) * F.col("fs") + 0.5), F.floor(F.lit(t1) * F.col("fs") + 0.5) - 1
    chunk = samples.filter((F.col("start_idx") <= hi) & (F.col("start_idx") + F.size("v") > lo))
    return explode_samples(chunk).filter((F.col("n") >= lo) & (F.col("n") <= hi))


def every_kth(rows: DataFrame, k: int | Column, start: int = 0) -> DataFrame:
    """Systematic decimation by sample index."""
    k = k if isinstance(k, Column) else F.lit(int(k))
    return rows.filter(F.pmod(F.col("n") - start, k) == 0)


def thin_to(rows: DataFrame, target: int, width: int) -> DataFrame:
    """Every k-th sample of a series, k = max(1, floor(n / target))."""
    placed = with_neighbours(rows, SERIES, "n", width).select(*rows.columns, (F.col("idx") - 1).alias("pos"))
    sizes = rows.groupBy(*SERIES).agg(
        F.greatest(F.lit(1).cast("bigint"), F.floor(F.count(F.lit(1)) / target)).alias("step"))
    return placed.join(sizes, SERIES).filter(F.pmod(F.col("pos"), F.col("step")) == 0)


# --- filtering ------------------------------------------------------------------

def notch_gain(freq: np.ndarray, fs: float, p: FilterParams) -> np.ndarray:
    """Squared gain of the notches at the mains frequency and its harmonics."""
    if min(fs, p.notch_f0, p.notch_max, p.notch_q) <= 0:
        raise ValueError("rate, notch frequency, limit and Q must be positive")
    z = np.exp(-2j * np.pi * freq / fs)
    gain = np.ones_like(freq)
    for f0 in np.arange(p.notch_f0, p.notch_max + 1e-9, p.notch_f0):
        if f0 < fs / 2:
            w0 = 2 * np.pi * f0 / fs
            alpha, c = np.sin(w0) / (2 * p.notch_q), -2 * np.cos(w0)
            gain *= np.abs((1 + c * z + z * z) / ((1 + alpha) + c * z + (1 - alpha) * z * z)) ** 2
    return gain


def band_gain(freq: np.ndarray, fs: float, p: FilterParams) -> np.ndarray:
    """Squared gain of the Butterworth band-pass."""
    if not 0 < p.band_low < p.band_high < fs / 2:
        raise ValueError("band edges must satisfy 0 < low < high < fs/2")
    warp = np.tan(np.pi * np.minimum(freq, fs / 2 * (1 - 1e-12)) / fs)
    lo, hi = np.tan(np.pi * p.band_low / fs), np.tan(np.pi * p.band_high / fs)
    with np.errstate(divide="ignore", over="ignore"):
        return 1 / (1 + ((warp**2 - lo * hi) / (warp * (hi - lo))) ** (2 * p.band_order))


@lru_cache(maxsize=8)
def _gain(n: int, fs: float, p: FilterParams) -> np.ndarray:
    freq = np.fft.rfftfreq(n, 1 / fs)
    return notch_gain(freq, fs, p) * band_gain(freq, fs, p)


def _fast_length(n: int) -> int:
    """The least number from n on with no prime factor above 5."""
    best = 1 << (n - 1).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            two = -(-n // three)
            best = min(best, three << max(0, (two - 1).bit_length()))
            three *= 3
        five *= 5
    return best


def _filter_stretch(x: np.ndarray, fs: float, p: FilterParams, reach: int) -> np.ndarray:
    """Zero-phase filter of samples without a gap; mirrored ends keep the transform's wrap-around out."""
    k = min(len(x) - 1, reach)
    padded = np.concatenate([2 * x[0] - x[k:0:-1], x, 2 * x[-1] - x[-2:-2 - k:-1]]) if k else x
    n = _fast_length(len(padded))
    padded = np.concatenate([padded, np.linspace(padded[-1], padded[0], n - len(padded))])
    return np.fft.irfft(np.fft.rfft(padded) * _gain(n, fs, p), n)[k:k + len(x)]


def _in_blocks(samples: DataFrame, block_us: int, reach_sec: float) -> DataFrame:
    """Each chunk's part of every block whose time it lies in or near: what a block task gets is cut to size here."""
    reach = F.ceil(F.lit(reach_sec) * F.col("fs")).cast("bigint") + 1
    per_us = F.lit(1e6) / F.col("fs")
    start, size = F.col("start_idx"), F.size("v")
    first = F.greatest(F.floor((start - reach) * per_us / block_us), F.lit(0))
    last = F.floor((start + size - 1 + reach) * per_us / block_us)
    spread = samples.filter(size > 0).select(*SERIES, "start_idx", "fs", "v", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(start, F.floor(F.col("block") * block_us / per_us).cast("bigint") - reach)
    hi = F.least(start + size, F.ceil((F.col("block") + 1) * block_us / per_us).cast("bigint") + reach)
    return spread.withColumn("lo", lo).withColumn("hi", hi).filter("hi > lo").select(
        *SERIES, "block", "fs", F.col("lo").alias("start_idx"), F.slice("v", (F.col("lo") - start + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("v"))


def _block(pdf: pd.DataFrame, p: FilterParams | None, block_us: int, reach_sec: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, time and (filtered) value of a block's own samples."""
    pdf = pdf.sort_values("start_idx")
    fs = float(pdf["fs"].iloc[0])
    n = np.concatenate([np.arange(s, s + len(v)) for s, v in zip(pdf["start_idx"], pdf["v"])])
    x = np.concatenate(list(pdf["v"])).astype(float)
    if p is not None and len(x):
        parts = np.split(np.arange(len(n)), np.flatnonzero(np.diff(n) != 1) + 1)  # gaps end a stretch
        x = np.concatenate([_filter_stretch(x[part], fs, p, int(reach_sec * fs)) for part in parts])
    t = np.floor(n * 1e6 / fs + 0.5).astype(np.int64)
    own = t // block_us == int(pdf["block"].iloc[0])
    return n[own], t[own], x[own]


def filter_samples(samples: DataFrame, p: FilterParams = FilterParams(), block_sec: float = 60.0,
                   overlap_sec: float = 3.0) -> DataFrame:
    """Notch and band-pass every series, zero-phase: recording_id, channel, n, fs, x.

    A series is cut into blocks of ``block_sec``; a block's task gets its samples and
    those within ``overlap_sec``, multiplies their spectrum by the squared gain and
    trims back. It returns arrays, which become rows inside the JVM.
    """
    require_columns(samples, *SERIES, "start_idx", "fs", "v", what="samples")
    block_us = int(block_sec * 1e6)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, _, x = _block(pdf, p, block_us, overlap_sec)
        cut = np.flatnonzero(np.diff(n) != 1) + 1
        starts = [part[0] for part in np.split(n, cut)] if len(n) else []
        k = len(starts)
        return pd.DataFrame({
            "recording_id": pd.Series([pdf["recording_id"].iloc[0]] * k, dtype=object),
            "channel": np.full(k, pdf["channel"].iloc[0], dtype="int32"), "start_idx": np.array(starts, dtype="int64"),
            "fs": np.full(k, float(pdf["fs"].iloc[0])), "v": pd.Series(np.split(x, cut) if k else [], dtype=object)})

    chunks = _in_blocks(samples, block_us, overlap_sec).groupBy(*SERIES, "block").applyInPandas(
        run, "recording_id string, channel int, start_idx bigint, fs double, v array<double>")
    return explode_samples(chunks).drop("t_us")


# --- detection ------------------------------------------------------------------

def noise_levels(rows: DataFrame, window_us: int) -> DataFrame:
    """Robust noise sd, median(|x|)/0.6745, per series and tumbling window.

    A group is one window of one series, so its size is window length times rate.
    """
    return rows.groupBy(*SERIES, div_floor(F.col("t_us"), window_us).alias("win")).agg(
        (F.median(F.abs("x")) / 0.6745).alias("sigma"))


def detect_blocks(samples: DataFrame, spike: SpikeParams = SpikeParams(), p: FilterParams | None = None,
                  windows: int = 12, overlap_sec: float = 3.0) -> DataFrame:
    """Filter (if given) and detect in one task per block: recording_id, channel, block, fs, n, times.

    ``n`` counts the block's samples, ``times`` are its threshold crossings before
    refractory thinning: samples beyond sd_factor * sigma, the robust noise level of
    their window, whose predecessor is not. A block is ``windows`` noise windows long.
    Its first sample's predecessor is the last one of the block before, wherever that
    ends; one row per block says what it needs to know.
    """
    require_columns(samples, *SERIES, "start_idx", "fs", "v", what="samples")
    if spike.polarity not in (-1, 1):
        raise ValueError("polarity must be -1 or 1")
    window_us, block_us = spike.noise_window_us, spike.noise_window_us * windows
    reach = overlap_sec if p is not None else 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, t, x = _block(pdf, p, block_us, reach)
        if not len(n):
            return pd.DataFrame({"recording_id": pd.Series([], dtype=object), "channel": pd.Series([], dtype="int32"),
                                 "block": pd.Series([], dtype="int64"), "fs": [], "n": pd.Series([], dtype="int64"),
                                 "times": pd.Series([], dtype=object), "first": pd.Series([], dtype="int64"),
                                 "over": pd.Series([], dtype=bool), "level": [], "last": []})
        y = spike.polarity * x
        edges = np.flatnonzero(np.diff(t // window_us)) + 1
        level = np.concatenate([np.full(len(part), spike.sd_factor * (np.median(np.abs(part)) / 0.6745))
                                for part in np.split(x, edges)])
        up = np.flatnonzero((y[1:] > level[1:]) & (y[:-1] <= level[1:])) + 1
        return pd.DataFrame({"recording_id": [pdf["recording_id"].iloc[0]], "channel": np.array([pdf["channel"].iloc[0]], "int32"),
                             "block": [int(pdf["block"].iloc[0])], "fs": [float(pdf["fs"].iloc[0])], "n": [len(n)], "times": [t[up]],
                             "first": [int(t[0])], "over": [bool(y[0] > level[0])], "level": [level[0]], "last": [y[-1]]})

    rows = _in_blocks(samples, block_us, reach).groupBy(*SERIES, "block").applyInPandas(
        run, "recording_id string, channel int, block bigint, fs double, n bigint, times array<bigint>, first bigint, "
             "over boolean, level double, last double")
    before = F.lag("last").over(Window.partitionBy(*SERIES).orderBy("block"))
    starts = F.col("over") & F.coalesce(F.col("_before") <= F.col("level"), F.lit(False))
    return rows.withColumn("_before", before).select(
        *SERIES, "block", "fs", "n", F.when(starts, F.concat(F.array("first"), "times")).otherwise(F.col("times")).alias("times"))


def crossings(blocks: DataFrame) -> DataFrame:
    """recording_id, channel, t_us of the blocks' crossings."""
    return blocks.select(*SERIES, F.explode("times").alias("t_us"))


def amplitude_scale(rows_b: DataFrame, rows_t: DataFrame, keys: list[str]) -> DataFrame:
    """Display scale per channel from the peaks and noise of both conditions."""
    both = rows_b.select(*keys, F.lit("b").alias("side"), "x").unionByName(
        rows_t.select(*keys, F.lit("t").alias("side"), "x"))
    by = [*keys, "side"]
    peak = both.groupBy(*by).agg(F.max(F.abs("x")).alias("peak"))
    med = percentile_mid(both, by, "x", {"_med": 50}).drop("n")
    dev = both.join(med, by).select(*by, F.abs(F.col("x") - F.col("_med")).alias("dev"))
    noise = percentile_mid(dev, by, "dev", {"noise": 50}).drop("n")
    rows = peak.join(noise, by).withColumn("noise", F.col("noise") / 0.6745)
    raw = F.greatest(F.max("peak"), F.max(8 * F.col("noise")))
    top = F.max("peak")
    return rows.groupBy(*keys).agg(
        F.when(raw <= 0, 50.0).otherwise(raw).alias("scale"), F.when(top < 1, 20.0).otherwise(top).alias("peak_scale"))
