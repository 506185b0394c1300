import numpy as np
import pytest
from pyspark.sql import functions as F

from pointproc.operators import signal as sg
from pointproc.operators.density import kernel_density
from pointproc.params import FilterParams, Params, SpikeParams
from pointproc.plans.preprocess import preprocess

FS = 8000.0


def chunked(spark, x, size=1000, channel=1, fs=FS):
    rows = [("r", channel, k // size, k, fs, [float(v) for v in x[k:k + size]]) for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, "recording_id string, channel int, chunk_no bigint, start_idx bigint, fs double, v array<double>")


def values(df):
    pdf = df.orderBy("n").toPandas()
    assert (pdf["n"].to_numpy() == np.arange(len(pdf))).all()
    return pdf["x"].to_numpy()


def forward_backward(b, a, x):
    def once(x):
        y = np.zeros_like(x)
        for n in range(len(x)):
            y[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)
        return y
    return once(once(x)[::-1])[::-1]


def test_hum_goes_and_tone_stays(spark):
    t = np.arange(int(8 * FS)) / FS
    tone = np.sin(2 * np.pi * 1000 * t)
    y = values(sg.filter_samples(chunked(spark, tone + 5 * np.sin(2 * np.pi * 60 * t) + 3), FilterParams()))
    mid = slice(int(3 * FS), int(5 * FS))
    assert np.abs(y[mid] - tone[mid]).max() < 1e-2


def test_blocks_agree_with_one_piece(spark):
    x = np.random.default_rng(1).normal(size=int(10 * FS))
    one = values(sg.filter_samples(chunked(spark, x), block_sec=100))
    many = values(sg.filter_samples(chunked(spark, x), block_sec=2.5, overlap_sec=3))
    assert np.abs(one - many)[int(3 * FS):int(7 * FS)].max() < 1e-6


def test_notch_equals_recursive_filter():
    # forward-backward recursion of the 60 Hz biquad against the spectrum method, away from the ends
    p = FilterParams(notch_max=60.0, notch_q=5.0)
    fs, x = 1000.0, np.random.default_rng(2).normal(size=6000)
    w0, q = 2 * np.pi * 60 / fs, 5.0
    al = np.sin(w0) / (2 * q)
    b, a = np.array([1, -2 * np.cos(w0), 1]) / (1 + al), np.array([1, -2 * np.cos(w0) / (1 + al), (1 - al) / (1 + al)])
    gain = sg.notch_gain(np.fft.rfftfreq(len(x), 1 / fs), fs, p)
    y = np.fft.irfft(np.fft.rfft(x) * gain, len(x))
    assert np.abs(y - forward_backward(b, a, x))[2000:4000].max() < 1e-6


def test_band_edges_are_checked():
    with pytest.raises(ValueError):
        sg.band_gain(np.array([1.0]), 4000.0, FilterParams())
    with pytest.raises(ValueError):
        sg.notch_gain(np.array([1.0]), -1.0, FilterParams())


def test_detection_and_slice(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=20_000) * 0.1
    at = [500, 4000, 9999, 10_000, 15_000]
    x[at] = -5.0
    for windows in (1, 12):  # 10,000 is the first sample of a window, and of a block where a block is one window
        blocks = sg.detect_blocks(chunked(spark, x), SpikeParams(sd_factor=6.0, noise_window_us=1_250_000), windows=windows)
        got = sorted(r["t_us"] for r in sg.crossings(blocks).collect())
        assert blocks.agg(F.sum("n")).first()[0] == 20_000
        assert got == [int(n / FS * 1e6) for n in (500, 4000, 9999, 15_000)]  # 9999 and 10000 are one crossing
    assert sg.time_slice(chunked(spark, x), 0.5, 1.0).agg(F.min("n"), F.max("n")).first()[:] == (4000, 7999)
    assert sg.thin_to(sg.explode_samples(chunked(spark, x)), 6000, 4096).count() == 6667


def test_filtered_detection_is_filter_then_detection(spark):
    x = np.random.default_rng(5).normal(size=int(30 * FS))
    x[[40_000, 40_001, 120_000, 159_999, 200_000]] -= 40
    spike = SpikeParams(sd_factor=5.0, noise_window_us=1_000_000)
    chunks = chunked(spark, x, size=7000)
    got = sorted(r["t_us"] for r in sg.crossings(sg.detect_blocks(chunks, spike, FilterParams(), windows=5)).collect())
    whole = values(sg.filter_samples(chunks, block_sec=100))
    want = sorted(r["t_us"] for r in sg.crossings(sg.detect_blocks(chunked(spark, whole), spike, windows=100)).collect())
    assert got == want and len(got) >= 4


def test_fast_length():
    for n in (1, 2, 7, 11, 1000, 1021, 99_991):
        k = m = sg._fast_length(n)
        for f in (2, 3, 5):
            while k % f == 0:
                k //= f
        assert k == 1 and n <= m <= 1.2 * n + 2


def test_preprocess(spark):
    x = np.random.default_rng(4).normal(size=int(4 * FS)) * 0.01
    for k in range(10):
        x[8000 + k * 400] = -9.0
    out = preprocess(chunked(spark, x), Params(spike=SpikeParams(sd_factor=6.0)), filtered=False)
    row = out.summary.first()
    assert (row["n_spikes"], row["n_bursts"], row["duration_us"]) == (10, 1, 4_000_000)
    assert row["spike_rate"] == pytest.approx(150.0)


def test_kernel_density(spark):
    df = spark.createDataFrame([("g", v) for v in [0.0, 1.0, 1.0, 3.0]], "g string, y double").withColumnRenamed("y", "v")
    got = kernel_density(df, ["g"], "v", -2.0, 6.0, 81, bandwidth=0.5).orderBy("k").toPandas()
    grid = np.linspace(-2, 6, 81)
    want = sum(np.exp(-0.5 * ((grid - v) / 0.5) ** 2) for v in (0, 1, 1, 3)) / (4 * 0.5 * np.sqrt(2 * np.pi))
    assert np.allclose(got["density"], want) and got["relative"].max() == 1.0
