import random

import pytest

from pointproc.operators import trains as tr
from pointproc.operators.ordered import with_islands, with_neighbours

BLOCK = 50


def thin(times, ref):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= ref:
            kept.append(t)
    return kept


def burst_machine(times, isi_max, isi_end, least):
    out, inside, start = [], False, None
    for k in range(len(times) - 1):
        isi = times[k + 1] - times[k]
        if not inside and isi <= isi_max:
            inside, start = True, k + 1
        elif inside and isi > isi_end:
            if k + 1 - start + 1 >= least:
                out.append((start, k + 1))
            inside = False
    if inside and len(times) - start + 1 >= least:
        out.append((start, len(times)))
    return out


def covered(times, delta, duration):
    marks = set()
    for t in times:
        marks.update(range(max(0, t - delta), min(duration, t + delta)))
    return len(marks) / duration


@pytest.fixture(scope="module")
def many():
    rnd = random.Random(3)
    data = {}
    for ch in range(1, 41):
        n = rnd.choice([1, 2, 5, 40, 120])
        data[ch] = sorted(rnd.sample(range(1000), n))
    return data


def test_neighbours_across_blocks(trains, many):
    spikes, _ = trains(many, 1000)
    got = {(r["channel"], r["idx"]): (r["prev"], r["t_us"], r["next"])
           for r in with_neighbours(spikes, tr.TRAIN, "t_us", BLOCK).collect()}
    for ch, ts in many.items():
        for k, t in enumerate(ts):
            want = (ts[k - 1] if k else None, t, ts[k + 1] if k + 1 < len(ts) else None)
            assert got[ch, k + 1] == want
    assert len(got) == sum(map(len, many.values()))


def test_islands(trains, many):
    spikes, _ = trains(many, 1000)
    got = {(r["channel"], r["t_us"]): r["island"] for r in with_islands(spikes, tr.TRAIN, "t_us", BLOCK, 12).collect()}
    for ch, ts in many.items():
        start = 1
        for k, t in enumerate(ts):
            if k and t - ts[k - 1] > 12:
                start = k + 1
            assert got[ch, t] == start


def test_refractory_known(trains):
    spikes, _ = trains({1: [0, 400, 900, 1200, 2500]}, 3000)
    got = [r["t_us"] for r in tr.drop_refractory(spikes, 1000, 1000).orderBy("t_us").collect()]
    assert got == [0, 1200, 2500]


def test_refractory_random(trains, many):
    data = {ch: ts + ts[:3] for ch, ts in many.items()}  # with repeated times
    spikes, _ = trains(data, 1000)
    got = {}
    for r in tr.drop_refractory(spikes, 25, BLOCK).collect():
        got.setdefault(r["channel"], []).append(r["t_us"])
    assert {c: sorted(v) for c, v in got.items()} == {c: thin(set(v), 25) for c, v in data.items()}


@pytest.mark.parametrize("isi_max,isi_end,least", [(8, 20, 3), (5, 5, 2), (15, 30, 5)])
def test_bursts_random(trains, many, isi_max, isi_end, least):
    spikes, _ = trains(many, 1000)
    got = {}
    for r in tr.bursts(spikes, isi_max, isi_end, least, BLOCK).orderBy("burst_no").collect():
        got.setdefault(r["channel"], []).append((r["start_idx"], r["end_idx"]))
        assert r["burst_no"] == len(got[r["channel"]])
        assert r["n_spikes"] == r["end_idx"] - r["start_idx"] + 1
        assert (r["start_us"], r["end_us"]) == (many[r["channel"]][r["start_idx"] - 1], many[r["channel"]][r["end_idx"] - 1])
    want = {c: burst_machine(ts, isi_max, isi_end, least) for c, ts in many.items()}
    assert got == {c: v for c, v in want.items() if v}


def test_burst_thresholds_checked(trains):
    spikes, _ = trains({1: [1, 2]}, 10)
    with pytest.raises(ValueError):
        tr.bursts(spikes, 10, 5, 2, BLOCK)


def test_coverage(trains, many):
    spikes, _ = trains(many, 1000)
    for r in tr.coverage(spikes, 9, BLOCK).collect():
        assert r["coverage"] == pytest.approx(covered(many[r["channel"]], 9, 1000))


def test_bins_close_the_last_edge(trains):
    spikes, _ = trains({1: [0, 9, 10, 29, 30, 31]}, 35)  # three bins of ten
    got = {r["bin"]: r["c"] for r in tr.bin_counts(spikes, 10).collect()}
    assert got == {0: 2, 1: 1, 2: 2}


def test_silent_channels_are_zero(trains):
    spikes, used = trains({1: [1, 2, 3], 2: []}, 60_000_000)
    got = {r["channel"]: r for r in tr.channel_summary(used, spikes, tr.bursts(spikes, 5, 5, 2, BLOCK)).collect()}
    assert (got[1]["n_spikes"], got[1]["spike_rate"], got[1]["n_bursts"]) == (3, 3.0, 1)
    assert (got[2]["n_spikes"], got[2]["spike_rate"], got[2]["n_bursts"]) == (0, 0.0, 0)


@pytest.mark.parametrize("refractory,width", [(7, 10), (7, 3), (1, 10), (30, 50), (0, 10), (100, 10)])
def test_refractory_over_blocks(spark, refractory, width):
    rnd = random.Random(refractory * width)
    data = {ch: [rnd.randint(-200, rnd.choice([50, 1000, 20000])) for _ in range(rnd.choice([1, 2, 50, 2000]))] for ch in range(20)}
    rows = [("r", c, t, 9, i) for c, ts in data.items() for i, t in enumerate(ts)]
    spikes = spark.createDataFrame(rows, "recording_id string, channel int, t_us bigint, duration_us bigint, extra int").repartition(5)
    got = {}
    for r in tr.drop_refractory(spikes, refractory, width).collect():
        got.setdefault(r["channel"], []).append(r["t_us"])
    assert {c: sorted(v) for c, v in got.items()} == {c: thin(set(v), refractory) for c, v in data.items()}
    assert tr.drop_refractory(spikes.limit(0), refractory, width).count() == 0


def test_dense_train_is_thinned_by_many_tasks(spark):
    """One train without any gap: no task sees more than a fair share of it."""
    from pyspark.sql import functions as F

    n = 200_000
    spikes = spark.range(n).select(F.lit("r").alias("recording_id"), F.lit(1).alias("channel"), (F.col("id") * 3).alias("t_us"),
                                   F.lit(3 * n).cast("bigint").alias("duration_us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = tr.drop_refractory(spikes, 10, 1000).withColumn("task", F.spark_partition_id())
        shares = [r["count"] for r in kept.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(shares) == n // 4 and len(shares) >= 4 and max(shares) < n // 4 / 2
