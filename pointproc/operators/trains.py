"""Spike-train operators: intervals, refractory thinning, bursts, coverage, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointproc.operators.ordered import div_floor, with_islands, with_neighbours
from pointproc.operators.thinning import thin

TRAIN = ["recording_id", "channel"]


def intervals(spikes: DataFrame, block_us: int) -> DataFrame:
    """Each spike but the last of its train with the time to the next one."""
    return (with_neighbours(spikes, TRAIN, "t_us", block_us)
            .filter(F.col("next").isNotNull())
            .select(*TRAIN, "idx", "t_us", (F.col("next") - F.col("t_us")).alias("isi_us")))


def drop_refractory(spikes: DataFrame, refractory_us: int, block_us: int) -> DataFrame:
    """Keep a spike only when the last *kept* one is at least ``refractory_us`` back."""
    return thin(spikes, TRAIN, refractory_us, block_us)


def bursts(spikes: DataFrame, isi_max_us: int, isi_end_us: int, min_spikes: int,
           block_us: int, numbered: bool = True) -> DataFrame:
    """Bursts: from the first interval <= ``isi_max_us`` to the next > ``isi_end_us``.

    Between two intervals above ``isi_end_us`` lies at most one burst: it opens at
    the first spike whose next interval is short enough and closes at the island's
    last spike. A burst is kept when it holds at least ``min_spikes``. ``numbered``
    adds ``burst_no`` in time order, which counting does not need.
    """
    if isi_max_us > isi_end_us:
        raise ValueError("isi_max_us must not exceed isi_end_us")
    rows = with_islands(spikes, TRAIN, "t_us", block_us, isi_end_us)
    opens = F.col("next") - F.col("t_us") <= isi_max_us
    found = (
        rows.groupBy(*TRAIN, "island")
        .agg(F.min(F.when(opens, F.col("idx"))).alias("start_idx"), F.max("idx").alias("end_idx"),
             F.min(F.when(opens, F.col("t_us"))).alias("start_us"), F.max("t_us").alias("end_us"),
             F.max("duration_us").alias("duration_us"))
        .withColumn("n_spikes", F.col("end_idx") - F.col("start_idx") + 1)
        .filter(F.col("n_spikes") >= min_spikes)
        .drop("island")
    )
    cols = ["start_idx", "end_idx", "start_us", "end_us", "n_spikes", "duration_us"]
    if not numbered:
        return found.select(*TRAIN, *cols)
    return with_neighbours(found, TRAIN, "start_us", 16 * block_us).select(
        *TRAIN, F.col("idx").alias("burst_no"), *cols)


def coverage(spikes: DataFrame, delta_us: int, block_us: int) -> DataFrame:
    """Fraction of the recording within ``delta_us`` of a spike, per train.

    All windows have one width, so the covered length is the sum over spikes of
    the window clipped at the next window's start.
    """
    rows = with_neighbours(spikes, TRAIN, "t_us", block_us)
    lo = F.greatest(F.lit(0), F.col("t_us") - delta_us)
    hi = F.least(F.col("duration_us"), F.col("t_us") + delta_us)
    # NULL after the last spike, where nothing cuts the window (greatest skips NULLs)
    next_lo = F.when(F.col("next").isNotNull(), F.greatest(F.lit(0), F.col("next") - delta_us))
    return rows.groupBy(*TRAIN).agg(
        (F.sum(F.least(hi, next_lo) - lo) / F.max("duration_us")).alias("coverage"),
        F.count(F.lit(1)).alias("n_spikes"))


def cover_intervals(spikes: DataFrame, delta_us: int, block_us: int) -> DataFrame:
    """The closed, disjoint intervals that make up the +-delta cover of a train."""
    rows = with_islands(spikes, TRAIN, "t_us", block_us, 2 * delta_us)
    return rows.groupBy(*TRAIN, "island").agg(
        (F.min("t_us") - delta_us).alias("lo"), (F.max("t_us") + delta_us).alias("hi")).drop("island")


def channel_summary(channels: DataFrame, spikes: DataFrame, burst_table: DataFrame | None = None,
                    unit_us: int = 60_000_000) -> DataFrame:
    """Spike and burst counts and rates per used channel; silent channels are 0."""
    usable = F.col("duration_us") > 0
    counts = spikes.groupBy(*TRAIN).agg(F.count(F.lit(1)).alias("n_spikes"))
    out = channels.join(counts, TRAIN, "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))

    def rate(n: str) -> Column:
        return F.when(usable, F.col(n) * F.lit(float(unit_us)) / F.col("duration_us"))

    out = out.withColumn("spike_rate", rate("n_spikes"))
    if burst_table is not None:
        n = burst_table.groupBy(*TRAIN).agg(F.count(F.lit(1)).alias("n_bursts"))
        out = (out.join(n, TRAIN, "left").withColumn("n_bursts", F.coalesce("n_bursts", F.lit(0)))
               .withColumn("burst_rate", rate("n_bursts")))
    return out


def inferred_duration(spikes: DataFrame, at_least_us: int) -> DataFrame:
    """Latest spike over all channels of a recording, at least one bin or delta."""
    return spikes.groupBy("recording_id").agg(
        F.greatest(F.max("t_us"), F.lit(int(at_least_us)).cast("bigint")).alias("duration_us"))


def bin_counts(spikes: DataFrame, bin_us: int) -> DataFrame:
    """Non-zero bins: recording_id, channel, bin, c, n_bins.

    Bins are half-open except the last, which is closed; later spikes are dropped.
    """
    n_bins = F.greatest(F.lit(1).cast("bigint"), div_floor(F.col("duration_us"), bin_us))
    b = div_floor(F.col("t_us"), bin_us)
    on_end = F.col("t_us") == F.col("n_bins") * F.lit(int(bin_us))
    return (
        spikes.withColumn("n_bins", n_bins)
        .withColumn("bin", F.when(on_end, F.col("n_bins") - 1).otherwise(b))
        .filter((F.col("bin") >= 0) & (F.col("bin") < F.col("n_bins")))
        .groupBy(*TRAIN, "bin", "n_bins").agg(F.count(F.lit(1)).alias("c"))
    )


def bin_moments(bins: DataFrame, channels: DataFrame, bin_us: int) -> DataFrame:
    """Mean and sample sd of the binned counts over *all* bins, zeros included."""
    n_bins = F.greatest(F.lit(1).cast("bigint"), div_floor(F.col("duration_us"), bin_us))
    sums = bins.groupBy(*TRAIN).agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("s2"))
    n, s, s2 = F.col("n_bins"), F.col("s"), F.col("s2")
    sd = F.sqrt((s2 - s * s / n) / (n - 1))
    return (
        channels.withColumn("n_bins", n_bins).join(sums, TRAIN, "left")
        .withColumn("s", F.coalesce("s", F.lit(0))).withColumn("s2", F.coalesce("s2", F.lit(0)))
        .select(*TRAIN, "n_bins", "s", "s2", (s / n).alias("mean"),
                F.when((n > 1) & (s2 * n > s * s), sd).otherwise(F.lit(1.0)).alias("sd"))
    )


def population_rate(spikes: DataFrame, recordings: DataFrame, bin_us: int, window_us: int,
                    unit_us: int = 1_000_000) -> DataFrame:
    """Pooled spikes per time unit on a dense grid of bins, per recording."""
    n_bins = window_us // bin_us
    b = div_floor(F.col("t_us"), bin_us)
    hits = (
        spikes.filter(F.col("t_us") <= n_bins * bin_us)
        .withColumn("bin", F.least(b, F.lit(n_bins - 1).cast("bigint")))
        .groupBy("recording_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    grid = recordings.select("recording_id", "condition", "study").withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint"))))
    return grid.join(hits, ["recording_id", "bin"], "left").select(
        "recording_id", "condition", "study", "bin",
        (F.coalesce("n", F.lit(0)) * (unit_us / bin_us)).alias("rate"))


def smoothed_mean_sem(rates: DataFrame, by: list[str], half: int = 2) -> DataFrame:
    """Mean and SEM over recordings per bin, each smoothed by a centred average.

    The average spans 2*half+1 bins and shrinks at the ends. One group here holds
    one row per bin of the common window, a number fixed by the bin width.
    """
    per_bin = rates.groupBy(*by, "bin").agg(
        F.avg("rate").alias("mean"), (F.stddev_samp("rate") / F.sqrt(F.count("rate"))).alias("sem"))
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(-half, half)
    return per_bin.select(*by, "bin", F.avg("mean").over(w).alias("mean"), F.avg("sem").over(w).alias("sem"))
