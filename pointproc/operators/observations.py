"""Paired observations and what is asked of them.

``observations`` holds one row per (pair, channel, metric) with the baseline value
``b`` and the treatment value ``t``. Groups (a metric, a study, a condition) are of
unbounded size, so every percentile here is the distributed one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointproc.functions.quantile import percentile_mid, small_percentile
from pointproc.functions.scalar import capped_pct, change_category

METRICS = {"spikeRates": "spike_rate", "burstRates": "burst_rate",
           "spikeCounts": "n_spikes", "burstCounts": "n_bursts"}


def pool_metric(summary: DataFrame, recordings: DataFrame, metric: str,
                channels: Sequence[int] | None = None) -> DataFrame:
    """Baseline joined to treatment on (study, pair, channel) for one metric."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    rows = summary.join(recordings.select("recording_id", "study", "condition", "pair_no"), "recording_id")
    if channels is not None:
        rows = rows.filter(F.col("channel").isin(*channels))
    key = ["study", "pair_no", "channel"]
    side = {
        c: rows.filter(F.col("condition") == c).select(*key, F.col(METRICS[metric]).cast("double").alias(a))
        for c, a in (("baseline", "b"), ("treatment", "t"))
    }
    return (side["baseline"].join(side["treatment"], key).dropna(subset=["b", "t"])
            .select(*key, F.lit(METRICS[metric]).alias("metric"), "b", "t"))


def keep_not_silent(obs: DataFrame, mode: str, minimum: float) -> DataFrame:
    """Silent-channel rules: baseline_min, both_zero, either_zero; others keep all."""
    b, t = F.col("b"), F.col("t")
    if mode == "baseline_min":
        return obs.filter(b >= minimum)
    if mode == "both_zero":
        quiet = ((b == 0) & (t == 0)) if minimum == 0 else ((b < minimum) & (t < minimum))
        return obs.filter(~quiet)
    if mode == "either_zero":
        return obs.filter((b >= minimum) & (t >= minimum))
    return obs


def keep_active_either(obs: DataFrame, minimum: float) -> DataFrame:
    """Scatter rule: active on at least one side and finite on both."""
    b, t = F.col("b"), F.col("t")
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (b, t)]
    return obs.filter(((b >= minimum) | (t >= minimum)) & finite[0] & finite[1])


def outlier_mode(mode: str, drop_mean_multiplier: bool) -> str:
    """The legacy flag only takes over from the default tukey mode."""
    return "mean_multiplier" if drop_mean_multiplier and mode == "tukey" else mode


def pooled(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Baseline and treatment values in one column ``y``."""
    return obs.select(*keys, F.explode(F.array("b", "t")).alias("y"))


def outlier_cuts(obs: DataFrame, keys: Sequence[str], mode: str, iqr_factor: float = 3.0,
                 upper_percentile: float = 99.0, multiplier: float = 15.0) -> DataFrame:
    """Upper cut per group and side; one small row per group."""
    keys = list(keys)
    finite = pooled(obs, keys).filter(F.abs(F.col("y")) != float("inf"))
    if mode == "tukey":
        q = percentile_mid(finite, keys, "y", {"q1": 25, "q3": 75})
        cut = F.col("q3") + iqr_factor * (F.col("q3") - F.col("q1"))
        return q.select(*keys, cut.alias("cut_b"), cut.alias("cut_t"))
    if mode == "percentile":
        q = percentile_mid(finite, keys, "y", {"cut_b": upper_percentile})
        return q.select(*keys, "cut_b", F.col("cut_b").alias("cut_t"))
    if mode == "mean_multiplier":
        return obs.groupBy(*keys).agg((multiplier * F.avg("b")).alias("cut_b"),
                                      (multiplier * F.avg("t")).alias("cut_t"))
    raise ValueError(f"no cuts for outlier mode {mode!r}")


def drop_outliers(obs: DataFrame, keys: Sequence[str], mode: str = "none", **options) -> DataFrame:
    """Keep rows with both sides at or below the group's cut."""
    if mode == "none":
        return obs
    cuts = outlier_cuts(obs, keys, mode, **options)
    return (obs.join(cuts, list(keys)).filter((F.col("b") <= F.col("cut_b")) & (F.col("t") <= F.col("cut_t")))
            .drop("cut_b", "cut_t"))


def outlier_report(obs: DataFrame, keys: Sequence[str], mode: str, **options) -> DataFrame:
    """n_total, n_kept, n_dropped and the cuts, per group."""
    keys = list(keys)
    if mode == "none":
        null = F.lit(None).cast("double")
        rows = obs.withColumn("cut_b", null).withColumn("cut_t", null)
        keep = F.lit(True)
    else:
        rows = obs.join(outlier_cuts(obs, keys, mode, **options), keys)
        keep = (F.col("b") <= F.col("cut_b")) & (F.col("t") <= F.col("cut_t"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(keep).alias("n_kept"),
        F.count_if(~keep).alias("n_dropped"), F.max("cut_b").alias("cut_b"), F.max("cut_t").alias("cut_t"))


def pct_change(obs: DataFrame, cap: float | None = 1000.0, drop_silenced: bool = False) -> DataFrame:
    """Percent change for displays, with the cap and silenced rules applied."""
    out = obs.withColumn("pct", capped_pct(F.col("b"), F.col("t"), cap)).filter("pct IS NOT NULL")
    return keep_pct(out, cap, drop_silenced)


def keep_pct(df: DataFrame, cap: float | None, drop_silenced: bool) -> DataFrame:
    if drop_silenced:
        df = df.filter(~(F.abs(F.col("pct") + 100) < 1e-6))
    return df if cap is None else df.filter(F.col("pct") <= cap)


def burst_pct_change(burst_obs: DataFrame, spike_obs: DataFrame, minimum: float = 0.0,
                     cap: float | None = 1000.0, drop_silenced: bool = False,
                     drop_silent: bool = True) -> DataFrame:
    """Percent change in burst rate of channels that burst at baseline and fire at all."""
    key = ["study", "pair_no", "channel"]
    spike = spike_obs.select(*key, F.col("b").alias("sb"), F.col("t").alias("st"))
    rows = burst_obs.join(spike, key).dropna(subset=["b", "t", "sb", "st"])
    if drop_silent:
        rows = keep_not_silent(rows, "both_zero", minimum)
    sb, st = F.col("sb"), F.col("st")
    rows = rows.filter(~(((sb < 0) & (st < 0)) | ((sb == 0) & (st == 0)))).filter("b > 0")
    rows = rows.withColumn("pct", 100.0 * (F.col("t") - F.col("b")) / F.col("b"))
    return keep_pct(rows, cap, drop_silenced).drop("sb", "st")


def direction_shares(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    b, t = F.col("b"), F.col("t")
    return obs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.count_if(t > b) / F.count(F.lit(1))).alias("pct_increased"),
        (100.0 * F.count_if(t < b) / F.count(F.lit(1))).alias("pct_decreased"))


def category_counts(obs: DataFrame, keys: Sequence[str], rel_tol: float = 1e-6) -> DataFrame:
    """Counts per group of each change category among baseline-active channels."""
    cat = change_category(F.col("b"), F.col("t"), rel_tol)
    return (obs.withColumn("category", cat).filter("category IS NOT NULL").groupBy(*keys).agg(
        *[F.count_if(F.col("category") == c).alias(f"n_{c}")
          for c in ("silenced", "decreased", "increased", "unchanged")]))


def category_shares(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentages per recording; unchanged rows stay out of the denominator."""
    den = F.col("n_silenced") + F.col("n_decreased") + F.col("n_increased")
    return counts.filter(den > 0).select(
        *keys, *[(100.0 * F.col(f"n_{c}") / den).alias(f"pct_{c}")
                 for c in ("silenced", "decreased", "increased")])


def category_report(obs: DataFrame, study_keys: Sequence[str], recording_keys: Sequence[str]) -> DataFrame:
    """Totals, and median and mean over recordings of the category percentages."""
    study_keys, recording_keys = list(study_keys), list(recording_keys)
    counts = category_counts(obs, recording_keys)
    totals = counts.groupBy(*study_keys).agg(
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in ("silenced", "decreased", "increased", "unchanged")])
    shares = category_shares(counts, recording_keys)
    names = ("silenced", "decreased", "increased")
    means = shares.groupBy(*study_keys).agg(
        F.count(F.lit(1)).alias("n_recordings"), *[F.avg(f"pct_{c}").alias(f"mean_pct_{c}") for c in names])
    long = shares.select(*study_keys, F.explode(F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(f"pct_{c}").alias("pct")) for c in names])).alias("x"))
    medians = percentile_mid(long.select(*study_keys, "x.*"), [*study_keys, "category"], "pct", {"m": 50})
    wide = medians.groupBy(*study_keys).agg(
        *[F.max(F.when(F.col("category") == c, F.col("m"))).alias(f"median_pct_{c}") for c in names])
    return totals.join(means, study_keys, "left").join(wide, study_keys, "left")


def violin_summary(df: DataFrame, keys: Sequence[str], value: str = "pct") -> DataFrame:
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.avg(v).alias("mean_pct"),
        (100.0 * F.count_if(v > 0) / F.count(v)).alias("pct_above_zero"),
        (100.0 * F.count_if(v < 0) / F.count(v)).alias("pct_below_zero"))
    q = percentile_mid(df, keys, value, {"median_pct": 50, "q1": 25, "q3": 75})
    return q.join(base, list(keys))


def box_stats(df: DataFrame, keys: Sequence[str], value: str = "pct") -> DataFrame:
    """Quartiles, Tukey fences, upper whisker, inlier mean and axis top."""
    keys, v = list(keys), F.col(value)
    q = percentile_mid(df, keys, value, {"q1": 25, "median": 50, "q3": 75})
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("lower_fence", F.col("q1") - 1.5 * iqr).withColumn("upper_fence", F.col("q3") + 1.5 * iqr)
    inside = v.between(F.col("lower_fence"), F.col("upper_fence"))
    agg = df.join(q, keys).groupBy(*keys).agg(
        F.max(F.when(v <= F.col("upper_fence"), v)).alias("_top"),
        F.coalesce(F.avg(F.when(inside, v)), F.avg(v)).alias("mean_inlier"))
    whisker = F.coalesce("_top", "q3")
    head = F.greatest(F.lit(30.0), 0.15 * (whisker + 100))
    return q.join(agg, keys).select(
        *keys, "n", "q1", "median", "q3", "lower_fence", "upper_fence", whisker.alias("whisker_top"),
        "mean_inlier", (F.ceil((whisker + head) / 50) * 50).cast("double").alias("axis_top"))


def inlier_mean_iqr(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and quartiles of the Tukey inliers (all rows when the IQR is zero)."""
    keys, v = list(keys), F.col(value)
    q = percentile_mid(df, keys, value, {"_q1": 25, "_q3": 75}).drop("n")
    iqr = F.col("_q3") - F.col("_q1")
    inside = (iqr <= 0) | v.between(F.col("_q1") - 1.5 * iqr, F.col("_q3") + 1.5 * iqr)
    kept = df.join(q, keys).filter(inside).select(*keys, value)
    return percentile_mid(kept, keys, value, {"q1": 25, "q3": 75}).join(
        kept.groupBy(*keys).agg(F.avg(v).alias("mean")), keys)


def log_floor(obs: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Lowest value a log axis shows: half the threshold or half the least positive."""
    if threshold > 0:
        floor: Column = F.lit(threshold * 0.5)
        return obs.select(*keys).distinct().withColumn("floor", floor)
    least = F.min(F.when(F.col("y") > 0, F.col("y")))
    return pooled(obs, keys).groupBy(*keys).agg(F.coalesce(0.5 * least, F.lit(0.1)).alias("floor"))


def on_log_axis(obs: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Values clipped to the floor, and the scatter's direction flag."""
    rows = obs.join(log_floor(obs, keys, threshold), list(keys))
    return rows.withColumn("b_plot", F.greatest("b", "floor")).withColumn(
        "t_plot", F.greatest("t", "floor")).withColumn("increased", F.col("t") > F.col("b"))


def qc_report(summary: DataFrame, recordings: DataFrame, min_rate: float = 6.0,
              min_active: int = 5, max_median: float = 2000.0) -> DataFrame:
    """Active channels, their median rate, bursts and anomaly flags per recording."""
    active = summary.filter(F.col("spike_rate") >= min_rate)
    med = percentile_mid(active, ["recording_id"], "spike_rate", {"median_active_rate": 50}).drop("n")
    agg = summary.groupBy("recording_id").agg(
        F.count_if(F.col("spike_rate") >= min_rate).alias("n_active"),
        F.sum("n_bursts").alias("n_bursts"))
    return (recordings.select("recording_id", "fs", "duration_us").join(agg, "recording_id")
            .join(med, "recording_id", "left")
            .withColumn("few_active", F.col("n_active") < min_active)
            .withColumn("rate_high", F.coalesce(F.col("median_active_rate") > max_median, F.lit(False))))


def representative_channels(obs: DataFrame, keys: Sequence[str], wanted: int, rate_floor: float = 5.0,
                            ceiling_pct: float = 98.0, top_fraction: float = 0.7) -> DataFrame:
    """Channels that carry the group's direction and span its baseline rates.

    The group is one pair of recordings, so it holds at most the array's 60
    channels; the ranks below are windows over that. A pick that falls on a taken
    rank moves to the lowest unused one.
    """
    keys = list(keys)
    b, t = F.col("b"), F.col("t")
    alive = obs.filter((b >= rate_floor) & (t >= 0.05))
    ceil = alive.groupBy(*keys).agg(small_percentile(b, ceiling_pct).alias("_ceil"))
    elig = alive.join(ceil, keys).filter(b <= F.col("_ceil"))
    elig = elig.withColumn("score", (t - b) / F.greatest(F.lit(1.0), b))
    w = Window.partitionBy(*keys)
    elig = elig.withColumn("n", F.count(F.lit(1)).over(w))
    sign = elig.groupBy(*keys).agg(F.signum(small_percentile(F.col("score"), 50.0)).alias("_sign"))
    on = elig.join(sign, keys).withColumn(
        "on_story", F.col("score") * F.when(F.col("_sign") == 0, 1.0).otherwise(F.col("_sign")))
    n_top = F.greatest(F.lit(wanted), F.floor(F.col("n") * top_fraction + 0.5).cast("int"))
    on = on.withColumn("_r", F.row_number().over(w.orderBy(F.desc("on_story"), "channel")))
    few = on.filter(F.col("n") <= wanted).select(*keys, "channel")
    top = on.filter((F.col("n") > wanted) & (F.col("_r") <= n_top))
    top = top.withColumn("rank", F.row_number().over(w.orderBy("b", "_r"))).withColumn(
        "m", F.count(F.lit(1)).over(w))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda k: F.floor(
        1 + k * (F.col("m") - 1) / max(wanted - 1, 1) + 0.5).cast("int"))
    if wanted == 1:
        spaced = F.array(F.col("m").cast("int"))
    picks = F.array_distinct(spaced)
    spare = F.filter(F.sequence(F.lit(1), F.col("m").cast("int")), lambda r: ~F.array_contains(picks, r))
    chosen = F.concat(picks, F.slice(spare, F.lit(1), F.lit(wanted) - F.size(picks)))
    many = top.filter(F.array_contains(chosen, F.col("rank").cast("int"))).select(*keys, "channel")
    return few.unionByName(many)
