"""Rate reports: did activity change between baseline and treatment?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.operators.observations import (
    burst_pct_change, direction_shares, drop_outliers, keep_not_silent, outlier_mode, pct_change)
from pointproc.operators.stats import bh_fdr, bootstrap_two_level, interval_and_p, paired_stats
from pointproc.functions.quantile import percentile_mid
from pointproc.params import DEFAULTS, Params
from pointproc.session import cut_lineage


#: Block length of ``ord``: 64 pairs.
ORDER_WIDTH = 1 << 38


def ordered(obs: DataFrame) -> DataFrame:
    """Observations with ``ord``: a BIGINT that orders (pair, channel) without collisions."""
    return obs.withColumn("ord", F.shiftleft(F.col("pair_no").cast("bigint"), 32) + F.col("channel"))


def rate_report(obs: DataFrame, minimum: float, params: Params = DEFAULTS, mode: str | None = None,
                outliers: str | None = None, drop_mean_multiplier: bool = False, iterations: int | None = None,
                keys: Sequence[str] = ("study", "metric")) -> DataFrame:
    """Silent filter, outlier filter, direction shares and paired statistics."""
    keys = list(keys)
    o = params.observation
    rows = keep_not_silent(obs, mode or o.silent_mode, minimum)
    rows = drop_outliers(rows, keys, outlier_mode(outliers or o.outlier_mode, drop_mean_multiplier))
    stats = paired_stats(ordered(rows), keys, "ord", ORDER_WIDTH, iterations or params.stats.n_bootstrap,
                         params.stats.bootstrap_seed)
    return direction_shares(rows, keys).drop("n").join(stats, keys)


def study_bootstrap(spike_obs: DataFrame, burst_obs: DataFrame, params: Params = DEFAULTS,
                    iterations: int | None = None, keys: Sequence[str] = ("study",)) -> DataFrame:
    """Hierarchical bootstrap of the percent change in firing and burst rate.

    Recordings are drawn first, then channels within each; the two p-values of a
    study form one family.
    """
    keys, o = list(keys), params.observation
    pct = pct_change(spike_obs, o.pct_max_include, o.exclude_silenced_pct).unionByName(
        burst_pct_change(burst_obs, spike_obs, o.min_rate_burst, o.pct_max_include, o.exclude_silenced_pct))
    by = [*keys, "metric"]
    pct = cut_lineage(pct)
    # the statistic is the median of pct itself: hand it over as a difference to 0
    rows = ordered(pct).select(*by, "pair_no", "ord", F.lit(0.0).alias("b"), F.col("pct").alias("t"))
    reps = bootstrap_two_level(rows, by, "pair_no", "ord", ORDER_WIDTH, iterations or params.stats.n_bootstrap,
                               params.stats.bootstrap_seed)
    seen = percentile_mid(pct, by, "pct", {"observed": 50}).withColumnRenamed("n", "n_channels")
    sets = pct.groupBy(*by).agg(F.countDistinct("pair_no").alias("n_datasets"))
    out = seen.join(sets, by).join(interval_and_p(reps, by, "delta"), by)
    return bh_fdr(cut_lineage(out), keys, "p", params.stats.fdr_q)
