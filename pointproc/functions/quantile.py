"""Exact order statistics: percentiles by the (k - 1/2)/n rule, and ranks.

The percentile rule puts the k-th smallest of n values at 100*(k - 1/2)/n and
clamps outside, which differs from the built-in ``percentile``.

Two forms. ``array_percentile`` is an expression over a sorted array, for groups
of proven small size (the edges of one 60-electrode graph, the replicates of one
bootstrap). ``percentile_mid`` and ``cumulative`` work on groups of any size:
equal values are merged before the first shuffle, the distinct values of a group
are spread over magnitude buckets, which are cut at sketched quantiles where many
values lie close together, and only bucket totals are scanned per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS = 1024  # buckets per factor of two
_FILL = 4096   # distinct values beyond which a bucket is cut
_CUTS = 256    # cuts of such a bucket, a power of two


def _magnitude_bucket(v: Column) -> Column:
    """A BIGINT that never decreases as ``v`` grows; about 0.1 % wide."""
    a = F.abs(v)
    e = F.floor(F.log2(a))
    within = F.floor((a / F.pow(F.lit(2.0), e) - 1) * _STEPS)
    level = ((e + 1100) * _STEPS + within).cast("bigint") + 1
    level = F.when(a == float("inf"), F.lit(1 << 40)).otherwise(level)
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, level).otherwise(-level)


def _splitters(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, _splits: ``_CUTS`` - 1 ascending values that share out each group of more than ``_FILL`` rows.

    They come from a mergeable quantile sketch and only place cuts, so its error moves
    no result. Groups are counted first: the many small ones get no sketch.
    """
    full = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > _FILL).drop("_rows")
    shares = F.array(*[F.lit(k / _CUTS) for k in range(1, _CUTS)])
    return values.select(*keys, value).join(full, list(keys)).groupBy(*keys).agg(
        F.percentile_approx(value, shares, 10 * _CUTS).alias("_splits"))


def _place(splits: Column, v: Column) -> Column:
    """How many of the splitters are at most ``v``, by bisection."""
    steps = F.array(*[F.lit(_CUTS >> k) for k in range(1, _CUTS.bit_length())])
    return F.when(splits.isNotNull(), F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.get(splits, at + step - 1) <= v, step).otherwise(0)))


def cumulative(df: DataFrame, keys: Sequence[str], value: str,
               sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (keys, distinct value) with ``cnt``, ``below`` and ``total``.

    ``below`` counts the group's rows with a smaller value. ``sums`` adds per-value
    sums of further expressions. NULL and NaN values are left out.
    """
    keys, sums = list(keys), dict(sums or {})
    coarse, part = [*keys, "_bucket"], [*keys, "_bucket", "_cut"]
    v = F.col(value)
    merged = (
        df.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
        .groupBy(*keys, v.cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])
        # -0.0 and 0.0 are one value
        .withColumn(value, F.col(value) + F.lit(0.0))
        .withColumn("_bucket", _magnitude_bucket(F.col(value)))
    )
    vals = merged.join(_splitters(merged, coarse, value), coarse, "left").withColumn(
        "_cut", F.coalesce(_place(F.col("_splits"), F.col(value)), F.lit(0))).drop("_splits")
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    past = group.orderBy("_bucket", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        vals.groupBy(*part).agg(F.sum("cnt").alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_offset"),
                F.sum("_n").over(group).alias("total"))
    )
    inner = (Window.partitionBy(*part).orderBy(value)
             .rowsBetween(Window.unboundedPreceding, -1))
    return (
        vals.withColumn("_inner", F.coalesce(F.sum("cnt").over(inner), F.lit(0)))
        .join(buckets, part)
        .select(*keys, value, "cnt", *sums, (F.col("_offset") + F.col("_inner")).alias("below"),
                "total")
    )


def _target(p: float, n: Column) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and weight of the upper one, for percentile ``p``."""
    pos = F.lit(float(p)) * n / 100.0 + 0.5
    lo = F.least(F.greatest(F.floor(pos), F.lit(1)), n)
    hi = F.least(F.greatest(F.ceil(pos), F.lit(1)), n)
    return lo, hi, F.least(F.greatest(pos, F.lit(1.0)), n.cast("double")) - lo


def percentile_mid(df: DataFrame, keys: Sequence[str], value: str,
                   probs: Mapping[str, float]) -> DataFrame:
    """One row per group with a column for each named percentile, and ``n``."""
    keys = list(keys)
    cum = cumulative(df, keys, value)
    v, n, below, last = F.col(value), F.col("total"), F.col("below"), F.col("below") + F.col("cnt")
    picks = []
    for name, p in probs.items():
        lo, hi, _ = _target(p, n)
        picks += [
            F.max(F.when((below < lo) & (lo <= last), v)).alias(f"_{name}_lo"),
            F.max(F.when((below < hi) & (hi <= last), v)).alias(f"_{name}_hi"),
        ]
    got = cum.groupBy(*keys).agg(F.max("total").alias("n"), *picks)
    cols = []
    for name, p in probs.items():
        w = _target(p, F.col("n"))[2]
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * w).alias(name))
    return got.filter(F.col("n") > 0).select(*keys, F.col("n").cast("bigint").alias("n"), *cols)


def array_percentile(values: Column, p: float) -> Column:
    """Percentile of a small array; NULL for an empty one."""
    a = F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
    n = F.size(a)
    lo, hi, w = _target(p, n)
    at_lo, at_hi = F.get(a, (lo - 1).cast("int")), F.get(a, (hi - 1).cast("int"))
    between = F.when(at_lo == at_hi, at_lo).otherwise(at_lo + (at_hi - at_lo) * w)
    return F.when(n > 0, between)


def small_percentile(value: Column, p: float) -> Column:
    """Aggregate form of ``array_percentile`` for groups of proven small size."""
    return array_percentile(F.collect_list(value.cast("double")), p)


def array_median(values: Column) -> Column:
    return array_percentile(values, 50.0)
