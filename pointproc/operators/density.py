"""Kernel density of grouped values on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.functions.quantile import percentile_mid


def kernel_density(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float,
                   points: int = 180, bandwidth: float | None = None, lower_bound: float | None = None) -> DataFrame:
    """keys, k, y, density, relative (density over its maximum).

    Gaussian kernel. Default bandwidth: sigma * (4 / 3n)^0.2 with sigma the median
    absolute deviation over 0.6745 (1 when it is 0). With ``lower_bound`` the values
    are reflected there. Equal values are merged first, and every row adds to the
    fixed grid map-side, so only ``points`` sums per group and task are shuffled.
    """
    keys, v = list(keys), F.col(value)
    vals = df.filter(v.isNotNull()).groupBy(*keys, v.cast("double").alias(value)).agg(F.count(F.lit(1)).alias("c"))
    med = percentile_mid(df, keys, value, {"_med": 50})
    if bandwidth is None:
        dev = df.join(med.select(*keys, "_med"), keys).select(*keys, F.abs(v - F.col("_med")).alias("dev"))
        mad = percentile_mid(dev, keys, "dev", {"_mad": 50}).drop("n")
        sigma = F.when(F.col("_mad") > 0, F.col("_mad") / 0.6745).otherwise(1.0)
        width = med.join(mad, keys).select(*keys, "n", (sigma * F.pow(4.0 / (3.0 * F.col("n")), F.lit(0.2))).alias("h"))
    else:
        width = med.select(*keys, "n", F.lit(float(bandwidth)).alias("h"))
    step = (hi - lo) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(lo) + k * F.lit(step))

    def bump(at):
        z = (F.col("y") - at) / F.col("h")
        return F.exp(-0.5 * z * z)

    kernel = bump(v)
    if lower_bound is not None:
        kernel = kernel + bump(2 * F.lit(float(lower_bound)) - v)
    rows = vals.join(width, keys).select("*", F.posexplode(grid).alias("k", "y"))
    dens = rows.groupBy(*keys, "k", "y").agg(
        (F.sum(F.col("c") * kernel) / (F.max("n") * F.max("h") * (2 * 3.141592653589793) ** 0.5)).alias("density"))
    top = dens.groupBy(*keys).agg(F.max("density").alias("_top"))
    return dens.join(top, keys).select(*keys, "k", "y", "density", (F.col("density") / F.col("_top")).alias("relative"))
