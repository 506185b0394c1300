import math
import random

import pytest
from pyspark.sql import functions as F

from pointproc.functions import quantile
from pointproc.functions.quantile import array_percentile, cumulative, percentile_mid


def by_rule(values, p):
    a, n = sorted(values), len(values)
    pos = min(max(p * n / 100 + 0.5, 1), n)
    lo = math.floor(pos)
    hi = min(lo + 1, n)
    return a[lo - 1] + (a[hi - 1] - a[lo - 1]) * (pos - lo)


@pytest.mark.parametrize("values,p,want", [
    ([1, 2, 3, 4], 25, 1.5), ([1, 2, 3, 4, 5, 6], 97.5, 6.0), ([7], 50, 7.0), ([1, 2, 3, 4], 50, 2.5), ([3, 1, 2], 0, 1.0)])
def test_known_values(spark, values, p, want):
    df = spark.createDataFrame([(float(v),) for v in values], "y double")
    assert percentile_mid(df, [], "y", {"q": p}).first()["q"] == pytest.approx(want)
    arr = df.agg(F.collect_list("y").alias("a")).select(array_percentile(F.col("a"), p).alias("q"))
    assert arr.first()["q"] == pytest.approx(want)


def test_random_groups(spark):
    rnd = random.Random(5)
    groups = {
        "wide": [rnd.gauss(0, 1) * 10 ** rnd.randint(-6, 6) for _ in range(700)],
        "ties": [float(rnd.randint(-3, 3)) for _ in range(500)],
        "near": [1000 + rnd.random() for _ in range(300)],
        "one": [0.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), ("ties", float("nan"))]
    df = spark.createDataFrame(rows, "g string, y double")
    probs = {"a": 2.5, "b": 25, "c": 50, "d": 97.5, "e": 100}
    for row in percentile_mid(df, ["g"], "y", probs).collect():
        assert row["n"] == len(groups[row["g"]])
        for name, p in probs.items():
            assert row[name] == pytest.approx(by_rule(groups[row["g"]], p), rel=1e-12), (row["g"], p)


def test_cumulative_counts(spark):
    df = spark.createDataFrame([(v,) for v in [2.0, -1.0, 2.0, 0.0, -0.0, 5.5]], "y double")
    got = sorted((r["y"], r["cnt"], r["below"], r["total"]) for r in cumulative(df, [], "y").collect())
    assert got == [(-1.0, 1, 0, 6), (0.0, 2, 1, 6), (2.0, 2, 3, 6), (5.5, 1, 5, 6)]


def test_empty_array_is_null(spark):
    assert spark.range(1).select(array_percentile(F.expr("CAST(array() AS ARRAY<DOUBLE>)"), 50).alias("q")).first()["q"] is None


def test_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, float("inf"), float("inf"), float("-inf"), 2.0]], "y double")
    row = percentile_mid(df, [], "y", {"lo": 1, "mid": 50, "hi": 90}).first()
    assert (row["lo"], row["mid"], row["hi"]) == (float("-inf"), 2.0, float("inf"))


def test_close_values_spread_over_buckets(spark):
    start = 1_700_000_000_000_000.0  # microseconds: all in one bucket of magnitude
    df = spark.range(20_000).selectExpr(f"{start!r}D + id * 7 AS y")
    got = cumulative(df, [], "y")
    assert got.filter("below != (y - 1.7e15) / 7 OR total != 20000 OR cnt != 1").isEmpty() and got.count() == 20_000
    assert percentile_mid(df, [], "y", {"m": 50}).first()["m"] == start + 9999.5 * 7


def test_close_values_beside_an_outlier_are_cut_evenly(spark):
    near = spark.range(200_000).select((F.lit(1.7e15) + F.col("id")).alias("y"))
    df = near.unionAll(spark.createDataFrame([(1.7e15 + 1e12,)], "y double")).withColumn("_bucket", F.lit(1))
    cuts = df.join(quantile._splitters(df, ["_bucket"], "y"), "_bucket").groupBy(quantile._place(F.col("_splits"), F.col("y")).alias("cut"))
    sizes = sorted(r["count"] for r in cuts.count().collect())
    assert len(sizes) == quantile._CUTS and sizes[-1] < 3 * sizes[len(sizes) // 2]
    got = percentile_mid(df, [], "y", {"a": 0, "b": 50, "c": 100}).first()
    assert (got["a"], got["b"], got["c"]) == (1.7e15, 1.7e15 + 100_000, 1.7e15 + 1e12)
    ranked = cumulative(df, [], "y")
    assert ranked.count() == 200_001 and ranked.filter("y < 1.7e15 + 1e11 AND below <> y - 1.7e15").isEmpty()
