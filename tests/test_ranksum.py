"""Exact rank-sum tails: both ways agree, and large endpoints stay within a small memory."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointproc.functions.ranksum import folded_tail, fourier_tail, two_sided
from pointproc.operators import stats


def ranks_of(counts):
    counts = np.asarray(counts)
    return 2 * (np.cumsum(counts) - counts) + counts + 1, counts


@pytest.mark.parametrize("counts", [[1] * 7, [1] * 180, [3, 1, 5, 2] * 20, [90, 1], [1, 90], [120], [40, 1, 1, 40, 2]])
def test_fourier_tail_equals_folding(counts):
    r, c = ranks_of(counts)
    total = int((r * c).sum())
    for share in (0, 0.003, 0.05, 0.2, 0.4, 0.49, 0.5):
        w = int(total * share)
        assert fourier_tail(r, c, w) == pytest.approx(folded_tail(r, c, w), rel=1e-9)


def test_fifty_thousand_differences_in_little_memory():
    n = 50_000
    r, c = ranks_of(np.ones(n, int))
    sd = 2 * math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    tracemalloc.start()
    for z in (0.5, 2, 4):  # the normal tail itself is off by more than this further out
        p = two_sided(r, c, int((r * c).sum() / 2 - z * sd))
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-3)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert two_sided(r, c, 0) == 0.0 and two_sided(r, c, int((r * c).sum()) // 2) == pytest.approx(1.0, abs=1e-6)


def test_signed_rank_of_a_large_endpoint(spark):
    obs = spark.range(20_000).select(
        F.lit("x").alias("k"), (F.rand(3) * 0).alias("b"), (F.randn(5) + 0.02).alias("t"))
    exact = stats.signed_rank(obs, ["k"]).first()
    near = stats.signed_rank(obs, ["k"], method="approximate").first()
    assert exact["n_nonzero"] == 20_000 and exact["p_wilcoxon"] == pytest.approx(near["p_wilcoxon"], rel=1e-2)
