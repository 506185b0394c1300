import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointproc.functions.quantile import array_median
from pointproc.functions.resample import draw_word
from pointproc.operators import stats as st


def obs(spark, b, t, key="e"):
    return spark.createDataFrame([(key, k, float(x), float(y)) for k, (x, y) in enumerate(zip(b, t))],
                                 "e string, ord bigint, b double, t double")


def test_hash_word(spark):
    assert spark.range(1).select(draw_word(1, 2).alias("w")).first()["w"] == int(hashlib.md5(b"1|2").hexdigest()[:15], 16)


def test_bh_known(spark):
    p = [0.001, 0.01, 0.02, 0.03, 0.04, 0.2, 0.4]
    df = spark.createDataFrame([("f", x) for x in p], "f string, p double")
    got = {r["p"]: (r["p_adj"], r["rejected"]) for r in st.bh_fdr(df, ["f"], "p").collect()}
    want = [0.007, 0.035, 0.14 / 3, 0.0525, 0.056, 0.7 / 3, 0.4]
    for x, w in zip(p, want):
        assert got[x][0] == pytest.approx(w) and got[x][1] == (w <= 0.05)


def test_bh_ties_and_missing(spark):
    p = [0.01, 0.01, 0.5, 0.5, None]
    df = spark.createDataFrame([("f", x) for x in p], "f string, p double")
    got = sorted((r["p"] if r["p"] is not None else 9, r["p_adj"]) for r in st.bh_fdr(df, ["f"], "p").collect())
    assert [g[1] for g in got] == [pytest.approx(0.025), pytest.approx(0.025), pytest.approx(0.625), pytest.approx(0.625), None]


def test_hedges(spark):
    g = st.hedges_g_av(obs(spark, range(1, 7), range(2, 8)), ["e"]).first()["hedges_g"]
    assert g == pytest.approx((1 / math.sqrt(3.5)) * (1 - 3 / 19))
    assert st.hedges_g_av(obs(spark, [1, 1], [1, 1]), ["e"]).first()["hedges_g"] is None
    assert st.hedges_g_av(obs(spark, [1], [2]), ["e"]).first()["hedges_g"] is None


def exact_p(d):
    d = [x for x in d if x]
    a = np.abs(d)
    ranks = np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])
    w = ranks[np.array(d) > 0].sum()
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    lo, hi = np.mean([s <= w for s in sums]), np.mean([s >= w for s in sums])
    return w, min(1.0, 2 * min(lo, hi))


@pytest.mark.parametrize("seed", range(3))
def test_signed_rank_exact(spark, seed):
    rnd = random.Random(seed)
    b = [rnd.randint(0, 6) for _ in range(11)]
    t = [rnd.randint(0, 9) for _ in range(11)]
    row = st.signed_rank(obs(spark, b, t), ["e"]).first()
    w, p = exact_p([y - x for x, y in zip(b, t)])
    assert row["w"] == w and row["p_wilcoxon"] == pytest.approx(p)


def test_signed_rank_approximate_is_close_to_exact(spark):
    rnd = random.Random(4)
    b = [rnd.random() for _ in range(200)]
    t = [x + rnd.gauss(0.05, 0.3) for x in b]
    near = st.signed_rank(obs(spark, b, t), ["e"]).first()["p_wilcoxon"]
    far = st.signed_rank(obs(spark, b, t), ["e"], "approximate").first()["p_wilcoxon"]
    assert far == pytest.approx(near, rel=0.05)
    with pytest.raises(ValueError, match="method"):
        st.signed_rank(obs(spark, b, t), ["e"], "auto")


def test_endpoints_without_differences_or_pairs(spark):
    rows = [("same", 1, 2.0, 2.0), ("same", 2, 3.0, 3.0), ("none", 1, None, 2.0), ("some", 1, 1.0, 2.0), ("some", 2, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "e string, ord bigint, b double, t double")
    ranks = {r["e"]: (r["n_nonzero"], r["w"], r["r_rank_biserial"], r["p_wilcoxon"]) for r in st.signed_rank(df, ["e"]).collect()}
    assert ranks["same"] == (0, 0.0, None, 1.0) and ranks["none"] == (None, None, None, None) and ranks["some"][0] == 2
    got = {r["e"]: r for r in st.paired_stats(df, ["e"], "ord", 100, 50).collect()}
    assert set(got) == {"same", "none", "some"} and got["none"]["n"] == 0 and got["none"]["median_delta"] is None
    assert got["same"]["p_wilcoxon"] == 1.0 and got["same"]["n"] == 2


def test_permutation(spark):
    a, b = [5.0, 6.0, 7.0, 8.0, 9.0, 10.0], [1.0, 2.0, 3.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "grp string, y double")
    r = st.permutation_test(spark, df).first()
    pool = a + b
    stats = [np.median([pool[k] for k in c]) - np.median([pool[k] for k in range(9) if k not in c])
             for c in itertools.combinations(range(9), 6)]
    seen = np.median(a) - np.median(b)
    assert r["n_permutations"] == 84 and r["observed"] == seen
    assert r["p_right"] == pytest.approx(np.mean(np.array(stats) >= seen))
    assert r["p_value"] == pytest.approx(min(1, 2 * min(np.mean(np.array(stats) >= seen), np.mean(np.array(stats) <= seen))))
    mean = st.permutation_test(spark, df, lambda x, y: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) - array_median(y), "right").first()
    assert mean["observed"] == 43.0 and mean["p_value"] == mean["p_right"]
    with pytest.raises(ValueError):
        st.permutation_test(spark, df.filter("grp = 'a'"))
    with pytest.raises(ValueError):
        st.permutation_test(spark, df, tails="both")


def test_chi2(spark):
    df = spark.createDataFrame([(30, 10), (0, 0)], "n_increased bigint, n_decreased bigint")
    got = {r["n_increased"]: r for r in st.chi2_even(df).collect()}
    assert got[30]["chi2"] == 10.0 and got[30]["p"] == pytest.approx(math.erfc(math.sqrt(5)))
    assert got[0]["chi2"] is None and got[0]["p"] is None


def test_bootstrap_is_repeatable_and_sane(spark):
    o = obs(spark, range(10, 16), [b + d for b, d in zip(range(10, 16), (2, 3, 4, 5, 6, 7))])
    a = st.paired_stats(o, ["e"], "ord", 4, 300, 1).first()
    b = st.paired_stats(o.repartition(3), ["e"], "ord", 4, 300, 1).first()
    assert a == b
    assert 2 <= a["ci_lo"] <= a["median_delta"] == 4.5 <= a["ci_hi"] <= 7
    assert a["p"] == 0.0 and a["n"] == 6 and a["hedges_g"] > 0 and 0 <= a["p_wilcoxon"] <= 1


def test_two_level_draw_sizes(spark):
    rows = [("e", c, k, 0.0, float(c * 100 + k)) for c in (1, 2, 3) for k in range(c * 3)]
    o = spark.createDataFrame(rows, "e string, c bigint, ord bigint, b double, t double")
    reps = st.bootstrap_two_level(o, ["e"], "c", "ord", 8, 50, 1)
    got = [r["delta"] for r in reps.collect()]
    assert len(got) == 50 and min(got) >= 100 and max(got) <= 308 and len(set(got)) > 5


def test_safe_percent_rules(spark):
    from pointproc.functions.scalar import capped_pct, change_category, p_text, safe_pct

    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 3.0), (2.0, 0.0), (2.0, 3.0), (2.0, 2.0)], "b double, t double")
    b, t = F.col("b"), F.col("t")
    got = rows.select(safe_pct(b, t).alias("s"), capped_pct(b, t, 1000.0).alias("c"), change_category(b, t).alias("k")).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (1e6, 1000.0, None), (-100.0, -100.0, "silenced"),
                                       (50.0, 50.0, "increased"), (0.0, 0.0, "unchanged")]
    ps = [0.0004, 0.0075, 0.0125, 0.05, 0.9996, 1.0, float("nan"), 0.0005, 0.3335]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    want = ["n/a" if p != p else "<0.001" if p < 0.001 else f"{p:.3f}" for p in ps]
    assert [r[0] for r in df.select(p_text(F.col("p"))).collect()] == want


@pytest.mark.parametrize("n,k", [(1, 1), (5, 2), (7, 7), (9, 4)])
def test_combinations_by_number(spark, n, k):
    got = spark.range(math.comb(n, k)).select(st._combination(F.col("id"), n, k).alias("m")).collect()
    assert [tuple(r["m"]) for r in got] == list(itertools.combinations(range(n), k))


def test_normal_signed_rank_of_millions(spark):
    # a count of differences, and of equal ones, whose cube is beyond BIGINT
    n, up = 5_000_000, 2_502_000
    rows = spark.range(n).select(F.lit("e").alias("e"), F.lit(0.0).alias("b"), F.when(F.col("id") < up, 1.0).otherwise(-1.0).alias("t"))
    got = st.signed_rank(rows, ["e"], "approximate").first()
    z = (2 * up - n) / math.sqrt(n)
    assert got["n_nonzero"] == n and got["w"] == up * (n + 1) / 2
    assert got["p_wilcoxon"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
