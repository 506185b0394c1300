import pytest
from pyspark.sql import functions as F

from pointproc.operators import observations as ob


@pytest.fixture
def obs(spark):
    rows = [("doi", 1, 1, 0.0, 0.0), ("doi", 1, 2, 8.0, 9.0), ("doi", 1, 3, 7.0, 0.0), ("doi", 1, 4, 2.0, 9.0),
            ("doi", 2, 1, 0.0, 4.0), ("doi", 2, 2, 6.0, 6.0), ("doi", 2, 3, 100.0, 50.0)]
    return spark.createDataFrame(rows, "study string, pair_no bigint, channel int, b double, t double").withColumn(
        "metric", F.lit("spike_rate"))


def keys(df):
    return sorted((r["pair_no"], r["channel"]) for r in df.collect())


def test_silent_modes(obs):
    assert keys(ob.keep_not_silent(obs, "baseline_min", 6.0)) == [(1, 2), (1, 3), (2, 2), (2, 3)]
    assert keys(ob.keep_not_silent(obs, "both_zero", 6.0)) == [(1, 2), (1, 3), (1, 4), (2, 2), (2, 3)]
    assert keys(ob.keep_not_silent(obs, "both_zero", 0.0)) == [(1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3)]
    assert keys(ob.keep_not_silent(obs, "either_zero", 6.0)) == [(1, 2), (2, 2), (2, 3)]
    assert len(keys(ob.keep_not_silent(obs, "other", 6.0))) == 7


def test_outliers(obs):
    got = ob.outlier_report(obs, ["metric"], "tukey", iqr_factor=3.0).first()
    assert (got["n_total"], got["n_kept"], got["n_dropped"]) == (7, 6, 1)
    assert ob.outlier_report(obs, ["metric"], "none").first()["n_dropped"] == 0
    assert (2, 3) not in keys(ob.drop_outliers(obs, ["metric"], "tukey"))
    assert ob.outlier_mode("tukey", True) == "mean_multiplier" and ob.outlier_mode("none", True) == "none"


def test_categories(obs):
    r = ob.category_report(obs, ["study"], ["study", "pair_no"]).first()
    assert (r["n_silenced"], r["n_decreased"], r["n_increased"], r["n_unchanged"]) == (1, 1, 2, 1)
    assert r["n_recordings"] == 2 and r["mean_pct_silenced"] == pytest.approx(100 / 6)
    assert r["median_pct_decreased"] == pytest.approx(50.0)


def test_pct_change(obs):
    got = {(r["pair_no"], r["channel"]): r["pct"] for r in ob.pct_change(obs, 1000.0, True).collect()}
    assert got == {(1, 2): 12.5, (1, 4): 350.0, (2, 1): 1000.0, (2, 2): 0.0, (2, 3): -50.0}
    assert (2, 1) not in {(r["pair_no"], r["channel"]) for r in ob.pct_change(obs, 300.0).filter("pct > 300").collect()}


def test_unknown_metric(obs):
    with pytest.raises(ValueError):
        ob.pool_metric(obs, obs, "rates")


def test_representative_channels(spark):
    rows = [("doi", 1, c, 5.0 + c, 6.0 + 2 * c) for c in range(1, 31)] + [("doi", 2, c, 9.0, 1.0) for c in (3, 1)]
    obs = spark.createDataFrame(rows, "study string, pair_no bigint, channel int, b double, t double")
    got = keys(ob.representative_channels(obs, ["study", "pair_no"], 4))
    assert [c for p, c in got if p == 2] == [1, 3]
    picked = [c for p, c in got if p == 1]
    assert len(picked) == 4 and picked[-1] == 29  # the top rate lies above the 98th percentile


def test_log_floor(obs):
    assert ob.log_floor(obs, ["metric"], 6.0).first()["floor"] == 3.0
    assert ob.log_floor(obs, ["metric"], 0.0).first()["floor"] == 1.0
