"""A few registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
SOME = ["S4_pool_metric", "F6_outlier_report", "A9_category_percentages", "W2_refractory", "W3_burst_detection",
        "C1_xcorr_pearson", "C6_sttc_edges", "P4_bootstrap_two_level", "P10_bh_fdr", "G4_threshold_detection"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    got = normal(entry.queries()[name](spark, FOLDER).toPandas())
    want = normal(db.execute(entry.oracle_sql()[name]).df())
    assert got == want and got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
