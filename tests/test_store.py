import json
import math

import pytest
from pyspark.sql import functions as F

from pointproc.params import Params, SpikeParams
from pointproc.plans.preprocess import preprocess_and_store
from pointproc.sources import exports, store
from pointproc.schema import require_columns

RECS = "recording_id string, study string, condition string, pair_no bigint, fs double, duration_us bigint, schema_version string"


@pytest.fixture
def recs(spark):
    return spark.createDataFrame([("a_#1", "doi", "baseline", 1, 100.0, 0, "2.0"), ("b_#1", "doi", "treatment", 1, 100.0, 0, "2.0"),
                                  ("c_#2", "ket", "baseline", 2, 100.0, 0, "2.0")], RECS)


def samples(spark, ids):
    v = [0.1, -0.1, 0.05, -0.02] * 25
    rows = []
    for r in ids:
        w = list(v)
        w[40] = -9.0
        rows.append((r, 1, 0, 0, 100.0, w))
    return spark.createDataFrame(rows, "recording_id string, channel int, chunk_no bigint, start_idx bigint, fs double, v array<double>")


def test_incremental_store(spark, recs, tmp_path):
    root, p = str(tmp_path / "store"), Params(spike=SpikeParams(sd_factor=4.0))
    done = preprocess_and_store(samples(spark, ["a_#1"]), recs, root, p, filtered=False)
    assert [r["recording_id"] for r in done.collect()] == ["a_#1"]
    again = preprocess_and_store(samples(spark, ["a_#1", "b_#1"]), recs, root, p, filtered=False)
    assert [r["recording_id"] for r in again.collect()] == ["b_#1"]
    assert store.read_table(spark, root, "spikes").count() == 2
    one = store.read_recording(spark, root, "channel_summary", "b_#1").first()
    assert one["n_spikes"] == 1 and one["study"] == "doi"
    redo = preprocess_and_store(samples(spark, ["a_#1"]), recs, root, p, overwrite=True, filtered=False)
    assert redo.count() == 1 and store.read_table(spark, root, "spikes").count() == 2
    assert [r["recording_id"] for r in store.missing_sources(recs, samples(spark, ["a_#1", "b_#1"])).collect()] == ["c_#2"]
    with pytest.raises(ValueError):
        store.read_recording(spark, root, "spikes", "zzz")


def test_rerun_after_a_failure(spark, recs, tmp_path, monkeypatch):
    root, p = str(tmp_path / "store"), Params(spike=SpikeParams(sd_factor=4.0))
    write = store.write_table

    def breaks(df, root, name):
        if name == "recordings":
            raise RuntimeError("lost")
        write(df, root, name)

    monkeypatch.setattr(store, "write_table", breaks)
    with pytest.raises(RuntimeError):
        preprocess_and_store(samples(spark, ["a_#1"]), recs, root, p, filtered=False)
    monkeypatch.setattr(store, "write_table", write)
    preprocess_and_store(samples(spark, ["a_#1"]), recs, root, p, filtered=False)
    assert store.read_table(spark, root, "spikes").count() == 1
    summary = store.read_table(spark, root, "channel_summary").collect()
    assert len(summary) == 60  # the layout's channels; those without samples have no counts
    assert [r["n_spikes"] for r in summary if r["channel"] == 1] == [1]
    assert all(r["n_spikes"] is None and r["burst_rate"] is None for r in summary if r["channel"] != 1)
    kept = json.loads(spark.read.parquet(f"{root}/recordings").first()["parameters"])
    assert kept["spike"]["sd_factor"] == 4.0 and kept["filtered"] is False
    spikes = spark.read.parquet(f"{root}/spikes").drop("t_us")
    spikes.write.partitionBy("study", "recording_id").parquet(f"{root}/broken/spikes")
    with pytest.raises(ValueError, match="t_us"):
        store.read_table(spark, f"{root}/broken", "spikes")


def test_versions_and_columns(spark, recs):
    assert store.check_version(recs).count() == 3
    for bad in ("1.0", None):
        with pytest.raises(Exception, match="schema version"):
            store.check_version(recs.withColumn("schema_version", F.lit(bad).cast("string"))).collect()
    with pytest.raises(ValueError, match="fs"):
        require_columns(recs.drop("fs"), "fs")


def test_studies_and_pairs(spark, recs):
    assert store.recordings_for(recs, "DOI").count() == 2
    with pytest.raises(ValueError):
        store.recordings_for(recs, "other")
    pairs = store.pair_up(recs.filter("condition = 'baseline'").select(F.col("recording_id").alias("name")),
                          recs.filter("condition = 'treatment'").select(F.col("recording_id").alias("name")))
    assert sorted((r["pair_no"], r["status"]) for r in pairs.collect()) == [(1, "ok"), (2, "no treatment")]
    with pytest.raises(ValueError, match="2"):
        store.require_paired(pairs)
    nameless = spark.createDataFrame([("x",)], "name string")
    with pytest.raises(Exception, match="no #N suffix"):
        store.pair_up(nameless, nameless).collect()


def test_channel_trains(spark, recs, trains):
    spikes, used = trains({("a_#1", 3): [5, 6], ("a_#1", 4): []}, 10)
    got = [(r["ord"], r["channel"], r["found"], r["t_us"]) for r in store.channel_trains(
        spikes, used, recs.filter("recording_id = 'a_#1'"), [9, 4, 3]).orderBy("ord", "t_us").collect()]
    assert got == [(1, 9, False, None), (2, 4, True, None), (3, 3, True, 5), (3, 3, True, 6)]


def test_export_stats(spark, tmp_path):
    vals = [1 / 3, 123456.789012345, 1e-7, 12345678901.5, 2.0, 0.0001, 100.0]
    df = spark.createDataFrame([(math.nan, math.inf, -math.inf, 'a,"b"', True, [1.0, 2.0], list(map(float, range(9))), *vals)],
                               "n double, p double, m double, s string, f boolean, ci array<double>, long array<double>, "
                               + ", ".join(f"v{k} double" for k in range(len(vals))))
    path = str(tmp_path / "x")
    exports.export_stats(df, path, {"ci": 2, "long": 9})
    lines = "\n".join(r["value"] for r in spark.read.text(path + "_csv").collect()).split("\n")
    assert lines[0] == "n,p,m,s,f,ci_1,ci_2," + ",".join(f"v{k}" for k in range(len(vals)))
    assert lines[1] == 'NaN,Inf,-Inf,"a,""b""",1,1,2,' + ",".join("%.10g" % v for v in vals)
    got = json.loads(spark.read.text(path + "_json").first()["value"])
    assert got["long"] == list(range(9)) and got["ci_2"] == 2.0


def test_tables_to_csv(spark, tmp_path):
    rows = spark.createDataFrame([("doi", 1, 0.1, "density", 0.5, 0.75, 0.25)],
                                 "study string, pair_no bigint, target_density double, metric string, b double, t double, delta double")
    exports.write_csv(exports.sweep_rows(rows), str(tmp_path / "s"))
    back = spark.read.option("header", True).csv(str(tmp_path / "s")).first()
    assert back.asDict() == {"study": "doi", "pair": "1", "target_density": "0.1", "metric": "Edge density", "baseline": "0.5",
                             "treatment": "0.75", "delta": "0.25"}


def test_a_file_without_a_column_is_found(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("doi", "r1", 1, 5, 10), ("doi", "r1", 2, 6, 10)], "study string, recording_id string, channel int, t_us bigint, duration_us bigint")
    store.write_table(rows, root, "spikes")
    lacking = spark.createDataFrame([("doi", "r2", 1, 10)], "study string, recording_id string, channel int, duration_us bigint")
    lacking.write.partitionBy("study", "recording_id").mode("append").parquet(f"{root}/spikes")
    recs = spark.createDataFrame([("doi", r, "baseline", 1, 1.0, 10, store.DEFAULTS.schema_version) for r in ("r1", "r2")],
                                 "study string, recording_id string, condition string, pair_no bigint, fs double, duration_us bigint, schema_version string")
    store.write_table(recs, root, "recordings")
    assert store.read_recording(spark, root, "spikes", "r1").count() == 2
    with pytest.raises(ValueError, match="t_us"):
        store.read_recording(spark, root, "spikes", "r2")
    table = store.read_table(spark, root, "spikes")
    assert table.select("channel").count() == 3  # columns that are not used are not read
    with pytest.raises(Exception, match="t_us"):
        table.select("t_us").collect()


def test_edges_of_both_methods_come_back(spark, tmp_path):
    from pointproc.sources import exports

    recs = spark.createDataFrame([("a1", "doi", 1, "baseline"), ("a2", "doi", 1, "treatment")],
                                 "recording_id string, study string, pair_no bigint, condition string")
    for method, shift in (("xcorr", 0.0), ("sttc", 0.5)):
        edges = spark.createDataFrame([("a1", 1, 2, 0.1 + shift, 5), ("a2", 1, 3, None, None)],
                                      "recording_id string, i int, j int, w double, peak_lag_us bigint")
        path = f"{tmp_path}/{method}"
        exports.write_edges(edges, recs, path)
        exports.write_edges(edges, recs, path)  # a second run replaces the first
        back = spark.read.parquet(path)
        assert sorted(map(tuple, back.select(edges.columns).collect())) == sorted(map(tuple, edges.collect()))
        assert {(r["study"], r["pair_no"], r["condition"]) for r in back.collect()} == {("doi", 1, "baseline"), ("doi", 1, "treatment")}
