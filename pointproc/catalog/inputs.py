"""Spark side of the shared inputs: the tables most queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointproc.operators import connectivity as cn
from pointproc.operators import observations as ob
from pointproc.operators import trains as tr
from pointproc.operators.graph import threshold_graph
from pointproc.session import cut_lineage
from pointproc.sources import testdata as td

spikes, recordings, channels, samples, table = td.spikes, td.recordings, td.channels, td.samples, td.table


def bursts(spark: SparkSession, d: str, numbered: bool = True) -> DataFrame:
    return tr.bursts(spikes(spark, d), td.ISI_MAX_US, td.ISI_END_US, td.MIN_SPIKES, td.BLOCK_US, numbered)


def summary(spark: SparkSession, d: str) -> DataFrame:
    return tr.channel_summary(channels(spark, d), spikes(spark, d), bursts(spark, d, False), td.DAY_US).drop("duration_us")


def spike_obs(spark: SparkSession, d: str) -> DataFrame:
    rates = tr.channel_summary(channels(spark, d), spikes(spark, d), None, td.DAY_US)
    return ob.pool_metric(rates, recordings(spark, d), "spikeRates")


def burst_obs(spark: SparkSession, d: str) -> DataFrame:
    return ob.pool_metric(summary(spark, d), recordings(spark, d), "burstRates")


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Spike and burst rate observations from one pass over the spikes.

    One row per channel, read several times by every report, so it is written once.
    """
    return cut_lineage(_obs(spark, d))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    s = summary(spark, d).join(recordings(spark, d).select("recording_id", "study", "condition", "pair_no"), "recording_id")
    at = F.col("condition") == "baseline"
    wide = s.groupBy("study", "pair_no", "channel").agg(
        *[F.max(F.when(at if c == "b" else ~at, F.col(m))).alias(f"{m}_{c}")
          for m in ("spike_rate", "burst_rate") for c in ("b", "t")])
    return wide.select("study", "pair_no", "channel", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_b").alias("b"), F.col(f"{m}_t").alias("t"))
        for m in ("spike_rate", "burst_rate")])).alias("o")).select("study", "pair_no", "channel", "o.*").dropna(
            subset=["b", "t"])


def pct(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d)
    spike, burst = o.filter("metric = 'spike_rate'"), o.filter("metric = 'burst_rate'")
    return cut_lineage(ob.pct_change(spike).unionByName(ob.burst_pct_change(burst, spike)))


def bins(spark: SparkSession, d: str) -> DataFrame:
    return tr.bin_counts(spikes(spark, d), td.BIN_US)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return cn.xcorr_edges(spikes(spark, d), channels(spark, d), td.BIN_US, td.MAX_LAG)


def with_pairs(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return df.join(recordings(spark, d).select("recording_id", "study", "pair_no", "condition"), "recording_id")


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph per recording, at 10 % density."""
    e = cut_lineage(edges(spark, d))
    cuts = cn.density_thresholds(e, [0.10])
    nodes = channels(spark, d).select("recording_id", F.col("channel").alias("node"))
    return nodes, threshold_graph(e, cuts, ["recording_id"])
