"""Connectivity studies: edges to graphs to family statistics, keyed by recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.operators.connectivity import density_thresholds, distance_slopes, sttc_edges, weight_stats, xcorr_edges
from pointproc.operators.graph import graph_metrics, long_metrics, paired_metrics, threshold_graph
from pointproc.operators.stats import bh_fdr, effect_interval, paired_stats, signed_rank
from pointproc.functions.quantile import percentile_mid
from pointproc.params import DEFAULTS, METRIC_LABELS, Params
from pointproc.session import cut_lineage

GRAPH = ["recording_id", "density"]
GRAPH_SWEEP = ["recording_id", "target_density"]


def graphs_at(edges: DataFrame, channels: DataFrame, densities: Sequence[float], explicit: float | None = None):
    """Thresholds, nodes and edges of one graph per recording and density."""
    cuts = cut_lineage(density_thresholds(edges, densities, explicit=explicit))  # one row per graph, read three times
    graph_edges = threshold_graph(edges, cuts, GRAPH)
    nodes = cuts.select(*GRAPH).join(
        channels.select("recording_id", F.col("channel").alias("node")), "recording_id")
    return cuts, nodes, graph_edges


def edge_metrics(edges: DataFrame, channels: DataFrame, densities: Sequence[float], null_n: int,
                 null_seed: int = 1, explicit: float | None = None) -> DataFrame:
    """Weight statistics, threshold and all graph metrics per recording and density."""
    edges = cut_lineage(edges)
    cuts, nodes, graph_edges = graphs_at(edges, channels, densities, explicit)
    metrics = graph_metrics(nodes.withColumnRenamed("density", "target_density"),
                            graph_edges.withColumnRenamed("density", "target_density"),
                            ["recording_id", "target_density"], null_n, null_seed)
    return (metrics.join(cuts.withColumnRenamed("density", "target_density"), ["recording_id", "target_density"])
            .join(weight_stats(edges).drop("n"), "recording_id"))


def connectivity_study(spikes: DataFrame, channels: DataFrame, params: Params = DEFAULTS,
                       method: str = "xcorr", null_n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of every recording and one metrics row per recording."""
    c = params.connectivity
    if method == "xcorr":
        edges = xcorr_edges(spikes, channels, c.bin_us, c.max_lag_bins, c.norm)
    elif method == "sttc":
        edges = sttc_edges(spikes, channels, c.sttc_delta_us, params.block_us)
    else:
        raise ValueError("method must be xcorr or sttc")
    edges = cut_lineage(edges)
    n = c.null_n if null_n is None else null_n
    return edges, edge_metrics(edges, channels, [c.density], n, c.null_seed)


def density_sweep(edges: DataFrame, channels: DataFrame, recordings: DataFrame, densities: Sequence[float],
                  null_n: int, null_seed: int = 1) -> DataFrame:
    """study, pair_no, target_density, metric, b, t, delta."""
    m = edge_metrics(edges, channels, densities, null_n, null_seed)
    return paired_metrics(long_metrics(m, GRAPH_SWEEP), recordings, ["target_density"])


def sweep_summary(sweep: DataFrame) -> DataFrame:
    return percentile_mid(sweep, ["study", "target_density", "metric"], "delta", {"median_delta": 50})


def family_test(observations: DataFrame, params: Params = DEFAULTS, iterations: int | None = None) -> DataFrame:
    """Paired statistics of each network metric over pairs, one family per study."""
    rows = cut_lineage(observations.withColumn("ord", F.col("pair_no").cast("bigint")))
    stats = paired_stats(rows, ["study", "metric"], "ord", 1 << 16, iterations or params.stats.n_bootstrap,
                         params.stats.bootstrap_seed)
    return bh_fdr(cut_lineage(stats), ["study"], "p", params.stats.fdr_q)


def metric_table(tests: DataFrame) -> DataFrame:
    """The tidy table: one row per metric with medians, interval, p-values and effect."""
    label = F.create_map(*[F.lit(x) for kv in METRIC_LABELS.items() for x in kv])[F.col("metric")]
    return tests.select(
        "study", "metric", label.alias("label"), "median_baseline", "median_treatment", "median_delta",
        F.col("ci_lo").alias("ci_delta_lo"), F.col("ci_hi").alias("ci_delta_hi"), F.col("p").alias("p_bootstrap"),
        F.col("p_adj").alias("p_bh_fdr"), "p_wilcoxon", F.col("hedges_g").alias("hedges_g_av"))


def forest_rows(tests: DataFrame, observations: DataFrame) -> DataFrame:
    """Effect sizes with rescaled intervals."""
    pooled = observations.select("study", "metric", F.explode(F.array("b", "t")).alias("y")).groupBy(
        "study", "metric").agg(F.stddev_samp("y").alias("sd_pooled"))
    return effect_interval(tests.join(pooled, ["study", "metric"]))


def method_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per pair and metric the delta of both methods (columns pearson_delta, sttc_delta)."""
    key = ["study", "pair_no", "metric"]
    return first.select(*key, F.col("delta").alias("pearson_delta")).join(
        second.select(*key, F.col("delta").alias("sttc_delta")), key)


def method_agreement(comparison: DataFrame) -> DataFrame:
    """Median delta per metric and method, and whether the signs agree."""
    long = comparison.select("study", "metric", F.explode(F.array(
        F.struct(F.lit("p").alias("m"), F.col("pearson_delta").alias("y")),
        F.struct(F.lit("s").alias("m"), F.col("sttc_delta").alias("y")))).alias("x")).select("study", "metric", "x.*")
    med = percentile_mid(long, ["study", "metric", "m"], "y", {"v": 50})
    out = med.groupBy("study", "metric").agg(
        F.max(F.when(F.col("m") == "p", F.col("v"))).alias("pearson_median"),
        F.max(F.when(F.col("m") == "s", F.col("v"))).alias("sttc_median"))
    return out.withColumn("same_sign", F.signum("pearson_median") == F.signum("sttc_median"))


def condition_spread(observations: DataFrame) -> DataFrame:
    """Median and quartiles of each metric per condition."""
    long = observations.select("study", "metric", F.explode(F.array(
        F.struct(F.lit("baseline").alias("condition"), F.col("b").alias("y")),
        F.struct(F.lit("treatment").alias("condition"), F.col("t").alias("y")))).alias("x")).select(
            "study", "metric", "x.*")
    return percentile_mid(long, ["study", "metric", "condition"], "y", {"q1": 25, "median": 50, "q3": 75})


def pair_condition_table(metrics: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row per pair and condition with its graph metrics."""
    cols = ["density", "degree_mean", "clustering_mean", "path_length", "efficiency", "modularity",
            "n_communities", "small_worldness"]
    return metrics.join(recordings.select("recording_id", "study", "pair_no", "condition"), "recording_id").select(
        "study", "pair_no", "condition", "recording_id", *cols)


def slope_test(edges: DataFrame, recordings: DataFrame) -> DataFrame:
    """Change in the distance slope of |w|: median difference and signed-rank p.

    Slopes are compared as baseline minus treatment in the test, treatment minus
    baseline in the median.
    """
    s = distance_slopes(edges).select("recording_id", F.lit("slope").alias("metric"), F.col("slope").alias("value"))
    obs = paired_metrics(s, recordings)
    med = percentile_mid(obs, ["study"], "delta", {"median_diff": 50})
    flipped = obs.select("study", F.col("t").alias("b"), F.col("b").alias("t"))
    return med.join(signed_rank(flipped, ["study"]), "study", "left")
