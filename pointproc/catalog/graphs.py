"""Queries: band joins, connectivity, graphs, and the connectivity studies."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pointproc.catalog import inputs as i
from pointproc.catalog.base import CTES, DUR, HOUR, query
from pointproc.catalog.statistics import _B1, _CI, _EXACT, _HG, _WX
from pointproc.operators import connectivity as cn
from pointproc.operators import graph as g
from pointproc.operators import trains as tr
from pointproc.params import METRIC_LABELS, ConnectivityParams, Params
from pointproc.plans import connectivity as cp
from pointproc.session import cut_lineage
from pointproc.sources import exports
from pointproc.sources import testdata as td
from pointproc.sources.electrodes import electrodes

R = ["recording_id"]
PARAMS = Params(
    connectivity=ConnectivityParams(bin_us=td.BIN_US, max_lag_bins=td.MAX_LAG, sttc_delta_us=td.DELTA_US),
    block_us=td.BLOCK_US)
NULLS, ITERATIONS = 100, 10_000


# --- band joins -----------------------------------------------------------------

@query("J4_spike_band_join", """SELECT recording_id, i, j, lag, c FROM coin""", ints="i j lag c")
def _(s, d):
    return cn.coincidences(i.bins(s, d), td.MAX_LAG)


_NEAR = f"""near AS (SELECT recording_id, a, b, count(*) AS n_near FROM (SELECT DISTINCT a.recording_id, a.channel AS a,
    b.channel AS b, a.t_us FROM spikes a JOIN spikes b ON a.recording_id = b.recording_id AND a.channel <> b.channel
    AND b.t_us BETWEEN a.t_us - {2 * HOUR} AND a.t_us + {2 * HOUR}) GROUP BY ALL)"""


@query("J5_band_semi_join", "SELECT recording_id, a, b, n_near FROM near", ints="a b", extra=_NEAR)
def _(s, d):
    return cn.near_counts(i.spikes(s, d), td.DELTA_US, td.BLOCK_US)


@query("J7_pair_lag_grid", "SELECT recording_id, i, j, lag, round(r, 6) AS r FROM scores", "r", ints="i j lag")
def _(s, d):
    return cn.lagged_scores(i.spikes(s, d), i.channels(s, d), td.BIN_US, td.MAX_LAG)


@query("J9_edges_with_distance", "SELECT recording_id, i, j, w, dist FROM edges JOIN epairs USING (i, j)", "w dist", ints="i j")
def _(s, d):
    return cn.with_distance(i.edges(s, d)).select("recording_id", "i", "j", "w", "dist")


# --- connectivity ---------------------------------------------------------------

@query("C1_xcorr_pearson", "SELECT recording_id, i, j, w, peak_lag_us FROM edges", "w", ints="i j peak_lag_us")
def _(s, d):
    return i.edges(s, d)


_PEAK = "QUALIFY row_number() OVER (PARTITION BY recording_id, i, j ORDER BY w DESC NULLS LAST, lag) = 1"


@query("C2_xcorr_coeff", f"""SELECT recording_id, i, j, w, lag * {HOUR} AS peak_lag_us FROM (SELECT recording_id, i, j, lag,
       CASE WHEN s2i > 0 AND s2j > 0 THEN round(c / sqrt(s2i::DOUBLE * s2j), 12) END AS w FROM cells) {_PEAK}""", "w", ints="i j peak_lag_us")
def _(s, d):
    return cn.xcorr_edges(i.spikes(s, d), i.channels(s, d), td.BIN_US, td.MAX_LAG, "coeff")


@query("C3_xcorr_raw_counts", f"SELECT recording_id, i, j, c AS w, lag * {HOUR} AS peak_lag_us FROM cells {_PEAK.replace('w DESC', 'c DESC')}",
       "w", ints="i j peak_lag_us")
def _(s, d):
    return cn.xcorr_edges(i.spikes(s, d), i.channels(s, d), td.BIN_US, td.MAX_LAG, "none")


_TOP = """top AS (SELECT study, pair_no, i, j, w FROM edges WHERE condition = 'baseline'
    QUALIFY row_number() OVER (PARTITION BY study, pair_no ORDER BY w DESC, j, i) = 1)"""


def _top_pairs(s, d, e):
    """The strongest baseline edge of every pair, for both of its recordings."""
    top = cn.strongest_edges(i.with_pairs(e, s, d).filter("condition = 'baseline'"), 1, ["study", "pair_no"])
    recs = i.recordings(s, d).select("recording_id", "study", "pair_no")
    return recs.join(top.select("study", "pair_no", "i", "j"), ["study", "pair_no"]).select("recording_id", "i", "j")


@query("C4_correlogram", f"""SELECT study, pair_no, i, j, lag_us, max(r) FILTER (WHERE condition = 'baseline') AS baseline,
       max(r) FILTER (WHERE condition = 'treatment') AS treatment FROM (SELECT s.study, s.pair_no, s.condition, s.i, s.j,
       -lag * {HOUR} AS lag_us, r FROM scores s JOIN top USING (study, pair_no, i, j)) GROUP BY ALL""",
       "baseline treatment", ints="i j lag_us", extra=_TOP)
def _(s, d):
    e = cut_lineage(i.edges(s, d))
    c = cn.correlogram(i.spikes(s, d), i.channels(s, d), _top_pairs(s, d, e), td.BIN_US, td.MAX_LAG)
    return exports.correlogram_rows(c, i.recordings(s, d))


_DELTA = """delta AS (SELECT study, pair_no, i, j, max(w) FILTER (WHERE condition = 'baseline') AS w_baseline,
    max(w) FILTER (WHERE condition = 'treatment') AS w_treatment, max(w) FILTER (WHERE condition = 'treatment')
    - max(w) FILTER (WHERE condition = 'baseline') AS delta FROM edges GROUP BY ALL)"""


@query("C5_delta_adjacency", "SELECT * FROM delta", "w_baseline w_treatment delta", ints="i j", extra=_DELTA)
def _(s, d):
    return cn.delta_edges(i.edges(s, d), i.recordings(s, d))


_STTC = _NEAR + f""", cov AS (SELECT recording_id, channel, count(*) AS n, sum(least(least({DUR}, t_us + {2 * HOUR}),
    CASE WHEN next IS NULL THEN {DUR} ELSE greatest(0, next - {2 * HOUR}) END) - greatest(0, t_us - {2 * HOUR})) / {DUR} AS cov FROM seq GROUP BY ALL),
    sttc AS (SELECT p.recording_id, p.study, p.pair_no, p.condition, p.i, p.j, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE 0.5 * (
    (coalesce(x.n_near, 0) / a.n - b.cov) / (1 - coalesce(x.n_near, 0) / a.n * b.cov)
    + (coalesce(y.n_near, 0) / b.n - a.cov) / (1 - coalesce(y.n_near, 0) / b.n * a.cov)) END AS w FROM cpairs p
    LEFT JOIN cov a ON a.recording_id = p.recording_id AND a.channel = p.i LEFT JOIN cov b ON b.recording_id = p.recording_id AND b.channel = p.j
    LEFT JOIN near x ON x.recording_id = p.recording_id AND x.a = p.i AND x.b = p.j
    LEFT JOIN near y ON y.recording_id = p.recording_id AND y.a = p.j AND y.b = p.i)"""


@query("C6_sttc_edges", "SELECT recording_id, i, j, w FROM sttc", "w", ints="i j", extra=_STTC)
def _(s, d):
    return cn.sttc_edges(i.spikes(s, d), i.channels(s, d), td.DELTA_US, td.BLOCK_US)


_WL = "wl AS (SELECT recording_id, list_sort(list(w)) AS w FROM edges GROUP BY ALL)"


@query("C7_density_threshold", """SELECT recording_id, 0.05::DOUBLE AS density, {pm:w:95} AS threshold FROM wl UNION ALL
       SELECT recording_id, 0.10, {pm:w:90} FROM wl UNION ALL SELECT recording_id, 0.25, {pm:w:75} FROM wl""",
       "density threshold", extra=_WL)
def _(s, d):
    return cn.density_thresholds(cut_lineage(i.edges(s, d)), [0.05, 0.10, 0.25])


@query("C10_grid_projection", """SELECT recording_id, grid_row, """ + ", ".join(
       f"max(spike_rate) FILTER (WHERE grid_col = {c}) AS col_{c}" for c in range(1, 9))
       + " FROM summary JOIN elec USING (channel) GROUP BY recording_id, grid_row",
       " ".join(f"col_{c}" for c in range(1, 9)), ints="grid_row")
def _(s, d):
    rates = tr.channel_summary(i.channels(s, d), i.spikes(s, d), None, td.DAY_US)
    return cn.on_grid(rates.select("recording_id", "channel", "spike_rate"), "spike_rate")


_SHOW = """shown AS (SELECT recording_id, i, j, w FROM edges JOIN (SELECT recording_id, {pm:w:80} AS cut FROM wl) USING (recording_id)
    WHERE w > cut)"""


@query("C11_node_degree", """SELECT c.recording_id, c.channel, count(s.w) AS degree FROM chans c LEFT JOIN (SELECT recording_id, i AS channel, w FROM shown
       UNION ALL SELECT recording_id, j, w FROM shown) s USING (recording_id, channel) GROUP BY ALL""", ints="channel", extra=_WL + ", " + _SHOW)
def _(s, d):
    return cn.node_metrics(cut_lineage(i.edges(s, d)), i.channels(s, d))


@query("C11_edge_alpha", "SELECT recording_id, i, j, abs(w) / max(abs(w)) OVER (PARTITION BY recording_id) AS alpha FROM edges", "alpha", ints="i j")
def _(s, d):
    return cn.edge_alpha(cut_lineage(i.edges(s, d))).select("recording_id", "i", "j", "alpha")


@query("F16_dead_channels", """SELECT recording_id, channel, mean_w, channel = 15 OR mean_w < med / 10 AS dead FROM cm JOIN
       (SELECT recording_id, median(mean_w) AS med FROM cm GROUP BY ALL) USING (recording_id)""", "mean_w", ints="channel",
       extra="""cm AS (SELECT recording_id, channel, avg(w) AS mean_w FROM (SELECT recording_id, i AS channel, w FROM edges
       UNION ALL SELECT recording_id, j, w FROM edges) GROUP BY ALL)""")
def _(s, d):
    return cn.dead_channels(cut_lineage(i.edges(s, d)), 15)


@query("F20_metric_edges", "SELECT recording_id, src, dst FROM gedges", ints="src dst")
def _(s, d):
    return i.graph(s, d)[1]


@query("F21_display_edges", """SELECT study, pair_no, 'weight' AS mode, i, j, w_baseline AS w FROM delta JOIN (SELECT study, pair_no,
       {pm:v:80} AS cut FROM (SELECT study, pair_no, list_sort(list(w_baseline)) AS v FROM delta GROUP BY ALL)) USING (study, pair_no)
       WHERE w_baseline >= cut UNION ALL SELECT study, pair_no, 'delta', i, j, delta FROM delta JOIN (SELECT study, pair_no,
       {pm:v:80} AS cut FROM (SELECT study, pair_no, list_sort(list(abs(delta))) AS v FROM delta GROUP BY ALL)) USING (study, pair_no)
       WHERE abs(delta) >= cut""", "w", ints="i j", extra=_DELTA)
def _(s, d):
    de = cut_lineage(cn.delta_edges(i.edges(s, d), i.recordings(s, d)))
    out = None
    for mode, col in (("weight", "w_baseline"), ("delta", "delta")):
        rows = de.select("study", "pair_no", F.lit(mode).alias("mode"), "i", "j", F.col(col).alias("w"))
        part = cn.display_edges(rows, mode, keys=["study", "pair_no"]).drop("threshold")
        out = part if out is None else out.unionByName(part)
    return out


@query("F23_edge_quality_flags", f"""SELECT recording_id, i, j, dist <= 1.01 AS adjacent, abs(peak_lag_us) < {1.5 * HOUR} AS zero_lag
       FROM edges JOIN epairs USING (i, j)""", ints="i j")
def _(s, d):
    return cn.edge_flags(cn.with_distance(i.edges(s, d)), 1.5 * HOUR).select("recording_id", "i", "j", "adjacent", "zero_lag")


@query("T1_strongest_edge", "SELECT study, pair_no, i, j, w FROM top", "w", ints="i j", extra=_TOP)
def _(s, d):
    e = i.with_pairs(i.edges(s, d), s, d).filter("condition = 'baseline'")
    return cn.strongest_edges(e, 1, ["study", "pair_no"]).select("study", "pair_no", "i", "j", "w")


@query("T2_top_edges", """SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY w DESC, j, i) AS rank, i, j, w, dist, peak_lag_us
       FROM edges JOIN epairs USING (i, j) QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY w DESC, j, i) <= 10""",
       "w dist", ints="i j peak_lag_us")
def _(s, d):
    top = cn.strongest_edges(i.edges(s, d), 10)
    return cn.with_distance(top).select("recording_id", "rank", "i", "j", "w", "dist", "peak_lag_us")


@query("T3_largest_gain_edge", """SELECT study, pair_no, i, j, delta FROM delta QUALIFY row_number() OVER
       (PARTITION BY study, pair_no ORDER BY delta DESC, j, i) = 1""", "delta", ints="i j", extra=_DELTA)
def _(s, d):
    de = cn.delta_edges(i.edges(s, d), i.recordings(s, d))
    return cn.strongest_edges(de, 1, ["study", "pair_no"], "delta").select("study", "pair_no", "i", "j", "delta")


@query("A14_weight_stats", "SELECT recording_id, count(w) AS n, avg(w) AS mean_w, stddev_samp(w) AS sd_w FROM edges GROUP BY ALL", "mean_w sd_w")
def _(s, d):
    return cn.weight_stats(i.edges(s, d))


@query("A15_distance_profile", """SELECT condition, bin, len(v) AS n, {pm:v:50} AS median, {pm:v:25} AS q1, {pm:v:75} AS q3 FROM (
       SELECT condition, floor(dist)::BIGINT AS bin, list_sort(list(abs(w))) AS v FROM edges JOIN epairs USING (i, j) WHERE dist < 8 GROUP BY ALL)""",
       "median q1 q3")
def _(s, d):
    return cn.distance_profile(i.with_pairs(cut_lineage(i.edges(s, d)), s, d), ["condition"])


@query("A16_distance_slope", """SELECT recording_id, regr_slope(abs(w), dist) AS slope, regr_intercept(abs(w), dist) AS intercept
       FROM edges JOIN epairs USING (i, j) GROUP BY ALL""", "slope intercept")
def _(s, d):
    return cn.distance_slopes(i.edges(s, d))


@query("A21_matrix_range", """SELECT 'plain' AS kind, study, pair_no, min(w_baseline) - CASE WHEN min(w_baseline) = max(w_baseline) THEN 1 ELSE 0 END AS vmin,
       max(w_baseline) + CASE WHEN min(w_baseline) = max(w_baseline) THEN 1 ELSE 0 END AS vmax FROM delta GROUP BY study, pair_no
       UNION ALL SELECT 'symmetric', study, pair_no, -max(abs(delta)), max(abs(delta)) FROM delta GROUP BY study, pair_no""", "vmin vmax", extra=_DELTA)
def _(s, d):
    de = cut_lineage(cn.delta_edges(i.edges(s, d), i.recordings(s, d)))
    key = ["study", "pair_no"]
    plain = cn.value_range(de.withColumn("w", F.col("w_baseline")), key, False).withColumn("kind", F.lit("plain"))
    sym = cn.value_range(de.withColumn("w", F.col("delta")), key, True).withColumn("kind", F.lit("symmetric"))
    return plain.unionByName(sym)


@query("S12_matrix_export", """SELECT recording_id, a.label AS label_i, b.label AS label_j, w FROM (SELECT recording_id, i AS channel, j AS other, w FROM edges
       UNION ALL SELECT recording_id, j, i, w FROM edges) x JOIN elec a ON a.channel = x.channel JOIN elec b ON b.channel = x.other
       WHERE x.channel <> 15 AND x.other <> 15 AND NOT EXISTS (SELECT 1 FROM dead d WHERE d.recording_id = x.recording_id AND d.channel IN (x.channel, x.other))""",
       "w", ints="label_i label_j", extra="""cm AS (SELECT recording_id, channel, avg(w) AS mean_w FROM (SELECT recording_id, i AS channel, w FROM edges
       UNION ALL SELECT recording_id, j, w FROM edges) GROUP BY ALL), dead AS (SELECT recording_id, channel FROM cm JOIN (SELECT recording_id,
       median(mean_w) AS med FROM cm GROUP BY ALL) USING (recording_id) WHERE mean_w < med / 10)""")
def _(s, d):
    return exports.matrix_rows(cut_lineage(i.edges(s, d)))


# --- graphs ---------------------------------------------------------------------

@query("N1_density", """SELECT n.recording_id, n.n AS n_nodes, coalesce(m, 0) AS n_edges, coalesce(m, 0) / greatest(n.n * (n.n - 1) / 2, 1) AS density
       FROM (SELECT recording_id, count(*) AS n FROM gnodes GROUP BY ALL) n LEFT JOIN (SELECT recording_id, count(*) AS m FROM gedges GROUP BY ALL)
       USING (recording_id)""", "density")
def _(s, d):
    return g.density(*i.graph(s, d), R)


@query("N2_degree_stats", "SELECT recording_id, avg(degree) AS degree_mean, stddev_samp(degree) AS degree_std FROM gdeg GROUP BY ALL", "degree_mean degree_std")
def _(s, d):
    return g.degree_stats(*i.graph(s, d), R)


_TRI = """tri AS (SELECT a.recording_id, a.src AS x, a.dst AS y, b.dst AS z FROM gedges a JOIN gedges b ON b.recording_id = a.recording_id
    AND b.src = a.dst JOIN gedges c ON c.recording_id = a.recording_id AND c.src = a.src AND c.dst = b.dst)"""


@query("J10_triangles", "SELECT recording_id, x, y, z FROM tri", ints="x y z", extra=_TRI)
def _(s, d):
    nodes, edges = i.graph(s, d)
    edges = cut_lineage(edges)
    t = F.array_sort(F.array("a", "b", "c"))
    return g.triangles(edges, g.degrees(nodes, edges, R), R).select(
        "recording_id", t[0].alias("x"), t[1].alias("y"), t[2].alias("z"))


@query("N3_clustering", """SELECT recording_id, avg(CASE WHEN degree >= 2 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS clustering_mean
       FROM gdeg LEFT JOIN (SELECT recording_id, node, count(*) AS t FROM (SELECT recording_id, unnest([x, y, z]) AS node FROM tri) GROUP BY ALL)
       USING (recording_id, node) GROUP BY ALL""", "clustering_mean", extra=_TRI)
def _(s, d):
    nodes, edges = i.graph(s, d)
    return g.clustering(nodes, cut_lineage(edges), R)


@query("N4_components", """SELECT recording_id, node, component, dense_rank() OVER (PARTITION BY recording_id ORDER BY component) AS number,
       count(*) OVER (PARTITION BY recording_id, component) AS size FROM comp""", ints="node component")
def _(s, d):
    labels = g.components(*i.graph(s, d), R)
    return labels.join(g.numbered_components(labels, R), [*R, "component"])


@query("N5_hop_distances", "SELECT recording_id, source, node, d FROM bfs", ints="source node d")
def _(s, d):
    return g.hop_distances(i.graph(s, d)[1], R)


@query("J11_bfs_frontier", "SELECT recording_id, d, count(*) AS n_reached FROM bfs GROUP BY ALL", ints="d")
def _(s, d):
    return g.hop_distances(i.graph(s, d)[1], R).groupBy("recording_id", "d").agg(F.count(F.lit(1)).alias("n_reached"))


@query("N6_path_length", """SELECT comp.recording_id, sum(d) / count(d) AS path_length FROM (SELECT recording_id, component FROM (SELECT recording_id, component,
       count(*) AS size FROM comp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY size DESC, component) = 1) JOIN comp USING (recording_id, component)
       LEFT JOIN bfs ON bfs.recording_id = comp.recording_id AND bfs.source = comp.node GROUP BY comp.recording_id""", "path_length")
def _(s, d):
    nodes, edges = i.graph(s, d)
    return g.path_metrics(nodes, g.hop_distances(edges, R), R).select("recording_id", "path_length")


@query("N7_global_efficiency", """SELECT recording_id, coalesce(e, 0) / (n * (n - 1)) AS efficiency FROM (SELECT recording_id, count(*) AS n FROM gnodes GROUP BY ALL)
       LEFT JOIN (SELECT recording_id, sum(1.0::DOUBLE / d) AS e FROM bfs GROUP BY ALL) USING (recording_id)""", "efficiency")
def _(s, d):
    nodes, edges = i.graph(s, d)
    return g.path_metrics(nodes, g.hop_distances(edges, R), R).select("recording_id", "efficiency")


@query("N8_modularity", """SELECT recording_id, sum(coalesce(e, 0) / m - (k / (2.0 * m)) ** 2) AS modularity, count(*) AS n_communities FROM (SELECT recording_id,
       grid_row AS c, sum(degree) AS k FROM gdeg JOIN elec ON channel = node GROUP BY ALL) LEFT JOIN (SELECT recording_id, a.grid_row AS c, count(*) AS e
       FROM gedges JOIN elec a ON a.channel = src JOIN elec b ON b.channel = dst WHERE a.grid_row = b.grid_row GROUP BY ALL) USING (recording_id, c)
       JOIN (SELECT recording_id, count(*) AS m FROM gedges GROUP BY ALL) USING (recording_id) GROUP BY ALL""", "modularity")
def _(s, d):
    # the partition is the electrode row of each node
    nodes, edges = i.graph(s, d)
    rows = electrodes(s).select(F.col("channel").alias("node"), F.col("grid_row").alias("community"))
    return g.modularity(nodes, cut_lineage(edges), nodes.join(F.broadcast(rows), "node"), R)


@query("N3_N6_N7_shape_metrics", """SELECT * FROM (SELECT recording_id, avg(CASE WHEN degree >= 2 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS clustering_mean
       FROM gdeg LEFT JOIN (SELECT recording_id, node, count(*) AS t FROM (SELECT recording_id, unnest([x, y, z]) AS node FROM tri) GROUP BY ALL)
       USING (recording_id, node) GROUP BY ALL) JOIN (SELECT comp.recording_id, sum(d) / count(d) AS path_length FROM (SELECT recording_id, component FROM
       (SELECT recording_id, component, count(*) AS size FROM comp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY size DESC,
       component) = 1) JOIN comp USING (recording_id, component) LEFT JOIN bfs ON bfs.recording_id = comp.recording_id AND bfs.source = comp.node
       GROUP BY comp.recording_id) USING (recording_id) JOIN (SELECT recording_id, coalesce(e, 0) / (n * (n - 1)) AS efficiency FROM (SELECT recording_id,
       count(*) AS n FROM gnodes GROUP BY ALL) LEFT JOIN (SELECT recording_id, sum(1.0::DOUBLE / d) AS e FROM bfs GROUP BY ALL) USING (recording_id))
       USING (recording_id)""", "clustering_mean path_length efficiency", extra=_TRI)
def _(s, d):
    nodes, edges = i.graph(s, d)
    return g.shape_metrics(nodes, edges, R)


# greedy merging: the state is one list of labels per graph, a step joins the two communities of the largest gain
_GREEDY = """gp AS (SELECT recording_id, list(node ORDER BY node) AS nodes, list(degree ORDER BY node) AS deg FROM gdeg GROUP BY ALL),
    gl AS (SELECT recording_id, nodes, deg, list(list_position(nodes, src)) AS s, list(list_position(nodes, dst)) AS d, count(*) AS m
    FROM gedges JOIN gp USING (recording_id) GROUP BY ALL),
    gm AS (SELECT recording_id, range(1, len(nodes) + 1) AS lab, 0 AS step FROM gp UNION ALL
    SELECT recording_id, list_transform(lab, lambda x: CASE WHEN x = -b.q THEN -b.p ELSE x END), step + 1 FROM (
    SELECT recording_id, lab, step, max({'g': round(e / m::DOUBLE - kp * kq / (2.0::DOUBLE * m * m), 12), 'p': -p, 'q': -q}) AS b FROM (
    SELECT recording_id, lab, step, m, p, q, e, list_sum(list_transform(range(1, len(lab) + 1), lambda k: CASE WHEN lab[k] = p THEN deg[k] ELSE 0 END)) AS kp,
    list_sum(list_transform(range(1, len(lab) + 1), lambda k: CASE WHEN lab[k] = q THEN deg[k] ELSE 0 END)) AS kq FROM (
    SELECT recording_id, lab, step, m, deg, least(lab[si], lab[di]) AS p, greatest(lab[si], lab[di]) AS q, count(*) AS e FROM (
    SELECT w.recording_id, lab, step, m, deg, unnest(s) AS si, unnest(d) AS di FROM gm w JOIN gl ON gl.recording_id = w.recording_id)
    WHERE lab[si] <> lab[di] GROUP BY ALL)) GROUP BY recording_id, lab, step) WHERE b.g > 0),
    gc AS (SELECT recording_id, unnest(nodes) AS node, unnest(lab) AS c FROM (SELECT recording_id, arg_max(lab, step) AS lab FROM gm GROUP BY ALL) JOIN gp USING (recording_id)),
    gq AS (SELECT recording_id, sum(coalesce(e, 0) / m - (k / (2.0 * m)) ** 2) AS modularity, count(*) AS n_communities FROM (SELECT recording_id, c, sum(degree) AS k
    FROM gdeg JOIN gc USING (recording_id, node) GROUP BY ALL) LEFT JOIN (SELECT gedges.recording_id, a.c, count(*) AS e FROM gedges
    JOIN gc a ON a.recording_id = gedges.recording_id AND a.node = src JOIN gc b ON b.recording_id = gedges.recording_id AND b.node = dst WHERE a.c = b.c GROUP BY ALL)
    USING (recording_id, c) JOIN (SELECT recording_id, count(*) AS m FROM gedges GROUP BY ALL) USING (recording_id) GROUP BY ALL)"""


@query("N9_greedy_modularity", "SELECT recording_id, modularity FROM gq", "modularity", extra=_GREEDY, recursive=True)
def _(s, d):
    nodes, edges = i.graph(s, d)
    edges = cut_lineage(edges)
    return g.modularity(nodes, edges, cut_lineage(g.greedy_communities(nodes, edges, R)), R).select(*R, "modularity")


@query("N10_communities", "SELECT recording_id, n_communities FROM gq", extra=_GREEDY, recursive=True)
def _(s, d):
    nodes, edges = i.graph(s, d)
    return g.greedy_communities(nodes, edges, R).groupBy("recording_id").agg(F.countDistinct("community").alias("n_communities"))


@query("N11_random_graphs", f"""SELECT recording_id, replicate, src, dst FROM (SELECT m.recording_id, replicate, a.node AS src, b.node AS dst, m.m,
       row_number() OVER (PARTITION BY m.recording_id, replicate ORDER BY ('0x' || substr(md5('1|' || m.recording_id || '|' || replicate || '|' || a.node
       || '|' || b.node), 1, 15))::BIGINT, a.node, b.node) AS r FROM (SELECT recording_id, count(*) AS m FROM gedges GROUP BY ALL) m
       CROSS JOIN (SELECT unnest(range(1, {NULLS + 1})) AS replicate) JOIN gnodes a ON a.recording_id = m.recording_id
       JOIN gnodes b ON b.recording_id = m.recording_id AND a.node < b.node) WHERE r <= m""", ints="replicate src dst")
def _(s, d):
    return g.random_graphs(*i.graph(s, d), R, NULLS, 1)


# the random graphs, their distances and their clustering
_NULL = _TRI + f""", ng AS (SELECT recording_id, replicate, src, dst FROM (SELECT m.recording_id, replicate, a.node AS src, b.node AS dst, m.m,
    row_number() OVER (PARTITION BY m.recording_id, replicate ORDER BY ('0x' || substr(md5('1|' || m.recording_id || '|' || replicate || '|' || a.node
    || '|' || b.node), 1, 15))::BIGINT, a.node, b.node) AS r FROM (SELECT recording_id, count(*) AS m FROM gedges GROUP BY ALL) m
    CROSS JOIN (SELECT unnest(range(1, {NULLS + 1})) AS replicate) JOIN gnodes a ON a.recording_id = m.recording_id
    JOIN gnodes b ON b.recording_id = m.recording_id AND a.node < b.node) WHERE r <= m),
    nb AS (SELECT * FROM ng UNION ALL SELECT recording_id, replicate, dst, src FROM ng),
    nw(recording_id, replicate, source, node, d) USING KEY (recording_id, replicate, source, node) AS (SELECT recording_id, replicate, src, dst, 1 FROM nb UNION
    SELECT DISTINCT w.recording_id, w.replicate, w.source, b.dst, w.d + 1 FROM nw w JOIN nb b ON b.recording_id = w.recording_id AND b.replicate = w.replicate AND b.src = w.node
    LEFT JOIN recurring.nw k ON k.recording_id = w.recording_id AND k.replicate = w.replicate AND k.source = w.source AND k.node = b.dst WHERE k.d IS NULL),
    nd AS (SELECT recording_id, replicate, source, node, d FROM nw WHERE source <> node),
    nn AS (SELECT n.recording_id, replicate, n.node FROM gnodes n JOIN (SELECT DISTINCT recording_id, replicate FROM ng) USING (recording_id)),
    nc AS (SELECT n.recording_id, n.replicate, n.node, least(n.node, min(x.node)) AS component, sum(x.d) AS sd, count(x.d) AS cd FROM nn n LEFT JOIN nd x
    ON x.recording_id = n.recording_id AND x.replicate = n.replicate AND x.source = n.node GROUP BY n.recording_id, n.replicate, n.node),
    nl AS (SELECT recording_id, avg(l) AS l_rand FROM (SELECT recording_id, replicate, sum(sd) / sum(cd) AS l, count(*) AS size, component FROM nc
    GROUP BY recording_id, replicate, component QUALIFY row_number() OVER (PARTITION BY recording_id, replicate ORDER BY count(*) DESC, component) = 1) GROUP BY ALL),
    nt AS (SELECT a.recording_id, a.replicate, unnest([a.src, a.dst, b.dst]) AS node FROM ng a JOIN ng b ON b.recording_id = a.recording_id AND b.replicate = a.replicate
    AND b.src = a.dst JOIN ng c ON c.recording_id = a.recording_id AND c.replicate = a.replicate AND c.src = a.src AND c.dst = b.dst),
    nk AS (SELECT n.recording_id, n.replicate, n.node, count(b.dst) AS k FROM nn n LEFT JOIN nb b ON b.recording_id = n.recording_id AND b.replicate = n.replicate
    AND b.src = n.node GROUP BY ALL),
    nq AS (SELECT recording_id, avg(c) AS c_rand FROM (SELECT recording_id, replicate, avg(CASE WHEN k >= 2 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END) AS c
    FROM nk LEFT JOIN (SELECT recording_id, replicate, node, count(*) AS t FROM nt GROUP BY ALL) USING (recording_id, replicate, node) GROUP BY ALL) GROUP BY ALL),
    oc AS (SELECT recording_id, avg(CASE WHEN degree >= 2 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS c_obs
    FROM gdeg LEFT JOIN (SELECT recording_id, node, count(*) AS t FROM (SELECT recording_id, unnest([x, y, z]) AS node FROM tri) GROUP BY ALL)
    USING (recording_id, node) GROUP BY ALL),
    ol AS (SELECT comp.recording_id, sum(d) / count(d) AS l_obs FROM (SELECT recording_id, component FROM (SELECT recording_id, component, count(*) AS size
    FROM comp GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY size DESC, component) = 1) JOIN comp USING (recording_id, component)
    LEFT JOIN bfs ON bfs.recording_id = comp.recording_id AND bfs.source = comp.node GROUP BY comp.recording_id)"""


@query("N12_small_worldness", """SELECT recording_id, CASE WHEN c_rand <> 0 AND l_rand <> 0 THEN (c_obs / c_rand) / (l_obs / l_rand) END AS small_worldness
       FROM oc JOIN ol USING (recording_id) LEFT JOIN nq USING (recording_id) LEFT JOIN nl USING (recording_id)""", "small_worldness",
       extra=_NULL, recursive=True)
def _(s, d):
    nodes, edges = i.graph(s, d)
    edges = cut_lineage(edges)
    seen = g.shape_metrics(nodes, edges, R)
    return g.small_worldness(nodes, edges, cut_lineage(seen), R, NULLS, 1)


# --- studies --------------------------------------------------------------------

# all metrics of each recording's graph, then as pairs; a study's graphs are named by recording and density
_GX = _NULL.replace("m.recording_id || '|' || replicate", "m.recording_id || '|0.1|' || replicate") + ", " + _GREEDY + """, gx AS (SELECT r.recording_id, r.study, r.pair_no, r.condition, coalesce(m, 0) / (n * (n - 1) / 2.0::DOUBLE) AS density,
    degree_mean, degree_std, c_obs AS clustering_mean, l_obs AS path_length, CASE WHEN c_rand <> 0 AND l_rand <> 0 THEN (c_obs / c_rand) / (l_obs / l_rand) END AS small_worldness,
    coalesce(e, 0) / (n * (n - 1)) AS efficiency, modularity, n_communities, n AS n_nodes, coalesce(m, 0) AS n_edges FROM recs r
    JOIN (SELECT recording_id, count(*) AS n, avg(degree) AS degree_mean, stddev_samp(degree) AS degree_std FROM gdeg GROUP BY ALL) USING (recording_id)
    LEFT JOIN (SELECT recording_id, count(*) AS m FROM gedges GROUP BY ALL) USING (recording_id) LEFT JOIN oc USING (recording_id) LEFT JOIN ol USING (recording_id)
    LEFT JOIN nq USING (recording_id) LEFT JOIN nl USING (recording_id) LEFT JOIN (SELECT recording_id, sum(1.0::DOUBLE / d) AS e FROM bfs GROUP BY ALL) USING (recording_id)
    LEFT JOIN gq USING (recording_id))"""
_GP = _GX + """, gpair AS (SELECT study, pair_no, metric, max(v) FILTER (WHERE condition = 'baseline') AS b, max(v) FILTER (WHERE condition = 'treatment') AS t,
    max(v) FILTER (WHERE condition = 'treatment') - max(v) FILTER (WHERE condition = 'baseline') AS delta FROM (SELECT study, pair_no, condition,
    unnest(['density', 'clustering_mean', 'path_length', 'small_worldness', 'efficiency', 'modularity']) AS metric,
    unnest([density, clustering_mean, path_length, small_worldness, efficiency, modularity]) AS v FROM gx) GROUP BY ALL)"""
_NAMES = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_LABELS.items()) + " END"
# the paired statistics' SQL over gpair in place of obs
_FT = (_GP + ", gobs AS (SELECT * FROM gpair WHERE b IS NOT NULL AND t IS NOT NULL), "
       + _B1.replace("ORDER BY pair_no, channel", "ORDER BY pair_no").replace("FROM obs)", "FROM gobs)") + ", "
       + _WX.replace("FROM obs WHERE", "FROM gobs WHERE") + ", " + _EXACT + ", " + _HG.replace("FROM obs GROUP", "FROM gobs GROUP")
       + """, ft AS (SELECT study, metric, median_baseline, median_treatment, median_delta, ci_lo, ci_hi, p,
    CASE WHEN n > 0 AND n_nonzero IS NULL THEN 1 ELSE wex.p_w END AS p_wilcoxon, hedges_g FROM (SELECT DISTINCT study, metric FROM gpair)
    LEFT JOIN (SELECT study, metric, count(*) AS n, median(b) AS median_baseline, median(t) AS median_treatment, median(t - b) AS median_delta FROM gobs GROUP BY ALL)
    USING (study, metric) LEFT JOIN (""" + _CI + """) USING (study, metric) LEFT JOIN (SELECT study, metric, n_nonzero, ex.p AS p_w FROM ws JOIN ex USING (study, metric)) wex
    USING (study, metric) LEFT JOIN hg USING (study, metric)),
    fb AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY study ORDER BY p DESC)) AS p_adj FROM (SELECT *, count(p) OVER (PARTITION BY study ORDER BY p) AS r,
    count(*) OVER (PARTITION BY study) AS m FROM ft) WHERE p IS NOT NULL UNION ALL SELECT *, NULL, NULL, NULL FROM ft WHERE p IS NULL)""")


# the same expressions over other graphs: every name of the chain gets a suffix
_CHAIN = "edges chans recs thr gedges gboth gnodes gdeg walk bfs comp tri ng nb nw nd nn nc nl nt nk nq oc ol gp gl gm gc gq gx gpair".split()


def _over(suffix: str, edges: str, chans: str, recs: str, thr: str, tail: str) -> str:
    """The graph expressions with their sources replaced, then ``tail``."""
    parts = [f"edges AS ({edges})", f"chans AS ({chans})", f"recs AS ({recs})", f"thr AS ({thr})"]
    parts += [f"{n} AS ({CTES[n]})" for n in ("gedges", "gboth", "gnodes", "gdeg", "walk", "bfs", "comp")]
    text = re.sub(rf"\b({'|'.join(_CHAIN)})\b", rf"\1_{suffix}", ", ".join([*parts, tail]))
    return text.replace("source_", "")


_DENS = [str(x) for x in PARAMS.connectivity.density_sweep]
_DV = "CROSS JOIN (SELECT unnest([" + ", ".join(f"'{x}'" for x in _DENS) + "]) AS dens)"
# graphs of the sweep are named by recording and density, which is what their random draws are made from
_SW = _over("sw", f"SELECT recording_id || '|' || dens AS recording_id, i, j, w FROM source_edges {_DV}",
            f"SELECT recording_id || '|' || dens AS recording_id, channel FROM source_chans {_DV}",
            f"SELECT recording_id || '|' || dens AS recording_id, study, condition, pair_no, dens FROM source_recs {_DV}",
            " UNION ALL ".join(f"SELECT recording_id || '|{x}' AS recording_id, {{pm:w:{100 - 100 * float(x):g}}} AS thr FROM "
                               "(SELECT recording_id, list_sort(list(w)) AS w FROM source_edges GROUP BY ALL)" for x in _DENS),
            _NULL + ", " + _GP[len(_NULL.replace("m.recording_id || '|' || replicate", "m.recording_id || '|0.1|' || replicate")) + 2:]
            .replace("r.condition,", "r.condition, r.dens,").replace("study, pair_no, metric, max", "study, pair_no, dens, metric, max")
            .replace("study, pair_no, condition,", "study, pair_no, dens, condition,"))
_ST = _STTC + ", " + _over(
    "st", "SELECT recording_id, study, pair_no, condition, i, j, w FROM sttc", "SELECT * FROM source_chans", "SELECT * FROM source_recs",
    "SELECT recording_id, {pm:w:90} AS thr FROM (SELECT recording_id, list_sort(list(w)) AS w FROM sttc GROUP BY ALL)", _GP)
_BOTH = _GP + ", " + _ST + """, cmp AS (SELECT study, pair_no, metric, a.delta AS pearson_delta, b.delta AS sttc_delta FROM gpair a JOIN gpair_st b USING (study, pair_no, metric))"""


@query("N13_graph_metrics", """SELECT recording_id, 0.1::DOUBLE AS target_density, n_nodes, n_edges, density, degree_mean, degree_std, clustering_mean, path_length, efficiency,
       modularity, n_communities, small_worldness FROM gx""",
       "target_density density degree_mean degree_std clustering_mean path_length efficiency modularity small_worldness", extra=_GX, recursive=True)
def _(s, d):
    m = cp.edge_metrics(i.edges(s, d), i.channels(s, d), [0.10], NULLS)
    return m.select("recording_id", "target_density", "n_nodes", "n_edges", "density", "degree_mean", "degree_std", "clustering_mean",
                    "path_length", "efficiency", "modularity", "n_communities", "small_worldness")


def _paired(s, d, method="xcorr"):
    _, m = cp.connectivity_study(i.spikes(s, d), i.channels(s, d), PARAMS, method, NULLS)
    return cut_lineage(g.paired_metrics(g.long_metrics(m, R), i.recordings(s, d)))


@query("C8_density_sweep", f"SELECT study, pair_no AS pair, dens::DOUBLE AS target_density, {_NAMES} AS metric, b AS baseline, t AS treatment, delta FROM gpair_sw",
       "target_density baseline treatment delta", extra=_SW, recursive=True)
def _(s, d):
    return exports.sweep_rows(cp.density_sweep(i.edges(s, d), i.channels(s, d), i.recordings(s, d),
                                               PARAMS.connectivity.density_sweep, NULLS))


@query("A19_sweep_summary", """SELECT study, dens::DOUBLE AS target_density, metric, count(delta) AS n, median(delta) AS median_delta FROM gpair_sw
       WHERE delta IS NOT NULL GROUP BY ALL""", "target_density median_delta", extra=_SW, recursive=True)
def _(s, d):
    sweep = cp.density_sweep(i.edges(s, d), i.channels(s, d), i.recordings(s, d), PARAMS.connectivity.density_sweep, NULLS)
    return cp.sweep_summary(cut_lineage(sweep))


@query("C9_connectivity_study", f"SELECT study, pair_no AS pair, {_NAMES} AS metric, b AS baseline, t AS treatment, delta FROM gpair", "baseline treatment delta",
       extra=_GP, recursive=True)
def _(s, d):
    return exports.method_rows(_paired(s, d))


@query("J12_method_join", "SELECT study, pair_no, metric, pearson_delta, sttc_delta FROM cmp", "pearson_delta sttc_delta", extra=_BOTH, recursive=True)
def _(s, d):
    return cp.method_comparison(_paired(s, d), _paired(s, d, "sttc"))


@query("A18_method_agreement", """SELECT study, metric, median(pearson_delta) AS pearson_median, median(sttc_delta) AS sttc_median,
       sign(median(pearson_delta)) = sign(median(sttc_delta)) AS same_sign FROM cmp GROUP BY ALL""", "pearson_median sttc_median", extra=_BOTH, recursive=True)
def _(s, d):
    return cp.method_agreement(cut_lineage(cp.method_comparison(_paired(s, d), _paired(s, d, "sttc"))))


@query("A20_condition_spread", """SELECT study, metric, condition, len(v) AS n, {pm:v:25} AS q1, {pm:v:50} AS median, {pm:v:75} AS q3 FROM (SELECT study, metric, condition,
       list_sort(list(y)) AS v FROM (SELECT study, metric, 'baseline' AS condition, b AS y FROM gpair UNION ALL SELECT study, metric, 'treatment', t FROM gpair)
       WHERE y IS NOT NULL GROUP BY ALL)""", "q1 median q3", extra=_GP, recursive=True)
def _(s, d):
    return cp.condition_spread(_paired(s, d))


@query("S16_pair_condition_table", """SELECT study, pair_no, condition, recording_id, density, degree_mean, clustering_mean, path_length, efficiency, modularity, n_communities,
       small_worldness FROM gx""", "density degree_mean clustering_mean path_length efficiency modularity small_worldness", extra=_GX, recursive=True)
def _(s, d):
    _, m = cp.connectivity_study(i.spikes(s, d), i.channels(s, d), PARAMS, "xcorr", NULLS)
    return cp.pair_condition_table(m, i.recordings(s, d))


@query("P14_metric_family_test", f"""SELECT study, metric, {_NAMES} AS label, median_baseline, median_treatment, median_delta, ci_lo AS ci_delta_lo, ci_hi AS ci_delta_hi,
       p AS p_bootstrap, p_adj AS p_bh_fdr, p_wilcoxon, hedges_g AS hedges_g_av FROM fb""",
       "median_baseline median_treatment median_delta ci_delta_lo ci_delta_hi p_bootstrap p_bh_fdr p_wilcoxon hedges_g_av", extra=_FT, recursive=True)
def _(s, d):
    return cp.metric_table(cp.family_test(_paired(s, d), PARAMS, ITERATIONS))


_SLOPES = """sl AS (SELECT study, pair_no, max(s) FILTER (WHERE condition = 'baseline') AS b, max(s) FILTER (WHERE condition = 'treatment') AS t FROM (SELECT study,
    pair_no, condition, regr_slope(abs(w), dist) AS s FROM edges JOIN epairs USING (i, j) GROUP BY ALL) GROUP BY ALL),
    wd AS (SELECT study, 'slope' AS metric, b - t AS d FROM sl WHERE b <> t), """ + _WX[_WX.index("wr AS"):] + ", " + _EXACT


@query("P16_slope_test", """SELECT study, n, median_diff, n_nonzero, wp AS w, (wp - wm) / (wp + wm) AS r_rank_biserial, ex.p AS p_wilcoxon FROM (SELECT study, count(*) AS n,
       median(t - b) AS median_diff FROM sl WHERE b IS NOT NULL AND t IS NOT NULL GROUP BY ALL) JOIN ws USING (study) JOIN ex USING (study)""",
       "median_diff w r_rank_biserial p_wilcoxon", extra=_SLOPES, recursive=True)
def _(s, d):
    return cp.slope_test(cut_lineage(i.edges(s, d)), i.recordings(s, d))


@query("P16_distance_slopes", """SELECT study, pair_no, max(s) FILTER (WHERE condition = 'baseline') AS b, max(s) FILTER (WHERE condition = 'treatment') AS t,
       max(s) FILTER (WHERE condition = 'treatment') - max(s) FILTER (WHERE condition = 'baseline') AS delta FROM (SELECT study, pair_no, condition,
       regr_slope(abs(w), dist) AS s FROM edges JOIN epairs USING (i, j) GROUP BY ALL) GROUP BY ALL""", "b t delta")
def _(s, d):
    sl = cn.distance_slopes(i.edges(s, d)).select("recording_id", F.lit("slope").alias("metric"), F.col("slope").alias("value"))
    return g.paired_metrics(sl, i.recordings(s, d)).drop("metric")
