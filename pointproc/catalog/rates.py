"""Queries: sources, filters, rate joins and aggregates, sequences, top-k, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointproc.catalog import inputs as i
from pointproc.catalog.base import DAY, DUR, HOUR, query
from pointproc.functions import scalar as sc
from pointproc.functions.quantile import percentile_mid
from pointproc.operators import connectivity as cn
from pointproc.operators import observations as ob
from pointproc.operators import trains as tr
from pointproc.operators.density import kernel_density
from pointproc.sources import electrodes as el
from pointproc.sources import store
from pointproc.sources import testdata as td

K = ["study", "metric"]
ALL_CHANNELS = [c for c in range(1, 64) if c not in el.GROUND]


def seconds(trains):
    return trains.withColumn("t", F.col("t_us") / 1e6).drop("t_us")


# --- sources --------------------------------------------------------------------

@query("S2_read_pair", "SELECT b.study, b.pair_no, b.recording_id AS baseline_id, t.recording_id AS treatment_id "
       "FROM recs b JOIN recs t USING (study, pair_no) WHERE b.condition = 'baseline' AND t.condition = 'treatment'")
def _(s, d):
    return store.read_pairs(i.recordings(s, d))


@query("S3_pair_spikes", """SELECT r.recording_id, 61 - e.pin AS ord, e.channel, c.channel IS NOT NULL AS found, s.t_us / 1e6 AS t
       FROM recs r CROSS JOIN elec e LEFT JOIN chans c USING (recording_id, channel)
       LEFT JOIN spikes s USING (recording_id, channel)""", "t", ints="ord channel")
def _(s, d):
    return seconds(store.channel_trains(i.spikes(s, d), i.channels(s, d), i.recordings(s, d), ALL_CHANNELS[::-1]))


@query("S4_pool_metric", """SELECT study, pair_no, channel, 'spike_rate' AS metric, sb AS b, st AS t FROM obs2
       UNION ALL SELECT study, pair_no, channel, 'burst_rate', bb, bt FROM obs2
       UNION ALL SELECT study, pair_no, channel, 'n_spikes', nsb, nst FROM obs2
       UNION ALL SELECT study, pair_no, channel, 'n_bursts', nbb, nbt FROM obs2""", "b t")
def _(s, d):
    summary, recs = i.summary(s, d), i.recordings(s, d)
    parts = [ob.pool_metric(summary, recs, m) for m in ob.METRICS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("S5_recordings_for_study", """SELECT recording_id, study, condition, pair_no, CASE WHEN condition = 'baseline'
       THEN 'Baseline' WHEN study = 'ket' THEN 'Ketanserin' ELSE 'DOI' END AS label FROM recs""")
def _(s, d):
    return store.recordings_for(i.recordings(s, d), "all").select(
        "recording_id", "study", "condition", "pair_no", "label")


@query("S6_pending_recordings", "SELECT recording_id, study FROM recs WHERE recording_id IN (SELECT recording_id FROM spikes) "
       "AND recording_id NOT IN (SELECT recording_id FROM spikes GROUP BY ALL HAVING max(t_us) > " + str(DUR - HOUR) + ")")
def _(s, d):
    sp = i.spikes(s, d)
    done = sp.groupBy("recording_id").agg(F.max("t_us").alias("last")).filter(F.col("last") > DUR - HOUR)
    return store.pending(i.recordings(s, d), done, sp).select("recording_id", "study")


@query("S15_electrode_dimension", """SELECT recording_id, channel, pin, label, grid_row, grid_col, x, y, n_spikes
       FROM summary JOIN elec USING (channel)""", ints="pin label grid_row grid_col x y channel")
def _(s, d):
    counts = tr.channel_summary(i.channels(s, d), i.spikes(s, d)).select("recording_id", "channel", "n_spikes")
    return counts.join(F.broadcast(el.electrodes(s)), "channel")


# --- filters --------------------------------------------------------------------

OBS = "SELECT study, metric, pair_no, channel, b, t FROM obs WHERE "


@query("F1_silent_baseline_min", OBS + "b >= 1", "b t")
def _(s, d):
    return ob.keep_not_silent(i.obs(s, d), "baseline_min", td.MIN_RATE)


@query("F2_silent_both_zero_rate", OBS + "NOT (b < 1 AND t < 1)", "b t")
def _(s, d):
    return ob.keep_not_silent(i.obs(s, d), "both_zero", td.MIN_RATE)


@query("F3_silent_both_zero_burst", OBS + "metric = 'burst_rate' AND NOT (b = 0 AND t = 0)", "b t")
def _(s, d):
    return ob.keep_not_silent(i.burst_obs(s, d), "both_zero", 0.0)


@query("F4_silent_either_zero", OBS + "b >= 1 AND t >= 1", "b t")
def _(s, d):
    return ob.keep_not_silent(i.obs(s, d), "either_zero", td.MIN_RATE)


@query("F5_scatter_activity", OBS + "b >= 1 OR t >= 1", "b t")
def _(s, d):
    return ob.keep_active_either(i.obs(s, d), td.MIN_RATE)


_CUTS = """q AS (SELECT study, metric, list_sort(list(y)) AS v FROM pooled GROUP BY ALL),
    mm AS (SELECT study, metric, 1.5 * avg(b) AS mb, 1.5 * avg(t) AS mt FROM obs GROUP BY ALL),
    cuts AS (SELECT study, metric, 'tukey' AS mode, {pm:v:75} + 0.5 * ({pm:v:75} - {pm:v:25}) AS cut_b,
        {pm:v:75} + 0.5 * ({pm:v:75} - {pm:v:25}) AS cut_t FROM q
    UNION ALL SELECT study, metric, 'percentile', {pm:v:90}, {pm:v:90} FROM q
    UNION ALL SELECT study, metric, 'mean_multiplier', mb, mt FROM mm
    UNION ALL SELECT study, metric, 'none', NULL, NULL FROM q)"""
_MODES = {"tukey": {"iqr_factor": 0.5}, "percentile": {"upper_percentile": 90.0},
          "mean_multiplier": {"multiplier": 1.5}, "none": {}}


@query("F6_outlier_report", """SELECT mode, study, metric, count(*) AS n_total,
       count(*) FILTER (WHERE mode = 'none' OR (b <= cut_b AND t <= cut_t)) AS n_kept,
       count(*) FILTER (WHERE NOT (mode = 'none' OR (b <= cut_b AND t <= cut_t))) AS n_dropped,
       max(cut_b) AS cut_b, max(cut_t) AS cut_t FROM obs JOIN cuts USING (study, metric) GROUP BY mode, study, metric""",
       "cut_b cut_t", extra=_CUTS)
def _(s, d):
    o, out = i.obs(s, d), None
    for mode, opt in _MODES.items():
        part = ob.outlier_report(o, K, mode, **opt).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("F6_drop_outliers_tukey", "SELECT study, metric, pair_no, channel, b, t FROM obs JOIN cuts USING (study, metric) "
       "WHERE mode = 'tukey' AND b <= cut_b AND t <= cut_t", "b t", extra=_CUTS)
def _(s, d):
    return ob.drop_outliers(i.obs(s, d), K, "tukey", iqr_factor=0.5)


@query("F7_legacy_outlier_flag", """SELECT study, metric, pair_no, channel, b, t FROM obs JOIN cuts USING (study, metric)
       WHERE mode = 'mean_multiplier' AND b <= cut_b AND t <= cut_t""", "b t", extra=_CUTS)
def _(s, d):
    return ob.drop_outliers(i.obs(s, d), K, ob.outlier_mode("tukey", True), multiplier=1.5)


@query("F8_raw_pct_change", "SELECT study, pair_no, channel, pct FROM spct", "pct")
def _(s, d):
    # no cap is applied here, only the value given to activity from silence
    o = i.spike_obs(s, d).withColumn("pct", sc.capped_pct(F.col("b"), F.col("t"), 1000.0))
    return o.filter("pct IS NOT NULL").select("study", "pair_no", "channel", "pct")


@query("F9_drop_silenced", "SELECT study, pair_no, channel, metric, pct FROM pct WHERE NOT abs(pct + 100) < 1e-6", "pct")
def _(s, d):
    return ob.keep_pct(i.pct(s, d), None, True).select("study", "pair_no", "channel", "metric", "pct")


@query("F10_pct_cap", "SELECT study, pair_no, channel, pct FROM spct WHERE pct <= 50", "pct")
def _(s, d):
    o = i.spike_obs(s, d).withColumn("pct", sc.capped_pct(F.col("b"), F.col("t"), 1000.0)).filter("pct IS NOT NULL")
    return ob.keep_pct(o, 50.0, False).select("study", "pair_no", "channel", "pct")


@query("F11_burst_pct_change", "SELECT study, pair_no, channel, b, t, pct FROM bpct", "b t pct")
def _(s, d):
    o = i.obs(s, d)
    return ob.burst_pct_change(o.filter("metric = 'burst_rate'"), o.filter("metric = 'spike_rate'")).select(
        "study", "pair_no", "channel", "b", "t", "pct")


@query("F12_safe_pct", "SELECT study, metric, pair_no, channel, CASE WHEN b <> 0 THEN 100 * (t - b) / b WHEN t > 0 THEN 1e6::DOUBLE END AS pct "
       "FROM obs WHERE b <> 0 OR t > 0", "pct")
def _(s, d):
    return i.obs(s, d).withColumn("pct", sc.safe_pct(F.col("b"), F.col("t"))).filter("pct IS NOT NULL").drop("b", "t")


_CAT = """cat AS (SELECT *, CASE WHEN t = 0 THEN 'silenced' WHEN abs(t - b) <= 1e-6 * b THEN 'unchanged'
    WHEN t > b THEN 'increased' ELSE 'decreased' END AS category FROM obs WHERE b > 0)"""


@query("F13_change_category", "SELECT study, metric, pair_no, channel, category FROM cat", extra=_CAT)
def _(s, d):
    c = sc.change_category(F.col("b"), F.col("t"))
    return i.obs(s, d).withColumn("category", c).filter("category IS NOT NULL").drop("b", "t")


@query("F14_direction_flags", """SELECT study, metric, pair_no, channel, t > b AS increased, t < b AS decreased,
       NOT t > b AS decreased_scatter FROM obs""")
def _(s, d):
    b, t = F.col("b"), F.col("t")
    return i.obs(s, d).select("study", "metric", "pair_no", "channel", (t > b).alias("increased"),
                              (t < b).alias("decreased"), (~(t > b)).alias("decreased_scatter"))


@query("F15_log_axis_floor", """SELECT study, metric, pair_no, channel, floor, greatest(b, floor) AS b_plot,
       greatest(t, floor) AS t_plot, t > b AS increased FROM obs JOIN (SELECT study, metric,
       coalesce(0.5 * min(y) FILTER (WHERE y > 0), 0.1) AS floor FROM pooled GROUP BY ALL) USING (study, metric)""",
       "floor b_plot t_plot")
def _(s, d):
    return ob.on_log_axis(i.obs(s, d), K, 0.0).drop("b", "t")


@query("F18_burst_window_overlap", f"""SELECT recording_id, channel, start_idx, end_idx, start_us, end_us FROM bursts
       WHERE start_us < {10 * DAY} AND end_us > {5 * DAY}""", ints="start_idx end_idx")
def _(s, d):
    return i.bursts(s, d).filter((F.col("start_us") < 10 * DAY) & (F.col("end_us") > 5 * DAY)).select(
        "recording_id", "channel", "start_idx", "end_idx", "start_us", "end_us")


@query("F19_bursts_gained_silenced", """SELECT study, count(*) FILTER (WHERE b > 0 AND t = 0) AS n_silenced,
       count(*) FILTER (WHERE b = 0 AND t > 0) AS n_gained FROM obs WHERE metric = 'burst_rate' GROUP BY study""")
def _(s, d):
    b, t = F.col("b"), F.col("t")
    return i.burst_obs(s, d).groupBy("study").agg(F.count_if((b > 0) & (t == 0)).alias("n_silenced"),
                                                  F.count_if((b == 0) & (t > 0)).alias("n_gained"))


_QC = """SELECT r.recording_id, 64.0::DOUBLE AS fs, {dur}::BIGINT AS duration_us, n_active, n_bursts, median_active_rate,
    n_active < 5 AS few_active, coalesce(median_active_rate > 2.3, false) AS rate_high FROM recs r
    JOIN (SELECT recording_id, count(*) FILTER (WHERE spike_rate >= 1) AS n_active, sum(n_bursts)::BIGINT AS n_bursts,
    median(spike_rate) FILTER (WHERE spike_rate >= 1) AS median_active_rate FROM summary GROUP BY ALL) USING (recording_id)
    """.replace("{dur}", str(DUR))


@query("F22_qc_predicates", "SELECT recording_id, few_active, rate_high FROM qc", extra=f"qc AS ({_QC})")
def _(s, d):
    return ob.qc_report(i.summary(s, d), i.recordings(s, d), td.MIN_RATE, 5, 2.3).select(
        "recording_id", "few_active", "rate_high")


@query("A13_qc_rollup", _QC, "median_active_rate")
def _(s, d):
    return ob.qc_report(i.summary(s, d), i.recordings(s, d), td.MIN_RATE, 5, 2.3)


@query("F24_channel_eligibility", """SELECT study, pair_no, channel, b, t FROM obs JOIN (SELECT study, pair_no,
       {pm:v:98} AS ceil FROM (SELECT study, pair_no, list_sort(list(b)) AS v FROM obs WHERE metric = 'spike_rate'
       AND b >= 1 AND t >= 0.05 GROUP BY ALL)) USING (study, pair_no) WHERE metric = 'spike_rate' AND b >= 1
       AND t >= 0.05 AND b <= ceil""", "b t")
def _(s, d):
    alive = i.spike_obs(s, d).filter("b >= 1 AND t >= 0.05")
    cut = percentile_mid(alive, ["study", "pair_no"], "b", {"ceil": 98}).drop("n")
    return alive.join(cut, ["study", "pair_no"]).filter("b <= ceil").select("study", "pair_no", "channel", "b", "t")


@query("F25_channel_domain", "SELECT recording_id, channel, count(*) AS n FROM spikes WHERE channel BETWEEN 1 AND 63 "
       "AND channel NOT IN (16, 32, 48, 64) GROUP BY ALL")
def _(s, d):
    return el.signal_channels(i.spikes(s, d)).groupBy("recording_id", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("F26_electrode_validation", """SELECT recording_id, count(*) AS n_channels, count(DISTINCT label) AS n_labels,
       count(*) FILTER (WHERE label IN (11, 18, 81, 88)) AS n_absent, bool_and(label // 10 BETWEEN 1 AND 8 AND
       label % 10 BETWEEN 1 AND 8) AS digits_ok, bool_and(channel NOT IN (16, 32, 48, 64)) AS ground_ok
       FROM chans JOIN elec USING (channel) GROUP BY ALL""")
def _(s, d):
    label = F.col("label")
    rows = i.channels(s, d).join(F.broadcast(el.electrodes(s)), "channel")
    return rows.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_channels"), F.countDistinct("label").alias("n_labels"),
        F.count_if(label.isin(*el.ABSENT_LABELS)).alias("n_absent"),
        F.bool_and(F.floor(label / 10).between(1, 8) & (label % 10).between(1, 8)).alias("digits_ok"),
        F.bool_and(~F.col("channel").isin(*el.GROUND)).alias("ground_ok"))


# --- joins ----------------------------------------------------------------------

@query("J1_baseline_join_treatment", "SELECT study, pair_no, channel, sb AS b, st AS t FROM obs2", "b t")
def _(s, d):
    return i.spike_obs(s, d).drop("metric")


@query("J2_align_to_channels", """SELECT r.recording_id, e.channel, s.spike_rate FROM recs r CROSS JOIN elec e
       LEFT JOIN summary s USING (recording_id, channel)""", "spike_rate", ints="channel")
def _(s, d):
    rates = tr.channel_summary(i.channels(s, d), i.spikes(s, d), None, td.DAY_US)
    asked = i.recordings(s, d).select("recording_id", F.explode(F.array(*[F.lit(c) for c in ALL_CHANNELS])).alias("channel"))
    return asked.join(rates.select("recording_id", "channel", "spike_rate"), ["recording_id", "channel"], "left")


@query("J3_pair_by_suffix", """SELECT coalesce(b.k, t.k) AS pair_no, b.name AS baseline, t.name AS treatment,
       CASE WHEN t.name IS NULL THEN 'no treatment' WHEN b.name IS NULL THEN 'no baseline' ELSE 'ok' END AS status
       FROM (SELECT c_name AS name, regexp_extract(c_name, '#(\\d+)$', 1)::BIGINT AS k FROM customer) b
       FULL JOIN (SELECT s_name AS name, regexp_extract(s_name, '#(\\d+)$', 1)::BIGINT AS k FROM supplier) t ON b.k = t.k""")
def _(s, d):
    return store.pair_up(i.table(s, d, "customer").select(F.col("c_name").alias("name")),
                         i.table(s, d, "supplier").select(F.col("s_name").alias("name")))


# --- aggregates -----------------------------------------------------------------

@query("A1_spike_counts", "SELECT recording_id, channel, n_spikes, spike_rate FROM summary", "spike_rate")
def _(s, d):
    return tr.channel_summary(i.channels(s, d), i.spikes(s, d), None, td.DAY_US).drop("duration_us")


@query("A2_burst_counts", "SELECT recording_id, channel, n_bursts, burst_rate FROM summary", "burst_rate")
def _(s, d):
    return i.summary(s, d).select("recording_id", "channel", "n_bursts", "burst_rate")


@query("A3_inferred_duration", f"SELECT recording_id, greatest(max(t_us), {HOUR}) AS duration_us FROM spikes GROUP BY ALL")
def _(s, d):
    return tr.inferred_duration(i.spikes(s, d), td.BIN_US)


@query("A4_binned_counts", "SELECT recording_id, channel, bin, c FROM bins")
def _(s, d):
    return i.bins(s, d).drop("n_bins")


@query("A5_binned_moments", "SELECT recording_id, channel, s, s2, mu AS mean, sd FROM moments", "mean sd")
def _(s, d):
    return tr.bin_moments(i.bins(s, d), i.channels(s, d), td.BIN_US).drop("n_bins")


_POP = f"""pop AS (SELECT r.recording_id, r.condition, r.study, g.bin, coalesce(h.n, 0) * {1e6 / (6 * HOUR)!r} * 3600 AS rate
    FROM recs r CROSS JOIN (SELECT unnest(range(0, {14 * 4})) AS bin) g LEFT JOIN (SELECT recording_id,
    least(t_us // {6 * HOUR}, {14 * 4 - 1}) AS bin, count(*) AS n FROM spikes WHERE t_us <= {14 * DAY} GROUP BY ALL) h
    USING (recording_id, bin))"""


@query("A6_population_rate", "SELECT recording_id, condition, study, bin, rate FROM pop", "rate", extra=_POP)
def _(s, d):
    return tr.population_rate(i.spikes(s, d), i.recordings(s, d), 6 * HOUR, 14 * DAY, HOUR)


@query("A7_mean_sem_per_bin", "SELECT condition, bin, avg(rate) AS mean, stddev_samp(rate) / sqrt(count(*)) AS sem FROM pop GROUP BY ALL",
       "mean sem", extra=_POP)
def _(s, d):
    rates = tr.population_rate(i.spikes(s, d), i.recordings(s, d), 6 * HOUR, 14 * DAY, HOUR)
    return tr.smoothed_mean_sem(rates, ["condition"], 0)


@query("W5_moving_average", """SELECT condition, bin, avg(mean) OVER w AS mean, avg(sem) OVER w AS sem FROM (SELECT condition, bin,
       avg(rate) AS mean, stddev_samp(rate) / sqrt(count(*)) AS sem FROM pop GROUP BY ALL)
       WINDOW w AS (PARTITION BY condition ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""", "mean sem", extra=_POP)
def _(s, d):
    rates = tr.population_rate(i.spikes(s, d), i.recordings(s, d), 6 * HOUR, 14 * DAY, HOUR)
    return tr.smoothed_mean_sem(rates, ["condition"], 2)


@query("A8_direction_shares", """SELECT study, metric, count(*) AS n, 100.0 * count(*) FILTER (WHERE t > b) / count(*) AS pct_increased,
       100.0 * count(*) FILTER (WHERE t < b) / count(*) AS pct_decreased FROM obs GROUP BY ALL""", "pct_increased pct_decreased")
def _(s, d):
    return ob.direction_shares(i.obs(s, d), K)


_CATN = _CAT + """, cn AS (SELECT study, metric, pair_no, count(*) FILTER (WHERE category = 'silenced') AS s,
    count(*) FILTER (WHERE category = 'decreased') AS d, count(*) FILTER (WHERE category = 'increased') AS u,
    count(*) FILTER (WHERE category = 'unchanged') AS x FROM cat GROUP BY ALL),
    tot AS (SELECT study, metric, sum(s)::BIGINT AS n_silenced, sum(d)::BIGINT AS n_decreased, sum(u)::BIGINT AS n_increased,
    sum(x)::BIGINT AS n_unchanged FROM cn GROUP BY ALL),
    sh AS (SELECT study, metric, count(*) AS n_recordings, avg(100.0 * s / (s + d + u)) AS mean_pct_silenced,
    avg(100.0 * d / (s + d + u)) AS mean_pct_decreased, avg(100.0 * u / (s + d + u)) AS mean_pct_increased,
    median(100.0 * s / (s + d + u)) AS median_pct_silenced, median(100.0 * d / (s + d + u)) AS median_pct_decreased,
    median(100.0 * u / (s + d + u)) AS median_pct_increased FROM cn WHERE s + d + u > 0 GROUP BY ALL)"""


@query("A9_category_percentages", "SELECT * FROM tot LEFT JOIN sh USING (study, metric)",
       "mean_pct_silenced mean_pct_decreased mean_pct_increased median_pct_silenced median_pct_decreased median_pct_increased",
       extra=_CATN)
def _(s, d):
    return ob.category_report(i.obs(s, d), K, [*K, "pair_no"])


_PL = "pl AS (SELECT study, metric, list_sort(list(pct)) AS v FROM pct GROUP BY ALL)"


@query("A10_violin_summary", """SELECT study, metric, n, {pm:v:50} AS median_pct, {pm:v:25} AS q1, {pm:v:75} AS q3, mean_pct,
       pct_above_zero, pct_below_zero FROM pl JOIN (SELECT study, metric, count(*) AS n, avg(pct) AS mean_pct,
       100.0 * count(*) FILTER (WHERE pct > 0) / count(*) AS pct_above_zero, 100.0 * count(*) FILTER (WHERE pct < 0) / count(*)
       AS pct_below_zero FROM pct GROUP BY ALL) USING (study, metric)""",
       "median_pct q1 q3 mean_pct pct_above_zero pct_below_zero", extra=_PL)
def _(s, d):
    return ob.violin_summary(i.pct(s, d), K)


_BOX = _PL + """, bx AS (SELECT study, metric, len(v) AS n, {pm:v:25} AS q1, {pm:v:50} AS median, {pm:v:75} AS q3,
    {pm:v:25} - 1.5 * ({pm:v:75} - {pm:v:25}) AS lower_fence, {pm:v:75} + 1.5 * ({pm:v:75} - {pm:v:25}) AS upper_fence FROM pl)"""


@query("A11_box_stats", """SELECT *, ceil((whisker_top + greatest(30, 0.15 * (whisker_top + 100))) / 50) * 50 AS axis_top FROM (
       SELECT bx.*, coalesce(max(pct) FILTER (WHERE pct <= upper_fence), any_value(q3)) AS whisker_top,
       coalesce(avg(pct) FILTER (WHERE pct BETWEEN lower_fence AND upper_fence), avg(pct)) AS mean_inlier
       FROM bx JOIN pct USING (study, metric) GROUP BY bx.study, bx.metric, n, q1, median, q3, lower_fence, upper_fence)""",
       "q1 median q3 lower_fence upper_fence whisker_top mean_inlier axis_top", extra=_BOX)
def _(s, d):
    return ob.box_stats(i.pct(s, d), K)


@query("A12_inlier_mean_iqr", """SELECT study, metric, n, {pm:w:25} AS q1, {pm:w:75} AS q3, mean FROM (SELECT study, metric,
       count(*) AS n, list_sort(list(pct)) AS w, avg(pct) AS mean FROM bx JOIN pct USING (study, metric)
       WHERE q3 - q1 <= 0 OR pct BETWEEN lower_fence AND upper_fence GROUP BY ALL)""", "q1 q3 mean", extra=_BOX)
def _(s, d):
    return ob.inlier_mean_iqr(i.pct(s, d), K, "pct")


@query("Q1_percentile_mid", """SELECT l_returnflag, l_linestatus, n, {pm:v:2.5} AS p2_5, {pm:v:25} AS p25, {pm:v:50} AS p50,
       {pm:v:75} AS p75, {pm:v:97.5} AS p97_5, {pm:v:100} AS p100 FROM (SELECT l_returnflag, l_linestatus, count(*) AS n,
       list_sort(list(l_extendedprice * (1 - l_discount))) AS v FROM lineitem GROUP BY ALL)""", "p2_5 p25 p50 p75 p97_5 p100")
def _(s, d):
    li = i.table(s, d, "lineitem").select("l_returnflag", "l_linestatus", (
        F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return percentile_mid(li, ["l_returnflag", "l_linestatus"], "v",
                          {"p2_5": 2.5, "p25": 25, "p50": 50, "p75": 75, "p97_5": 97.5, "p100": 100})


# --- sequences ------------------------------------------------------------------

@query("W1_inter_spike_interval", "SELECT recording_id, channel, idx, t_us, next - t_us AS isi_us FROM seq WHERE next IS NOT NULL")
def _(s, d):
    return tr.intervals(i.spikes(s, d), td.BLOCK_US)


_REF = f"""keep AS (SELECT recording_id, channel, idx, t_us, t_us AS last FROM seq WHERE idx = 1 UNION ALL
    SELECT s.recording_id, s.channel, s.idx, s.t_us, CASE WHEN s.t_us - k.last >= {td.REFRACTORY_US} THEN s.t_us ELSE k.last END
    FROM keep k JOIN seq s ON s.recording_id = k.recording_id AND s.channel = k.channel AND s.idx = k.idx + 1)"""


@query("W2_refractory", "SELECT recording_id, channel, t_us FROM keep WHERE t_us = last", extra=_REF, recursive=True)
def _(s, d):
    return tr.drop_refractory(i.spikes(s, d), td.REFRACTORY_US, td.BLOCK_US).drop("duration_us")


_STATE = f"""st AS (SELECT recording_id, channel, idx, next - t_us <= {4 * HOUR} AS inb,
    CASE WHEN next - t_us <= {4 * HOUR} THEN idx END AS start, NULL::BIGINT AS s0, NULL::BIGINT AS e0 FROM seq WHERE idx = 1
    UNION ALL SELECT q.recording_id, q.channel, q.idx,
    CASE WHEN st.inb THEN q.next - q.t_us <= {8 * HOUR} ELSE q.next - q.t_us <= {4 * HOUR} END,
    CASE WHEN st.inb THEN st.start WHEN q.next - q.t_us <= {4 * HOUR} THEN q.idx END,
    CASE WHEN st.inb AND (q.next IS NULL OR q.next - q.t_us > {8 * HOUR}) THEN st.start END,
    CASE WHEN st.inb AND (q.next IS NULL OR q.next - q.t_us > {8 * HOUR}) THEN q.idx END
    FROM st JOIN seq q ON q.recording_id = st.recording_id AND q.channel = st.channel AND q.idx = st.idx + 1)"""


@query("W3_burst_detection", """SELECT recording_id, channel, row_number() OVER (PARTITION BY recording_id, channel ORDER BY s0) AS burst_no,
       s0 AS start_idx, e0 AS end_idx, a.t_us AS start_us, b.t_us AS end_us, e0 - s0 + 1 AS n_spikes FROM st
       JOIN (SELECT recording_id, channel, idx AS s0, t_us FROM seq) a USING (recording_id, channel, s0)
       JOIN (SELECT recording_id, channel, idx AS e0, t_us FROM seq) b USING (recording_id, channel, e0)
       WHERE e0 - s0 + 1 >= 3""", extra=_STATE, recursive=True)
def _(s, d):
    return i.bursts(s, d).drop("duration_us")


@query("W3_burst_detection_min5", f"""SELECT recording_id, channel, start_idx, end_idx, start_us, end_us FROM (SELECT recording_id,
       channel, min(idx) FILTER (WHERE next - t_us <= {4 * HOUR}) AS start_idx, max(idx) AS end_idx,
       min(t_us) FILTER (WHERE next - t_us <= {4 * HOUR}) AS start_us, max(t_us) AS end_us FROM isl
       GROUP BY recording_id, channel, island) WHERE end_idx - start_idx + 1 >= 5""")
def _(s, d):
    return tr.bursts(i.spikes(s, d), td.ISI_MAX_US, td.ISI_END_US, 5, td.BLOCK_US).select(
        "recording_id", "channel", "start_idx", "end_idx", "start_us", "end_us")


@query("W4_tiling_coverage", f"""SELECT recording_id, channel, n_spikes, covered / {DUR} AS coverage FROM (SELECT recording_id, channel,
       count(*) AS n_spikes, sum(least(least({DUR}, t_us + {2 * HOUR}), CASE WHEN next IS NULL THEN {DUR} ELSE greatest(0, next - {2 * HOUR}) END)
       - greatest(0, t_us - {2 * HOUR})) AS covered FROM seq GROUP BY ALL)""", "coverage")
def _(s, d):
    return tr.coverage(i.spikes(s, d), td.DELTA_US, td.BLOCK_US)


@query("W10_raster_projection", """SELECT r.recording_id, e.pin AS ord, e.channel, s.t_us / 1e6 AS t FROM recs r CROSS JOIN elec e
       LEFT JOIN spikes s USING (recording_id, channel)""", "t", ints="ord channel")
def _(s, d):
    return seconds(store.channel_trains(i.spikes(s, d), i.channels(s, d), i.recordings(s, d), ALL_CHANNELS)).drop("found")


@query("W11_burst_onsets", f"""SELECT r.recording_id, e.channel, b.start_us / 1e6 AS onset, coalesce(b.start_us BETWEEN 0 AND {DUR}, true) AS in_range
       FROM recs r CROSS JOIN elec e LEFT JOIN bursts b USING (recording_id, channel)""", "onset", ints="channel")
def _(s, d):
    asked = i.recordings(s, d).select("recording_id", "duration_us", F.explode(F.array(*[F.lit(c) for c in ALL_CHANNELS])).alias("channel"))
    b = i.bursts(s, d).select("recording_id", "channel", "start_us")
    return asked.join(b, ["recording_id", "channel"], "left").select(
        "recording_id", "channel", (F.col("start_us") / 1e6).alias("onset"),
        F.coalesce(F.col("start_us").between(F.lit(0), F.col("duration_us")), F.lit(True)).alias("in_range"))


# --- top-k and sets -------------------------------------------------------------

_REP = """rb AS (SELECT * FROM obs WHERE metric = 'spike_rate' AND b >= 1 AND t >= 0.05),
    rc AS (SELECT study, pair_no, {pm:v:98} AS ceil FROM (SELECT study, pair_no, list_sort(list(b)) AS v FROM rb GROUP BY ALL)),
    re AS (SELECT study, pair_no, channel, b, t, (t - b) / greatest(1, b) AS score, count(*) OVER (PARTITION BY study, pair_no) AS n
    FROM rb JOIN rc USING (study, pair_no) WHERE b <= ceil),
    rs AS (SELECT study, pair_no, CASE WHEN sign(median(score)) = 0 THEN 1 ELSE sign(median(score)) END AS sg FROM re GROUP BY ALL),
    ro AS (SELECT *, row_number() OVER (PARTITION BY study, pair_no ORDER BY score * sg DESC, channel) AS r FROM re JOIN rs USING (study, pair_no)),
    rt AS (SELECT *, row_number() OVER (PARTITION BY study, pair_no ORDER BY b, r) AS rank, count(*) OVER (PARTITION BY study, pair_no) AS m
    FROM ro WHERE n > 8 AND r <= greatest(8, floor(n * 0.7 + 0.5))),
    rk AS (SELECT DISTINCT study, pair_no, floor(1 + k * (m - 1) / 7.0::DOUBLE + 0.5)::BIGINT AS rank FROM rt CROSS JOIN (SELECT unnest(range(0, 8)) AS k))"""


@query("T4_representative_channels", """SELECT study, pair_no, channel FROM ro WHERE n <= 8 UNION ALL
       SELECT study, pair_no, channel FROM rt JOIN rk USING (study, pair_no, rank)""", extra=_REP)
def _(s, d):
    return ob.representative_channels(i.spike_obs(s, d), ["study", "pair_no"], 8, 1.0)


@query("T5_label_order", """SELECT recording_id, label, channel, n_spikes, row_number() OVER (PARTITION BY recording_id ORDER BY label) AS pos
       FROM summary JOIN elec USING (channel)""", ints="label channel")
def _(s, d):
    from pyspark.sql import Window

    counts = tr.channel_summary(i.channels(s, d), i.spikes(s, d)).select("recording_id", "channel", "n_spikes")
    w = Window.partitionBy("recording_id").orderBy("label")  # at most 60 electrodes
    return counts.join(F.broadcast(el.electrodes(s).select("channel", "label")), "channel").withColumn(
        "pos", F.row_number().over(w))


@query("T6_default_pair", """SELECT study, pair_no, baseline_id, treatment_id FROM (SELECT b.study, pair_no, b.recording_id AS baseline_id,
       t.recording_id AS treatment_id, row_number() OVER (PARTITION BY b.study ORDER BY pair_no) AS k, count(*) OVER
       (PARTITION BY b.study) AS n FROM recs b JOIN recs t USING (pair_no) WHERE b.condition = 'baseline' AND t.condition = 'treatment')
       WHERE k = greatest(1, floor(n / 2.0 + 0.5))""")
def _(s, d):
    return store.default_pair(store.read_pairs(i.recordings(s, d)))


@query("U1_union_studies", "SELECT recording_id, study FROM recs WHERE study IN ('doi', 'ket')")
def _(s, d):
    r = i.recordings(s, d)
    return store.recordings_for(r, "doi").unionByName(store.recordings_for(r, "ket")).select("recording_id", "study")


_IDS = """ids AS (SELECT 'c' AS side, regexp_extract(c_name, '#(\\d+)$', 1)::BIGINT AS k FROM customer UNION ALL
    SELECT 's', regexp_extract(s_name, '#(\\d+)$', 1)::BIGINT FROM supplier)"""


def _ids(s, d):
    return (i.table(s, d, "customer").select(sc.require_pair_number(F.col("c_name")).alias("k")),
            i.table(s, d, "supplier").select(sc.require_pair_number(F.col("s_name")).alias("k")))


@query("U2_intersect_pair_ids", "SELECT k FROM ids WHERE side = 'c' INTERSECT SELECT k FROM ids WHERE side = 's'", extra=_IDS)
def _(s, d):
    c, p = _ids(s, d)
    return c.intersect(p)


@query("U3_unmatched_pair_ids", """SELECT 'no treatment' AS status, k FROM (SELECT k FROM ids WHERE side = 'c' EXCEPT ALL SELECT k FROM ids WHERE side = 's')
       UNION ALL SELECT 'no baseline', k FROM (SELECT k FROM ids WHERE side = 's' EXCEPT ALL SELECT k FROM ids WHERE side = 'c')""", extra=_IDS)
def _(s, d):
    c, p = _ids(s, d)
    return c.exceptAll(p).select(F.lit("no treatment").alias("status"), "k").unionByName(
        p.exceptAll(c).select(F.lit("no baseline").alias("status"), "k"))


@query("U4_channel_membership", """SELECT recording_id, channel, channel IN (SELECT channel FROM chans c WHERE c.recording_id = x.recording_id)
       AS used FROM (SELECT recording_id, channel FROM recs CROSS JOIN elec) x""", ints="channel")
def _(s, d):
    asked = i.recordings(s, d).select("recording_id", F.explode(F.array(*[F.lit(c) for c in ALL_CHANNELS])).alias("channel"))
    have = i.channels(s, d).select("recording_id", "channel", F.lit(True).alias("used"))
    return asked.join(have, ["recording_id", "channel"], "left").withColumn("used", F.coalesce("used", F.lit(False)))


@query("U5_pooled_values", "SELECT study, metric, y FROM pooled", "y")
def _(s, d):
    return ob.pooled(i.obs(s, d), K)


# --- scalars --------------------------------------------------------------------

@query("X1_pair_number", "SELECT c_name AS name, regexp_extract(c_name, '#(\\d+)$', 1)::BIGINT AS pair_no FROM customer")
def _(s, d):
    return i.table(s, d, "customer").select(F.col("c_name").alias("name"), sc.require_pair_number(F.col("c_name")).alias("pair_no"))


@query("X2_safe_name", "SELECT recording_id, replace(replace(recording_id, '-', '_'), '#', '_') AS safe FROM recs")
def _(s, d):
    return i.recordings(s, d).select("recording_id", sc.safe_name(F.col("recording_id")).alias("safe"))


@query("X3_p_text", """SELECT l_orderkey, l_linenumber, CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p_text
       FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN NULL ELSE l_discount / l_quantity END AS p FROM lineitem)""", ints="l_linenumber")
def _(s, d):
    p = F.when(F.col("l_quantity") == 50, None).otherwise(F.col("l_discount") / F.col("l_quantity"))
    return i.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", sc.p_text(p).alias("p_text"))


@query("X4_change_score", "SELECT study, metric, pair_no, channel, (t - b) / greatest(1, b) AS score FROM obs", "score")
def _(s, d):
    return i.obs(s, d).withColumn("score", sc.change_score(F.col("b"), F.col("t"))).drop("b", "t")


_DIST = """SELECT recording_id, i, j, label_i, label_j, dist FROM cpairs JOIN epairs USING (i, j)"""


@query("J8_electrode_distance", _DIST, "dist", ints="i j label_i label_j")
def _(s, d):
    return cn.with_distance(cn.channel_pairs(i.channels(s, d))).drop("duration_us")


@query("X5_euclidean", "SELECT recording_id, channel, sqrt(x::DOUBLE * x + y::DOUBLE * y) AS r FROM chans JOIN elec USING (channel)", "r")
def _(s, d):
    return i.channels(s, d).join(F.broadcast(el.electrodes(s)), "channel").select(
        "recording_id", "channel", sc.euclid(F.col("x"), F.col("y")).alias("r"))


@query("J6_channel_pairs", "SELECT recording_id, i, j FROM cpairs", ints="i j")
def _(s, d):
    return cn.channel_pairs(i.channels(s, d)).drop("duration_us")


# --- density --------------------------------------------------------------------

@query("K1_kernel_density", """SELECT study, metric, k, y, density, density / max(density) OVER (PARTITION BY study, metric) AS relative
       FROM (SELECT study, metric, k, y, sum(exp(-0.5 * ((pct - y) / h) ** 2)) / (max(n) * max(h) * sqrt(2 * pi())) AS density
       FROM pct JOIN bw USING (study, metric) CROSS JOIN (SELECT k, -100 + k * (600.0::DOUBLE / 179) AS y FROM
       (SELECT unnest(range(0, 180)) AS k)) GROUP BY study, metric, k, y)""", "y density relative",
       extra="""md AS (SELECT study, metric, count(*) AS n, median(pct) AS med FROM pct GROUP BY ALL),
       bw AS (SELECT study, metric, max(n) AS n, CASE WHEN median(abs(pct - med)) > 0 THEN median(abs(pct - med)) / 0.6745 ELSE 1 END
       * (4.0::DOUBLE / (3 * max(n))) ** 0.2 AS h FROM pct JOIN md USING (study, metric) GROUP BY study, metric)""")
def _(s, d):
    return kernel_density(i.pct(s, d), K, "pct", -100.0, 500.0, 180)
