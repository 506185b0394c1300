"""Queries: samples and signals, resampling, ranks, tests and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pointproc.catalog import inputs as i
from pointproc.catalog.base import query
from pointproc.functions import scalar as sc
from pointproc.functions.quantile import percentile_mid
from pointproc.functions.resample import draw_index, draw_word
from pointproc.operators import observations as ob
from pointproc.operators import signal as sg
from pointproc.operators import stats as st
from pointproc.operators.trains import drop_refractory
from pointproc.params import BurstParams, ObservationParams, Params, SpikeParams
from pointproc.plans import rates as pr
from pointproc.plans.preprocess import preprocess
from pointproc.session import cut_lineage
from pointproc.sources import testdata as td

K = ["study", "metric"]
ITERATIONS = 10_000
RAW_FS = 24414.0625


def erfc(x: str) -> str:
    """SQL of the complementary error function by its all-positive series."""
    term = "exp((2 * k + 1) * ln(greatest(x, 1e-300)) + 2 * k * ln(2) + lgamma(k + 1.0::DOUBLE) - lgamma(2 * k + 2.0::DOUBLE) - x * x)"
    term = term.replace("x,", f"{x},").replace("x * x", f"({x}) * ({x})")
    return f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 300), lambda k: {term})))"


# --- samples --------------------------------------------------------------------

@query("S17_sample_source", "SELECT channel, n, x FROM smp", "x", ints="channel n")
def _(s, d):
    return sg.explode_samples(i.samples(s, d)).select("channel", "n", "x")


@query("S17_duration", "SELECT channel, count(*) AS n_samples, count(*) / 64.0::DOUBLE AS duration_sec FROM smp GROUP BY ALL", "duration_sec", ints="channel")
def _(s, d):
    return sg.durations(i.samples(s, d)).drop("recording_id")


@query("X7_microvolts", "SELECT channel, n, x * 1e6 AS uv FROM smp", "uv", ints="channel n")
def _(s, d):
    return sg.explode_samples(i.samples(s, d)).select("channel", "n", sc.microvolts(F.col("x")).alias("uv"))


@query("F17_time_slice", "SELECT channel, n, x FROM smp WHERE n BETWEEN floor(100.3 * 64 + 0.5) AND floor(350.7 * 64 + 0.5) - 1", "x", ints="channel n")
def _(s, d):
    return sg.time_slice(i.samples(s, d), 100.3, 350.7).select("channel", "n", "x")


@query("W8_decimation", "SELECT channel, n, x FROM smp WHERE n % 16 = 0", "x", ints="channel n")
def _(s, d):
    return sg.every_kth(sg.explode_samples(i.samples(s, d)), 16).select("channel", "n", "x")


@query("W9_target_downsample", """SELECT channel, n, x FROM (SELECT channel, n, x, row_number() OVER (PARTITION BY channel ORDER BY n) - 1 AS pos,
       greatest(1, floor(count(*) OVER (PARTITION BY channel) / 500)) AS step FROM smp) WHERE pos % step = 0""", "x", ints="channel n")
def _(s, d):
    return sg.thin_to(sg.explode_samples(i.samples(s, d)), 500, 1 << 12).select("channel", "n", "x")


_SIDES = "sides AS (SELECT channel, CASE WHEN (n // 64) % 2 = 0 THEN 'b' ELSE 't' END AS side, x FROM smp)"


@query("A17_amplitude_scale", """SELECT channel, CASE WHEN greatest(max(peak), max(8 * noise)) <= 0 THEN 50 ELSE greatest(max(peak), max(8 * noise)) END AS scale,
       CASE WHEN max(peak) < 1 THEN 20 ELSE max(peak) END AS peak_scale FROM (SELECT channel, side, max(abs(x)) AS peak,
       median(abs(x - med)) / 0.6745 AS noise FROM sides JOIN (SELECT channel, side, median(x) AS med FROM sides GROUP BY ALL)
       USING (channel, side) GROUP BY channel, side) GROUP BY channel""", "scale peak_scale", ints="channel", extra=_SIDES)
def _(s, d):
    rows = sg.explode_samples(i.samples(s, d)).withColumn("half", F.floor(F.col("n") / 64) % 2)
    return sg.amplitude_scale(rows.filter("half = 0"), rows.filter("half = 1"), ["channel"])


_DET = """dt AS (SELECT channel, n, round(n * 1e6 / 64)::BIGINT AS t_us, x FROM smp),
    nz AS (SELECT channel, t_us // 5000000 AS win, median(abs(x)) / 0.6745 AS sigma FROM dt GROUP BY ALL),
    dl AS (SELECT channel, t_us, x, lag(x) OVER (PARTITION BY channel ORDER BY n) AS before FROM dt),
    det AS (SELECT channel, t_us, row_number() OVER (PARTITION BY channel ORDER BY t_us) AS idx FROM dl
    JOIN nz ON nz.channel = dl.channel AND nz.win = t_us // 5000000 WHERE x < -2 * sigma AND before >= -2 * sigma)"""
_DET = _DET.replace("SELECT channel, t_us, row_number() OVER (PARTITION BY channel", "SELECT dl.channel, t_us, row_number() OVER (PARTITION BY dl.channel")


@query("G4_noise_levels", "SELECT channel, win, sigma FROM nz", "sigma", ints="channel win", extra=_DET)
def _(s, d):
    return sg.noise_levels(sg.explode_samples(i.samples(s, d)), 5_000_000).drop("recording_id")


@query("G4_threshold_detection", """SELECT channel, t_us FROM keep WHERE t_us = last""", ints="channel t_us", recursive=True, extra=_DET + """,
       keep AS (SELECT channel, idx, t_us, t_us AS last FROM det WHERE idx = 1 UNION ALL SELECT q.channel, q.idx, q.t_us,
       CASE WHEN q.t_us - k.last >= 100000 THEN q.t_us ELSE k.last END FROM keep k JOIN det q ON q.channel = k.channel AND q.idx = k.idx + 1)""")
def _(s, d):
    found = sg.crossings(sg.detect_blocks(i.samples(s, d), SpikeParams(sd_factor=2.0))).withColumn("duration_us", F.lit(0).cast("bigint"))
    return drop_refractory(found, 100_000, 60_000_000).select("channel", "t_us")


@query("G3_filter_samples")
def _(s, d):
    return sg.filter_samples(i.samples(s, d, RAW_FS)).select("channel", "n", "x")


def _filter_response(s, d, notch: bool):
    """Response at the frequency of every sample's position in its chunk's spectrum."""
    p = Params().filter

    @F.pandas_udf("double")
    def gain(f: pd.Series) -> pd.Series:
        wide = sg.notch_gain if notch else sg.band_gain
        return pd.Series(wide(f.to_numpy(dtype=float), RAW_FS, p))

    freq = (F.col("n") % 4096 + 1) * F.lit(RAW_FS / 2 / 4097)
    rows = sg.explode_samples(i.samples(s, d, RAW_FS)).select("channel", "n", freq.alias("freq"))
    return rows.withColumn("gain", gain("freq"))


@query("G1_notch_response", """SELECT channel, n, freq, exp(list_sum(list_transform(range(1, 14), lambda k: ln(
       ((1 + cos(2 * w) - 2 * cos(2 * pi() * 60 * k / 24414.0625) * cos(w)) ** 2 + (sin(2 * w) - 2 * cos(2 * pi() * 60 * k / 24414.0625) * sin(w)) ** 2)
       / ((1 + sin(2 * pi() * 60 * k / 24414.0625) / 70 - 2 * cos(2 * pi() * 60 * k / 24414.0625) * cos(w) + (1 - sin(2 * pi() * 60 * k / 24414.0625) / 70) * cos(2 * w)) ** 2
       + (2 * cos(2 * pi() * 60 * k / 24414.0625) * sin(w) - (1 - sin(2 * pi() * 60 * k / 24414.0625) / 70) * sin(2 * w)) ** 2))))) AS gain
       FROM (SELECT channel, n, freq, 2 * pi() * freq / 24414.0625 AS w FROM (SELECT channel, n, (n % 4096 + 1) * (24414.0625::DOUBLE / 2 / 4097) AS freq FROM smp))""",
       "freq gain", ints="channel n")
def _(s, d):
    return _filter_response(s, d, True)


@query("G2_band_response", """SELECT channel, n, freq, 1 / (1 + ((w * w - lo * hi) / (w * (hi - lo))) ** 8) AS gain FROM (SELECT channel, n, freq,
       tan(pi() * freq / 24414.0625) AS w, tan(pi() * 300 / 24414.0625) AS lo, tan(pi() * 2500 / 24414.0625) AS hi
       FROM (SELECT channel, n, (n % 4096 + 1) * (24414.0625::DOUBLE / 2 / 4097) AS freq FROM smp))""", "freq gain", ints="channel n")
def _(s, d):
    return _filter_response(s, d, False)


@query("G5_preprocess", f"""SELECT c.recording_id, c.channel, coalesce(n_spikes, 0) AS n_spikes, coalesce(n_spikes, 0) * 6e7 / dur AS spike_rate,
       coalesce(n_bursts, 0) AS n_bursts, coalesce(n_bursts, 0) * 6e7 / dur AS burst_rate FROM (SELECT DISTINCT 'vectors-baseline_#1' AS recording_id, channel FROM dt) c
       CROSS JOIN (SELECT round(count(*) * 1e6 / 64)::BIGINT AS dur FROM dt WHERE channel = (SELECT min(channel) FROM dt))
       LEFT JOIN (SELECT channel, count(*) AS n_spikes FROM kp GROUP BY ALL) USING (channel)
       LEFT JOIN (SELECT channel, count(*) AS n_bursts FROM bs GROUP BY ALL) USING (channel)""", "spike_rate burst_rate", ints="channel", recursive=True,
       extra=_DET + """,
       keep AS (SELECT channel, idx, t_us, t_us AS last FROM det WHERE idx = 1 UNION ALL SELECT q.channel, q.idx, q.t_us,
       CASE WHEN q.t_us - k.last >= 100000 THEN q.t_us ELSE k.last END FROM keep k JOIN det q ON q.channel = k.channel AND q.idx = k.idx + 1),
       kp AS (SELECT channel, t_us, row_number() OVER w AS k, lag(t_us) OVER w AS prev, lead(t_us) OVER w AS next FROM keep WHERE t_us = last
       WINDOW w AS (PARTITION BY channel ORDER BY t_us)),
       ki AS (SELECT *, sum(CASE WHEN t_us - prev <= 30000000 THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY k) AS island FROM kp),
       bs AS (SELECT channel, island FROM ki GROUP BY ALL HAVING max(k) - min(k) FILTER (WHERE next - t_us <= 10000000) + 1 >= 3)""")
def _(s, d):
    p = Params(spike=SpikeParams(sd_factor=2.0, refractory_us=100_000), burst=BurstParams(10_000_000, 30_000_000, 3),
               block_us=60_000_000)
    return preprocess(i.samples(s, d), p, filtered=False).summary.drop("duration_us")


# --- resampling -----------------------------------------------------------------

@query("P1_hash_draws", """SELECT l_orderkey, l_linenumber, ('0x' || substr(md5('1|' || l_orderkey || '|0|' || l_linenumber), 1, 15))::BIGINT AS word,
       ('0x' || substr(md5('1|' || l_orderkey || '|0|' || l_linenumber), 1, 15))::BIGINT % 360 AS pick FROM lineitem""", ints="l_linenumber")
def _(s, d):
    parts = (F.lit(1), F.col("l_orderkey"), F.lit(0), F.col("l_linenumber"))
    return i.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", draw_word(*parts).alias("word"),
                                            draw_index(360, *parts).alias("pick"))


_SP = "CASE WHEN b <> 0 THEN 100 * (t - b) / b WHEN t > 0 THEN 1e6::DOUBLE END"


@query("P2_paired_medians", f"""SELECT study, metric, count(*) AS n, median(b) AS median_baseline, median(t) AS median_treatment, median(t - b) AS median_delta,
       median({_SP}) AS median_pct FROM obs GROUP BY ALL""", "median_baseline median_treatment median_delta median_pct")
def _(s, d):
    return st.paired_medians(i.obs(s, d), K)


_B1 = f"""ob AS (SELECT *, row_number() OVER (PARTITION BY study, metric ORDER BY pair_no, channel) AS idx,
    count(*) OVER (PARTITION BY study, metric) AS n FROM obs),
    dr AS (SELECT study, metric, it, ('0x' || substr(md5('1|' || it || '|0|' || slot), 1, 15))::BIGINT % n + 1 AS idx FROM
    (SELECT study, metric, n, unnest(range(0, n)) AS slot FROM (SELECT DISTINCT study, metric, n FROM ob))
    CROSS JOIN (SELECT unnest(range(0, {ITERATIONS})) AS it)),
    b1 AS (SELECT study, metric, it AS iteration, median(t - b) AS delta, median({_SP}) AS pct FROM dr JOIN ob USING (study, metric, idx) GROUP BY ALL)"""


@query("P3_bootstrap", "SELECT study, metric, iteration, delta, pct FROM b1", "delta pct", ints="iteration", extra=_B1)
def _(s, d):
    return st.bootstrap_one_level(pr.ordered(i.obs(s, d)), K, "ord", pr.ORDER_WIDTH, ITERATIONS, 1)


_B2 = f"""ob AS (SELECT *, row_number() OVER (PARTITION BY study, metric, pair_no ORDER BY channel) AS idx,
    count(*) OVER (PARTITION BY study, metric, pair_no) AS n, dense_rank() OVER (PARTITION BY study, metric ORDER BY pair_no) AS c FROM obs),
    cl AS (SELECT DISTINCT study, metric, c, n FROM ob), nc AS (SELECT study, metric, count(*) AS nc FROM cl GROUP BY ALL),
    dc AS (SELECT study, metric, it, cs, ('0x' || substr(md5('1|' || it || '|1|' || cs), 1, 15))::BIGINT % nc + 1 AS c FROM (SELECT *, unnest(range(0, nc)) AS cs FROM nc)
    CROSS JOIN (SELECT unnest(range(0, {ITERATIONS})) AS it)),
    dr AS (SELECT study, metric, it, c, ('0x' || substr(md5('1|' || it || '|2|' || cs || ',' || slot), 1, 15))::BIGINT % n + 1 AS idx
    FROM (SELECT *, unnest(range(0, n)) AS slot FROM dc JOIN cl USING (study, metric, c))),
    b2 AS (SELECT study, metric, it AS iteration, median(t - b) AS delta, median({_SP}) AS pct FROM dr JOIN ob USING (study, metric, c, idx) GROUP BY ALL)"""


@query("P4_bootstrap_two_level", "SELECT study, metric, iteration, delta, pct FROM b2", "delta pct", ints="iteration", extra=_B2)
def _(s, d):
    return st.bootstrap_two_level(pr.ordered(i.obs(s, d)), K, "pair_no", "ord", pr.ORDER_WIDTH, ITERATIONS, 1)


_CI = """SELECT study, metric, {pm:v:2.5} AS ci_lo, {pm:v:97.5} AS ci_hi, p FROM (SELECT study, metric, list_sort(list(delta)) AS v,
    least(1, 2 * least(avg((delta >= 0)::INT), avg((delta <= 0)::INT))) AS p FROM b1 GROUP BY ALL)"""


@query("P5_bootstrap_interval", _CI, "ci_lo ci_hi p", extra=_B1)
def _(s, d):
    reps = st.bootstrap_one_level(pr.ordered(i.obs(s, d)), K, "ord", pr.ORDER_WIDTH, ITERATIONS, 1)
    return st.interval_and_p(reps, K, "delta")


@query("X6_two_sided_tail", "SELECT study, metric, least(1, 2 * least(avg((delta >= 0)::INT), avg((delta <= 0)::INT))) AS p FROM b1 GROUP BY ALL", "p", extra=_B1)
def _(s, d):
    reps = st.bootstrap_one_level(pr.ordered(i.obs(s, d)), K, "ord", pr.ORDER_WIDTH, ITERATIONS, 1)
    return st.interval_and_p(reps, K, "delta").select("study", "metric", "p")


_P6 = f"""ob AS (SELECT study, metric, pair_no, pct, row_number() OVER (PARTITION BY study, metric, pair_no ORDER BY channel) AS idx,
    count(*) OVER (PARTITION BY study, metric, pair_no) AS n, dense_rank() OVER (PARTITION BY study, metric ORDER BY pair_no) AS c FROM pct),
    cl AS (SELECT DISTINCT study, metric, c, n FROM ob), nc AS (SELECT study, metric, count(*) AS nc FROM cl GROUP BY ALL),
    dc AS (SELECT study, metric, it, cs, ('0x' || substr(md5('1|' || it || '|1|' || cs), 1, 15))::BIGINT % nc + 1 AS c FROM (SELECT *, unnest(range(0, nc)) AS cs FROM nc)
    CROSS JOIN (SELECT unnest(range(0, {ITERATIONS})) AS it)),
    dr AS (SELECT study, metric, it, c, ('0x' || substr(md5('1|' || it || '|2|' || cs || ',' || slot), 1, 15))::BIGINT % n + 1 AS idx
    FROM (SELECT *, unnest(range(0, n)) AS slot FROM dc JOIN cl USING (study, metric, c))),
    b2 AS (SELECT study, metric, it, median(pct) AS m FROM dr JOIN ob USING (study, metric, c, idx) GROUP BY ALL),
    pv AS (SELECT study, metric, {{pm:v:2.5}} AS ci_lo, {{pm:v:97.5}} AS ci_hi, p FROM (SELECT study, metric, list_sort(list(m)) AS v,
    least(1, 2 * least(avg((m >= 0)::INT), avg((m <= 0)::INT))) AS p FROM b2 GROUP BY ALL)),
    ad AS (SELECT *, min(least(1, p * m / r)) OVER (PARTITION BY study ORDER BY r DESC) AS p_adj FROM (SELECT *, count(*) OVER (PARTITION BY study) AS m,
    row_number() OVER (PARTITION BY study ORDER BY p) AS r FROM pv))"""


@query("P6_study_bootstrap", """SELECT study, metric, n_channels, n_datasets, observed, ci_lo, ci_hi, p, p_adj, p_adj <= 0.05 AS rejected FROM ad JOIN (SELECT study, metric,
       count(*) AS n_channels, count(DISTINCT pair_no) AS n_datasets, median(pct) AS observed FROM pct GROUP BY ALL) USING (study, metric)""",
       "observed ci_lo ci_hi p p_adj", extra=_P6)
def _(s, d):
    o = i.obs(s, d)
    return pr.study_bootstrap(o.filter("metric = 'spike_rate'"), o.filter("metric = 'burst_rate'"), iterations=ITERATIONS)


# --- ranks and tests ------------------------------------------------------------

_WX = """wd AS (SELECT study, metric, t - b AS d FROM obs WHERE t <> b),
    wr AS (SELECT study, metric, d, rank() OVER (PARTITION BY study, metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY study, metric, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM wd),
    ws AS (SELECT study, metric, count(*) AS n_nonzero, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS wm FROM wr GROUP BY ALL)"""


@query("W6_tied_ranks", """SELECT DISTINCT l_shipmode_key, size, cnt, rk FROM (SELECT l_returnflag AS l_shipmode_key, l_extendedprice AS size,
       count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) AS cnt, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
       + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS rk FROM lineitem)""".replace("l_shipmode_key", "flag"), "size rk")
def _(s, d):
    li = i.table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("size"))
    return st.tied_ranks(li, ["flag"], "size").select("flag", "size", "cnt", F.col("rank").alias("rk"))


@query("P7_signed_rank_w", "SELECT study, metric, n_nonzero, wp AS w FROM ws", "w", extra=_WX)
def _(s, d):
    return st.signed_rank(i.obs(s, d), K).select("study", "metric", "n_nonzero", "w")


# all rank sums by recursion over the ranks
_EXACT = """rr AS (SELECT study, metric, row_number() OVER (PARTITION BY study, metric ORDER BY rk, d) AS k, (2 * rk)::BIGINT AS r2 FROM wr),
    dp AS (SELECT study, metric, 0::BIGINT AS k, 0::BIGINT AS s, 1.0::DOUBLE AS p FROM ws UNION ALL
    SELECT dp.study, dp.metric, rr.k, s + c * r2 AS s, sum(p) / 2 AS p FROM dp JOIN rr ON rr.study = dp.study AND rr.metric = dp.metric AND rr.k = dp.k + 1
    CROSS JOIN (SELECT unnest([0, 1]) AS c) GROUP BY dp.study, dp.metric, rr.k, s + c * r2),
    ex AS (SELECT study, metric, least(1, 2 * least(sum(p) FILTER (WHERE s <= 2 * wp), sum(p) FILTER (WHERE s >= 2 * wp))) AS p FROM dp JOIN ws USING (study, metric)
    WHERE k = n_nonzero GROUP BY study, metric)"""
_WP = _WX + ", " + _EXACT


@query("P7_signed_rank_p", """SELECT study, metric, n_nonzero, wp AS w, (wp - wm) / (wp + wm) AS r_rank_biserial, ex.p AS p_wilcoxon
       FROM ws JOIN ex USING (study, metric)""", "w r_rank_biserial p_wilcoxon", extra=_WP, recursive=True)
def _(s, d):
    return st.signed_rank(i.obs(s, d), K)


@query("P7_signed_rank_large", f"""SELECT flag, n_nonzero, wp AS w, (wp - wm) / (wp + wm) AS r,
       least(1, {erfc('z / sqrt(2)')}) AS p FROM (SELECT *, (n_nonzero * (n_nonzero + 1.0::DOUBLE) / 4 - least(wp, wm))
       / sqrt((n_nonzero * (n_nonzero + 1.0::DOUBLE) * (2 * n_nonzero + 1) - tie / 2) / 24) AS z FROM (SELECT flag, count(*) AS n_nonzero,
       sum(rk) FILTER (WHERE x > 0) AS wp, sum(rk) FILTER (WHERE x < 0) AS wm, sum(same * same - 1.0::DOUBLE) AS tie FROM (SELECT flag, x,
       count(*) OVER (PARTITION BY flag, abs(x)) AS same, rank() OVER (PARTITION BY flag ORDER BY abs(x)) + (count(*) OVER (PARTITION BY flag, abs(x)) - 1) / 2.0::DOUBLE AS rk
       FROM (SELECT l_returnflag AS flag, l_quantity - l_discount * 510 AS x FROM lineitem) WHERE x <> 0) GROUP BY ALL))""", "w r p")
def _(s, d):
    li = i.table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.lit(0.0).alias("b"),
                                          (F.col("l_quantity") - F.col("l_discount") * 510).alias("t"))
    return st.signed_rank(li, ["flag"], "approximate").select(
        "flag", "n_nonzero", "w", F.col("r_rank_biserial").alias("r"), F.col("p_wilcoxon").alias("p"))


@query("P8_rank_biserial", "SELECT study, metric, (wp - wm) / (wp + wm) AS r FROM ws", "r", extra=_WX)
def _(s, d):
    return st.signed_rank(i.obs(s, d), K).select("study", "metric", F.col("r_rank_biserial").alias("r"))


_HG = """hg AS (SELECT study, metric, CASE WHEN count(*) >= 2 AND stddev_samp(b) + stddev_samp(t) > 0 THEN (avg(t) - avg(b)) / ((stddev_samp(b) + stddev_samp(t)) / 2)
    * (1 - 3 / (4.0::DOUBLE * (count(*) - 1) - 1)) END AS hedges_g FROM obs GROUP BY ALL)"""


@query("P9_hedges_g_av", "SELECT study, metric, hedges_g FROM hg", "hedges_g", extra=_HG)
def _(s, d):
    return st.hedges_g_av(i.obs(s, d), K)


_FAM = """fam AS (SELECT l_returnflag AS family, l_suppkey, avg(l_discount) * avg(l_tax) * 100 / avg(l_quantity) AS p FROM lineitem GROUP BY ALL),
    fa AS (SELECT *, least(1, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC)) AS p_adj FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m,
    row_number() OVER (PARTITION BY family ORDER BY p) AS r FROM fam))"""


def _family(s, d):
    return i.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("family"), "l_suppkey").agg(
        (F.avg("l_discount") * F.avg("l_tax") * 100 / F.avg("l_quantity")).alias("p"))


@query("P10_bh_fdr", "SELECT family, l_suppkey, p, p_adj, p_adj <= 0.013 AS rejected FROM fa", "p p_adj", extra=_FAM)
def _(s, d):
    return st.bh_fdr(cut_lineage(_family(s, d)), ["family"], "p", 0.013)


@query("W7_step_up_minimum", "SELECT family, l_suppkey, p_adj FROM fa", "p_adj", extra=_FAM)
def _(s, d):
    return st.bh_fdr(cut_lineage(_family(s, d)), ["family"], "p").select("family", "l_suppkey", "p_adj")


_PERM = """pv AS (SELECT n_regionkey AS rk, n_nationkey, median(c_acctbal) AS y FROM customer JOIN nation ON n_nationkey = c_nationkey
    GROUP BY ALL), px AS (SELECT *, row_number() OVER (ORDER BY rk, n_nationkey) - 1 AS pos FROM pv),
    pn AS (SELECT count(*) AS n, count(*) FILTER (WHERE rk = 0) AS na FROM px),
    ids AS (SELECT id FROM (SELECT na, unnest(range(0, (1::BIGINT << n::BIGINT))) AS id FROM pn) WHERE bit_count(id::BIGINT) = na),
    sp AS (SELECT id, median(y) FILTER (WHERE (id >> pos) & 1 = 1) - median(y) FILTER (WHERE (id >> pos) & 1 = 0) AS s FROM ids, px GROUP BY id),
    so AS (SELECT median(y) FILTER (WHERE rk = 0) - median(y) FILTER (WHERE rk > 0) AS o FROM px)"""


@query("P11_permutation_test", """SELECT o AS observed, count(*) AS n_permutations, avg((s >= o)::INT) AS p_right, avg((s <= o)::INT) AS p_left,
       least(1, 2 * least(avg((s >= o)::INT), avg((s <= o)::INT))) AS p_value FROM sp, so GROUP BY o""", "observed p_right p_left p_value", extra=_PERM)
def _(s, d):
    # one value per nation, over all customers; one region against the others
    cust = i.table(s, d, "customer").join(F.broadcast(i.table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    values = percentile_mid(cust, ["n_regionkey", "n_nationkey"], "c_acctbal", {"y": 50})
    return st.permutation_test(s, values.select(F.when(F.col("n_regionkey") == 0, "a").otherwise("b").alias("grp"), "y"))


_CHI = """ch AS (SELECT study, metric, count(*) FILTER (WHERE b > 0 AND t <> 0 AND abs(t - b) > 1e-6 * b AND t > b) AS ni,
    count(*) FILTER (WHERE b > 0 AND t <> 0 AND abs(t - b) > 1e-6 * b AND t < b) AS nd FROM obs GROUP BY ALL)"""


@query("P12_chi2_even_split", """SELECT study, metric, ni AS n_increased, nd AS n_decreased, CASE WHEN ni + nd > 0 THEN (ni - nd) ** 2 / (ni + nd)::DOUBLE END AS chi2,
       CASE WHEN ni + nd > 0 THEN 100.0 * ni / (ni + nd) END AS pct_increase FROM ch""", "chi2 pct_increase", extra=_CHI)
def _(s, d):
    return st.chi2_even(ob.category_counts(i.obs(s, d), K)).select("study", "metric", "n_increased", "n_decreased", "chi2", "pct_increase")


@query("P12_chi2_p", f"""SELECT study, metric, chi2, {erfc('sqrt(chi2 / 2)')} AS p FROM (SELECT study, metric, CASE WHEN ni + nd > 0
       THEN (ni - nd) ** 2 / (ni + nd)::DOUBLE END AS chi2 FROM ch)""", "chi2 p", extra=_CHI)
def _(s, d):
    return st.chi2_even(ob.category_counts(i.obs(s, d), K)).select("study", "metric", "chi2", "p")


def _ci(reps: str, value: str, prefix: str) -> str:
    """SQL of the interval and tail p of replicate values."""
    return (f"SELECT study, metric, {{pm:v:2.5}} AS {prefix}ci_lo, {{pm:v:97.5}} AS {prefix}ci_hi, {prefix}p FROM (SELECT study, metric, list_sort(list({value})) AS v, "
            f"least(1, 2 * least(avg(({value} >= 0)::INT), avg(({value} <= 0)::INT))) AS {prefix}p FROM {reps} GROUP BY ALL)")


@query("P13_paired_stats", f"""SELECT study, metric, n, median_baseline, median_treatment, median_delta, median_pct, n_datasets, ci_lo, ci_hi, p, pct_ci_lo, pct_ci_hi, pct_p,
       n_nonzero, wp AS w, (wp - wm) / (wp + wm) AS r_rank_biserial, ex.p_exact AS p_wilcoxon,
       hedges_g, {ITERATIONS}::BIGINT AS n_iterations FROM (SELECT study, metric, count(*) AS n, median(b) AS median_baseline, median(t) AS median_treatment,
       median(t - b) AS median_delta, median({_SP}) AS median_pct, count(DISTINCT pair_no) AS n_datasets FROM obs GROUP BY ALL)
       JOIN ({_ci('b2', 'delta', '')}) USING (study, metric) JOIN ({_ci('b2', 'pct', 'pct_')}) USING (study, metric) JOIN ws USING (study, metric)
       JOIN (SELECT study, metric, p AS p_exact FROM ex) ex USING (study, metric) JOIN hg USING (study, metric)""",
       "median_baseline median_treatment median_delta median_pct ci_lo ci_hi p pct_ci_lo pct_ci_hi pct_p w r_rank_biserial p_wilcoxon hedges_g",
       extra=_B2 + ", " + _WP + ", " + _HG, recursive=True)
def _(s, d):
    return st.paired_stats(pr.ordered(i.obs(s, d)), K, "ord", pr.ORDER_WIDTH, ITERATIONS, 1, cluster="pair_no")


_EFF = _B1 + ", " + _HG + """, fo AS (SELECT study, metric, hedges_g, median_delta, sd_pooled, ci_lo, ci_hi, CASE WHEN abs(hedges_g) > 0.001 AND abs(median_delta) > 2.220446049250313e-16
    THEN abs(median_delta) / abs(hedges_g) WHEN sd_pooled < 2.220446049250313e-16 THEN 1 ELSE sd_pooled END AS sd_star FROM hg
    JOIN (SELECT study, metric, median(t - b) AS median_delta FROM obs GROUP BY ALL) USING (study, metric)
    JOIN (SELECT study, metric, stddev_samp(y) AS sd_pooled FROM pooled GROUP BY ALL) USING (study, metric)
    JOIN (""" + _CI + """) USING (study, metric))"""


@query("P15_effect_interval", "SELECT study, metric, sd_star, ci_lo / sd_star AS ci_lo_g, ci_hi / sd_star AS ci_hi_g FROM fo", "sd_star ci_lo_g ci_hi_g", extra=_EFF)
def _(s, d):
    o = i.obs(s, d)
    reps = st.bootstrap_one_level(pr.ordered(o), K, "ord", pr.ORDER_WIDTH, ITERATIONS, 1)
    rows = (st.interval_and_p(reps, K, "delta").join(st.hedges_g_av(o, K), K)
            .join(st.paired_medians(o, K).select(*K, "median_delta"), K)
            .join(ob.pooled(o, K).groupBy(*K).agg(F.stddev_samp("y").alias("sd_pooled")), K))
    return st.effect_interval(rows).select("study", "metric", "sd_star", "ci_lo_g", "ci_hi_g")


_RR = (_B1.replace("FROM obs)", "FROM obs WHERE b >= 1)") + ", " + _WX.replace("FROM obs WHERE t <> b", "FROM obs WHERE b >= 1 AND t <> b")
       + ", " + _EXACT + ", " + _HG.replace("FROM obs GROUP", "FROM obs WHERE b >= 1 GROUP"))


@query("P17_rate_report", f"""SELECT study, metric, n, pct_increased, pct_decreased, median_baseline, median_treatment, median_delta, median_pct, ci_lo, ci_hi, p,
       pct_ci_lo, pct_ci_hi, pct_p, w, r_rank_biserial, p_wilcoxon, hedges_g FROM (SELECT study, metric, count(*) AS n, 100.0 * count(*) FILTER (WHERE t > b) / count(*) AS pct_increased,
       100.0 * count(*) FILTER (WHERE t < b) / count(*) AS pct_decreased, median(b) AS median_baseline, median(t) AS median_treatment, median(t - b) AS median_delta,
       median({_SP}) AS median_pct FROM obs WHERE b >= 1 GROUP BY ALL) JOIN ({_CI}) USING (study, metric)
       JOIN (SELECT study, metric, {{pm:v:2.5}} AS pct_ci_lo, {{pm:v:97.5}} AS pct_ci_hi, p AS pct_p FROM (SELECT study, metric, list_sort(list(pct)) AS v,
       least(1, 2 * least(avg((pct >= 0)::INT), avg((pct <= 0)::INT))) AS p FROM b1 GROUP BY ALL)) USING (study, metric)
       JOIN (SELECT study, metric, wp AS w, (wp - wm) / (wp + wm) AS r_rank_biserial, ex.p AS p_wilcoxon FROM ws JOIN ex USING (study, metric)) USING (study, metric)
       JOIN hg USING (study, metric)""",
       "pct_increased pct_decreased median_baseline median_treatment median_delta median_pct ci_lo ci_hi p pct_ci_lo pct_ci_hi pct_p w r_rank_biserial p_wilcoxon hedges_g",
       extra=_RR, recursive=True)
def _(s, d):
    spikes_only = i.obs(s, d).filter("metric = 'spike_rate'")
    report = pr.rate_report(spikes_only, td.MIN_RATE, iterations=ITERATIONS)
    return report.drop("n_datasets", "n_nonzero", "n_iterations")


@query("P17_rate_report_both")
def _(s, d):
    p = Params(observation=ObservationParams(silent_mode="both_zero", outlier_mode="tukey"))
    return pr.rate_report(i.obs(s, d), 0.0, p, iterations=ITERATIONS)
