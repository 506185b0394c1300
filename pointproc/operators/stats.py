"""Paired statistics per endpoint (the ``keys``), over observations ``b`` and ``t``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointproc.functions.quantile import array_median, cumulative, percentile_mid, small_percentile
from pointproc.functions.ranksum import two_sided
from pointproc.functions.resample import draw_index
from pointproc.functions.scalar import safe_pct
from pointproc.operators import bootstrap
from pointproc.operators.bootstrap import resampled
from pointproc.operators.ordered import with_neighbours
from pointproc.session import cut_lineage, wide

SLOT_CHUNK = 10_000
#: Splits of a permutation test under one row before they are numbered.
SPLITS = 4096


# --- summaries ------------------------------------------------------------------

def complete(obs: DataFrame) -> DataFrame:
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in ("b", "t")]
    return obs.filter(ok[0] & ok[1])


def paired_medians(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n and the medians of b, t, t - b and the percent change, per endpoint."""
    keys = list(keys)
    rows = complete(obs)
    b, t = F.col("b").cast("double"), F.col("t").cast("double")
    long = rows.select(*keys, F.explode(F.array(
        F.struct(F.lit("b").alias("what"), b.alias("y")), F.struct(F.lit("t").alias("what"), t.alias("y")),
        F.struct(F.lit("d").alias("what"), (t - b).alias("y")),
        F.struct(F.lit("p").alias("what"), safe_pct(b, t).alias("y")))).alias("x")).select(*keys, "x.*")
    m = percentile_mid(long, [*keys, "what"], "y", {"m": 50})

    def pick(what: str, name: str, col: str = "m") -> Column:
        return F.max(F.when(F.col("what") == what, F.col(col))).alias(name)

    return m.groupBy(*keys).agg(
        pick("b", "n", "n"), pick("b", "median_baseline"), pick("t", "median_treatment"),
        pick("d", "median_delta"), pick("p", "median_pct"))


def hedges_g_av(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean difference over the average sd, with the small-sample correction."""
    agg = complete(obs).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("t") - F.avg("b")).alias("diff"),
        ((F.stddev_samp("b") + F.stddev_samp("t")) / 2).alias("sd"))
    corr = 1 - 3 / (4 * (F.col("n") - 1) - 1)
    g = F.when((F.col("n") >= 2) & (F.col("sd") > 0), F.col("diff") / F.col("sd") * corr)
    return agg.select(*keys, g.alias("hedges_g"))


def effect_interval(rows: DataFrame) -> DataFrame:
    """Bootstrap interval of the delta in effect-size units (forest plot)."""
    g, d = F.abs("hedges_g"), F.abs("median_delta")
    sd = F.when((g > 0.001) & (d > 2.0**-52), d / g).when(F.col("sd_pooled") < 2.0**-52, 1.0).otherwise(
        F.col("sd_pooled"))
    return rows.withColumn("sd_star", sd).withColumn("ci_lo_g", F.col("ci_lo") / F.col("sd_star")).withColumn(
        "ci_hi_g", F.col("ci_hi") / F.col("sd_star"))


# --- ranks ----------------------------------------------------------------------

def tied_ranks(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Average rank of every distinct value: keys, value, cnt, rank, total."""
    c = cumulative(df, keys, value, sums)
    return c.withColumn("rank", F.col("below") + (F.col("cnt") + 1) / 2.0)


def signed_rank(obs: DataFrame, keys: Sequence[str], method: str = "exact") -> DataFrame:
    """W (rank sum of increases), rank-biserial r and the two-sided p per endpoint.

    Zero differences are dropped; where nothing else remains W is 0, p is 1 and r is
    missing. Endpoints without a complete pair have missing results. Ranks come per
    distinct |difference|. The p-value is the caller's choice: "exact" holds the
    distinct ranks of an endpoint in a row and takes memory in proportion to them
    (`functions/ranksum.py`); "approximate" is the tie-corrected normal tail, for
    endpoints of any size.
    """
    if method not in ("exact", "approximate"):
        raise ValueError("method must be exact or approximate")
    keys = list(keys)
    pairs = complete(obs).select(*keys, (F.col("t") - F.col("b")).alias("d"))
    d = pairs.filter("d != 0").select(
        *keys, F.abs("d").alias("size"), F.when(F.col("d") > 0, 1).otherwise(0).alias("up"))
    r = tied_ranks(d, keys, "size", {"up": F.col("up")})
    cnt, rank, total = F.col("cnt"), F.col("rank"), F.col("total")
    ranks = F.collect_list(F.struct((rank * 2).cast("bigint").alias("r2"), cnt.alias("cnt")))
    agg = r.groupBy(*keys).agg(
        F.max(total).alias("n_nonzero"), F.sum(rank * F.col("up")).alias("w_plus"),
        F.sum(rank * (cnt - F.col("up"))).alias("w_minus"),
        F.sum(_cube(cnt) - cnt).alias("ties"),
        (ranks if method == "exact" else F.expr("array()")).alias("ranks"))
    w_p, w_m, n = F.col("w_plus"), F.col("w_minus"), F.col("n_nonzero")
    if method == "exact":
        p = _exact_p(F.transform("ranks", lambda x: x["r2"]), F.transform("ranks", lambda x: x["cnt"]), w_p)
    else:
        m = n.cast("double")
        var = (m * (m + 1) * (2 * m + 1) - F.col("ties") / 2) / 24
        p = F.least(_normal_tails((m * (m + 1) / 4 - F.least(w_p, w_m)) / F.sqrt(var)), F.lit(1.0))
    scored = agg.select(*keys, n, w_p.alias("w"), F.when(w_p + w_m > 0, (w_p - w_m) / (w_p + w_m)).alias("r_rank_biserial"),
                        p.alias("p_wilcoxon"))
    sizes = _endpoints(obs, keys).join(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "left")
    flat = F.col("_n").isNotNull() & F.col("n_nonzero").isNull()
    return sizes.join(scored, keys, "left").select(
        *keys, F.when(flat, 0).otherwise(F.col("n_nonzero")).alias("n_nonzero"), F.when(flat, 0.0).otherwise(F.col("w")).alias("w"),
        "r_rank_biserial", F.when(flat, 1.0).otherwise(F.col("p_wilcoxon")).alias("p_wilcoxon"))


def _cube(n: Column) -> Column:
    """The cube of a count as a double: as BIGINT it ends at 2,097,151."""
    return n.cast("double") * n * n


def _endpoints(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every endpoint there is an observation of, complete or not."""
    return obs.select(*keys).distinct()


@F.pandas_udf(T.DoubleType())
def _exact_p(r2: pd.Series, cnt: pd.Series, w: pd.Series) -> pd.Series:
    """Tail of the rank-subset sums, one row per endpoint."""
    return pd.Series([two_sided(ranks, counts, int(round(2 * wp))) for ranks, counts, wp in zip(r2, cnt, w)])


@F.pandas_udf(T.DoubleType())
def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(v / math.sqrt(2)))


def bh_fdr(df: DataFrame, family: Sequence[str], p: str, q: float = 0.05) -> DataFrame:
    """Add ``p_adj`` and ``rejected``: step-up adjustment within each family.

    Equal p-values share the highest of their ranks. The running minimum from the
    largest p down is taken within and then across the value buckets, so a family of
    any size stays distributed.
    """
    family = list(family)
    # a missing p is never rejected but does count towards the family size
    if family:
        sized = cumulative(df, family, p).drop("total").join(
            df.groupBy(*family).agg(F.count(F.lit(1)).alias("total")), family)
    else:
        sized = cumulative(df.withColumn(p, F.col(p).cast("double")), family, p).withColumn(
            "total", F.lit(df.count()))
    c = sized.withColumn("raw", F.col(p) * F.col("total") / (F.col("below") + F.col("cnt")))
    # ranks fall into equal blocks, whose minima are few
    c = c.withColumn("_block", F.floor(F.col("below") / 65536))
    inner = Window.partitionBy(*family, "_block").orderBy(F.desc(p))
    mins = c.groupBy(*family, "_block").agg(F.min("raw").alias("_min"))
    across = (Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))).orderBy(
        F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    mins = mins.select(*family, "_block", F.min("_min").over(across).alias("_above"))
    adj = c.withColumn("_in", F.min("raw").over(inner)).join(mins, [*family, "_block"]).select(
        *family, F.col(p).alias("_p"), F.least("_in", "_above", F.lit(1.0)).alias("p_adj"))
    keyed = df.withColumn("_p", F.col(p).cast("double") + F.lit(0.0))
    known = F.col("_p").isNotNull() & ~F.isnan("_p")
    # rows without a p-value find nothing: they do not share a join key
    found = keyed.filter(known).join(adj, [*family, "_p"]).unionByName(
        keyed.filter(~F.coalesce(known, F.lit(False))).withColumn("p_adj", F.lit(None).cast("double")))
    return found.select(*df.columns, "p_adj").withColumn("rejected", F.coalesce(F.col("p_adj") <= q, F.lit(False)))


# --- bootstrap ------------------------------------------------------------------

def bootstrap_one_level(obs: DataFrame, keys: Sequence[str], order: str, width: int, iterations: int,
                        seed: int) -> DataFrame:
    """Replicate medians: keys, iteration, delta, pct.

    Observations are numbered per endpoint; each replicate draws its indices by hash,
    so draws are made where they are used and are the same after a task is retried.
    """
    keys, rows = list(keys), complete(obs)
    small, total, large = _by_size(rows, keys)
    inside = resampled(small, keys, None, order, iterations, seed, total)
    return inside if large is None else inside.unionByName(_joined_one_level(large, keys, order, width, iterations, seed))


def bootstrap_two_level(obs: DataFrame, keys: Sequence[str], cluster: str, order: str, width: int,
                        iterations: int, seed: int) -> DataFrame:
    """Replicate medians after drawing clusters, then observations inside each."""
    keys, rows = list(keys), complete(obs)
    small, total, large = _by_size(rows, keys)
    inside = resampled(small, keys, cluster, order, iterations, seed, total)
    return inside if large is None else inside.unionByName(_joined_two_level(large, keys, cluster, order, width, iterations, seed))


def _by_size(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int, DataFrame | None]:
    """Observations of endpoints that fit a task, how many they are, and those of the others if there are any."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fits = F.col("_n") <= bootstrap.MOST
    total, most = sizes.agg(F.sum(F.when(fits, F.col("_n"))), F.max("_n")).first()
    if (most or 0) <= bootstrap.MOST:
        return rows, total or 0, None
    sized = rows.join(sizes, keys)
    return sized.filter(fits).drop("_n"), total or 0, sized.filter(~fits).drop("_n")


def _joined_one_level(obs: DataFrame, keys: list[str], order: str, width: int, iterations: int, seed: int) -> DataFrame:
    """The same draws joined with the observations, for endpoints of any size."""
    rows = with_neighbours(obs, keys, order, width).select(*keys, "idx", "b", "t")
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.max("idx").alias("n")))
    slots = _slots(sizes.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))), "n")
    draws = slots.withColumn("idx", draw_index(F.col("n"), F.lit(seed), F.col("iteration"), F.lit(0), F.col("slot")) + 1)
    return _replicates(draws.join(rows, [*keys, "idx"]), keys)


def _joined_two_level(obs: DataFrame, keys: list[str], cluster: str, order: str, width: int,
                      iterations: int, seed: int) -> DataFrame:
    rows = with_neighbours(obs, [*keys, cluster], order, width).select(
        *keys, cluster, "idx", "b", "t")
    sizes = cut_lineage(rows.groupBy(*keys, cluster).agg(F.max("idx").alias("n")))
    ranked = with_neighbours(sizes, keys, cluster, 1 << 16).select(*keys, cluster, "n", F.col("idx").alias("c_idx"))
    totals = ranked.groupBy(*keys).agg(F.max("c_idx").alias("n_c"))
    first = _slots(totals.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))), "n_c")
    picked = first.withColumnRenamed("slot", "c_slot").withColumn("c_idx", draw_index(
        F.col("n_c"), F.lit(seed), F.col("iteration"), F.lit(1), F.col("c_slot")) + 1).join(ranked, [*keys, "c_idx"])
    draws = _slots(picked, "n").withColumn("idx", draw_index(
        F.col("n"), F.lit(seed), F.col("iteration"), F.lit(2), F.concat_ws(",", "c_slot", "slot")) + 1)
    return _replicates(draws.join(rows, [*keys, cluster, "idx"]), keys)


def _slots(df: DataFrame, n: str) -> DataFrame:
    """One row per draw slot 0..n-1, made in chunks so no row holds a long array."""
    size = F.col(n)
    chunked = df.withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((size - 1) / SLOT_CHUNK))))
    chunked = wide(chunked, *chunked.columns)
    first = F.col("_chunk") * SLOT_CHUNK
    last = F.least(first + SLOT_CHUNK, size) - 1
    return chunked.withColumn("slot", F.explode(F.sequence(first, last))).drop("_chunk")


def _replicates(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Medians per replicate."""
    b, t = F.col("b"), F.col("t")
    return drawn.groupBy(*keys, "iteration").agg(F.median(t - b).alias("delta"), F.median(safe_pct(b, t)).alias("pct"))


def interval_and_p(reps: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """95 % interval and two-sided tail p of replicate values; columns of a second value carry its name in front.

    A group holds one value per bootstrap iteration, a number the caller sets.
    """
    columns = []
    for k, value in enumerate(values):
        v, prefix = F.col(value), f"{value}_" if k else ""
        tail = F.least(F.avg(F.when(v >= 0, 1.0).when(v < 0, 0.0)), F.avg(F.when(v <= 0, 1.0).when(v > 0, 0.0)))
        columns += [small_percentile(v, 2.5).alias(f"{prefix}ci_lo"), small_percentile(v, 97.5).alias(f"{prefix}ci_hi"),
                    F.when(F.count(v) > 0, F.least(2 * tail, F.lit(1.0))).alias(f"{prefix}p")]
    return reps.groupBy(*keys).agg(*columns)


# --- exact permutation test -----------------------------------------------------

def median_difference(a: Column, b: Column) -> Column:
    return array_median(a) - array_median(b)


def _combination(number: Column, n: int, k: int) -> Column:
    """The members, ascending, of the k-of-n combination with this number in lexicographic order.

    Place by place: of the combinations that are left, C(n - 1 - place, missing - 1) hold the place.
    """
    table = F.array(*[F.lit(math.comb(rest, r)).cast("bigint") for rest in range(n) for r in range(k)])
    start = F.struct(number.cast("bigint").alias("left"), F.lit(k).alias("missing"), F.expr("CAST(array() AS ARRAY<INT>)").alias("members"))

    def step(s: Column, place: Column) -> Column:
        holding = F.when(s["missing"] > 0, F.get(table, (F.lit(n - 1) - place) * k + s["missing"] - 1)).otherwise(F.lit(0).cast("bigint"))
        inside = s["left"] < holding
        return F.struct(F.when(inside, s["left"]).otherwise(s["left"] - holding).alias("left"),
                        (s["missing"] - inside.cast("int")).alias("missing"),
                        F.when(inside, F.concat(s["members"], F.array(place))).otherwise(s["members"]).alias("members"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)["members"]


def permutation_test(spark: SparkSession, values: DataFrame, statistic: Callable[[Column, Column], Column] = median_difference,
                     tails: str = "two") -> DataFrame:
    """Exact two-sample test over every split of the pooled values.

    ``values`` has ``grp`` ('a' or 'b') and ``y``, a handful of rows: the number of
    splits, C(n, n_a), is what limits the sample. A split is made from its number, so
    tasks take equal ranges of numbers; ``statistic`` maps two array columns to one.
    """
    if tails not in ("two", "right", "left"):
        raise ValueError("tails must be two, right or left")
    good = values.filter(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double"))).select(
        "grp", F.col("y").cast("double").alias("y"))
    counts = {r["grp"]: r["n"] for r in good.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_a, n_b = counts.get("a", 0), counts.get("b", 0)
    if n_a < 1 or n_b < 1:
        raise ValueError("each group needs at least one value")
    n = n_a + n_b
    sample = good.agg(F.array_sort(F.collect_list(F.when(F.col("grp") == "a", F.col("y")))).alias("a"),
                      F.array_sort(F.collect_list(F.when(F.col("grp") == "b", F.col("y")))).alias("b"))
    sample = sample.withColumn("observed", statistic(F.col("a"), F.col("b"))).withColumn("pooled", F.concat("a", "b"))
    # the smaller group is enumerated by number; the other is its complement
    k = min(n_a, n_b)
    total = math.comb(n, k)
    if total >= 1 << 62:
        raise ValueError(f"{total} splits cannot be enumerated")
    # the one row becomes one per range of numbers, and a range its numbers
    ranges = wide(sample.withColumn("_range", F.explode(F.sequence(F.lit(0), F.lit((total - 1) // SPLITS).cast("bigint")))), "_range")
    number = F.explode(F.sequence(F.col("_range") * SPLITS, F.least(F.col("_range") * SPLITS + SPLITS, F.lit(total)) - 1))
    picks = ranges.withColumn("_number", number).withColumn("member", _combination(F.col("_number"), n, k))
    positions = F.sequence(F.lit(0), F.lit(n - 1))

    def values_at(inside: bool) -> Column:
        kept = F.filter(positions, lambda p: F.array_contains("member", p) == F.lit(inside))
        return F.transform(kept, lambda p: F.get("pooled", p))

    stat = statistic(values_at(n_a <= n_b), values_at(n_a > n_b))
    scored = picks.select("observed", stat.alias("stat"))
    right, left = F.avg(F.when(F.col("stat") >= F.col("observed"), 1.0).otherwise(0.0)), F.avg(
        F.when(F.col("stat") <= F.col("observed"), 1.0).otherwise(0.0))
    out = scored.agg(F.max("observed").alias("observed"), F.count(F.lit(1)).alias("n_permutations"),
                     right.alias("p_right"), left.alias("p_left"))
    p = {"two": F.least(2 * F.least("p_right", "p_left"), F.lit(1.0)), "right": F.col("p_right"),
         "left": F.col("p_left")}[tails]
    return out.withColumn("p_value", p)


# --- counts ---------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def _chi2_tail_df1(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v else None)


def chi2_even(counts: DataFrame) -> DataFrame:
    """Increased against decreased counts versus an even split (one row per group)."""
    i, d = F.col("n_increased"), F.col("n_decreased")
    n = i + d
    half = n / 2.0
    stat = F.when(n > 0, (i - half) * (i - half) / half + (d - half) * (d - half) / half)
    return counts.withColumn("chi2", stat).withColumn("df", F.lit(1)).withColumn(
        "pct_increase", F.when(n > 0, 100.0 * i / n)).withColumn(
        "pct_decrease", F.when(n > 0, 100.0 * d / n)).withColumn("p", _chi2_tail_df1("chi2"))


# --- roll-up --------------------------------------------------------------------

def paired_stats(obs: DataFrame, keys: Sequence[str], order: str, width: int, iterations: int = 10_000,
                 seed: int = 1, cluster: str | None = None, method: str = "exact") -> DataFrame:
    """Everything above for each endpoint, one row each, also where no pair is complete.

    With ``cluster`` the bootstrap draws clusters first; ``order`` and ``width`` give
    the BIGINT column the observations are numbered by and its block length.
    """
    keys = list(keys)
    obs = cut_lineage(obs.select(*keys, *([cluster] if cluster else []), order, "b", "t"))  # read by each part
    if cluster is None:
        reps = bootstrap_one_level(obs, keys, order, width, iterations, seed)
    else:
        reps = bootstrap_two_level(obs, keys, cluster, order, width, iterations, seed)
    boot = interval_and_p(reps, keys, "delta", "pct")
    n_sets = (complete(obs).groupBy(*keys).agg(F.countDistinct(cluster).alias("n_datasets")) if cluster else
              complete(obs).groupBy(*keys).agg(F.lit(None).cast("bigint").alias("n_datasets")))
    out = _endpoints(obs, keys)
    for part in (paired_medians(obs, keys), n_sets, boot, signed_rank(obs, keys, method), hedges_g_av(obs, keys)):
        out = out.join(part, keys, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))).withColumn("n_iterations", F.lit(iterations))
