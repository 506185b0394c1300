"""Mixing sources to target weights by nested hash thresholds.

Every document draws a 60-bit number from its id. A source takes its documents in
the order of that number until its budget is met, which a threshold expresses: the
words of a source are summed by hash bucket, the running sums show the bucket in
which the budget ends, and only that bucket's rows are summed again by finer
buckets. Nothing is sorted but the few rows left in the last bucket, and the rows
are then filtered by comparing their number with their source's threshold.

Rows without text have size 0. Rows with equal ids draw alike and are taken
together. A missing source is a source of its own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointproc.llm.common import WORD, draw
from pointproc.session import discard, store

WEIGHTS = (5, 2, 1)
#: A source takes no more than so many times its own words.
MOST = 3
BITS, LEVEL_BITS, LEVELS = 60, 10, 3


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the row's draw."""
    return docs.select("doc_id", "source",
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       draw("doc_id").alias("h"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of all words by repeating weights, capped and reshared.

    Capping at `most` times the source's words and resharing until none is above has
    the closed form min(cap, weight * level): sources in the order of cap / weight,
    the level is taken at the first one that stays below. One row per source enters
    the window, so its length is the number of sources, which a mix names one by one.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.select(
        "*", F.row_number().over(order).alias("i"),
        (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("rest"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest_w"))
    level = F.col("rest") / F.col("rest_w")
    first = F.min(F.when(level * F.col("w") <= F.col("cap"), F.struct("i", level.alias("level")))).over(everything)
    return per.withColumn("first", first).select(
        "source", "source_size",
        F.when((F.col("i") < F.col("first.i")) | F.col("first").isNull(), F.col("cap"))
        .otherwise(F.col("w") * F.col("first.level")).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame, most: int = MOST, level_bits: int = LEVEL_BITS,
               levels: int = LEVELS) -> DataFrame:
    """source, source_size, target, full (times that each document is taken whole), cut (draws below it once more).

    A document whose draw lies at the boundary is taken if the sum comes nearer to
    the budget with it.
    """
    full = F.when(F.col("source_size") > 0,
                  F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    state = targets.withColumn("full", full.cast("long")).withColumn(
        "need", F.col("target") - F.col("full") * F.col("source_size")).select(
        "*", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("base"), F.lit(True).alias("open"))
    kept = []
    for level in range(1, levels + 1):
        state = store(state)
        kept.append(state)
        width = 1 << (BITS - level_bits * level)
        inside = rows.alias("r").join(state.alias("s"), (F.col("r.source").eqNullSafe(F.col("s.source")))
                                      & F.col("s.open") & (F.col("r.h") >= F.col("s.low"))
                                      & (F.col("r.h") < F.col("s.low") + width * (1 << level_bits)))
        hist = inside.groupBy(F.col("s.source").alias("source"), F.shiftright("r.h", BITS - level_bits * level).alias("bucket")) \
            .agg(F.sum("r.size").alias("n"), F.first("s.need").alias("need"), F.first("s.base").alias("base"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("end", F.col("base") + F.sum("n").over(run))
        edge = hist.where(F.col("end") > F.col("need")).groupBy(F.col("source").alias("edge_source")).agg(
            F.min(F.struct("bucket", (F.col("end") - F.col("n")).alias("start"))).alias("at"))
        joined = state.join(edge, state["source"].eqNullSafe(edge["edge_source"]), "left")
        state = joined.select(
            "source", "source_size", "target", "full", "need",
            F.when(F.col("at").isNotNull(), F.col("at.bucket") * width).otherwise(F.col("low")).alias("low"),
            F.when(F.col("at").isNotNull(), F.col("at.start")).otherwise(F.col("base")).alias("base"),
            (F.col("open") & F.col("at").isNotNull()).alias("open"))
    state = store(state)
    kept.append(state)
    last = 1 << (BITS - level_bits * levels)
    inside = rows.alias("r").join(state.alias("s"), (F.col("r.source").eqNullSafe(F.col("s.source"))) & F.col("s.open")
                                  & (F.col("r.h") >= F.col("s.low")) & (F.col("r.h") < F.col("s.low") + last))
    ties = inside.groupBy(F.col("s.source").alias("source"), F.col("r.h").alias("h")).agg(
        F.sum("r.size").alias("n"), F.first("s.need").alias("need"), F.first("s.base").alias("base"))
    end = F.col("base") + F.sum("n").over(Window.partitionBy("source").orderBy("h"))
    cut = ties.withColumn("end", end).where(2 * F.col("end") - F.col("n") <= 2 * F.col("need")) \
        .groupBy(F.col("source").alias("cut_source")).agg((F.max("h") + 1).alias("at"))
    out = state.join(cut, state["source"].eqNullSafe(cut["cut_source"]), "left").select(
        "source", "source_size", "target", "full",
        F.when(F.col("at").isNotNull(), F.col("at")).when(F.col("open"), F.col("low"))
        .when(F.col("need") > 0, F.lit(1 << BITS)).otherwise(0).cast("long").alias("cut"))
    out = store(out)
    discard(*kept)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, times, taken (size * times)."""
    rows = store(sized(docs))
    plan = thresholds(rows, store(source_targets(rows, weights, most)), most)
    times = F.col("s.full") + (F.col("r.h") < F.col("s.cut")).cast("long")
    return rows.alias("r").join(plan.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "r.doc_id", "r.size", "s.source_size", "s.target", times.alias("times"),
        (F.col("r.size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, all columns kept.

    Documents of no words weigh nothing; they come once for each pass that takes them, at most
    `most` times, and so do not change any source's words.
    """
    rows = store(sized(docs))
    plan = thresholds(rows, store(source_targets(rows, weights, most)), most)
    d = docs.withColumn("_mix_draw", draw("doc_id"))
    times = F.least(F.col("s.full") + (F.col("d._mix_draw") < F.col("s.cut")).cast("long"), F.lit(most).cast("long"))
    out = d.alias("d").join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return out.where(times > 0).select(
        *[F.col(f"d.`{c}`") for c in docs.columns],
        F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("_mix_copy")).drop("_mix_copy")


QUERY_COLUMNS = ("doc_id", "size", "source_size", "target", "taken", "times")

#: DuckDB text for `mix` over documents: the same rule with a running sum over every source.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
           3.0 * CAST(source_size AS DOUBLE) AS cap FROM per),
sums AS (SELECT *, row_number() OVER o AS i,
  CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM ranked WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
level AS (SELECT i AS first_i, rest / rest_w AS level FROM sums WHERE rest / rest_w * w <= cap ORDER BY i LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN first_i IS NULL OR i < first_i THEN cap ELSE w * level END AS target
            FROM sums LEFT JOIN level ON true),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS whole
         FROM targets),
running AS (
  SELECT r.doc_id, r.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
         CAST(sum(r.size) OVER (PARTITION BY p.source ORDER BY r.h) AS BIGINT) AS upto,
         CAST(sum(r.size) OVER (PARTITION BY p.source, r.h) AS BIGINT) AS tied
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
counted AS (SELECT *, whole + CASE WHEN need > 0 AND 2 * upto - tied <= 2 * need THEN 1 ELSE 0 END AS n FROM running)
SELECT doc_id, size, source_size, target, size * n AS taken FROM counted
"""
