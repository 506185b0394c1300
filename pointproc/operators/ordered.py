"""Ordered operators over long sequences, cut into time blocks.

A window partitioned by (recording, channel) alone puts a whole train into one
task, and one train may hold a third of the data. Here every window is
partitioned by (keys, block) instead. What a block needs from its neighbours is
one small row per block, carried by a window over the *block summaries* and
joined back on (keys, block); the rows themselves are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def div_floor(x: Column, width: int) -> Column:
    """Exact floor(x / width) on BIGINT, also for negative x."""
    w = F.lit(int(width)).cast("bigint")
    return ((x - F.pmod(x, w)) / w).cast("bigint")


def _past(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def with_neighbours(df: DataFrame, keys: Sequence[str], order: str, width: int,
                    ties: Sequence[str] = ()) -> DataFrame:
    """Add ``idx`` (1-based rank in the train), ``prev`` and ``next`` order values.

    ``order`` is a BIGINT column; ``width`` is the block length in its unit.
    ``ties`` make the rank of equal order values repeatable.
    """
    keys = list(keys)
    part = [*keys, BLOCK]
    own = df.columns
    df = df.withColumn(BLOCK, div_floor(F.col(order), width))
    inner = Window.partitionBy(*part).orderBy(order, *ties)
    rows = df.select(
        "*",
        F.lag(order).over(inner).alias("_lag"),
        F.lead(order).over(inner).alias("_lead"),
        F.row_number().over(inner).alias("_rn"),
    )
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks = (
        df.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), F.max(order).alias("_last"))
        .select(
            *part,
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
            F.coalesce(F.sum("_n").over(_past(across)), F.lit(0)).alias("_offset"),
        )
    )
    return rows.join(blocks, part).select(
        *own, BLOCK,
        (F.col("_offset") + F.col("_rn")).cast("bigint").alias("idx"),
        F.coalesce("_lag", "_before").alias("prev"),
        F.coalesce("_lead", "_after").alias("next"),
    )


def carry_latest(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the latest non-NULL ``value`` at or before each row.

    Needs the ``idx`` and block columns of :func:`with_neighbours`.
    """
    keys = list(keys)
    part = [*keys, BLOCK]
    marked = df.withColumn("_v", value)
    inner = (Window.partitionBy(*part).orderBy("idx")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = marked.withColumn("_seen", F.last("_v", ignorenulls=True).over(inner))
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    blocks = (
        marked.groupBy(*part)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("idx"))).alias("_latest"))
        .select(*part, F.last("_latest", ignorenulls=True).over(_past(across)).alias("_carried"))
    )
    return rows.join(blocks, part).select(
        *df.columns, F.coalesce("_seen", "_carried").alias(out))


def with_islands(df: DataFrame, keys: Sequence[str], order: str, width: int, gap: int) -> DataFrame:
    """As :func:`with_neighbours`, plus ``island``: the ``idx`` of the latest row that
    comes more than ``gap`` after its predecessor (or is first)."""
    keys = list(keys)
    part = [*keys, BLOCK]
    own = df.columns
    inner = Window.partitionBy(*part).orderBy(order)
    t = F.col(order)
    placed = df.withColumn(BLOCK, div_floor(t, width)).select(
        "*", F.lag(order).over(inner).alias("_lag"), F.lead(order).over(inner).alias("_lead"),
        F.row_number().over(inner).alias("_rn"),
    ).withColumn("_break", F.when(t - F.col("_lag") > gap, F.col("_rn")))
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumn("_seen", F.last("_break", ignorenulls=True).over(upto))
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    opens = F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap)
    blocks = (
        placed.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), F.max(order).alias("_last"),
             F.max("_break").alias("_tail"))
        .select("*", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"),
                F.coalesce(F.sum("_n").over(_past(across)), F.lit(0)).alias("_offset"))
        .withColumn("_head", F.when(opens, F.col("_offset") + 1))
        .withColumn("_latest", F.coalesce(F.col("_offset") + F.col("_tail"), F.col("_head")))
        .select(*part, "_before", "_after", "_offset",
                F.coalesce("_head", F.last("_latest", ignorenulls=True).over(_past(across))).alias("_carried"))
    )
    return rows.join(blocks, part).select(
        *own, BLOCK,
        (F.col("_offset") + F.col("_rn")).cast("bigint").alias("idx"),
        F.coalesce("_lag", "_before").alias("prev"),
        F.coalesce("_lead", "_after").alias("next"),
        F.coalesce(F.col("_offset") + F.col("_seen"), "_carried").cast("bigint").alias("island"),
    )
