"""Band joins: rows of two sides whose positions differ by at most ``reach``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.operators.ordered import div_floor
from pointproc.session import wide


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_pos: str,
              right_pos: str, reach: int, after: bool = False) -> DataFrame:
    """All (left, right) rows with equal ``keys`` and |right - left| <= ``reach``.

    With ``after`` only right rows at or after the left one: 0 <= right - left <= reach.
    Positions are BIGINT. Buckets are as wide as the band, so a left row meets at most
    two of them and the join is an equi-join on (keys, bucket): a hot key is spread
    over its buckets, and no row is matched twice because a right row has one bucket.
    Column names of both sides other than the keys must differ.
    """
    reach = int(reach)
    low = 0 if after else reach
    width = max(low + reach, 1)
    lp, rp = F.col(left_pos), F.col(right_pos)
    near = left.withColumn("_cell", F.explode(
        F.sequence(div_floor(lp - low, width), div_floor(lp + reach, width))))
    cell = right.withColumn("_cell", div_floor(rp, width))
    on = [*keys, "_cell"]
    return wide(near, *on).join(wide(cell, *on), on).filter(
        (rp - lp).between(F.lit(-low), F.lit(reach))).drop("_cell")


def point_in_intervals(points: DataFrame, spans: DataFrame, keys: Sequence[str], pos: str,
                       width: int) -> DataFrame:
    """All (point, span) rows with equal ``keys`` and lo <= point <= hi.

    A span is listed in every bucket it touches, a point in one; the spans of one
    owner are disjoint, so a point meets at most one span of each owner.
    """
    width = max(int(width), 1)
    listed = spans.withColumn("_cell", F.explode(
        F.sequence(div_floor(F.col("lo"), width), div_floor(F.col("hi"), width))))
    p, on = F.col(pos), [*keys, "_cell"]
    return (wide(points.withColumn("_cell", div_floor(p, width)), *on).join(wide(listed, *on), on)
            .filter((F.col("lo") <= p) & (p <= F.col("hi"))).drop("_cell"))
