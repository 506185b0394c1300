"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to the least neighbour: minima by a combining
aggregate, then a join that Spark may split, so a node of very many links is not
gathered in one task. Rounds end when a round changes no link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.session import discard, store


def _large(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
        least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of one type: node and component, the least node that it is linked with by any path.

    Links with a missing end or to the node itself say nothing. Nodes without links do not appear.
    """
    now = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    state = _state(now)
    while state != before and state[0]:
        after = store(_small(_large(now).distinct()).distinct())
        discard(now)
        now, before, state = after, state, _state(after)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
