"""Comparing all rows of a group in tiles: how rows are dealt out, and links inside a tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_rows(rows: DataFrame, group: str, item: str, tile: int) -> DataFrame:
    """Each row once for every tile of its group that its block takes part in: adds i, j (i <= j) and its own block."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / tile).cast("int").alias("_blocks"))
    blocks = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return blocks.withColumn("_other", other).withColumn("i", F.least("block", "_other")) \
        .withColumn("j", F.greatest("block", "_other")).drop("_other", "_blocks")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least linked row of each of n rows."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        if (root[a] == least).all() and (root[b] == least).all():
            break
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
    return root
