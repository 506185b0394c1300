"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors of one label are compared in tiles. A unit vector x is rounded to s * q with
8-bit whole numbers q; with e the length of x - s * q, two products differ by at most
e_x + (1 + e_x) * e_y, whatever the vectors are. Only pairs whose rounded product may
lie above the threshold by that bound are computed again in double precision.
Products of 8-bit numbers are summed as single-precision matrices, which is exact as
long as the sum stays below 2^24; longer vectors use double precision.

Equal vectors of a label form a class and are compared once. A tile returns counts of
links and a spanning forest of them, never its pairs. A label that holds a third of
all rows is as many tiles as it needs, spread over the cluster.

Vectors link with nothing if they, their label or a component are missing, not finite
or all zero, or if their lengths differ. Rows with equal ids count as one vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.llm.components import components
from pointproc.llm.tiles import roots, tile_rows
from pointproc.session import store

THRESHOLD = 0.98
TILE = 512


def usable() -> F.Column:
    e = F.col("embedding")
    wrong = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & ~wrong & F.exists(e, lambda x: x != 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers, scale and error length of unit vectors."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - scale[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12
    return q, scale, error


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y with cosine of at least the threshold, computed in double where rounding leaves doubt."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantise(x / nx[:, None]), quantise(y / ny[:, None])
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64) * sx[:, None] * sy[None, :]
    bound = ex[:, None] + (1 + ex[:, None]) * ey[None, :] + 1e-9
    a, b = np.nonzero(product + bound >= threshold)
    exact = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
    ok = exact >= threshold
    return a[ok], b[ok]


def compare_tiles(tiled: DataFrame, threshold: float) -> DataFrame:
    """rep, other, links: as tiles come one after the other; rows are sorted by tile within partitions."""

    def flush(rep, copies, block, side, raw):
        x = np.array([np.frombuffer(r, np.float32) for r in raw]).astype(np.float64)
        if side[0] == side[1]:
            first = second = np.arange(len(rep))
        else:
            first, second = np.flatnonzero(block == side[0]), np.flatnonzero(block == side[1])
        if not len(first) or not len(second):
            return [], [], []
        a, b = close_pairs(x[first], x[second], threshold)
        a, b = first[a], second[b]
        keep = a < b if side[0] == side[1] else a >= 0
        a, b = a[keep], b[keep]
        links = np.bincount(a, weights=copies[b], minlength=len(rep)) + np.bincount(b, weights=copies[a], minlength=len(rep))
        root = roots(len(rep), a, b)
        k, f = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(rep)))
        return [*rep[k], *rep[f]], [None] * len(k) + list(rep[root[f]]), [*links[k].astype(int), *[0] * len(f)]

    def compare(batches):
        key, rows = None, []

        def done():
            if len(rows) > 1:
                rep, copies, block, raw = (np.array(c, object if n == 3 else np.int64) for n, c in enumerate(zip(*rows)))
                cols = flush(rep, copies, block, key[-2:], raw)
                if cols[0]:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["rep", "other", "links"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "i", "j", "rep", "copies", "block", "raw")]
            for part, i, j, *row in zip(*cols):
                if (part, i, j) != key:
                    yield from done()
                    key, rows = (part, i, j), []
                rows.append(row)
        yield from done()

    return tiled.sortWithinPartitions("part", "i", "j").mapInArrow(compare, "rep long, other long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least id reachable by links), kept."""
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")

    def packed(batches):
        for batch in batches:
            raw = [np.array(v, np.float32).tobytes() for v in batch.column("embedding").to_pylist()]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())],
                                  names=["vec_id", "label", "raw"])

    kind = rows.schema["label"].dataType.simpleString()
    good = rows.where(usable()).dropDuplicates(["vec_id"]).mapInArrow(packed, f"vec_id long, label {kind}, raw binary")
    part = F.xxhash64("label", F.length("raw"))
    good = store(good.withColumn("part", part))
    classes = store(good.groupBy("part", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    tiled = tile_rows(classes, "part", "rep", TILE).repartition(width, "part", "i", "j")
    links = store(compare_tiles(tiled, threshold))
    joined = components(links.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = links.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = store(classes.join(joined, classes["rep"] == joined["node"], "left").join(counts, "rep", "left").select(
        "part", "raw", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    found = good.join(per_class, ["part", "raw"]).select("vec_id", "component", "links")
    out = rows.select("vec_id").distinct().join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: DuckDB text for all pairs of a label.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach(n, m) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.m FROM reach r JOIN links l ON r.n = l.a),
least AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n),
many AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT n AS vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, n = component_id AS kept
FROM least LEFT JOIN many ON n = a
"""
