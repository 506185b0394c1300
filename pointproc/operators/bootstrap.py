"""Co-located bootstrap: draws meet the observations inside a task, not in a join.

Endpoints travel in packs of about `MOST` observations, each as one row: an observation is
the ranks of its two values among the distinct ones, in as few bytes as they take, a cluster its
size. A pack goes once to each of a number of ranges of iterations that the shuffle width bounds,
so what is moved grows with the observations only, and a task holds one pack. It makes the
draws of a replicate by hashing their counters, once for all endpoints of the pack that draw
alike, counts them by value and reads the medians from running counts; one row per
replicate leaves it. Nothing is shuffled per draw.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointproc.functions.resample import draw_words
from pointproc.functions.scalar import safe_pct

#: Observations of an endpoint up to which they travel in a pack, and of all endpoints of a pack, about.
MOST = 1 << 20
#: Draws that a range of iterations is at least good for.
DRAWS = 1 << 22
#: Draws counted together.
STEP = 1 << 20


class Medians:
    """Medians of drawn observations, by counts of their distinct values; missing ones are left out."""

    def __init__(self, values: np.ndarray, missing: np.ndarray):
        self.values, rank = np.unique(values[~missing], return_inverse=True)
        self.rank = np.full(len(values), len(self.values))
        self.rank[~missing] = rank

    @classmethod
    def coded(cls, values: bytes, rank: bytes) -> Medians:
        """From the bytes of the distinct values and of the ranks, which are as wide as their number asks for."""
        m = cls.__new__(cls)
        m.values = np.frombuffer(values, np.float64)
        m.rank = np.frombuffer(rank, np.min_scalar_type(len(m.values)))
        return m

    def of(self, replicate: np.ndarray, drawn: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Medians of n replicates, and which have none, from (replicate, observation) of each draw."""
        bins = len(self.values) + 1
        counts = np.bincount(replicate * bins + self.rank[drawn], minlength=n * bins).reshape(n, bins)
        upto = np.cumsum(counts[:, :-1], axis=1)
        total = upto[:, -1] if bins > 1 else np.zeros(n, np.int64)
        empty = total == 0
        if empty.all():
            return np.zeros(n), empty
        low, high = (np.minimum((upto > k[:, None]).argmax(axis=1), bins - 2) for k in ((total - 1) // 2, total // 2))
        low, high = self.values[low], self.values[high]
        with np.errstate(invalid="ignore"):
            return np.where(low == high, low, 0.5 * low + 0.5 * high), empty


def draws_one_level(iterations: np.ndarray, sizes: list[np.ndarray], seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each endpoint its place, that of each draw's replicate, and the observation drawn: a slot has the same word in all of them."""
    many = [int(s.sum()) for s in sizes]
    words = draw_words(seed, np.repeat(iterations, max(many)), 0, np.tile(np.arange(max(many)), len(iterations)))
    words = words.astype(np.uint64).reshape(len(iterations), -1)
    for k, n in enumerate(many):
        own = words[:, :n]
        yield k, np.repeat(np.arange(len(iterations)), n), (own - own // np.uint64(n) * np.uint64(n)).astype(np.int64).ravel()


def draws_two_level(iterations: np.ndarray, sizes: list[np.ndarray], seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As many clusters as there are, then as many observations of each as it has; endpoints with the same clusters draw alike."""
    alike: dict[bytes, list[int]] = {}
    for k, s in enumerate(sizes):
        alike.setdefault(s.tobytes(), []).append(k)
    for places in alike.values():
        own = sizes[places[0]]
        c = len(own)
        start = np.cumsum(own) - own
        c_slot = np.tile(np.arange(c), len(iterations))
        picked = draw_words(seed, np.repeat(iterations, c), 1, c_slot) % c
        length = own[picked]
        row = np.repeat(np.arange(len(picked)), length)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        replicate = row // c
        drawn = start[picked][row] + draw_words(seed, iterations[replicate], 2, c_slot[row], ",", slot) % length[row]
        for k in places:
            yield k, replicate, drawn


def runs(sorted_values: pa.Array) -> np.ndarray:
    """Lengths of the runs of equal values."""
    code = sorted_values.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.diff(np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]))


def coded(keys: Sequence[str]) -> Callable:
    """Endpoints with the sizes of their clusters, and the distinct values and ranks of each of their two measures, as bytes."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                cells = [runs(batch.column("clusters")[k].values).astype(np.int64).tobytes()]
                for c in ("delta", "pct"):
                    x = batch.column(c)[k].values
                    m = Medians(x.fill_null(0.0).to_numpy(), ~np.asarray(x.is_valid()))
                    cells += [m.values.tobytes(), m.rank.astype(np.min_scalar_type(len(m.values))).tobytes()]
                yield pa.record_batch([*(batch.column(c).slice(k, 1) for c in keys), *(pa.array([x], pa.binary()) for x in cells)],
                                      names=[*keys, *CODED])

    return run


CODED = ["sizes", "delta", "delta_rank", "pct", "pct_rank"]


def ranged(iterations: int, length: int) -> Callable:
    """Each pack with each range of iterations, one row at a time: an explode would hold all copies of a pack at once."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                for first in range(0, iterations, length):
                    ends = [pa.array([x], pa.int32()) for x in (first, min(first + length, iterations) - 1)]
                    yield pa.record_batch([batch.column("endpoints").slice(k, 1), *ends], names=["endpoints", "first", "last"])

    return run


def replicates(keys: Sequence[str], seed: int, draw: Callable) -> Callable:
    """keys, iteration, delta, pct of the iterations of each row's range, for all endpoints of its pack."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                first, last = (batch.column(c)[k].as_py() for c in ("first", "last"))
                ends = batch.column("endpoints").slice(k, 1).flatten()
                cells = [[x.as_py() for x in ends.field(c)] for c in CODED]
                sizes = [np.frombuffer(x, np.int64) for x in cells[0]]
                medians = [[Medians.coded(*x) for x in zip(*cells[i:i + 2])] for i in (1, 3)]
                step = max(1, STEP // max(max(int(x.sum()) for x in sizes), 1))
                for lo in range(first, last + 1, step):
                    its = np.arange(lo, min(lo + step, last + 1))
                    for e, replicate, drawn in draw(its, sizes, seed):
                        columns = [pa.array(v, mask=none) for v, none in (m[e].of(replicate, drawn, len(its)) for m in medians)]
                        key = [ends.field(c).take(pa.array(np.full(len(its), e))) for c in keys]
                        yield pa.record_batch([*key, pa.array(its.astype(np.int32)), *columns], names=[*keys, "iteration", "delta", "pct"])

    return run


def resampled(rows: DataFrame, keys: Sequence[str], cluster: str | None, order: str, iterations: int, seed: int, total: int) -> DataFrame:
    """Replicate medians of the difference and the percent change: keys, iteration, delta, pct.

    ``rows`` are ``total`` complete observations of endpoints of at most ``MOST`` each. Observations
    are numbered by ``order`` within their cluster, clusters by their value.
    """
    keys = list(keys)
    b, t = F.col("b").cast("double"), F.col("t").cast("double")
    group: Column = F.col(cluster) if cluster else F.lit(0)
    item = F.struct(group.alias("c"), F.col(order).alias("o"), (t - b).alias("delta"), safe_pct(b, t).alias("pct"))
    arrays = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        *keys, F.col("items.delta").alias("delta"), F.col("items.pct").alias("pct"), F.col("items.c").alias("clusters"))
    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    endpoints = arrays.mapInArrow(coded(keys), f"{ddl}, {', '.join(f'{c} binary' for c in CODED)}")
    packs = max(1, -(-total // max(MOST, 1)))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # as many ranges as give each task work, but no more than two tasks of the shuffle width a pack
    ranges = max(1, min(iterations, -(-total * iterations // (packs * DRAWS)), -(-2 * width // packs)))
    length = -(-iterations // ranges)
    packed = endpoints.groupBy(F.pmod(F.xxhash64(*keys), F.lit(packs)).alias("pack")).agg(
        F.collect_list(F.struct(*keys, *CODED)).alias("endpoints"))
    row = T.StructType([packed.schema["endpoints"], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    dealt = packed.select("endpoints").mapInArrow(ranged(iterations, length), row).repartition(packs * ranges)
    return dealt.mapInArrow(replicates(keys, seed, draws_two_level if cluster else draws_one_level),
                            f"{ddl}, iteration int, delta double, pct double")
