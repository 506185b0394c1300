"""Refractory thinning as a composition of block functions.

Whether a spike is kept depends on the last kept one, over any number of spikes
back. A time block that is at least one refractory time long forgets all but one
number of what came before: the last kept time. So each block is a function from
that time to its own last kept time. It is a step function of few steps, because
chains of kept spikes that start at different places soon run together.

All blocks work out their function in parallel; one row per block is then passed
through in time order, which gives every block the time it starts from; and all
blocks thin their spikes in parallel. A dense train without any gap is spread like
any other. Inside a task the blocks of a batch are handled together: a spike points
to the first one that is late enough, and chains are followed by doubling.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointproc.operators.ordered import BLOCK, div_floor


class Chains:
    """Spikes of whole blocks in time order, equal times once, each pointing to the next one that may be kept after it."""

    def __init__(self, t: np.ndarray, block: np.ndarray, head: np.ndarray, refractory: int, width: int):
        self.refractory, self.stride = refractory, width + refractory + 1
        fresh = head.copy()
        fresh[1:] |= t[1:] != t[:-1]
        self.at = np.flatnonzero(fresh)
        self.group = (np.cumsum(head) - 1)[self.at]
        self.t = t[self.at]
        self.begin = block[head] * width
        # one axis for all blocks, with more than a refractory time between them
        self.axis = self.group * self.stride + self.t - self.begin[self.group]
        self.first = np.searchsorted(self.group, np.arange(len(self.begin)))
        n = len(self.t)
        after = np.searchsorted(self.axis, self.axis + refractory)
        self.next = np.where(np.append(self.group, -1)[after] == self.group, after, n)

    def last(self) -> np.ndarray:
        """For each spike the last one kept of its block if it is kept itself."""
        n = len(self.t)
        to = np.where(self.next < n, self.next, np.arange(n))
        while True:
            further = to[to]
            if (further == to).all():
                return to
            to = further

    def kept(self, start: np.ndarray) -> np.ndarray:
        """All spikes on the chains that begin at the given ones."""
        n = len(self.t)
        jumps = [np.append(self.next, n).astype(np.int32)]
        while (jumps[-1][start] < n).any():
            jumps.append(jumps[-1][jumps[-1]])
        found = start
        for jump in reversed(jumps):
            more = jump[found]
            found = np.concatenate([found, more[more < n]])
        return found


def whole_groups(batches: Iterator[pa.RecordBatch], head: str) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no group, which begins where `head` is true, is cut."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        begins = np.flatnonzero(batch.column(head).to_numpy(zero_copy_only=False))
        if len(begins):
            if held or begins[-1]:
                yield pa.concat_tables([*held, rows.slice(0, int(begins[-1]))]).combine_chunks()
            held, rows = [], rows.slice(int(begins[-1]))
        held.append(rows)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def block_functions(keys: Sequence[str], refractory: int, width: int) -> Callable:
    """keys, block, upto, out: a last kept time L leads to out[i] for the first i with upto[i] >= L + refractory, else stays."""

    def run(batches):
        for rows in whole_groups(batches, "_head"):
            if not len(rows):
                continue
            head = rows.column("_head").to_numpy()
            c = Chains(numbers(rows, "t_us"), numbers(rows, BLOCK), head, refractory, width)
            last = c.last()
            # an earlier kept time reaches no further than the refractory time into the block: what it may lead to is
            # one of the spikes there or the first one behind them
            early = c.t - c.begin[c.group] < refractory
            entry = early.copy()
            entry[c.first] = True
            entry[1:] |= early[:-1] & (c.group[1:] == c.group[:-1])
            e = np.flatnonzero(entry)
            step = np.append((last[e][1:] != last[e][:-1]) | (c.group[e][1:] != c.group[e][:-1]), True)
            e = e[step]
            offsets = pa.array(np.append(np.searchsorted(c.group[e], np.arange(len(c.begin))), len(e)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (c.t[e], c.t[last[e]])]
            key = rows.select([*keys, BLOCK]).take(pa.array(np.flatnonzero(head))).combine_chunks()
            yield from pa.table([*key.columns, *lists], names=[*keys, BLOCK, "upto", "out"]).to_batches()

    return run


def pass_through(keys: Sequence[str], refractory: int) -> Callable:
    """keys, block, since: the last kept time that each block starts from; one row per block, in time order."""

    def run(batches):
        train, kept = None, None
        for batch in batches:
            since = []
            for *key, upto, out in zip(*(batch.column(c).to_pylist() for c in (*keys, "upto", "out"))):
                if key != train:
                    train, kept = key, None
                since.append(kept)
                i = 0 if kept is None else bisect_left(upto, kept + refractory)
                if i < len(upto):
                    kept = out[i]
            yield pa.record_batch([*(batch.column(c) for c in (*keys, BLOCK)), pa.array(since, pa.int64())], names=[*keys, BLOCK, "since"])

    return run


def thin_blocks(columns: Sequence[str], refractory: int, width: int) -> Callable:
    """The kept rows of each block, given the last kept time before it."""

    def run(batches):
        for rows in whole_groups(batches, "_head"):
            if not len(rows):
                continue
            head = rows.column("_head").to_numpy()
            c = Chains(numbers(rows, "t_us"), numbers(rows, BLOCK), head, refractory, width)
            since = rows.column("since").take(pa.array(np.flatnonzero(head)))
            known = ~np.asarray(since.is_null())
            since = np.where(known, since.fill_null(0).to_numpy(), c.begin - refractory)
            group = np.arange(len(c.begin))
            start = np.searchsorted(c.axis, group * c.stride + np.maximum(since + refractory - c.begin, 0))
            start = start[np.append(c.group, -1)[start] == group]
            keep = np.sort(c.at[c.kept(start)])
            yield from rows.select(list(columns)).take(pa.array(keep)).combine_chunks().to_batches()

    return run


def thin(spikes: DataFrame, keys: Sequence[str], refractory_us: int, block_us: int) -> DataFrame:
    """Spikes at least `refractory_us` behind the last kept one of their train; the first of a train is kept.

    Of equal times one is kept, that of the longest ``duration_us``. Spikes are
    shuffled once, by train and block; a task holds one block of one train at least.
    """
    keys, refractory = list(keys), max(int(refractory_us), 1)  # times are whole, equal ones are merged
    width = max(int(block_us), refractory, 1)
    columns = [*keys, "t_us", "duration_us"]
    order = ["t_us", F.desc("duration_us")]
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    rows = spikes.select(*columns).withColumn(BLOCK, div_floor(F.col("t_us"), width)).withColumn(
        "_head", F.row_number().over(within) == 1)
    key = rows.select(*keys, BLOCK).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key)
    steps = rows.select(*keys, BLOCK, "t_us", "_head").mapInArrow(
        block_functions(keys, refractory, width), f"{ddl}, upto array<bigint>, out array<bigint>")
    entries = steps.repartition(*keys).sortWithinPartitions(*keys, BLOCK).mapInArrow(
        pass_through(keys, refractory), f"{ddl}, since bigint")
    # the window keeps a block's rows together and in order, a left join leaves them so
    joined = rows.join(entries, [*keys, BLOCK], "left").sortWithinPartitions(*keys, BLOCK, *order)
    return joined.select(*columns, BLOCK, "_head", "since").mapInArrow(
        thin_blocks(columns, refractory, width), spikes.select(*columns).schema)
