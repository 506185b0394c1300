"""What the corpus operators share: words, hashes of text in numpy, keys and held-out rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that numpy works on at once; a longer document makes a piece of its own.
PIECE = 1 << 19

_rng = np.random.default_rng(20240611)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def draw(*columns: str) -> Column:
    """A 60-bit number from the digest of the columns as text, alike on every rerun."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lean(run: Callable) -> Callable:
    """A task function that gives freed memory back when it ends: a worker serves many tasks, and what it keeps of one
    stage is missing in the next."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return task


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in the table: the measure from which bucket numbers are taken."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets(spark: SparkSession, size: int, each: int) -> int:
    """So many buckets that each holds about `each` of `size`, and at least the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits given."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Bytes:
    """Text of some documents as one byte array, with hashes of any of its ranges.

    The hash of bytes s..e is a polynomial modulo 2^64 taken from one running sum, so
    a range costs the same whatever its length.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._sum = self._inverse = None

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sum is None:
            n = len(self.data)
            self._sum = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODE[self.data] * powers(n, BASE), out=self._sum[1:])
            self._inverse = powers(n + 1, INVERSE)
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start])

    def grams(self, width: int) -> np.ndarray:
        """Hash of the `width` bytes at each position that has so many."""
        n = len(self.data) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self.ranges(np.zeros(0, np.int64), np.zeros(0, np.int64))
        return mix((self._sum[width:] - self._sum[:n]) * self._inverse[:n])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document (by place) of every word; no word crosses documents."""
        d = self.data
        solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(d))]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.searchsorted(self.offsets, start, side="right") - 1


def pieces(text: pa.Array, limit: int = PIECE, rows: int = 1 << 30) -> Iterator[tuple[int, int, Bytes]]:
    """Documents lo..hi of an Arrow string column, as bytes, about `limit` bytes at a time."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        yield lo, hi, Bytes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:len(x) - step], x[step:])
        have += step
    return x


def heads(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    out = np.ones(len(sorted_values), bool)
    out[1:] = sorted_values[1:] != sorted_values[:-1]
    return out


def group_first(values: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each row the value at the head of its group."""
    return values[np.flatnonzero(head)][np.cumsum(head) - 1]
