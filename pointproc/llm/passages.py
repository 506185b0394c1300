"""Substring near-deduplication by compact windows.

A passage is at least `WORDS` words; two passages are near-duplicates if their sets of
five-word shingles have a Jaccard similarity of at least `THRESHOLD`.

1. Shingles are counted by the documents that hold them. A window with more than `LACK`
   shingles that no other document holds resembles nothing, and is in no stretch that
   a window of another document resembles; it is left out of what follows.
2. For each of `HASHES` hash functions all windows of the passage length have a least
   hash. In the Cartesian tree over a text's hashes, a node that is the least of its
   subtree's span covers a whole run of windows, its compact window; nodes whose span
   holds no window never matter, and those that do are the least of some window, so
   the runs of window minima give exactly the compact windows needed, without
   building the rest of the tree.
3. Interval join: runs of one function with one value group windows that share a
   signature. Runs whose surroundings are equal as far as a window reaches are copies: they
   join the runs of the first document of their class only. The classes of a value, each
   by its first document, join one another all. The text is read again for the places whose
   value another document has: pairs whose bitmaps of the shingles beside the one and
   around the other rule out every window with the value go, as do pairs of cells without
   a window that verification could keep; the rest are kept by cells of both documents' places.
4. Verification: around each linked pair of places the shingles of both texts are
   compared, every window of the one against all stretches of the other, with every
   occurrence of its shingles there. Windows that pass are joined into maximal passages.

The join is complete up to the chance that no function agrees, (1 - J) ** HASHES for
similarity J: below 0.0001 at 0.8. Of several earlier documents with one equal window
a passage that resembles it names the first; they are linked with each other. Words are runs of anything but blanks. Missing and
short texts have no passage; rows without an id take no part; rows with equal ids
count as one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointproc.llm.common import BASE, INVERSE, Bytes, buckets, heads, mix, pieces, powers, sliding_min, text_bytes
from pointproc.llm.components import components
from pointproc.session import discard, store

WORDS, SHINGLE, THRESHOLD, HASHES = 50, 5, 0.8, 6
#: Shingles of a window, of a cell of places, and the most of a stretch that resembles a window of distinct ones.
SPAN = WORDS - SHINGLE + 1
CELL, STRETCH = 2 * SPAN, int(SPAN / THRESHOLD) + 1
OFFER, BUCKET = 4 << 20, 32 << 20
#: Bits of a sketch of shingles, and how many of a window's shingles a resembling stretch may lack.
SKETCH, STRANGE = 512, int(SPAN * (1 - THRESHOLD) + 1e-9)
#: Shingles of all windows with a place in a cell, and bits of the sketch of a cell's surroundings.
REACH, WIDE = CELL + 2 * SPAN - 2, 2048
#: How many shingles of a window of the stretch may be missing in the window that resembles the stretch.
LACK = int((STRETCH - 1) * (1 - THRESHOLD) + 1e-9)
#: Bits of a shingle's hash that go to the count, besides those that name the bucket.
COUNTED = 40

_rng = np.random.default_rng(11)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_FUNCTION = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place in its document of every shingle."""
    start, end, doc = b.words()
    w = b.ranges(start, end)
    n = len(w) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h += w[j:j + n] * _PLACE[j]
    ok = doc[:n] == doc[SHINGLE - 1:]
    of = doc[:n][ok]
    return mix(h[ok]), of, np.arange(len(of)) - np.searchsorted(of, of)


def group_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles as `shingles` gives them, of all rows of a column."""
    parts = [(h, doc + lo, pos) for lo, _, b in pieces(text) for h, doc, pos in [shingles(b)]]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else shingles(Bytes(np.empty(0, np.uint8), np.zeros(1, np.int64)))


def sorted_shingles(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of shingles by bucket and hash, those keys, and where a new one begins."""
    bits = np.uint64(COUNTED)
    key = (h % np.uint64(n)) << bits | h >> np.uint64(64 - COUNTED)
    order = np.argsort(key, kind="stable")
    return order, key[order], heads(key[order])


def common_windows(h: np.ndarray, doc: np.ndarray, n: int, elsewhere: np.ndarray) -> np.ndarray:
    """Whether each window of documents has at most `LACK` shingles that no other document holds.

    elsewhere: for each distinct key of `sorted_shingles` whether another group has it.
    """
    order, _, head = sorted_shingles(h, n)
    which = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(h)) - 1
    alone = (~elsewhere & (doc[order[first]] == doc[order[last]]))[which]
    again = np.flatnonzero(alone & ~head)
    before, here = order[again - 1], order[again]
    near = here - before < SPAN  # both in one window: they count once
    repeats = np.zeros(len(h) + 1, np.int64)
    np.add.at(repeats, np.maximum(here[near] - SPAN + 1, 0), 1)
    np.add.at(repeats, before[near] + 1, -1)
    own = np.zeros(len(h) + 1, np.int64)
    own[1:][order[alone]] = 1
    np.cumsum(own, out=own)
    return own[SPAN:] - own[:-SPAN] - np.cumsum(repeats)[:len(own) - SPAN] <= LACK


def compact_windows(h: np.ndarray, doc: np.ndarray, common: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each function: its value at, and the shingle (by its place in h) of, each run of windows, or of those in `common`.

    Of a run of windows with one value so many places are given that each window holds
    one: the last place of the first window, then that of the first window beyond it.
    """
    inside = np.empty(0, np.int64)
    if len(doc) >= SPAN:
        ok = doc[SPAN - 1:] == doc[:len(doc) - SPAN + 1]
        inside = np.flatnonzero(ok if common is None else ok & common)
    for k in range(HASHES):
        if not len(inside):
            continue
        v = mix(h * _FUNCTION[k])
        bits = np.uint64(max(1, len(v).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        least = sliding_min((v & ~low) | (low - np.arange(len(v), dtype=np.uint64)), SPAN)[inside]
        last = (low - (least & low)).astype(np.int64)
        head = heads(least >> bits)
        head[1:] |= np.diff(inside) > 1
        w = np.flatnonzero(head)
        end, places = np.append(w[1:], len(inside)), []
        while len(w):
            places.append(last[w])
            w = w + (last[w] + 1 - inside[w])
            on = w < end
            w, end = w[on], end[on]
        at = np.sort(np.concatenate(places))
        yield v[at] ^ np.uint64(k), at


def by_class(value: np.ndarray, of: np.ndarray, cell: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows by value, surroundings, document and cell, without repeats; where a class (value, surroundings) begins; rows of its least document."""
    order = np.lexsort((cell, of, near, value))
    rows = [x[order] for x in (value, of, cell, near)]
    head = heads(rows[0]) | heads(rows[3])
    new = head | heads(rows[1]) | heads(rows[2])
    value, of, cell, near, head = (x[new] for x in (*rows, head))
    return value, of, cell, near, head, of == of[begins(head)] if len(of) else head


def begins(head: np.ndarray) -> np.ndarray:
    """For each row the place of its group's head."""
    return np.flatnonzero(head)[np.cumsum(head) - 1]


def row_pairs(start: np.ndarray, times: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with the `times` rows from `start` on, about `limit` pairs at once."""
    rows = np.flatnonzero(times)
    start, times = start[rows], times[rows]
    for lo, hi in chunks(np.cumsum(times), limit):
        many = times[lo:hi]
        a = np.repeat(rows[lo:hi], many)
        b = np.repeat(start[lo:hi] - (np.cumsum(many) - many), many) + np.arange(len(a))
        yield a, b


def pairs_with(start: np.ndarray, times: np.ndarray, of: np.ndarray, cell: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (document, cell, other document, its cell) of the pairs of rows, without repeats."""
    for a, b in row_pairs(start, times):
        yield distinct(np.stack([of[a], cell[a], of[b], cell[b]], 1))


def copies(of: np.ndarray, cell: np.ndarray, head: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
    """Links of the rows of a class with those of its least document."""
    if len(of):
        start = begins(head)
        yield from pairs_with(start, np.where(own, 0, np.bincount(start[own], minlength=len(of))[start]), of, cell)


def between(value: np.ndarray, of: np.ndarray, cell: np.ndarray) -> Iterator[np.ndarray]:
    """Links of all rows with those of every earlier document that has the value."""
    if len(value):
        order = np.lexsort((cell, of, value))
        value, of, cell = value[order], of[order], cell[order]
        head = heads(value)
        start = begins(head)
        yield from pairs_with(start, begins(head | heads(of)) - start, of, cell)


def meetings(value: np.ndarray, of: np.ndarray, cell: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
    """All links of a table of values; without surroundings no two rows are copies."""
    value, of, cell, _, head, own = by_class(value, of, cell, (of << 32) + cell if near is None else near)
    out = [np.empty((0, 4), np.int64), *copies(of, cell, head, own), *between(value[own], of[own], cell[own])]
    return distinct(np.concatenate(out))


def chunks(running: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose counts, given as running sums, come to about `limit`."""
    lo = 0
    while lo < len(running):
        hi = int(np.searchsorted(running, (running[lo - 1] if lo else 0) + limit, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def distinct(rows: np.ndarray) -> np.ndarray:
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]


def part_of(docs: DataFrame, size: int) -> Column:
    """The group of documents, of about `OFFER` bytes of text, that a document is worked on with."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets(docs.sparkSession, size, OFFER))).alias("part")


def met_places(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, cell, other_id, other_cell, value: cells that are copies (no value), and places of classes with a value that other classes have.

    The latter are places, not cells: each with one of the document before it with the value, or itself.
    """
    n = buckets(docs.sparkSession, size, BUCKET)

    def rows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = t.sort_by("doc_id")
        return t.column("doc_id").to_numpy(), *group_of(t.column("text"))

    def count(t: pa.Table) -> pa.Table:
        _, key, head = sorted_shingles(rows_of(t)[1], n)
        key = key[head]
        edges = np.searchsorted(key >> np.uint64(COUNTED), np.arange(n + 1, dtype=np.uint64))
        low = key.view(np.uint8).reshape(-1, 8)[:, :COUNTED // 8]
        some = np.flatnonzero(np.diff(edges)).tolist()
        return pa.table([pa.array(some, pa.int64()), pa.array([t.column("part")[0].as_py()] * len(some), pa.int64()),
                         pa.array([low[edges[k]:edges[k + 1]].tobytes() for k in some], pa.binary())], names=["bucket", "part", "keys"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        raw = t.column("keys").to_pylist()
        edges = np.cumsum([0, *[len(x) // (COUNTED // 8) for x in raw]])
        key = np.zeros((edges[-1], 8), np.uint8)
        key[:, :COUNTED // 8] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, COUNTED // 8)
        del raw
        key = key.view(np.uint64).ravel()
        order = np.argsort(key)
        same = ~heads(key[order])
        more = same.copy()
        more[:-1] |= same[1:]
        shared = np.zeros(len(key), bool)
        shared[order] = more
        yield pa.record_batch([t.column("part").combine_chunks(), t.column("bucket").combine_chunks(), pa.array(np.diff(edges)),
                               pa.array([np.packbits(shared[a:z]).tobytes() for a, z in zip(edges, edges[1:])], pa.binary())],
                              names=["part", "bucket", "keys", "shared"])

    def offer(t: pa.Table, found: pa.Table) -> pa.Table:
        ids, h, doc, pos = rows_of(t)
        out = []
        if len(h) >= SPAN:
            found = found.sort_by("bucket")
            elsewhere = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for k, x in zip(*(found.column(c).to_pylist() for c in ("keys", "shared")))])
            got = list(compact_windows(h, doc, common_windows(h, doc, n, elsewhere.astype(bool))))
            if got:
                value, at = (np.concatenate(x) for x in zip(*got))
                value, of, place, near, head, own = by_class(value, ids[doc[at]], pos[at], neighbourhoods(h, doc, at))
                out.extend(packets(n, value[own], of[own], place[own] << 32 | near[own]))
                for links in copies(of, place // CELL, head, own):  # copies inside the group pass through
                    pair = mix(links[:, 0].astype(np.uint64) ^ mix(links[:, 2].astype(np.uint64)))
                    out.extend(packets(n, pair, *links.T))
        return pa.Table.from_batches(out, PACKET)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        value, *rows = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64 if c == "value" else np.int64)
                        for c in ("value", "of", "pos", "other", "other_pos"))
        del t
        if len(rows[2]):
            yield table_of(distinct(np.stack(rows, 1)))
            return
        value, of, place, _, head, own = by_class(value, rows[0], rows[1] >> 32, rows[1] & 0xFFFFFFFF)
        for links in copies(of, place // CELL, head, own):
            yield table_of(links)
        value, of, place = value[own], of[own], place[own]
        if len(value):
            order = np.lexsort((place, of, value))
            value, of, place = value[order], of[order], place[order]
            head = heads(value)
            shared = (of[head] < of[np.append(np.flatnonzero(head)[1:], len(of)) - 1])[np.cumsum(head) - 1]  # values of one document meet nobody
            start = begins(head | heads(of))
            before = np.where(start > begins(head), start - 1, np.arange(len(of)))
            yield table_of(np.stack([of, place, of[before], place[before]], 1)[shared], value[shared].view(np.int64))

    dealt = docs.select("doc_id", "text", part_of(docs, size))
    known = store(dealt.groupBy("part").applyInArrow(count, "bucket long, part long, keys binary")
                  .groupBy("bucket").applyInArrow(compared, "part long, bucket long, keys long, shared binary"))
    met = store(dealt.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(
        offer, "bucket long, value binary, of binary, pos binary, other binary, other_pos binary")
                .groupBy("bucket").applyInArrow(gather, MET))
    discard(known)
    return met


def between_places(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """As `met_places`: cells of places of different classes with one value that the bitmaps do not rule out. shared: value, doc_id, place, class."""
    n = buckets(docs.sparkSession, shared.count() * (32 + 3 * SKETCH // 8 + 5 * REACH + WIDE // 8), BUCKET)
    places = shared.groupBy("doc_id").agg(F.collect_list(F.struct("value", "place", "class")).alias("places"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        value, of, place, kind = (t.column(c).to_numpy() for c in ("value", "doc_id", "place", "class"))
        order = np.lexsort((place, of, kind, value))
        left, right, around, shingle, lack, there = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(len(value), -1)[order] for c, kind in (
            ("left", np.uint64), ("right", np.uint64), ("around", np.uint64), ("shingles", np.uint32), ("lack", np.int8), ("there", np.uint8)))
        value, of, place, kind = value[order], of[order], place[order], kind[order]
        start = begins(heads(value))
        for a, b in row_pairs(start, begins(heads(value) | heads(kind)) - start, 1 << 17):
            a, b = np.where(of[a] > of[b], a, b), np.where(of[a] > of[b], b, a)
            strange = ~around[b]
            ok = np.minimum(*(np.bitwise_count(side[a] & strange).sum(1) for side in (left, right))) <= STRANGE
            cells = np.stack([of[a], place[a] // CELL, of[b], place[b] // CELL], 1)[ok]
            a, b, order = a[ok], b[ok], np.lexsort(cells.T[::-1])
            first = order[np.append(True, (cells[order[1:]] != cells[order[:-1]]).any(1))] if len(order) else order
            for x in np.array_split(first, -(-len(first) // (1 << 14))) if len(first) else ():
                ok = may_resemble(shingle[a[x]], lack[a[x]], there[b[x]])
                yield table_of(cells[x[ok]])

    seen = docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(
        sketched, "doc_id long, value long, place long, class long, left binary, right binary, around binary, shingles binary, lack binary, there binary")
    return seen.groupBy(F.pmod("value", F.lit(n)).alias("bucket")).applyInArrow(compare, MET)


def links_of(cells: DataFrame) -> DataFrame:
    """doc_id, other_id, other_cell, cells: all cells of a document that are linked with one of an earlier document."""
    return cells.groupBy("doc_id", "other_id", "other_cell").agg(F.sort_array(F.collect_set("cell")).alias("cells"))


def linked_places(docs: DataFrame, size: int) -> DataFrame:
    """Links of cells of places that share a value, the other document being an earlier one."""
    met = met_places(docs, size)
    shared = met.where("value IS NOT NULL").select("value", "doc_id", F.col("cell").alias("place"), F.col("doc_id").alias("class"))
    out = store(links_of(between_places(docs, shared).unionAll(met.where("value IS NULL"))))
    discard(met)
    return out


def likeliest(met: DataFrame) -> DataFrame:
    """Links of each cell with the cell of an earlier document that most of its places meet, of `met_places`."""
    n = buckets(met.sparkSession, met.count() * 40, BUCKET)

    def best(t: pa.Table) -> pa.Table:
        doc, cell, other, other_cell = (t.column(c).to_numpy() for c in ("doc_id", "cell", "other_id", "other_cell"))
        place = t.column("value").is_valid().to_numpy()
        rows = np.stack([doc, np.where(place, cell // CELL, cell), other, np.where(place, other_cell // CELL, other_cell)], 1)
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1)))
        rows, many = rows[first], np.diff(np.append(first, len(rows)))
        rows = rows[np.lexsort((rows[:, 2], -many, rows[:, 1], rows[:, 0]))]
        return pa.Table.from_batches([table_of(rows[heads(rows[:, 0]) | heads(rows[:, 1])])])

    return links_of(met.where("doc_id <> other_id").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(n))).applyInArrow(best, MET))


def one_of_classes(near: DataFrame, classes: DataFrame) -> DataFrame:
    """For each two classes the link, of `links_of`, that takes in most cells. classes: doc_id, class."""
    other = classes.select(F.col("doc_id").alias("other_id"), F.col("class").alias("other_class"))
    link = F.struct(*near.columns)
    return near.join(classes, "doc_id").join(other, "other_id").groupBy(F.least("class", "other_class"), F.greatest("class", "other_class")).agg(
        F.max_by(link, F.struct(F.size("cells"), link)).alias("link")).select("link.*")


def apart(near: DataFrame, known: DataFrame) -> DataFrame:
    """Links between documents that are not in one component. known: node, component."""
    ends = [known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("doc_id", "other_id")]
    return near.join(ends[0], "doc_id", "left").join(ends[1], "other_id", "left").where(
        F.coalesce("of_doc_id", "doc_id") != F.coalesce("of_other_id", "other_id")).select(*near.columns)


def parted_places(met: DataFrame, joined: DataFrame) -> DataFrame:
    """value, doc_id, place, class: places whose value documents of several classes have. joined: node, component."""
    shared = met.where("value IS NOT NULL").select("value", "doc_id", F.col("cell").alias("place"))
    n = buckets(met.sparkSession, shared.count() * 32, BUCKET)

    def parted(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("class").to_numpy(), t.column("value").to_numpy()))
        value, kind = (t.column(c).to_numpy()[order] for c in ("value", "class"))
        head = heads(value)
        last = np.append(np.flatnonzero(head)[1:], len(value)) - 1
        some = (kind[head] < kind[last])[np.cumsum(head) - 1]
        return t.take(pa.array(order[some]))

    known = joined.select(F.col("node").alias("doc_id"), F.col("component").alias("class"))
    rows = shared.join(known, "doc_id", "left").select("value", "doc_id", "place", F.coalesce("class", "doc_id").alias("class"))
    return rows.groupBy(F.pmod("value", F.lit(n))).applyInArrow(parted, "value long, doc_id long, place long, class long")


MET = "doc_id long, cell long, other_id long, other_cell long, value long"
PACKET = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("value", "of", "pos", "other", "other_pos"))])


def table_of(links: np.ndarray, value: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.record_batch([*(pa.array(np.ascontiguousarray(x)) for x in links.T), pa.nulls(len(links), pa.int64()) if value is None else pa.array(value)],
                           names=["doc_id", "cell", "other_id", "other_cell", "value"])


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the shingles beside each place and around it, and what `may_resemble` asks of its cell.

    A window with the place holds all of one side. If it resembles a stretch of
    another document with the value, at most `STRANGE` of its shingles are missing
    around the value there, so at most as many bits of that side. A side that the
    document's end cuts short lies in no window: all its bits are set.
    """
    side = SPAN // 2
    for batch in batches:
        for lo, hi, b in pieces(batch.column("text")):
            h, doc, _ = shingles(b)
            begin = np.searchsorted(doc, np.arange(hi - lo + 1))
            places = batch.column("places").slice(lo, hi - lo)
            many, flat = places.value_lengths().to_numpy(), places.flatten()
            value, place, kind = (flat.field(k).to_numpy() for k in range(3))
            of = np.repeat(np.arange(hi - lo), many)

            def reach(x: np.ndarray, at: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
                near = (at + begin[of[x]])[:, None] + np.arange(-before, after + 1)
                return near, (near >= begin[of[x], None]) & (near < begin[of[x] + 1, None])

            for x in np.array_split(np.arange(len(of)), -(-len(of) // 5_000)) if len(of) else ():
                bits = []
                for before, after in ((side - 1, 0), (0, side - 1), (STRETCH, STRETCH)):
                    near, inside = reach(x, place[x], before, after)
                    found = np.zeros((len(x), SKETCH), bool)
                    found[np.nonzero(inside)[0], (h[near[inside]] >> np.uint64(32)).astype(np.int64) % SKETCH] = True
                    if not before or not after:
                        found[~inside.all(1)] = True
                    bits.append(np.packbits(found, axis=1))
                cell = place[x] // CELL * CELL
                near, inside = reach(x, cell, SPAN - 1, CELL + SPAN - 2)
                bits.extend(wanted_of(np.where(inside, h[np.clip(near, 0, len(h) - 1)], np.arange(REACH, dtype=np.uint64)), inside))
                near, inside = reach(x, cell, STRETCH, CELL + STRETCH - 1)
                found = np.zeros((len(x), WIDE), bool)
                found[np.nonzero(inside)[0], (h[near[inside]] >> np.uint64(32)).astype(np.int64) % WIDE] = True
                bits.append(np.packbits(found, axis=1))
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(of[x])), pa.array(value[x]), pa.array(place[x]), pa.array(kind[x]),
                                       *(pa.array([r.tobytes() for r in rows], pa.binary()) for rows in bits)],
                                      names=["doc_id", "value", "place", "class", "left", "right", "around", "shingles", "lack", "there"])


def wanted_of(h: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of shingles the bit of each, and how many of its distinct ones each window may lack; -1 if it is not all inside.

    Above its 16 bits a shingle has how many places before it a window may begin that holds it for the first time there.
    """
    order = np.argsort(h, 1, kind="stable")
    ranked = np.take_along_axis(h, order, 1)
    before = np.full(h.shape, -1, np.int16)
    np.put_along_axis(before, order[:, 1:], np.where(ranked[:, 1:] == ranked[:, :-1], order[:, :-1], -1).astype(np.int16), 1)
    lack = np.full((len(h), h.shape[1] - SPAN + 1), -1, np.int8)
    for w in range(lack.shape[1]):
        size = (before[:, w:w + SPAN] < w).sum(1)
        lack[:, w] = np.where(inside[:, w] & inside[:, w + SPAN - 1], size * (1 - THRESHOLD) + 1e-9, -1)
    bit = ((h >> np.uint64(32)) % np.uint64(WIDE)).astype(np.uint32)
    fresh = np.minimum(np.arange(h.shape[1]) - before - 1, SPAN - 1).astype(np.uint32)
    return bit | fresh << np.uint32(16), lack


def may_resemble(bit: np.ndarray, lack: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Whether any window of `wanted_of` lacks no more than it may of the bitmap beside it: if none does, verification finds nothing.

    A missing shingle that stands several times in a window counts once, so that a run of one word is not taken as found.
    """
    rows, reach = bit.shape
    place, fresh = (bit & 0xFFFF).astype(np.int64), (bit >> 16).astype(np.int64)
    row, at = np.nonzero(np.take_along_axis(there, place >> 3, 1) >> (7 - (place & 7)).astype(np.uint8) & 1 == 0)
    first = row * (reach + 1) + at
    cells = rows * (reach + 1)
    change = np.bincount(first - np.minimum(fresh[row, at], at), minlength=cells) - np.bincount(first + 1, minlength=cells)
    return (np.cumsum(change.reshape(rows, -1), 1)[:, :lack.shape[1]] <= lack).any(1)


def neighbourhoods(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 bits of the shingles around each place, as far as a window or stretch with it reaches in its document."""
    lo = np.maximum(at - STRETCH, np.searchsorted(doc, doc[at]))
    hi = np.minimum(at + STRETCH + 1, np.searchsorted(doc, doc[at], side="right"))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h), BASE), out=total[1:])
    around = mix((total[hi] - total[lo]) * powers(len(h) + 1, INVERSE)[lo])
    return (mix(around ^ ((at - lo) << 8 | (hi - at)).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def packets(n: int, value: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by hash bucket; packets that only pass through (with other ends) go to buckets of their own."""
    through = len(columns) == 4
    to = (value % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(n + 1))
    rows = []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        i = order[edges[k]:edges[k + 1]]
        cells = [b"" if through else value[i].tobytes(), *(c[i].tobytes() for c in columns)]
        rows.append((k + n * through, *cells, *[b""] * (5 - len(cells))))
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKET)], schema=PACKET)


def surroundings(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, cell, start, hashes (4 bytes each): the shingles of each cell and a stretch on both sides. cells: doc_id, cell."""
    wanted = cells.groupBy("doc_id").agg(F.sort_array(F.collect_set("cell")).alias("wanted"))

    def cut(batches):
        for batch in batches:
            wanted = batch.column("wanted")
            for lo, hi, b in pieces(batch.column("text")):
                h, doc, _ = shingles(b)
                begin = np.searchsorted(doc, np.arange(hi - lo + 1))
                h = (h >> np.uint64(32)).astype(np.uint32)
                rows = []
                for i, at in enumerate(wanted.slice(lo, hi - lo).to_pylist()):
                    a, z = begin[i], begin[i + 1]
                    for c in at:
                        s = max(0, c * CELL - STRETCH)
                        rows.append((lo + i, c, s, h[a + s:min(z, a + (c + 1) * CELL + STRETCH)].tobytes()))
                ids, cell, start, found = zip(*rows)
                yield pa.record_batch([batch.column("doc_id").take(pa.array(ids)), pa.array(cell, pa.int64()),
                                       pa.array(start, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "cell", "start", "hashes"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
        cut, "doc_id long, cell long, start long, hashes binary")


def earlier(x: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same value, or -1."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), -1)
    same = x[order[1:]] == x[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def best_stretches(a: np.ndarray, b: np.ndarray, windows: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """Windows of a that resemble a stretch of b, with first and last place of the one most like it.

    size: distinct shingles of each window. For each start in b a stretch ends where it
    has more distinct shingles than the threshold allows; a window that has too few
    matches even there is not compared with any stretch of that start. Of equal neighbours
    in b only the first counts: a stretch that begins or ends at another has the same set.
    """
    places = np.flatnonzero(heads(b))
    b = b[places]
    seen = np.zeros((len(a) + 1, len(b)), np.int16)
    np.cumsum(a[:, None] == b, 0, out=seen[1:])
    inside = seen[windows + SPAN] > seen[windows]
    back, nb = earlier(b), len(b)
    most = int(size.max() / threshold + 1e-9)
    near = back >= np.maximum(np.arange(nb) - most, 0)
    if near.any():  # ends by distinct shingles, else by places
        many = np.cumsum((back < np.arange(nb)[:, None]) & ~np.tri(nb, k=-1, dtype=bool), 1, dtype=np.int16)
        end = (many <= most).sum(1)
    else:
        end = np.minimum(np.arange(nb) + most, nb)
    running = np.zeros((len(windows), nb + 1), np.int16)
    np.cumsum(inside, 1, out=running[:, 1:])
    may = inside & (running[:, end] - running[:, :-1] >= (threshold * size - 1e-9)[:, None])
    some = may.any(1)
    windows, size, inside, running, may = windows[some], size[some], inside[some], running[some], may[some]
    which = np.arange(len(windows))
    if near.any():  # windows of one set
        _, one, which = np.unique(np.column_stack([np.packbits(inside, axis=1), size]), axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        size, inside, running, may = size[one], inside[one], running[one], may[one]
    best, first, last = (np.zeros(len(size)) for _ in range(3))

    def take(i, similarity, s, e):
        new = similarity > best[i]
        i = i[new]
        best[i], first[i], last[i] = similarity[new], s if np.isscalar(s) else s[new], e[new]

    if near.any():
        for s in np.flatnonzero(may.any(0)).tolist():
            i, fresh = np.flatnonzero(may[:, s]), back[s:end[s]] < s
            shared = np.cumsum(inside[i, s:end[s]] & fresh, 1)
            j = shared / (size[i, None] + np.cumsum(fresh) - shared)
            k = j.argmax(1)
            take(i, j[np.arange(len(i)), k], s, s + k)
    elif len(size):
        i, s = np.nonzero(may)
        similarity, at, base = np.zeros(len(i)), s.copy(), running[i, s]
        for length in range(math.ceil(threshold * int(size.min()) - 1e-9), most + 1):
            e = np.minimum(s + length, nb)
            shared = running[i, e] - base
            j = shared / (size[i] + (e - s) - shared)
            new = j > similarity
            similarity[new], at[new] = j[new], e[new] - 1
        order = np.lexsort((s, -similarity, i))
        order = order[heads(i[order])]
        take(i[order], similarity[order], s[order], at[order])
    for w in np.flatnonzero(best[which] >= threshold - 1e-9).tolist():
        yield int(windows[w]), int(places[int(first[which[w]])]), int(places[int(last[which[w]])])


def similar_runs(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, one: bool = False) -> list[tuple[int, int, int, int]]:
    """First and last shingle (exclusive) of runs of a's windows that resemble a stretch of b, and of that stretch.

    A window whose matches in b, all together, are dense enough is
    settled by them. With `one` that will do, if there is such a window. Any other with enough matches is held against all stretches of b
    that begin and end with one of its shingles, wherever else these may stand.
    """
    n = len(a) - SPAN + 1
    if n <= 0 or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    j = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    place = order[j]
    hit = b[place] == a
    if not hit.any():
        return []
    before = earlier(a)
    size, shared = np.full(n, SPAN), np.cumsum(np.append(0, hit))
    shared = shared[SPAN:] - shared[:n]
    if (np.arange(len(a)) - before < SPAN)[before >= 0].any():
        first = np.lib.stride_tricks.sliding_window_view(before, SPAN) < np.arange(n)[:, None]
        size = first.sum(1)
        shared = (first & np.lib.stride_tricks.sliding_window_view(hit, SPAN)).sum(1)
    if not ((shared > 0) & (shared >= threshold * size - 1e-9)).any():
        return []
    far = np.int64(1 << 40)
    low = sliding_min(np.where(hit, place, far), SPAN)
    high = -sliding_min(np.where(hit, -place, far), SPAN)
    stretch = np.maximum(high - low + 1, 1)
    ok = (shared > 0) & (shared >= threshold * (size + stretch - shared) - 1e-9)
    hard = np.flatnonzero(~ok & (shared > 0) & (shared >= threshold * size - 1e-9))
    if len(hard) and not (one and ok.any()):
        for w, p, q in best_stretches(a, b, hard, size[hard], threshold):
            ok[w], low[w], high[w] = True, p, q
    w = np.flatnonzero(ok)
    if not len(w):
        return []
    apart = (np.diff(w) > 1) | (low[w[1:]] > high[w[:-1]] + 1) | (high[w[1:]] + 1 < low[w[:-1]])
    cut = np.flatnonzero(apart)
    return [(int(w[s]), int(w[e]) + SPAN, int(low[w[s]:w[e] + 1].min()), int(high[w[s]:w[e] + 1].max()) + 1)
            for s, e in zip(np.append(0, cut + 1), np.append(cut, len(w) - 1))]


def near_passages(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start_word, end_word, other_id, other_start, other_end: maximal near-duplicate passages, the other one earlier."""
    rows = texts(docs)
    size = text_bytes(rows)
    return verified(rows, linked_places(rows, size), size, threshold).select(
        "doc_id", "start_word", "end_word", "other_id", "other_start", "other_end")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, component_id, kept, start_word, end_word, other_id, other_start, other_end.

    component_id is the least id that the document is linked with by near-duplicate
    passages, over other documents too, and kept is true for it. Each cell is first
    compared with one of an earlier document that most of its places meet. Places with one
    value whose documents are not in one class yet then give the links that the bitmaps leave: first
    one of each two classes is verified, then all whose documents are still apart, so
    that a group of near copies takes no pairs beyond those that join it. The last
    columns are one of the passages found, as in `near_passages`.
    """
    rows = texts(docs)
    size = text_bytes(rows)
    met = met_places(rows, size)
    some = verified(rows, store(likeliest(met)), size, threshold, True)
    pairs = some.select("doc_id", "other_id")
    links = store(met.where("value IS NULL").select("doc_id", "other_id").unionAll(pairs).distinct().toDF("a", "b"))
    parted = store(parted_places(met, components(links)))
    discard(met)
    near = store(links_of(between_places(rows, parted)))
    some = some.unionAll(verified(rows, store(one_of_classes(near, parted.select("doc_id", "class").distinct())), size, threshold, True))
    discard(parted)
    known = components(links.unionAll(some.select("doc_id", "other_id")))
    rest = verified(rows, store(apart(near, known)), size, threshold, True)
    discard(near)
    joined = components(links.unionAll(some.unionAll(rest).select("doc_id", "other_id")))
    shown = ["other_id", "start_word", "end_word", "other_start", "other_end"]
    found = some.unionAll(rest).groupBy("doc_id").agg(F.min(F.struct(*shown)).alias("one"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
        *(f"one.{c}" for c in ("start_word", "end_word", "other_id", "other_start", "other_end")))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: one row of each id, without missing ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    if _repeats(rows):
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))  # the same one whenever it is read
    return rows


def verified(rows: DataFrame, links: DataFrame, size: int, threshold: float, one: bool = False) -> DataFrame:
    """Passages of the links, as `near_passages` gives them, or with `one` a passage of each two documents. The table of links goes.

    The linked cells of the earlier documents go, with their surroundings, to the groups
    of the later ones, once to each group. The later ones are then read once more and
    compared with all that they are linked with: each
    cell once, against all of their own cells that share a value with it. Copies link
    with the first document of their class and have its other links through it.
    """
    around = store(surroundings(rows, links.select(F.col("other_id").alias("doc_id"), F.col("other_cell").alias("cell"))))
    part = part_of(rows, size)
    other = around.select(F.col("doc_id").alias("other_id"), F.col("cell").alias("other_cell"), "start", "hashes")
    there = store(other.join(links.select("other_id", "other_cell", part).distinct(), ["other_id", "other_cell"]))
    discard(around)
    came = store(links.groupBy("doc_id").agg(F.collect_list(F.struct("other_id", "other_cell", "cells")).alias("came")))
    discard(links)

    out = store(rows.join(came, "doc_id").select("doc_id", "text", "came", part).groupBy("part").cogroup(there.groupBy("part")).applyInArrow(
        lambda t, there: passages_of(t, there, threshold, one), ", ".join(f"{x} long" for x in FOUND)))
    discard(there, came)
    return out


FOUND = ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end"]


def passages_of(t: pa.Table, there: pa.Table, threshold: float, one: bool = False) -> pa.Table:
    """Passages of documents with their texts and links, the surroundings of the linked cells given."""
    cells = {(a, c): (s, h) for a, c, s, h in zip(*(there.column(x).to_pylist() for x in ("other_id", "other_cell", "start", "hashes")))}
    got = []
    for batch in t.to_batches(max_chunksize=1 << 10):
        came = batch.column("came")
        for lo, hi, b in pieces(batch.column("text")):
            h, doc, _ = shingles(b)
            begin = np.searchsorted(doc, np.arange(hi - lo + 1))
            h = (h >> np.uint64(32)).astype(np.uint32)
            ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
            out = []
            for i, links in enumerate(came.slice(lo, hi - lo).to_pylist()):
                own, runs, seen = h[begin[i]:begin[i + 1]], set(), {}
                for link in sorted(links, key=lambda x: (x["other_id"], x["other_cell"])):
                    if one and link["other_id"] in seen:
                        continue
                    start, there = cells[link["other_id"], link["other_cell"]]
                    there = np.frombuffer(there, np.uint32)
                    for s, e in ranges(link["cells"]):
                        for x, y, p, q in similar_runs(own[s:e], there, threshold, one):
                            if one:
                                seen[link["other_id"]] = True
                                runs.add((link["other_id"], s + x, s + y + SHINGLE - 1, start + p, start + q + SHINGLE - 1))
                                break
                            same = seen.setdefault((s + x, s + y, there[p:q].tobytes()), [])
                            if any(other != link["other_id"] and one_window(a, o, there, p, q) for other, a, o in same):
                                continue
                            same.append((link["other_id"], there, p))
                            runs.add((link["other_id"], s + x, s + y + SHINGLE - 1, start + p, start + q + SHINGLE - 1))
                out.extend((ids[i], *run) for run in joined(sorted(runs)))
            got += out
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * len(FOUND))], names=FOUND)


def one_window(a: np.ndarray, o: int, b: np.ndarray, p: int, q: int) -> bool:
    """Whether the equal stretches a[o:] and b[p:q] lie in an equal window: the two documents are linked by it themselves."""
    left, right = min(o, p, SPAN), min(len(a) - (o + q - p), len(b) - q, SPAN)
    before = np.append(a[o - left:o] != b[p - left:p], False)
    after = np.append(a[o + q - p:o + q - p + right] != b[q:q + right], True)
    back = left - 1 - int(np.flatnonzero(before)[-1]) if before.any() else left
    return back + int(after.argmax()) + q - p >= SPAN


def ranges(cells: list[int]) -> list[tuple[int, int]]:
    """Shingles of all windows with a place in one of the sorted cells; neighbouring cells make one range."""
    edges = [k for k in range(1, len(cells)) if cells[k] > cells[k - 1] + 1]
    return [(max(0, cells[a] * CELL - SPAN + 1), (cells[z - 1] + 1) * CELL + SPAN - 1) for a, z in zip([0, *edges], [*edges, len(cells)])]


def joined(runs: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Sorted runs (other, start, end, other's start, other's end); those that meet in both documents are made one."""
    out: list[tuple[int, int, int, int, int]] = []
    live: list[list[int]] = []
    for other, s, e, p, q in runs:
        out.extend(tuple(x) for x in live if x[0] != other or x[2] < s)
        live = [x for x in live if x[0] == other and x[2] >= s]
        one = [other, s, e, p, q]
        for x in [x for x in live if p <= x[4] and q >= x[3]]:
            one = [other, x[1] if x[1] < one[1] else one[1], max(one[2], x[2]), min(one[3], x[3]), max(one[4], x[4])]
            live.remove(x)
        live.append(one)
    return sorted(out + [tuple(x) for x in live])


def _repeats(rows: DataFrame) -> bool:
    """Whether an id occurs twice; only then must rows be made distinct, which moves all text."""
    return not rows.groupBy("doc_id").count().where("count > 1").isEmpty()
