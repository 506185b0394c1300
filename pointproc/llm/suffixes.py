"""Suffix-array deduplication: bytes covered by a 50-byte string that an earlier document has too.

A byte is removed if some string of `WIDTH` bytes covers it that also starts in a
document of a smaller id; strings are judged on the input and never cross documents.

The suffixes are sorted sparsely. Of the tokens (`GRAM` bytes) inside each window of
`WIDTH` bytes the one with the least hash is the window's leading token, so equal
windows lead with equal tokens, and one token leads about fourteen windows in a row.

1. `shared_tokens`: tokens that two documents have. A piece of text offers a token
   once however often it holds it, so no bucket gets more than a row for each piece.
2. `token_suffixes`: for each of those the suffix from the token on, with what stands
   before it: all bytes of the windows it leads, as a key of fixed width.
3. `sort_tokens`: sampled splitters range-partition these keys (ties split by id, so
   a passage in a third of all documents spreads over many tasks); a bucket is sorted
   by multikey quicksort and compared row by row. Equal keys settle all windows at
   once; the first rows of different keys with one token are compared with each other,
   by how far they agree to the left and right. Where these are more than `NEAR`, or a
   token meets a bucket's edge, its first rows go on.
4. `sort_windows`: the single windows of those rows, sorted in the same way, bucket
   edges included: each bucket tells its last string and the least id that has it,
   a row per bucket, and the next one's first rows are compared with that.

Rows without an id are left alone and compared with nothing; missing text is empty.
Rows with equal ids never remove from each other, and each loses its own spans: where ids
repeat, a row's places start at a number of its text's own (`base`), so rows of one id are
told apart by a checksum of 31 bits. Where none repeats, all places start at 0.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.llm.common import Bytes, buckets, group_first, heads, lean, mix, pieces, sliding_min, text_bytes
from pointproc.session import discard, store

WIDTH = 50
GRAM = 24
SIDE = WIDTH - GRAM
#: Token first, then the bytes before and behind it that belong to its windows, in words of 8 bytes.
KEY = -(-(GRAM + 2 + 2 * SIDE) // 8) * 8
SUFFIX = -(-WIDTH // 8) * 8
#: Bytes of text for which one token is offered once, and that one hash bucket or range stands for.
OFFER, BUCKET, RANGE = 8 << 20, 32 << 20, 16 << 20
#: First rows of one token that are compared pair by pair.
NEAR = 24
_STEP, _PLACE = 1 << 19, np.uint64(21)


def leading(b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leading tokens of all windows: place, first and last window, hash. Long texts go by steps."""
    found = []
    for at in range(0, max(0, len(b.data) - WIDTH + 1), _STEP):
        part = b.data[at:at + _STEP + WIDTH - 1]
        h = Bytes(part, np.array([0, len(part)])).grams(GRAM)
        key = (h >> _PLACE << _PLACE) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(key, SIDE + 1)
        place = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        doc_end = b.offsets[np.searchsorted(b.offsets, at, side="right"):]
        ok = np.ones(len(place), bool)
        for end in doc_end[doc_end - at < len(place) + WIDTH]:
            ok[max(0, end - at - WIDTH + 1):max(0, end - at)] = False
        window = np.flatnonzero(ok)
        place = place[window]
        new = heads(place)
        new[1:] |= np.diff(window) > 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1 if len(window) else first
        found.append((place[first] + at, window[first] + at, window[last] + at, h[place[first]]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def shared_tokens(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, hashes: the tokens of a document that another one has too.

    Hashes travel in packets: to the bucket that compares them, then to the bucket of
    their document, so rows follow the documents and not their tokens.
    """
    n = buckets(docs.sparkSession, size, BUCKET)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, b in pieces(batch.column("text"), OFFER):
                place, _, _, h = leading(b)
                doc = ids[lo:hi][np.searchsorted(b.offsets, place, side="right") - 1]
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                if not len(h):
                    continue
                head = heads(h)
                at = np.flatnonzero(head)
                several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                both = np.repeat(several, np.diff(np.append(at, len(h))))
                one_h, one_doc = h[at], doc[at]
                to = (one_h % np.uint64(n)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(n + 1))
                used = np.flatnonzero(np.diff(edges))
                rows = [(int(k), one_h[i].tobytes(), one_doc[i].tobytes())
                        for k in used for i in [order[edges[k]:edges[k + 1]]]]
                if both.any():  # known here already: these only pass through
                    rows.append((n + int(h[0] % np.uint64(n)), h[both].tobytes(), doc[both].tobytes()))
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["bucket", "hashes", "docs"])

    def gather(t: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64)
        doc = np.frombuffer(b"".join(t.column("docs").to_pylist()), np.int64)
        if t.column("bucket")[0].as_py() < n:
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            at = np.flatnonzero(heads(h))
            several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            both = np.repeat(several, np.diff(np.append(at, len(h))))
            h, doc = h[both], doc[both]
        home = (mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        h, doc, home = h[order], doc[order], home[order]
        at = np.append(np.flatnonzero(heads(home)), len(home)) if len(home) else np.zeros(1, np.int64)
        return pa.table({"home": pa.array(home[at[:-1]], pa.int64()),
                         "hashes": pa.array([h[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary()),
                         "docs": pa.array([doc[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary())})

    def bring_home(t: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64)
        doc = np.frombuffer(b"".join(t.column("docs").to_pylist()), np.int64)
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
        at = np.append(np.flatnonzero(heads(doc)), len(doc))
        return pa.table({"doc_id": pa.array(doc[at[:-1]], pa.int64()),
                         "hashes": pa.array([np.unique(h[a:z]).tobytes() for a, z in zip(at, at[1:])], pa.binary())})

    return docs.mapInArrow(lean(offer), "bucket long, hashes binary, docs binary") \
        .groupBy("bucket").applyInArrow(gather, "home long, hashes binary, docs binary") \
        .groupBy("home").applyInArrow(bring_home, "doc_id long, hashes binary")


def take(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    return data[np.clip(start[:, None] + np.arange(width), 0, len(data) - 1)]


def binary(m: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as an Arrow column."""
    n, width = m.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()),
                                                  pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def text_number(raw: bytes) -> int:
    """What tells rows of one id apart, from 1 to 2 ** 31."""
    return (zlib.crc32(raw) & 0x7FFFFFFF) + 1


def token_suffixes(docs: DataFrame, tokens: DataFrame, repeated: bool = False) -> DataFrame:
    """key, doc_id, pos: a row for each place of a shared token, pos being its first window.

    With `repeated` ids, pos is counted from the text's number times 2 ** 31.
    """

    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            base = np.array([text_number(t.encode()) << 31 for t in batch.column("text").to_pylist()] if repeated else [0] * len(ids), np.int64)
            known = batch.column("known")
            for lo, hi, b in pieces(batch.column("text"), 1 << 20):
                place, first, last, h = leading(b)
                row = np.searchsorted(b.offsets, place, side="right") - 1
                want = [np.frombuffer(x, np.uint64) + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                        for i, x in enumerate(known.slice(lo, hi - lo).to_pylist())]
                hit = np.isin(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.concatenate(want))
                place, first, last, row = place[hit], first[hit], last[hit], row[hit]
                key = np.zeros((len(place), KEY), np.uint8)
                key[:, :GRAM] = take(b.data, place, GRAM)
                before, behind = place - first, last + WIDTH - place - GRAM
                key[:, GRAM], key[:, GRAM + 1] = before, behind
                side = np.arange(SIDE)
                key[:, GRAM + 2:GRAM + 2 + SIDE] = take(b.data, place - SIDE, SIDE) * (side >= SIDE - before[:, None])
                key[:, GRAM + 2 + SIDE:GRAM + 2 + 2 * SIDE] = take(b.data, place + GRAM, SIDE) * (side < behind[:, None])
                yield pa.record_batch([binary(key), pa.array(ids[lo:hi][row], pa.int64()),
                                       pa.array(first - b.offsets[row] + base[lo:hi][row])], names=["key", "doc_id", "pos"])

    known = tokens.withColumnRenamed("hashes", "known")
    return docs.join(known, "doc_id").select("doc_id", "text", "known").mapInArrow(lean(rows), "key binary, doc_id long, pos long")


def multikey_order(words: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Order of rows by their words from left to right; each next word is looked at only in runs still equal."""
    order = np.argsort(words[:, 0], kind="stable")
    head = heads(words[order, 0])
    for column in [words[:, j] for j in range(1, words.shape[1])] + list(ties):
        alone = head & np.append(head[1:], True)
        rest = np.flatnonzero(~alone)
        if not len(rest):
            break
        run, rows = np.cumsum(head)[rest], order[rest]
        rows = rows[np.lexsort((column[rows], run))]
        order[rest] = rows
        head[rest] |= heads(column[rows])
    return order


def bucket_rows(batches: Iterator[pa.RecordBatch], width: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All rows of a range bucket: keys as words, ids, places."""
    got = [x for x in batches if x.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    raw = np.frombuffer(b"".join(t.column(0).to_pylist()), np.uint8).reshape(-1, width)
    if pad > width:
        raw = np.pad(raw, ((0, 0), (0, pad - width)))
    return np.ascontiguousarray(raw).view(">u8").astype(np.uint64), t.column(1).to_numpy(), t.column(2).to_numpy()


def unlike(words: np.ndarray) -> np.ndarray:
    out = np.ones(len(words), bool)
    out[1:] = (words[1:] != words[:-1]).any(1)
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and behind their token two keys agree on."""
    side = np.arange(SIDE)
    before = np.minimum(a[:, GRAM], b[:, GRAM]).astype(np.int64)[:, None]
    behind = np.minimum(a[:, GRAM + 1], b[:, GRAM + 1]).astype(np.int64)[:, None]
    same = a[:, GRAM + 2:GRAM + 2 + 2 * SIDE] == b[:, GRAM + 2:GRAM + 2 + 2 * SIDE]
    left = (same[:, :SIDE] & (side >= SIDE - before))[:, ::-1]
    right = same[:, SIDE:] & (side < behind)
    return (np.where(left.all(1), SIDE, left.argmin(1)), np.where(right.all(1), SIDE, right.argmin(1)))


def sort_tokens(suffixes: DataFrame, n: int) -> DataFrame:
    """doc_id, pos, end, key: bytes found to be covered (no key), and rows whose windows are still to be compared."""

    def compare(batches):
        rows = bucket_rows(batches, KEY, KEY)
        if rows is None:
            return
        words, doc, pos = rows
        order = multikey_order(words, doc, pos)
        words, doc, pos = words[order], doc[order], pos[order]
        token, key = unlike(words[:, :GRAM // 8]), unlike(words)
        covered = doc > group_first(doc, key)
        at = np.flatnonzero(token)
        many = np.add.reduceat((~covered).astype(np.int64), at)
        many[[0, -1]] = NEAR + 1  # the token may go on in the next bucket
        many = np.repeat(many, np.diff(np.append(at, len(doc))))
        going_on = ~covered & (many > NEAR)
        raw = words.astype(">u8").view(np.uint8).reshape(-1, KEY)
        end = pos + raw[:, GRAM] + GRAM + raw[:, GRAM + 1]
        near = np.flatnonzero(~covered & (many <= NEAR) & (many > 1))
        run = np.cumsum(token)[near]
        for shift in range(1, NEAR):
            i = np.flatnonzero(run[shift:] == run[:-shift])
            if not len(i):
                break
            for part in np.array_split(i, max(1, len(i) // 50_000)):
                a, b = near[part], near[part + shift]
                left, right = agreement(raw[a], raw[b])
                for one, other in ((a, b), (b, a)):  # the later document loses what both have
                    hit = (doc[one] < doc[other]) & (left + GRAM + right >= WIDTH)
                    o = other[hit]
                    if len(o):
                        token_at = pos[o] + raw[o, GRAM]
                        yield pa.record_batch([pa.array(doc[o]), pa.array(token_at - left[hit]),
                                               pa.array(token_at + GRAM + right[hit]), pa.nulls(len(o), pa.binary())],
                                              names=["doc_id", "pos", "end", "key"])
        for keep, with_key in ((covered, False), (going_on, True)):
            for i in np.array_split(np.flatnonzero(keep), max(1, keep.sum() // 50_000)):
                if len(i):
                    yield pa.record_batch([pa.array(doc[i]), pa.array(pos[i]), pa.array(end[i]),
                                           binary(raw[i]) if with_key else pa.nulls(len(i), pa.binary())],
                                          names=["doc_id", "pos", "end", "key"])

    return suffixes.repartitionByRange(n, "key", "doc_id").mapInArrow(lean(compare), "doc_id long, pos long, end long, key binary")


def windows(rows: DataFrame) -> DataFrame:
    """suffix, doc_id, pos: every window of the rows' keys."""

    def spread(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                raw = np.frombuffer(b"".join(part.column("key").to_pylist()), np.uint8).reshape(-1, KEY)
                whole = np.concatenate([raw[:, GRAM + 2:GRAM + 2 + SIDE], raw[:, :GRAM], raw[:, GRAM + 2 + SIDE:GRAM + 2 + 2 * SIDE]], 1)
                many = raw[:, GRAM].astype(np.int64) + raw[:, GRAM + 1] - SIDE + 1
                row = np.repeat(np.arange(len(raw)), many)
                step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = SIDE - raw[row, GRAM].astype(np.int64) + step + row * whole.shape[1]
                yield pa.record_batch([binary(take(whole.ravel(), start, WIDTH)),
                                       part.column("doc_id").take(pa.array(row)),
                                       pa.array(part.column("pos").to_numpy()[row] + step)], names=["suffix", "doc_id", "pos"])

    return rows.select("key", "doc_id", "pos").mapInArrow(lean(spread), "suffix binary, doc_id long, pos long")


def sort_windows(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, pos of covered windows; and the table that they are read from."""

    def compare(batches):
        part = TaskContext.get().partitionId()
        got = bucket_rows(batches, WIDTH, SUFFIX)
        if got is None:
            return
        words, doc, pos = got
        order = multikey_order(words, doc, pos)
        words, doc, pos = words[order], doc[order], pos[order]
        head = unlike(words)
        least = group_first(doc, head)
        covered = doc > least
        first_run = np.cumsum(head) == 1
        i = np.flatnonzero(covered | first_run)
        for i in np.array_split(i, max(1, len(i) // 100_000)):
            yield pa.record_batch([pa.array(np.full(len(i), part)), pa.array(np.where(covered[i], "covered", "edge").tolist()),
                                   pa.array(doc[i]), pa.array(pos[i]), pa.nulls(len(i), pa.binary()), pa.nulls(len(i), pa.binary())],
                                  names=["part", "kind", "doc_id", "pos", "first", "last"])
        ends = words[[0, -1]].astype(">u8").view(np.uint8).reshape(2, SUFFIX)
        yield pa.record_batch([pa.array([part]), pa.array(["ends"]), pa.array(least[-1:]), pa.array([0]),
                               binary(ends[:1]), binary(ends[1:])], names=["part", "kind", "doc_id", "pos", "first", "last"])

    found = store(rows.repartitionByRange(n, "suffix", "doc_id").mapInArrow(
        lean(compare), "part long, kind string, doc_id long, pos long, first binary, last binary"))
    carry, before = [], (None, None)
    for r in found.where("kind = 'ends'").orderBy("part").collect():  # one row for each bucket
        same = before[0] is not None and bytes(r["first"]) == before[0]
        if same:
            carry.append((r["part"], before[1]))
        whole = same and bytes(r["last"]) == before[0]
        before = (bytes(r["last"]), min(before[1], r["doc_id"]) if whole else r["doc_id"])
    covered = found.where("kind = 'covered'").select("doc_id", "pos")
    if carry:
        least = F.create_map(*[F.lit(v).cast("long") for row in carry for v in row])
        covered = covered.unionAll(found.where("kind = 'edge'").where(F.col("doc_id") > least[F.col("part")]).select("doc_id", "pos"))
    return covered, found


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_no, spans (array of start, end in bytes, maximal and ascending) of rows that lose bytes.

    text_no is 0, or, where ids repeat, the `text_number` of the row that loses them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    repeated = not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    size = text_bytes(docs)
    n = buckets(spark, size, RANGE)
    tokens = store(shared_tokens(docs, size))
    first = store(sort_tokens(token_suffixes(docs, tokens, repeated), n))
    discard(tokens)
    second, table = sort_windows(windows(first.where("key IS NOT NULL")), n)
    spans = first.where("key IS NULL").select("doc_id", "pos", "end").unionAll(
        second.select("doc_id", "pos", (F.col("pos") + WIDTH).alias("end")))

    def merge(batches):
        for batch in batches:
            out = []
            for row in batch.column("all").to_pylist():
                a = np.array([(x["pos"], x["end"]) for x in row], np.int64) & 0x7FFFFFFF
                a = a[np.argsort(a[:, 0], kind="stable")]
                reach = np.maximum.accumulate(a[:, 1])
                new = np.append(True, a[1:, 0] > reach[:-1])
                out.append([{"start": s, "end": e} for s, e in
                            zip(a[new, 0].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)].tolist())])
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_no"),
                                   pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                                  names=["doc_id", "text_no", "spans"])

    text_no = F.shiftright("pos", 31).alias("text_no")
    out = store(spans.groupBy("doc_id", text_no).agg(F.collect_list(F.struct("pos", "end")).alias("all")).mapInArrow(
        lean(merge), "doc_id long, text_no long, spans array<struct<start:long,end:long>>"))
    discard(first, table)
    return out


def kept_bytes(text: str | None, spans: list[dict] | None) -> bytes:
    raw = (text or "").encode()
    if not spans:
        return raw
    edges = [0] + [x for s in spans for x in (s["start"], s["end"])] + [len(raw)]
    return b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, spans: DataFrame, columns: list[str], own: str) -> DataFrame:
    """The named columns of all rows and, as `own`, the spans of the row (NULL if it loses nothing)."""
    d, s = docs.alias("d"), spans.select("doc_id", "text_no", F.col("spans").alias(own)).alias("s")
    number = F.crc32(F.encode(F.col("d.text"), "UTF-8")).bitwiseAND(F.lit(0x7FFFFFFF)) + 1  # as `text_number`
    mine = (F.col("d.doc_id") == F.col("s.doc_id")) & ((F.col("s.text_no") == 0) | (F.col("s.text_no") == number))
    return d.join(s, mine, "left").select(*[F.col(f"d.`{c}`") for c in columns], f"s.{own}")


def digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            rows = []
            for text, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                kept = kept_bytes(text, s)
                n = len((text or "").encode())
                rows.append((n, n - len(kept), len(s or ()), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()])]],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select("doc_id", "text"), spans, ["doc_id", "text"], "spans").mapInArrow(
        lean(digest), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with their spans cut out, all columns kept; a character cut in two goes whole."""
    names = docs.columns
    own = "_spans"
    while own in names:
        own += "_"

    def cut(batches):
        for batch in batches:
            text = [t if not s else kept_bytes(t, s).decode(errors="ignore")
                    for t, s in zip(batch.column("text").to_pylist(), batch.column(own).to_pylist())]
            yield pa.record_batch([pa.array(text, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    return with_spans(docs, spans, names, own).mapInArrow(lean(cut), docs.schema)
