"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; two are linked if their Jaccard similarity
is at least `THRESHOLD`. Documents of equal sets form a class and go on as one.

* Chosen paths: a class is a vector of min-hashes, its sampled tokens. A node of the
  tree picks a few coordinates by its own dice (each with a chance that makes 1 /
  threshold on average), and a class goes on to a child for each, named by the token
  it has there: classes that share tokens meet again. Nodes of up to `SMALL` classes
  are compared outright. In a larger node each class is first compared with one
  that a hash picks there, which settles a large group of copies without pairs; the
  others split again. Each node picks its own: a pair parted by one is met by another. What is still large at the last level is compared in tiles.
  Runs with other dice repeat this until the recall aimed at is met.
* These comparisons use sketches and a threshold lowered by `SLACK`; they only say
  which classes belong to one candidate group.
* Verification: inside a candidate group all sets are compared exactly, in tiles, so
  each pair once. A tile returns counts of links and a spanning forest, not pairs.

Words are runs of anything but blanks. A text of one to four words is a single
shingle. Missing texts and texts without words link with nothing, nor do rows
without an id. Rows with equal ids count as one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointproc.llm.common import BYTE_CODE, heads, lean, mix, pieces
from pointproc.llm.components import components
from pointproc.llm.tiles import roots, tile_rows
from pointproc.session import discard, store

THRESHOLD = 0.8
SHINGLE = 5
#: Sampled tokens of a class, and how far below the threshold their agreement may lie.
TOKENS, SLACK = 96, 0.15
SMALL, LEVELS, RECALL = 64, 3, 0.99
TILE = 128
_SET_BITS = np.uint64(44)

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)


def shingle_sets(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents lo..hi of a column: their shingles as 44-bit hashes, sorted and distinct, and where each set begins."""
    for lo, hi, b in pieces(text):
        start, end, doc = b.words()
        w = b.ranges(start, end)
        many = np.bincount(doc, minlength=hi - lo)
        n = len(w) - SHINGLE + 1
        if n > 0:
            h = np.zeros(n, np.uint64)
            for j in range(SHINGLE):
                h += w[j:j + n] * _PLACE[j]
            inside = doc[:n] == doc[SHINGLE - 1:]
            h, of = mix(h[inside]), doc[:n][inside]
        else:
            h, of = np.empty(0, np.uint64), np.empty(0, np.int64)
        few = np.flatnonzero((many > 0) & (many < SHINGLE))
        if len(few):
            first = np.searchsorted(doc, few)
            short = np.array([mix((w[a:a + many[d]] * _PLACE[1:many[d] + 1]).sum(dtype=np.uint64, keepdims=True))[0]
                              for a, d in zip(first, few)], np.uint64)
            h, of = np.concatenate([h, short]), np.concatenate([of, few])
        base = of.astype(np.uint64) << _SET_BITS
        key = np.unique(base | (h >> np.uint64(64 - 44)))
        of = (key >> _SET_BITS).astype(np.int64)
        yield lo, hi, key & np.uint64((1 << 44) - 1), np.searchsorted(of, np.arange(hi - lo + 1))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_key (equal for equal sets), tokens (min-hashes, 4 bytes each); only documents with words."""

    def sketch(batches):
        for batch in batches:
            for lo, hi, h, at in shingle_sets(batch.column("text")):
                n = np.diff(at)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                begin = at[:-1][some]
                sig = np.empty((len(some), TOKENS), np.uint32)
                for t in range(TOKENS):
                    v = h * _MULTIPLY[t]
                    sig[:, t] = np.minimum.reduceat((v ^ (v >> np.uint64(31))) >> np.uint64(32), begin)
                one = np.add.reduceat(mix(h), begin)
                two = np.add.reduceat(mix(h ^ BYTE_CODE[0]), begin)
                keys = np.stack([one, two, n[some].astype(np.uint64)], 1)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some]),
                                       pa.array([x.tobytes() for x in keys], pa.binary()),
                                       pa.array([x.tobytes() for x in sig], pa.binary())],
                                      names=["doc_id", "n", "set_key", "tokens"])

    return docs.mapInArrow(lean(sketch), "doc_id long, n long, set_key binary, tokens binary")


def runs_for(recall: float, levels: int) -> int:
    """Runs until a pair at the threshold meets with this chance: at worst it must live through all levels.

    A node has 1 / threshold children on average and the pair shares each with the
    threshold as its chance, so the pair's own tree is a branching process of mean 1.
    """
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def chosen(nodes: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and child node for each coordinate that a row's node picks."""
    t = np.arange(TOKENS, dtype=np.uint64)
    dice = mix(nodes[:, None] + t * np.uint64(0xA24BAED4963EE407)) >> np.uint64(40)
    row, coordinate = np.nonzero(dice < int((1 << 24) / (threshold * TOKENS)))
    child = mix(nodes[row] * np.uint64(0x9FB21C651E98DF25) + (sig[row, coordinate].astype(np.uint64) << np.uint64(8)) + t[coordinate])
    return row, child


def _split(rows: DataFrame, threshold: float, runs: int = 0) -> DataFrame:
    """rep, tokens, node of the next level; `runs` roots if the rows have no node yet."""

    def split(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sig = np.frombuffer(b"".join(part.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
                if runs:
                    got = [chosen(mix(np.full(len(sig), 0x51ED27 + r, np.uint64)), sig, threshold) for r in range(runs)]
                    row, child = (np.concatenate(x) for x in zip(*got))
                else:
                    row, child = chosen(part.column("node").to_numpy().astype(np.uint64), sig, threshold)
                yield pa.record_batch([part.column("rep").take(pa.array(row)), pa.array(child.astype(np.int64))], names=["rep", "node"])

    return rows.mapInArrow(lean(split), "rep long, node long")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def _compare_small(rows: DataFrame, least: float) -> DataFrame:
    """a, b: links inside nodes; rows (node, rep, sketch) are sorted by node within partitions."""

    def flush(node, rep, sketch):
        a_all, b_all = [], []
        size = np.diff(np.append(np.flatnonzero(heads(node)), len(node)))
        for shift in range(1, int(size.max())):
            a = np.flatnonzero(node[shift:] == node[:-shift])
            for lo in range(0, len(a), 1 << 16):
                i = a[lo:lo + (1 << 16)]
                i = i[agreement(sketch[i], sketch[i + shift]) >= least]
                a_all.append(i)
                b_all.append(i + shift)
        if a_all:
            root = roots(len(node), np.concatenate(a_all), np.concatenate(b_all))
            i = np.flatnonzero((root != np.arange(len(node))) & (rep != rep[root]))
            if len(i):
                yield pa.record_batch([pa.array(rep[i]), pa.array(rep[root[i]])], names=["a", "b"])

    def compare(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column("node").to_numpy(), batch.column("rep").to_numpy(),
                   np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS))
            if held:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            whole = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on
            if whole:
                yield from flush(*(x[:whole] for x in now))
            held = tuple(x[whole:] for x in now)
        if held:
            yield from flush(*held)

    return rows.sortWithinPartitions("node").select("node", "rep", "sketch").mapInArrow(lean(compare), "a long, b long")


def candidate_links(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """a, b: links that join every class with those it may be similar to, directly or by others.

    reps: rep, tokens.
    """
    spark = reps.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = threshold - SLACK

    def cut(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            yield pa.record_batch([batch.column("rep"), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())],
                                  names=["rep", "sketch"])

    sketched = store(reps.select("rep", "tokens").mapInArrow(lean(cut), "rep long, sketch binary"))
    paths = _split(reps, threshold, runs_for(recall, LEVELS))
    found = []
    for level in range(1, LEVELS + 1):
        paths = store(paths)
        sizes = paths.groupBy("node").agg(F.count("*").alias("m"), F.min_by("rep", F.xxhash64("node", "rep")).alias("pivot")).where("m > 1")
        sizes = store(sizes)
        rows = paths.join(sizes, "node").join(sketched, "rep")
        small = rows.where(F.col("m") <= SMALL).repartition(width, "node")
        found.append(store(_compare_small(small, least)))
        big = paths.join(sizes.where(F.col("m") > SMALL), "node").join(reps.select("rep", "tokens"), "rep")
        pivots = sizes.where(F.col("m") > SMALL).join(reps.select(F.col("rep").alias("pivot"), F.col("tokens").alias("pivot_tokens")), "pivot")
        big = big.join(pivots.select("node", "pivot_tokens"), "node")
        seen = store(_pivot(big, least))
        found.append(seen.where("linked").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        rest = seen.where("NOT linked")
        discard(sizes)
        if rest.isEmpty():
            break
        rest = rest.join(reps.select("rep", "tokens"), "rep")
        if level == LEVELS:
            found.append(store(_tiles(rest.join(sketched, "rep").select("node", "rep", "sketch"), least, width)))
        else:
            paths = _split(rest.select("node", "rep", "tokens"), threshold)
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.where("a <> b").distinct()


def _pivot(rows: DataFrame, least: float) -> DataFrame:
    """node, rep, pivot, linked: whether a class agrees with the one that a hash picks in its node.

    Each node picks its own, so a pair that one pivot parts meets in other nodes, with or by another pivot.
    """

    def compare(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, TOKENS)
                    for c in ("tokens", "pivot_tokens"))
            linked = agreement(a, b) >= least
            yield pa.record_batch([batch.column("node"), batch.column("rep"), batch.column("pivot"), pa.array(linked)],
                                  names=["node", "rep", "pivot", "linked"])

    return rows.select("node", "rep", "pivot", "tokens", "pivot_tokens").mapInArrow(
        lean(compare), "node long, rep long, pivot long, linked boolean")


def _tiles(rows: DataFrame, least: float, width: int) -> DataFrame:
    tiled = tile_rows(rows, "node", "rep", SMALL).withColumn("node", F.xxhash64("node", "i", "j"))
    return _compare_small(tiled.repartition(width, "node"), least)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, from blocks of a 0/1 matrix."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(common) - 1
    keep = common[column]
    row, column = row[keep], place[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 8192
    edges = np.searchsorted(column, np.arange(0, int(common.sum()) + step, step))
    for k, (a, z) in enumerate(zip(edges, edges[1:])):
        if a < z:
            m = np.zeros((len(sets), step), np.float32)
            m[row[a:z], column[a:z] - k * step] = 1
            out += m @ m.T
    return out


def verify(members: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rep, other, links: counts of documents in linked classes (no other), and links of a spanning forest.

    members: component, rep, copies (documents of the class).
    """
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sets(batches):
        for batch in batches:
            for lo, hi, h, at in shingle_sets(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([part.column("component"), part.column("rep"), part.column("copies"),
                                       pa.array([h[a:z].tobytes() for a, z in zip(at, at[1:])], pa.binary())],
                                      names=["component", "rep", "copies", "shingles"])

    def flush(rows):
        rep = np.array([r[0] for r in rows])
        copies = np.array([r[1] for r in rows])
        block = np.array([r[2] for r in rows])
        i, j = rows[0][4]
        shared = overlaps([r[3] for r in rows])
        n = np.array([len(r[3]) for r in rows])
        union = n[:, None] + n[None, :] - shared
        link = shared >= threshold * union - 1e-9
        np.fill_diagonal(link, False)
        if i != j:
            link &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(link))
        root = roots(len(rows), a, b)
        links = link @ copies
        k = np.flatnonzero(links)
        f = np.flatnonzero(root != np.arange(len(rows)))
        return ([*rep[k], *rep[f]], [None] * len(k) + list(rep[root[f]]), [*links[k], *[0] * len(f)])

    def compare(batches):
        key, rows, out = None, [], ([], [], [])
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("rep", "copies", "block", "shingles", "component", "i", "j")]
            for rep, copies, block, raw, component, i, j in zip(*cols):
                if (component, i, j) != key:
                    if len(rows) > 1:
                        for x, y in zip(out, flush(rows)):
                            x.extend(y)
                    key, rows = (component, i, j), []
                rows.append((rep, copies, block, np.frombuffer(raw, np.uint64), (i, j)))
            if len(out[0]) > 20_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["rep", "other", "links"])
                out = ([], [], [])
        if len(rows) > 1:
            for x, y in zip(out, flush(rows)):
                x.extend(y)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["rep", "other", "links"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep"])
    rows = members.join(texts, "rep").select("component", "rep", "copies", "text").mapInArrow(
        lean(sets), "component long, rep long, copies long, shingles binary")
    return tile_rows(rows, "component", "rep", TILE).repartition(width, "component", "i", "j") \
        .sortWithinPartitions("component", "i", "j").mapInArrow(lean(compare), "rep long, other long, links long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least id of equal sets), component_id, n_links, kept.

    n_links counts all other documents at or above the threshold; kept is true for
    the least id of each component. Rows of documents without words have n_links 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    marks = store(sketches(known).dropDuplicates(["doc_id"]))
    classes = store(marks.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = store(marks.join(classes.select("rep"), marks["doc_id"] == classes["rep"]).select("rep", "tokens"))
    groups = store(components(candidate_links(reps, threshold, recall)))
    members = groups.select("component", F.col("node").alias("rep")).join(classes.select("rep", "copies"), "rep")
    links = store(verify(store(members), known, threshold))
    joined = components(links.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = links.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = store(classes.join(joined, classes["rep"] == joined["node"], "left").join(counts, "rep", "left").select(
        "set_key", classes["rep"].alias("class_id"), F.coalesce("component", classes["rep"]).alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    found = marks.select("doc_id", "set_key").join(per_class, "set_key").drop("set_key")
    out = rows.select("doc_id").distinct().join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents kept, all columns: one of each component; rows without an id stay."""
    gone = near_duplicates(docs, threshold).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
