"""Graph metrics over many graphs at once.

A graph is named by its key columns (a recording, a density, a null replicate).
``edges`` holds each undirected edge once, as src < dst; ``nodes`` holds every node,
isolated ones included, because averages are over all nodes. Every loop below runs
over all graphs in one job per round, never graph by graph.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import md5
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointproc.session import cut_lineage, wide


def threshold_graph(weights: DataFrame, thresholds: DataFrame, keys: Sequence[str],
                    on: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Edges strictly above the threshold: keys, src, dst."""
    return (weights.join(thresholds, list(on)).filter(F.col("w") > F.col("threshold"))
            .select(*keys, F.col("i").alias("src"), F.col("j").alias("dst")))


def both_ways(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.select(*keys, F.explode(F.array(
        F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    ).select(*keys, "e.src", "e.dst")


def degrees(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, node, degree (0 for isolated nodes)."""
    deg = both_ways(edges, keys).groupBy(*keys, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(deg, [*keys, "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def density(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    possible = F.greatest(F.col("n_nodes") * (F.col("n_nodes") - 1) / 2, F.lit(1.0))
    return n.join(m, list(keys), "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0))).withColumn(
        "density", F.col("n_edges") / possible)


def degree_stats(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return degrees(nodes, edges, keys).groupBy(*keys).agg(
        F.avg("degree").alias("degree_mean"), F.stddev_samp("degree").alias("degree_std"))


def triangles(edges: DataFrame, degree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each triangle once, as keys, a, b, c.

    Edges point from the end of lower degree to the other, so a hub lists no pairs
    of neighbours: a node has at most sqrt(2m) outgoing edges.
    """
    keys = list(keys)
    d1 = degree.select(*keys, F.col("node").alias("src"), F.col("degree").alias("ds"))
    d2 = degree.select(*keys, F.col("node").alias("dst"), F.col("degree").alias("dd"))
    e = edges.join(d1, [*keys, "src"]).join(d2, [*keys, "dst"])
    up = F.struct("ds", "src") < F.struct(F.col("dd").alias("ds"), F.col("dst").alias("src"))
    out = e.select(*keys, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"),
                   F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    other = out.select(*keys, "a", F.col("b").alias("c"))
    wedge = out.join(other, [*keys, "a"]).filter("b < c")
    closing = edges.select(*keys, F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedge.join(closing, [*keys, "b", "c"]).select(*keys, "a", "b", "c")


def clustering(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean local clustering over all nodes; nodes of degree below 2 count as 0."""
    keys = list(keys)
    deg = degrees(nodes, edges, keys)
    tri = triangles(edges, deg, keys)
    per = tri.select(*keys, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("tri"))
    k = F.col("degree")
    local = F.when(k >= 2, 2.0 * F.coalesce("tri", F.lit(0)) / (k * (k - 1))).otherwise(0.0)
    return deg.join(per, [*keys, "node"], "left").groupBy(*keys).agg(F.avg(local).alias("clustering_mean"))


def hop_distances(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All-pairs hop counts between different connected nodes: keys, source, node, d.

    A bit-parallel search: a row (node, block) holds one bit for each of the 64
    sources whose number lies in the block, so a hop moves words, not pairs, and
    what is new is a word with the bits known before taken out. All graphs advance
    in one round; the rounds stop after the largest diameter. A node's words number
    as many as there are blocks with sources; pairs are only listed in the result.
    """
    keys = list(keys)
    step = cut_lineage(both_ways(edges, keys))
    onward = step.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next"))
    word = F.expr("shiftleft(1L, CAST(pmod(node, 64) AS INT))")
    none = F.lit(0).cast("bigint")
    state = step.select(*keys, F.col("src").alias("node")).distinct().select(
        *keys, "node", F.shiftright(F.col("node").cast("bigint"), 6).alias("block"), word.alias("seen"), word.alias("fresh"))
    levels, d = [], 0
    while True:
        d += 1
        sent = state.filter("fresh <> 0").join(onward, [*keys, "node"]).select(
            *keys, F.col("next").alias("node"), "block", none.alias("seen"), F.col("fresh").alias("heard"))
        heard = state.select(*keys, "node", "block", "seen", none.alias("heard")).unionAll(sent).groupBy(
            *keys, "node", "block").agg(F.bit_or("seen").alias("seen"), F.bit_or("heard").alias("heard"))
        state = cut_lineage(heard.select(*keys, "node", "block", F.col("seen").bitwiseOR(F.col("heard")).alias("seen"),
                                         F.col("heard").bitwiseAND(F.bitwise_not("seen")).alias("fresh")))
        level = state.filter("fresh <> 0")
        if levels and level.isEmpty():
            break
        levels.append(level.select(*keys, "node", "block", "fresh", F.lit(d).alias("d")))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionAll(level)
    kind = edges.schema["src"].dataType
    bits = F.expr("explode(filter(sequence(0, 63), b -> shiftright(fresh, b) & 1L = 1L))")
    return found.select(*keys, "block", bits.alias("bit"), "node", "d").select(
        *keys, (F.col("block") * 64 + F.col("bit")).cast(kind).alias("source"), F.col("node").cast(edges.schema["dst"].dataType).alias("node"), "d")


#: Ways in which the links of one node are split, so that a node of very many is not met by one task.
SPLIT = 64


def _least_linked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, a, b) with m, the least b of their a. A hot a is met by ``SPLIT`` tasks, in the join too."""
    cells = rows.withColumn("_cell", F.pmod(F.xxhash64("b"), F.lit(SPLIT)))
    part = cells.groupBy(*keys, "a", "_cell").agg(F.min("b").alias("m"))
    whole = part.groupBy(*keys, "a").agg(F.min("m").alias("m"))
    told = part.drop("m").join(whole, [*keys, "a"])  # at most SPLIT rows for a node
    return cells.join(told, [*keys, "a", "_cell"]).drop("_cell")


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Connected components: keys, node, component (its lowest node).

    Alternating large and small stars: links run from a node to a lower one; a node
    first hands its higher neighbours to its least one, then its lower ones. Rounds
    end when one changes no link. Nodes without links are their own component.
    """
    keys = list(keys)
    links = cut_lineage(edges.filter("src <> dst").select(
        *keys, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))
    before, now = None, links.agg(F.count(F.lit(1)), mark).first()
    while now != before and now[0]:
        both = links.unionAll(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least_linked(both, keys).filter("b > a").select(
            *keys, F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _least_linked(large, keys).select(
            *keys, F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        links = cut_lineage(small.distinct())
        before, now = now, links.agg(F.count(F.lit(1)), mark).first()
    found = links.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.select(*keys, "node").join(found, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def numbered_components(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Component numbers 1, 2, ... in the order of their first node, and sizes."""
    keys = list(keys)
    sizes = labels.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("component"))
    return sizes.withColumn("number", rank)


def path_metrics(nodes: DataFrame, distances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Characteristic path length of the largest component, and global efficiency.

    Components follow from the distances: a node's component is the least node it
    reaches, itself included. Ties in size go to the component met first.
    """
    keys = list(keys)
    per_node = distances.groupBy(*keys, F.col("source").alias("node")).agg(
        F.min("node").alias("least"), F.sum("d").alias("sum_d"), F.count(F.lit(1)).alias("n_d"),
        F.sum(1.0 / F.col("d")).alias("inv"))
    rows = nodes.join(per_node, [*keys, "node"], "left").withColumn(
        "component", F.least("node", "least"))
    comp = rows.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("size"), F.sum("sum_d").alias("sum_d"), F.sum("n_d").alias("n_d"),
        F.sum("inv").alias("inv"))
    n = F.col("n_nodes")
    return (
        comp.groupBy(*keys).agg(
            F.max(F.struct("size", (-F.col("component")).alias("first"), "sum_d", "n_d")).alias("big"),
            F.sum("size").alias("n_nodes"), F.sum("inv").alias("inv"), F.count(F.lit(1)).alias("n_components"))
        .select(*keys, (F.col("big.sum_d") / F.col("big.n_d")).alias("path_length"),
                F.when(n >= 2, F.coalesce("inv", F.lit(0.0)) / (n * (n - 1))).alias("efficiency"),
                "n_components", F.col("big.size").alias("largest"))
    )


def graph_rows(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per graph: keys, node, src, dst as arrays.

    A graph is one electrode array, whatever the amount of data; its metrics take
    memory in proportion to its nodes and edges, for any numbering.
    """
    keys = list(keys)
    n = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("node").cast("bigint"))).alias("node"))
    e = edges.groupBy(*keys).agg(F.collect_list(F.struct(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))).alias("e"))
    none = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    return n.join(e, keys, "left").select(*keys, "node", F.coalesce(F.col("e.src"), none).alias("src"), F.coalesce(F.col("e.dst"), none).alias("dst"))


def _shape(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[float, float | None, float | None]:
    """Mean clustering, path length in the largest component and global efficiency of nodes 0..n-1.

    A word of 64 sources at a time, one word a node: memory goes with nodes and edges. A
    node's bits after the first hop are its neighbours among the sources, so two
    ends of an edge count their common neighbours by AND and popcount.
    """
    if not len(src):
        return 0.0, None, 0.0 if n >= 2 else None
    tail, head = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.argsort(tail, kind="stable")
    tail, head = tail[order], head[order]
    at = np.flatnonzero(np.append(True, tail[1:] != tail[:-1]))
    linked = tail[at]
    k = np.bincount(tail, minlength=n).astype(float)
    common, sum_d, n_d = np.zeros(len(tail), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    label, reached = np.full(n, -1), []
    for first in range(0, n, 64):
        own = np.arange(first, min(first + 64, n))
        seen = np.zeros(n, np.uint64)
        seen[own] = np.uint64(1) << (own - first).astype(np.uint64)
        front, d = seen.copy(), 0
        while True:
            d += 1
            heard = np.zeros(n, np.uint64)
            heard[linked] = np.bitwise_or.reduceat(front[head], at)
            if d == 1:
                common += np.bitwise_count(heard[tail] & heard[head])
            front = heard & ~seen
            count = np.bitwise_count(front).astype(np.int64)
            total = int(count.sum())
            if not total:
                break
            seen |= front
            sum_d += d * count
            n_d += count
            if d > len(reached):
                reached.append(0)
            reached[d - 1] += total
        here = (label < 0) & (seen != 0)
        label[here] = first + np.bitwise_count((seen[here] & -seen[here]) - np.uint64(1)).astype(np.int64)
    links = np.bincount(tail, common, minlength=n)
    local = np.where(k >= 2, links / np.maximum(k * (k - 1), 1), 0.0)
    big = label == np.bincount(label, minlength=n).argmax()
    pairs = int(n_d[big].sum())
    inverse = float((np.array(reached) / np.arange(1, len(reached) + 1)).sum())
    return float(local.mean()), int(sum_d[big].sum()) / pairs if pairs else None, inverse / (n * (n - 1)) if n >= 2 else None


def _placed(node: list[int], src: list[int], dst: list[int]) -> tuple[np.ndarray, np.ndarray]:
    order = np.array(node)
    return np.searchsorted(order, np.array(src, np.int64)), np.searchsorted(order, np.array(dst, np.int64))


def shape_metrics(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """clustering_mean, path_length and efficiency per graph, each graph in its row.

    Same values as ``clustering`` and ``path_metrics``, which join instead.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_shape(len(n), *_placed(n, s, d)) for n, s, d in zip(*(batch.column(c).to_pylist() for c in ("node", "src", "dst")))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.record_batch([*(batch.column(k) for k in keys), *(pa.array(c, pa.float64()) for c in cols)],
                                  names=[*keys, "clustering_mean", "path_length", "efficiency"])

    return wide(graph_rows(nodes, edges, keys), *keys).mapInArrow(run, _keyed(nodes, keys, "clustering_mean double, path_length double, efficiency double"))


def _keyed(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    """Schema text of the key columns and some others."""
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def modularity(nodes: DataFrame, edges: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q of a given partition ``labels`` (keys, node, community); NULL without edges."""
    keys = list(keys)
    deg = degrees(nodes, edges, keys).join(labels, [*keys, "node"])
    k = deg.groupBy(*keys, "community").agg(F.sum("degree").alias("k"))
    src = labels.select(*keys, F.col("node").alias("src"), F.col("community").alias("cs"))
    dst = labels.select(*keys, F.col("node").alias("dst"), F.col("community").alias("cd"))
    e = edges.join(src, [*keys, "src"]).join(dst, [*keys, "dst"]).filter("cs = cd").groupBy(
        *keys, F.col("cs").alias("community")).agg(F.count(F.lit(1)).alias("e"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    frac = F.col("k") / (2.0 * F.col("m"))
    return k.join(e, [*keys, "community"], "left").join(m, keys, "left").groupBy(*keys).agg(
        F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - frac * frac).alias("modularity"),
        F.count(F.lit(1)).alias("n_communities"))


def _merge_communities(src: np.ndarray, dst: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Greedy merging of one graph; returns each node's community (its lowest node).

    Only linked communities can gain, so links between communities are kept as one
    dictionary a community and the gains in a heap whose outdated entries are passed
    over. Equal gains (to 1e-12) go to the pair of lowest places.
    """
    n = len(node)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for s, d in zip(np.searchsorted(node, src).tolist(), np.searchsorted(node, dst).tolist()):
        links[s][d] = links[d][s] = 1.0
    k = [float(len(x)) for x in links]
    m = sum(k) / 2
    owner, version, heap = list(range(n)), [0] * n, []

    def offer(p: int, q: int) -> None:
        gain = np.rint((links[p][q] / m - k[p] * k[q] / (2 * m * m)) * 1e12)
        if gain > 0:
            p, q = min(p, q), max(p, q)
            heappush(heap, (-gain, p, q, version[p], version[q]))

    for p in range(n):
        for q in links[p]:
            if p < q:
                offer(p, q)
    while heap:
        _, p, q, at_p, at_q = heappop(heap)
        if version[p] != at_p or version[q] != at_q:
            continue
        del links[p][q]
        for x, w in links[q].items():
            if x != p:
                links[p][x] = links[x][p] = links[p].get(x, 0.0) + w
                del links[x][q]
        links[q] = {}
        k[p] += k[q]
        version[p] += 1
        version[q] += 1
        owner[q] = p
        for x in links[p]:
            offer(p, x)
    for v in range(n):  # an owner is lower than what it took, so it is settled already
        owner[v] = owner[owner[v]]
    return node[owner]


def greedy_communities(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy modularity merging: keys, node, community.

    Merge by merge and order-dependent within a graph, so no set operation speeds it
    up; across graphs it is one grouped map. A group is one electrode array, whatever
    the amount of data, and takes memory in proportion to its nodes and edges.
    """
    keys = list(keys)
    rows = nodes.select(*keys, F.col("node").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(
        edges.select(*keys, F.col("src").cast("int").alias("a"), F.col("dst").cast("int").alias("b")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        link = pdf[pdf["b"].notna()]
        node = np.sort(pdf.loc[pdf["b"].isna(), "a"].to_numpy())
        comm = _merge_communities(link["a"].to_numpy(), link["b"].astype("int64").to_numpy(), node)
        out = pd.DataFrame({"node": node, "community": comm})
        for key in reversed(keys):
            out.insert(0, key, pdf[key].iloc[0])
        return out

    fields = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([f"{k} {fields[k]}" for k in keys] + ["node int", "community int"])
    return rows.groupBy(*keys).applyInPandas(solve, schema)


def _random_edges(name: str, seed: int, replicate: int, node: list[int], m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m node pairs of lowest hash, as places: a uniform draw without replacement."""
    x, y, ends = _pair_names(tuple(node))
    head = f"{seed}|{name}|{replicate}".encode()
    # the first 15 hex digits are the upper 60 bits
    h = np.frombuffer(b"".join([md5(head + end).digest() for end in ends]), ">u8")[::2] >> 4
    pick = np.argsort(h, kind="stable")[:m]
    return x[pick], y[pick]


@lru_cache(maxsize=4)
def _pair_names(node: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All pairs of places, and how each ends the text that is hashed; the replicates of a graph share them."""
    x, y = np.triu_indices(len(node), 1)
    return x, y, [f"|{node[p]}|{node[q]}".encode() for p, q in zip(x.tolist(), y.tolist())]


def _replicates(nodes: DataFrame, edges: DataFrame, keys: list[str], replicates: int) -> DataFrame:
    """A row per graph and replicate, spread over the cluster; graphs without edges have none."""
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    rows = graph_rows(nodes, edges, keys).filter(F.size("src") > 0).select(*keys, name.alias("_name"), "node", F.size("src").alias("m"))
    return wide(rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(int(replicates))))), *keys, "replicate")


def random_graphs(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], replicates: int,
                  seed: int) -> DataFrame:
    """Random graphs with the same nodes and edge count: keys, replicate, src, dst. Each is drawn in its row."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (name, node, m, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_name", "node", "m", "replicate")))):
                x, y = _random_edges(name, seed, r, node, m)
                node = np.array(node)
                same = pa.array(np.full(len(x), at))
                yield pa.record_batch([*(batch.column(k).take(same) for k in [*keys, "replicate"]), pa.array(node[x]), pa.array(node[y])],
                                      names=[*keys, "replicate", "src", "dst"])

    return _replicates(nodes, edges, keys, replicates).mapInArrow(run, _keyed(nodes, keys, "replicate int, src bigint, dst bigint"))


def small_worldness(nodes: DataFrame, edges: DataFrame, observed: DataFrame, keys: Sequence[str],
                    replicates: int, seed: int) -> DataFrame:
    """(C / mean C of the random graphs) / (L / mean L of the random graphs).

    A random graph is drawn and measured in its row and only its two values leave it.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_shape(len(node), *_random_edges(name, seed, r, node, m))[:2]
                    for name, node, m, r in zip(*(batch.column(c).to_pylist() for c in ("_name", "node", "m", "replicate")))]
            cols = list(zip(*rows)) or [(), ()]
            yield pa.record_batch([*(batch.column(k) for k in keys), *(pa.array(c, pa.float64()) for c in cols)], names=[*keys, "c", "l"])

    rand = _replicates(nodes, edges, keys, replicates).mapInArrow(run, _keyed(nodes, keys, "c double, l double")).groupBy(*keys).agg(
        F.avg("c").alias("c_rand"), F.avg("l").alias("l_rand"))
    ok = (F.col("c_rand") != 0) & (F.col("l_rand") != 0)
    sigma = F.when(ok, (F.col("clustering_mean") / F.col("c_rand")) / (F.col("path_length") / F.col("l_rand")))
    return observed.join(rand, keys, "left").select(*keys, sigma.alias("small_worldness"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], null_n: int = 100,
                  null_seed: int = 1) -> DataFrame:
    """All graph metrics, one row per graph."""
    keys = list(keys)
    nodes, edges = cut_lineage(nodes.select(*keys, "node")), cut_lineage(edges.select(*keys, "src", "dst"))
    out = density(nodes, edges, keys).join(degree_stats(nodes, edges, keys), keys)
    out = out.join(shape_metrics(nodes, edges, keys), keys)
    parts = cut_lineage(greedy_communities(nodes, edges, keys))
    out = cut_lineage(out.join(modularity(nodes, edges, parts, keys), keys))
    if null_n > 0:
        sigma = small_worldness(nodes, edges, out, keys, null_n, null_seed)
        return out.join(sigma, keys, "left")
    return out.withColumn("small_worldness", F.lit(None).cast("double"))


METRICS = ("density", "clustering_mean", "path_length", "small_worldness", "efficiency", "modularity")


def long_metrics(metrics: DataFrame, keys: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """One row per (keys, metric) with its value."""
    return metrics.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")
    ).select(*keys, "x.metric", "x.value")


def paired_metrics(long: DataFrame, recordings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Baseline and treatment value of each metric per pair, as observations."""
    rows = long.join(recordings.select("recording_id", "study", "pair_no", "condition"), "recording_id")
    by = ["study", "pair_no", *keys, "metric"]
    at = F.col("condition") == "baseline"
    return rows.groupBy(*by).agg(F.max(F.when(at, F.col("value"))).alias("b"),
                                 F.max(F.when(~at, F.col("value"))).alias("t")).withColumn(
        "delta", F.col("t") - F.col("b"))
