import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pytest

from pointproc.operators import graph as g

K = ["gid"]


@pytest.fixture
def build(spark):
    def make(graphs):
        nodes = [(name, v) for name, (n, _) in graphs.items() for v in range(1, n + 1)]
        edges = [(name, a, b) for name, (_, es) in graphs.items() for a, b in es]
        return (spark.createDataFrame(nodes, "gid string, node int"),
                spark.createDataFrame(edges, "gid string, src int, dst int"))

    return make


def rand_graph(n, m, seed):
    return n, random.Random(seed).sample(list(itertools.combinations(range(1, n + 1), 2)), m)


def hops(n, edges):
    d = np.full((n + 1, n + 1), np.inf)
    for a, b in edges:
        d[a, b] = d[b, a] = 1
    for v in range(1, n + 1):
        d[v, v] = 0
    for k in range(1, n + 1):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    return d[1:, 1:]


def quality(n, edges, comm):
    m, deg = len(edges), [0] * (n + 1)
    for a, b in edges:
        deg[a] += 1
        deg[b] += 1
    inside = sum(comm[a] == comm[b] for a, b in edges)
    return inside / m - sum((sum(deg[v] for v in comm if comm[v] == c) / (2 * m)) ** 2 for c in set(comm.values()))


def greedy(n, edges):
    comm = {v: v for v in range(1, n + 1)}
    q = quality(n, edges, comm)
    while True:
        best, pick = 0, None
        for a, b in itertools.combinations(sorted(set(comm.values())), 2):
            trial = {v: (a if c == b else c) for v, c in comm.items()}
            gain = round(quality(n, edges, trial) - q, 12)
            if gain > best:
                best, pick = gain, (a, b)
        if not pick:
            return comm, q
        comm = {v: (pick[0] if c == pick[1] else c) for v, c in comm.items()}
        q = quality(n, edges, comm)


def test_triangle_and_isolated_node(build):
    nodes, edges = build({"t": (4, [(1, 2), (1, 3), (2, 3)])})
    m = g.graph_metrics(nodes, edges, K, null_n=3).first()
    assert m["density"] == 0.5 and m["n_edges"] == 3
    assert m["clustering_mean"] == pytest.approx(0.75)
    assert m["path_length"] == pytest.approx(1.0)
    assert m["efficiency"] == pytest.approx(0.5)
    assert m["degree_mean"] == 1.5


def test_two_disjoint_edges(build):
    nodes, edges = build({"p": (4, [(1, 2), (3, 4)]), "none": (3, [])})
    parts = g.greedy_communities(nodes, edges, K)
    got = {r["gid"]: r for r in g.modularity(nodes, edges, parts, K).collect()}
    assert got["p"]["modularity"] == pytest.approx(0.5) and got["p"]["n_communities"] == 2
    assert got["none"]["modularity"] is None and got["none"]["n_communities"] == 3


def test_random_graphs_match_brute_force(build):
    graphs = {f"g{s}": rand_graph(12, m, s) for s, m in enumerate((4, 11, 18, 40))}
    nodes, edges = build(graphs)
    dist = g.hop_distances(edges, K)
    seen = {}
    for r in dist.collect():
        seen[r["gid"], r["source"], r["node"]] = r["d"]
    paths = {r["gid"]: r for r in g.path_metrics(nodes, dist, K).collect()}
    clus = {r["gid"]: r["clustering_mean"] for r in g.clustering(nodes, edges, K).collect()}
    labels = g.components(nodes, edges, K)
    comp = {(r["gid"], r["node"]): r["component"] for r in labels.collect()}
    comm = {(r["gid"], r["node"]): r["community"] for r in g.greedy_communities(nodes, edges, K).collect()}
    for name, (n, es) in graphs.items():
        d = hops(n, es)
        finite = {(a + 1, b + 1): d[a, b] for a in range(n) for b in range(n) if a != b and np.isfinite(d[a, b])}
        assert finite == {(s, t): v for (gid, s, t), v in seen.items() if gid == name}
        want_comp = {v: 1 + int(np.argmax(np.isfinite(d[v - 1]))) for v in range(1, n + 1)}
        assert want_comp == {v: comp[name, v] for v in want_comp}
        sizes = {}
        for v, c in want_comp.items():
            sizes.setdefault(c, []).append(v)
        big = max(sizes.items(), key=lambda kv: (len(kv[1]), -kv[0]))[1]
        inner = [d[a - 1, b - 1] for a in big for b in big if a != b]
        assert paths[name]["path_length"] == pytest.approx(np.mean(inner))
        inv = sum(1 / v for v in finite.values())
        assert paths[name]["efficiency"] == pytest.approx(inv / (n * (n - 1)))
        adj = (d == 1).astype(int)
        k = adj.sum(1)
        tri = np.diag(adj @ adj @ adj) / 2
        assert clus[name] == pytest.approx(np.mean([2 * t / (q * (q - 1)) if q > 1 else 0 for t, q in zip(tri, k)]))
        want, _ = greedy(n, es)
        assert want == {v: comm[name, v] for v in want}


def test_hub_triangles(build):
    star = [(1, v) for v in range(2, 41)] + [(2, 3), (39, 40)]
    nodes, edges = build({"s": (40, star)})
    got = {tuple(sorted((r["a"], r["b"], r["c"]))) for r in g.triangles(edges, g.degrees(nodes, edges, K), K).collect()}
    assert got == {(1, 2, 3), (1, 39, 40)}


def test_null_graphs_and_small_worldness(build):
    graphs = {"a": rand_graph(15, 30, 1), "b": rand_graph(10, 12, 2), "empty": (5, [])}
    nodes, edges = build(graphs)
    null = g.random_graphs(nodes, edges, K, 4, 1)
    counts = {(r["gid"], r["replicate"]): r["count"] for r in null.groupBy("gid", "replicate").count().collect()}
    assert counts == {**{("a", k): 30 for k in range(1, 5)}, **{("b", k): 12 for k in range(1, 5)}}
    assert null.distinct().count() == null.count() and null.filter("src >= dst").isEmpty()
    m = {r["gid"]: r for r in g.graph_metrics(nodes, edges, K, null_n=4).collect()}
    assert m["a"]["small_worldness"] > 0 and m["empty"]["small_worldness"] is None


def test_rows_agree_with_joins(build):
    graphs = {f"g{s}": rand_graph(n, m, s) for s, (n, m) in enumerate([(70, 200), (63, 40), (20, 190), (8, 3)])}
    graphs["none"] = (4, [])
    graphs["pair"] = (63, [(62, 63)])
    nodes, edges = build(graphs)
    masks = {r["gid"]: r for r in g.shape_metrics(nodes, edges, K).collect()}
    paths = {r["gid"]: r for r in g.path_metrics(nodes, g.hop_distances(edges, K), K).collect()}
    clus = {r["gid"]: r["clustering_mean"] for r in g.clustering(nodes, edges, K).collect()}
    assert set(masks) == set(graphs)
    for name, m in masks.items():
        assert m["clustering_mean"] == pytest.approx(clus[name])
        assert m["efficiency"] == pytest.approx(paths[name]["efficiency"])
        assert (m["path_length"] is None) == (paths[name]["path_length"] is None)
        if m["path_length"] is not None:
            assert m["path_length"] == pytest.approx(paths[name]["path_length"])


def test_a_star_and_a_chain_are_components(build, spark):
    n = 20_000
    nodes = spark.range(1, 2 * n + 4).select(g.F.lit("g").alias("gid"), g.F.col("id").cast("int").alias("node"))
    star = spark.range(2, n + 1).select(g.F.lit("g").alias("gid"), g.F.lit(1).alias("src"), g.F.col("id").cast("int").alias("dst"))
    chain = spark.range(n + 1, n + 200).select(g.F.lit("g").alias("gid"), g.F.col("id").cast("int").alias("src"), (g.F.col("id") + 1).cast("int").alias("dst"))
    labels = g.components(nodes, star.unionAll(chain), K)
    sizes = {r["component"]: r["count"] for r in labels.groupBy("component").count().collect()}
    assert sizes.pop(1) == n and sizes.pop(n + 1) == 200
    assert len(sizes) == n - 197 and set(sizes.values()) == {1}
    assert labels.count() == 2 * n + 3
    # the hub's links are met in shares of about equal size
    met = star.select("gid", g.F.col("src").alias("a"), g.F.col("dst").alias("b"))
    shares = [r["count"] for r in met.groupBy(g.F.pmod(g.F.xxhash64("b"), g.F.lit(g.SPLIT))).count().collect()]
    assert len(shares) == g.SPLIT and max(shares) < 3 * sorted(shares)[len(shares) // 2]
    assert g._least_linked(met, K).filter("m <> 2").isEmpty() and g._least_linked(met, K).count() == n - 1


def test_hops_with_any_node_numbers(spark):
    rows = [("x", -70, 5), ("x", 5, 1000), ("x", 64, 1000), ("y", 63, 64)]
    edges = spark.createDataFrame(rows, "gid string, src int, dst int")
    got = {(r["gid"], r["source"], r["node"]): r["d"] for r in g.hop_distances(edges, K).collect()}
    path = [-70, 5, 1000, 64]
    want = {("x", a, b): abs(i - j) for i, a in enumerate(path) for j, b in enumerate(path) if i != j}
    assert got == {**want, ("y", 63, 64): 1, ("y", 64, 63): 1}
    assert g.hop_distances(edges.limit(0), K).count() == 0


def test_large_graphs_take_memory_by_their_edges():
    n, rnd = 5000, random.Random(3)
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(4 * n)}
    src, dst = np.array(sorted(pairs)).T
    tracemalloc.start()
    found = g._merge_communities(src, dst, np.arange(n))
    merging = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    clustering, path, efficiency = g._shape(n, src, dst)
    shape = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert merging < 60e6 and shape < 60e6  # a matrix of doubles has 200e6 bytes
    assert 2 < len(set(found.tolist())) < n / 10 and (found <= np.arange(n)).all()
    assert 0 < clustering < 0.01 and 3 < path < 6 and 0.1 < efficiency < 0.5


def test_replicates_share_the_names_of_their_pairs():
    node = [3, 7, 12, 40, 41]
    pairs = [(p, q) for p in range(5) for q in range(p + 1, 5)]
    for replicate in (1, 2):
        order = sorted(pairs, key=lambda e: hashlib.md5(f"5|g|0.1|{replicate}|{node[e[0]]}|{node[e[1]]}".encode()).hexdigest()[:15])
        x, y = g._random_edges("g|0.1", 5, replicate, node, 4)
        assert list(zip(x.tolist(), y.tolist())) == order[:4]
    assert g._pair_names.cache_info().maxsize and g._pair_names(tuple(node)) is g._pair_names(tuple(node))
