"""The n-gram join against all pairs, and its parts."""

import random
import re

import numpy as np

from pointproc.llm import ngram_join
from pointproc.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
    out = {}
    for a in sets:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (min(seen), len(links[a]))
    return out


def sample(seed, groups=12, big=150):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(300)]
    rows, common = [], " ".join(r.choice(words) for _ in range(40))

    def edited(base, k):
        w = base.split(" ")
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w)

    for g in range(groups):
        base = " ".join(r.choice(words) for _ in range(r.randint(20, 200)))
        if g % 3 == 0:
            base = common + " " + base
        for _ in range(big if g == 0 else r.randint(1, 6)):
            rows.append(edited(base, r.randint(0, 4)))
    rows += [rows[0]] * 20 + ["one two", "one two", "x", "", None, "a b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 8)  # large nodes, pivots and tiles
    monkeypatch.setattr(ngram_join, "TILE", 32)
    for seed in (1, 2):
        rows = sample(seed)
        docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component string").repartition(4)
        got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
        assert got == brute(rows)


def off_centre(pairs, crowd, seed=5):
    """A crowd around one class, and pairs of similar classes of which only one is near that class: tokens by id."""
    r = np.random.default_rng(seed)

    def like(sig, share):
        return np.where(r.random(ngram_join.TOKENS) < share, sig, r.integers(0, 1 << 32, ngram_join.TOKENS)).astype(np.uint32)

    centre = r.integers(0, 1 << 32, ngram_join.TOKENS).astype(np.uint32)
    rows = [centre] + [like(centre, 0.92) for _ in range(crowd)]
    for _ in range(pairs):
        near = like(centre, 0.80)
        rows += [near, like(near, 0.82)]
    return rows


def test_pairs_beside_a_crowd_meet(spark):
    rows = off_centre(300, 400)
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(rows)], "rep long, tokens binary").repartition(4)
    group = {r.node: r.component for r in components(ngram_join.candidate_links(reps)).collect()}
    alike = [(b, b + 1) for b in range(401, len(rows), 2) if (rows[b] == rows[b + 1]).mean() >= 0.8]
    lost = [b for b, c in alike if group.get(b, b) != group.get(c, c)]
    assert len(alike) > 150 and len(lost) <= 0.01 * len(alike)


def test_one_of_each_and_empty(spark):
    rows = sample(3, 4, 5)
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (c, _) in brute(rows).items() if i == c}
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert {(r.doc_id, r.n_links, r.kept) for r in ngram_join.near_duplicates(odd).collect()} == {(None, 0, True), (1, 0, True)}
    assert ngram_join.one_of_each(odd).count() == 3


def test_overlaps():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3, 4, 9], [7], [])]
    assert ngram_join.overlaps(sets)[:2, :2].tolist() == [[2, 2], [2, 2]]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}
