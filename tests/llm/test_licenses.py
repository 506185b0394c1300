"""Patience alignment and license scans on small texts."""

from pointproc.llm import licenses


def test_align_is_ascending_and_whole():
    a, b = "x y the same words go here z".split(), "the same old words go here".split()
    pairs = licenses.align(a, b)
    assert [a[i] for i, _ in pairs] == "the same words go here".split()
    assert pairs == sorted(pairs) and [j for _, j in pairs] == sorted(j for _, j in pairs)
    assert licenses.align([], b) == [] and licenses.align(a, []) == []
    assert len(licenses.align(b, b)) == len(b)


def test_increasing_against_all_subsequences():
    from itertools import combinations, permutations

    for p in permutations(range(5)):
        pairs = list(enumerate(p))
        best = max(k for k in range(6) for c in combinations(p, k) if list(c) == sorted(c))
        got = licenses.increasing(pairs)
        assert len(got) == best and [y for _, y in got] == sorted(y for _, y in got)


def test_scan(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    rows = [(1, "some words\nReleased under the MIT License.\nmore"), (2, "license plates are not licensed here"), (3, None), (4, ""),
            (5, "é " * 3000 + mit.replace("merge, ", "") + " and so on"), (6, "RELEASED UNDER THE MIT LICENSE"), (6, "RELEASED UNDER THE MIT LICENSE")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = licenses.scan(docs).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT"), (5, "MIT-text"), (6, "MIT"), (6, "MIT")]
    assert {r.doc_id: r.coverage for r in got}[1] == 1.0
    five = next(r for r in got if r.doc_id == 5)
    assert 0.95 < five.coverage < 1 and five.start_word == 3000
    assert licenses.scan(docs.limit(0)).count() == 0
