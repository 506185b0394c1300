"""Suffix-array deduplication against a plain dictionary of all windows."""

import hashlib
import random

from pointproc.llm import suffixes


def brute(rows, width=50):
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - width + 1):
            w = raw[p:p + width]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if least[raw[p:p + width]] < i:
                gone[p:p + width] = b"\1" * width
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.setdefault(i, set()).add((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(40)]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    passages = [text(30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a:a + r.randint(20, len(p))], text(r.randint(0, 5))]
        rows.append((i * 3 % 61, " ".join(parts)))
    rows += [(100 + i, rows[0][1]) for i in range(20)]  # a large group of copies
    rows += [(200, None), (201, ""), (202, "a" * 400), (203, "a" * 60), (204, "x" * 49), (100, rows[0][1])]
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = sample(seed)
        docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string").repartition(5)
        got = {}
        for r in suffixes.digests(docs, suffixes.removed_spans(docs)).collect():
            got.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert got == brute(rows)


def test_small_steps_and_buckets(spark, monkeypatch):
    """Edges of steps and buckets everywhere."""
    monkeypatch.setattr(suffixes, "_STEP", 64)
    monkeypatch.setattr(suffixes, "RANGE", 600)
    monkeypatch.setattr(suffixes, "BUCKET", 900)
    monkeypatch.setattr(suffixes, "OFFER", 1000)
    monkeypatch.setattr(suffixes, "NEAR", 2)
    rows = sample(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in suffixes.digests(docs, suffixes.removed_spans(docs)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert got == brute(rows)


def test_empty_and_missing_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.digests(empty, suffixes.removed_spans(empty)).count() == 0
    docs = spark.createDataFrame([(None, "b" * 80), (1, "b" * 80), (2, "b" * 80)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffixes.digests(docs, suffixes.removed_spans(docs)).collect()}
    assert got == {None: 0, 1: 0, 2: 80}
    cut = suffixes.without_spans(docs, suffixes.removed_spans(docs))
    assert {(r.doc_id, r.text) for r in cut.collect()} == {(None, "b" * 80), (1, "b" * 80), (2, "")}


def test_cut_texts_keep_columns_of_any_name(spark):
    same = "a passage of more than fifty bytes that both of the documents hold, word for word"
    docs = spark.createDataFrame([(1, same, "x", 1), (2, "b " + same, "y", 2), (3, None, "z", 3)], "doc_id long, text string, _spans string, _id int")
    spans = suffixes.removed_spans(docs)
    got = sorted(tuple(r) for r in suffixes.without_spans(docs, spans).collect())
    assert got == [(1, same, "x", 1), (2, "b ", "y", 2), (3, None, "z", 3)]


def test_rows_of_one_id_lose_their_own_bytes(spark):
    """Also with a text that several rows have, and one repeated inside one id only."""
    r = random.Random(9)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, a), (5, a + "tail"), (5, b), (5, b), (5, None), (5, ""), (6, c + b[:90]), (6, a[100:200] + c), (7, c[40:140]), (-3, "é" + c[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = suffixes.removed_spans(docs)
    got = {}
    for x in suffixes.digests(docs, spans).collect():
        got.setdefault(x.doc_id, set()).add((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256))
    assert got == brute(rows)
    cut = [tuple(x) for x in suffixes.without_spans(docs, spans).collect()]
    assert len(cut) == len(rows) and cut.count((5, b)) == 2 and (5, "tail") in cut and (5, a + "tail") not in cut
