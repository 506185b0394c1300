"""The divergence audit against its SQL: skewed counts, groups without terms, ties, odd rows."""

import random

import duckdb
import numpy as np
import pytest

from pointproc.llm import divergence


def by_sql(docs):
    db = duckdb.connect()
    db.register("documents", docs.select("lang", "source", "text").toPandas())
    return sorted(db.execute(divergence.SQL).fetchall())


def check(docs):
    got = sorted(tuple(r) for r in divergence.audit(docs).collect())
    assert got == by_sql(docs)
    return got


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"{'ÄÉß日x'[k % 5]}{'abcdefghij'[k % 10] * (1 + k // 40)}" for k in range(400)]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "en", "de", None, "fr"]), r.choice(["hot", "hot", "a", "b", None, "ünï", "z"])
        if lang == "fr" and source == "a":
            text = r.choice(["", None, "123 456", "rare%d" % i])  # a group without kept terms
        else:
            text = " ".join(r.choice(words[:r.choice([3, 30, 400])]).upper() for _ in range(r.randint(0, 80))) + ("The THE the " * 20 if source == "hot" else "")
        rows.append((i, text, lang, source))
    return rows + [(1000 + i, "once %d" % i, "xx", s) for i, s in enumerate("pqr")]  # a language that keeps no term


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sql(spark, seed):
    got = check(spark.createDataFrame(corpus(seed, 300), "doc_id long, text string, lang string, source string").repartition(5))
    assert {r[3:] for r in got if r[0] == "xx"} == {(o, 0, k) for o, k in [("p", 0), ("q", 0)]} or all(r[4] == 0 for r in got if r[0] == "xx")
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "" for r in got) and any(r[1] == "" for r in got)
    assert any(r[:3] == ("fr", "a", "pair") for r in got) and not any(r[:3] == ("fr", "a", "term") for r in got)


def test_small_tiles_and_parts(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(3, 200), "doc_id long, text string, lang string, source string").repartition(4)
    monkeypatch.setattr(divergence, "GATHER", 50)
    monkeypatch.setattr(divergence, "TILE", 7)
    monkeypatch.setattr(divergence, "BLOCK", 1)
    check(docs)


def test_odd_rows(spark, odd_documents, no_documents):
    check(odd_documents)
    assert divergence.audit(no_documents).count() == 0
    repeated = odd_documents
    for _ in range(4):
        repeated = repeated.unionByName(repeated)
    check(repeated)


def test_equal_values_are_ranked_by_item(spark):
    text = " ".join(f"t{a}{b}" for a in "abcdefgh" for b in "abcdefgh")
    rows = [(i, text if s == "a" else "other " * 60, "en", s) for i, s in enumerate("ab" * 12)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1:3] == ("a", "term")] == sorted(f"t{x}{y}" for x in "ab" for y in "abcdefgh")[:10]


def test_bits():
    row, bit = divergence.bits_of(np.array([5, 0, 1 << 63], np.uint64))
    assert row.tolist() == [0, 0, 2] and bit.tolist() == [0, 2, 63]
