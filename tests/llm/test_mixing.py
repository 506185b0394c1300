"""Mixing against its SQL and its rules."""

import duckdb

from pointproc.llm import mixing
from tests.llm.conftest import same


def by_sql(docs):
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    return sorted(db.execute(mixing.SQL).fetchall(), key=str)


def test_equals_sql_and_stays_near_targets(spark):
    rows = [(i, "w " * (i * 37 % 50), None if i % 13 == 0 else f"s{i * i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [tuple(r) for r in mixing.mix(docs).drop("times").collect()]
    want = by_sql(docs)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(sorted(got, key=str), want) for x, y in zip(a, b))
    source = {r.doc_id: r.source for r in docs.collect()}
    totals = {}
    for doc, size, whole, target, taken in got:
        assert taken <= 3 * size
        t = totals.setdefault(source[doc], [0, target, whole])
        t[0] += taken
    assert all(abs(n - target) <= 50 and target <= 3 * whole + 1e-6 for n, target, whole in totals.values())
    assert abs(sum(t for _, t, _ in totals.values()) - sum(r[1] for r in got)) < 1e-6
    assert sorted(got) == sorted(tuple(r) for r in mixing.mix(docs.repartition(2)).drop("times").collect())


def test_odd_rows(odd_documents, no_documents):
    got = [tuple(r) for r in mixing.mix(odd_documents).drop("times").collect()]
    assert len(got) == 10 and {r[1] for r in got if r[0] in (2, 3, 4)} == {0}
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_documents(no_documents).count() == 0
    assert mixing.mix(odd_documents.where("doc_id IN (2, 3)")).count() == 2  # no word at all
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = {}
    for r in mixing.mix(odd_documents).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.times
    assert times == {k: v for k, v in want.items() if v}
