"""Fill-in-the-middle against plain Python and its SQL; the rank index against the offsets it stands for."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pointproc.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["a b  c\n", None, "", "   ", "x" * 3000, "<P> tok", "é日 🙂  z\u0085q", " lead <", "a\x1cb\x0bc \x0c", "<<S", "w <S> v"] + [
    f"wörd{i} " * (i % 50) + " " * (i % 7) + "<S"[:i % 3] for i in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (None, "no id but some words")], "doc_id long, text string").repartition(3)


def plain(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    assert "".join(units) == text
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_plain_python(docs):
    got = {r.doc_id: tuple(r)[1:] for r in infill.transform(docs).collect()}
    want = {i: plain(i, t) for i, t in [*enumerate(TEXTS), (None, "no id but some words")]}
    assert got == want
    assert min(Counter(w[1] for w in want.values()).values()) > 5  # all forms occur


def test_equals_sql(docs):
    db = duckdb.connect()
    db.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    got = sorted((tuple(r) for r in infill.digests(docs).collect()), key=str)
    assert got == sorted(db.execute(infill.SQL).fetchall(), key=str)
    sha = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS)}
    assert all(r[-1] == sha[r[0]] for r in got if r[0] is not None)


def test_restored(docs, odd_documents, no_documents):
    back = {r.doc_id: r.text for r in infill.restore(infill.transform(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no id but some words"}
    assert infill.digests(odd_documents).count() == 10 and infill.digests(no_documents).count() == 0
    assert infill.restore(infill.transform(odd_documents)).where("doc_id = 1").distinct().count() == 1


@pytest.mark.parametrize("offsets", [
    np.arange(10_000) * 6, np.cumsum(np.random.default_rng(1).integers(1, 12, 50_000)), np.array([0]), np.array([], np.int64),
    np.cumsum(np.where(np.arange(9000) % 1000 == 999, 1_000_000, 3)), np.repeat([0, 5, 5_000_000_000], 700)])
def test_index_is_exact_and_bounded(offsets):
    index = infill.RankIndex(offsets)
    assert (index.offset(np.arange(len(offsets))) == offsets).all()
    assert (np.abs(index.residual.astype(int)) <= infill.ERROR).all() and (np.diff(index.start) > 0).all()
    assert len(index.start) <= max(1, len(offsets) // 20)  # lines, not a list of offsets
