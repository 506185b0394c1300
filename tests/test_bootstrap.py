"""Draws inside tasks against draws by join, and against plain Python."""

import hashlib
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest

from pointproc.functions.resample import draw_words, first_halves
from pointproc.operators import bootstrap, stats


def word(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_words_are_those_of_the_digest():
    r = random.Random(1)
    a = np.array([r.choice([0, 9, 10, 99, 100, 12345, 10**9]) for _ in range(3000)])
    b = np.array([r.randrange(2000) for _ in range(3000)])
    assert draw_words(7, a, 0, b).tolist() == [word(7, x, 0, y) for x, y in zip(a, b)]
    assert draw_words(7, a, 2, b, ",", a).tolist() == [word(7, x, 2, f"{y},{x}") for x, y in zip(a, b)]
    for n in (0, 1, 54, 55):
        text = bytes(range(1, n + 1))
        got = first_halves(np.frombuffer(text, np.uint8).reshape(1, n))[0]
        assert int(got) == int(hashlib.md5(text).hexdigest()[:16], 16)
    with pytest.raises(ValueError):
        first_halves(np.zeros((1, 56), np.uint8))


@pytest.fixture(scope="module")
def obs(spark):
    r = random.Random(4)
    rows = []
    for key, n in [("a", 1), ("b", 2), ("c", 37), ("d", 150)]:
        for i in range(n):
            rows.append((key, r.randrange(5), i * 7, r.choice([0.0, 1.0, 2.5, r.random()]), r.choice([0.0, 3.0, r.random() * 9])))
    rows += [("d", 9, 10_000, None, 1.0), ("d", 9, 10_001, float("nan"), 1.0), ("e", 1, 0, None, None), ("f", 1, 0, 0.0, 2.0)]
    return spark.createDataFrame(rows, "k string, c int, o bigint, b double, t double").repartition(3)


def found(reps):
    return {(r.k, r.iteration): (None if r.delta is None else round(r.delta, 9), None if r.pct is None else round(r.pct, 9)) for r in reps.collect()}


@pytest.mark.parametrize("most", [0, 30])
def test_joined_draws_are_the_same(obs, monkeypatch, most):
    one, two = (lambda: stats.bootstrap_one_level(obs, ["k"], "o", 1 << 16, 25, 3)), (
        lambda: stats.bootstrap_two_level(obs, ["k"], "c", "o", 1 << 16, 25, 3))
    inside = found(one()), found(two())
    assert len(inside[0]) == len(inside[1]) == 5 * 25
    monkeypatch.setattr(bootstrap, "MOST", most)
    assert (found(one()), found(two())) == inside


def test_medians_by_plain_python(obs, monkeypatch):
    monkeypatch.setattr(bootstrap, "STEP", 300)
    monkeypatch.setattr(bootstrap, "DRAWS", 1000)  # several ranges of an endpoint, several steps of a range
    got = found(stats.bootstrap_one_level(obs, ["k"], "o", 1 << 16, 25, 3))
    rows = sorted((r.k, r.o, r.b, r.t) for r in obs.collect() if r.b is not None and r.t is not None and r.b == r.b)
    for key in "abcdf":
        own = [(b, t) for k, _, b, t in rows if k == key]
        for it in range(25):
            delta = [t - b for b, t in (own[word(3, it, 0, s) % len(own)] for s in range(len(own)))]
            assert got[key, it][0] == round(statistics.median(delta), 9)


def test_medians_of_counts():
    m = bootstrap.Medians(np.array([5.0, 1.0, 5.0, 0.0]), np.array([False, False, False, True]))
    value, none = m.of(np.array([0, 0, 0, 0, 1, 1, 2]), np.array([0, 1, 2, 3, 1, 2, 3]), 4)
    assert none.tolist() == [False, False, True, True] and value[:2].tolist() == [5.0, 3.0]
    assert bootstrap.Medians(np.zeros(2), np.ones(2, bool)).of(np.zeros(2, int), np.array([0, 1]), 1)[1].tolist() == [True]


@pytest.mark.parametrize("cluster", [None, "c"])
def test_observations_travel_no_more_often_than_there_are_tasks(spark, obs, monkeypatch, cluster):
    """Copies of the observations are bounded by the shuffle width, not by the number of draws (quadratic in the observations)."""

    def counted(keys, *_):
        def run(batches):
            for batch in batches:
                yield pa.record_batch([pa.array(["x"]), pa.array([len(batch)], pa.int32()), pa.array([0.0]), pa.array([0.0])], names=["k", "iteration", "delta", "pct"])

        return run

    monkeypatch.setattr(bootstrap, "DRAWS", 10)
    monkeypatch.setattr(bootstrap, "replicates", counted)
    if cluster:
        reps = stats.bootstrap_two_level(obs, ["k"], cluster, "o", 1 << 16, 500, 3)
    else:
        reps = stats.bootstrap_one_level(obs, ["k"], "o", 1 << 16, 500, 3)
    moved = sum(r.iteration for r in reps.collect())
    assert 1 < moved <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_endpoints_of_several_packs(obs, monkeypatch):
    one, two = (lambda: stats.bootstrap_one_level(obs, ["k"], "o", 1 << 16, 25, 3)), (
        lambda: stats.bootstrap_two_level(obs, ["k"], "c", "o", 1 << 16, 25, 3))
    together = found(one()), found(two())
    monkeypatch.setattr(bootstrap, "MOST", 150)  # nothing is joined, but two packs are made
    assert (found(one()), found(two())) == together
