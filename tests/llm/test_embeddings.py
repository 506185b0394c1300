"""Embedding near-duplicates against all pairs in double precision."""

import numpy as np

from pointproc.llm import embeddings


def brute(rows, threshold=0.98):
    good = {i: (lab, np.array(v, np.float32).astype(float)) for i, v, lab in rows
            if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: set() for i, _, _ in rows if i is not None}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def sample():
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(160):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 12 < 8)))
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(25)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0, None] * 8, 1), (304, rows[0][1], None),
             (305, [float("inf")] + [1.0] * 15, 1), (306, [], 1), (307, rows[0][1][:4], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0) for r in rows], "vec_id long, embedding array<float>, label int, raw string, part int").repartition(3)


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 20)
    rows = sample()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_repeats_and_empty(spark):
    rows = sample()
    got = embeddings.near_duplicates(frame(spark, rows[:3] + rows[:3])).collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 2]
    assert embeddings.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_bound_is_rigorous():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 40)), rng.normal(size=(50, 40))
    x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    (qx, sx, ex), (qy, sy, ey) = embeddings.quantise(x), embeddings.quantise(y)
    rough = (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy
    assert (np.abs(rough - x @ y.T) <= ex[:, None] + (1 + ex[:, None]) * ey).all()
    for threshold in (-0.2, 0.0, 0.3):
        a, b = embeddings.close_pairs(x, y, threshold)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= threshold))))
