"""Near-dedup against all pairs in double precision."""

import numpy as np
import pytest
from tessera.llm import vectors


def brute(rows, cosine=0.98):
    """rows: (id, vector, label) by id."""
    ok = [v is not None and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) for _, v, lab in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    up[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 20)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(250):
        v = rng.normal(size=16)
        if rows and rng.random() < 0.6:
            base = rows[rng.integers(len(rows))][1]
            if base is not None and None not in base:
                v = np.array(base) + rng.normal(size=16) * rng.choice([0, 0.02, 0.12, 0.2]) * np.linalg.norm(base) / 4
        v = v.astype(np.float32).tolist()
        rows.append((i * 2, {7: None, 9: [0.0] * 16, 11: [None] * 16, 13: [float("nan")] * 16}.get(i, v), None if i % 31 == 0 else int(rng.integers(3))))
    got = {r.vec_id: r for r in vectors.near_dedup(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int")).collect()}
    links, root = brute(rows)
    for i, (k, _, _) in enumerate(rows):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (links[i], root[i] * 2, root[i] == i)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    docs = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [2.0, 0.0], 0), (0, [1.0, 0.0, 0.0], 0)], schema)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links) for r in vectors.near_dedup(docs).collect()) == [(-1, 2), (0, 0), (1, 2), (1, 2)]
    assert vectors.near_dedup(spark.createDataFrame([], schema)).count() == 0


def test_calibration():
    k = vectors.least_collisions()
    rng = np.random.default_rng(0)
    half = vectors.SPREADS * np.sqrt(2 - 2 * vectors.COSINE)
    hits = (np.abs(rng.normal(size=(100_000, vectors.PROJECTIONS)) * np.sqrt(2 - 2 * vectors.COSINE)) <= half).sum(1)
    assert (hits >= k).mean() > 0.9999


def test_ties_repeats_and_columns_of_any_name(spark):
    import math

    v = [1.0, 2.0, 3.0]
    edge = [math.cos(math.acos(0.98)), math.sin(math.acos(0.98)), 0.0]
    rows = [(1, v, "a", 1, 1), (1, v, "a", 1, 1), (2, v, "b", 1, 1), (None, v, "a", 1, 1), (4, [1.0, 0.0, 0.0], "c", 2, 2), (5, edge, "c", 2, 2), (6, [0.0, 0.0, 1.0] * 4_000, "d", 3, 3), (7, [0.0, 0.0, 1.0] * 4_000, "d", 3, 3)]
    got = vectors.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n int, root int"))
    out = sorted(((r.vec_id or 99, r.n_links, r.component_id, r.kept) for r in got.collect()))
    linked = math.fsum(x * y for x, y in zip(edge, rows[4][1], strict=True)) / math.sqrt(math.fsum(x * x for x in edge)) >= 0.98
    assert out[:3] == [(1, 2, 1, False), (1, 2, 1, True), (2, 0, 2, True)] and out[-1] == (99, 2, 1, False)
    assert out[3:5] == ([(4, 1, 4, True), (5, 1, 4, False)] if linked else [(4, 0, 4, True), (5, 0, 5, True)])
    assert out[5:7] == [(6, 1, 6, True), (7, 1, 6, False)]
