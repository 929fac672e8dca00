import numpy as np
import pytest

from millrace.llm import vectors


def brute(rows, threshold):
    """n_links and component of each (vec_id, vector), pair by pair."""

    def fit(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fit(v) else None for _, v in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for i, (vec_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(vec_id)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((v, n[i], least[find(i)], v is not None and v == least[find(i)]) for i, (v, _) in enumerate(rows)), key=str)


def found(spark, rows, threshold=0.9):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted((tuple(r) for r in vectors.near_vectors(frame, threshold).collect()), key=str)


@pytest.mark.parametrize("block, strip", [(4096, 256), (16, 5)])
def test_clusters_against_brute_force(spark, monkeypatch, block, strip):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "STRIP", strip)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=8) * (i % 5) * 0.1).astype(np.float32)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(6)] + [(7, rows[7][1])]
    assert found(spark, rows) == brute(rows, 0.9)


def test_near_the_threshold_the_bound_leaves_it_to_double_precision(spark):
    rows = [(0, [1.0, 0.0, 0.0])]
    for i, c in enumerate(np.linspace(0.88, 0.92, 81)):
        rows.append((i + 1, [float(np.float32(c)), float(np.float32(np.sqrt(1 - c * c))), 0.0]))
    assert found(spark, rows) == brute(rows, 0.9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
        (None, [3.0, 0.01]), (9, [1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (11, [1e30, 1e28]), (12, [-1.0, 0.0]), (12, [-1.0, 0.0]), (None, [0.0, 1.0]), (13, [-0.0, 5.0]),
    ]
    assert found(spark, rows) == brute(rows, 0.9)
    assert found(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    u = vectors.unit([*rng.normal(size=(60, 33)), *rng.normal(size=(60, 33)).round()])
    q, scale, held, error = vectors.quantised(u)
    near = scale[:, None] * scale[None, :] * (q.astype(int) @ q.astype(int).T)
    assert (np.abs(u @ u.T - near) <= held[:, None] * error[None, :] + error[:, None] + 1e-12).all()


def test_extra_columns_stay_out(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 5, 6), (2, [1.0, 0.1], 5, 6)], "vec_id long, embedding array<double>, class int, block int")
    assert [tuple(r) for r in vectors.near_vectors(frame).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False)]
