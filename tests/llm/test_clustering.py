import hashlib
import math

import numpy as np
import pytest

from folioflow.llm import clustering as C


def brute(rows, k, rounds=5, dims=64, scale=256, seed=2):
    kept = [(i, [min(max(math.floor(scale * float(x)), -C.LARGEST), C.LARGEST) for x in v]) for i, v in rows if v and len(v) == dims and None not in v and np.isfinite(v).all()]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    x = np.array([v for _, v in kept], object).reshape(-1, dims)
    cells = [np.array(v, "<i4").tobytes() for _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (name(kept[j][0]), cells[j]))[:k]
    cs = [x[j].tolist() for j in order]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        found = [near(v)[1] for v in x]
        for j in range(len(cs)):
            mine = [x[i] for i in range(len(x)) if found[i] == j]
            if mine:
                cs[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    last = [near(v) for v in x]
    inertia = {j: sum(d for d, c in last if c == j) for j in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, last, strict=True)), key=repr)


def answer(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, cells string").repartition(3)
    return sorted((tuple(r) for r in C.clusters(table, **how).collect()), key=repr)


@pytest.mark.parametrize("kind", ["clusters", "no structure", "coarse"])
def test_same_as_a_full_scan(spark, monkeypatch, kind):
    monkeypatch.setattr(C, "BATCH_ROWS", 50)
    r = np.random.default_rng(len(kind))
    x = r.normal(size=(300, 8))
    if kind == "clusters":
        x = r.normal(size=(12, 8))[r.integers(0, 12, 300)] + 0.1 * x
    scale = 1 if kind == "coarse" else 256  # few values: many ties
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [rows[5], rows[5], (7, rows[9][1]), (None, rows[2][1]), (400, None), (401, []), (402, [1.0] * 7), (403, [1.0] * 7 + [None]), (404, [float("nan")] * 8), (405, [float("inf")] + [0.0] * 7), (406, [1.0] * 9)]
    assert answer(spark, rows, k=40, dims=8, scale=scale) == brute(rows, 40, dims=8, scale=scale)


def test_few_vectors_one_vector_everywhere_and_empty_tables(spark):
    assert answer(spark, [], dims=3) == [] and answer(spark, [(1, [1.0, 2.0])], dims=3) == []
    one = [(3, [0.5, -0.5, 0.25])]
    assert answer(spark, one, dims=3) == brute(one, 40, dims=3)
    same = [(i % 7, [0.1, 0.2, 0.3]) for i in range(100)] + [(i, [float(i), 0.0, 0.0]) for i in range(10)]
    assert answer(spark, same, k=5, dims=3) == brute(same, 5, dims=3)


def test_very_large_components(spark):
    rows = [(i, [1e300 * (-1) ** i, 1e6 * i, 0.0]) for i in range(20)]
    assert answer(spark, rows, k=3, dims=3) == brute(rows, 3, dims=3)


@pytest.mark.parametrize("seed", range(6))
def test_every_round_is_exact_and_filters_save_distances(seed):
    r = np.random.default_rng(seed)
    n, k = 3000, 40
    x = np.floor(64 * (r.normal(size=(25, 6))[r.integers(0, 25, n)] + 0.1 * r.normal(size=(n, 6)))).astype(np.int64)
    centroids = x[r.choice(n, k, replace=False)]
    group = C.groups_of(centroids)
    cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.full((n, group.max() + 1), -np.inf)
    moved, spent = np.zeros(k), []
    for _ in range(8):
        step = C.Assignment(centroids, moved, group)
        step.run(x, cluster, upper, lower)
        d = ((x[:, None] - centroids[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (upper >= root[np.arange(n), cluster] - 1e-6).all()
        root[np.arange(n), cluster] = np.inf
        for g in range(lower.shape[1]):
            assert (lower[:, g] <= root[:, group == g].min(1) + 1e-6).all()
        spent.append(step.distances)
        new = np.array([x[cluster == j].sum(0) // (cluster == j).sum() if (cluster == j).any() else centroids[j] for j in range(k)])
        moved, centroids = np.sqrt(((new - centroids) ** 2).sum(1)), new
    assert spent[-1] < 0.35 * n * k
