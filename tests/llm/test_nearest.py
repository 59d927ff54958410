import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import nearest as N


def usable(rows):
    return [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]


def brute(rows, k, every):
    """For each query (id and vector) its k nearest: ids and scores."""
    good, out, copies = usable(rows), {}, {}
    for n, (q, v) in enumerate(good):
        if q % every == 0:
            scores = sorted((-float((v * w).sum()), i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v))
            if scores:
                out[q, tuple(v)] = [(i, -s) for s, i in scores[:k]] * 1
                copies[q, tuple(v)] = copies.get((q, tuple(v)), 0) + 1
    return {(*key, c): x for key, x in out.items() for c in range(copies[key])}


def answer(spark, rows, k, every):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, id int")
    return N.nearest(table, F.col("id") % every == 0, k).collect()


def same(got, want):
    """Results of all queries, however those of one id are mixed."""
    flat = lambda q, x: [(q, n + 1, i, round(s, 9)) for n, (i, s) in enumerate(x)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(y for (q, *_), x in want.items() for y in flat(q, x))


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan"), 1.0, 1.0, 1.0]), (105, [float("inf")] * 4), (None, [1.0] * 4), (110, [1.0, 2.0]), (120, [2.0, 1.0])]
    rows += [(130 + j, rows[0][1]) for j in range(5)] + [(7, rows[3][1])]
    same(answer(spark, rows, 20, 10), brute(rows, 20, 10))
    assert answer(spark, [], 20, 10) == [] and answer(spark, [(1, [1.0])], 20, 10) == [] and answer(spark, [(0, [1.0])], 20, 10) == []


def test_repeated_ids_and_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4).tolist()) for i in range(60)]
    rows += [(0, r.normal(size=4).tolist()), (0, [0.1, 0.0, 0.0, 0.0]), (10, rows[10][1]), (10, rows[10][1]), (20, rows[7][1])]
    want = brute(rows, 20, 10)
    assert len([q for q in want if q[0] == 0]) == 3 and len([q for q in want if q[0] == 10]) == 3
    got = answer(spark, rows, 20, 10)
    same(got, want)
    assert len([x for x in got if x.query_id == 10]) == 60 and [x.vec_id for x in got if x.query_id == 10].count(10) == 6  # each its copies, but not itself
    same(answer(spark, [(0, [1.0, 0.0])] * 3, 20, 10), brute([(0, [1.0, 0.0])] * 3, 20, 10))


@pytest.mark.parametrize("kind", ["clusters", "no structure"])
def test_recall_in_shards_and_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "SHARD_ROWS", 4000)
    monkeypatch.setattr(N, "QUERY_ROWS", 30)
    r = np.random.default_rng(2)
    vectors = r.normal(size=(12000, 32))
    if kind == "clusters":
        vectors = r.normal(size=(200, 32))[r.integers(0, 200, 12000)] + 0.3 * vectors
    got = {}
    for x in answer(spark, [(i, v.tolist()) for i, v in enumerate(vectors)], 20, 200):
        got.setdefault(x.query_id, set()).add(x.vec_id)
    right = 0
    for q, found in got.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        right += len(found & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 60 and right / (20 * len(got)) >= 0.9


def test_clusters_end_the_ascent_early():
    r = np.random.default_rng(6)
    vectors = r.normal(size=(500, 32))[r.integers(0, 500, 20000)] + 0.15 * r.normal(size=(20000, 32))
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    forest = N.Forest(np.arange(len(vectors)), vectors)
    levels = []
    ranges = forest.ranges
    forest.ranges = lambda codes, level: levels.append(int(level.min())) or ranges(codes, level)
    right = 0
    for q in range(50):
        ((best, _),) = forest.search(vectors[q : q + 1], 20)
        right += len(set(best.tolist()) & set(np.argsort(-(vectors @ vectors[q]))[:20].tolist()))
    assert right / 1000 >= 0.9 and min(levels) > 0


def test_one_very_long_vector_and_one_id_everywhere(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_ROWS", 20)
    r = np.random.default_rng(8)
    rows = [(0, r.normal(size=3).tolist()) for _ in range(70)] + [(i, r.normal(size=3).tolist()) for i in range(1, 20)] + [(30, r.normal(size=100_000).tolist()), (31, r.normal(size=100_000).tolist())]
    same(answer(spark, rows, 5, 10), brute(rows, 5, 10))


def test_ranges_are_prefix_matches():
    r = np.random.default_rng(3)
    forest = N.Forest(np.arange(300), r.normal(size=(300, 6)), trees=2)
    codes = forest.codes(r.normal(size=(5, 7)))
    for level in (0, 1, 3, 9, 64):
        low, high = forest.ranges(codes, np.full(5, level, np.uint64))
        for t in range(2):
            for q in range(5):
                want = [c for c in forest.sorted[t].tolist() if level == 0 or c >> (64 - level) == int(codes[t, q]) >> (64 - level)]
                assert forest.sorted[t][low[t, q] : high[t, q]].tolist() == want
