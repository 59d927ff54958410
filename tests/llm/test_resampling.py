import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import resampling as R


def grams(text, order):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1)]


def brute(rows, target, order=1, buckets=10_000, percent=10, min_words=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    docs = [(d, *grams(t, order)) for d, t in rows]
    s, t = (Counter(bucket(g) for gs in all_ for g in gs) for all_ in ([x[2] for x in docs], [grams(x, order)[1] for x in target]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for d, n, gs in docs:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(g)) for g in gs) // len(gs) if gs else 0
        out.append([d, n, len(gs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, -x[3], x[2]))
    for k, x in enumerate(may[: percent * len(may) // 100]):
        x[5] = k + 1
    return sorted((tuple(x) for x in out), key=repr)


def answer(spark, documents, rows, target, **settings):
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id bigint, text string, chunk int")
    got = R.scores(documents(rows), bench, **settings).collect()
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=repr)


def corpus(seed, n=120, most=60):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "The", "é日", "x1", *(f"w{k}" for k in range(80))])
    rows = [(i, r.choice([" ", ", ", "\n-"]).join(word() for _ in range(r.randint(0, most)))) for i in range(n)]
    return rows + [rows[3], rows[3], (4, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]


@pytest.mark.parametrize("order,percent,buckets", [(1, 10, 10_000), (3, 25, 500), (2, 100, 70_000)])
def test_same_as_brute_force(spark, documents, odd, order, percent, buckets):
    rows = corpus(order) + list(enumerate(odd, 500))
    target = [t for _, t in corpus(9, 12)] + [None, ""]
    how = {"order": order, "percent": percent, "buckets": buckets}
    assert answer(spark, documents, rows, target, **how) == brute(rows, target, **how)


@pytest.mark.parametrize("order", [1, 3])
def test_long_texts_are_cut_and_added_up(spark, documents, order):
    """Every text of more than 50 bytes goes in chunks, copies of long texts too, and one is very long."""
    rows = corpus(5) + [(900, " ".join(f"w{k % 91}" for k in range(60_000))), (901, "y" * 5_000 + " z"), (902, "..." * 2_000)]
    target = [t for _, t in corpus(9, 12)]
    how = {"order": order, "percent": 30}
    assert answer(spark, documents, rows, target, chunk_bytes=50, **how) == brute(rows, target, **how)


def test_ties_and_one_score_for_all(spark, documents):
    rows = [(None, "same words " * 15)] * 300 + [(7, "same words " * 15)] * 3
    assert answer(spark, documents, rows, ["same"], percent=50) == brute(rows, ["same"], percent=50)


def test_empty_tables(spark, documents):
    assert answer(spark, documents, [], ["a"]) == []
    rows = corpus(2, 40)
    assert answer(spark, documents, rows, []) == brute(rows, [])


def test_drawn_rows_are_whole(spark, documents):
    rows = corpus(3)
    docs = documents(rows)
    bench = spark.createDataFrame([(0, "w1 w2 w3")], "item_id bigint, text string")
    ranks = Counter((x[0], t) for x, t in zip(sorted_like(rows, bench=["w1 w2 w3"]), (t for _, t in rows), strict=True) if x[5])
    got = R.resampled(docs, bench, percent=60)
    assert got.columns == docs.columns and Counter((x.doc_id, x.text) for x in got.collect()) == ranks


def sorted_like(rows, bench):
    """brute()'s rows in the order of ``rows``; repeats of a row are drawn from the front."""
    left = Counter()
    by = {}
    for x in brute(rows, bench, percent=60):
        by.setdefault((x[0], x[3], x[2]), []).append(x)
    out = []
    for d, t in rows:
        n, gs = grams(t, 1)
        key = next(k for k in by if k[0] == d and k[2] == len(gs) and by[k][0][1] == n and left[k] < len(by[k]))
        out.append(by[key][left[key]])
        left[key] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=20))
def test_checksums(parts):
    buf = np.frombuffer(b"".join(parts) + b" " * 9, np.uint8)
    end = np.cumsum([len(p) for p in parts]).astype(np.int64)
    start = end - np.array([len(p) for p in parts], np.int64)
    assert R.crc32_ranges(buf, start, end).tolist() == [zlib.crc32(p) for p in parts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", "é", "12345", "日本語語語"]), max_size=60), st.integers(1, 4), st.integers(1, 30))
def test_chunks_own_each_run_once(words, order, limit):
    text = " - ".join(words)
    pieces = R.cut(text.encode(), order, limit)
    got = []
    for (n, bag), (owned, _) in zip(R.features([t for _, t in pieces], [n for n, _ in pieces], order, 1 << 20), pieces, strict=True):
        assert n == owned
        got += bag.tolist()
    n, want = grams(text, order)
    assert sum(n for n, _ in pieces) == n and sorted(got) == sorted(zlib.crc32(g.encode()) % (1 << 20) for g in want)
