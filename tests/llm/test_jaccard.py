import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import jaccard as J


def shingles(text, n):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    above = J.Sets(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                above.join(i, j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[above.find(i)] = min(d, smallest.get(above.find(i), d))
    return sorted(((d, len(s), smallest.get(above.find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "B", "the", "of", "é", *map(str, range(60))])
    seeds = [[word() for _ in range(r.choice([1, 2, 5, 20, 60, 120]))] for _ in range(12)]
    common = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        text = list(r.choice(seeds)) if r.random() < 0.8 else [word() for _ in range(r.randint(0, 40))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            k = r.randrange(len(text) + 1)
            text[k : k + r.randint(0, 2)] = [word()]
        if r.random() < 0.3:
            text += common
        rows.append((i, r.choice([" ", "\n", "  "]).join(text)))
    r.shuffle(rows)
    return rows + [(3, dict(rows)[3]), (5, dict(rows)[9]), (None, dict(rows)[11]), (None, "only this one"), (None, None)]


def answer(spark, documents, rows, n, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.links(documents(rows), n, percent).collect()), key=str)


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (2, 5, 80)])
def test_same_as_brute_force(spark, documents, seed, n, percent):
    rows = corpus(seed)
    assert answer(spark, documents, rows, n, percent) == brute(rows, n, percent)


def test_large_blocks_are_dealt_and_frequent_grams_come_last(spark, documents, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(J, "BLOCK_ITEMS", 300)
    monkeypatch.setattr(J, "FREQUENT_SHARE", 0.02)
    assert len(J.frequent(J._rows(documents(rows)), 3))
    assert answer(spark, documents, rows, 3, 90) == brute(rows, 3, 90)


@pytest.mark.parametrize("seed,n,percent", [(4, 3, 90), (6, 5, 80)])
def test_large_groups_are_dealt(spark, documents, monkeypatch, seed, n, percent):
    rows = corpus(seed)
    monkeypatch.setattr(J, "GROUP_NODES", 3)
    monkeypatch.setattr(J, "BLOCK_ITEMS", 2_000)
    assert answer(spark, documents, rows, n, percent) == brute(rows, n, percent)


def test_one_block_of_near_copies(spark, documents, monkeypatch):
    r = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(90):
        text = list(words)
        for _ in range(r.randint(0, 6)):
            text[r.randrange(150)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(J, "GROUP_NODES", 10)
    monkeypatch.setattr(J, "BLOCK_ITEMS", 1_500)
    assert answer(spark, documents, rows, 3, 90) == brute(rows, 3, 90)


def test_odd_rows_and_empty_tables(spark, documents, odd):
    rows = list(enumerate(odd)) + [(20, "A"), (21, "a b"), (22, "A B")]
    assert answer(spark, documents, rows, 3, 90) == brute(rows, 3, 90)
    assert answer(spark, documents, [], 3, 90) == []


def test_one_of_each_group_stays(spark, documents):
    rows = corpus(5)
    docs = documents(rows)
    got = J.kept(docs)
    assert got.columns == docs.columns
    found, want = brute([(i, t) for i, (_, t) in enumerate(rows)], 5, 80), []
    group = {i: (n, c) for i, n, c in found}
    got = [(r.doc_id, r.text) for r in got.collect()]
    for c in {c for n, c in group.values() if n}:
        members = [rows[i] for i, (n, k) in group.items() if n and k == c]
        first = min((d is None, d or 0) for d, _ in members)
        mine = [x for x in got if x in members]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == first, members
    assert len([x for x in got if not shingles(x[1], 5)]) == sum(not n for n, _ in group.values())


def test_linked_rows_of_one_doc_id_leave_one(spark, documents):
    """Repeated ids with unlike texts: near copies among them leave one row, others stay."""
    text = [f"w{k}" for k in range(100)]
    near = " ".join([*text[:-1], "x"])
    rows = [(7, " ".join(text)), (7, near), (7, near), (7, "quite another text of nine words or so, here"), (8, near), (9, None), (9, "")]
    got = sorted(((r.doc_id, r.text) for r in J.kept(documents(rows)).collect()), key=str)
    assert len(got) == 4 and sum(t in (" ".join(text), near) for _, t in got) == 1 and (7, rows[3][1]) in got and {(9, None), (9, "")} < set(got)


def test_n_grams_and_hubs_that_many_have(spark, documents, monkeypatch):
    """Keys above a small bound take the broadcast way from the first step on; a star's hub as well."""
    monkeypatch.setattr("folioflow.llm.common.HOT_ROWS", 3)
    rows = corpus(6, 80)
    assert answer(spark, documents, rows, 3, 90) == brute(rows, 3, 90)
    edges = [(1, k) for k in range(2, 400)] + [(1000 + k, 399) for k in range(300)]
    got = {x.node: x.root for x in J.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len(got) == 699 and set(got.values()) == {1}


def test_one_table_is_left(spark, documents):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    found = J.links(documents(corpus(9, 60)), 3, 90)
    (mine,) = set(folder.iterdir()) - before
    assert [x.name.split("-")[1] for x in mine.iterdir()] == ["result"] and found.count() == 65


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=1, max_size=25), st.integers(50, 95))
def test_trie_links(sets, percent):
    grams = [np.array(sorted(s), np.uint64) for s in sets]
    above = J.Sets(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                above.join(i, j)
    assert J.link_sets(grams, percent) == [above.find(i) for i in range(len(sets))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 300), min_size=1, max_size=60), min_size=2, max_size=30), st.sampled_from([80, 90]))
def test_bounds_lose_no_link(sets, percent):
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    sketch = np.array([np.bincount([x % 64 for x in s], minlength=64) for s in sets]).astype(np.uint8)
    joined = J.Sets(len(sets))
    for i, j in J.plausible_edges(size, sketch, percent, recent=2):
        joined.join(i, j)
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                assert joined.find(i) == joined.find(j)
                p, q = J.prefix_size(len(a), percent), J.prefix_size(len(sets[j]), percent)
                assert set(sorted(a)[:p]) & set(sorted(sets[j])[:q])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.sets(st.integers(0, 120), min_size=1, max_size=60)), min_size=2, max_size=30), st.sampled_from([80, 90]))
def test_boxes_lose_no_link(members, percent):
    sets = [s for _, s in members]
    sketch = np.array([np.bincount([x % 64 for x in s], minlength=64) for s in sets]).astype(np.uint8)
    size = np.array([len(s) for s in sets], np.int64)
    table = {"group": np.zeros(len(sets), np.int64), "root": np.array([r for r, _ in members]), "least": size, "most": size, "low": [x.tobytes() for x in sketch], "high": [x.tobytes() for x in sketch]}
    (box,) = J._boxes(iter([pa.RecordBatch.from_pydict(table)]))
    root = box["root"].to_numpy()
    low, high = (np.array([np.frombuffer(x, np.uint8) for x in box[c].to_pylist()]) for c in ("low", "high"))
    assert root.tolist() == sorted({r for r, _ in members})
    joined = J.Sets(9)
    for i, j in J.box_edges(root, box["least"].to_numpy(), box["most"].to_numpy(), low, high, percent):
        joined.join(int(root[i]), int(root[j]))
    for i, (a, x) in enumerate(members):
        for b, y in members[:i]:
            if 100 * len(x & y) >= percent * len(x | y):
                assert joined.find(a) == joined.find(b)


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(900, k) for k in range(901, 950)] + [(5, 5)]
    sets = J.Sets(1000)
    for a, b in edges:
        sets.join(a, b)
    got = {x.node: x.root for x in J.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: sets.find(i) for e in edges if e[0] != e[1] for i in e}


def test_groups_without_ids_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near, other = text + " more", " ".join(f"v{k}" for k in range(9))
    rows = [(None, text, 1, 2), (None, text, 1, 2), (None, near, 3, 4), (None, other, 5, 6), (7, other + " x y", 5, 6), (8, "one", 5, 6), (None, "one", 5, 6), (9, "", 0, 0), (9, "", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _key int, key int")
    got = [(r.doc_id, r.text, r._key, r.key) for r in J.kept(docs).collect()]
    assert sum(t in (text, near) for _, t, *_ in got) == 1 and set(got) <= set(rows)
    assert sorted((d, t) for d, t, *_ in got if d is not None) == [(7, other + " x y"), (8, "one"), (9, ""), (9, "")]
    assert sum(t == other for _, t, *_ in got) == (0 if 100 * 5 >= 80 * 7 else 1)


def test_one_very_long_text(spark, documents):
    r = np.random.default_rng(1)
    words = [f"w{x}" for x in r.integers(0, 50_000, 400_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5])), (3, " ".join(words[: len(words) // 2]))]
    assert answer(spark, documents, rows, 3, 90) == brute(rows, 3, 90)


def test_few_rows_take_few_tasks(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)]
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("few rows", "")
    try:
        got = {x.node: x.root for x in J.components(spark.createDataFrame(edges, "a bigint, b bigint"), rows=300).coalesce(1).collect()}
        stages = {i for j in context.statusTracker().getJobIdsForGroup("few rows") for i in context.statusTracker().getJobInfo(j).stageIds}
        tasks = [context.statusTracker().getStageInfo(i).numCompletedTasks for i in stages]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    sets = J.Sets(400)
    for a, b in edges:
        sets.join(a, b)
    assert got == {i: sets.find(i) for e in edges if e[0] != e[1] for i in e}
    assert max(tasks) < 64


def test_near_copies_that_do_not_link_are_compared_together():
    r = np.random.default_rng(5)
    grams = [np.setdiff1d(np.arange(150), r.choice(150, 20, replace=False)).astype(np.uint64) for _ in range(200)]
    size = [len(g) for g in grams]
    sets = J.Sets(200)
    trie = J.Trie(sets, 150, 90)
    for i, g in enumerate(grams):
        trie.link(i, g.astype(np.int32))
        trie.add(i, g.astype(np.int32))
    plain = J.Sets(200)
    for i in range(200):
        for j in range(i):
            common = len(np.intersect1d(grams[i], grams[j]))
            if 100 * common >= 90 * (size[i] + size[j] - common):
                plain.join(i, j)
    assert [sets.find(i) for i in range(200)] == [plain.find(i) for i in range(200)]
    assert trie.visited < 200 * 20


def test_tables_of_known_size_are_not_counted_again(spark, documents, monkeypatch):
    """Each count runs its plan once more, joins and broadcasts included, and the driver pays for it."""
    rows, asked = corpus(7), []
    frame = type(spark.range(0))
    limit = frame.limit
    monkeypatch.setattr(frame, "limit", lambda self, n: asked.append(n) or limit(self, n))
    got = J.links(documents(rows), 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)
    assert J.BROADCAST_ROWS + 1 not in asked
