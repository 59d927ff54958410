import random
import time

import numpy as np
import pytest

from folioflow.llm import decontaminate as D


def distance(needle, text):
    """Fewest edits between needle and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(needle, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, b in items:
            value, text = D.normalise(b), D.normalise(t)
            starts = [0] if len(value) <= D.SEGMENT else sorted({*range(0, len(value) - D.SEGMENT, D.STRIDE), len(value) - D.SEGMENT})
            for s in starts:
                part = value[s : s + D.SEGMENT]
                budget = int(D.EDIT_SHARE * len(part))
                while budget and len(part) - D.Q + 1 - budget * D.Q < 1:
                    budget -= 1
                if part and distance(part, text) <= budget:
                    out.add((d, i))
    return out


@pytest.fixture(scope="module")
def cases():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.choice([1, 3, 12, 40]))) for i in range(12)] + [(3, prose(20)), (None, prose(20)), (90, None), (91, "  ")]
    docs = []
    for d in range(60):
        text = prose(r.randint(0, 60))
        if d % 3:
            value = r.choice([b for _, b in items if b and b.strip()])
            value = list(value.upper() if d % 2 else value)
            for _ in range(r.choice([0, 0, 1, 3, 6, 12])):
                k = r.randrange(len(value)) if value else 0
                value[k : k + r.randint(0, 1)] = r.choice(["", "z", "\n "])
            text = f"{text} {''.join(value)} {prose(5)}"
        docs.append((d, text))
    return docs + [(None, None), (7, docs[7][1]), (100, "")], items


def test_nothing_within_the_budget_is_lost(spark, documents, cases):
    docs, items = cases
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = D.find_passages(documents(docs), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)
    docs = docs + [(None, docs[d][1]) for d in (1, 2, 3, 4, 5)]
    kept = D.clean_documents(documents(docs), bench)
    leaked = {n for n, _ in brute([(n, t) for n, (_, t) in enumerate(docs)], items)}
    assert leaked & set(range(len(docs) - 5, len(docs)))  # rows without an id go, too
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(d) for n, d in enumerate(docs) if n not in leaked)
    assert kept.columns == documents(docs).columns


def test_blocks_give_the_same(spark, documents, cases, monkeypatch):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(str, D.find_passages(documents(docs), bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 400)
    assert sorted(map(str, D.find_passages(documents(docs), bench).collect())) == whole
    kept = sorted(map(str, D.clean_documents(documents(docs), bench).collect()))
    monkeypatch.undo()
    assert kept == sorted(map(str, D.clean_documents(documents(docs), bench).collect()))


def test_one_very_long_text(spark, documents):
    passage = " ".join(f"word{k}" for k in range(40))
    long = "some other words here " * 200_000
    docs = documents([(1, long + passage + long), (2, long)])
    bench = spark.createDataFrame([(5, passage)], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in D.find_passages(docs, bench).collect()] == [(1, 5)]
    assert [r.doc_id for r in D.clean_documents(docs, bench).collect()] == [2]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_passages(documents([(1, "a")]), none).count() == 0
    assert D.find_passages(documents([]), spark.createDataFrame([(1, "a b")], none.schema)).count() == 0


def test_no_excerpt_of_the_stated_length_is_missed():
    r = random.Random(2)
    item = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(90))
    queries, n = D.Queries([(0, item)]), D.SEGMENT + D.STRIDE - 1
    texts = [f"before it {item[i : i + n]} after it" for i in range(len(item) - n + 1)]
    assert set(queries.matches(texts)[0].tolist()) == set(range(len(texts)))


def test_many_items_that_share_a_sentence():
    """10,000 items with one common sentence: its segments are looked up and aligned once."""
    r = random.Random(3)
    common = " ".join(f"common{k}" for k in range(40))
    items = [(i, f"{common} {r.randrange(10**9)} {r.randrange(10**9)}") for i in range(10_000)]
    began = time.time()
    queries = D.Queries(items)
    assert len(queries.length) < 5 * 10_000
    text, segment, *_ = queries.matches([f"a text with {common} in it"] * 2)
    assert set(text.tolist()) == {0, 1} and len(text) < 2 * 40
    assert queries.n_items[segment].max() == 10_000 and time.time() - began < 30


def test_pieces_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 10)
    ends = np.cumsum([3, 3, 3, 3, 25, 1, 9, 1])
    assert list(D._pieces(ends)) == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 8)] and list(D._pieces(ends[:0])) == []
