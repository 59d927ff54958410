import random

import numpy as np
import pytest

from folioflow.llm import hyperminhash as H
from folioflow.llm import jaccard as J
from tests.llm.test_jaccard import brute, corpus


def answer(spark, documents, rows, n=4, percent=80):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in H.links(documents(rows), n, percent).collect()), key=str)


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 80), (3, 3, 90)])
def test_same_as_brute_force(spark, documents, odd, seed, n, percent):
    rows = corpus(seed, 160) + list(enumerate(odd, 500))
    assert answer(spark, documents, rows, n, percent) == brute(rows, n, percent)


def test_large_keys_groups_and_blocks_are_dealt(spark, documents, monkeypatch):
    monkeypatch.setattr(J, "GROUP_NODES", 3)
    monkeypatch.setattr(J, "BLOCK_ITEMS", 2_000)
    monkeypatch.setattr("folioflow.llm.common.HOT_ROWS", 3)
    rows = corpus(4, 80)
    assert answer(spark, documents, rows) == brute(rows, 4, 80)


def test_near_copies_of_one_long_text_and_rows_repeated_very_often(spark, documents):
    r = random.Random(3)
    words = [f"w{r.randrange(4000)}" for _ in range(3000)]
    rows = []
    for i in range(40):
        text = list(words)
        for _ in range(r.choice([0, 10, 60, 200, 700])):
            text[r.randrange(3000)] = f"x{r.randrange(900)}"
        rows.append((i, " ".join(text)))
    rows += [(None, rows[0][1])] * 300 + [(5, rows[5][1])] * 4 + [(900, " ".join(f"v{r.randrange(9**6)}" for _ in range(100_000)))]
    assert answer(spark, documents, rows) == brute(rows, 4, 80)
    kept = H.kept(documents(rows), 4, 80).collect()
    assert len(kept) == len({c for _, _, c in brute(rows, 4, 80)})


def test_empty_table(spark, documents):
    assert answer(spark, documents, []) == []


def sets_of(r, size, similarity):
    """Two sets of this size with about this similarity."""
    common = round(2 * size * similarity / (1 + similarity))
    pool = r.choice(1 << 62, 2 * size - common, replace=False).astype(np.uint64) * np.uint64(2)
    return np.sort(pool[:size]), np.sort(np.concatenate((pool[size:], pool[:common])))


@pytest.mark.parametrize("size", [20, 100, 1000, 20_000])
@pytest.mark.parametrize("similarity", [0.0, 0.5, 0.8])
def test_estimates_are_corrected_for_collisions(size, similarity):
    r = np.random.default_rng(size)
    found = []
    for _ in range(300):
        a, b = sets_of(r, size, similarity)
        x, y = H.registers([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found.append(H.estimate((x == y).sum(), float(size), float(size)) - true)
    assert abs(np.mean(found)) < (0.01 if size >= 100 else 0.03)


@pytest.mark.parametrize("size", [80, 130, 600, 5000])
def test_linked_sets_share_a_key_and_pass_the_estimate(size):
    r = np.random.default_rng(size)
    near = H.near_registers(80)
    for _ in range(500):
        a, b = sets_of(r, size, 0.8)
        rows = H.registers([a, b])
        keys = H.band_keys(rows)
        assert len(np.intersect1d(keys[0], keys[1])) and near(np.array([len(a)]), rows[:1], len(b), rows[1])[0]


def test_unlike_sets_mostly_fall_out():
    r = np.random.default_rng(5)
    near = H.near_registers(80)
    passed = 0
    for _ in range(300):
        a, b = sets_of(r, 500, 0.3)
        rows = H.registers([a, b])
        passed += near(np.array([500]), rows[:1], 500, rows[1])[0]
    assert passed == 0


def test_registers_keep_zeros_and_mantissa():
    for value in (0, 1, 5, (1 << H._REST) - 1, 0b1011011 << 20, 1 << 40, 0b1_1011_11 << 44):
        zeros = H._REST - value.bit_length()
        want = 15 if zeros > 15 else zeros
        bits = (value << (want + 1)) % (1 << H._REST) >> (H._REST - 4)
        assert H.compress(np.array([value], np.uint64))[0] == want << 4 | bits
