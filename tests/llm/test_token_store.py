import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import token_store as S
from folioflow.llm.common import NULL_ID


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(1, 40))
def test_block_round_trip_from_every_checkpoint(values, lanes):
    values = np.array([v * v // 40 for v in values], np.uint32)
    coder = S.Coder(S.normalise(np.bincount(values, minlength=41)))
    payload, n_lanes, states, marks = coder.encode(values)
    for c in range(len(marks)):
        got = coder.decode(payload, n_lanes, states, marks, len(values), checkpoint=c)
        assert (got == values[c * S.STEPS * n_lanes :]).all()
    if len(marks) > 1:
        assert (coder.decode(payload, n_lanes, states, marks, len(values), stop=1) == values[: S.STEPS * n_lanes]).all()


def test_frequencies():
    for counts in ([0, 0], [1, 0, 10**12], [1] * 5000, [10**9] + [1] * 40000):
        out = S.normalise(np.array(counts))
        assert out.sum() == 1 << S.PRECISION and all(o > 0 for o, c in zip(out, counts) if c)


@cache
def library():
    return Tokenizer.from_file(S.TOKENIZER)  # as loaded, apart from the operator's own


def library_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, S.END_ID]


def test_dataset(spark, documents, odd, monkeypatch):
    monkeypatch.setattr(S, "LEAST_PART_BYTES", 4000)
    monkeypatch.setattr(S, "BLOCK_IDS", 50)
    rows = list(enumerate([*odd, "The QUICK, brown fox's É é <|endoftext|> don't.", "<|startoftext|> a<|endoftext|>", "one two " * 300, "Long, très long 日本 " * 150_000])) + [(None, "no id"), (-5, "b"), (4, "again")]
    got = [tuple(r) for r in S.round_trip(documents(rows)).collect()]
    key = lambda i: NULL_ID if i is None else i
    coded = sorted(((key(i), library_ids(t)) for i, t in rows), key=lambda x: x[0])
    got = sorted(((key(g[0]), *g[1:]) for g in got), key=lambda g: g[1])
    assert [g[0] for g in got] == [i for i, _ in coded]
    at = 0
    for g, (i, _) in zip(got, coded):
        assert g[1] == at
        at += g[2]
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    assert sorted((g[0], g[2], g[3]) for g in got) == sorted((i, len(v), crc(v)) for i, v in coded)
    assert S.round_trip(documents([])).count() == 0


def test_damage_is_seen():
    values = np.arange(500, dtype=np.uint32) % 7
    coder = S.Coder(S.normalise(np.bincount(values)))
    payload, lanes, states, marks = coder.encode(values)
    row = {"part": 0, "block": 0, "n": 500, "payload": payload.tobytes(), "lanes": lanes, "states": states.tobytes(), "marks": marks.tobytes(), "ids_crc32": zlib.crc32(values.astype("<u4").tobytes()), "payload_crc32": zlib.crc32(payload.tobytes())}
    assert (S.decode_block(coder, row) == values).all()
    with pytest.raises(ValueError):
        S.decode_block(coder, row | {"payload": b"\1" + row["payload"][1:]})


def test_ids_are_those_of_the_library_alone():
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>don't É", "日本 <|endoftext|><|startoftext|> 1", "<|ENDOFTEXT|> <|endof text|>", "<| endoftext |> plain", "<|endoftext|", "é <|END"]
    texts += ["a\x1cb\x85c\xa0d\u2003e\u3000f", "e\u0301 =\u0338 \u0301x", "ΣΑΣ Σ İI ß ẞ", "it's'LL d'd 12,3.. ``--''", "\ufeff\x00 \x7f", "一 二三\u200b四", "ﬁ ① x²", ""]
    got = [np.frombuffer(x, S.encoder(S.TOKENIZER).kind).tolist() for x in S.encoder(S.TOKENIZER).encode([t.encode() for t in texts])]
    assert got == [library().encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [320, 49407, 321]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_text_as_the_library(texts):
    got = [np.frombuffer(x, S.encoder(S.TOKENIZER).kind).tolist() for x in S.encoder(S.TOKENIZER).encode([t.encode("utf-8", "replace") for t in texts])]
    assert got == [library().encode(t.encode("utf-8", "replace").decode(), add_special_tokens=False).ids for t in texts]


def test_runs_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(S, "CACHED", 3)
    coder = S.WordEncoder(S.TOKENIZER)
    for k in range(5):
        texts = [f"word{k} and é{k}, once", "and again"]
        assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode([t.encode() for t in texts])] == [library().encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_of_one_id_fill_many_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "LEAST_PART_BYTES", 500)
    docs = documents([(7, f"text {i}") for i in range(400)] + [(None, f"n {i}") for i in range(100)])
    assert docs.select("text").count() == 500 and S.tokenised(docs).select("part").distinct().count() > 3
    got = S.round_trip(docs).orderBy("start").collect()
    assert [g.doc_id for g in got] == [None] * 100 + [7] * 400
    assert [g.start for g in got] == np.cumsum([0] + [g.n_tokens for g in got])[:-1].tolist()


def test_a_word_is_learned_once_with_all_signs():
    coder = S.WordEncoder(S.TOKENIZER)
    text = " ".join(f"{a}{word}{z}" for word in ("alpha", "beta", "gamma", "don't", "I'LL") for a in ("", "(", "'") for z in ("", "...", "$$$", ",", "'"))
    assert np.frombuffer(coder.encode([text.encode()])[0], coder.kind).tolist() == library().encode(text, add_special_tokens=False).ids
    assert len(coder.runs.young) < 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="astldmLLRVE''''$.=< 1é̸́ß", max_size=30), max_size=4))
def test_runs_cut_at_signs_as_the_library(texts):
    got = [np.frombuffer(x, S.encoder(S.TOKENIZER).kind).tolist() for x in S.encoder(S.TOKENIZER).encode([t.encode() for t in texts])]
    assert got == [library().encode(t, add_special_tokens=False).ids for t in texts]
