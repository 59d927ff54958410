import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import bpe_pieces as B

ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(B.RANKS), special_tokens={})


def expected(text):
    return np.array(ENC.encode_ordinary(text or ""), "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'asdlt ")), max_size=60), max_size=4))
def test_same_ids_as_the_rank_file_asks_for(texts):
    coder = B.codec(B.RANKS, public_tokenizers.PATTERN)
    got = coder.encode(texts)
    assert got == [expected(t) for t in texts]
    assert [coder.decode(x).decode() for x in got] == texts


def test_query_columns_on_odd_rows(spark, documents, odd):
    rows = list(enumerate(odd)) + [(None, "no id"), (3, " \n\t ")]
    got = B.encode_documents(documents(rows), digest=True).collect()
    want = sorted((str(i), len(expected(t)) // 4, hashlib.sha256(expected(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert B.encode_documents(documents([])).count() == 0


def test_forgetting_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(B, "CACHED", 3)
    coder = B.Codec(B.read_ranks(B.RANKS), public_tokenizers.PATTERN)
    texts = ["one two three four five", "six  seven one", "two nine"]
    assert coder.encode(texts) == coder.encode(texts) == [expected(t) for t in texts]
