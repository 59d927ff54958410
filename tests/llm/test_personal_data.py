import hashlib
import itertools
import re
from dataclasses import fields

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import personal_data as P
from folioflow.llm.common import Words

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(m[0])))) % 10 == 0]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0159@.-+() _é:", max_size=60))
def test_patterns(text):
    assert P.base_spans(text) == plain(text)


@pytest.fixture(scope="module")
def field():
    return P.model()


def full_path(tables, shape):
    """Best labels over the whole sequence by trying everything that Viterbi could."""
    pad = np.concatenate(([P.OUTSIDE], shape, [P.OUTSIDE]))
    score = tables.own[shape] + tables.before[pad[:-2]] + tables.after[pad[2:]]
    best = max(itertools.product(range(len(P.LABELS)), repeat=len(shape)), key=lambda ys: sum(score[i, y] for i, y in enumerate(ys)) + sum(tables.moves[a, b] for a, b in zip((0, *ys), (*ys, 0))))
    return list(best)


def test_decoding_runs_is_decoding_the_whole(field):
    tables = field.tables()
    for sentence, _ in P.labelled_table(40, seed=3):
        words = Words([" ".join(sentence.split()[:5]).encode()])
        shape, _, _ = P.shapes(words)
        at, label = tables.decode(shape, words.first)
        got = np.zeros(len(shape), int)
        got[at] = label
        assert got.tolist() == full_path(tables, shape)


def test_field_learns_shapes(field):
    tables = field.tables()
    right = total = 0
    for sentence, labels in P.labelled_table(300, seed=99):
        words = Words([sentence.encode()])
        at, label = tables.decode(P.shapes(words)[0], words.first)
        got = np.zeros(len(labels), int)
        got[at] = label
        right += int((got == labels).sum())
        total += len(labels)
    assert right / total > 0.97


def test_added_spans(field):
    tables = field.tables()
    text = "Call (555) 123-4567 or use key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff. é In 2024 v1.2 cost $12.50."
    (base, spans), (none, clean) = P.find([text.encode(), b"In 2024 the 3 of 4.0 were CC BY-NC."], tables)
    assert base == [] and none == [] and clean == []
    assert {(k, text[a:b]) for k, a, b in spans} == {("phone", "555) 123-4567"), ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")}


LISTS = {
    "call 555-123-4567, 555-987-6543 now": ["555-123-4567", "555-987-6543"],
    "555-123-4567\n555-987-6543\n555-111-2222": ["555-123-4567", "555-987-6543", "555-111-2222"],
    "555-123-4567 555-987-6543": ["555-123-4567", "555-987-6543"],
    "(555) 123-4567 (555) 987-6543": ["555) 123-4567", "555) 987-6543"],
    "(555) 123-4567\n(555) 987-6543": ["555) 123-4567", "555) 987-6543"],
    "é +1-784-555-8120, 555-987-6543": ["+1-784-555-8120", "555-987-6543"],
    "(555)\n123-4567": ["555)\n123-4567"],
}


@pytest.mark.parametrize("text", LISTS)
def test_adjacent_numbers(field, text):
    ((_, spans),) = P.find([text.encode()], field.tables())
    assert [text[a:b] for k, a, b in sorted(spans, key=lambda s: s[1]) if k == "phone"] == LISTS[text]


def test_adjacent_cards(field):
    text = "pay 4111111111111111 5500005555555559 or 4111111111111112 soon"
    ((base, spans),) = P.find([text.encode()], field.tables())
    assert base == [] and [text[a:b] for k, a, b in spans if k == "card"] == ["4111111111111111", "5500005555555559"]


def test_query(spark, documents, odd, field):
    rows = list(enumerate([*odd, "é x.y@a.b.c, 1.2.3.4 4111 1111 1111 1111 +1 (784) 555-8120", "300.1.1.1 " * 3])) + [(None, "a@b.c"), (0, None)]
    got = P.find_in_documents(documents(rows), field).collect()
    want = []
    for i, t in rows:
        spans = plain(t or "")
        spelled = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((str(i), *[sum(k == j for k, _, _ in spans) for j in range(4)], hashlib.sha256(spelled.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:6]) for r in got) == sorted(want)
    assert P.find_in_documents(documents([]), field).count() == 0


def test_redaction_keeps_rows_and_columns(spark, documents, field):
    docs = documents([(1, "mail a@b.c now"), (2, None), (3, "clean")])
    got = P.redact(docs, field)
    assert got.schema == docs.schema
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail <email> now", 2: None, 3: "clean"}


def test_training_gives_the_same_field_again():
    field = P.model()
    assert P.model() is field
    again = P.train(P.labelled_table(seed=11))
    assert all(np.array_equal(getattr(field, n.name), getattr(again, n.name)) for n in fields(field))
