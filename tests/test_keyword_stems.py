"""Stems in retrieval, by brute force on a small table of four languages."""

import math
import re
import unicodedata
from collections import Counter

import pytest

from folioflow.functions.stemming import STEMMERS
from folioflow.operators import keyword
from folioflow.plans import QUERIES
from folioflow.plans.search_queries import STEM_QUERY

ROWS = [
    (0, "en", "s0", "The houses and the running dogs"),
    (1, "en", "s0", "A house; that dog runs"),
    (2, "de", "s1", "Die Häuser und das Haus öffnen sich, geöffnet"),
    (3, "fr", "s1", "continuellement les maisons continuaient"),
    (4, "es", "s0", "los toreros torean y the casas"),
    (5, "xx", "s0", "unknown houses"),
    (6, None, "s1", "houses houses and"),
    (7, "en", "s1", ""),
    (8, "en", "s0", None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stems")
    spark.createDataFrame(ROWS, "doc_id bigint, lang string, source string, text string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    return str(root)


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def stem(token, lang):
    made = STEMMERS[lang](token) if lang in STEMMERS else token
    return [token] if made == token else [token, made]


def brute(rows, query, lang):
    asked = {x for t in tokens(query) for x in stem(t, lang)}
    docs = {d: (Counter(x for t in tokens(text) for x in stem(t, code)), len(tokens(text))) for d, code, _, text in rows}
    average = sum(n for _, n in docs.values()) / sum(t is not None for *_, t in rows)  # a null text has no length
    df = {q: sum(q in c for c, _ in docs.values()) for q in asked}
    out = {}
    for d, (c, length) in docs.items():
        score = sum(math.log(1 + (len(docs) - df[q] + 0.5) / (df[q] + 0.5)) * c[q] * 2.2 / (c[q] + 1.2 * (0.25 + 0.75 * length / average)) for q in asked if c[q])
        if score:
            out[d] = round(score, 6)
    return out


@pytest.mark.parametrize("query", ["house running", "das Haus und die Häuser geöffnet", "les maisons continuent dans la", "el torero y los toros de la", "", "zzz"])
def test_bm25_of_stems(spark, folder, query):
    lang = keyword.query_language(query)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: round(r.score, 6) for r in keyword.bm25_stems(docs, query).collect()}
    assert got == brute(ROWS, query, lang)
    by = {(r.source, r.doc_id): round(r.score, 6) for r in keyword.bm25_stems(docs, query, group=["source"]).collect()}
    assert by == {(s, d): x for s in ("s0", "s1") for d, x in brute([r for r in ROWS if r[2] == s], query, lang).items()}


def test_query_languages():
    assert [keyword.query_language(q) for q in ("the house and the dog", "das Haus und der Hund", "la casa de los perros", "les chats dans la maison", "xq zz", "")] == ["en", "de", "es", "fr", "en", "en"]


def test_registered_queries(spark, folder):
    got = {(r.lang, r.term, r.stem) for r in QUERIES["stemmed_terms"](spark, folder).collect()}
    assert got == {(c, t, s[1]) for _, c, _, text in ROWS for t in tokens(text) for s in [stem(t, c)] if len(s) == 2}
    assert {x[0] for x in got} == {"de", "en", "es", "fr"}
    ranked = QUERIES["keyword_bm25_stems"](spark, folder).collect()
    want = sorted(brute(ROWS, STEM_QUERY, "en").items(), key=lambda x: (-x[1], x[0]))
    assert [(r.doc_id, r.score) for r in ranked] == want[:10]
    weights = keyword.sparse_vectors(spark.read.parquet(f"{folder}/documents.parquet"), language="lang").collect()
    assert {r.term for r in weights if r.doc_id == 2} == {x for t in tokens(ROWS[2][3]) for x in stem(t, "de")}


def test_han_texts_stay_in_spark(spark):
    """What NFKC keeps isn't sent to Python, and what is kept is kept in any company."""
    keeps = re.compile(f"[{keyword.STABLE}]")
    second = {int(d.split()[1], 16) for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and d[0] != "<" and len(d.split()) == 2}
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for c in filter(keeps.match, map(chr, range(0x110000))):
        assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and ord(c) not in second | jamo
    texts = ["plain", "für 数据库", "ﬁn", "é", "ガ", "ｶ", "각", "ß ", "x²", "", None, "Москва", "“q” – …", "\U0001d400"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = docs.selectExpr("i", "t", "1 AS one").select("i", "t", docs["t"].rlike(keyword.CHANGED_BY_NFKC).alias("sent"), keyword.nfkc(docs["t"]).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [t and unicodedata.normalize("NFKC", t) for t in texts]
    assert not any(r.sent for r in rows if r.t and r.n == r.t and not re.search("[“…]", r.t))


def test_stored_counts_give_the_same_scores(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for group in ([], ["source"]):
        plain, stored = (sorted(map(tuple, keyword.bm25(docs, "the houses and", group=group, stored=s).collect())) for s in (False, True))
        assert plain == stored and plain
    plan = keyword.bm25(docs, "the", stored=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_terms_are_counted_within_the_row(spark):
    rows = [(0, "b a b  c a b"), (1, ""), (2, None), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: (r.length, [(t.term, t.tf) for t in r.terms or []]) for r in keyword.term_counts(docs, ["doc_id"]).collect()}
    assert got == {0: (6, [("a", 2), ("b", 3), ("c", 1)]), 1: (0, []), 2: (None, []), 3: (1, [("x", 1)])}
    plan = keyword.weights(keyword.term_counts(docs, ["doc_id"]), docs.selectExpr("1L AS length"), distinct=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the average's


def test_the_average_and_the_asked_terms_need_no_shuffle_of_postings(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id int, text string")
    stored = keyword.sparse_vectors(docs)
    sized = stored._jdf.queryExecution().optimizedPlan().toString()
    assert sized.count("Aggregate") == 2  # the postings once, the lengths once
    scored = keyword.score_postings(stored, "a", 2)
    assert "regexp_extract_all" not in scored._jdf.queryExecution().optimizedPlan().toString()  # made once, for the asked terms
    assert [r.doc_id for r in scored.collect()] == [1]


def test_stems_are_made_once(spark, folder):
    plan = QUERIES["stemmed_terms"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [run(") <= 2  # the form of the texts, the stems
