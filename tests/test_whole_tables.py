"""Queries over all rows of a table, by brute force on small tables that the plain ones lack."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import dense, usage
from folioflow.plans import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    """Writes a documents table of the given texts and gives its folder."""

    def build(texts):
        rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return build


TAGGED = ["plain", "a #Tag and #area/sub/ here", "`#code` #out", "```\n#no\n```\n#yes", "~~~ #no ~~~ #late", "one ` two #open", "# head #über", "#42 #1-2 x#y", "``` #unclosed"]


def tags_of(i, text):
    """The tags of markdown(text) by a scan, without the library's columns."""
    body = f"# src0\n\n{text}\n\n## Tail\n\nSee [[doc-{i % 50}|alias]] and #area/x{i % 4} `#no`\n"
    for fence in ("```", "~~~"):
        parts, kept = body.split(fence), []
        while len(parts) >= 3:
            kept.append(parts[0])
            parts = parts[2:]
        body = " ".join([*kept, fence.join(parts)])
    lines = []
    for line in body.split("\n"):
        parts, kept = line.split("`"), []
        while len(parts) >= 3:
            kept.append(parts[0])
            parts = parts[2:]
        lines.append(" ".join([*kept, "`".join(parts)]))
    out = [f"t{i % 7}", "en"]
    for word in "\n".join(lines).split():
        m = re.match(r"#(\w[\w/-]*)", word)
        tag = m[1].rstrip("/-") if m else ""
        if tag and not re.fullmatch(r"[0-9/_-]+", tag) and tag not in out:
            out.append(tag)
    return "[" + ", ".join(out) + "]"


def test_note_fields_of_every_document(spark, folder):
    got = {r.note_id: r.tags for r in QUERIES["note_fields_all"](spark, folder(TAGGED)).collect()}
    assert got == {i: tags_of(i, t) for i, t in enumerate(TAGGED)}
    assert "Tag" in got[1] and "code" not in got[2] and "yes" in got[3] and "late" in got[4]


def test_edits_of_every_document(spark, folder):
    texts = ["a", "a!", "a!!", "!", "", "😀!", "x!x"]
    got = {r.doc_id: (r.offset, r.deleted, r.inserted) for r in QUERIES["minimal_edits_all"](spark, folder(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        offset, deleted, inserted = got[i]
        raw = t.encode("utf-16-le")
        assert (raw[: 2 * offset] + inserted.encode("utf-16-le") + raw[2 * (offset + deleted) :]).decode("utf-16-le") == t + "!x"
        assert deleted == 0 and len(inserted) == 2


def test_block_search_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "CHUNK", 16)
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(90)] + [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(90, 130)]
    vectors += [(130, None), (131, [0.0] * 6), (132, [1.0, 2.0]), (133, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").repartition(3)
    asked = rows.selectExpr("vec_id AS query_id", "embedding AS query")
    want = rows.crossJoin(asked).select("query_id", "vec_id", dense.cosine(F.col("embedding"), F.col("query")).alias("score")).collect()
    best = {}
    for r in sorted(want, key=lambda r: (r.query_id, -r.score, r.vec_id)):
        best.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for block, high in ((50, 40), (4096, 4096)):  # many blocks, and one
        got = {}
        for r in sorted(dense.query_top_k(rows, asked, 5, block=block, rows=high).collect(), key=lambda r: (r.query_id, -r.score, r.vec_id)):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == {q: b[:5] for q, b in best.items()}


def test_block_search_of_odd_tables(spark):
    """Rows of one id fill several blocks; equal query ids are one query; clashing names; empty tables."""
    rows = spark.createDataFrame([(7, [1.0, float(i)], "x") for i in range(40)] + [(8, [0.0, 1.0], "y")], "vec_id int, embedding array<double>, query string")
    asked = spark.createDataFrame([("a", [0.0, 1.0], 1), ("b", None, 2), ("c", [], 3)], "query_id string, query array<double>, _v int")
    got = sorted((r.query_id, -r.score, r.vec_id) for r in dense.query_top_k(rows, asked, 2, rows=10).collect())
    assert [g[0] for g in got] == ["a", "a", "b", "b", "c", "c"] and got[0] == ("a", -1.0, 8) and got[2:] == [("b", 0.0, 7), ("b", 0.0, 7), ("c", 0.0, 7), ("c", 0.0, 7)]
    assert dense.query_top_k(rows.limit(0), asked).count() == 0
    assert dense.query_top_k(rows, asked.limit(0)).count() == 0


def test_block_search_takes_more_than_ten_thousand_queries(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    asked = spark.range(10_002).selectExpr("id AS query_id", "array(1.0f, float(id)) AS query")
    got = dense.query_top_k(vectors, asked, 1)
    assert sorted((r.vec_id, r["count"]) for r in got.groupBy("vec_id").count().collect()) == [(1, 2), (2, 10_000)]


def test_folds_hold_a_batch_and_not_a_key(spark):
    rows = spark.range(300).selectExpr("id AS event_id", "IF(id % 3 = 0, id % 5, 7) AS user_id", "timestamp_seconds(id * id % 977 * 60) AS ts")
    makers = [lambda r: usage.token_bucket(r, capacity=3.0, per_second=0.001), lambda r: usage.debounce(r, quiet=90, ceiling=600)]
    whole = [sorted(map(tuple, m(rows).collect())) for m in makers]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [sorted(map(tuple, m(rows).collect())) for m in makers] == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for m in makers:  # no operator that gathers a group
        assert "FlatMapGroups" not in m(rows)._jdf.queryExecution().toString()
