"""The index by term against the scores of all documents."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import inverted, keyword

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents of two vocabularies, some null or empty, a third of the rows equal, ids that repeat."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(rng.choices(WORDS[:25] if i % 2 else WORDS[15:], k=rng.randint(1, 60)))) for i in range(300)]
    rows += [(1000 + i, "a", "w1 w2 w2 same") for i in range(150)] + [(7, "b", None), (8, "a", ""), (9, "b", "w1 rare"), (9, "b", "w1 rare rare"), (2000, "a", "w3 " * 30_000)]
    path = str(tmp_path_factory.mktemp("index"))
    spark.createDataFrame(rows, "id bigint, lang string, body string").withColumn("row", F.lit(1)).withColumn("term", F.lit("x")).repartition(5).write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    return docs, {near: inverted.build(docs, f"{path}/{len(near)}", "id", "body", near, buckets=8, block=16) for near in ((), ("lang",))}


@pytest.mark.parametrize("near, k, query", [(("lang",), 10, q) for q in ("w2 w1 w30", "rare", "w3 w3", "w5 nowhere W6", " . ")] + [((), 1, "w1"), ((), 170, "same w1")])
def test_same_rows_as_all_scores(spark, made, near, k, query):
    docs, indexes = made
    want = sorted((-round(r.score, 9), r.id) for r in keyword.bm25(docs, query, "id", text="body").collect())[:k]
    assert [(-round(r.score, 9), r.id) for r in indexes[near].top_k(query, k).collect()] == want


def test_few_folders_and_blocks_are_read(spark, made):
    index = made[1][("lang",)]
    bounds, idf = index.bounds("rare w1")
    assert list(idf) == ["rare", "w1"]
    scan = index.scored(idf, [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in scan and "In(term, [rare,w1])" in scan and "In(block, [0,1])" in scan
    read = index.scored(idf, [0, 1]).select(F.col("row")).count()
    assert 0 < read <= 32
    all_blocks, floor = bounds.count(), index.top_k("rare w1", 2).agg(F.min("score")).first()[0]
    assert bounds.where(F.col("bound") >= floor * (1 - inverted.SLACK)).count() < all_blocks / 4


def test_bounds_hold(spark, made):
    for index in made[1].values():
        bounds, idf = index.bounds("w1 w2 w30 same")
        scores = index.scored(idf, bounds).withColumn("block", F.floor((F.col("row") - 1) / index.block))
        assert scores.join(bounds, "block").where(F.col("score") > F.col("bound") * (1 + inverted.SLACK)).count() == 0


def test_more_blocks_than_literals(spark, made, monkeypatch):
    monkeypatch.setattr(inverted, "LITERALS", 1)
    docs, indexes = made
    want = sorted(((-round(r.score, 9), r.id) for r in keyword.bm25(docs, "w2 w1", "id", text="body").collect()))[:20]
    assert [(-round(r.score, 9), r.id) for r in indexes[()].top_k("w2 w1", 20).collect()] == want


def test_stems(spark, tmp_path):
    spark.createDataFrame([(1, "en", "houses"), (2, "en", "house"), (3, "de", "Häuser"), (4, "en", "tree")], "doc_id int, lang string, text string").write.parquet(f"{tmp_path}/docs")
    index = inverted.build(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/index", language="lang")
    assert sorted(r.doc_id for r in index.top_k("houses", 9, "en").collect()) == [1, 2]


def test_empty_table(spark, made, tmp_path):
    spark.createDataFrame([], "doc_id int, text string").write.parquet(f"{tmp_path}/docs")
    index = inverted.build(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/index")
    assert index.top_k("a", 3).collect() == []
    with pytest.raises(ValueError):
        index.top_k("a", 0)
