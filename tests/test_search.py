"""The stages of a search: modes, reranking or passing by, scrubbed results."""

import pytest
from pyspark.sql import functions as F

from folioflow.operators import search
from folioflow.operators.search import Profile


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, "apple " * (i % 4) + "pear", [float(i), 1.0], "v", f"n{i % 5}.md") for i in range(20)]
    made = spark.createDataFrame(rows, "chunk_id bigint, text string, vector array<double>, vault_id string, source_path string")
    cut = F.concat(F.lit("apple "), F.unhex(F.lit("C3")).cast("string"), F.lit(" é "), F.unhex(F.lit("E280")).cast("string"))
    return made.withColumn("text", F.when(F.col("chunk_id") == 19, cut).otherwise(F.col("text")))


def ids(df):
    return [r.chunk_id for r in df.collect()]


def test_modes_and_scrubbed_texts(chunks):
    by_vector = search.search(chunks, "pear", [1.0, 0.0], "vector", Profile(limit=3))
    rows = by_vector.collect()
    assert [r.chunk_id for r in rows] == [19, 18, 17]
    assert rows[0].text == "apple � é ��" and rows[1].text == "apple apple pear"
    words = chunks.where("chunk_id < 19")
    by_word = ids(search.search(words, "apple", None, "keyword", Profile(limit=4)))
    assert by_word == [3, 7, 11, 15]
    assert ids(search.search(words, "apple", None, "hybrid", Profile(limit=4))) == by_word  # the embedder failed
    for mode in ("vector", "other"):
        with pytest.raises(ValueError):
            search.search(words, "apple", None, mode)


def test_reranked_and_passed_by(chunks):
    seen = []

    def rerank(pool, query):
        seen.append(query)
        return pool.withColumn("rerank_score", -F.col("chunk_id").cast("double"))

    ask = lambda **dials: ids(search.search(chunks, "pear", [1.0, 0.0], "vector", Profile(limit=2, candidate_pool=6, **dials), rerank))
    assert ask() == [19, 18] and seen == []
    assert ask(rerank=True) == [12, 13] and seen == ["pear"]  # the last of a pool of eight come first
    pool = chunks.select("chunk_id", (F.col("chunk_id") % 3).cast("double").alias("score"))
    assert ids(search.passthrough(pool, 4, "chunk_id")) == [2, 5, 8, 11]
