"""The pipeline's stages against brute force, on a small folder of tables with planted cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from folioflow.llm import bpe_pieces, hyperminhash, jaccard, personal_data, toxicity
from folioflow.llm.queries import oracle_sql, queries

ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_pieces.read_ranks(bpe_pieces.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n))
    bench = [(i, prose(30)) for i in range(5)]
    texts, toxic = [], []
    for i in range(400):
        bad = i % 5 == 1
        texts.append(f"{prose(40)} {'idiot clown' if bad else 'fine day'} {prose(20)}")
        toxic.append(int(bad))
    texts[10] = texts[2]  # exact copy
    texts[20] = texts[12].replace("fine day", "good night")  # near copy
    texts[30] += " " + bench[3][1].upper()
    texts[40] += " write to jo.e@mail.example.org or +1 (784) 555-8120"
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)] + [(400, None, "en", None, None), (401, "", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic) if i < 300], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), texts


def test_stages_in_order(spark, folder):
    root, texts = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = docs.columns
    alive = set(range(402))
    gone = [{i for i in range(400) if i % 5 == 1}, {10, 20}, {30}, set()]
    for (name, stage), drop in zip(C.STAGES[:-1], gone, strict=True):
        docs = stage(spark, docs, root)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        alive -= drop
        assert {r.doc_id for r in docs.collect()} == alive, name
    by = {r.doc_id: r.text for r in docs.collect()}
    assert by[400] is None and by[401] == "" and by[3] == texts[3]
    assert by[40].endswith("write to <email> or <phone>")
    got = {r.doc_id: tuple(r) for r in C.run(spark, root).collect()}
    for i, t in by.items():
        ids = np.array(ENC.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[i] == (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert set(got) == set(by)


def test_stages_call_the_operators():
    assert [n for n, _ in C.STAGES] == ["toxicity", "near duplicates", "decontamination", "personal data", "encoding"] and C.ORACLE_SQL is None
    assert personal_data.LABELS[0] == "other"
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)} and set(oracle_sql()) <= set(queries())


def test_stages_take_empty_tables_and_clashing_names(spark, documents):
    """The stages that judge or change texts keep extra columns, whatever they are called, and take tables without rows."""
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    rows = [(i, f"{'idiot clown' if i % 2 else 'fine day'} number {i}") for i in range(40)] + [(50, None), (51, "")]
    names = ["score", "predicted", "held_out", "toxic", "text_hash", "kind"]
    docs = documents(rows)
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    for stage in (lambda d: toxicity.reject(d, labels), personal_data.redact, jaccard.kept, hyperminhash.kept):
        got = stage(docs)
        assert got.columns == docs.columns and got.where(F.col("score") != "score").isEmpty() and got.count() > 0
        assert stage(docs.where("doc_id < 0")).count() == 0
    assert toxicity.reject(docs, labels.where("doc_id < 0")).count() == docs.count()
