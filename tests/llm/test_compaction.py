from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.llm import compaction as C
from folioflow.llm.compaction import ShardStore, compacted


@pytest.fixture
def rows(spark):
    return spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("x").alias("group"), F.lit(1).alias("shard"), F.lit(2).alias("_file"), F.lit(3).alias("_group"), F.lit(4).alias("_shard"), F.lit(5).alias("_metadata"), F.lit(6).alias("file"), F.lit(7).alias("file_"), F.lit(8).alias("a.b"))


def key(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rounds_keep_all_rows_and_shrink_the_number_of_shards(spark, rows, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000)
    assert store.version() == 0 and store.manifest().count() == 0
    for k in range(3):
        assert store.append(rows.where(F.col("doc_id") % 3 == k), shard_rows=100) == k + 1
    small = store.manifest().count()
    first = key(store.read(1))
    version = store.compact()
    assert version == 4 and key(store.read(1)) == first  # readers of an old version aren't disturbed
    version = store.compact_fully()
    assert store.compact() == version
    shards = store.manifest().collect()
    assert len(shards) < small / 4 and sum(s.n_rows for s in shards) == 5000
    assert max(s.n_bytes for s in shards) < 3 * 60_000
    assert store.read().columns == rows.columns and key(store.read()) == key(rows)
    assert store.vacuum() > 0 and key(store.read()) == key(rows)
    assert store.vacuum() == 0
    assert store.append(rows.limit(0)) == version


def test_of_two_writers_one_loses(spark, rows, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(rows.limit(10))
    manifest = store.manifest()
    assert store._commit(manifest, 2) == 2
    with pytest.raises(FileExistsError):
        store._commit(manifest, 2)
    assert store.version() == 2
    assert not [p for p in (tmp_path / "s/manifests").iterdir() if p.name.startswith("_")]


def test_odd_rows_and_empty_tables(spark, documents, odd, tmp_path):
    docs = documents(list(enumerate(odd)) + [(None, None), (1, "")])
    assert key(compacted(docs, f"file://{tmp_path}/a")) == key(docs)
    empty = compacted(documents([]), f"file://{tmp_path}/b")
    assert empty.count() == 0 and empty.columns == docs.columns


def test_no_python_on_the_way(spark, documents, tmp_path):
    plan = compacted(documents([(i, "a") for i in range(50)]), f"file://{tmp_path}/s")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rounds_are_bounded(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "ROUND_SHARDS", 12)
    monkeypatch.setattr(C, "STRETCH_SHARDS", 5)
    monkeypatch.setattr(C, "GROUP_SHARDS", 6)
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=200_000)
    store.append(rows, shard_rows=100)
    plan = store.plan().collect()
    sizes = Counter(r.group for r in plan)
    assert sorted(sizes) == list(range(len(sizes))) and max(sizes.values()) <= 7 and len(plan) == len({r.shard for r in plan}) > 12
    assert store.compact() == 2
    assert len(store.manifest(1).join(store.manifest(2), "shard", "left_anti").collect()) <= 12
    assert store.compact_fully() > 2 and key(store.read()) == key(rows)


def test_a_group_is_one_task_and_one_shard(spark, rows, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000)
    store.append(rows, shard_rows=100)
    groups = {r.group for r in store.plan().collect()}
    before = store.manifest().count()
    moved = store.plan().count()
    store.compact()
    assert len(groups) > 3 and store.manifest().count() == before - moved + len(groups)


def test_one_very_long_text(spark, documents, tmp_path):
    docs = documents([(i, "a") for i in range(20)] + [(99, "long " * 800_000)])
    assert key(compacted(docs, f"file://{tmp_path}/s")) == key(docs)


@pytest.mark.parametrize("name", ["st ore", "50% + more", "a#b", "ü ñ"])
def test_roots_with_odd_characters(spark, rows, tmp_path, name):
    store = ShardStore(spark, f"file://{tmp_path}/{name}", target_bytes=60_000)
    for k in range(4):
        store.append(rows.where(F.col("doc_id") % 4 == k), shard_rows=200)
    version = store.compact_fully()
    assert version > 4 and key(store.read()) == key(rows) and store.vacuum() > 0 and key(store.read(version)) == key(rows)
