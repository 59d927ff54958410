import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import dense, feed, keyword, search, usage
from folioflow.sources import tables
from folioflow.streaming import folds, sinks


def test_bm25_weight(spark):
    rows = spark.createDataFrame([(1, 100, 100.0), (2, 100, 100.0), (1, 50, 100.0), (1, 200, 100.0)], "tf int, n int, a double")
    got = [r[0] for r in rows.select(keyword.tf_weight(F.col("tf"), F.col("n"), F.col("a"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] > got[0] and got[2] > got[0] > got[3]
    assert keyword.bm25(spark.createDataFrame([(1, "a")], "doc_id int, text string"), "?!").count() == 0


def test_stored_postings_score_like_texts(spark):
    docs = spark.createDataFrame([(i, "the cat " * (i % 4) + "dog sat") for i in range(12)], "doc_id int, text string")
    a = {r.doc_id: round(r.score, 9) for r in keyword.bm25(docs, "cat sat").collect()}
    b = {r.doc_id: round(r.score, 9) for r in keyword.score_postings(keyword.sparse_vectors(docs), "cat sat", 12).collect()}
    assert a == b


def test_cosine_and_quantised(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.5])], "vec_id int, embedding array<float>")
    assert [(r.vec_id, round(r.score, 6)) for r in dense.top_k(rows, [2.0, 0.0]).collect()] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, -0.894427)]
    bits = rows.where("vec_id = 4").select(dense.signs(F.col("embedding")).alias("s")).first()["s"]
    assert bits == [1]


def test_mmr():
    vectors = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], None]
    scores = np.array([0.9, 0.89, 0.7, 0.6])
    assert search.mmr_order(scores, vectors, 0.0, 3) == [0, 1, 2]
    assert search.mmr_order(scores, vectors, 0.7, 3) == [0, 2, 3]
    assert search.mmr_order(np.array([]), [], 0.5, 3) == []


def test_profile():
    p = search.Profile.resolve({"limit": None, "diversity": 0.4}, {"limit": 7}, {"limit": 9, "group": True})
    assert (p.limit, p.diversity, p.group, p.pool) == (7, 0.4, True, 28) and search.Profile().pool == 5
    assert search.clamped(0) == 1 and search.clamped(500) == 100


def test_blend_of_missing_candidates(spark):
    pool = spark.createDataFrame([(1, 1.0, 5.0), (2, 0.5, None), (3, 0.2, 9.0)], "doc_id int, score double, rerank_score double")
    got = {r.doc_id: round(r.blend, 6) for r in search.blended(pool, 5).collect()}
    assert got == {1: 0.4, 2: 0.2 + 0.6 * -1.25, 3: 0.68}


def changes(spark, n, step=1, size=10, seq0=0):
    return spark.createDataFrame([(seq0 + i * step // 2, i, size) for i in range(n)], "seq bigint, id bigint, content_bytes bigint")


def test_pages_pass_nothing_over(spark):
    a, b = changes(spark, 37), changes(spark, 9, step=7).withColumn("id", F.col("id") + 1000)
    want = sorted((r.seq, r.id) for df in (a, b) for r in df.collect())
    got, cursor = [], (-1, -1)
    while True:
        rows = feed.merged_page([a, b], *cursor, limit=5).orderBy("seq", "id").collect()
        got += [(r.seq, r.id) for r in rows]
        if not rows or not rows[0].has_more:
            break
        cursor = got[-1]
    assert got == want


def test_byte_budget_always_ships_one(spark):
    rows = feed.page(changes(spark, 9, size=600_000), -1, -1, 100, budget=400_000).collect()
    assert len(rows) == 1 and rows[0].has_more
    assert len(feed.page(changes(spark, 9, size=600_000), -1, -1, 100, budget=4_000_000).collect()) == 6
    last = feed.page(changes(spark, 3), -1, -1, 3).collect()
    assert len(last) == 3 and not last[0].has_more


def test_batches_are_all_or_nothing(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2)], "id int, seq int")
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert feed.batch_change(rows, ask(1, 2), 7).count() == 2 and feed.batch_change(rows, ask(1, 3), 7).count() == 0


def test_folders(spark):
    notes = spark.createDataFrame([("v", "a/b/x.md"), ("v", "a/y.md"), ("v", "z.md")], "vault_id string, path string")
    markers = spark.createDataFrame([("v", "a")], "vault_id string, folder string")
    assert [tuple(r) for r in feed.implied_folders(notes, markers).collect()] == [("v", "a/b", "a")]
    assert {(r.folder, r.notes) for r in feed.tree(notes).collect()} == {("", 1), ("a", 1), ("a/b", 1)}
    moves = spark.createDataFrame([("a", "q"), ("a/b", "r")], "old string, new string")
    assert {r.path: r.new_path for r in feed.retargeted(notes, moves).collect()} == {"a/b/x.md": "r/x.md", "a/y.md": "q/y.md", "z.md": None}


def test_meter_is_anchored():
    m = usage.Meter(window=30, per_conversation=3, conversations=2, queries=100)
    minute = 60_000_000
    assert [m(t * minute) for t in (0, 29, 30, 31)] == [(1, 1, "allowed"), (1, 2, "allowed"), (1, 3, "allowed"), (2, 1, "allowed")]
    assert m(62 * minute) == (3, 0, "conversation_cap") and m(63 * minute)[2] == "conversation_cap"
    assert m(1440 * minute) == (1, 1, "allowed")


def test_bucket():
    b = usage.Bucket(capacity=2, per_second=1)
    assert [b(int(t * 1e6))[1] for t in (0, 0, 0, 0.5, 1)] == ["allowed", "allowed", "denied", "denied", "allowed"]


def test_debounce():
    assert usage.debounced([0, 10, 20, 100], quiet=30, ceiling=300) == [(0, 50, 3), (100, 130, 1)]
    assert usage.debounced(list(range(0, 101, 10)), quiet=30, ceiling=60) == [(0, 60, 7), (70, 130, 4)]
    assert usage.debounced([0, 1, 50], quiet=5, ceiling=60, eager=2, idle=5) == [(0, 2, 2), (50, 52, 1)]
    assert usage.debounced([], 1, 2) == []


def test_small_columns(spark):
    row = spark.range(1).select(usage.compaction_due(F.lit(500_000), F.lit(1000)), usage.embed_priority(F.lit(None)), usage.idle_delay(F.lit(400), F.lit(20)), usage.bucketed(F.lit(11), [10, 20]), usage.retry_after(F.lit("2024-01-01").cast("timestamp"), F.lit("transient"))).first()
    assert tuple(row) == (True, 9, 2400, 1, dt.datetime(2024, 1, 1, 0, 5))


def test_sinks_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i % 3}") for i in range(30)], "id int, vault_id string")
    tables.write_by_vault(rows, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").where("vault_id = 'v1'")
    assert back.count() == 10 and "PartitionFilters: [isnotnull(vault_id" in back._jdf.queryExecution().toString()
    (tmp_path / "b.bin").write_bytes(b"xyz")
    assert bytes(tables.blobs(spark, str(tmp_path), "*.bin").first()["content"]) == b"xyz"
    chunks = spark.createDataFrame([(i, "t" * i) for i in range(5)], "id int, context_text string")
    assert [r.dense for r in tables.embedded(chunks, lambda ts: [[float(len(t))] for t in ts], batch=2).orderBy("id").collect()] == [[float(i)] for i in range(5)]


@pytest.mark.parametrize("name,dials", [("conversation_meter", {"window": 720, "per_conversation": 3, "conversations": 2, "queries": 4}), ("token_bucket", {"capacity": 3.0, "per_second": 5e-6})])
def test_streams_equal_batches(spark, tmp_path, name, dials):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    for k, (a, b) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2025-01-01"))):
        rows.where(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/part=*")
    q = getattr(folds, name)(stream, **dials).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, getattr(usage, name)(rows, **dials).collect()))


def test_index_with_stems_and_compatibility_forms(spark):
    docs = spark.createDataFrame([(1, "en", "running RUNS ﬁling"), (2, "en", "the runner"), (3, "de", "running"), (4, "en", None), (5, "en", "ﾃﾞｰﾀ １２")], "doc_id int, lang string, text string")
    raw = {(r.doc_id, r.term): r.tf for r in keyword.postings(docs, ["doc_id"]).collect()}
    assert raw == {(1, "running"): 1, (1, "runs"): 1, (1, "filing"): 1, (2, "the"): 1, (2, "runner"): 1, (3, "running"): 1, (5, "デー"): 1, (5, "ータ"): 1, (5, "12"): 1}
    both = {(r.doc_id, r.term): r.tf for r in keyword.postings(docs, ["doc_id"], language="lang").collect()}
    assert both == raw | {(1, "run"): 2, (1, "file"): 1} or both == raw | {(1, "run"): 2, (1, "file"): 1, (2, "runner"): 1}
    stored = keyword.sparse_vectors(docs, language="lang")
    assert {(r.doc_id, r.term): r.tf for r in stored.collect()} == both
    assert sorted(r.doc_id for r in keyword.score_postings(stored, "run", 5, language="en").collect()) == [1]
    assert sorted(r.doc_id for r in keyword.score_postings(stored, "running", 5, language="en").collect()) == [1, 3]
    assert keyword.asked_tokens(spark, "Running ﬁles running", "en") == ["running", "run", "files", "file"]
    plain = {(r.doc_id, r.term): r.weight for r in keyword.sparse_vectors(docs).collect()}
    assert all(abs(r.weight - plain[r.doc_id, r.term]) < 1e-12 for r in stored.collect() if (r.doc_id, r.term) in plain)


def test_bm25_tokenises_once_for_each_branch(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id int, text string")
    plan = keyword.bm25(docs, "a b c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 * 3  # two branches; the plain and the CJK way of each, and the runs of the latter
    assert [(r.doc_id, r.score > 0) for r in keyword.bm25(docs, "a b c").collect()] == [(1, True)]


@pytest.mark.parametrize("dials", [{}, {"eager": 3600, "idle": 7200}])
def test_streamed_debounce_equals_batch(spark, tmp_path, dials):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = spark.sql("SELECT -1L AS event_id, -1L AS user_id, TIMESTAMP '2030-01-01' AS ts").select(*[F.col(c).cast(t) for c, t in rows.dtypes])
    for k, (a, b) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2025-01-01"))):
        rows.where(f"ts >= '{a}' and ts < '{b}'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
    last.coalesce(1).write.parquet(f"{tmp_path}/in/part=3")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    dials = {"quiet": 86_400, "ceiling": 259_200, **dials}
    folds.debounce(stream, **dials).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("user_id >= 0").collect()))
    want = usage.debounce(rows, **dials).select("user_id", F.unix_micros("first"), F.unix_micros("run_at"), "events")
    assert got and got == sorted(map(tuple, want.collect()))


def test_change_topics_replace_a_replayed_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i % 3}") for i in range(30)], "seq int, vault_id string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for cp in ("one", "two"):  # a new checkpoint runs the same batch again
        sinks.change_topics(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/{cp}").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 30 and sorted(r.seq for r in back.where("vault_id = 'v1'").collect()) == list(range(1, 30, 3))
