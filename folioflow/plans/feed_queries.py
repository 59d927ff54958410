"""Queries of change feeds, manifests and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioflow.operators import feed
from folioflow.plans.notes import NOTES_SQL, notes
from folioflow.plans.registry import query
from folioflow.scratch import remove_dir, shared_dir
from folioflow.sources.change_log import ChangeLog
from folioflow.sources.tables import table

_EVENTS = "e AS (SELECT event_id // 3 AS seq, event_id AS id, length(props) * 100 AS content_bytes FROM events)"
_CONVERSATIONS = "c AS (SELECT conv_id * 7 AS seq, min(turn) + conv_id * 100 AS id, count(*) AS content_bytes FROM conversations GROUP BY conv_id)"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.expr("event_id div 3").alias("seq"), F.col("event_id").alias("id"), (F.length("props") * 100).cast("bigint").alias("content_bytes"))


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").groupBy("conv_id").agg(F.min("turn").alias("t"), F.count("*").alias("content_bytes"))
    return rows.select((F.col("conv_id") * 7).alias("seq"), (F.col("t") + F.col("conv_id") * 100).alias("id"), "content_bytes")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def assigned_seq(spark: SparkSession, folder: str) -> DataFrame:
    return feed.with_seq(table(spark, folder, "events"), ["ts", "event_id"], "user_id").select("user_id", "event_id", "seq")


@query(f"WITH {_EVENTS} SELECT seq, id, content_bytes, true AS has_more FROM e WHERE (seq, id) > (40, 121) ORDER BY seq, id LIMIT 100")
def change_feed_page(spark: SparkSession, folder: str) -> DataFrame:
    return feed.page(_events(spark, folder), 40, 121, 100)


@query(f"""WITH {_EVENTS}, p AS (SELECT *, sum(content_bytes) OVER w AS spent, row_number() OVER w AS r FROM e WHERE (seq, id) > (40, 121) WINDOW w AS (ORDER BY seq, id ROWS UNBOUNDED PRECEDING))
SELECT seq, id, content_bytes::BIGINT AS content_bytes, true AS has_more FROM p WHERE r <= 100 AND (spent <= 20000 OR r = 1)""")
def byte_budget_page(spark: SparkSession, folder: str) -> DataFrame:
    return feed.page(_events(spark, folder), 40, 121, 100, budget=20_000)


@query(f"""WITH {_EVENTS}, {_CONVERSATIONS},
a AS (SELECT 0 AS f, * FROM e WHERE (seq, id) > (10, 0) ORDER BY seq, id LIMIT 51), b AS (SELECT 1 AS f, * FROM c WHERE (seq, id) > (10, 0) ORDER BY seq, id LIMIT 51),
n AS (SELECT (SELECT count(*) FROM e WHERE (seq, id) > (10, 0)) > 51 AS ma, (SELECT count(*) FROM c WHERE (seq, id) > (10, 0)) > 51 AS mb),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
m AS (SELECT min(l) AS mark FROM (SELECT f, max(row(seq, id)) AS l FROM u, n WHERE (f = 0 AND ma) OR (f = 1 AND mb) GROUP BY f)),
h AS (SELECT u.*, mark FROM u, m WHERE mark IS NULL OR row(seq, id) <= mark)
SELECT seq, id, content_bytes::BIGINT AS content_bytes, (count(*) OVER () > 50) OR mark IS NOT NULL AS has_more FROM h QUALIFY row_number() OVER (ORDER BY seq, id) <= 50""")
def merged_feed_page(spark: SparkSession, folder: str) -> DataFrame:
    return feed.merged_page([_events(spark, folder), _conversations(spark, folder)], 10, 0, 50)


@query(f"WITH {_EVENTS} SELECT seq, id, content_bytes::BIGINT AS content_bytes, true AS has_more FROM e WHERE seq > 40 ORDER BY seq, id LIMIT 20")
def feed_catch_up(spark: SparkSession, folder: str) -> DataFrame:
    return feed.catch_up([_events(spark, folder)], "40:not-a-number", 20)


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def delete_by_vault(spark: SparkSession, folder: str) -> DataFrame:
    gone = spark.createDataFrame([("src1",), ("src2",), ("src2",)], "source string")
    return feed.without(table(spark, folder, "documents", ["doc_id", "source"]), gone, ["source"])


@query(f"WITH {NOTES_SQL} SELECT 'note' AS kind, id, path, content_hash, seq FROM notes")
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return feed.manifest(notes(spark, folder))


@query(f"""WITH {NOTES_SQL}, a AS (SELECT path, content_hash FROM notes WHERE note_id % 10 <> 1), b AS (SELECT path, CASE WHEN note_id % 10 = 2 THEN 'new' ELSE content_hash END AS content_hash FROM notes WHERE note_id % 10 <> 3)
SELECT path, CASE WHEN a.content_hash IS NULL THEN 'added' WHEN b.content_hash IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path) WHERE a.content_hash IS DISTINCT FROM b.content_hash""")
def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    all_ = notes(spark, folder)
    old = all_.where("note_id % 10 <> 1").select("path", "content_hash")
    new = all_.where("note_id % 10 <> 3").select("path", F.when(F.col("note_id") % 10 == 2, "new").otherwise(F.col("content_hash")).alias("content_hash"))
    return feed.manifest_diff(old, new)


@query(f"""WITH {NOTES_SQL}, d AS (SELECT vault_id, folder, count(*) AS notes FROM notes GROUP BY ALL), i AS (SELECT DISTINCT vault_id, lang AS folder, 0 AS notes FROM notes)
SELECT vault_id, folder, max(notes)::BIGINT AS notes, CASE WHEN contains(folder, '/') THEN split_part(folder, '/', 1) END AS parent FROM (SELECT * FROM d UNION ALL SELECT * FROM i) GROUP BY vault_id, folder""")
def vault_tree(spark: SparkSession, folder: str) -> DataFrame:
    return feed.tree(notes(spark, folder))


@query(f"WITH {NOTES_SQL} SELECT note_id, path, 'moved' || substr(path, 6) AS new_path, false AS conflict FROM notes WHERE starts_with(path, 'en/p2/')")
def subtree_rename(spark: SparkSession, folder: str) -> DataFrame:
    return feed.renamed_subtree(notes(spark, folder), "en/p2", "moved").select("note_id", "path", "new_path", "conflict")


@query(f"WITH {NOTES_SQL} SELECT count(*) AS notes, count(DISTINCT folder) AS folders, count(*) = 0 AS allowed FROM notes WHERE folder = 'en' OR starts_with(folder, 'en/')")
def subtree_delete(spark: SparkSession, folder: str) -> DataFrame:
    return feed.subtree_deletion(notes(spark, folder), "en", recursive=False)


@query(f"WITH {NOTES_SQL} SELECT id, 9999::BIGINT AS seq, true AS deleted FROM notes WHERE id IN (SELECT doc_id FROM labels)")
def batch_delete(spark: SparkSession, folder: str) -> DataFrame:
    return feed.batch_change(notes(spark, folder), table(spark, folder, "labels").select(F.col("doc_id").alias("id")), 9999).select("id", "seq", "deleted")


@query(f"""WITH {NOTES_SQL}, c AS (SELECT CASE WHEN note_id % 5 = 0 THEN path || 'x' ELSE path END AS path, CASE note_id % 3 WHEN 0 THEN content_hash WHEN 1 THEN 'stale' END AS base_hash, CASE WHEN note_id % 4 = 0 THEN content_hash ELSE 'h' END AS content_hash FROM notes)
SELECT c.path, CASE WHEN n.path IS NULL THEN 'created' WHEN n.content_hash = c.content_hash THEN 'unchanged' WHEN c.base_hash IS NOT NULL AND c.base_hash <> n.content_hash THEN 'conflict' ELSE 'updated' END AS status FROM c LEFT JOIN notes n ON n.path = c.path""")
def optimistic_upsert(spark: SparkSession, folder: str) -> DataFrame:
    all_ = notes(spark, folder)
    changes = all_.select(F.when(F.col("note_id") % 5 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.when(F.col("note_id") % 3 == 0, F.col("content_hash")).when(F.col("note_id") % 3 == 1, "stale").alias("base_hash"), F.when(F.col("note_id") % 4 == 0, F.col("content_hash")).otherwise("h").alias("content_hash"))
    return feed.upsert(all_, changes).select("path", "status")


@query("SELECT user_id, event_type, arg_min(event_id, ts) AS event_id FROM events GROUP BY ALL")
def idempotent_replay(spark: SparkSession, folder: str) -> DataFrame:
    return feed.first_responses(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS n_chars FROM documents")
def replace_by_note(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "documents", ["doc_id", "n_chars"])
    return feed.replaced_rows(stored, stored.where("doc_id % 4 = 0").withColumn("n_chars", F.lit(0).cast("bigint")), "doc_id")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 6 = 0 THEN 'patched' ELSE source END AS source FROM documents")
def payload_patch(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "documents", ["doc_id", "lang", "source"])
    return feed.patched(stored, stored.where("doc_id % 6 = 0").select("doc_id", F.lit("patched").alias("source")), "doc_id", ["source"])


@query("SELECT user_id, event_type, arg_max(value, struct_pack(t := ts, v := value)) AS value FROM events GROUP BY ALL")
def log_replay(spark: SparkSession, folder: str) -> DataFrame:
    from folioflow.operators import usage

    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "value")
    return usage.replayed(rows.where("ts < '2024-01-10'"), rows, ["user_id", "event_type"], "value", ["ts"])


@query(f"WITH {_EVENTS} SELECT seq, id, content_bytes::BIGINT AS content_bytes, least(seq * 3 // ((SELECT max(seq) FROM e) + 1), 2)::INTEGER AS run FROM e")
def change_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Changes appended in three parts, and after each a run of one stream that goes on from its checkpoint."""
    rows = _events(spark, folder)
    top = rows.agg(F.max("seq")).first()[0] or 0
    rows = rows.withColumn("_run", F.least(F.expr(f"(seq * 3) div {top + 1}"), F.lit(2)).cast("int"))
    root = shared_dir(spark, "change-log")
    log = ChangeLog(spark, f"{root}/log", rows.drop("_run").schema)
    rows.where("false").withColumnRenamed("_run", "run").write.parquet(f"{root}/read/none")  # no changes are no batches
    for run in range(3):
        log.append(rows.where(F.col("_run") == run), run)
        write = lambda batch, number, run=run: batch.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{root}/read/{number}")
        log.stream().writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    remove_dir(spark, f"{root}/log")
    return spark.read.schema(StructType([*log.schema.fields, StructField("run", IntegerType())])).parquet(f"{root}/read/*")
