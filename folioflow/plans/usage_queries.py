"""Queries of inventory, usage, limits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import usage
from folioflow.plans.notes import NOTES_SQL, notes
from folioflow.plans.registry import query
from folioflow.sources.tables import table


@query(f"WITH {NOTES_SQL} SELECT vault_id, folder, count(*) FILTER (WHERE kind = 'note') AS notes FROM notes GROUP BY ALL")
def folder_counts(spark: SparkSession, folder: str) -> DataFrame:
    return usage.folder_counts(notes(spark, folder))


@query(f"WITH {NOTES_SQL}, t AS (SELECT note_id, unnest(list_distinct(['t' || (note_id % 7), lang, 't' || (note_id % 3)])) AS tag FROM notes) SELECT tag, count(*) AS notes FROM t GROUP BY tag")
def tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.array(F.expr("concat('t', note_id % 7)"), F.col("lang"), F.expr("concat('t', note_id % 3)"))
    return usage.tag_counts(notes(spark, folder).withColumn("tags", tags))


@query(f"WITH {NOTES_SQL} SELECT DISTINCT folder FROM notes")
def type_list(spark: SparkSession, folder: str) -> DataFrame:
    return usage.distinct_values(notes(spark, folder), "folder")


@query(f"WITH {NOTES_SQL} SELECT vault_id, count(*) AS total, count(*) FILTER (WHERE embed_hash = content_hash) AS indexed, count(*) FILTER (WHERE embed_hash IS NULL OR embed_hash <> content_hash) AS pending FROM notes GROUP BY vault_id")
def embed_status(spark: SparkSession, folder: str) -> DataFrame:
    return usage.embed_status(notes(spark, folder), ["vault_id"])


@query("SELECT source AS vault_id, coalesce(sum(n_chars), 0)::BIGINT AS bytes, count(*) AS files FROM documents GROUP BY source")
def storage_usage(spark: SparkSession, folder: str) -> DataFrame:
    return usage.storage_usage(table(spark, folder, "documents", ["source", "n_chars"]).withColumnRenamed("source", "vault_id"), size="n_chars")


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return usage.latest(table(spark, folder, "events"), ["user_id"], [F.desc("ts"), "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_type, count(DISTINCT user_id) AS users, max(ts) AS last FROM events GROUP BY event_type")
def active_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.max("ts").alias("last"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE ts::DATE IN ('2024-01-05', '2024-01-06') GROUP BY ALL HAVING count(*) > 1)
SELECT user_id FROM d GROUP BY user_id HAVING count(*) = 2""")
def cap_consecutive_days(spark: SparkSession, folder: str) -> DataFrame:
    stats = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), F.lit(1).alias("request_count"))
    return usage.over_cap_every_day(stats, 1, ["2024-01-05", "2024-01-06"])


@query("SELECT user_id, ts::DATE AS day, event_type, count(*) AS request_count FROM events GROUP BY ALL")
def origin_stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("request_count"))


@query("""SELECT n_nationkey AS vault_id, coalesce(c, 0) AS notes, coalesce(s, 0) AS attachments FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY ALL) ON s_nationkey = n_nationkey""")
def vault_content_counts(spark: SparkSession, folder: str) -> DataFrame:
    vaults = table(spark, folder, "nation").select(F.col("n_nationkey").alias("vault_id"))
    return usage.content_counts(vaults, table(spark, folder, "customer").select(F.col("c_nationkey").alias("vault_id")), table(spark, folder, "supplier").select(F.col("s_nationkey").alias("vault_id")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    return usage.orphans(table(spark, folder, "documents", ["doc_id"]), table(spark, folder, "labels", ["doc_id"]), "doc_id")


@query("SELECT provider, (SELECT count(*) FROM events WHERE CASE WHEN event_type IN ('click', 'view', 'none') THEN event_type ELSE 'other' END = provider) AS n FROM (VALUES ('click'), ('view'), ('none'), ('other')) v(provider)")
def provider_counts(spark: SparkSession, folder: str) -> DataFrame:
    return usage.provider_counts(table(spark, folder, "events").select(F.col("event_type").alias("provider")), ["click", "view", "none"])


@query("""WITH u AS (SELECT user_id, max(ts) AS last_active FROM events GROUP BY user_id), i AS (SELECT *, date_diff('day', last_active::DATE, DATE '2024-04-25') AS idle_days FROM u)
SELECT user_id, idle_days::INT AS idle_days, CASE WHEN idle_days >= 120 THEN 'delete' WHEN idle_days >= 90 THEN 'disable' WHEN idle_days >= 80 THEN 'warn_80' WHEN idle_days >= 60 THEN 'warn_60' ELSE 'active' END AS step FROM i""")
def inactivity_ladder(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last_active"))
    return usage.inactivity_ladder(users, "2024-04-25").select("user_id", "idle_days", "step")


@query("SELECT event_id FROM events WHERE ts >= DATE '2024-01-30' - INTERVAL 7 DAYS")
def retention_prune(spark: SparkSession, folder: str) -> DataFrame:
    return usage.kept_by_retention(table(spark, folder, "events", ["event_id", "ts"]), "2024-01-30", 7).select("event_id")


@query("SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 2000000, false) AS hot FROM events")
def hot_cold_pacing(spark: SparkSession, folder: str) -> DataFrame:
    return usage.hot_cold(table(spark, folder, "events"), "user_id").select("event_id", "hot")


@query("SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 20)::INT AS slot FROM events")
def drain_slots(spark: SparkSession, folder: str) -> DataFrame:
    return usage.drain_slots(table(spark, folder, "events"), "event_type").select("event_id", "slot")


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS window_start, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def fixed_window_limit(spark: SparkSession, folder: str) -> DataFrame:
    return usage.fixed_window_limit(table(spark, folder, "events"), 3600, 1).select("event_id", "window_start", "allowed")


@query("SELECT event_type, CASE WHEN value <= 10 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 100 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return usage.histogram(table(spark, folder, "events"), "value", [10, 50, 100], ["event_type"])


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) > 100")
def lru_eviction(spark: SparkSession, folder: str) -> DataFrame:
    return usage.evicted(table(spark, folder, "events"), 100, "event_type", "ts", "event_id").select("event_type", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-03' ORDER BY ts DESC, event_id LIMIT 200")
def log_tail_filtered(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", where=(F.col("event_type") == "click") & (F.col("ts") > F.lit("2024-01-03").cast("timestamp")))
    return rows.orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events UNION SELECT DISTINCT user_id, 'any' FROM events")
def distinct_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return rows.select("user_id", "event_type").union(rows.select("user_id", F.lit("any"))).distinct()


@query("SELECT user_id, count(*) AS tail, max(ts) AS last, greatest(0, 60 - count(*)) AS remaining FROM events GROUP BY user_id")
def tail_watermarks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("tail"), F.max("ts").alias("last"), F.greatest(F.lit(0), 60 - F.count("*")).alias("remaining"))


@query("SELECT event_id, sha256(left(repeat(props, 500), 8000)) AS message_sha256, coalesce(NULLIF(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END, ''), 'info') AS level FROM events")
def log_ingest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", F.col("ts").cast("string").alias("ts"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("level"), F.repeat("props", F.lit(500)).alias("message"), F.lit(None).cast("string").alias("stack"), F.col("event_id").cast("string").alias("category"))
    out = usage.ingested_logs(rows, F.lit("2024-01-01").cast("timestamp"), columns=("category",))
    return out.select(F.col("category").cast("bigint").alias("event_id"), F.sha2("message", 256).alias("message_sha256"), "level")


@query("SELECT c_custkey AS user_id, (c_custkey % 20)::INT AS notes_count, coalesce(n, 0) AS real, greatest(0, c_custkey % 20 - 5)::INT AS lowered FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey WHERE c_custkey % 20 <> coalesce(n, 0)")
def counter_repair(spark: SparkSession, folder: str) -> DataFrame:
    meters = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 20).cast("int").alias("notes_count"))
    owned = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return usage.recounted(meters, owned).withColumn("lowered", usage.decremented(F.col("notes_count"), F.lit(5)))


_ORDERED = "o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (
  SELECT user_id, event_id, r, us AS at, 2.0::DOUBLE AS left_, 2.0::DOUBLE AS tokens, 'allowed' AS decision FROM o WHERE r = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.r, CASE WHEN n >= 1 THEN o.us ELSE f.at END, CASE WHEN n >= 1 THEN n - 1 ELSE f.left_ END, CASE WHEN n >= 1 THEN n - 1 ELSE n END, CASE WHEN n >= 1 THEN 'allowed' ELSE 'denied' END
  FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1, LATERAL (SELECT least(3.0, f.left_ + (o.us - f.at) / 1e6 * 0.000005) AS n) x)
SELECT user_id, event_id, round(tokens, 6) AS tokens, decision FROM f""")
def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    out = usage.token_bucket(table(spark, folder, "events"), capacity=3.0, per_second=0.000005)
    return out.select("user_id", "event_id", F.round("tokens", 6).alias("tokens"), "decision")


@query(f"""WITH RECURSIVE {_ORDERED}, q AS (SELECT *, us // 86400000000 AS day FROM o), f AS (
  SELECT user_id, event_id, r, us AS start, day, 1 AS inside, 1 AS opened, 1 AS asked, 1 AS query_no, 'allowed' AS decision FROM q WHERE r = 1
  UNION ALL
  SELECT q.user_id, q.event_id, q.r, CASE WHEN fresh THEN q.us ELSE f.start END, q.day,
         CASE WHEN ok THEN base + 1 ELSE base END, seen, CASE WHEN ok THEN today + 1 ELSE today END,
         CASE WHEN ok THEN base + 1 WHEN seen > 2 AND fresh THEN 0 ELSE base END,
         CASE WHEN seen > 2 THEN 'conversation_cap' WHEN NOT ok THEN 'query_cap' ELSE 'allowed' END
  FROM f JOIN q ON q.user_id = f.user_id AND q.r = f.r + 1,
  LATERAL (SELECT q.us - f.start > 43200 * 1000000::BIGINT OR f.inside >= 3 AS fresh, CASE WHEN q.day = f.day THEN f.opened ELSE 0 END AS o0, CASE WHEN q.day = f.day THEN f.asked ELSE 0 END AS today) a,
  LATERAL (SELECT o0 + CASE WHEN fresh THEN 1 ELSE 0 END AS seen, CASE WHEN fresh THEN 0 ELSE f.inside END AS base) b,
  LATERAL (SELECT seen <= 2 AND today < 4 AS ok) c)
SELECT user_id, event_id, opened AS conversation_no, query_no, decision FROM f""")
def conversation_meter(spark: SparkSession, folder: str) -> DataFrame:
    return usage.conversation_meter(table(spark, folder, "events"), window=720, per_conversation=3, conversations=2, queries=4)


@query(f"""WITH RECURSIVE {_ORDERED}, f AS (
  SELECT user_id, r, us AS first_us, us + 36000000000 AS due, 1 AS n, us AS last FROM o WHERE r = 1
  UNION ALL
  SELECT o.user_id, o.r, CASE WHEN new_ THEN o.us ELSE first_us END, CASE WHEN new_ THEN o.us + 36000000000 ELSE least(o.us + 36000000000, first_us + 86400000000) END, CASE WHEN new_ THEN 1 ELSE n + 1 END, o.us
  FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1, LATERAL (SELECT o.us > f.due AS new_) x)
SELECT user_id, make_timestamp(first_us) AS first, make_timestamp(max(due)) AS run_at, max(n) AS events FROM f GROUP BY user_id, first_us""")
def debounce_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    return usage.debounce(table(spark, folder, "events"), quiet=36_000, ceiling=86_400)


@query()
def debounce_eager(spark: SparkSession, folder: str) -> DataFrame:
    return usage.debounce(table(spark, folder, "events"), quiet=5, ceiling=60, eager=0.25, idle=5)


@query("""SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"]).groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    orders = table(spark, folder, "orders", ["o_orderkey", "o_custkey"]).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    by_customer = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("amount").alias("amount"))
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = by_customer.join(table(spark, folder, "customer", ["c_custkey", "c_nationkey"]), F.col("c_custkey") == F.col("o_custkey")).join(places, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("orders").alias("orders"), F.round(F.sum("amount"), 2).alias("revenue"))
