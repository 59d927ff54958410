"""Queries of the smaller operators: scans, filters, edits, paths, schedules, stored postings, link repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import python_text as P
from folioflow.functions import text as T
from folioflow.operators import dense, feed, keyword, links, usage
from folioflow.plans.notes import MARKDOWN_SQL, NOTES_SQL, markdown, notes
from folioflow.plans.registry import query
from folioflow.plans.search_queries import ASK, _bm25_sql
from folioflow.plans.text_queries import _LINKS, _resolved
from folioflow.sources.tables import table


@query(f"WITH {NOTES_SQL} SELECT note_id, path FROM notes WHERE note_id % 9 <> 0 AND note_id % 4 = 1 AND vault_id = 'src3'")
def tenant_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = notes(spark, folder).withColumn("deleted_at", F.when(F.col("note_id") % 9 == 0, F.lit("2024-01-01").cast("timestamp"))).withColumn("user_id", F.col("note_id") % 4)
    return feed.live(rows, user=1, vault="src3").select("note_id", "path")


@query("""SELECT vec_id FROM embeddings WHERE label IN (1, 2, 3) AND (vec_id % 5 IN (1, 2) OR vec_id % 3 = 1) AND vec_id % 2 = 0
AND vec_id % 7 <> 0 AND TIMESTAMP '2024-01-01' + to_days((vec_id % 30)::INT) BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'""")
def search_filters(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.array(F.expr("concat('t', vec_id % 5)"), F.expr("concat('u', vec_id % 3)"))
    date = F.when(F.col("vec_id") % 7 != 0, F.timestamp_add("DAY", (F.col("vec_id") % 30).cast("int"), F.lit("2024-01-01").cast("timestamp")))
    rows = table(spark, folder, "embeddings", ["vec_id", "label"]).withColumn("tags", tags).withColumn("folder", F.expr("concat('f', vec_id % 2)")).withColumn("fm_timestamp", date)
    return dense.filtered(rows, vaults=[1, 2, 3], vault="label", tags_any=["t1", "t2", "u1"], folder="f0", since="2024-01-03", until="2024-01-25").select("vec_id")


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM b")
def stored_postings_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return keyword.score_postings(keyword.sparse_vectors(docs), ASK, docs.count()).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id AS note_id, sha256({MARKDOWN_SQL.split(chr(124) * 2 + ' chr(10) || chr(10) || ' + chr(39) + 'See')[0]} || chr(10) || 'new tail') AS content_sha256 FROM documents")
def section_replace(spark: SparkSession, folder: str) -> DataFrame:
    return markdown(spark, folder).select("note_id", F.sha2(T.section_replaced(F.col("content"), "## Tail", "new tail"), 256).alias("content_sha256"))


@query("SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::INT AS \"offset\", 0 AS deleted, '!x' AS inserted FROM documents WHERE NOT suffix(text, '!')")
def minimal_edits(spark: SparkSession, folder: str) -> DataFrame:
    return _edits(table(spark, folder, "documents").where(~F.col("text").endswith("!")))


@query("SELECT doc_id, (length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))::INT AS \"offset\", 0 AS deleted, '!x' AS inserted FROM documents")
def minimal_edits_all(spark: SparkSession, folder: str) -> DataFrame:
    """The edits of every document, those that end in ``!`` too: the common beginning is taken first, so there is no tie."""
    return _edits(table(spark, folder, "documents"))


def _edits(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", P.edit(F.col("text"), F.concat("text", F.lit("!x"))).alias("e")).select("doc_id", "e.*")


@query(r"""SELECT doc_id AS note_id, sha256(concat(CASE WHEN regexp_matches(text, '(?m)^#\s+\S') THEN '' ELSE '# Doc ' || doc_id || chr(10) || chr(10) END, CASE WHEN regexp_matches(text, '(?m)^tags:') THEN '' ELSE 'Tags: ' || lang || ', x' || chr(10) || chr(10) END, text)) AS rendered_sha256 FROM documents""")
def note_rendering(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    return rows.select(F.col("doc_id").alias("note_id"), F.sha2(T.rendered(F.col("text"), F.concat(F.lit("Doc "), "doc_id"), F.array("lang", F.lit("x"))), 256).alias("rendered_sha256"))


@query("""SELECT page_id, array_to_string(list_filter(list_transform(string_split(ltrim(regexp_replace(url_decode('/../' || url || '/ ..%2F%2e/x   y:z/.'), '[\\\\:*?<>"|]', '', 'g'), '/'), '/'),
lambda x: regexp_replace(replace(trim(x), '..', ''), ' {2,}', ' ', 'g')), lambda x: x NOT IN ('', '.', '..', '. .')), '/') AS path FROM pages""")
def path_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's url as a path, with segments that have to go around it."""
    dirty = F.concat(F.lit("/../"), F.col("url"), F.lit("/ ..%2F%2e/x   y:z/."))
    return table(spark, folder, "pages").select("page_id", P.clean_path(dirty).alias("path"))


@query("SELECT doc_id, 'fi' || lower(source) || lang AS type FROM documents")
def type_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Types made of each document's source and language, with a ligature, capitals and full-width letters."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    wide = "".join(chr(ord(c) - ord("a") + 0xFF41) for c in letters)
    given = F.concat(F.lit("\ufb01"), F.upper("source"), F.translate(F.col("lang"), letters, wide))
    return table(spark, folder, "documents").select("doc_id", P.type_key(given).alias("type"))


@query("SELECT doc_id, sha256(text || chr(65533) || lang || chr(65533) || chr(65533)) AS text_sha256 FROM documents")
def utf8_scrub(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's bytes with a lead byte and a cut sequence that no character has."""
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")), F.encode("lang", "UTF-8"), F.unhex(F.lit("E280")))
    return table(spark, folder, "documents").select("doc_id", F.sha2(P.scrubbed(raw), 256).alias("text_sha256"))


@query("""SELECT event_id, ts + to_seconds(CASE event_type WHEN 'click' THEN 300 WHEN 'view' THEN 21600 ELSE 1800 END) AS retry_at,
CASE WHEN event_id % 3 = 0 THEN 9 ELSE 0 END AS priority, event_id * 1000 >= 500000 AND event_id * 2 >= 1000 AS compact,
CASE WHEN event_id % 700 >= 300 THEN (300 * least(event_id % 12 + 1, 8))::BIGINT END AS delay FROM events""")
def job_schedule(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "transient").when(F.col("event_type") == "view", "persistent")
    embedded = F.when(e % 3 != 0, "hash")
    return table(spark, folder, "events").select("event_id", usage.retry_after(F.col("ts"), F.coalesce(kind, F.lit("reconcile"))).alias("retry_at"), usage.embed_priority(embedded).alias("priority"), usage.compaction_due(e * 1000, e * 2).alias("compact"), usage.idle_delay(e % 700, e % 12).alias("delay"))


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 OR ts + INTERVAL 3 DAYS > TIMESTAMP '2024-01-15'")
def unexpired_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", ["event_id", "ts"])
    expires = F.when(F.col("event_id") % 4 != 0, F.timestamp_add("DAY", F.lit(3), F.col("ts").cast("timestamp")))
    return usage.unexpired(rows.withColumn("expires_at", expires), F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query(f"WITH {_LINKS} SELECT DISTINCT l.source_note_id FROM links l JOIN documents d ON d.source = l.vault_id AND 'doc-' || d.doc_id = l.target WHERE d.doc_id % 3 = 1")
def affected_sources(spark: SparkSession, folder: str) -> DataFrame:
    return links.affected_sources(_resolved(spark, folder), notes(spark, folder).where("note_id % 3 = 1").select("note_id"))


@query(f"""WITH {_LINKS}, d AS (SELECT DISTINCT l.vault_id, l.target AS basename_key FROM links l LEFT JOIN documents d ON d.source = l.vault_id AND 'doc-' || d.doc_id = l.target WHERE d.doc_id IS NULL)
SELECT * FROM d WHERE (vault_id, basename_key) IN (SELECT source, 'doc-' || ((doc_id + 1) % 50) FROM documents WHERE doc_id % 3 = 0)""")
def link_repairs(spark: SparkSession, folder: str) -> DataFrame:
    renames = notes(spark, folder).where("note_id % 3 = 0").select("vault_id", F.expr("concat('old/Doc-', (note_id + 1) % 50, '.md')").alias("old_path"))
    return links.repairs(_resolved(spark, folder), renames)
