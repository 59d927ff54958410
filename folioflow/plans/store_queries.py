"""Queries of stored payloads, batches, heads and links as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import python_text as P
from folioflow.functions import text as T
from folioflow.operators import feed, links, search
from folioflow.operators.link_graph import LinkGraph
from folioflow.plans.notes import NOTES_SQL, PATH, notes
from folioflow.plans.registry import query
from folioflow.scratch import shared_dir
from folioflow.sources.tables import table
from folioflow.sources.upsert import UpsertTable


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 3) AND vec_id > 100 ORDER BY vec_id LIMIT 256")
def vector_scroll(spark: SparkSession, folder: str) -> DataFrame:
    return feed.scroll(table(spark, folder, "embeddings"), F.col("label").isin(1, 3), ["label"], "vec_id", after=100)


@query("SELECT doc_id, lang, CASE WHEN lang = 'en' AND n_chars > 1000 THEN 'patched' ELSE source END AS source, CASE WHEN lang = 'en' AND n_chars > 1000 THEN 'filter' END AS origin FROM documents")
def payload_patch_by_filter(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "documents", ["doc_id", "lang", "source", "n_chars"])
    patched = feed.patched_where(stored, (F.col("lang") == "en") & (F.col("n_chars") > 1000), {"source": F.lit("patched"), "origin": F.lit("filter")})
    return patched.select("doc_id", "lang", "source", "origin")


@query("SELECT doc_id, source FROM documents")
def payload_key_delete(spark: SparkSession, folder: str) -> DataFrame:
    return feed.without_keys(table(spark, folder, "documents"), ["lang", "n_chars", "text", "unknown"])


@query("SELECT source, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars >= 500 GROUP BY source")
def filtered_counts(spark: SparkSession, folder: str) -> DataFrame:
    return feed.filtered_count(table(spark, folder, "documents"), (F.col("lang") == "en") & (F.col("n_chars") >= 500), ["source"])


@query(f"WITH {NOTES_SQL} SELECT vault_id, lang, count(*) AS n FROM notes WHERE embed_hash IS NULL GROUP BY ALL")
def missing_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that still need warming up: those with a row without a head."""
    return feed.filtered_count(notes(spark, folder), F.col("embed_hash").isNull(), ["vault_id", "lang"])


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0")
def active_admins(spark: SparkSession, folder: str) -> DataFrame:
    return feed.filtered_count(table(spark, folder, "customer"), (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 0))


@query(f"WITH {NOTES_SQL} SELECT note_id, size_bytes FROM notes WHERE embed_hash IS DISTINCT FROM content_hash ORDER BY size_bytes, note_id LIMIT 500")
def oldest_stale_batch(spark: SparkSession, folder: str) -> DataFrame:
    return feed.oldest_first(notes(spark, folder), ~F.col("embed_hash").eqNullSafe(F.col("content_hash")), "size_bytes", "note_id").select("note_id", "size_bytes")


@query(f"WITH {NOTES_SQL} SELECT note_id, 'moved/' || vault_id AS folder, 'moved/' || vault_id || '/Doc-' || note_id || '.md' AS path, 77::BIGINT AS seq FROM notes WHERE note_id IN (SELECT doc_id FROM labels)")
def batch_move(spark: SparkSession, folder: str) -> DataFrame:
    all_ = notes(spark, folder)
    to = all_.join(table(spark, folder, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", F.concat(F.lit("moved/"), "vault_id").alias("folder"))
    return feed.batch_move(all_, to, 77).select("note_id", "folder", "path", "seq")


#: Three links behind each whole text: by name, by path in markdown form, and one in code, which is none.
_TAIL = "concat('\\n\\nA [[doc-', doc_id % 50, '|one]], B [two](<', replace(lang, ' ', ''), '/p', doc_id % 5, '/Doc-', doc_id, '.md>), `[[doc-1|code]]`\\n')"


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("vault_id"), F.concat("text", F.expr(_TAIL)).alias("content"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return notes(spark, folder).select("vault_id", "id", "path", F.lit("note").alias("kind"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """All links of the whole texts and of what stands behind them, resolved."""
    return links.resolve(links.extract_links(_linked(spark, folder)), _files(spark, folder))


_EDGES = f"""e AS (SELECT doc_id AS source_note_id, source AS vault_id, 'one' AS alias, 'doc-' || (doc_id % 50) AS goal, NULL AS whole FROM documents
UNION ALL SELECT doc_id, source, 'two', 'doc-' || doc_id, {PATH} FROM documents),
r AS (SELECT e.*, d.doc_id AS target_note_id, concat(d.lang, '/p', d.doc_id % 5, '/Doc-', d.doc_id, '.md') AS found, row_number() OVER (PARTITION BY source_note_id ORDER BY e.alias) AS n
      FROM e LEFT JOIN documents d ON d.source = e.vault_id AND 'doc-' || d.doc_id = e.goal)"""


@query(f"WITH {_EDGES} SELECT source_note_id, n::INT AS place, alias, target_note_id, CASE WHEN target_note_id IS NOT NULL THEN found END AS target_path, target_note_id IS NULL AS dangling FROM r")
def outgoing_links(spark: SparkSession, folder: str) -> DataFrame:
    found = links.outgoing(_edges(spark, folder))
    place = F.row_number().over(Window.partitionBy("source_note_id").orderBy("position"))
    return found.withColumn("place", place.cast("int")).select("source_note_id", "place", "alias", "target_note_id", "target_path", "dangling")


@query(f"WITH {_EDGES}, b AS (SELECT *, row_number() OVER (PARTITION BY target_note_id ORDER BY n, source_note_id) AS k FROM r WHERE target_note_id IS NOT NULL) SELECT target_note_id, source_note_id, n::INT AS place FROM b WHERE k <= 200")
def backlinks_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The feature's own cap: the first 200 edges of each target by place in the note and source."""
    edges = _edges(spark, folder)
    place = F.row_number().over(Window.partitionBy("source_note_id").orderBy("position"))
    titled = notes(spark, folder).withColumn("title", T.derived_title(F.col("path")))
    found = links.backlinks(edges.withColumn("position", place.cast("int")), titled)
    return found.select("target_note_id", "source_note_id", F.col("position").alias("place"))


_CHANGED = "SELECT source AS vault_id, 'doc-' || doc_id AS key FROM documents WHERE doc_id % 3 = 0"


@query(f"WITH {_EDGES}, k AS ({_CHANGED}) SELECT source_note_id, n::INT AS place, target_note_id, target_note_id IS NULL AS dangling FROM r JOIN k ON k.vault_id = r.vault_id AND k.key = r.goal")
def rebound_links(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of every third note's basename, resolved anew."""
    edges = _edges(spark, folder)
    place = F.row_number().over(Window.partitionBy("source_note_id").orderBy("position"))
    edges = edges.withColumn("place", place.cast("int")).drop("target_note_id", "target_attachment_id", "target_path", "dangling")
    keys = notes(spark, folder).where("note_id % 3 = 0").select("vault_id", T.basename_key(F.col("path")).alias("basename_key"))
    files = notes(spark, folder).select("vault_id", "id", "path", F.lit("note").alias("kind"))
    return links.rebound(edges, files, keys).select("source_note_id", "place", "target_note_id", "dangling")


@query(f"WITH {NOTES_SQL}, h AS (SELECT vec_id AS chunk_id, d.source AS vault_id, concat(d.lang, '/p', d.doc_id % 5, '/Doc-', d.doc_id + vec_id % 2, '.md') AS source_path FROM embeddings JOIN documents d ON d.doc_id = vec_id) SELECT chunk_id, h.source_path, note_id FROM h LEFT JOIN notes n ON n.vault_id = h.vault_id AND n.path = h.source_path")
def attached_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = F.expr("concat(lang, '/p', doc_id % 5, '/Doc-', doc_id + vec_id % 2, '.md')")
    met = table(spark, folder, "embeddings").join(table(spark, folder, "documents"), F.col("doc_id") == F.col("vec_id"))
    hits = met.select(F.col("vec_id").alias("chunk_id"), F.col("source").alias("vault_id"), path.alias("source_path"))
    return search.attach_ids(hits, notes(spark, folder)).select("chunk_id", "source_path", "note_id")


_OKF = "concat('---\ntype: ', source, '\ndescription: \"', lang, ' text\"\nresource: ', n_chars, '\nmodified: 2024-02-0', doc_id % 9 + 1, '\ntimestamp: soon\ndate: 2024-03-0', doc_id % 9 + 1, 'T10:00:00.5Z\n---\n', text)"


@query("SELECT doc_id AS note_id, source AS type, lang || ' text' AS description, NULL::VARCHAR AS resource, '2024-02-0' || (doc_id % 9 + 1) || ' 00:00:00' AS fm_timestamp, '2024-03-0' || (doc_id % 9 + 1) || ' 10:00:00' AS fm_created FROM documents")
def okf_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("note_id"), P.frontmatter_fields(F.expr(_OKF)).alias("f"))
    found = rows.select("note_id", *T.okf_fields(F.col("f.values")))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("note_id", "type", "description", "resource", show("fm_timestamp"), show("fm_created"))


@query("""SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END AS first FROM embeddings WHERE vec_id % 7 <> 0
UNION ALL SELECT vec_id + 1000000000, label, embedding[1]::DOUBLE FROM embeddings WHERE vec_id % 5 = 0""")
def vector_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors in one batch, new values for a third and new rows in a second, which comes twice, deletions in a third."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("vault_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    store = UpsertTable(spark, shared_dir(spark, "upserts"), rows.schema, bucket_on="vec_id", buckets=8)
    store.upsert(rows, 1)
    changed = rows.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    changed = changed.unionByName(rows.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000))
    for _ in range(2):
        store.upsert(changed, 2)
    store.delete(rows.where("vec_id % 7 = 0").select("vault_id", "vec_id"), 3)
    return store.read().select("vec_id", F.col("vault_id").alias("label"), F.col("embedding")[0].alias("first"))


@query(f"""WITH {_EDGES}, w AS (SELECT source_note_id, bool_or(alias = 'one') AS one, bool_or(alias = 'two') AS two FROM r WHERE target_note_id % 7 = 0 GROUP BY ALL)
SELECT doc_id AS note_id, sha256(text || chr(10) || chr(10) || 'A [[' || CASE WHEN one THEN 'Renamed ' ELSE 'doc-' END || (doc_id % 50) || '|one]], B [two](<'
|| CASE WHEN two THEN 'moved/Renamed%20' || doc_id || '.md' ELSE {PATH} END || '>), `[[doc-1|code]]`' || chr(10)) AS content_sha256
FROM w JOIN documents ON doc_id = source_note_id""")
def link_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh note is renamed; all notes with links to those are written anew."""
    stays = F.col("id") % 7 != 0
    renames = _files(spark, folder).where(~stays).select(F.col("id").alias("note_id"), F.concat(F.lit("moved/Renamed "), "id", F.lit(".md")).alias("new_path"))
    after = _files(spark, folder).withColumn("path", F.when(stays, F.col("path")).otherwise(F.concat(F.lit("moved/Renamed "), "id", F.lit(".md"))))
    out = links.rewrite_notes(_linked(spark, folder), _edges(spark, folder), renames, after)
    return out.select("note_id", F.sha2("content", 256).alias("content_sha256"))


@query("""WITH e AS (SELECT doc_id AS source_note_id, source, 1 AS place, doc_id % 50 AS goal FROM documents UNION ALL SELECT doc_id, source, 2, doc_id FROM documents)
SELECT source_note_id, place, d.doc_id AS target_note_id, d.doc_id IS NULL AS dangling FROM e
LEFT JOIN documents d ON d.source = e.source AND d.doc_id = e.goal AND d.doc_id % 7 <> 0 AND d.doc_id % 11 <> 3 WHERE source_note_id % 11 <> 3 OR source_note_id % 7 = 0""")
def link_graph(spark: SparkSession, folder: str) -> DataFrame:
    """All files in one batch; then every seventh moves and every eleventh of the others goes, in a batch that comes twice."""
    graph = LinkGraph(spark, shared_dir(spark, "links"), buckets=8)
    all_ = _files(spark, folder).withColumnRenamed("path", "at")
    first = all_.select("vault_id", "id", "kind", F.lit(None).cast("string").alias("old_path"), F.col("at").alias("path"))
    graph.apply(first, _linked(spark, folder), 1)
    path = F.when(F.col("id") % 7 == 0, F.concat(F.lit("moved/Renamed "), "id", F.lit(".md")))
    second = all_.where("id % 7 = 0 OR id % 11 = 3").select("vault_id", "id", "kind", F.col("at").alias("old_path"), path.alias("path"))
    for _ in range(2):
        graph.apply(second, _linked(spark, folder).limit(0), 2)
    place = F.row_number().over(Window.partitionBy("source_note_id").orderBy("position"))
    return graph.edges.read().select("source_note_id", place.cast("int").alias("place"), "target_note_id", "dangling")
