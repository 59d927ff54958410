"""Notes, files and changes derived from the plain tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.tables import table

PATH = "concat(lang, '/p', doc_id % 5, '/Doc-', doc_id, '.md')"
NOTES_SQL = f"""notes AS (
  SELECT doc_id AS note_id, doc_id AS id, source AS vault_id, {PATH} AS path, concat(lang, '/p', doc_id % 5) AS folder,
         CASE WHEN doc_id % 11 = 0 THEN 'folder' ELSE 'note' END AS kind, lang, n_chars AS size_bytes, doc_id AS seq,
         sha256(text) AS content_hash,
         CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN sha256(text) ELSE 'old' END AS embed_hash, text FROM documents)"""

MARKDOWN = "concat('---\\ntitle: Note ', doc_id, '\\ntags: [t', doc_id % 7, ', \"', lang, '\"]\\ncreated: 2024-01-0', doc_id % 9 + 1, '\\n---\\n# ', source, '\\n\\n', text, '\\n\\n## Tail\\n\\nSee [[doc-', doc_id % 50, '|alias]] and #area/x', doc_id % 4, ' `#no`\\n')"
MARKDOWN_SQL = "'---' || chr(10) || 'title: Note ' || doc_id || chr(10) || 'tags: [t' || (doc_id % 7) || ', \"' || lang || '\"]' || chr(10) || 'created: 2024-01-0' || (doc_id % 9 + 1) || chr(10) || '---' || chr(10) || '# ' || source || chr(10) || chr(10) || text || chr(10) || chr(10) || '## Tail' || chr(10) || chr(10) || 'See [[doc-' || (doc_id % 50) || '|alias]] and #area/x' || (doc_id % 4) || ' `#no`' || chr(10)"


def notes(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 11 == 0, "folder").otherwise("note")
    hash_ = F.sha2("text", 256)
    embed = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, hash_).otherwise("old")
    return table(spark, folder, "documents").select(F.col("doc_id").alias("note_id"), F.col("doc_id").alias("id"), F.col("source").alias("vault_id"), F.expr(PATH).alias("path"), F.expr("concat(lang, '/p', doc_id % 5)").alias("folder"), kind.alias("kind"), "lang", F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("seq"), hash_.alias("content_hash"), embed.alias("embed_hash"), "text")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("vault_id"), F.expr(PATH).alias("path"), F.expr(MARKDOWN).alias("content"))
