"""Queries on single notes: parsing, paths, chunks, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import frontmatter as M
from folioflow.functions import language
from folioflow.functions import python_text as P
from folioflow.functions import text as T
from folioflow.operators import chunking, links
from folioflow.plans.notes import MARKDOWN_SQL, NOTES_SQL, markdown, notes
from folioflow.plans.registry import query
from folioflow.sources.tables import table


@query(f"SELECT doc_id AS note_id, 'Note ' || doc_id AS title, concat(lang, '/p', doc_id % 5) AS folder, 'doc-' || doc_id AS key, 'Doc-' || doc_id AS derived, ['t' || (doc_id % 7), lang, 'area/x' || (doc_id % 4)]::VARCHAR AS tags FROM documents WHERE text NOT LIKE '%#%' AND text NOT LIKE '%`%' AND text NOT LIKE '%~~~%'")
def note_fields(spark: SparkSession, folder: str) -> DataFrame:
    plain = table(spark, folder, "documents").where("text NOT LIKE '%#%' AND text NOT LIKE '%`%' AND text NOT LIKE '%~~~%'")
    return note_fields_all(spark, folder).join(plain.select(F.col("doc_id").alias("note_id")), "note_id", "left_semi")


@query()
def note_fields_all(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of every document; those with tags or code in their own text are beyond the SQL of ``note_fields``."""
    content, path = F.col("content"), F.col("path")
    return markdown(spark, folder).select("note_id", T.title(content, path).alias("title"), T.folder(path).alias("folder"), T.basename_key(path).alias("key"), T.derived_title(path).alias("derived"), F.concat(F.lit("["), F.array_join(T.tags(content), ", "), F.lit("]")).alias("tags"))


@query(f"SELECT doc_id AS note_id, sha256({MARKDOWN_SQL}) AS content_hash, ((octet_length(encode({MARKDOWN_SQL})) + 3) // 4)::BIGINT AS tokens FROM documents")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return markdown(spark, folder).select("note_id", T.content_hash(F.col("content")).alias("content_hash"), T.token_estimate(F.col("content")).alias("tokens"))


@query("SELECT doc_id AS note_id, '2024-01-0' || (doc_id % 9 + 1) AS created FROM documents")
def frontmatter_dates(spark: SparkSession, folder: str) -> DataFrame:
    values = F.str_to_map(T.frontmatter(F.col("content")), F.lit("\n"), F.lit(": "))
    return markdown(spark, folder).select("note_id", F.date_format(T.first_timestamp(values, "created", "date"), "yyyy-MM-dd").alias("created"))


@query("SELECT doc_id AS note_id, 'title' AS first_key, NULL::VARCHAR AS reason, '\"Note ' || doc_id || '\"' AS title FROM documents")
def frontmatter_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = markdown(spark, folder).select("note_id", P.frontmatter_fields("content").alias("f"))
    return rows.select("note_id", F.element_at("f.keys", 1).alias("first_key"), F.col("f.reason").alias("reason"), F.element_at("f.values", "title").alias("title"))


#: Frontmatter with comments, blank lines, quotes, a repeated key, broken YAML and CRLF around each document's text.
_LOSSLESS = "concat('---\\r\\n# ', source, '\\n\\ntitle: \"', doc_id, ': x\" # why\\r\\n\\ntags:\\n-  ', lang, '\\n# between\\ntags: {broken\\n\\'a key\\' : |\\n  text: ', n_chars, '\\n---\\n', text)"
_LOSSLESS_SQL = "'---' || chr(13) || chr(10) || '# ' || source || chr(10) || chr(10) || 'title: \"' || doc_id || ': x\" # why' || chr(13) || chr(10) || chr(10) || 'tags:' || chr(10) || '-  ' || lang || chr(10) || '# between' || chr(10) || 'tags: {broken' || chr(10) || chr(39) || 'a key' || chr(39) || ' : |' || chr(10) || '  text: ' || n_chars || chr(10) || '---' || chr(10) || text"


@query(f"SELECT doc_id AS note_id, 'title|tags|tags|a key' AS keys, sha256({_LOSSLESS_SQL}) AS note_sha256, sha256(text) AS text_sha256 FROM documents")
def frontmatter_lossless(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a note and as it is, tiled and put together again."""
    rows = table(spark, folder, "documents").select("doc_id", "text", F.expr(_LOSSLESS).alias("content"))
    rows = rows.select("doc_id", M.tiled(F.col("content")).alias("n"), M.tiled(F.col("text")).alias("plain"))
    return rows.select(F.col("doc_id").alias("note_id"), F.array_join("n.keys", "|").alias("keys"), F.sha2(M.project(F.col("n")), 256).alias("note_sha256"), F.sha2(M.project(F.col("plain")), 256).alias("text_sha256"))


@query("SELECT page_id, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[1] AS label, list_aggregate(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), 'string_agg', '/') AS path FROM pages")
def url_paths(spark: SparkSession, folder: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return table(spark, folder, "pages").select("page_id", F.element_at(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\."), 1).alias("label"), T.sanitised_path(path).alias("path"))


@query("""WITH p AS (SELECT DISTINCT list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages),
a AS (SELECT unnest(list_transform(range(1, len(s)), lambda i: list_aggregate(s[1:i], 'string_agg', '/'))) AS folder FROM p WHERE len(s) > 1)
SELECT DISTINCT folder, CASE WHEN contains(folder, '/') THEN regexp_replace(folder, '/[^/]*$', '') END AS parent FROM a""")
def ancestor_materialise(spark: SparkSession, folder: str) -> DataFrame:
    from folioflow.operators import feed

    path = T.sanitised_path(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1))
    return feed.implied_folders(table(spark, folder, "pages").select(path.alias("path")), by=())


@query("""SELECT e.event_id, CASE WHEN agent = '' THEN 'unknown' WHEN contains(agent, 'app-mobile') THEN 'mobile' WHEN contains(agent, 'mcp/') THEN 'mcp_other' WHEN contains(agent, 'mozilla') THEN 'browser' ELSE 'unknown' END AS origin
FROM (SELECT event_id, lower(['', 'Mozilla/5.0', 'MCP/1 Mozilla', 'App-Mobile Mozilla', 'x'][(event_id % 5 + 1)::INT]) AS agent FROM events) e""")
def origin_classes(spark: SparkSession, folder: str) -> DataFrame:
    agent = F.element_at(F.array(*map(F.lit, ["", "Mozilla/5.0", "MCP/1 Mozilla", "App-Mobile Mozilla", "x"])), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", T.classified_origin(agent, T.origin_rules("app"), "unknown").alias("origin"))


def _language_sql() -> str:
    count = {k: f"len(list_filter(ws, lambda w: list_contains({v}, w)))" for k, v in sorted(language.FUNCTION_WORDS.items())}
    best = f"greatest({', '.join(count.values())})"
    cases = " ".join(f"WHEN {c} = {best} THEN '{k}'" for k, c in count.items())
    return f"""WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(left(text, 2000)), '\\p{{L}}+') AS ws FROM documents)
SELECT lang, CASE WHEN {best} >= 2 AND {best} >= 0.4 * ({" + ".join(count.values())}) THEN CASE {cases} END END AS guess, count(*) AS n FROM t GROUP BY ALL"""


@query(_language_sql())
def language_detect(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", ["lang", "text"]).groupBy("lang", language.detect(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id AS note_id, replace(text, 'the', 'THE') AS all_replaced, CASE WHEN contains(text, 'and') THEN regexp_replace(text, 'and', 'AND') ELSE text END AS first_replaced, rtrim(text, chr(10)) || chr(10) || 'end' AS appended FROM documents")
def text_edits(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select(F.col("doc_id").alias("note_id"), T.replaced_occurrence(t, "the", "THE", -1).alias("all_replaced"), T.replaced_occurrence(t, "and", "AND", 0).alias("first_replaced"), T.appended(t, F.lit("end")).alias("appended"))


@query()
def chunk_markdown(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunking.chunk_notes(markdown(spark, folder))
    return chunks.select("note_id", "position", "heading_path", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id AS note_id, 1 AS frontmatter, 1 AS tail FROM documents")
def chunk_kinds(spark: SparkSession, folder: str) -> DataFrame:
    chunks = chunking.chunk_notes(markdown(spark, folder))
    return chunks.groupBy("note_id").agg(F.count_if(F.col("heading_path") == "frontmatter").cast("int").alias("frontmatter"), F.count_if(F.col("heading_path").endswith(" > Tail")).cast("int").alias("tail"))


_LINKS = """links AS (SELECT doc_id AS source_note_id, source AS vault_id, 'doc-' || (doc_id % 50) AS target, 'alias' AS alias FROM documents)"""


@query(f"WITH {_LINKS} SELECT source_note_id, target, alias, 'wikilink' AS link_type, 'wiki' AS form FROM links")
def link_extract(spark: SparkSession, folder: str) -> DataFrame:
    return links.extract_links(markdown(spark, folder)).select("source_note_id", "target", "alias", "link_type", "form")


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    edges = links.extract_links(markdown(spark, folder))
    files = notes(spark, folder).select("vault_id", "id", "path", F.lit("note").alias("kind"))
    return links.resolve(edges, files)


@query(f"WITH {_LINKS} SELECT l.source_note_id, d.doc_id AS target_note_id, CASE WHEN d.doc_id IS NOT NULL THEN concat(d.lang, '/p', d.doc_id % 5, '/Doc-', d.doc_id, '.md') END AS target_path, d.doc_id IS NULL AS dangling FROM links l LEFT JOIN documents d ON d.source = l.vault_id AND 'doc-' || d.doc_id = l.target")
def link_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder).select("source_note_id", "target_note_id", "target_path", "dangling")


@query(f"WITH {_LINKS} SELECT d.doc_id AS target_note_id, l.source_note_id, s.lang || '/p' || (s.doc_id % 5) || '/Doc-' || s.doc_id || '.md' AS source_path FROM links l JOIN documents d ON d.source = l.vault_id AND 'doc-' || d.doc_id = l.target JOIN documents s ON s.doc_id = l.source_note_id")
def backlinks(spark: SparkSession, folder: str) -> DataFrame:
    titled = notes(spark, folder).withColumn("title", T.derived_title(F.col("path")))
    return links.backlinks(_resolved(spark, folder), titled, 100_000).select("target_note_id", "source_note_id", "source_path")


@query(f"WITH {_LINKS} SELECT l.vault_id, l.target AS basename_key, count(*) AS edges, count(DISTINCT source_note_id) AS sources FROM links l LEFT JOIN documents d ON d.source = l.vault_id AND 'doc-' || d.doc_id = l.target WHERE d.doc_id IS NULL GROUP BY ALL")
def danglers(spark: SparkSession, folder: str) -> DataFrame:
    return links.danglers(_resolved(spark, folder))


@query(f"WITH {NOTES_SQL} SELECT vault_id, lang AS basename_key, count(*) AS files FROM notes GROUP BY ALL")
def basename_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return links.basename_collisions(notes(spark, folder).select("vault_id", F.concat(F.lit("x/"), F.upper("lang"), F.lit(".md")).alias("path")))


@query(f"WITH {_LINKS} SELECT l.source_note_id, d.doc_id AS target_note_id FROM links l JOIN documents d ON d.source = l.vault_id AND 'doc-' || d.doc_id = l.target WHERE d.doc_id % 7 = 0")
def pre_rename_winners(spark: SparkSession, folder: str) -> DataFrame:
    edges = links.extract_links(markdown(spark, folder))
    all_ = notes(spark, folder)
    files = all_.select("vault_id", "id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("new/x"), "id", F.lit(".md"))).otherwise(F.col("path")).alias("path"), F.lit("note").alias("kind"))
    return links.pre_rename_winners(edges, files, all_.where("id % 7 = 0").select("note_id", F.col("path").alias("old_path"))).select("source_note_id", "target_note_id")


@query(f"WITH {_LINKS} SELECT l.source_note_id, CASE WHEN d.doc_id % 2 = 1 THEN d.doc_id END AS target_note_id, coalesce(d.doc_id % 2 = 0, true) AS dangling FROM links l LEFT JOIN documents d ON d.source = l.vault_id AND 'doc-' || d.doc_id = l.target WHERE l.source_note_id % 2 = 1")
def soft_delete_links(spark: SparkSession, folder: str) -> DataFrame:
    out = links.without_deleted(_resolved(spark, folder), notes(spark, folder).where("note_id % 2 = 0"))
    return out.select("source_note_id", "target_note_id", "dangling")


@query("""WITH m(old, new) AS (VALUES ('en', 'english'), ('fr', 'f'), ('en/1', 'one'))
SELECT page_id, path, (SELECT new || substr(path, length(old) + 1) FROM m WHERE path = old OR starts_with(path, old || '/') ORDER BY length(old) DESC LIMIT 1) AS new_path
FROM (SELECT page_id, list_aggregate(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), 'string_agg', '/') AS path FROM pages)""")
def folder_prefix_retarget(spark: SparkSession, folder: str) -> DataFrame:
    from folioflow.operators import feed

    rows = table(spark, folder, "pages").select("page_id", T.sanitised_path(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)).alias("path"))
    moves = spark.createDataFrame([("en", "english"), ("fr", "f"), ("en/1", "one")], "old string, new string")
    return feed.retargeted(rows, moves)


