"""Queries of retrieval: keyword, dense, fusion, re-ranking, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import language_model
from folioflow.operators import dense, inverted, keyword, search
from folioflow.plans.registry import query
from folioflow.scratch import materialise, shared_dir
from folioflow.sources.tables import table

WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+')"
ASK = "the and that whou"
STEM_QUERY = "the houses and that whou"
TERMS = "('the'), ('and'), ('that'), ('whou')"


def _bm25_sql(group: str = "") -> str:
    g, on = (f"{group}, ", f"USING ({group})") if group else ("", "ON true")
    return f"""t AS (SELECT {g}doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT {g}count(*) AS n, avg(len(ws)) AS a FROM t {f"GROUP BY {group}" if group else ""}),
p AS (SELECT {g}doc_id, q, len(ws) AS l, len(list_filter(ws, lambda x: x = q)) AS tf FROM t, (VALUES {TERMS}) v(q)),
d AS (SELECT {g}q, count(*) AS df FROM p WHERE tf > 0 GROUP BY {g}q),
b AS (SELECT {f"p.{group}, " if group else ""}doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score
      FROM p JOIN d {f"ON d.q = p.q AND d.{group} = p.{group}" if group else "USING (q)"} JOIN s {f"ON s.{group} = p.{group}" if group else "ON true"} WHERE tf > 0 GROUP BY ALL)"""


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY score DESC, doc_id LIMIT 10")
def keyword_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = keyword.bm25(table(spark, folder, "documents"), ASK, stored=True)
    return hits.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY score DESC, doc_id LIMIT 10")
def index_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The same ten from an index by term, of which only the blocks whose bound reaches the tenth score are read."""
    docs = table(spark, folder, "documents", ["doc_id", "lang", "text"])
    index = inverted.build(docs, shared_dir(spark, "index"), near=["lang"], block=64)
    return index.top_k(ASK, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql('source')} SELECT source, doc_id, round(score, 6) AS score FROM b")
def keyword_bm25_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return keyword.bm25(table(spark, folder, "documents"), ASK, group=["source"], stored=True).select("source", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH t AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY term ORDER BY n DESC, term LIMIT 50")
def vocabulary_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = keyword.postings(table(spark, folder, "documents"), ["doc_id"])
    return found.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "term").limit(50)


@query(f"SELECT doc_id, len({WORDS})::BIGINT AS length FROM documents")
def token_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return keyword.lengths(table(spark, folder, "documents"), ["doc_id"])


@query(f"SELECT source, round(avg(len({WORDS})), 6) AS average, count(*) AS n FROM documents GROUP BY source")
def average_length_by_source(spark: SparkSession, folder: str) -> DataFrame:
    out = keyword.average_length(keyword.lengths(table(spark, folder, "documents"), ["source", "doc_id"]), ["source"])
    return out.select("source", F.round("average", 6).alias("average"), "n")


@query(f"""WITH t AS (SELECT doc_id, {WORDS} AS ws FROM documents), a AS (SELECT avg(len(ws)) AS a FROM t),
p AS (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM t), f AS (SELECT doc_id, l, term, count(*) AS tf FROM p GROUP BY ALL)
SELECT doc_id, count(*) AS terms, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 4) AS weight FROM f, a GROUP BY doc_id""")
def sparse_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return keyword.sparse_vectors(table(spark, folder, "documents")).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("weight"))


_HAN = "translate(text, 'aeiouAEIOU', '数据库引擎数据库引擎')"


@query(f"""WITH t AS (SELECT doc_id, {WORDS.replace("text", _HAN)} AS ws FROM documents),
r AS (SELECT doc_id, flatten(list_transform(ws, lambda w: flatten(list_transform(regexp_extract_all(w, '[数据库引擎]+|[^数据库引擎]+'),
  lambda r: CASE WHEN len(r) > 1 AND contains('数据库引擎', r[1]) THEN list_transform(range(1, len(r)), lambda i: r[i:i + 1]) ELSE [r] END)))) AS ts FROM t)
SELECT doc_id, len(ts)::BIGINT AS n, sha256(array_to_string(ts, '|')) AS tokens_sha256 FROM r""")
def cjk_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of each document with its vowels written in Han characters."""
    found = table(spark, folder, "documents").select("doc_id", F.explode(F.array(keyword.tokens(F.expr(_HAN)))).alias("t"))
    return found.select("doc_id", F.size("t").cast("bigint").alias("n"), F.sha2(F.array_join("t", "|"), 256).alias("tokens_sha256"))


@query()
def stemmed_terms(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents", ["lang", "text"]).select("lang", F.explode(F.array_distinct(keyword.tokens(F.col("text")))).alias("term"))
    # the stem stands behind a generator: a filter on it would be pushed down and stem all terms twice
    return found.distinct().select("lang", "term", F.explode(F.array_compact(F.array(keyword.stem_column(F.col("term"), F.col("lang"))))).alias("stem"))


@query()
def keyword_bm25_stems(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents by tokens and stems, in the documents' languages."""
    found = keyword.bm25_stems(table(spark, folder, "documents"), STEM_QUERY)
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query()
def language_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's language by trigrams, learnt from a bounded sample of the documents that name theirs."""
    docs = table(spark, folder, "documents", ["doc_id", "lang", "text"])
    guess = language_model.guessed(F.col("text"), language_model.learnt(docs))
    return docs.select("doc_id", "lang", guess.alias("g")).select("doc_id", "lang", "g.language", F.round("g.confidence", 6).alias("confidence"))


def _query_vector(spark: SparkSession, folder: str, id_: int = 0) -> list[float]:
    return table(spark, folder, "embeddings").where(F.col("vec_id") == id_).first()["embedding"]


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[])"


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return dense.top_k(table(spark, folder, "embeddings"), _query_vector(spark, folder), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label IN (1, 2) ORDER BY {_COS} DESC, vec_id LIMIT 10")
def dense_filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    live = dense.filtered(table(spark, folder, "embeddings"), vaults=[1, 2], vault="label")
    return dense.top_k(live, _query_vector(spark, folder), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH q AS {_Q.replace("embedding FROM", "embedding AS q FROM")}, n AS (SELECT vec_id, embedding, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END)) AS d FROM embeddings, q ORDER BY d, vec_id LIMIT 30)
SELECT vec_id, round({_COS}, 6) AS score FROM n ORDER BY {_COS} DESC, vec_id LIMIT 10""")
def dense_quantised_topk(spark: SparkSession, folder: str) -> DataFrame:
    index = materialise(dense.with_signs(table(spark, folder, "embeddings")), "signs")
    return dense.quantised_top_k(index, _query_vector(spark, folder), 10).select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 1)
SELECT query_id, vec_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 12""")
def dense_query_block(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 50 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return dense.query_top_k(vectors, asked, 12).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5""")
def dense_query_block_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every row whose id is divisible by 50 is a query, so queries grow with the table."""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return dense.query_top_k(vectors, asked).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_LEGS = f"""{_bm25_sql()}, k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b ORDER BY score DESC, doc_id LIMIT 40),
v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 40),
h AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM v) GROUP BY doc_id)"""


def _hybrid(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    near = dense.top_k(table(spark, folder, "embeddings"), _query_vector(spark, folder), 40).withColumnRenamed("vec_id", "doc_id")
    return search.rrf([keyword.bm25(table(spark, folder, "documents"), ASK, stored=True), near], 40, limit)


@query(f"WITH {_LEGS} SELECT doc_id, round(score, 9) AS score FROM h ORDER BY round(score, 12) DESC, doc_id LIMIT 10")
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, 10).select("doc_id", F.round("score", 9).alias("score"))


@query(f"""WITH {_LEGS}, pool AS (SELECT doc_id, score FROM h ORDER BY round(score, 12) DESC, doc_id LIMIT 20),
r AS (SELECT p.*, CASE WHEN doc_id % 4 <> 3 THEN (doc_id % 17)::DOUBLE END AS rr FROM pool p),
m AS (SELECT *, 0.4 * score + 0.6 * CASE WHEN min(rr) OVER () IS NULL OR min(rr) OVER () = max(rr) OVER () THEN 0.5 ELSE (coalesce(rr, 0) - min(rr) OVER ()) / (max(rr) OVER () - min(rr) OVER ()) END AS blend FROM r)
SELECT doc_id, round(blend, 9) AS blend FROM m ORDER BY round(blend, 12) DESC, doc_id LIMIT 10""")
def rerank_blend(spark: SparkSession, folder: str) -> DataFrame:
    pool = _hybrid(spark, folder, 20).withColumn("rerank_score", F.when(F.col("doc_id") % 4 != 3, (F.col("doc_id") % 17).cast("double")))
    return search.blended(pool, 10).select("doc_id", F.round("blend", 9).alias("blend"))


_HITS = """hits AS (SELECT vec_id AS chunk_id, label AS vault_id, CASE WHEN vec_id % 13 <> 0 THEN concat('n', vec_id % 40) END AS source_path, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings)"""


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    path = F.when(F.col("vec_id") % 13 != 0, F.concat(F.lit("n"), F.col("vec_id") % 40))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("vault_id"), path.alias("source_path"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"))


@query(f"WITH {_HITS} SELECT vault_id, source_path, arg_max(chunk_id, struct_pack(s := score, c := -chunk_id)) AS chunk_id, max(score) AS score, count(*) AS match_count FROM hits WHERE source_path IS NOT NULL GROUP BY vault_id, source_path")
def collapse_to_notes(spark: SparkSession, folder: str) -> DataFrame:
    return search.collapse(_hits(spark, folder))


@query(f"WITH {_HITS}, t AS (SELECT * FROM hits ORDER BY score DESC, chunk_id LIMIT 10) SELECT vault_id AS folder, count(*) AS hits FROM t GROUP BY folder ORDER BY hits DESC, folder LIMIT 3")
def suggest_folder(spark: SparkSession, folder: str) -> DataFrame:
    return search.suggest_folder(_hits(spark, folder).withColumnRenamed("vault_id", "folder"))


@query(f"WITH {_HITS} SELECT vault_id, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS relevance FROM hits WINDOW w AS (PARTITION BY vault_id)")
def minmax_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return search.minmax(_hits(spark, folder), "score", "relevance", ["vault_id"]).select("vault_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


@query()
def mmr_diverse_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    pool = dense.top_k(vectors, _query_vector(spark, folder), 40, with_vector=True).withColumn("query_id", F.lit(0))
    return search.mmr(pool, 10, 0.5, id_="vec_id").select("query_id", "vec_id", "pick")


@query(f"WITH {_HITS} SELECT h.chunk_id, h.vault_id, coalesce('d' || d.doc_id, h.source_path) AS source_path FROM hits h LEFT JOIN documents d ON d.doc_id = h.chunk_id AND d.doc_id % 2 = 0")
def rehydrated_hits(spark: SparkSession, folder: str) -> DataFrame:
    fresh = table(spark, folder, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("source_path"))
    return search.rehydrate(_hits(spark, folder), fresh, "chunk_id", ["source_path"]).select("chunk_id", "vault_id", "source_path")


@query()
def search_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("vault_id"), F.expr("concat(lang, '/', doc_id % 30)").alias("source_path"))
    profile = search.Profile.resolve({"limit": 8, "diversity": None}, {"diversity": 0.3, "group": True})
    return search.search(docs.join(vectors, "chunk_id"), ASK, _query_vector(spark, folder), profile=profile).select("vault_id", "source_path", "match_count")
