"""An inverted index by term, with upper bounds that let an exact top k leave most of it unread.

Two tables.  ``postings`` has a row for each term of each document, in folders by a hash of the term and in the order of
term and block, so that a query's terms are a few folders and, in their files, a few row groups.  ``heads`` has a row for
each term and block: how many documents of the block have the term, and the largest of their weights.  A block holds
about ``block`` documents that are next to each other in the order given, so that like ones meet and bounds are close.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import keyword
from folioflow.operators.numbering import numbered
from folioflow.scratch import Scratch, free_name, remove_dir

BUCKETS = 64
BLOCK = 4096  #: documents of a block
FIRST = 8  #: documents of the first blocks that are looked at, as a multiple of k
LITERALS = 512  #: blocks that are named in the scan's filter; more are joined
SLACK = 1e-9  #: relative, more than the rounding of a sum of weights


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", near: Sequence[str] = (), language: str | None = None, buckets: int = BUCKETS, block: int = BLOCK) -> "Index":
    """Writes the index of ``docs`` under ``path``, a new folder.

    ``near`` names columns whose equal values put documents next to each other; within those the order is that of the
    text's length, which sets the weights.  The order's numbers come from prefix sums (``numbered``); rows that are equal in
    all are told apart by their place, so ``docs`` has to be a stored table.  Each text is tokenised once; its counted terms
    are stored meanwhile, and the average and the ranges of the order are taken from them.  A row is a document: rows that share a value of ``doc`` are scored each for itself.  Null and empty texts count in the number of documents
    as in ``keyword.bm25`` but have no postings.  With ``language`` stems are stored beside the tokens.
    """
    spark = docs.sparkSession
    kept = [*dict.fromkeys([doc, *([language] if language else [])])]
    at = free_name([*docs.columns], "_at")
    lined = numbered(docs.select(*dict.fromkeys([*kept, text, *near])), [*(F.col(c) for c in near), F.length(text), F.xxhash64(doc)], at, spread=True)
    lined = lined.select(*kept, F.col(text).alias("_text"), F.col(at).alias("row"))
    lined.select(doc, "row").write.parquet(f"{path}/documents")
    rows = lined.drop(doc) if doc != language else lined
    run = Scratch(spark, "index-terms")
    cut = run.write(keyword.term_counts(rows, ["row", *([language] if language else [])], "_text"), "counts")
    weights = keyword.weights(cut, cut.select("length"), "row", language=language, distinct=True)
    placed = weights.select(_bucket(F.col("term"), buckets).alias("bucket"), "term", F.floor((F.col("row") - 1) / block).alias("block"), "row", "tf", "weight")
    # ranges of the order, so that a term in very many documents fills many files
    placed = placed.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block", "row")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings")
    remove_dir(spark, run.path)
    stored = spark.read.schema(placed.schema).parquet(f"{path}/postings")
    heads = stored.groupBy("bucket", "term", "block").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
    heads.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/heads")
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(block).alias("block"), F.lit(doc).alias("doc")).coalesce(1).write.parquet(f"{path}/settings")
    return Index(spark, path)


@dataclass
class Index:
    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}")
        made = read("settings").first()
        self.buckets, self.block, self.doc = made["buckets"], made["block"], made["doc"]
        self.documents = read("documents")
        self.postings = self.spark.read.schema("term string, block bigint, row bigint, tf bigint, weight double, bucket int").parquet(f"{self.path}/postings")
        self.heads = self.spark.read.schema("term string, block bigint, n bigint, top double, bucket int").parquet(f"{self.path}/heads")

    def _of(self, table: DataFrame, asked: Sequence[str]) -> DataFrame:
        """A table's rows of some terms: their folders alone are listed and read."""
        found = self.spark.range(1).select(F.explode(F.array(*map(F.lit, asked))).alias("t")).select(_bucket(F.col("t"), self.buckets).alias("b"))
        return table.where(F.col("bucket").isin(sorted({r["b"] for r in found.collect()})) & F.col("term").isin(list(asked)))

    def bounds(self, query: str, language: str | None = None) -> tuple[DataFrame, dict[str, float]]:
        """block and bound, the most that a document of the block can score, and the weight of each term that is stored."""
        asked = keyword.asked_tokens(self.spark, query, language)
        heads = self._of(self.heads, asked) if asked else self.heads.limit(0)
        total = self.documents.count()
        df = {r["term"]: r["df"] for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each asked term
        idf = {t: log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) for t in asked if t in df}
        return heads.groupBy("block").agg(F.sum(_weighted("top", idf)).alias("bound")), idf

    def scored(self, idf: dict[str, float], blocks: Sequence[int] | DataFrame) -> DataFrame:
        """row and score of the documents of some blocks; a row's terms are added in the query's order, so equal texts tie."""
        if not idf:
            return self.postings.select("row", F.col("weight").alias("score")).limit(0)
        held = self._of(self.postings, list(idf))
        held = held.join(blocks.select("block"), "block", "left_semi") if isinstance(blocks, DataFrame) else held.where(F.col("block").isin(list(blocks)))
        each = [F.max(F.when(F.col("term") == t, F.col("weight"))).alias(f"_{i}") for i, t in enumerate(idf)]
        score = sum((F.coalesce(F.col(f"_{i}"), F.lit(0.0)) * w for i, w in enumerate(idf.values())), F.lit(0.0))
        return held.groupBy("row").agg(*each).select("row", score.alias("score"))

    def top_k(self, query: str, k: int = 10, language: str | None = None) -> DataFrame:
        """doc and score of the k best by BM25, ties to the smaller id; the same rows as by scoring all documents.

        The blocks with the highest bounds are scored first; the k-th score found is a floor, and only blocks whose bound
        reaches it are read then.  With fewer than k hits so far there is no floor and all blocks of the terms are open.
        """
        if k < 1:
            raise ValueError("k counts from 1")
        bounds, idf = self.bounds(query, language)
        if not idf:
            return self.documents.select(self.doc, F.lit(0.0).alias("score")).limit(0)
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(max(1, -(-FIRST * k // self.block))).collect()]
        floor = self.scored(idf, first).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
        open_ = bounds.where(F.col("bound") >= floor["low"] * (1 - SLACK)) if floor["n"] == k else bounds
        few = [r["block"] for r in open_.select("block").limit(LITERALS + 1).collect()]
        hits = self.scored(idf, few if len(few) <= LITERALS else open_)
        if floor["n"] == k:
            hits = hits.where(F.col("score") >= floor["low"] * (1 - SLACK))
        # ties at the k-th place are told by id, so hits that reach the k-th score meet their documents
        edge = hits.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("low"))
        hits = hits.join(F.broadcast(edge), F.col("score") >= F.col("low") * (1 - SLACK)).select("row", "score")
        return self.documents.join(hits, "row").select(self.doc, "score").orderBy(F.desc("score"), self.doc).limit(k)


def _weighted(value: str, idf: dict[str, float]) -> Column:
    """``value`` times the weight of the row's term."""
    cases = F.lit(0.0)
    for term, weight in idf.items():
        cases = F.when(F.col("term") == term, F.lit(weight)).otherwise(cases)
    return cases * F.col(value)
