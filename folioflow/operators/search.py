"""From ranked lists to results: fusion, blending, diversity, grouping by note, folder suggestion, the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import python_text as P
from folioflow.operators import dense, keyword

RRF_K = 60


@dataclass(frozen=True)
class Profile:
    """The dials of a search; ``resolve`` takes each from the first source that sets it."""

    limit: int = 5
    candidate_pool: int = 0
    diversity: float = 0.0
    group: bool = False
    rerank: bool = False

    @classmethod
    def resolve(cls, *sources: dict) -> "Profile":
        return cls(**{k: v for source in reversed(sources) for k, v in source.items() if v is not None})

    @property
    def pool(self) -> int:
        """How many candidates a leg fetches."""
        wide = self.group or self.rerank or self.diversity > 0
        return max(4 * self.limit, self.candidate_pool) if wide else self.limit


def clamped(limit: int, low: int = 1, high: int = 100) -> int:
    return min(max(limit, low), high)


def ranked(leg: DataFrame, k: int, id_: str = "doc_id") -> DataFrame:
    """The first k of a leg with their ranks from 1.  The limit comes first, so only k rows are ranked in one task."""
    top = leg.orderBy(F.desc("score"), id_).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)))


def rrf(legs: Sequence[DataFrame], pool: int, limit: int, id_: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """id and score: the sum over the legs of 1 / (k + rank), best first, ties to the smaller id."""
    both = None
    for leg in legs:
        part = ranked(leg, pool, id_).select(id_, (1 / (F.col("rank") + k)).alias("_s"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(id_).agg(F.sum("_s").alias("score")).orderBy(F.desc("score"), id_).limit(limit)


def minmax(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``column`` scaled to 0..1 over the pool; 0.5 where the pool is constant."""
    w = Window.partitionBy(*by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(out, F.when(high == low, 0.5).otherwise(F.try_divide(F.col(column) - low, high - low)))


def blended(pool: DataFrame, n: int, score: str = "score", rerank: str = "rerank_score", id_: str = "doc_id") -> DataFrame:
    """0.4 of the first score and 0.6 of the reranker's, scaled over the pool.

    A candidate without a reranker's score counts 0 before scaling by the returned ones, so it can leave 0..1.  The pool
    is a page of candidates, which one task holds.
    """
    low, high = F.min(rerank).over(Window.partitionBy()), F.max(rerank).over(Window.partitionBy())
    scaled = F.when(low.isNull() | (low == high), 0.5).otherwise(F.try_divide(F.coalesce(F.col(rerank), F.lit(0.0)) - low, high - low))
    return pool.withColumn("blend", 0.4 * F.col(score) + 0.6 * scaled).orderBy(F.desc("blend"), id_).limit(n)


def passthrough(pool: DataFrame, n: int, id_: str = "doc_id") -> DataFrame:
    """The stage without a reranker: the first ``n`` by the score that they have, ties to the smaller id."""
    return pool.orderBy(F.desc("score"), id_).limit(n)


def scrubbed(hits: DataFrame) -> DataFrame:
    """``hits`` with valid UTF-8 in all their texts: each invalid byte is one replacement character.

    Valid texts, which are nearly all, stay in the JVM; only others are sent to Python.
    """
    clean = lambda c: F.coalesce(P.scrubbed(F.when(~F.is_valid_utf8(c), F.col(c).cast("binary"))), F.col(c)).alias(c)
    return hits.select(*[clean(c) if t == "string" else F.col(c) for c, t in hits.dtypes])


def mmr_order(scores: np.ndarray, vectors: list, diversity: float, n: int) -> list[int]:
    """Indices in the order of picking: relevance (scaled over the pool) against the largest cosine to what is picked."""
    low, high = (scores.min(), scores.max()) if len(scores) else (0, 0)
    relevance = np.full(len(scores), 1.0) if high == low else (scores - low) / (high - low)
    size = max((len(v) for v in vectors if v is not None), default=0)
    unit = np.zeros((len(scores), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size and (length := np.linalg.norm(v)) > 0:
            unit[i] = np.asarray(v, float) / length
    picked, worst, left = [], np.zeros(len(scores)), np.ones(len(scores), bool)
    while left.any() and len(picked) < n:
        value = relevance if not picked else (1 - diversity) * relevance - diversity * worst
        best = int(np.where(left, value, -np.inf).argmax())
        near = unit @ unit[best]
        worst = near if not picked else np.maximum(worst, near)
        picked.append(best)
        left[best] = False
    return picked


def mmr(pool: DataFrame, n: int, diversity: float, query: str = "query_id", id_: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """query, id, score and pick (from 1): maximal marginal relevance within each query's pool.

    The pick depends on the picks before it, so each pool (a few hundred rows at most) is one group; with diversity 0 it
    is the order by score.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", id_], ascending=[False, True], ignore_index=True)
        order = list(range(min(n, len(frame)))) if diversity == 0 else mmr_order(frame["score"].to_numpy(float), list(frame[vector]), diversity, n)
        out = frame.iloc[order][[query, id_, "score"]].copy()
        out["pick"] = range(1, len(out) + 1)
        return out

    kinds = dict(pool.dtypes)
    return pool.select(query, id_, "score", vector).groupBy(query).applyInPandas(run, f"{query} {kinds[query]}, {id_} {kinds[id_]}, score double, pick int")


def collapse(hits: DataFrame, by: Sequence[str] = ("vault_id", "source_path"), id_: str = "chunk_id", others: Sequence[str] = ()) -> DataFrame:
    """The best chunk of each note (ties to the smaller id) and how many chunks of it were hit; no path, no row."""
    best = F.max_by(F.struct(id_, "score", *others), F.struct(F.col("score"), -F.col(id_)) if dict(hits.dtypes)[id_] in ("int", "bigint") else F.struct("score", id_))
    grouped = hits.where(F.col(by[-1]).isNotNull()).groupBy(*by).agg(best.alias("_b"), F.count("*").alias("match_count"))
    return grouped.select(*by, "_b.*", "match_count").orderBy(F.desc("score"), *by)


def suggest_folder(hits: DataFrame, k: int = 3, top: int = 10, folder: str = "folder", id_: str = "chunk_id") -> DataFrame:
    """The folders of the first ``top`` chunk hits by how many of them they hold."""
    first = hits.orderBy(F.desc("score"), id_).limit(top)
    return first.groupBy(folder).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), folder).limit(k)


def rehydrate(hits: DataFrame, notes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Hits with the notes' present values of ``columns``; where there is no live note, the hit's own stay."""
    fresh = notes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = hits.join(fresh, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in hits.columns])


def attach_ids(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """Hits with the note's id by vault and path; a path is looked up in its own vault only."""
    return hits.join(notes.select("vault_id", F.col("path").alias("source_path"), "note_id"), ["vault_id", "source_path"], "left")


def search(chunks: DataFrame, query: str, vector: Sequence[float] | None, mode: str = "hybrid", profile: Profile = Profile(), rerank: Callable[[DataFrame, str], DataFrame] | None = None, id_: str = "chunk_id", **filters) -> DataFrame:
    """The whole search over chunks (id, text, vector, vault_id, source_path and what the filters need).

    ``mode`` is vector, keyword or hybrid; a hybrid search without a vector (the embedder failed) is a keyword search.
    ``rerank`` adds a rerank_score to the pool, which is blended with the score; without it, or where the profile doesn't ask
    for it, the pool passes by its score.  The stage keeps the whole pool where diversity or grouping follow, otherwise
    ``limit``.  The texts of the results are ``scrubbed``.
    """
    if mode not in ("vector", "keyword", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    live = dense.filtered(chunks, **filters)
    pool = profile.pool
    legs = []
    if mode != "keyword" and vector is not None:
        legs.append(dense.top_k(live, vector, pool, id_, "vector"))
    if mode != "vector":
        legs.append(keyword.bm25(live, query, id_).orderBy(F.desc("score"), id_).limit(pool))
    if not legs:
        raise ValueError("a vector search needs a vector")
    found = rrf(legs, pool, pool, id_) if len(legs) > 1 else legs[0]
    hits = live.join(F.broadcast(found), id_)
    keep = pool if profile.group or profile.diversity > 0 else profile.limit
    if profile.rerank and rerank is not None:
        hits = blended(rerank(hits, query), keep, id_=id_).drop("score").withColumnRenamed("blend", "score")
    else:
        hits = passthrough(hits, keep, id_)
    if profile.diversity > 0:
        picked = mmr(hits.withColumn("_q", F.lit(0)), pool if profile.group else profile.limit, profile.diversity, "_q", id_, "vector")
        hits = hits.drop("score").join(F.broadcast(picked.select(id_, "score", "pick")), id_)
    if profile.group:
        return scrubbed(collapse(hits, id_=id_, others=("text",)).limit(profile.limit))
    return scrubbed(hits.orderBy(*(["pick"] if profile.diversity > 0 else [F.desc("score"), id_])).limit(profile.limit))
