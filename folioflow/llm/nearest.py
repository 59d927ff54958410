"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets, for each of TREES trees, a string of BITS random-hyperplane bits; a tree is the sorted array of those
strings.  A query descends each tree to its longest prefix matches, which are a contiguous range found by binary search,
and then ascends all trees together, one bit shorter at a time.  Each step about doubles the candidates, whose inner
products are computed exactly on the original vectors; the ascent ends when STEADY steps in a row have brought nothing
nearer than the best found, or when all is seen.  So vectors in clusters end early, and vectors without structure, where
no hash tells near from far, are mostly scanned.

Inner products become angles by one more coordinate that brings every indexed vector to the same length (0 for queries).

The table is dealt into shards of about SHARD_ROWS vectors, written once, and each shard holds a forest of its own
vectors.  Queries go to all shards in blocks of about QUERY_ROWS, one block after the other; a shard answers with its best,
and the best of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import materialise

TREES = 16
BITS = 64
SHARD_ROWS = 32_768
QUERY_ROWS = 20_000
STEADY = 2  #: steps without anything nearer that end the ascent
LEAST_ENTRIES = 2_000  #: entries of all trees together with which the ascent begins


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, seed: int = 17):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        with np.errstate(over="ignore"):
            self.scale = max(np.abs(self.vectors).max(initial=0.0), 1e-300)
            unit = self.vectors / self.scale
        lengths = (unit * unit).sum(1)
        self.longest = self.scale * np.sqrt(lengths.max(initial=0.0))
        extra = np.sqrt(np.maximum(lengths.max(initial=0.0) - lengths, 0))
        self.planes = np.random.default_rng(seed).normal(size=(trees, vectors.shape[1] + 1, BITS))
        codes = self.codes(np.column_stack((unit, extra)))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """A 64-bit string, first bit highest, for each tree and row."""
        out = np.empty((len(self.planes), len(rows)), np.uint64)
        for t, plane in enumerate(self.planes):
            out[t] = np.packbits(rows @ plane > 0, axis=1).view(">u8").ravel()
        return out

    def ranges(self, codes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last entry that shares ``level`` leading bits, for each tree and query."""
        tail = np.where(level == 0, np.uint64(2**64 - 1), (np.uint64(1) << (np.uint64(BITS) - np.maximum(level, 1)).astype(np.uint64)) - np.uint64(1))
        low = np.stack([np.searchsorted(s, c & ~tail) for s, c in zip(self.sorted, codes, strict=True)])
        high = np.stack([np.searchsorted(s, c | tail, side="right") for s, c in zip(self.sorted, codes, strict=True)])
        return low, high

    def search(self, queries: np.ndarray, k: int, steady: int = STEADY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and scores of the best ``k`` found, nearest first, ties to the smaller id."""
        with np.errstate(over="ignore"):
            unit = queries / np.abs(queries).max(1, keepdims=True)
        codes = self.codes(np.column_stack((unit, np.zeros(len(queries)))))
        least, most = np.zeros(len(queries), np.uint64), np.full(len(queries), BITS, np.uint64)
        entries = min(max(LEAST_ENTRIES, 4 * k), len(self.planes) * len(self.ids))
        while (least < most).any():  # the longest level at which all trees together hold enough
            level = (least + most + np.uint64(1)) // np.uint64(2)
            low, high = self.ranges(codes, level)
            enough = (high - low).sum(0) >= entries
            least, most = np.where(enough, level, least), np.where(enough, most, level - np.uint64(1))
        level = least
        low, high = self.ranges(codes, level)
        trees = range(len(self.planes))
        slack = 1e-9 * self.longest * np.sqrt((queries * queries).sum(1))  # far more than sums in another order differ by
        mark, new = np.zeros(len(self.ids), bool), np.zeros(len(self.ids), bool)
        for q, query in enumerate(queries):
            mark[:] = False
            seen, best, score, calm, own = 0, np.zeros(0, np.int64), np.zeros(0), 0, codes[:, q : q + 1]
            at, begin, stop = int(level[q]), low[:, q], high[:, q]
            pieces = [self.order[t, begin[t] : stop[t]] for t in trees]
            while True:
                for piece in pieces:
                    new[piece] = True
                found = np.flatnonzero(new & ~mark)
                mark |= new
                new[:] = False
                seen += len(found)
                rough = np.einsum("ij,j->i", self.vectors[found], query)
                edge = score[-1] if len(best) == k else np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
                found = found[rough >= edge - slack[q]]
                before = score[-1] if len(best) == k else -np.inf
                best = np.concatenate((best, found))
                score = np.concatenate((score, (self.vectors[found] * query).sum(1)))
                order = np.lexsort((self.ids[best], -score))[:k]
                best, score = best[order], score[order]
                calm = calm + 1 if len(best) == k and score[-1] == before else 0
                if calm >= steady or seen == len(self.ids) or at == 0:
                    break
                at -= 1
                wide_low, wide_high = self.ranges(own, np.array([at], np.uint64))
                pieces = [x for t in trees for x in (self.order[t, wide_low[t, 0] : begin[t]], self.order[t, stop[t] : wide_high[t, 0]])]
                begin, stop = wide_low[:, 0], wide_high[:, 0]
            yield best, score


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector of the rows that take part: an id, and a vector that is finite, without nulls and not zero."""
    v = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("bigint").alias("id"), v.alias("vector")).where("id is not null and vector is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def nearest(table: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", trees: int = TREES, steady: int = STEADY) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` rows found with the largest inner product with each query.

    ``is_query`` is a condition on the column ``id``.  A query's own row is no candidate, other rows of its id are.  Rows
    that are equal in id and vector, or in id alone, are queries of their own, each with ranks from 1; equal ones are
    searched once.  Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
    without an id; vectors of another length than the query's are not compared.  Ties go to the smaller id; of repeated
    rows each is a candidate.
    """
    spark = table.sparkSession
    rows = usable(table, id_column, vector_column)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    total, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    if not asked:
        return spark.createDataFrame([], schema)
    shards = materialise(rows.repartition(max(1, -(-total // SHARD_ROWS)), F.xxhash64("id", "vector")), "vectors")
    blocks = -(-asked // QUERY_ROWS)
    deal = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))  # of rows, so that one id can't fill a block
    queries = shards.where(is_query).groupBy("id", "vector").agg(F.count("*").cast("int").alias("copies"))
    found = [materialise(_block(shards, queries.where(deal == b), b, k + 1, trees, steady), "nearest") for b in range(blocks)]
    each = reduce(DataFrame.unionByName, found).select("query", "query_id", "copies", F.inline(F.arrays_zip("ids", "scores", "own")))
    # the own row is among the best k + 1 or it isn't among the best k: one such row goes
    order = Window.partitionBy("query").orderBy(F.desc("scores"), "ids", F.desc("own"))
    numbered = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    first = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    numbered = numbered.withColumn("first", F.coalesce(first, F.lit(k + 1)))
    rank = F.col("place") - (F.col("place") > F.col("first")).cast("int")
    each_copy = numbered.where("place <> first").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return each_copy.select("query_id", rank.cast("int").alias("rank"), F.col("ids").alias("vec_id"), F.col("scores").alias("score"))


def _block(shards: DataFrame, queries: DataFrame, block: int, k: int, trees: int, steady: int) -> DataFrame:
    """The best of every shard for a block of queries, whose size is bounded by QUERY_ROWS as hashes deal them."""
    got = queries.orderBy("id", "vector").toArrow()
    keys, lists = got["id"].to_numpy(), got["vector"].combine_chunks()
    width = np.diff(lists.offsets.to_numpy())
    copies = got["copies"].to_numpy()
    parts = {}  # by the vectors' length: place in the block, id, copies and vector
    for n in np.unique(width).tolist():
        at = np.flatnonzero(width == n)
        parts[n] = (at + block * 2**40, keys[at], copies[at], lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n))
    asked = shards.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SHARD_ROWS * 3 // 2:
                yield from answer(held)
                held, size = [], 0
        if size:
            yield from answer(held)

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([b.column("id").to_numpy() for b in held])
        lists = [b.column("vector") for b in held]
        lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
        flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])
        first = np.cumsum(lengths) - lengths
        for n in np.unique(lengths).tolist():
            if n not in asked.value:
                continue
            number, own, copies, vectors = asked.value[n]
            at = np.flatnonzero(lengths == n)
            forest = Forest(ids[at], flat[first[at][:, None] + np.arange(n)], trees)
            out = list(forest.search(vectors, k, steady))
            itself = [(forest.ids[best] == i) & (forest.vectors[best] == v).all(1) for i, v, (best, _) in zip(own.tolist(), vectors, out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(own), pa.array(copies), pa.array([forest.ids[best] for best, _ in out], pa.list_(pa.int64())), pa.array([s for _, s in out], pa.list_(pa.float64())), pa.array(itself, pa.list_(pa.bool_()))], ["query", "query_id", "copies", "ids", "scores", "own"])

    return shards.mapInArrow(run, "query bigint, query_id bigint, copies int, ids array<bigint>, scores array<double>, own array<boolean>")
