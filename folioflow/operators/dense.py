"""Dense retrieval: exact cosine top-k under filters, and sign-bit search with exact rescoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.scratch import Scratch

OVERSAMPLING = 3.0
BLOCK_QUERIES = 16384  #: queries that meet a block of vectors in one task
BLOCK_ROWS = 65536  #: vectors of a block
CHUNK = 1024  #: rows and queries of one matrix product
MARGIN = 1e-9  #: more than a matrix product's rounding of a cosine


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null or has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def filtered(vectors: DataFrame, *, vaults: Sequence = (), tags_any: Sequence[str] = (), folder: str | None = None, type_: str | None = None, since: str | None = None, until: str | None = None, vault: str = "vault_id") -> DataFrame:
    """All given conditions hold: vault in the list, any of the tags, the folder itself (not below it), the type, and the
    note's date within the bounds (inclusive; no date never matches)."""
    if vaults:
        vectors = vectors.where(F.col(vault).isin(list(vaults)))
    if tags_any:
        vectors = vectors.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags_any))))
    if folder is not None:
        vectors = vectors.where(F.col("folder") == folder)
    if type_ is not None:
        vectors = vectors.where(F.col("type") == type_)
    if since is not None:
        vectors = vectors.where(F.col("fm_timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        vectors = vectors.where(F.col("fm_timestamp") <= F.lit(until).cast("timestamp"))
    return vectors


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 5, id_: str = "vec_id", vector: str = "embedding", with_vector: bool = False) -> DataFrame:
    """The k nearest by cosine, ties to the smaller id.  The query is a literal, so this is one scan and a top-k."""
    kept = [id_, vector] if with_vector else [id_]
    return vectors.select(*kept, cosine(F.col(vector), literal(query)).alias("score")).orderBy(F.desc("score"), id_).limit(k)


def signs(vector: Column) -> Column:
    """The sign bits as 0/1, in 63-bit words."""
    bit = lambda i: F.when(F.element_at(vector, i) > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    words = F.ceil(F.size(vector) / 63).cast("int")
    word = lambda w: F.aggregate(F.sequence(w * 63 + 1, F.least(F.size(vector), (w + 1) * 63)), F.lit(0).cast("bigint"), lambda s, i: F.shiftleft(s, 1) + bit(i))
    return F.transform(F.sequence(F.lit(0), words - 1), word)


def query_signs(query: Sequence[float]) -> list[int]:
    """``signs`` of a query."""
    bits = [int(x > 0) for x in query]
    return [int("".join(map(str, bits[i : i + 63])), 2) for i in range(0, len(bits), 63)]


def with_signs(vectors: DataFrame, vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """``vectors`` with the packed sign bits of each vector in a column ``signs``, to be stored beside it.

    Vectors that are null, or of another size than ``dims`` where that is given, have none and are not found by signs.
    """
    usable = F.col(vector).isNotNull() if dims is None else F.size(vector) == dims
    return vectors.withColumn("signs", F.when(usable, signs(F.col(vector))))


def quantised_top_k(indexed: DataFrame, query: Sequence[float], k: int = 5, oversampling: float = OVERSAMPLING, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``oversampling * k`` nearest by differing sign bits (ties to the smaller id), rescored exactly.

    ``indexed`` is a stored table of ``with_signs``.  The search reads ids and sign words alone and counts differing bits
    word by word; full vectors are read for the few rows that are rescored.  Signs of another size don't take part.
    """
    words = query_signs(query)
    differ = sum((F.bit_count(F.col("signs")[i].bitwiseXOR(F.lit(w).cast("bigint"))) for i, w in enumerate(words)), F.lit(0))
    few = indexed.where(F.size("signs") == len(words)).select(id_, differ.alias("_d")).orderBy("_d", id_).limit(int(oversampling * k))
    few = few.groupBy(id_).agg(F.count("*").alias("_n"))  # of an id in several rows all are rescored
    return top_k(indexed.join(F.broadcast(few), id_), query, k, id_, vector)


def query_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding", block: int = BLOCK_QUERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id and score of the k nearest of each query in a table of queries (query_id, query), ties to the smaller id.

    Both sides are written once, with a number for each row that deals them evenly into blocks of about ``block`` queries
    and ``rows`` vectors, whatever ids repeat; only the two counts come to the driver.  Each block of vectors meets each
    block of queries in one task of a shuffle, so a task holds one block of each, and keeps the exact k best of its rows for
    each query.  Those are shuffled by query, ranked, and written; the blocks are removed.  Scores are those of ``cosine``,
    to the bit.  Rows of an id that several rows share count one by one; without queries or vectors there are no rows.
    """
    spark, kinds = vectors.sparkSession, {**dict(vectors.dtypes), **dict(queries.dtypes)}
    run = Scratch(spark, "nearest")
    dealt = F.xxhash64(F.monotonically_increasing_id())
    asked, q = run.measured(queries.select("query_id", F.col("query").cast("array<double>").alias("query"), dealt.alias("_n")), "queries", n=F.count(F.lit(1)))
    held, v = run.measured(vectors.select(id_, F.col(vector).cast("array<double>").alias("_v"), dealt.alias("_n")), "vectors", n=F.count(F.lit(1)))
    columns, across = max(1, -(-(q["n"] or 0) // block)), max(1, -(-(v["n"] or 0) // rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.col("_n"), F.lit(n)).cast("int")
    left = asked.select("query_id", "query", place(columns).alias("_q"), every(across).alias("_b"))
    right = held.select(id_, "_v", every(columns).alias("_q"), place(across).alias("_b"))
    schema = f"query_id {kinds['query_id']}, {id_} {kinds[id_]}, score double"
    met = left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInArrow(_nearest_of_blocks(k, id_), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_)
    return run.finish(met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows of ``width`` columns, their lengths (-1: null, or with a null inside) and their norms."""
    out, size = np.zeros((len(column), width)), np.full(len(column), -1)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        for i, v in enumerate(column.to_pylist()):
            if v is not None and None not in v:
                size[i] = len(v)
                out[i, : len(v)] = v[:width]
    else:
        ends = np.cumsum(np.maximum(lengths, 0))
        size = lengths
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            out[at, : min(n, width)] = values[(ends[at] - n)[:, None] + np.arange(min(n, width))]
    norm = np.zeros(len(column))
    for d in range(width):
        norm += out[:, d] * out[:, d]
    return out, size, np.sqrt(norm)


def _nearest_of_blocks(k: int, id_: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        query = asked.column("query").combine_chunks()
        width = max(pc.max(pc.list_value_length(query)).as_py() or 0, 0) if len(query) else 0
        q, q_size, q_norm = _matrix(query, width)
        best: list[list[tuple[float, bool, object, float]]] = [[] for _ in q]  # order: score down, null ids first, id
        floor = np.full(len(q), -np.inf)  # k-th best so far
        vectors = vectors.take(pc.sort_indices(vectors.column(id_), null_placement="at_start"))
        for at in range(0, vectors.num_rows if len(q) else 0, CHUNK):
            part = vectors.slice(at, CHUNK)
            keys = part.column(id_).to_pylist()
            v, v_size, v_norm = _matrix(part.column("_v").combine_chunks(), width)
            for begin in range(0, len(q), CHUNK):
                stop = min(begin + CHUNK, len(q))
                for i, rows, scores in _candidates(q[begin:stop], q_size[begin:stop], q_norm[begin:stop], v, v_size, v_norm, floor[begin:stop], k):
                    more = [(-_rank(s), keys[r] is not None, keys[r], s) for r, s in zip(rows, scores, strict=True)]
                    held = best[begin + i] = sorted(best[begin + i] + more, key=lambda x: x[:3] if x[1] else x[:2])[:k]
                    if len(held) == k:
                        floor[begin + i] = -held[-1][0]
        number = np.repeat(np.arange(len(q)), [len(x) for x in best])
        flat = [x for held in best for x in held]
        kinds = asked.schema.field("query_id").type, vectors.schema.field(id_).type
        return pa.table({"query_id": asked.column("query_id").combine_chunks().take(pa.array(number, pa.int64())).cast(kinds[0]), id_: pa.array([x[2] for x in flat], kinds[1]), "score": pa.array([x[3] for x in flat], pa.float64())})

    return run


def _rank(score: float) -> float:
    """Spark's order: not-a-number above all."""
    return np.inf if score != score else score


def _candidates(q, q_size, q_norm, v, v_size, v_norm, floor, k) -> Iterator[tuple[int, list[int], list[float]]]:
    """Query number, and rows and scores that may be among its k best: found by a matrix product with a margin for its
    rounding, then scored exactly, in the order of the dimensions."""
    with np.errstate(all="ignore"):
        live = (q_size[:, None] == v_size) & (q_size[:, None] >= 0)
        size = q_norm[:, None] * v_norm
        live &= (size > 0) | np.isnan(size)
        near = np.where(live, (q @ v.T) / size, 0.0)
        near = np.where(np.isnan(near), np.inf, near)
        kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(q), -np.inf)
        open_ = near >= np.maximum(floor, kth)[:, None] - MARGIN
        for i in np.flatnonzero(open_.any(1)).tolist():
            at = np.flatnonzero(open_[i])
            dot = np.zeros(len(at))
            for d in range(q.shape[1]):
                dot += v[at, d] * q[i, d]
            score = np.where(live[i, at], dot / (v_norm[at] * q_norm[i]), 0.0)
            order = np.argsort(-np.where(np.isnan(score), np.inf, score), kind="stable")[:k]
            yield i, at[order].tolist(), score[order].tolist()
