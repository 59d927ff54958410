"""k-means over integer vectors with Yinyang's filters: exact results, few distances.

Centroids are put into groups once.  Each vector keeps an upper bound of the distance to its centroid and, for each group, a
lower bound of the distance to every other centroid of the group.  When the centroids move, the bounds are widened by how far
they moved, and a vector asks in turn: can any group hold something nearer (the global filter)?  Which groups can?  Which of
their centroids can?  Only those are scanned, with exact integer distances, so the result is that of a full scan; a bound
never decides a tie.

A round is one pass over the vectors and their bounds, dealt as Spark reads them, and one aggregation of a row a centroid.
What goes to every task are the centroids and their groups; what comes back to the driver is a sum for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, remove_dir

GROUP_SIZE = 10  #: centroids of a group, about
BATCH_ROWS = 8_192
LARGEST = (1 << 27) - 1  #: of a component's integer; with it, squared distances of 64 components fit 63 bits
_SLACK = 1e-9  #: of bounds, for rounding; it only makes filters keep more

_STATE = "vec_id bigint, cells binary, cluster int, upper double, lower binary, distance bigint"


def integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and cells (floor(scale * x), 32 bits each) of the vectors with ``dims`` components, none null or non-finite.

    Components beyond LARGEST count as LARGEST.
    """
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("embedding").flatten().to_numpy().reshape(-1, dims)
                with np.errstate(over="ignore"):
                    cells = np.clip(np.floor(float(scale) * values), -LARGEST, LARGEST).astype("<i4")
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in cells], pa.binary())], ["vec_id", "cells"])

    return own.where((F.size("embedding") == dims) & finite).mapInArrow(pack, "vec_id bigint, cells binary")


def groups_of(centroids: np.ndarray, size: int = GROUP_SIZE) -> np.ndarray:
    """The group of each centroid, by a few rounds of k-means among the centroids."""
    k = len(centroids)
    n = -(-k // size)
    points = centroids.astype(np.float64)
    centres = points[np.linspace(0, k - 1, n).astype(int)] if k else points
    group = np.zeros(k, np.int64)
    for _ in range(5):
        group = ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if n else group
        centres = np.array([points[group == g].mean(0) if (group == g).any() else centres[g] for g in range(n)])
    return np.unique(group, return_inverse=True)[1]


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


class Assignment:
    """The nearest centroid of each vector of a batch, and the bounds that let the next round skip distances."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray, group: np.ndarray):
        self.centroids, self.moved, self.group = centroids, moved, group
        self.n = int(group.max()) + 1
        self.members = [np.flatnonzero(group == g) for g in range(self.n)]
        self.most_moved = np.array([moved[m].max() for m in self.members])
        self.distances = 0  # how many were computed

    def _to(self, x: np.ndarray, at: np.ndarray, centroid: int) -> np.ndarray:
        self.distances += len(at)
        return squared(x[at], self.centroids[centroid])

    def run(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Updates cluster, upper and lower in place.  A new vector has any cluster, an infinite upper and lower bounds of -inf."""
        upper += self.moved[cluster]
        before = lower.copy()
        lower -= self.most_moved
        loose = lambda u: u + _SLACK * (1 + np.abs(u))
        least = lower.min(1)
        at = np.flatnonzero(~(least > loose(upper)))  # the global filter, with the old bound
        own = np.zeros(len(at), np.int64)
        for c in np.unique(cluster[at]).tolist():
            mine = np.flatnonzero(cluster[at] == c)
            own[mine] = self._to(x, at[mine], c)
        upper[at] = np.sqrt(own.astype(np.float64))
        near = ~(least[at] > loose(upper[at]))  # and with the exact distance
        at, own = at[near], own[near]
        if not len(at):
            return
        old = cluster[at]
        best, who = own.copy(), old.copy()
        far = np.iinfo(np.int64).max
        seen = []
        for g, members in enumerate(self.members):
            reach = loose(np.sqrt(best.astype(np.float64)))
            inside = np.flatnonzero(~(lower[at, g] > reach))  # the group filter
            if not len(inside):
                continue
            first, second, which = np.full(len(inside), far), np.full(len(inside), far), np.full(len(inside), -1)
            skipped = np.full(len(inside), np.inf)
            for c in members.tolist():
                bound = before[at[inside], g] - self.moved[c]
                mine = old[inside] == c
                scan = mine | ~(bound > reach[inside])  # the centroid filter
                skipped[~scan] = np.minimum(skipped[~scan], bound[~scan])
                here = np.flatnonzero(scan)
                value = np.where(mine[here], own[inside[here]], 0)
                other = np.flatnonzero(~mine[here])
                value[other] = self._to(x, at[inside[here[other]]], c)
                closer = value < first[here]
                second[here] = np.where(closer, first[here], np.minimum(second[here], value))
                first[here], which[here] = np.where(closer, value, first[here]), np.where(closer, c, which[here])
            found = which >= 0
            wins = found & ((first < best[inside]) | ((first == best[inside]) & (which < who[inside])))
            best[inside[wins]], who[inside[wins]] = first[wins], which[wins]
            seen.append((g, inside, first, second, which, skipped))
        root = lambda v: np.where(v == far, np.inf, np.sqrt(v.astype(np.float64)))
        changed = np.flatnonzero(who != old)  # its old centroid is now one of the others
        g = self.group[old[changed]]
        lower[at[changed], g] = np.minimum(lower[at[changed], g], root(own[changed]))
        for g, inside, first, second, which, skipped in seen:
            rest = np.where(which == who[inside], root(second), root(first))
            lower[at[inside], g] = np.minimum(rest, skipped)
        cluster[at], upper[at] = who, root(best)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, moved: np.ndarray, group: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    step = Assignment(centroids, moved, group)
    dims = centroids.shape[1]
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(begin, BATCH_ROWS)
            x = np.frombuffer(b"".join(part.column("cells").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            if "cluster" in part.schema.names:
                cluster, upper = (part.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("cluster", np.int64), ("upper", np.float64)))
                lower = np.frombuffer(b"".join(part.column("lower").to_pylist()), "<f8").reshape(-1, step.n).copy()
            else:
                cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full((len(x), step.n), -np.inf)
            step.run(x, cluster, upper, lower)
            distance = np.zeros(len(x), np.int64)
            if last:
                apart = x - centroids[cluster]
                distance = np.einsum("ij,ij->i", apart, apart)
            columns = [part.column("vec_id"), part.column("cells"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cells", "cluster", "upper", "lower", "distance"])


def _sums(batches: Iterator[pa.RecordBatch], k: int, dims: int) -> Iterator[pa.RecordBatch]:
    """cluster, n and the sums of its components, for what a task reads."""
    n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for batch in batches:
        cluster = batch.column("cluster").to_numpy()
        x = np.frombuffer(b"".join(batch.column("cells").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
        order = np.argsort(cluster, kind="stable")
        names, first, count = np.unique(cluster[order], return_index=True, return_counts=True)
        if len(names):
            total[names] += np.add.reduceat(x[order], first)
            n[names] += count
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Kept are the vectors with ``dims`` components, none null or non-finite; each component x becomes floor(scale * x).
    Centroids start as the ``k`` kept vectors (all, if fewer) with the smallest sha256 of ``seed:vec_id``, those of one id in
    the order of their components; a null id hashes as an empty one.  Each round assigns every vector to its nearest
    centroid, ties to the smaller number, and moves each centroid to the floor of its vectors' mean; one without vectors
    stays.  Then vectors are assigned once more.  Repeated rows are rows of their own.  Without kept vectors the result is
    empty.  Other columns aren't read.  Inertias beyond 63 bits are shown as the largest number of 63 bits.
    """
    run = Scratch(vectors.sparkSession, "clustering")
    state, folder = run.place(integers(vectors, dims, scale), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = state.orderBy(name, "cells").limit(k).select("cells").collect()
    if not start:
        return run.finish(vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    centroids = np.array([np.frombuffer(r["cells"], "<i4") for r in start], np.int64)
    group, moved = groups_of(centroids), np.zeros(len(centroids))
    for turn in range(rounds + 1):
        before = folder
        state, folder = run.place(state.mapInArrow(partial(_assign, centroids=centroids, moved=moved, group=group, last=turn == rounds), _STATE), "assigned")
        remove_dir(vectors.sparkSession, before)
        if turn < rounds:
            partial_sums = state.select("cluster", "cells").mapInArrow(partial(_sums, k=len(centroids), dims=dims), "cluster int, n bigint, sums array<bigint>")
            # sums and not a mean: exact whatever the order
            sums = partial_sums.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims))).collect()
            new = centroids.copy()
            for r in sums:
                new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
            apart = (new - centroids).astype(np.float64)
            moved, centroids = np.sqrt((apart * apart).sum(1)) * (1 + _SLACK), new
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    capped = lambda x: min(x, 2**63 - 1)
    rows = [(c, capped(d), capped(sum(inertia.values())), digest[c]) for c, d in inertia.items()]
    by_cluster = F.broadcast(vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))  # a row a centroid
    return run.finish(state.select("vec_id", "cluster", "distance").join(by_cluster, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same in DuckDB's SQL, every distance computed."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, e FROM v ORDER BY c LIMIT {k})",
    ]
    for turn in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        steps.append(f"a{turn} AS MATERIALIZED (SELECT r, min(struct_pack(d := {distance}, c := c.c)) AS m FROM v, c{turn} c GROUP BY r)")
        if turn < rounds:
            steps.append(f"s{turn} AS (SELECT m.c AS c, i, floor(sum(e[i])::DOUBLE / count(*))::BIGINT AS x FROM a{turn} JOIN v USING (r), (SELECT unnest(range(1, {dims} + 1)) AS i) GROUP BY ALL)")
            steps.append(f"c{turn + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.e, c.e) AS e FROM c{turn} c LEFT JOIN (SELECT c, list(x ORDER BY i) AS e FROM s{turn} GROUP BY c) n USING (c))")
    return "WITH " + ",\n".join(steps) + (
        f"\nSELECT vec_id, m.c::INTEGER AS cluster, m.d::BIGINT AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256\n"
        f"FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.m.c"
    )


SQL = _sql()
