"""Exact Jaccard self-join of documents' word n-gram sets, by prefix trees.

Sets are ordered globally: first the n-grams that few documents have, by hash, then the frequent ones.  Two sets with
``100 * intersection >= percent * union`` must share an n-gram among the first ``n - ceil(percent * n / 100) + 1`` of
each (the prefix).  The work goes in these steps:

1. One pass finds the frequent n-grams (a hint for the order; the result doesn't depend on it).
2. One pass makes a small row for each document: size, digest of the set (128 bits), prefix, and a sketch, which is how many
   of the n-grams fall into each of 64 classes.  Documents with equal sets are one node from here on.
3. Nodes that share an n-gram of their prefixes are grouped: n-grams are counted by partial sums, those of one node fall
   out, and of those with the same nodes one stays.  Within a group, nodes whose sizes and sketches allow the threshold
   (the sketches' difference is never larger than the sets') are joined into blocks.  Long sets of unlike documents look
   alike in 64 classes, so a block that is too large for one task is cut anew by sketches of 1024.
4. Each block gets its texts and stores its sets in a trie, frequent n-grams first, so that near copies share their path.
   A set traverses the trie once for all sets below a node, with the overlap so far, and leaves out subtrees whose
   remaining lengths can't reach the threshold and those that are already linked to it.
5. Linked nodes, and the documents with equal sets, share a component.

No link is lost: every filter is a bound.  Keys, groups and blocks of any size are dealt over tasks of bounded size:

* An n-gram, set, node or class that very many rows have is counted before it is joined; its rows stay where they are and
  get a broadcast of the few rows that concern such keys (``join_counted``).
* A group with more than GROUP_NODES nodes is compared in parts.  What a part joins is then one box, the range of its
  sizes and sketches, and only boxes are compared across parts; two boxes are joined unless no member of one can be linked
  with a member of the other.
* A block with more than BLOCK_ITEMS n-grams is linked in chunks, then a few sets of each class found are linked with each
  other.  If that leaves one class, as among near copies, the block is done.  Otherwise the sets outside the largest class
  meet all chunks of the block; those of the largest class don't meet each other again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Rolling, Scratch, Words, few_tasks, free_name, join_counted, mix, remove_dir, slices

FREQUENT_SHARE = 1 / 400  #: of a task's documents
FREQUENT = 100_000  #: n-grams in the hint at most
CLASSES = 64
FINE_CLASSES = 1024  #: of the sketches that large blocks are cut by
GROUP_NODES = 1_000  #: nodes of one n-gram that one task compares
BLOCK_ITEMS = 2_000_000  #: n-grams of all sets that one task links
HEADS = 8  #: sets that stand for a class of a chunk when chunks are compared
BROADCAST_ROWS = 1_000_000  #: rows of two numbers that are broadcast at most; more are joined by a shuffle
HUB_ROWS = 250_000  #: rows of two numbers that each step of ``components`` broadcasts at most
TASK_TEXTS = 500  #: texts for which a task of its own is worth its start
FEW_ITEMS = 16_384  #: n-grams of the sets below a trie's node that are compared at once, without going down
TOGETHER = 256  #: sets that are compared at once at most
_TASK_ITEMS = 1_000_000
_TOP = np.uint64(1 << 63)

# --- sets -------------------------------------------------------------------------------------------------------------


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct n-grams of each text as sorted 63-bit hashes; a text with fewer words has its whole sequence as one."""
    words = Words(texts, lower=True)
    rolling = Rolling(words.hashes())
    grams = rolling.windows(n) & ~_TOP
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    whole = dict(zip(short.tolist(), mix(rolling.runs(words.first[short], words.first[short + 1]) + words.count[short].astype(np.uint64)) & ~_TOP, strict=True))
    out = []
    for i, (a, k) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=False)):
        out.append(np.unique(grams[a : a + k - n + 1]) if k >= n else np.array([whole[i]] if k else [], np.uint64))
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def most_different(a, b, percent: int):
    """The largest symmetric difference that two linked sets of these sizes can have."""
    return a + b - 2 * (-(-percent * (a + b) // (100 + percent)))


def sketch(grams: np.ndarray, classes: int) -> bytes:
    """How many of the n-grams fall into each class (a power of 2), 255 at most."""
    return np.minimum(np.bincount((grams & np.uint64(classes - 1)).astype(np.int64), minlength=classes), 255).astype(np.uint8).tobytes()


def frequent(rows: DataFrame, n: int) -> np.ndarray:
    """n-grams of many documents, sorted; the FREQUENT most frequent of those that some task saw in FREQUENT_SHARE of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(4, FREQUENT_SHARE * len(held))
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["gram", "n"])

        for _, texts in slices(batches):
            sets = gram_sets(texts, n)
            held += sets
            size += sum(map(len, sets))
            if size >= _TASK_ITEMS:
                yield report()
                held, size = [], 0
        if held:
            yield report()

    found = rows.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return np.sort(found.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").toArrow()["gram"].to_numpy()).view(np.uint64)


def _summaries(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, keys (its prefix) and sketch; empty sets have none of these."""
    hint = frequent(rows, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sizes, digests, prefixes, sketches = [], [], [], []
            for grams in gram_sets(texts, n):
                sizes.append(len(grams))
                if not len(grams):
                    digests.append(None)
                    prefixes.append(None)
                    sketches.append(None)
                    continue
                digests.append(set_digest(grams))
                key = grams
                if len(hint):
                    known = hint[np.minimum(np.searchsorted(hint, grams), len(hint) - 1)] == grams
                    key = np.concatenate((grams[~known], grams[known] | _TOP))
                prefixes.append(key[: prefix_size(len(key), percent)].view(np.int64))
                sketches.append(sketch(grams, CLASSES))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "n_shingles", "digest", "keys", "sketch"])

    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, keys array<bigint>, sketch binary")


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


# --- blocks -----------------------------------------------------------------------------------------------------------


def _groups(run: Scratch, nodes: DataFrame, total: int) -> tuple[DataFrame, int]:
    """group, node: nodes that share a key, and how many rows.  Of keys that the same nodes have, one makes a group."""
    items = nodes.select("node", F.explode("keys").alias("key"))
    held = items.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("these")).where("n > 1")
    keys, seen = run.measured(few_tasks(held.groupBy("these", "n").agg(F.min("key").alias("key")).select("key", "n"), total), "keys", total=F.sum("n"), most=F.max("n"))
    return run.write(few_tasks(join_counted(items, keys, "key", "n", **seen).select(F.col("key").alias("group"), "node"), seen["total"] or 0), "groups"), seen["total"] or 0


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which a partition is sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        begin = 0
        for stop in [*edges.tolist(), len(values)]:
            if held and held[-1].num_rows and values[begin] != held[-1].column(column)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            if stop > begin:
                held.append(batch.slice(begin, stop - begin))
            begin = stop
    if held:
        yield pa.Table.from_batches(held)


def _new(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """The rows that differ in ``columns`` from the row before, of a sorted partition."""
    last: list = [None] * len(columns)
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, c in enumerate(columns):
            values = batch.column(c).to_numpy(zero_copy_only=False)
            if len(values):
                keep[1:] |= values[1:] != values[:-1]
                keep[0] |= values[0] != last[k]
                last[k] = values[-1]
        yield batch if keep.all() else batch.filter(pa.array(keep))


class Sets:
    """Disjoint sets of 0, 1, 2, ..."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def find(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.above[max(i, j)] = min(i, j)


#: Tells which of some nodes (sizes, shapes) may be linked with one (size, shape).
Near = Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray]


def near_sketches(percent: int) -> Near:
    return lambda sizes, shapes, size, shape: np.abs(shapes.astype(np.int16) - shape.astype(np.int16)).sum(1) <= most_different(sizes, size, percent)


def plausible_edges(size: np.ndarray, shape: np.ndarray, percent: int, recent: int = 32, near: Near | None = None) -> list[tuple[int, int]]:
    """Pairs that connect all nodes of a group whose sizes and shapes (sketches, unless ``near`` says) allow a link.

    ``size`` is in ascending order.  Each node is compared with the smaller ones that its size allows, but of those that
    are connected with each other already only until one pair is found.
    """
    edges, low, near = [], 0, near or near_sketches(percent)
    root = np.arange(len(size))
    for i in range(1, len(size)):
        while percent * size[i] > 100 * size[low]:
            low += 1
        at = np.arange(low, i)
        for part in (at[-recent:], at[:-recent]):
            while len(part := part[root[part] != root[i]]):
                hit = part[near(size[part], shape[part], size[i], shape[i])]
                if not len(hit):
                    break
                edges.append((int(hit[-1]), i))
                old, new = max(root[hit[-1]], root[i]), min(root[hit[-1]], root[i])
                root[low : i + 1][root[low : i + 1] == old] = new
                part = hit[:-1]
    return edges


def components(edges: DataFrame, run: Scratch | None = None, rows: int | None = None) -> DataFrame:
    """node, root: the smallest node of each node's component, for all nodes in ``edges`` (columns a, b).

    Alternates the large-star and small-star steps; each is an aggregation and a join, and the edges are written to the
    shared folder after every round.  A hub's edges, however many, are not brought together: the least neighbours are
    broadcast up to HUB_ROWS, and beyond it see ``join_counted``.  ``rows`` is about how many edges there are, if known.
    """
    run = run or Scratch(edges.sparkSession, "components")
    mark = {"edges": F.count("*"), "digest": F.bit_xor(F.xxhash64("a", "b"))}

    def starred(pairs: DataFrame, least) -> DataFrame:
        """Each pair with the least neighbour m of its a."""
        hubs = few_tasks(pairs.groupBy("a").agg(least.alias("m"), F.count("*").alias("n")), size)
        if size <= HUB_ROWS:
            return pairs.join(F.broadcast(hubs.drop("n")), "a")
        hubs, seen = run.measured(hubs, "least", total=F.sum("n"), most=F.max("n"))
        return join_counted(pairs, hubs, "a", "n", **seen)

    old = []
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = run.measured(edges if rows is None else few_tasks(edges, rows), "edges", **mark)
    while True:
        begun = len(run.paths)
        size = 2 * (before["edges"] or 0)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = run.write(few_tasks(starred(both, F.least(F.min("b"), F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), size), "large-star")
        pairs = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = starred(large, F.min("b")).select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges, now = run.measured(few_tasks(small, size), "edges", **mark)
        for path in old:
            remove_dir(run.spark, path)
        old = run.paths[begun:]
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def box_edges(root: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all boxes of which members may be linked; boxes of one ``root`` are connected already.

    A box has the least and most n-grams of its members, and of each class of their sketches (``low``, ``high``).
    """
    edges: list[tuple[int, int]] = []
    _, at = np.unique(root, return_inverse=True)
    low, high = low.astype(np.int16), high.astype(np.int16)
    for i in range(1, len(at)):
        part = np.flatnonzero(at[:i] != at[i])
        part = part[percent * np.maximum(least[part], least[i]) <= 100 * np.minimum(most[part], most[i])]
        apart = np.maximum(np.maximum(low[part] - high[i], low[i] - high[part]), 0).sum(1)
        # the bound of most_different without its rounding, which isn't monotone in the sizes
        for j in part[(100 + percent) * apart <= (100 - percent) * (most[part] + most[i])].tolist():
            if at[j] != at[i]:
                edges.append((j, i))
                at[at == max(at[i], at[j])] = min(at[i], at[j])
    return edges


_BOX = "group bigint, root bigint, least bigint, most bigint, low binary, high binary"


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One box for each group and root of a batch, from the boxes in it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        group, root, least, most = (batch.column(c).to_numpy() for c in ("group", "root", "least", "most"))
        low, high = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(group), -1) for c in ("low", "high"))
        order = np.lexsort((root, group))
        group, root = group[order], root[order]
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (root[1:] != root[:-1])))
        low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
        numbers = [pa.array(x) for x in (group[first], root[first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first))]
        yield pa.RecordBatch.from_arrays([*numbers, *(pa.array([row.tobytes() for row in x], pa.binary()) for x in (low, high))], ["group", "root", "least", "most", "low", "high"])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])


def _plausible(run: Scratch, groups: DataFrame, rows: int, shapes: DataFrame, percent: int, near: Near | None = None, sketches: DataFrame | None = None) -> DataFrame:
    """node, root: nodes joined by plausible links.  ``groups`` has so many rows.

    ``shapes`` has node, n_shingles and shape; other nodes take no part.  ``near`` compares shapes; without it they are
    sketches.  ``sketches`` (node, sketch) is for boxes, which are always of sketches; without it they are the shapes.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in runs(batches, "task"):
            node = table["node"].to_pylist()
            if len(node) > 1:
                wide = np.frombuffer(b"".join(table["shape"].to_pylist()), np.uint8).reshape(len(node), -1)
                out += [(node[i], node[j]) for i, j in plausible_edges(table["n_shingles"].to_numpy(), wide, percent, near=near)]
            if len(out) > 100_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    def compare_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "task"):
            root = table["root"].to_numpy()
            low, high = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint8).reshape(len(root), -1) for c in ("low", "high"))
            found = box_edges(root, table["least"].to_numpy(), table["most"].to_numpy(), low, high, percent)
            yield _edges([(int(root[i]), int(root[j])) for i, j in found])

    large, seen = run.measured(few_tasks(groups.groupBy("group").agg(F.count("*").alias("nodes")).where(F.col("nodes") > GROUP_NODES), rows), "large-groups", rows=F.count("*"))
    dealt = groups.join(_few(large, seen["rows"] or 0), "group", "left")
    part = F.when(F.col("nodes").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("nodes") * 2 / GROUP_NODES)))
    members = dealt.withColumn("task", F.when(part == 0, F.col("group")).otherwise(F.xxhash64("group", part))).join(shapes, "node")
    compared = few_tasks(members.select("task", "node", "n_shingles", "shape").repartition("task").sortWithinPartitions("task", "n_shingles", "node"), rows)
    found = components(compared.mapInArrow(compare, "a bigint, b bigint"), run, rows)
    if not seen["rows"]:
        return found
    found = run.write(few_tasks(found, rows), "parts")
    named = members.where("nodes IS NOT NULL").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.withColumn("sketch", F.col("shape")) if sketches is None else named.join(sketches, "node")
    boxes = named.select("group", "root", F.col("n_shingles").alias("least"), F.col("n_shingles").alias("most"), F.col("sketch").alias("low"), F.col("sketch").alias("high"))
    boxes = few_tasks(boxes, rows).mapInArrow(_boxes, _BOX).repartition("group", "root").sortWithinPartitions("group", "root")
    boxes = run.write(few_tasks(boxes, rows).mapInArrow(_boxes, _BOX), "boxes")
    sizes = boxes.groupBy("group").agg(F.count("*").alias("boxes"), F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other")
    parts = sizes.select("group", F.when(F.col("boxes") > GROUP_NODES, F.ceil(F.col("boxes") * 2 / GROUP_NODES)).otherwise(1).cast("int").alias("parts"))
    dealt = boxes.join(_few(parts), "group")
    mine = F.pmod(F.xxhash64("root", "least"), F.col("parts")).cast("int")
    tasks = dealt.select(*boxes.columns, F.explode(_pairs(mine, F.col("parts"))).alias("pair")).withColumn("task", F.xxhash64("group", "pair.i", "pair.j"))
    across = few_tasks(tasks.drop("group", "pair").repartition("task").sortWithinPartitions("task", "most", "root"), rows).mapInArrow(compare_boxes, "a bigint, b bigint")
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across), run, rows)


def _pairs(mine, parts):
    """The pairs (i, j) of parts that a row of part ``mine`` belongs to."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))


def _blocks(run: Scratch, rows: DataFrame, nodes: DataFrame, total: int, n: int, percent: int, near: Near | None) -> tuple[DataFrame, int]:
    """node, root: nodes that may be linked, with their block, and how many; ``nodes`` are ``total`` at most."""
    groups, held = _groups(run, nodes, total)
    count = {"rows": F.count("*")}
    sketches = nodes.select("node", "sketch")
    shapes = nodes.select("node", "n_shingles", "shape") if near else nodes.select("node", "n_shingles", F.col("sketch").alias("shape"))
    blocks, seen = run.measured(few_tasks(_plausible(run, groups, held, shapes, percent, near, sketches if near else None), min(held, total)), "blocks", **count)
    size = seen["rows"] or 0
    sized = blocks.join(nodes.select("node", "n_shingles", "key"), "node")
    large, seen = run.measured(few_tasks(sized.groupBy("root").agg(F.sum("n_shingles").alias("size")).where(F.col("size") > BLOCK_ITEMS).select("root"), size), "too-large", **count)
    if not seen["rows"]:
        return blocks, size
    large = _few(large, seen["rows"])
    again = sized.join(large, "root", "left_semi")

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n_shingles"), pa.array([sketch(g, FINE_CLASSES) for g in gram_sets(texts, n)], pa.binary())], ["node", "n_shingles", "shape"])

    texts = _texts(rows, again.select("key", "node", "n_shingles"), size)
    finer = run.write(texts.select("node", "n_shingles", "text").mapInArrow(fine, "node bigint, n_shingles bigint, shape binary").dropDuplicates(["node"]), "sketches")
    blocks, seen = run.measured(blocks.join(large, "root", "left_anti").select("node", "root").unionByName(_plausible(run, groups, held, finer, percent)), "blocks", **count)
    return blocks, seen["rows"] or 0


# --- trie -------------------------------------------------------------------------------------------------------------


class _Node:
    __slots__ = ("part", "below", "least", "most", "ends", "some", "one", "few", "items")

    def __init__(self, part: np.ndarray):
        self.part = part  # ranks on the edge into this node
        self.below: dict[int, _Node] = {}
        self.least, self.most = 1 << 60, 0  # sizes of the sets below
        self.ends: list[int] = []  # sets that end here
        self.some = -1  # one set below
        self.one = True  # whether all sets below were linked when the last came
        self.few: list[int] | None = []  # all sets below, if it is one or they have FEW_ITEMS at most
        self.items = 0  # n-grams of those


class Trie:
    """Sets of ranks (ascending arrays) that are linked as they come."""

    def __init__(self, sets: Sets, n_ranks: int, percent: int):
        self.sets, self.percent = sets, percent
        self.root = _Node(np.zeros(0, np.int32))
        self.mask = np.zeros(n_ranks, bool)
        self.held: dict[int, np.ndarray] = {}  # the sets in the trie
        self.visited = 0  # nodes gone through one by one

    def link(self, item: int, ranks: np.ndarray) -> None:
        """Links ``item`` with the sets in the trie that reach the threshold."""
        sets, mask, percent, n = self.sets, self.mask, self.percent, len(ranks)
        mask[ranks] = True
        few = [node for node in self.root.below.values() if node.few is not None]
        stack = [(node, 0, 0) for node in self.root.below.values() if node.few is None]
        while stack:
            node, overlap, depth = stack.pop()
            if node.one and sets.find(node.some) == sets.find(item):
                continue
            self.visited += 1
            overlap += int(np.count_nonzero(mask[node.part]))
            depth += len(node.part)
            passed = int(ranks.searchsorted(node.part[-1], "right")) - overlap  # n-grams of the item that no set below has
            missed = depth - overlap
            size = min(max(n - passed + missed, node.least), node.most)
            common = min(size - missed, n - passed)
            if 100 * common < percent * (n + size - common):
                continue
            for other in node.ends:
                if 100 * overlap >= percent * (n + depth - overlap):
                    sets.join(item, other)
            few += [child for child in node.below.values() if child.few is not None]
            stack += [(child, overlap, depth) for child in node.below.values() if child.few is None]
        others = [i for node in few if percent * node.least <= 100 * n and percent * n <= 100 * node.most for i in node.few]
        for k in range(0, len(others), TOGETHER):
            self._compare(item, n, others[k : k + TOGETHER])
        mask[ranks] = False

    def _compare(self, item: int, n: int, others: list[int]) -> None:
        """Links ``item``, a set of n that the mask holds, with those of some sets that reach the threshold."""
        find = self.sets.find
        own = find(item)
        parts = [(i, self.held[i]) for i in others if find(i) != own]
        if not parts:
            return
        size = np.array([len(p) for _, p in parts])
        overlap = np.add.reduceat(self.mask[np.concatenate([p for _, p in parts])], np.cumsum(size) - size, dtype=np.int64)
        for k in np.flatnonzero(100 * overlap >= self.percent * (n + size - overlap)).tolist():
            self.sets.join(item, parts[k][0])

    def add(self, item: int, ranks: np.ndarray) -> None:
        node, at, n = self.root, 0, len(ranks)
        self.held[item] = ranks
        while True:
            self._note(node, item, n)
            if at == n:
                node.ends.append(item)
                return
            child = node.below.get(int(ranks[at]))
            if child is None:
                child = _Node(ranks[at:])
                node.below[int(ranks[at])] = child
                self._note(child, item, n)
                child.ends.append(item)
                return
            k = min(len(child.part), n - at)
            differ = np.flatnonzero(child.part[:k] != ranks[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(child.part):
                middle = _Node(child.part[:same])
                middle.least, middle.most, middle.some, middle.one = child.least, child.most, child.some, child.one
                middle.few, middle.items = child.few and list(child.few), child.items
                child.part = child.part[same:]
                middle.below[int(child.part[0])] = child
                node.below[int(ranks[at])] = middle
                child = middle
            node, at = child, at + same

    def _note(self, node: _Node, item: int, n: int) -> None:
        node.least, node.most = min(node.least, n), max(node.most, n)
        if node.few is not None:
            node.few.append(item)
            node.items += n
            if node.items > FEW_ITEMS and len(node.few) > 1:
                node.few = None
        if node.some < 0:
            node.some = item
        node.one = node.one and self.sets.find(node.some) == self.sets.find(item)


def link_sets(grams: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[int]:
    """For each set the smallest index of a set that it is linked with, directly or through others.

    Sets with the same number in ``known`` are known to be linked.
    """
    flat = np.concatenate(grams)
    _, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int32)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    ranks, at = rank[which], 0
    sets = Sets(len(grams))
    first: dict[int, int] = {}
    for i, name in enumerate(known or []):
        sets.join(first.setdefault(name, i), i)
    trie = Trie(sets, len(count), percent)
    for i, g in enumerate(grams):
        mine = np.sort(ranks[at : at + len(g)])
        at += len(g)
        trie.link(i, mine)
        trie.add(i, mine)
    return [sets.find(i) for i in range(len(grams))]


# --- join -------------------------------------------------------------------------------------------------------------


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows without the repeats of a doc_id and text, so that a row repeated very often is read, but not shuffled."""
    seen: set[tuple[int | None, int]] = set()
    for batch in batches:
        keep = []
        for key in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _key(doc_id, text_hash):
    """What tells documents apart, also those without or with the same doc_id; without one they come last."""
    doc_id = doc_id.cast("bigint")
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("d"), text_hash.alias("h"))


def _few(small: DataFrame, most: int = BROADCAST_ROWS + 1) -> DataFrame:
    """``small``, marked for broadcast if it has at most BROADCAST_ROWS rows; otherwise Spark joins by a shuffle.

    Where ``most``, which it has at most, doesn't tell, its rows are counted, which runs its plan once more.
    """
    return F.broadcast(small) if most <= BROADCAST_ROWS or small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def _texts(rows: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """``wanted`` (with a column key, ``most`` rows at most) and the text of the document with that key, which stands for its node."""
    return rows.select(_key(F.col("doc_id"), F.col("text_hash")).alias("key"), "text").join(_few(wanted, most), "key")


def links(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and first of each document.

    The set of a document is that of its distinct n-word shingles, lower-cased in A-Z; with fewer words, the whole
    sequence as one; without words or with a null text it is empty and linked with nothing.  component_id is the smallest
    doc_id of the documents reachable by links (a document with an empty set has its own).  Rows with a null doc_id are
    linked like others and get the smallest doc_id that isn't null, if there is one.  ``first`` is true for the component's
    first document, that with the smallest doc_id (null last) and among those the smallest text_hash, and for empty sets.
    Repeated rows are linked with each other; columns other than doc_id and text aren't read.  An empty table gives none.
    """
    run, rows = Scratch(docs.sparkSession, "links"), _rows(docs)
    return linked_documents(run, rows, run.write(_summaries(rows, n, percent), "summaries"), n, percent)


def linked_documents(run: Scratch, rows: DataFrame, all_: DataFrame, n: int, percent: int, near: Near | None = None) -> DataFrame:
    """``links`` from summaries: doc_id, text_hash, n_shingles, digest, keys, sketch, and shape where ``near`` compares it.

    Linked sets must share a key.  Sets are verified as wholes, so keys and ``near`` decide only what is compared.
    """
    once = ["n_shingles", "keys", "sketch", *(["shape"] if near else [])]
    total = all_.count()
    if not few_tasks(all_.groupBy("doc_id", "text_hash").count().where("count > 1"), total).isEmpty():
        rows = rows.mapInArrow(_first_of_each, "doc_id bigint, text_hash bigint, text string")
    nodes = all_.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("copies"), F.min(_key(F.col("doc_id"), F.col("text_hash"))).alias("key"), *(F.first(c).alias(c) for c in once))
    nodes, copies = run.measured(few_tasks(nodes, total).withColumn("node", F.monotonically_increasing_id()), "nodes", total=F.sum("copies"), most=F.max("copies"))
    blocks, size = _blocks(run, rows, nodes, total, n, percent, near)
    linked = _linked(run, rows, nodes, blocks, size, n, percent)
    named = run.write(few_tasks(nodes.join(linked, "node", "left").select("digest", "copies", "key", F.coalesce("root", "node").alias("root")), total), "named")
    first, sizes = run.measured(few_tasks(named.groupBy("root").agg(F.min("key").alias("least"), F.count("*").alias("n")), total), "first", total=F.sum("n"), most=F.max("n"))
    found = run.write(few_tasks(join_counted(named, first, "root", "n", **sizes).select("digest", "copies", "least"), total), "components")
    joined = join_counted(all_.select("doc_id", "text_hash", "n_shingles", "digest"), found, "digest", "copies", "left", **copies)
    own = F.col("least").isNull()
    component = F.when(own, F.col("doc_id")).when(~F.col("least.none"), F.col("least.d"))
    is_first = own | (F.col("least") == _key(F.col("doc_id"), F.col("text_hash")))
    return run.finish(few_tasks(joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), is_first.alias("first")), total))


def _tries(dealt: DataFrame, size: int, n: int, percent: int) -> DataFrame:
    """a, b, head: each node with the first that it is linked with in its task, by tries; ``dealt`` has about so many rows.

    ``dealt`` has task, node, root (nodes of one root are known to be linked) and text.  HEADS nodes of a class are heads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(_new(batches, "task", "node"), "task"):
            node = table["node"].to_pylist()
            if len(node) > 1:
                grams = [g for batch in table.to_batches() for _, texts in slices([batch]) for g in gram_sets(texts, n)]
                first = link_sets(grams, percent, table["root"].to_pylist())
                total, seen, head = np.bincount(first), [0] * len(node), []
                for r in first:
                    head.append(bool(total[r] > 1 and seen[r] < HEADS))
                    seen[r] += 1
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([node[r] for r in first], pa.int64()), pa.array(head, pa.bool_())], ["a", "b", "head"])

    return few_tasks(dealt.select("task", "node", "root", "text").repartition("task").sortWithinPartitions("task", "node"), size, TASK_TEXTS).mapInArrow(run, "a bigint, b bigint, head boolean")


def _chunks(size):
    return F.when(size > BLOCK_ITEMS, F.ceil(size * 2 / BLOCK_ITEMS)).otherwise(1).cast("int")


def _chunk(chunks):
    return F.pmod(F.xxhash64("node"), chunks).cast("int")


def _linked(run: Scratch, rows: DataFrame, nodes: DataFrame, blocks: DataFrame, size: int, n: int, percent: int) -> DataFrame:
    """node, root for the nodes of all blocks, so many, by tries over their texts."""
    sized = blocks.withColumnRenamed("root", "block").join(nodes.select("node", "key", "n_shingles"), "node")
    large = sized.groupBy("block").agg(F.sum("n_shingles").alias("size")).where(F.col("size") > BLOCK_ITEMS).select("block", _chunks(F.col("size")).alias("chunks"))
    split, seen = run.measured(few_tasks(large, size), "large-blocks", rows=F.count("*"))
    placed = sized.join(_few(split, seen["rows"] or 0), "block", "left")
    texts = _texts(rows, placed.select("node", F.col("node").alias("root"), "key", F.xxhash64("block", _chunk(F.coalesce("chunks", F.lit(1)))).alias("task")), size)
    found = run.write(_tries(texts, size, n, percent), "links")
    if not seen["rows"]:
        return found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    # a few sets of each class, over the chunks of a block
    placed = placed.where("chunks IS NOT NULL").drop("chunks")
    heads = run.write(placed.join(found.where("head").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "node"), "heads")
    dealt = heads.join(_few(heads.groupBy("block").agg(_chunks(F.sum("n_shingles")).alias("chunks")), seen["rows"]), "block")
    texts = _texts(rows, dealt.select("node", "root", "key", F.xxhash64("block", _chunk(F.col("chunks"))).alias("task")), size)
    joined = run.write(few_tasks(components(found.select("a", "b").unionByName(_tries(texts, size, n, percent).select("a", "b")), run, size), size), "joined")
    # sets outside the largest class of a block meet all of it
    named = placed.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("block", "root").agg(F.sum("n_shingles").alias("size"))
    largest = classes.groupBy("block").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("size"), F.sum("size").alias("total"), F.count("*").alias("classes")).where("classes > 1")
    largest = run.write(largest.select("block", "main", _chunks(F.col("size")).alias("chunks"), _chunks(F.col("total") - F.col("size")).alias("others")), "largest")
    if largest.isEmpty():
        return joined
    open_ = named.join(_few(largest, seen["rows"]), "block")
    upto = lambda parts: F.sequence(F.lit(0), parts - 1)
    task = lambda i, j, others: F.struct(i.alias("i"), j.alias("j"), F.lit(others).alias("others"))
    main = F.transform(upto(F.col("others")), lambda j: task(_chunk(F.col("chunks")), j, False))
    mine = _chunk(F.col("others"))
    other = F.concat(F.transform(upto(F.col("chunks")), lambda i: task(i, mine, False)), F.transform(_pairs(mine, F.col("others")), lambda p: task(p["i"], p["j"], True)))
    texts = _texts(rows, open_.select("node", "root", "key", "block", F.when(F.col("root") == F.col("main"), main).otherwise(other).alias("tasks")), size)
    dealt = texts.select("node", "root", "text", "block", F.explode("tasks").alias("at")).withColumn("task", F.xxhash64("block", "at.i", "at.j", "at.others"))
    edges = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(edges.unionByName(_tries(dealt, size, n, percent).select("a", "b")), run, size)


def kept(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of linked ones: that with the smallest doc_id, null last.

    Of documents with that same doc_id (or none) and unlike texts it is that with the smallest hash of its text.  Documents
    with an empty set all stay.  Of rows with one doc_id (or none) and one text, one stays.
    """
    return first_documents(docs, links(docs, n, percent))


def first_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` (of ``links``) names first; of those with one doc_id and text, one."""
    found = found.where("n_shingles > 0")
    name = free_name(docs.columns, "key")
    key = _key(F.col("doc_id"), F.col("text_hash")).alias(name)
    gone = found.where("NOT first").select(key).distinct()
    again = found.groupBy(key).count().where("count > 1").select(name)
    mine = _key(docs["doc_id"], F.xxhash64(docs["text"].cast("string")))
    left = docs.join(_few(gone), mine == F.col(name), "left_anti")
    if again.isEmpty():
        return left
    again = _few(again)
    once = left.join(again, mine == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, mine == F.col(name), "left_anti").unionByName(once)


#: The links of 3-word shingles at 90 per cent in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
