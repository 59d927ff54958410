"""Benchmark passages in documents, found by counting shared q-grams in diagonal bands.

Texts are lower-cased and their white space is collapsed.  Each benchmark item is cut into overlapping segments of
SEGMENT characters (a shorter item is one segment).  A segment occurs in a document if some stretch of it is within
``budget`` edits, EDIT_SHARE of the segment's length.  By the q-gram lemma such a stretch shares at least
``length - Q + 1 - budget * Q`` q-grams with the segment, all of them on diagonals (place in the document less place in
the segment) that differ by the budget at most.  Shared q-grams are therefore counted in overlapping bands of diagonals,
bands below the bound are dropped, and the rest is verified by an alignment inside the band.  Nothing within the budget
is lost.

The benchmark is a stated set of queries: it is read in blocks of bounded size, and each block is sent to all executors,
where one pass over the documents meets it.  No step shuffles documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import NULL_ID, free_name, id_column, materialise, mix

Q = 12
SEGMENT = 80
EDIT_SHARE = 0.05
STRIDE = 20  #: an excerpt of SEGMENT + STRIDE - 1 characters (99) holds a whole segment
PIECE = 2_000_000  #: places of shared q-grams that are counted at once
BLOCK_CHARS = 4 << 20  #: characters of benchmark text in one block
SLICE_CHARS = 1 << 20

_GAP = SEGMENT  # separators between texts, more than any budget, so that no stretch spans two of them


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(values: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each run of q characters."""
    n = len(values) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    part, size, out, done = values.astype(np.uint64), 1, None, 0
    while True:  # runs of 1, 2, 4, ... characters, joined as q's bits ask for
        if q & size:
            out = part[:n] if out is None else out * np.uint64(pow(base, size, 2**64)) + part[done : done + n]
            done += size
        if size * 2 > q:
            return mix(out)
        part = part[:-size] * np.uint64(pow(base, size, 2**64)) + part[size:]
        size *= 2


class Queries:
    """Segments of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]]):
        self.length, self.budget, texts = [], [], []
        known: dict[str, list[int]] = {}  # equal segments are one, with the items that hold it
        for item, text in items:
            value = normalise(text)
            if not value:
                continue
            starts = [0] if len(value) <= SEGMENT else sorted({*range(0, len(value) - SEGMENT, STRIDE), len(value) - SEGMENT})
            for s in starts:
                part = value[s : s + SEGMENT]
                if part in known:
                    known[part].append(item)
                    continue
                known[part] = [item]
                texts.append(codes(part))
                self.length.append(len(part))
                self.budget.append(int(EDIT_SHARE * len(part)))
        self.length, self.budget = (np.array(x, np.int64) for x in (self.length, self.budget))
        held = np.array([len(x) for x in known.values()], np.int64)
        self.items = np.array([i for x in known.values() for i in x], np.int64)
        self.items_from = np.cumsum(held) - held
        self.n_items = held
        self.least = self.length - Q + 1 - self.budget * Q
        while (low := (self.least < 1) & (self.budget > 0)).any():  # short segments: as many edits as the lemma can tell
            self.budget[low] -= 1
            self.least = self.length - Q + 1 - self.budget * Q
        self.text = np.zeros((len(texts), SEGMENT), np.uint32)
        for i, t in enumerate(texts):
            self.text[i, : len(t)] = t
        self.tiny = [(i, "".join(map(chr, texts[i]))) for i in np.flatnonzero(self.least < 1)]  # shorter than a q-gram
        hashes = [grams(t) for t in texts]
        sizes = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        segment = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(flat, kind="stable")
        self.segment, self.place = segment[order], place[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        bits = max(16, min(26, int(np.ceil(np.log2(max(len(self.keys), 1)))) + 5))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.keys >> self.shift] = True

    def matches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text number, segment, edits, and start and end in the normalised text, of each segment that occurs."""
        clean = [normalise(t) for t in texts]
        gap = "\0" * _GAP
        value = codes(gap + gap.join(clean) + gap + gap)
        begins = np.cumsum([_GAP] + [len(t) + _GAP for t in clean])
        h = grams(value)
        at = np.flatnonzero(self.maybe[h >> self.shift]) if len(self.keys) else np.zeros(0, np.int64)
        key = np.searchsorted(self.keys, h[at])
        hit = (key < len(self.keys)) & (self.keys[np.minimum(key, len(self.keys) - 1)] == h[at]) if len(at) else np.zeros(0, bool)
        at, key = at[hit], key[hit]
        times = self.first[key + 1] - self.first[key]
        counted: tuple[list, list] = ([], [])
        ends = np.cumsum(times)
        for begin, stop in _pieces(ends):
            some = times[begin:stop]
            entry = np.repeat(self.first[key[begin:stop]] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
            segment, diagonal = self.segment[entry], np.repeat(at[begin:stop], some) - self.place[entry]
            width = self.budget[segment] + 1
            for shift in (0, 1):  # bands of twice the width, each beginning where the one before is half over
                counted[shift].append(np.unique(segment * (1 << 40) + (diagonal + shift * width) // (2 * width), return_counts=True))
        found = []
        for shift, parts in enumerate(counted):
            pair, of = np.unique(np.concatenate([p for p, _ in parts] or [np.zeros(0, np.int64)]), return_inverse=True)
            count = np.bincount(of, np.concatenate([c for _, c in parts] or [np.zeros(0, np.int64)]), len(pair))
            s, b = pair >> 40, pair & ((1 << 40) - 1)
            keep = count >= self.least[s]
            s, b = s[keep], b[keep]
            w = self.budget[s] + 1
            found.append(np.stack((s, b * 2 * w - shift * w)))
        s, low = np.concatenate(found, 1)
        edits, begin, end = self._align(value, s, low)
        good = edits <= self.budget[s]
        s, edits, begin, end = s[good], edits[good], begin[good], end[good]
        text = np.searchsorted(begins, begin, side="right") - 1
        rows = [text, s, edits, begin - begins[text], end - begins[text]]
        for i, needle in self.tiny:
            for k, t in enumerate(clean):
                p = t.find(needle)
                if p >= 0:
                    rows = [np.append(r, v) for r, v in zip(rows, (k, i, 0, p, p + len(needle)), strict=True)]
        return tuple(rows)

    def _align(self, value: np.ndarray, segment: np.ndarray, low: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fewest edits between each segment and a stretch of the text on the band's diagonals, and that stretch."""
        out = [np.zeros(len(segment), np.int64) for _ in range(3)]
        for k in range(0, len(segment), chunk):
            s, d = segment[k : k + chunk], low[k : k + chunk]
            half = int(self.budget[s].max(initial=0)) + 1
            span = 2 * half + 2  # diagonals, one spare on each side
            step = np.arange(span)
            cost = np.zeros((len(s), span), np.int64)
            origin = np.broadcast_to(d[:, None] - 1 + step, cost.shape).copy()
            best, begin, end = np.full(len(s), 1 << 30), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            for j in range(int(self.length[s].max(initial=0))):
                live = j < self.length[s]
                place = np.clip(d[:, None] - 1 + step + j, 0, len(value) - 1)
                change = cost + (value[place] != self.text[s, j][:, None])
                skip = np.full_like(cost, 1 << 20)
                skip[:, :-1] = cost[:, 1:] + 1
                came = origin.copy()
                came[:, :-1] = np.where(skip[:, :-1] < change[:, :-1], origin[:, 1:], origin[:, :-1])
                now = np.minimum(change, skip)
                # further characters of the text: one more edit for each diagonal to the left that a path comes from
                scaled = (now - step) * span * 2 + step
                source = np.minimum.accumulate(scaled, 1) % (span * 2)
                new = np.take_along_axis(now, source, 1) + step - source
                came = np.take_along_axis(came, source, 1)
                cost, origin = np.where(live[:, None], new, cost), np.where(live[:, None], came, origin)
            pick = cost.argmin(1)
            rows = np.arange(len(s))
            best, begin = cost[rows, pick], origin[rows, pick]
            end = d - 1 + pick + self.length[s]
            for o, v in zip(out, (best, begin, end), strict=True):
                o[k : k + chunk] = v
        return tuple(out)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters; only one block is on the driver at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        held.append((NULL_ID if row[0] is None else row[0], row[1] or ""))
        size += len(held[-1][1])
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


SCHEMA = "doc_id bigint, item_id bigint, n_segments int, edits int, start bigint, end bigint"


def _pieces(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sums, of which ``ends`` are the running totals, are about PIECE."""
    begin, done = 0, 0
    while begin < len(ends):
        stop = max(begin + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        yield begin, stop
        begin, done = stop, int(ends[stop - 1])


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows with about SLICE_CHARS characters."""
    begin = size = 0
    for stop in range(1, len(texts) + 1):
        size += len(texts[stop - 1] or "")
        if size >= SLICE_CHARS or stop == len(texts):
            yield begin, stop
            begin, size = stop, 0


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item of which at least one segment occurs in it.

    doc_id, item_id, the number of the item's segments found, the fewest edits of one, and the stretch from the first to
    the last of them in the normalised text (characters, end exclusive).  Null and blank texts match nothing; a null id
    stays null; each of several equal rows or items gives its own row; other columns are not read.  The blocks of the
    benchmark are taken one after the other.

    An excerpt of an item is found for certain from SEGMENT + STRIDE - 1 characters on, verbatim in the normalised text;
    shorter ones are found where they hold a segment, and items shorter than SEGMENT as wholes.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [rows.sparkSession.createDataFrame([], SCHEMA)]
    for items in _blocks(benchmark):
        found.append(materialise(_pass(rows, items), "passages"))
    return reduce(DataFrame.unionByName, found)


def _pass(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    numbers = [i for i, _ in items]
    shared = rows.sparkSession.sparkContext.broadcast([(n, t) for n, (_, t) in enumerate(items)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, stop in _runs(texts):
                text, segment, edits, a, b = queries.matches([t or "" for t in texts[begin:stop]])
                if not len(text):
                    continue
                times = queries.n_items[segment]
                entry = np.repeat(queries.items_from[segment] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
                text, segment, edits, a, b = (np.repeat(x, times) for x in (text, segment, edits, a, b))
                pair, of = np.unique(np.stack((text, queries.items[entry])), axis=1, return_inverse=True)
                of = of.ravel()
                n = pair.shape[1]
                seen = np.bincount(np.unique(np.stack((of, entry)), axis=1)[0], minlength=n)
                least, first, last = np.full(n, 1 << 30), np.full(n, 1 << 60), np.zeros(n, np.int64)
                np.minimum.at(least, of, edits)
                np.minimum.at(first, of, a)
                np.maximum.at(last, of, b)
                ids = batch.column("doc_id").slice(begin, stop - begin).take(pa.array(pair[0]))
                yield pa.RecordBatch.from_arrays([ids, id_column([numbers[i] for i in pair[1]]), pa.array(seen, pa.int32()), pa.array(least, pa.int32()), pa.array(first), pa.array(last)], ["doc_id", "item_id", "n_segments", "edits", "start", "end"])

    return rows.mapInArrow(run, SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage, whatever their doc_id; all columns stay as they are.

    With one block of the benchmark rows are judged where they are read, and nothing is joined or shuffled.  With more,
    each block's pass writes only which rows it rejects (doc_id and a hash of the text), and those are taken out at the end.
    """
    blocks = _blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return _without(docs, first)
    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    bad = reduce(DataFrame.unionByName, [materialise(_without(rows, items, False).select("doc_id", "h"), "rejected") for items in chain([first, second], blocks)]).distinct()
    d, h = free_name(docs.columns, "d"), free_name(docs.columns, "h")
    bad = bad.select(F.col("doc_id").alias(d), F.col("h").alias(h))
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left_anti")


def _without(docs: DataFrame, items: list[tuple[int, str]], keep: bool = True) -> DataFrame:
    """The rows without a passage of the items, or those with one."""
    shared = docs.sparkSession.sparkContext.broadcast([(n, t) for n, (_, t) in enumerate(items)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(shared.value)
        for batch in batches:
            texts = batch.column("text").cast(pa.string()).to_pylist()
            clean = np.ones(len(texts), bool)
            for begin, stop in _runs(texts):
                clean[begin + queries.matches([t or "" for t in texts[begin:stop]])[0]] = False
            yield batch.filter(pa.array(clean == keep))

    return docs.mapInArrow(run, docs.schema)
