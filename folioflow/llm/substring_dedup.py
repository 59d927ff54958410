"""Removal of repeated passages: windows of K words that also start earlier in the corpus.

Super-k-mer partitioning.  The minimiser of a window is the smallest hash of the M-word runs in it.  Consecutive windows
of a document with one minimiser travel as one string of words to the bucket that the minimiser names, so equal windows
meet there; about half of them share each word's transport.  A bucket sorts its windows by a 64-bit hash, compares the
words of equal hashes byte by byte, and reports every window that is not the first of its kind.

Buckets are kept even.  A map task sends each distinct string once, with its first place; it knows that the other places
are repeated, and deals its reports on them over all buckets, whatever the words.  Windows of a minimiser that holds more than HOT_SHARE of all strings (a passage in a third of all
documents, with other words around it each time) travel one by one, dealt by the hash of the window itself; a first pass
over the corpus finds those minimisers, at most 2 / LEAST_SHARE of them; with the corpus the share falls, so that the
rest of a bucket stays at HOT_BUCKETS times its size, down to LEAST_SHARE.  A task packs what it sends to a bucket into
compressed rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import NULL_ID, Rolling, Words, gather, id_column, mix, same_bytes, slices

K = 20
M = 3
HOT_SHARE = 1 / 2000
LEAST_SHARE = 1 / 100_000
HOT_BUCKETS = 16
BUCKET_BYTES = 2 << 20  #: of corpus text for each bucket
CHUNK_BYTES = 24 << 20  #: of text that a map task packs at a time
_CHUNK_ITEMS = 4_000_000
_REPORTS = 512  #: that a packed row takes along, unless a task has more for each of its buckets

_ROW = "doc_id bigint, text_hash int, text string"
_RUNS = "doc_id bigint, text_hash int, start int, n int"


class Strings:
    """The super-k-mers of some texts: ``begin`` word, number of ``windows`` and ``minimiser`` of each."""

    def __init__(self, texts: list[bytes], k: int, m: int):
        self.words = Words(texts).joined()
        n = len(self.words.start)
        self.text = np.repeat(np.arange(len(texts)), self.words.count)
        self.rolling = Rolling(self.words.hashes())
        size = n - k + 1
        if size <= 0:
            self.begin = self.windows = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.uint64)
            return
        low = sliding_min(self.rolling.windows(m), k - m + 1)
        valid = self.text[:size] == self.text[k - 1 :]
        change = valid.copy()
        change[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | change[1:]
        self.begin = np.flatnonzero(change)
        self.windows = np.flatnonzero(stop) + 1 - self.begin
        self.minimiser = low[self.begin]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def hot_minimisers(rows: DataFrame, k: int = K, m: int = M, share: float = HOT_SHARE) -> np.ndarray:
    """Minimisers of more than about ``share`` of all super-k-mers, sorted; at most 2 / share of them.

    Each task reports those that hold the share among its own strings, which any minimiser with the share overall does
    in some task, and the sums are compared with half the share of all strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def report() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            total = int(counts.sum())
            keep = counts >= max(2, share * total)
            return pa.RecordBatch.from_arrays([pa.array([*_signed(values[keep]).tolist(), None], pa.int64()), pa.array([*counts[keep].tolist(), total], pa.int64())], ["minimiser", "n"])

        for _, texts in slices(batches):
            held.append(Strings(texts, k, m).minimiser)
            if sum(map(len, held)) >= _CHUNK_ITEMS:
                yield report()
                held = []
        if held:
            yield report()

    found = rows.mapInArrow(run, "minimiser bigint, n bigint").groupBy("minimiser").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.col("minimiser").isNotNull(), F.desc("n"), "minimiser").limit(int(2 / share) + 1).collect()
    total = top[0]["n"] if top else 0
    return np.sort(np.array([r["minimiser"] for r in top[1:] if r["n"] >= share / 2 * total], np.int64).view(np.uint64))


def _pack(columns: list[np.ndarray], text: np.ndarray, others: list[np.ndarray], coder: zstandard.ZstdCompressor) -> bytes:
    head = np.array([len(columns[0]), len(others[0]), len(text)], "<i8")
    return coder.compress(b"".join([head.tobytes(), *(c.tobytes() for c in columns), *(o.tobytes() for o in others), text.tobytes()]))


_TYPES = ("<i8", "<i4", "<i4", "<i4", "<i4")  # doc, text hash, first window, windows, bytes
_OTHER = ("<i8", "<i4", "<i4", "<i4")  # doc, text hash, first window, windows


def _unpack(raw: bytes) -> tuple[list[np.ndarray], list[np.ndarray], bytes]:
    n, o, size = np.frombuffer(raw, "<i8", 3).tolist()
    at, out = 24, []
    for types, count in ((_TYPES, n), (_OTHER, o)):
        out.append([])
        for t in types:
            out[-1].append(np.frombuffer(raw, t, count, at))
            at += out[-1][-1].nbytes
    return out[0], out[1], raw[at : at + size]


class _Packer:
    """Collects the super-k-mers of a map task's slices and packs them by bucket."""

    def __init__(self, k: int, m: int, buckets: int, hot: np.ndarray):
        self.k, self.m, self.buckets, self.hot = k, m, np.uint64(buckets), hot
        self.turn = 0
        self.coder = zstandard.ZstdCompressor(level=1)
        self.clear()

    def clear(self) -> None:
        self.buffers: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, texts: list[bytes], doc: np.ndarray, text_hash: np.ndarray) -> None:
        s = Strings(texts, self.k, self.m)
        w, begin, windows = s.words, s.begin, s.windows
        bucket = mix(s.minimiser) % self.buckets
        if len(self.hot) and len(begin):
            at = np.minimum(np.searchsorted(self.hot, s.minimiser), len(self.hot) - 1)
            alone = self.hot[at] == s.minimiser
            if alone.any():
                times = np.where(alone, windows, 1)
                offset = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                begin, alone = np.repeat(begin, times) + offset, np.repeat(alone, times)
                windows, bucket = np.where(alone, 1, np.repeat(windows, times)), np.repeat(bucket, times)
                bucket[alone] = mix(s.rolling.runs(begin[alone], begin[alone] + self.k)) % self.buckets
        stop = begin + windows - 1 + self.k
        text = s.text[begin]
        first, last = w.start[begin], w.end[stop - 1]
        self.parts.append((s.rolling.runs(begin, stop), doc[text], begin - w.first[text], text_hash[text], windows, first + self.size, last - first, bucket))
        self.buffers.append(w.buf)
        self.size += len(w.buf)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        buf = np.concatenate(self.buffers)
        key, doc, start, text_hash, windows, at, size, bucket = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.clear()
        order = np.lexsort((start, doc, key))
        key, doc, start, text_hash, windows, at, size, bucket = (x[order] for x in (key, doc, start, text_hash, windows, at, size, bucket))
        if not len(key):
            return
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        twin = np.flatnonzero(~new & (size == size[head]))
        twin = twin[same_bytes(buf, at[twin], at[head[twin]], size[twin])] if len(twin) else twin
        same_place = (doc[twin] == doc[head[twin]]) & (start[twin] == start[head[twin]])
        later = np.zeros(len(key), bool)
        later[twin[~same_place]] = True  # equal words at a later place
        drop = later.copy()
        drop[twin[same_place & (text_hash[twin] == text_hash[head[twin]])]] = True  # the very same row again
        kept, gone = np.flatnonzero(~drop), np.flatnonzero(later)
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        names, first = np.unique(bucket[kept], return_index=True)
        first = np.append(first, len(kept))
        gone = gone[np.lexsort((start[gone], doc[gone]))]
        shares = min(len(names), -(-len(gone) // _REPORTS))
        taker = (np.arange(shares) * len(names) // max(shares, 1) + self.turn) % len(names)
        self.turn += 1
        reports = dict(zip(taker.tolist(), np.array_split(gone, max(shares, 1)), strict=False))
        blobs = []
        for i in range(len(names)):
            x, y = kept[first[i] : first[i + 1]], reports.get(i, gone[:0])
            columns = [v[x].astype(t) for v, t in zip((doc, text_hash, start, windows, size), _TYPES, strict=True)]
            others = [v[y].astype(t) for v, t in zip((doc, text_hash, start, windows), _OTHER, strict=True)]
            blobs.append(_pack(columns, gather(buf, at[x], size[x] + 1), others, self.coder))  # a space after each string
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def repeated_runs(blobs: list[bytes], k: int = K) -> list[np.ndarray]:
    """From a bucket's packed strings: doc, text hash, first window and number of windows of each repeated run."""
    open_ = zstandard.ZstdDecompressor()
    parts = [_unpack(open_.decompress(b)) for b in blobs]
    doc, text_hash, start, windows, size = (np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True))
    others = [np.concatenate(x) for x in zip(*(p[1] for p in parts), strict=True)]
    raw = b"".join([p[2] for p in parts])
    words = Words([raw])
    # string of each word, from the strings' places
    place = np.cumsum(size.astype(np.int64) + 1)
    string = np.searchsorted(place, words.start, side="right")
    n = len(words.start) - k + 1
    key = Rolling(words.hashes()).windows(k)
    valid = np.flatnonzero(string[:n] == string[k - 1 :])
    key, string = key[valid], string[valid]
    first = np.searchsorted(string, np.arange(len(size)))
    at = start[string] + np.arange(len(valid)) - first[string]
    d = doc[string]
    order = np.lexsort((at, d, key))
    ks = key[order]
    new = np.ones(len(ks), bool)
    new[1:] = ks[1:] != ks[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(ks)), 0))
    more = np.flatnonzero(~new)
    mine, its = order[more], order[head[more]]
    a, b = words.start[valid[mine]], words.start[valid[its]]
    length, other = words.end[valid[mine] + k - 1] - a, words.end[valid[its] + k - 1] - b
    equal = length == other
    equal[equal] = same_bytes(words.buf, a[equal], b[equal], length[equal])
    late = (d[mine] > d[its]) | (d[mine] == d[its]) & (at[mine] > at[its])
    repeated = np.zeros(len(valid), bool)
    repeated[mine[equal & late]] = True
    if not equal.all():  # different words with one hash: judged by the words themselves
        for h in np.unique(ks[more[~equal]]).tolist():
            seen: dict[bytes, tuple[int, int]] = {}
            for i in order[np.searchsorted(ks, h) : np.searchsorted(ks, h, side="right")].tolist():
                content = words.buf[words.start[valid[i]] : words.end[valid[i] + k - 1]].tobytes()
                repeated[i] = seen.setdefault(content, (d[i], at[i])) < (d[i], at[i])
    hit = np.flatnonzero(repeated)
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (hit[1:] != hit[:-1] + 1) | (string[hit[1:]] != string[hit[:-1]])
    begin = np.flatnonzero(fresh)
    runs = [d[hit[begin]], text_hash[string[hit[begin]]], at[hit[begin]], np.diff(np.append(begin, len(hit)))]
    return [np.concatenate((x, y)) for x, y in zip(runs, others, strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.hash(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))


def repeated(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id (NULL_ID for null), text_hash, start and n: runs of windows that aren't the first of their kind."""
    rows = _keyed(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    hot = hot_minimisers(rows, k, m, min(HOT_SHARE, max(LEAST_SHARE, HOT_BUCKETS / buckets)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(k, m, buckets, hot)
        for part, texts in slices(batches):
            packer.add(texts, part.column("doc_id").to_numpy(), part.column("text_hash").to_numpy())
            if packer.size >= CHUNK_BYTES:
                yield from packer.rows()
        yield from packer.rows()

    def judge(table: pa.Table) -> pa.Table:
        doc, text_hash, start, n = repeated_runs(table["blob"].to_pylist(), k)
        return pa.table([pa.array(doc, pa.int64()), pa.array(text_hash, pa.int32()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "text_hash", "start", "n"])

    return rows.mapInArrow(cut, "bucket bigint, blob binary").groupBy("bucket").applyInArrow(judge, _RUNS)


def _kept(texts: list[bytes], runs: list[list[dict] | None], k: int) -> Iterator[tuple[int, int, bytes]]:
    words = Words(texts).joined()
    buf = words.buf.tobytes()
    for i, found in enumerate(runs):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        n = hi - lo
        if not found:
            yield n, 0, buf[words.start[lo] : words.end[hi - 1]] if n else b""
            continue
        step = np.zeros(n + 1, np.int64)
        begin = np.array([r["start"] for r in found])
        np.add.at(step, begin, 1)
        np.add.at(step, begin + np.array([r["n"] for r in found]) - 1 + k, -1)
        keep = np.concatenate(([False], np.cumsum(step[:-1]) == 0, [False]))
        edge = np.flatnonzero(keep[1:] != keep[:-1]) + lo
        pieces = [buf[words.start[a] : words.end[b - 1]] for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]
        yield n, n - int(keep.sum()), b" ".join(pieces)


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (or their sha256, with ``digest``).

    A word goes if some window of ``k`` words that covers it also starts earlier: in a document with a smaller doc_id,
    or earlier in the same one.  Windows are judged on the input.  A null text has no words; a null doc_id is smaller
    than all others.  Of rows with one doc_id, equal places are no earlier than each other, so equal rows keep the same
    words.  Other columns are not read.
    """
    runs = repeated(docs, k, m).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = _keyed(docs).join(runs.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            n, removed, kept = zip(*_kept(texts, part.column("runs").to_pylist(), k), strict=True)
            last = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([id_column(part.column("doc_id").to_numpy()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), last], ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return joined.mapInArrow(finish, f"doc_id bigint, n_words bigint, n_removed bigint, {'kept_sha256' if digest else 'kept'} string")


#: The same in DuckDB's SQL.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM win),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE rn > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
         FROM words LEFT JOIN cov ON cov.doc_id = words.doc_id AND cov.p = words.p WHERE cov.p IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
