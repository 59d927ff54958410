"""Helpers shared by the corpus operators: shared scratch space, byte-level words and their hashes.

Text is handled as the UTF-8 bytes of one slice of documents joined by single spaces, so numpy works on whole slices
instead of on Python strings.  A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; those bytes never
occur inside a multi-byte UTF-8 sequence, so byte runs and code-point runs are the same words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.scratch import Scratch, free_name, materialise, remove_dir, shared_dir, stored  # noqa: F401

NULL_ID = -(2**63)  #: stands for a null doc_id inside numpy code; sorts before every other id
SLICE_BYTES = 2 << 20  #: bytes of text that one numpy pass handles, or one document if that is longer

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG = 512  #: bytes from which a word is hashed by itself


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts Arrow batches into runs of rows with about ``limit`` bytes of text; a null text counts as empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        begin = size = 0
        for i, text in enumerate(texts):
            if i > begin and size + len(text) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(text)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def ids(column: pa.Array) -> np.ndarray:
    """An integer id column as int64, with NULL_ID for null."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_column(values: np.ndarray) -> pa.Array:
    values = np.asarray(values, np.int64)
    return pa.array(values, pa.int64(), mask=values == NULL_ID)


class Words:
    """The words of some texts: ``buf`` padded bytes, ``start`` and ``end`` of each word, ``first[i]:first[i+1]`` those of text i."""

    def __init__(self, texts: list[bytes], lower: bool = False, apart: np.ndarray = _SPACE):
        """``apart``: for each byte, whether it parts words; a space must."""
        self.apart = apart
        raw = b" ".join(texts)
        if lower:
            raw = raw.lower()  # bytes.lower() maps A-Z only
        self.buf = np.frombuffer(raw + b" " * 9, np.uint8)
        live = ~apart[self.buf]
        edge = np.flatnonzero(live[1:] != live[:-1]) + 1
        if live[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begins)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.buf, self.start, self.end)

    def joined(self) -> "Words":
        """The same words with exactly one space after each."""
        length = self.end - self.start
        keep = ~self.apart[self.buf[:-8]]
        keep[self.end[self.end < len(keep)]] = True
        buf = self.buf[:-8][keep]
        out = object.__new__(Words)
        out.end = np.cumsum(length + 1) - 1
        out.start = out.end - length
        buf = buf.copy()
        buf[out.end] = 0x20
        out.buf = np.concatenate((buf, np.full(9, 0x20, np.uint8)))
        out.first, out.count, out.apart = self.first, self.count, self.apart
        return out


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ``buf`` is padded by 8 bytes at least."""
    eight = np.ndarray((max(len(buf) - 7, 0),), "<u8", buf, strides=(1,))
    length = end - start
    out = (length.astype(np.uint64) + np.uint64(1)) * _STEP
    if not len(start):
        return out
    todo, at = np.arange(len(start)), start
    whole = length > _LONG
    for i in np.flatnonzero(whole):
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    if whole.any():
        todo = todo[~whole]
        at = start[todo]
    left = length[todo]
    while len(todo):
        part = eight[at] & _MASK[np.minimum(left, 8)]
        out[todo] = mix(out[todo] ^ part * _M2)
        more = left > 8
        if not more.any():
            break
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


_R = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)[:n]


class Rolling:
    """Hashes of runs of consecutive words from the words' hashes, by a polynomial modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(_R, n), out=self.sums[1:])
        self.back = _powers(_R_INV, n + 1)

    def runs(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[begin]) * self.back[begin])

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Whether ``buf[a:a+length]`` equals ``buf[b:b+length]``, for arrays of ranges; ``length`` is at least 1."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), chunk):
        x, y, n = a[k : k + chunk], b[k : k + chunk], length[k : k + chunk]
        begin = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[k : k + chunk] = np.logical_and.reduceat(buf[np.repeat(x, n) + step] == buf[np.repeat(y, n) + step], begin)
    return out


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after the other."""
    begin = np.cumsum(length) - length
    return buf[np.repeat(start - begin, length) + np.arange(int(length.sum()))]


#: A key is hot if it has more rows than a shuffle partition would get, divided by this, and more than HOT_ROWS.
HOT_SHARE = 4
HOT_ROWS = 100


TASK_ROWS = 10_000  #: rows for which a task of its own is worth its start


def few_tasks(df: DataFrame, rows: int, size: int = TASK_ROWS) -> DataFrame:
    """``df``, which has about so many rows, in no more tasks than these are worth; each reads several shuffle partitions.

    As many tasks as cores stay, and with more rows than ``size`` for each shuffle partition nothing changes.
    """
    spark = df.sparkSession
    tasks = max(1, spark.sparkContext.defaultParallelism, -(-rows // size))
    return df.coalesce(tasks) if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def join_counted(many: DataFrame, one: DataFrame, on: str | list[str], count: str, how: str = "inner", total: int | None = None, most: int | None = None) -> DataFrame:
    """``many`` joined with ``one``, which has each value of ``on`` once and in ``count`` how many rows of ``many`` have it.

    ``total`` and ``most`` are the sum and the largest of the counts, or a bound of it.  Rows of hot keys stay where they are and get a
    broadcast of ``one``'s hot rows, of which there are at most HOT_SHARE for each shuffle partition, whatever the size of
    the data; the rest is joined by a shuffle or as Spark chooses.  Both are read twice if there are hot keys, so they
    should be stored tables.  ``how`` is inner or left; ``count`` is dropped.
    """
    partitions = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = max(HOT_ROWS, (total or 0) // (HOT_SHARE * partitions))
    if (most or 0) <= bound:
        return many.join(one.drop(count), on, how)
    hot = F.broadcast(one.where(F.col(count) > bound).drop(count))
    return many.join(hot, on).unionByName(many.join(F.broadcast(hot.select(*([on] if isinstance(on, str) else on))), on, "left_anti").join(one.drop(count), on, how))
