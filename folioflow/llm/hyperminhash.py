"""MinHash near-duplicates by HyperMinHash registers of one byte.

1. The n-gram hashes of a document are dealt over REGISTERS buckets by their first bits.  Of each bucket's smallest hash a
   register keeps how many zeros it leads with and the MANTISSA bits after the first one: a floating-point minimum in one
   byte.  Empty registers borrow from others in a fixed order of their own.
2. BAND registers in a row are a key; sets that share a key are candidates.  At the threshold of 0.8 two sets share none of
   their 32 keys with a probability of 5e-8, and less above.  Sets of fewer than SMALL n-grams, whose registers hold few
   different minima, also have the n-grams of their prefix as keys, by which no link is lost.
3. Unlike minima may fall into one register.  How often depends on the sets' sizes; the estimate of the similarity from equal
   registers is corrected for it, and candidates whose estimate is six standard deviations below the threshold fall out.
4. What is left is verified on full sets by the tries of ``jaccard``, which also deals very large keys and groups over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm import jaccard
from folioflow.llm.common import Scratch, mix, slices

REGISTERS = 128  #: a power of 2
MANTISSA = 4  #: bits; with 4 bits of leading zeros a register is a byte
BAND = 4
SMALL = 80  #: sets with fewer n-grams have their prefix as keys, too
DEVIATIONS = 6

_BITS = 63  #: of an n-gram's hash
_REST = _BITS - (REGISTERS.bit_length() - 1)
_ORDER = np.array([np.random.default_rng(i).permutation(REGISTERS) for i in range(REGISTERS)])  #: where an empty register borrows


def compress(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum of _REST bits: leading zeros, 15 at most, and the bits after the first one."""
    top = (least >> np.uint64(_REST - 53)).astype(np.float64)  # exact: 53 bits
    zeros = np.minimum(53 - np.frexp(top)[1], 15)
    after = (least << (zeros + 1).astype(np.uint64)) & np.uint64((1 << _REST) - 1)
    return ((zeros << MANTISSA) | (after >> np.uint64(_REST - MANTISSA)).astype(np.int64)).astype(np.uint8)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS bytes for each set, which is not empty and sorted."""
    size = np.array([len(s) for s in sets], np.int64)
    if not len(sets):
        return np.zeros((0, REGISTERS), np.uint8)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    place = owner * REGISTERS + (flat >> np.uint64(_REST)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))  # sorted, so the bucket's smallest
    out, full = np.zeros(len(sets) * REGISTERS, np.uint8), np.zeros(len(sets) * REGISTERS, bool)
    out[place[first]] = compress(flat[first] & np.uint64((1 << _REST) - 1))
    full[place[first]] = True
    todo, filled = np.flatnonzero(~full), out.copy()
    for turn in range(REGISTERS):
        if not len(todo):
            break
        lender = todo // REGISTERS * REGISTERS + _ORDER[todo % REGISTERS, turn]
        ready = full[lender]
        filled[todo[ready]] = out[lender[ready]]
        todo = todo[~ready]
    return filled.reshape(-1, REGISTERS)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """The keys of each row's bands."""
    words = np.ascontiguousarray(rows).view("<u4").reshape(len(rows), -1).astype(np.uint64)
    band = np.arange(words.shape[1], dtype=np.uint64)
    return mix(words | (band + np.uint64(1)) << np.uint64(32))


def collision(a, b):
    """How probable it is that unlike minima of sets of these sizes fall into one register.

    A minimum of n hashes has about the density n * exp(-n * x).  A register of z leading zeros is 2**-(z + 1 + MANTISSA)
    wide, so both fall into it with that width times the integral of the densities' product; summed over all z, as an
    integral over the logarithm, that is a * b / (a + b)**2 / (2 * ln 2) / 2**MANTISSA.
    """
    return a * b / (a + b) ** 2 / (2 * np.log(2)) / 2**MANTISSA


def estimate(equal, a, b):
    """The similarity of sets of sizes a and b with so many equal registers."""
    c = collision(a, b)
    return (equal / REGISTERS - c) / (1 - c)


def near_registers(percent: int) -> jaccard.Near:
    p = percent / 100
    least = p - DEVIATIONS * np.sqrt(p * (1 - p) / REGISTERS)

    def near(sizes: np.ndarray, shapes: np.ndarray, size: int, shape: np.ndarray) -> np.ndarray:
        return estimate((shapes == shape).sum(1), sizes.astype(np.float64), float(size)) >= least

    return near


def _summaries(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """What ``jaccard.linked_documents`` takes; shapes are registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sets = jaccard.gram_sets(texts, n)
            some = [s for s in sets if len(s)]
            shapes = registers(some)
            found = iter(zip(some, shapes, band_keys(shapes).view(np.int64), strict=True))
            out: list[tuple] = []
            for s in sets:
                if not len(s):
                    out.append((0, None, None, None, None))
                    continue
                _, shape, keys = next(found)
                if len(s) < SMALL:
                    keys = np.concatenate((keys, mix(s[: jaccard.prefix_size(len(s), percent)]).view(np.int64)))
                out.append((len(s), jaccard.set_digest(s), keys, jaccard.sketch(s, jaccard.CLASSES), shape.tobytes()))
            size, digest, keys, sketch, shape = zip(*out, strict=True)
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(shape, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "keys", "sketch", "shape"])

    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, keys array<bigint>, sketch binary, shape binary")


def links(docs: DataFrame, n: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and first of each document, as ``jaccard.links`` defines them.

    Links are confirmed on full sets; one between sets of SMALL n-grams or more is missed with a probability of 5e-8 at
    a similarity of 0.8.  ``percent`` under 60 would need more bands.
    """
    run, rows = Scratch(docs.sparkSession, "hyperminhash"), jaccard._rows(docs)
    return jaccard.linked_documents(run, rows, run.write(_summaries(rows, n, percent), "summaries"), n, percent, near_registers(percent))


def kept(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of linked ones, as ``jaccard.kept``."""
    return jaccard.first_documents(docs, links(docs, n, percent))


#: The links of 4-word shingles at 80 per cent in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""
