"""Importance resampling towards a target distribution, by hashed word runs.

Each document's features are its runs of 1 to ``order`` words, hashed into ``buckets``.  A bucket's gain is the logarithm of
how much likelier it is in the target than in the documents; a document weighs the mean gain of its features.  Documents are
drawn without replacement by adding Gumbel noise, a function of the seed and the doc_id, to the weight and taking the highest.

Long texts don't hold up a task.  A text of more than CHUNK_BYTES is split at word boundaries into chunks of about that size,
which are dealt over all tasks.  A chunk carries the next ``order - 1`` words, but owns only the runs that start in its own
words, so every run is counted once.  The steps:

1. Chunks and whole short texts become rows of words, features and bucket numbers, written once; nothing is tokenised again.
2. Each task counts its buckets; the counts' sums, one row a bucket, set the table of gains.
3. Each row's gains are summed; the chunks of a document are added up by document.
4. Scores are integers in a range that the gains and the noise bound, so one count by score tells the lowest score that can
   be drawn.  Only rows from there on are sorted, and numbered by distributed prefix sums.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Scratch, Words, free_name, gather, slices
from folioflow.operators.numbering import numbered

CHUNK_BYTES = 256 << 10
_LONG = 64  #: bytes from which a feature is hashed by itself

_APART = np.ones(256, bool)
_APART[0x30:0x3A] = _APART[0x61:0x7B] = _APART[0x80:] = False

_BAG = "doc_id bigint, text_hash bigint, chunk int, n_words bigint, n_features bigint, features binary"


def _crc_table() -> np.ndarray:
    """The checksum's step for each byte, by its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_STEP = _crc_table()


def crc32_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each byte range."""
    out = np.zeros(len(start), np.uint32)
    length = end - start
    for i in np.flatnonzero(length > _LONG):
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    todo = np.flatnonzero(length <= _LONG)
    todo = todo[np.argsort(-length[todo], kind="stable")]
    at, left = start[todo], length[todo]
    value = np.full(len(todo), 0xFFFFFFFF, np.uint32)
    alive = len(todo)
    for k in range(int(left[0]) if alive else 0):
        alive = int(np.searchsorted(-left, -k, "left"))  # those longer than k
        now = value[:alive]
        value[:alive] = _STEP[(now ^ buf[at[:alive] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[todo] = ~value
    return out


def cut(text: bytes, order: int, limit: int) -> list[tuple[int, bytes]]:
    """Chunks of a text at word boundaries: how many words each owns, and its text with the ``order - 1`` words after them."""
    words = Words([text], lower=True, apart=_APART)
    total = len(words.start)
    if not total:
        return [(0, b"")]
    raw = words.buf.tobytes()
    # a chunk begins with the first word of each stretch of ``limit`` bytes
    begins = np.flatnonzero(np.diff(words.start // limit, prepend=-1))
    stops = np.append(begins[1:], total)
    return [(b - a, raw[words.start[a] : words.end[min(b + order - 1, total) - 1]]) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]


def features(texts: list[bytes], owned: list[int | None], order: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its own words and the buckets of its features; ``owned`` is None for a whole text."""
    words = Words(texts, lower=True, apart=_APART)
    if order > 1:
        words = words.joined()
    total = words.count
    own = np.array([t if o is None else o for t, o in zip(total.tolist(), owned, strict=True)], np.int64)
    text = np.repeat(np.arange(len(texts)), total)
    place = np.arange(len(text)) - np.repeat(words.first[:-1], total)
    starts, stops, owner = [], [], []
    for k in range(order):
        begin = np.flatnonzero((place < own[text]) & (place + k < total[text]))
        starts.append(words.start[begin])
        stops.append(words.end[begin + k])
        owner.append(text[begin])
    found = crc32_ranges(words.buf, np.concatenate(starts), np.concatenate(stops)) % np.uint32(buckets)
    owner = np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[by], np.arange(len(texts) + 1))
    found = found[by]
    for i, n in enumerate(own.tolist()):
        yield n, found[first[i] : first[i + 1]]


def _wide(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def _bags(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    kind = _wide(buckets)
    for part, texts in slices(batches):
        found = list(features(texts, part.column("n_words").to_pylist(), order, buckets))
        columns = [part.column("doc_id"), part.column("text_hash"), part.column("chunk"), pa.array([n for n, _ in found], pa.int64()), pa.array([len(f) for _, f in found], pa.int64()), pa.array([f.astype(kind).tobytes() for _, f in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "chunk", "n_words", "n_features", "features"])


def _chunks(batches: Iterator[pa.RecordBatch], order: int, limit: int) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        for i, text in enumerate(texts):
            pieces = cut(text, order, limit)
            row = part.slice(i, 1)
            for begin in range(0, len(pieces), 64):
                some = pieces[begin : begin + 64]
                same = pa.array([0] * len(some))
                columns = [row.column("doc_id").take(same), row.column("text_hash").take(same), pa.array(range(begin, begin + len(some)), pa.int32()), pa.array([n for n, _ in some], pa.int64()), pa.array([t for _, t in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "chunk", "n_words", "text"])


def bags(docs: DataFrame, order: int = 1, buckets: int = 10_000, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each short text and each chunk of a long one: its words, features and their buckets.

    ``chunk`` is null for a whole text, otherwise the chunk's number; n_words and n_features count what the chunk owns.
    A null text has none.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("bigint").alias("n_words"), text.cast("binary").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    dealt = rows.where(long).mapInArrow(partial(_chunks, order=order, limit=chunk_bytes), "doc_id bigint, text_hash bigint, chunk int, n_words bigint, text binary")
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    make = partial(_bags, order=order, buckets=buckets)
    return rows.where(~long).mapInArrow(make, _BAG).unionByName(dealt.mapInArrow(make, _BAG))


def bucket_counts(bags: DataFrame, buckets: int) -> np.ndarray:
    """How many features are in each bucket; a row a bucket comes to the driver."""
    kind = _wide(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("features").to_pylist()), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in bags.select("features").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the two smoothed shares) for each bucket."""
    b, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _sums(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = _wide(len(table))
    for batch in batches:
        flat = table[np.frombuffer(b"".join(batch.column("features").to_pylist()), kind)]
        stop = np.cumsum(batch.column("n_features").to_numpy(zero_copy_only=False))
        total = np.concatenate(([0], np.cumsum(flat)))[np.concatenate(([0], stop)).astype(np.int64)]
        columns = [batch.column(c) for c in ("doc_id", "text_hash", "chunk", "n_words", "n_features")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(total).astype(np.int64))], ["doc_id", "text_hash", "chunk", "n_words", "n_features", "total"])


def scores(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, percent: int = 10, seed: int = 2024, min_words: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score and rank of each row of ``docs``.

    Of the rows with ``min_words`` words or more, ``percent`` of a hundred (rounded down) are drawn and have a rank from 1;
    the others' rank is null.  Ties go to the smaller doc_id, null last; repeated rows are rows of their own, and tie.  A
    row without features (a null or empty text, one of signs alone) weighs 0.  The noise of a null doc_id is that of an
    empty one.  Empty tables give no rows; an empty ``target`` counts as one without words.  Other columns aren't read.
    """
    run = Scratch(docs.sparkSession, "resampling")
    held = run.write(bags(docs, order, buckets, chunk_bytes), "bags")
    wanted = run.write(bags(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), order, buckets, chunk_bytes), "target")
    table = gains(bucket_counts(held, buckets), bucket_counts(wanted, buckets))
    sums = held.mapInArrow(partial(_sums, table=table), "doc_id bigint, text_hash bigint, chunk int, n_words bigint, n_features bigint, total bigint")
    whole = sums.where("chunk IS NULL").drop("chunk")
    copies = F.count_if(F.col("chunk") == 0)  # each copy of a repeated row brings its own chunks
    added = sums.where("chunk IS NOT NULL").groupBy("doc_id", "text_hash").agg(copies.alias("copies"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "total")))
    added = added.select("doc_id", "text_hash", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "total")), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
    mean = F.expr("CASE WHEN n_features = 0 THEN 0 ELSE (total - pmod(total, n_features)) div n_features END")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = run.write(whole.unionByName(added).select("doc_id", "text_hash", "n_words", "n_features", mean.alias("weight"), (mean + noise).cast("bigint").alias("score")), "scored")
    return run.finish(_drawn(scored, percent, min_words))


def _drawn(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    may = F.col("n_words") >= min_words
    # scores lie between the least and largest gain plus noise: some ten thousand values
    by_score = sorted(((r["score"], r["n"]) for r in scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in by_score) // 100
    lowest, so_far = None, 0
    for score, n in by_score:
        if so_far < draw:
            lowest, so_far = score, so_far + n
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    in_reach = may & (F.col("score") >= lowest)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.col("n_features"), F.col("text_hash")]
    ranked = numbered(scored.where(in_reach), order, "rank", spread=True)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return scored.where(~in_reach).withColumn("rank", F.lit(None).cast("bigint")).unionByName(ranked)


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are drawn, whole and with all their columns; ``settings`` as in ``scores``.

    Rows with one doc_id (or none) and one text are drawn as often as their ranks say.
    """
    found = scores(docs, target, **settings).where("rank IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count("*").alias("drawn"))
    d, h, n, copy = (free_name(docs.columns, c) for c in ("d", "h", "drawn", "copy"))
    found = found.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("drawn").alias(n))
    mine = docs["doc_id"].cast("bigint").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"].cast("string")) == F.col(h))
    once = docs.join(found.where(f"{n} = 1"), mine, "left_semi")
    again = docs.join(found.where(f"{n} > 1"), mine)
    if again.isEmpty():
        return once
    # of rows drawn twice or more (always repeats of one row), as many as were drawn; of those drawn once, one
    more = again.dropDuplicates(["doc_id", "text"]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
    return once.unionByName(more)


#: The same in DuckDB's SQL; the checksum goes byte by byte over a table made from the polynomial.
SQL = r"""
WITH t0 AS (SELECT unnest(range(0, 256)) AS b),
ct AS MATERIALIZED (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS ct FROM t0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
gw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM g) GROUP BY ALL),
hx AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM gw)),
cs AS MATERIALIZED (
    SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x) + 1, 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)), lambda c, b: xor(c >> 8, ct[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
    FROM hx, ct),
sb AS (SELECT b, sum(n) AS n FROM dw JOIN cs USING (w) GROUP BY b),
tb AS (SELECT b, sum(n) AS n FROM gw JOIN cs USING (w) GROUP BY b),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM sb)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM tb)::DOUBLE AS t),
gain AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(tb.n, 0)::DOUBLE + 1) * (s + 10000) / ((sb.n::DOUBLE + 1) * (t + 10000))))::BIGINT AS gain FROM sb LEFT JOIN tb USING (b), tot),
wt AS (SELECT r, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN cs USING (w) JOIN gain USING (b) GROUP BY r),
hh AS (SELECT r, doc_id, len(ws) AS n_words, (list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[i]) - 1), lambda a, c: a * 16 + c))::DOUBLE AS h FROM d),
sc AS (SELECT r, doc_id, n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM hh LEFT JOIN wt USING (r)),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN rank <= (SELECT count(*) FROM rk) * 10 // 100 THEN rank END::BIGINT AS rank
FROM sc LEFT JOIN rk USING (r)
"""
