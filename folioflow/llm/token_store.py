"""Token ids of a corpus in files of entropy-coded blocks.

Format.  A dataset is a folder with two Parquet tables.

* ``table``: one row with the tokenizer's vocabulary size and the shared frequency table, as little-endian unsigned
  32-bit integers that sum to 2**PRECISION.
* ``blocks``: a row for each block of whole documents: ``part`` and ``block`` (order), ``start`` (ids of all documents
  before the block), ``doc_ids`` (int64), ``lengths`` (uint32), ``payload`` (uint32 words), ``lanes``, ``states``
  (uint64), ``marks`` and ``ids_crc32``, ``payload_crc32``.

A block is coded by a static range asymmetric numeral system.  Its ids are dealt in turn to ``lanes`` interleaved coders,
which share one stream of 32-bit words, so that each numpy step codes one id of every lane.  ``states`` holds the coders'
states at the block's beginning and at every STEPS-th step, and ``marks`` the place in the stream at those steps: a
reader can begin at any of these checkpoints.  Blocks depend on nothing but the frequency table.

Spark writes and commits both tables, so a lost executor or a repeated task leaves no partial file behind.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import NULL_ID, Words, gather, id_column, ids, materialise, same_bytes, shared_dir, slices

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
PRECISION = 20
BLOCK_IDS = 1 << 17  #: a block ends with the document that brings it to so many ids
LANES = 512
STEPS = 128  #: steps between checkpoints
PART_BYTES = 128 << 20  #: of text in a range of doc_id, about, at most
LEAST_PART_BYTES = 2 << 20  #: of text in a range of doc_id, about, at least
CACHED = 300_000  #: runs between spaces, and words, that a Python worker remembers from of late, and as many from before
ENCODE_BYTES = 4 << 20  #: of text that is taken together

#: how the pre-tokenizer cuts a normalised text; fixed by the tokenizer's file
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: WORDS always cuts a run between an ASCII letter (1) and an ASCII sign (2 or 3), but not after an apostrophe (3)
_KIND = np.array([1 if chr(b).isascii() and chr(b).isalpha() else 3 if b == 0x27 else 2 if 0x20 < b < 0x7F and not chr(b).isalnum() else 0 for b in range(256)], np.uint8)
_CUT = np.zeros(16, bool)
_CUT[[1 * 4 + 2, 1 * 4 + 3, 2 * 4 + 1]] = True

_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_P = np.uint64(PRECISION)

# --- numeral system ---------------------------------------------------------------------------------------------------


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 for every id that occurs."""
    total, goal = int(counts.sum()), 1 << PRECISION
    out = np.zeros(len(counts), np.int64)
    if not total:
        out[0] = goal
        return out.astype(np.uint32)
    seen = counts > 0
    out[seen] = np.maximum(1, counts[seen] * (goal / total)).astype(np.int64)
    left = goal - int(out.sum())
    order = np.argsort(-out, kind="stable")
    while left:  # over or under: the largest give or take, in proportion
        part = out[order]
        room = part - 1 if left < 0 else part
        move = np.minimum(np.ceil(room * (abs(left) / max(room.sum(), 1))).astype(np.int64), room)
        move = np.where(np.cumsum(move) <= abs(left), move, np.maximum(0, abs(left) - (np.cumsum(move) - move)))
        out[order] += move if left > 0 else -move
        left = goal - int(out.sum())
    return out.astype(np.uint32)


class Coder:
    """Encodes and decodes arrays of ids under one frequency table."""

    def __init__(self, freqs: np.ndarray):
        if int(freqs.sum()) != 1 << PRECISION:
            raise ValueError("frequencies must sum to 2**PRECISION")
        self.freq = freqs.astype(np.uint64)
        self.base = np.cumsum(self.freq) - self.freq
        self.limit = ((_LOW >> _P) << _32) * self.freq
        self.symbol = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs)

    def encode(self, values: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """payload, lanes, states (checkpoints, lanes), marks (checkpoints)."""
        n = len(values)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        x = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []
        states, emitted = [], []
        sent = 0
        freq, base, limit = self.freq, self.base, self.limit
        for t in range(steps - 1, -1, -1):
            ids_ = values[t * lanes : (t + 1) * lanes]
            m = len(ids_)
            f, state = freq[ids_], x[:m]
            over = state >= limit[ids_]
            words.append((state[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            sent += len(words[-1])
            state = np.where(over, state >> _32, state)
            q = state // f
            x[:m] = (q << _P) + (state - q * f) + base[ids_]
            if t % STEPS == 0:
                states.append(x.copy())
                emitted.append(sent)
        payload = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        if not states:
            states, emitted = [x], [0]
        return payload, lanes, np.array(states[::-1]), sent - np.array(emitted[::-1], np.int64)

    def decode(self, payload: np.ndarray, lanes: int, states: np.ndarray, marks: np.ndarray, n: int, checkpoint: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from a checkpoint up to another (or to the end); ``n`` is the block's number of ids."""
        steps = -(-n // lanes)
        first, last = checkpoint * STEPS, steps if stop is None else min(steps, stop * STEPS)
        x, at = states[checkpoint].copy(), int(marks[checkpoint])
        out = np.empty((max(last - first, 0), lanes), np.uint32)
        freq, base, symbol, mask = self.freq, self.base, self.symbol, np.uint64((1 << PRECISION) - 1)
        for t in range(first, last):
            m = min(lanes, n - t * lanes)
            state = x[:m]
            slot = state & mask
            s = symbol[slot]
            out[t - first, :m] = s
            state = freq[s] * (state >> _P) + slot - base[s]
            low = np.flatnonzero(state < _LOW)
            if len(low):
                state[low] = (state[low] << _32) | payload[at : at + len(low)]
                at += len(low)
            x[:m] = state
        return out.ravel()[: max(0, min(n, last * lanes) - first * lanes)]


# --- tokenizer --------------------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte in a byte-level model: itself where it prints, else 256, 257 and so on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in prints]
    return {b: 256 + k for k, b in enumerate(rest)}


class Memory:
    """Two generations of a cache: when the young one is full it becomes the old one, and what is used is taken over."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.young[key] = value
        return value


class WordEncoder:
    """Ids of texts (UTF-8) by the tokenizers library, remembered for each run of bytes between spaces.

    A tokenizer that cuts by WORDS drops white space and never joins across it, so a text's ids are those of its runs.
    numpy finds the distinct runs of many texts, cut between ASCII letters and signs.  A new run of ASCII and Latin-1 letters is lower-cased and cut by WORDS
    here, and each new word goes to the library's model; other new runs go through the library as they are.  Whole texts go
    there where they hold an added token, such as ``<|endoftext|>``, and where the tokenizer is of another make.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        made = json.loads(self.library.to_str())
        tokens = made["added_tokens"]
        self.known_make = WORDS in json.dumps(made["pre_tokenizer"], ensure_ascii=False) and [n.get("type") for n in made["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
            self.known_make = False  # such tokens are not found by their content alone
        self.added = re.compile(b"|".join(re.escape(t["content"].encode()) for t in tokens) or rb"(?!)")
        self.runs, self.words = Memory(), Memory()
        self.plain = re.compile("[\n!-~À-ÖØ-öø-ÿ]*").fullmatch
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
        self.alphabet = byte_alphabet()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            known = self.words.young[word] = array(self.code, [t.id for t in self.library.model.tokenize(mapped)]).tobytes()
        return known

    def _learn(self, wanted: list[bytes]) -> None:
        """Puts the ids of some runs into the young generation."""
        young, cut, known_word, odd = self.runs.young, self.cut.findall, self.words.young.get, []
        if self.runs.old:
            before = list(map(self.runs.old.get, wanted))
            young.update((raw, x) for raw, x in zip(wanted, before, strict=True) if x is not None)
            wanted = [raw for raw, x in zip(wanted, before, strict=True) if x is None]
        text = b"\n".join(wanted).decode()  # a run holds no white space
        if not self.plain(text):
            match = [self.plain(run) is not None for run in text.split("\n")]
            odd = [raw for raw, plain in zip(wanted, match, strict=True) if not plain]
            wanted = [raw for raw, plain in zip(wanted, match, strict=True) if plain]
            text = b"\n".join(wanted).decode()
        if wanted:
            low = text.lower().split("\n")
            for raw, run, known in zip(wanted, low, list(map(known_word, low)), strict=True):  # each word is cut into itself
                if known is None:
                    if run.isalpha():
                        known = self._word(run)
                    else:
                        words = cut(run)
                        known = b"".join([x or self._word(w) for x, w in zip(map(known_word, words), words)])
                young[raw] = known
        for k in range(0, len(odd), 4096):
            young.update(zip(odd[k : k + 4096], self._whole([x.decode() for x in odd[k : k + 4096]]), strict=True))

    def _ids(self, keys: list[bytes]) -> list[bytes]:
        self.runs.turn()
        self.words.turn()
        found = list(map(self.runs.young.get, keys))
        if None in found:
            self._learn([k for k, x in zip(keys, found, strict=True) if x is None])
            found = list(map(self.runs.young.__getitem__, keys))
        return found

    def _by_runs(self, texts: list[bytes]) -> list[bytes]:
        words = Words(texts)
        if not len(words.start):
            return [b""] * len(texts)
        kind = _KIND[words.buf]
        cuts = np.flatnonzero(_CUT[kind[:-1] * 4 + kind[1:]]) + 1
        words.first = words.first + np.searchsorted(cuts, np.append(words.start, len(words.buf))[words.first])
        words.start, words.end = (np.sort(np.concatenate((x, cuts)), kind="stable") for x in (words.start, words.end))
        _, first, each = np.unique(words.hashes(), return_index=True, return_inverse=True)
        length = words.end - words.start
        same = length == length[first][each]
        if not same.all() or not same_bytes(words.buf, words.start, words.start[first][each], length).all():
            return [b"".join(self._ids(t.split())) for t in texts]  # two runs with one hash
        raw = words.buf.tobytes()
        found = self._ids([raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)])
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        size_of = size[each]
        out = gather(flat, (np.cumsum(size) - size)[each], size_of).tobytes()
        stops = (np.concatenate(([0], np.cumsum(size_of)))[words.first] * self.kind.itemsize).tolist()
        return [out[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as the bytes of unsigned integers of ``kind``."""
        whole = [i for i, t in enumerate(texts) if self.added.search(t)] if self.known_make else range(len(texts))
        apart = set(whole)
        out = self._by_runs([b"" if i in apart else t for i, t in enumerate(texts)])
        for i, x in zip(whole, self._whole([texts[i].decode() for i in whole]), strict=True):
            out[i] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# --- jobs -------------------------------------------------------------------------------------------------------------


def _parts(docs: DataFrame) -> int:
    """How many ranges of doc_id: of PART_BYTES at most, but enough for all cores where those hold LEAST_PART_BYTES."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = 4 * docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // PART_BYTES), min(cores, -(-size // LEAST_PART_BYTES)))


def tokenised(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id and its ids with the end id, in shared files: part (range of doc_id), offset within it, n, ids (zstd).

    The files hold each part's rows together and in the order of doc_id, ties by a hash of the text.  Ranges are of both,
    so that rows of one doc_id, or of none, may fill many.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], coder.kind).tobytes()
        total = 0
        for part, texts in slices(batches, limit=ENCODE_BYTES):
            got = [x + end for x in coder.encode(texts)]
            n = np.array([len(x) // coder.kind.itemsize for x in got], np.int64)
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([part.column("part"), part.column("doc_id"), pa.array(n), pa.array([pack.compress(x) for x in got], pa.binary()), pa.array(before)], ["part", "doc_id", "n", "ids", "offset"])

    keyed = docs.withColumn("tie", F.xxhash64("text"))
    rows = keyed.repartitionByRange(_parts(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return materialise(rows.mapInArrow(encode, "part int, doc_id bigint, n bigint, ids binary, offset bigint"), "tokens")


def _bases(tokens: DataFrame) -> dict[int, int]:
    """Ids before each part; there is a row for each part, not for each document."""
    out, total = {}, 0
    for part, k in sorted(tokens.groupBy("part").agg(F.sum("n")).collect()):
        out[part] = total
        total += k
    return out


def frequencies(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs in all documents; the result has a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, open_ = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            counts += np.bincount(np.concatenate([np.frombuffer(open_.decompress(x), kind) for x in batch.column("ids").to_pylist()] or [np.zeros(0, kind)]), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect():
        out[row[0]] = row[1]
    return out


BLOCKS = "part int, block int, start bigint, n bigint, doc_ids binary, lengths binary, payload binary, lanes int, states binary, marks binary, ids_crc32 bigint, payload_crc32 bigint"


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encodes ``docs`` and writes the dataset at ``path``, documents in ascending order of doc_id.

    A null text counts as empty and has the end id alone.  A null doc_id comes first; rows of one doc_id stand side by
    side, ordered by a hash of their texts.  Other columns are not read.  An empty table gives a dataset without blocks.
    """
    spark = docs.sparkSession
    coder = encoder(tokenizer)
    size, kind = coder.library.get_vocab_size(), coder.kind.str
    tokens = tokenised(docs, tokenizer, end_id)
    freqs = normalise(frequencies(tokens, max(size, end_id + 1), kind))
    bases = _bases(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numeral, open_ = Coder(freqs), zstandard.ZstdDecompressor()
        held: list[tuple[int, np.ndarray]] = []
        at = count = 0
        part = None

        def block() -> pa.RecordBatch:
            values = np.concatenate([v for _, v in held])
            payload, lanes, states, marks = numeral.encode(values)
            row = [part, at, bases[part] + at, len(values), np.array([d for d, _ in held], "<i8").tobytes(), np.array([len(v) for _, v in held], "<u4").tobytes(), payload.tobytes(), lanes, states.tobytes(), marks.tobytes(), zlib.crc32(values.astype("<u4").tobytes()), zlib.crc32(payload.tobytes())]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 2, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for p, doc, offset, raw in zip(batch.column("part").to_pylist(), ids(batch.column("doc_id")).tolist(), batch.column("offset").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and (p != part or count >= BLOCK_IDS):
                    yield block()
                    held, count = [], 0
                if not held:
                    part, at = p, offset
                held.append((doc, np.frombuffer(open_.decompress(raw), kind)))
                count += len(held[-1][1])
        if held:
            yield block()

    spark.createDataFrame([(size, bytearray(freqs.astype("<u4").tobytes()))], "vocabulary int, frequencies binary").coalesce(1).write.parquet(f"{path}/table")
    tokens.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(bytes(spark.read.parquet(f"{path}/table").first()["frequencies"]), "<u4")


def decode_block(numeral: Coder, row: dict) -> np.ndarray:
    """A block's ids; raises where a checksum doesn't hold."""
    if zlib.crc32(row["payload"]) != row["payload_crc32"]:
        raise ValueError(f"payload of block {row['part']}/{row['block']} is damaged")
    marks = np.frombuffer(row["marks"], "<i8")
    states = np.frombuffer(row["states"], "<u8").reshape(len(marks), -1)
    out = numeral.decode(np.frombuffer(row["payload"], "<u4"), row["lanes"], states, marks, row["n"])
    if zlib.crc32(out.astype("<u4").tobytes()) != row["ids_crc32"]:
        raise ValueError(f"ids of block {row['part']}/{row['block']} are damaged")
    return out


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (little-endian unsigned 32-bit), or their crc32, of each stored document."""
    freqs = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numeral = Coder(freqs)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                values = decode_block(numeral, row).astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                docs = [values[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                last = pa.array([zlib.crc32(d) for d in docs], pa.int64()) if digest else pa.array(docs, pa.binary())
                yield pa.RecordBatch.from_arrays([id_column(np.frombuffer(row["doc_ids"], "<i8")), pa.array(row["start"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digest else 'ids binary'}")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes a dataset in the shared folder and reads its digests back."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path, digest=True)


__all__ = ["Coder", "WordEncoder", "decode_block", "normalise", "read_ids", "round_trip", "write_ids", "NULL_ID"]
