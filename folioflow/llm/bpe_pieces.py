"""Byte-level BPE encoding and decoding with a sentencepiece model that is serialised straight from a rank file.

Each byte is mapped to a printable character, each entry of the rank file becomes a piece of such characters scored by
its negative rank, and the normaliser is the identity.  Sentencepiece then merges, in every pre-token, the pair whose
union has the smallest rank, which is what a rank file asks for.  Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CACHED = 300_000  #: chunks of text whose ids a task remembers before it starts afresh
BATCH_BYTES = 2 << 20  #: of text encoded together, or one document if that is longer


def byte_characters() -> list[str]:
    """A distinct character for each byte, none of which sentencepiece treats specially."""
    return [chr(0x100 + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes as length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The bytes of a sentencepiece BPE model; piece id = rank, and one unknown piece follows the last rank."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [_field(1, "".join(chars[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1) for piece, rank in by_rank]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)  # BPE, vocabulary size, unknown id
    trainer += b"".join(_field(k, 2**64 - 1) for k in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = [p for p, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.pattern = regex.compile(pattern)
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.odd_space, self.lone_space = re.compile(r"\s\s|^ | \Z"), re.compile(r"(?<=\S)(?= \S)")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.single = {p.decode(): struct.pack("<I", r) for p, r in ranks.items() if self._is_text(p)}

    @staticmethod
    def _is_text(piece: bytes) -> bool:
        try:
            piece.decode()
        except UnicodeDecodeError:
            return False
        return True

    def _chunks(self, text: str) -> list[str]:
        """Cuts a text at every single space that stands between two characters other than white space.

        Such a space always begins a match of the pattern, so the ids of the parts (all but the first with their space)
        are, one after the other, the ids of the text.  Other white space stays inside its part, where the pattern sees it.
        """
        if self.odd_space.search(text) is None:
            return text.split(" ")
        return [p[1:] if i else p for i, p in enumerate(self.lone_space.split(text))]

    def _learn(self, chunks: list[str], known: dict[str, bytes]) -> None:
        """Puts the ids of new chunks into ``known``, with one call of sentencepiece for all their pre-tokens."""
        single, find = self.single, self.pattern.findall
        tokens = [find(c) for c in chunks] if known is self.first else [find(" " + c) for c in chunks]
        todo = list({t for ts in tokens for t in ts if t not in single})
        got = self.model.encode([t.encode().decode("latin-1").translate(self.table) for t in todo], num_threads=1) if todo else []
        new = {t: array("I", x).tobytes() for t, x in zip(todo, got, strict=True)}
        for chunk, ts in zip(chunks, tokens, strict=True):
            known[chunk] = b"".join([single.get(t) or new[t] for t in ts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self._chunks(t) for t in texts]
        heads, tails = {c[0] for c in cut}, set()
        for chunks in cut:
            tails.update(chunks[1:])
        for known, wanted in ((self.first, heads), (self.later, tails)):
            missing = wanted.difference(known)
            if len(known) + len(missing) > CACHED:
                known.clear()
                missing = wanted
            self._learn(list(missing), known)
        first, later = self.first, self.later.__getitem__
        return [first[chunks[0]] + b"".join(map(later, chunks[1:])) for chunks in cut]

    def forget(self) -> None:
        """Drops what was remembered: a Python worker lives on after its task, beside those of other jobs."""
        self.first.clear()
        self.later.clear()

    def decode(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


SCHEMA = "doc_id bigint, ids binary, decoded binary"


def encode_documents(docs: DataFrame, path: str = RANKS, digest: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the decoded bytes of each text, or their digests.

    A null text counts as empty and gives no ids.  A null doc_id stays null; repeated rows each give a row; other
    columns of ``docs`` are not read.  With ``digest`` the columns are doc_id, n_tokens, ids_sha256, decoded_sha256.
    The vocabulary file at ``path`` must exist on every executor, as installed data of the Python environment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, public_tokenizers.PATTERN)
        for batch in batches:
            texts = batch.column("text")
            begin = size = 0
            for stop, length in enumerate(pc.utf8_length(texts).to_pylist(), 1):
                size += length or 0
                if size < BATCH_BYTES and stop < len(texts):
                    continue
                encoded = coder.encode([t or "" for t in texts.slice(begin, stop - begin).to_pylist()])
                decoded = map(coder.decode, encoded)
                ids = batch.column("doc_id").slice(begin, stop - begin)
                if digest:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(encoded, pa.binary()), pa.array(list(decoded), pa.binary())], ["doc_id", "ids", "decoded"])
                begin, size = stop, 0
        coder.forget()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else SCHEMA)
