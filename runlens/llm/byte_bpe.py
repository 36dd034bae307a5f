"""Byte-level BPE with a sentencepiece model that is written straight from a rank vocabulary.

Every byte gets a letter of its own, so a vocabulary entry becomes a string of such letters, scored by its negative
rank; the normaliser is the identity. Pre-tokens are encoded one by one, ids are turned back by the inverse mapping.

``encode``: a null or empty text has no ids. Repeated rows are encoded each. Ids come as packed little-endian
unsigned 32-bit integers, so they travel as one binary value, whatever the length of the text. Nothing is joined or
grouped: every row is its own, so no key can be hot, and a lost executor only means its partitions again.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordids import WordIds, binaries, forgetting, joined, slices

# letters that stand for the 256 bytes; none of them is white space
_FIRST_LETTER = 0x100
_LETTERS = {b: _FIRST_LETTER + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def letters(token: bytes) -> str:
    return token.decode("latin-1").translate(_LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model (its published protobuf message) of a rank vocabulary. Ids equal ranks, which must be
    gapless; one unknown piece follows them."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    normal, unknown, bpe = 1, 2, 2  # fixed values of the message's enumerations
    pieces = [
        _bytes(1, _bytes(1, letters(token).encode()) + b"\x15" + struct.pack("<f", -rank) + _number(3, normal))
        for rank, token in enumerate(ordered)
    ]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown)))
    trainer = _number(3, bpe) + _number(4, len(ordered) + 1) + _number(40, len(ordered))
    # no begin, end or padding piece: -1 as the message writes it
    trainer += b"".join(_varint(f << 3) + _varint((1 << 64) - 1) for f in (41, 42, 43))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.find = regex.compile(pattern).findall
        self.pieces: list[bytes] = sorted(ranks, key=ranks.__getitem__)
        self.words = WordIds(self.pretokens)

    def pretokens(self, new: list[str]) -> Iterable[bytes]:
        for ids in self.model.encode([letters(t.encode()) for t in new], out_type=int, num_threads=1):
            yield struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> pa.Array:
        split = [self.find(t) for t in texts]
        ends = np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
        return binaries(*self.words.texts(pa.array(chain.from_iterable(split), pa.string()), ends))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Packed ids of each text by the vocabulary file at ``path`` (readable on every executor)."""

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        return forgetting(own.words, batches, lambda texts: joined([own.encode(part.to_pylist()) for part in slices(texts)]))

    return encoded(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that packed ids stand for; null ids: no bytes."""

    @F.arrow_udf("binary")
    def decoded(packed: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([own.decode(x.as_py() or b"") for x in packed], pa.binary())

    return decoded(ids)
