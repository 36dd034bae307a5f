"""Ids of texts from the ids of their words, where a tokenizer treats each word on its own.

The words of a batch are reduced to distinct ones by Arrow, those that this worker has not met lately are encoded by
the tokenizer, and the ids of the texts are gathered in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: words remembered per Python worker, and the longest that is
REMEMBERED, REMEMBERED_CHARS = 300_000, 48
#: bytes of text held as Python objects at once (or one text)
SLICE = 4 << 20


def slices(array: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Neighbouring parts of about ``most`` bytes, of one row at least. Nulls become empty texts."""
    array = pc.fill_null(array, "")
    ends = np.cumsum(pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(array):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield array.slice(start, end - start)
        start = end


class WordIds:
    """``encode_new`` gives the packed ids (little-endian unsigned 32-bit) of words."""

    def __init__(self, encode_new: Callable[[list[str]], Iterable[bytes]]):
        self.encode_new = encode_new
        self.known: dict[str, bytes] = {}

    def _packed(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        got = [self.known.get(w) for w in words]
        gaps = [i for i, g in enumerate(got) if g is None]
        new = [words[i] for i in gaps]
        for i, w, ids in zip(gaps, new, self.encode_new(new) if new else ()):
            got[i] = ids
            if len(w) <= REMEMBERED_CHARS:
                self.known[w] = ids
        return got

    def texts(self, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of each text end; ``ends``: where the words of each text end."""
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        packed = self._packed(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        first = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(packed), dtype="<u4")
        n = lengths[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(first[at] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[ends]


def binaries(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per text."""
    offsets = np.concatenate(([0], ends)) * 4
    if offsets[-1] >= 1 << 31:
        parts = np.split(ids, ends[:-1])
        return pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))]
    return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


def forgetting(words: WordIds, arrays: Iterator[pa.Array], encode: Callable[[pa.Array], pa.Array]) -> Iterator[pa.Array]:
    """``encode`` of each array; the words are forgotten after the last, as the worker may live on for other work."""
    try:
        for array in arrays:
            yield encode(array)
    finally:
        words.known.clear()
        pa.default_memory_pool().release_unused()


def joined(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
