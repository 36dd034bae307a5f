"""Sequences of fixed size with little padding: best-fit decreasing over the whole corpus.

Documents are tokenised and cut into full windows and one rest. The rests are packed longest first, each into the
open window with the least room that still takes it. A window is known by its room alone and a piece by its length
alone, so the plan of the packing follows from the histogram of lengths, at most ``size`` numbers, however many
pieces there are: windows of equal room are one interval of sequence numbers, and a run of pieces of one length fills
an interval at once. The result is that of placing piece after piece. Pieces then find their place by (length, rank
within the length); the ranks come from counts per (length, bucket), so a length that holds most pieces is spread.

Null and empty texts have the end id only. Repeated rows are packed each. Rows are ranked by id, start and digest.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .wordids import WordIds, binaries, forgetting, joined, slices

WINDOW = 2048
#: a run of ASCII marks, no apostrophe, between a letter and a space
_MARK = r"(\pL)([!-&(-/:-@\[-`{-~]+) "


class WordTokenizer:
    """Ids by a tokenizer that lower-cases and never crosses white space, from the ids of the words.

    Texts are cut at spaces and line feeds, and before marks between a letter and a space, where the tokenizer cuts
    anyway. Words of letters alone are one pre-token each, whose last piece bears the word end; they
    are encoded many at a time. Texts that may hold a special token go to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words = WordIds(self.new)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in found]

    def new(self, words: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha()]
        for i in range(0, len(plain), 500):
            some = plain[i : i + 500]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
                out.update((w, data[a:b]) for w, a, b in zip(some, at, at[1:]))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.whole(rest)))
        return [out[w] for w in words]

    def encode(self, texts: pa.Array) -> pa.Array:
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        t = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        t = pc.replace_substring(pc.ascii_lower(t), "\n", " ")
        t = pc.replace_substring_regex(t, _MARK, r"\1 \2 ")
        lists = pc.split_pattern(t, " ")
        words = lists.flatten()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        out = binaries(*self.words.texts(words, ends))
        if special.any():
            own = iter(self.whole(texts.filter(pa.array(special)).to_pylist()))
            out = pa.array([next(own) if s else x for s, x in zip(special, out.to_pylist())], pa.binary())
        return out


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenise(text: Column, path: str, end_id: int) -> Column:
    """Packed ids (little-endian unsigned 32-bit) of each text, then ``end_id``."""
    end = struct.pack("<I", end_id)

    @F.arrow_udf("binary")
    def tokenised(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = word_tokenizer(path)

        def ids(texts: pa.Array) -> pa.Array:
            found = joined([own.encode(part) for part in slices(texts)])
            return pc.binary_join_element_wise(found, pa.scalar(end, pa.binary()), pa.scalar(b"", pa.binary()))

        return forgetting(own.words, batches, ids)

    return tokenised(text)


def cut(docs: DataFrame, ids: str, size: int = WINDOW) -> DataFrame:
    """One row per piece of at most ``size`` ids, in place of column ``ids``: ``start``, ``length``, ``ids`` (its own)
    and ``doc_tokens``."""
    kept = [c for c in docs.columns if c not in (ids, "start", "length", "doc_tokens")]
    n = (F.length(ids) / 4).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    pieces = docs.select(*kept, F.col(ids).alias("__ids"), n.alias("doc_tokens"), F.explode(starts).alias("start"))
    own = F.substring("__ids", (F.col("start") * 4 + 1).cast("int"), F.lit(4 * size))
    return pieces.select(*kept, "start", (F.length(own) / 4).cast("long").alias("length"), own.alias("ids"), "doc_tokens")


class Rooms:
    """A segment tree over the room 0..size of open windows. A leaf holds the intervals of sequence numbers with that
    room, an inner node whether any leaf below it does."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.any = [False] * (2 * self.leaves)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _tell(self, room: int) -> None:
        i = room + self.leaves
        self.any[i] = bool(self.at[room])
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def put(self, room: int, first: int, end: int) -> None:
        if first < end:
            self.at[room].append((first, end))
            self._tell(room)

    def take(self, room: int) -> tuple[int, int]:
        got = self.at[room].pop()
        self._tell(room)
        return got

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open window has."""
        if need >= len(self.at):
            return None
        i = need + self.leaves
        if not self.any[i]:
            while i > 1 and (i % 2 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


@dataclass
class Run:
    """Pieces ``first``.. of one length fill windows from ``sequence`` on, ``each`` per window, from ``offset`` on."""

    length: int
    first: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], size: int = WINDOW) -> list[Run]:
    """Best-fit decreasing of ``{length: pieces}``."""
    rooms, runs, sequences = Rooms(size), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= size:
            raise ValueError(f"a piece has {length} of {size} ids")
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, (first, end) = size, (sequences, sequences - -left // (size // length))
                sequences = end
            else:
                first, end = rooms.take(room)
            each = room // length
            full = min(end - first, left // each)
            rest = min(left - full * each, each - 1) if full < end - first else 0
            runs.append(Run(length, rank, first, each, size - room))
            rooms.put(room - each * length, first, first + full)
            rooms.put(room, first + full + (rest > 0), end)
            if rest:
                rooms.put(room - rest * length, first + full, first + full + 1)
            rank += full * each + rest
            left -= full * each + rest
    return runs


def pack(pieces: DataFrame, order: list[str], size: int = WINDOW, length: str = "length", buckets: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (both long) to pieces of 1..``size`` ids.

    ``order`` ranks the pieces of one length; rows that agree on all of it may swap places. The pieces are written
    once, so they are not computed twice."""
    pieces = written(pieces, "pieces")
    spark = pieces.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = written(pieces.groupBy(F.col(length).alias("__l"), F.col("__bucket").alias("__b")).agg(F.count("*").alias("__n")), "counts")
    histogram = {r["__l"]: r["n"] for r in counts.groupBy("__l").agg(F.sum("__n").alias("n")).collect()}  # at most ``size`` rows
    runs = plan(histogram, size)

    before = Window.partitionBy("__l").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__l", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = pieces.withColumn("__rank", F.row_number().over(Window.partitionBy(length, "__bucket").orderBy(*order)) - 1)
    ranked = ranked.join(offsets, (F.col(length) == F.col("__l")) & (F.col("__bucket") == F.col("__b")))

    runs.sort(key=lambda r: (r.length, r.first))
    key = np.array([r.length << 48 | r.first for r in runs], dtype=np.int64)
    first, sequence, each, offset = (np.array([getattr(r, f) for r in runs], dtype=np.int64) for f in ("first", "sequence", "each", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        run = np.searchsorted(key, n << 48 | rank, side="right") - 1
        at = rank - first[run]
        return pd.DataFrame({"sequence_id": sequence[run] + at // each[run], "offset": offset[run] + at % each[run] * n})

    kept = [c for c in pieces.columns if c not in ("__bucket", "sequence_id", "offset")]
    placed = ranked.withColumn("__place", place(F.col(length), F.col("__rank") + F.col("__before")))
    return placed.select(*kept, "__place.sequence_id", "__place.offset")
