"""Substring dedup by hashing the units of paragraphs.

Units are sentences and pieces of long ones. A line is cut after a full stop, exclamation or question mark and a space,
and after the full-width marks of scripts that have no spaces. Within a sentence it is cut where a hash of two neighbouring
words is the smallest of ``REACH`` on either side, ``UNIT_WORDS`` from both ends at least: such a place depends on the words
around it alone, so a passage in the middle of different sentences is cut alike in each of them. A unit is
normalised to its words, A-Z in lower case, and gets a 128-bit digest. Digests are grouped globally; the earliest
occurrence by (document, unit) is kept. In a document, neighbouring units that all occur earlier form a passage, and
passages of at least ``LEAST_WORDS`` words are removed. Units of fewer than ``UNIT_WORDS`` words are no evidence: they
go with a passage that encloses them, and aren't grouped. A unit of more than ``SPACED`` characters a word is in a script
without spaces, or data: each ``CHARS`` characters of it count as a word. What isn't found: the ends of a passage that
starts or stops within a sentence, up to its first and from its last cut. Offsets are those of the original text, in UTF-8 bytes.

Groups are reduced to their earliest occurrence per task before the shuffle, so a passage that is everywhere costs a
row per task. Null and empty texts have no units. Rows equal in id and text are one document: both stay or lose alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .rows import ID, TIE, give, keyed
from .textbytes import LOWER, SPACE, Hasher, as_bytes, mix, words
from .wordids import slices

LEAST_WORDS, UNIT_WORDS, REACH = 25, 4, 4
SPACED, CHARS = 16, 4
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True
#: full-width full stop, exclamation and question mark
_MARKS = np.array([[0xE3, 0x80, 0x82], [0xEF, 0xBC, 0x81], [0xEF, 0xBC, 0x9F]], dtype=np.uint8)
_PAIR = np.uint64(0x8CB92BA72F3D8DD7)
_BASES = (0x9FB21C651E98DF25, 0xD1342543DE82EF95)
UNIT = "array<struct<unit:int,h:long,g:long>>"


def marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, cut after full-width marks as well, and which of them follow such a cut."""
    lead = np.flatnonzero((data[:-2] == 0xE3) | (data[:-2] == 0xEF)) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    after = lead[(data[lead[:, None] + np.arange(3)][:, None] == _MARKS).all(2).any(1)] + 3 if len(lead) else lead
    after = after[~np.isin(after, ends)]
    starts, ends = np.sort(np.concatenate((starts, after))), np.sort(np.concatenate((ends, after)))
    return starts, ends, np.isin(starts, after)


def cuts(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words (hashes ``own``) at which sentences are cut by their content; ``first``: the first words of sentences."""
    at, number, i = np.flatnonzero(first), np.cumsum(first) - 1, np.arange(len(own))
    stop = np.concatenate((at[1:], [len(own)]))
    value = mix(own * _PAIR + np.concatenate((own[:1], own[:-1])))
    value[first] = np.iinfo(np.uint64).max
    cut = (i - at[number] >= UNIT_WORDS) & (stop[number] - i >= UNIT_WORDS)
    for d in range(1, REACH + 1):
        apart = number[d:] != number[:-d]
        cut[:-d] &= apart | (value[:-d] < value[d:])
        cut[d:] &= apart | (value[d:] < value[:-d])
    return cut


def units(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units (from their first word to their last), the words they count as, and their two hashes
    (2, n)."""
    starts, ends, _, size, hashes = _units(text)
    return starts, ends, size, hashes


def _units(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``units``, with their words before what they count as."""
    data = LOWER[as_bytes(text)]
    starts, ends, cut = marked(data, *words(data))
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, np.zeros((2, 0), dtype=np.uint64)
    feeds = np.concatenate(([0], np.cumsum(data == 10)))
    first = np.ones(len(starts), dtype=bool)
    first[1:] = (feeds[starts[1:]] > feeds[ends[:-1]]) | (_END[data[ends[:-1] - 1]] & SPACE[data[np.minimum(ends[:-1], len(data) - 1)]])
    first |= cut
    own = Hasher(data)(starts, ends)
    first |= cuts(own, first)
    at = np.flatnonzero(first)
    stop = np.concatenate((at[1:], [len(starts)]))
    both = []
    for base in _BASES:
        powers = np.full(len(own), base, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        inverse = np.full(len(own), pow(base, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(own ^ np.uint64(base)) * powers)))
        both.append(mix((sums[stop] - sums[at]) * inverse[at] + (stop - at).astype(np.uint64)))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars, n = chars[ends[stop - 1]] - chars[starts[at]], stop - at
    return starts[at], ends[stop - 1], n, np.where(chars > SPACED * n, np.maximum(n, chars // CHARS), n), np.stack(both)


def digests(text: Column, unit_words: int = UNIT_WORDS) -> Column:
    """The units of each text that count as evidence."""

    @F.arrow_udf(UNIT)
    def found(texts: pa.Array) -> pa.Array:
        number, h, g, n = [], [], [], [0]
        for part in slices(texts):
            for t in part.to_pylist():
                _, _, size, hashes = units(t)
                keep = np.flatnonzero(size >= unit_words)
                number.append(keep)
                h.append(hashes[0][keep])
                g.append(hashes[1][keep])
                n.append(len(keep))
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (number, h, g)]
        structs = pa.StructArray.from_arrays(
            [pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.uint64).view(np.int64)), pa.array(flat[2].astype(np.uint64).view(np.int64))],
            ["unit", "h", "g"],
        )
        return pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), structs)

    return found(text)


def passages(text: str | bytes | None, earlier: set[int], least_words: int = LEAST_WORDS, unit_words: int = UNIT_WORDS) -> list[tuple[int, int, int, int]]:
    """(start, end, words, first unit) of the passages to remove; ``earlier``: units that occur earlier."""
    starts, ends, n_words, size, _ = _units(text)
    out, run = [], []
    for i in range(len(starts) + 1):
        if i < len(starts) and i in earlier:
            run.append(i)
        elif i == len(starts) or size[i] >= unit_words:
            if run:
                if size[run[0] : run[-1] + 1].sum() >= least_words:
                    out.append((int(starts[run[0]]), int(ends[run[-1]]), int(n_words[run[0] : run[-1] + 1].sum()), run[0]))
            run = []
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans of its UTF-8 bytes; blanks and empty lines left around a span are closed up."""
    data, out, at = text.encode(), b"", 0
    for start, end in spans:
        out += data[at:start]
        at = end
        if data[at : at + 1] in (b"\n", b""):
            out = out.rstrip(b" ")
        if not out or out[-1:] in b" \n":
            while data[at : at + 1] == b" " or (data[at : at + 1] == b"\n" and (not out or out[-1:] == b"\n")):
                at += 1
    return (out + data[at:]).decode()


_SPAN = "array<struct<start:long,end:long,n_words:long,unit:int>>"


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` cleaned, and ``removed``: the passages that went, with their
    offsets in the original text and the document that keeps the first of their units."""
    docs = keyed(docs, key, text)
    held = materialise(docs.select(ID, TIE, digests(F.col(text)).alias("units")), "units")
    each = held.select(ID, TIE, F.explode("units").alias("u")).select(ID, TIE, "u.*")
    rank = F.struct(F.col(ID), F.col(TIE), F.col("unit"))
    # by the first hash alone, which most units have for themselves; only the others are grouped and joined in full
    often = materialise(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    some = materialise(each.join(often, "h", "left_semi"), "repeated")
    groups = materialise(some.groupBy("h", "g").agg(F.min(rank).alias("first")), "groups")
    found = some.join(groups, ["h", "g"]).where(~rank.eqNullSafe(F.col("first")))
    per_doc = found.groupBy(ID, TIE).agg(F.collect_set(F.struct("unit", F.col(f"first.{ID}").alias("kept"))).alias("__earlier"))
    joined = give(docs, per_doc)

    @F.arrow_udf(f"text string, removed {_SPAN}")
    def cleaned(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        out, removed = [], []
        for t, e in zip(texts, earlier):
            t, e = t.as_py(), e.as_py()
            spans = passages(t, set(e), least_words) if e else []
            out.append(without(t, [s[:2] for s in spans]) if spans else t)
            removed.append([dict(zip(("start", "end", "n_words", "unit"), s)) for s in spans])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("unit", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(removed, kind)], ["text", "removed"])

    own = [c for c in docs.columns if c not in (ID, TIE, text, "removed")]
    made = cleaned(F.col(text), F.transform("__earlier", lambda e: e["unit"]))
    out = joined.select(*own, "__earlier", made.alias("__c"))
    keeper = lambda s: F.filter("__earlier", lambda e: e["unit"] == s["unit"])[0]["kept"]
    removed = F.transform(
        "__c.removed",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n_words"].alias("n_words"), keeper(s).alias("kept_id")),
    )
    return out.select(*own, F.col("__c.text").alias(text), removed.alias("removed"))
