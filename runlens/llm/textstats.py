"""Counts over one text that rules and classifiers share."""

from __future__ import annotations

import numpy as np

from .textbytes import SPACE, Hasher, as_bytes, repeated, windows, words

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?\"'()-")] = True


class Counts:
    """Words are runs of anything but ASCII white space; a null text has none."""

    def __init__(self, text: str | bytes | None):
        self.data = data = as_bytes(text)
        self.starts, self.ends = words(data)
        self.hasher = Hasher(data)
        self.hashes = self.hasher(self.starts, self.ends)
        self.n_words = len(self.starts)
        self.inside = ~SPACE[data]
        self.first_bytes = (data & 0xC0) != 0x80  # of a character
        self.word_chars = int(np.count_nonzero(self.inside & self.first_bytes))
        self.n_symbols = int(np.count_nonzero(_SYMBOL[data]))

    def lines(self) -> tuple[int, int]:
        """Lines that hold a word, and those of them that equal an earlier one."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate(([0], ends + 1))
        ends = np.concatenate((ends, [len(self.data)]))
        so_far = np.concatenate(([0], np.cumsum(self.inside)))
        full = so_far[ends] > so_far[starts]
        hashes = self.hasher(starts[full], ends[full])
        return len(hashes), len(hashes) - len(np.unique(hashes))

    def repeated_words(self, k: int = 3) -> int:
        """Words within windows of ``k`` words that the text holds twice or more."""
        again = np.flatnonzero(repeated(windows(self.hashes, k)))
        if not len(again):
            return 0
        edge = np.zeros(self.n_words + 1, dtype=np.int64)
        edge[again] += 1
        edge[again + k] -= 1
        return int(np.count_nonzero(np.cumsum(edge[:-1])))


STATISTICS = (
    "words", "word_chars", "word_spread", "symbols", "repeated_lines", "repeated_words", "distinct_words", "upper_case",
    "digits", "marks", "other_scripts", "words_per_line", "top_word", "capital_words", "byte_entropy",
)


def statistics(text: str | bytes | None) -> np.ndarray:
    """Transformed statistics of a document, all finite: logs of sizes, square roots of shares."""
    c = Counts(text)
    n, size = max(1, c.n_words), max(1, len(c.data))
    n_lines, dup = c.lines()
    lengths = (c.ends - c.starts).astype(np.float64)
    _, each = np.unique(c.hashes, return_counts=True)
    letters = max(1, np.count_nonzero(_LETTER[c.data]))
    by = np.bincount(c.data, minlength=256)
    share = by[by > 0] / size
    root = lambda part, whole: np.sqrt(part / whole)
    return np.array(
        [
            np.log1p(c.n_words),
            np.log1p(c.word_chars / n),
            np.log1p(lengths.std() if len(lengths) else 0.0),
            root(c.n_symbols, size),
            root(dup, max(1, n_lines)),
            root(c.repeated_words(), n),
            len(each) / n,
            root(np.count_nonzero(_UPPER[c.data]), letters),
            root(np.count_nonzero(_DIGIT[c.data]), size),
            root(np.count_nonzero(_MARK[c.data]), size),
            root(np.count_nonzero(c.data > 127), size),
            np.log1p(c.n_words / max(1, n_lines)),
            root(each.max() if len(each) else 0, n),
            root(np.count_nonzero(_UPPER[c.data[c.starts]]), n),
            -float(np.sum(share * np.log2(share))) if len(share) else 0.0,
        ]
    )
