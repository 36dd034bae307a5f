"""Keys of lines: stripped of ASCII white space at both ends, A-Z in lower case."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import text_of

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)


def lines(text: str) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(text_of(text), "\n", -1)


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def digest(line: str) -> bytes:
    """What ``unhex(md5(key(line)))`` is in a plan."""
    return hashlib.md5(line.strip(BLANKS).translate(_LOWERED).encode()).digest()
