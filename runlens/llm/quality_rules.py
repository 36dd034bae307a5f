"""Quality rules: plain counts, and a logistic regression on hashed word and character n-grams.

A document's features are the shares of its words, of its pairs of neighbouring words and of its windows of 4 characters
that fall on each hash, so its logit is a constant plus three mean weights. The regression is fitted on at most ``SAMPLE`` labelled rows, those of the smallest
hash of their id; the other ones of the sample's folds calibrate the logits to probabilities. Scoring runs in Arrow
batches, row by row on whole texts: no row depends on another.

Null and empty texts have no words and fail the base rule. Labels without quality, or in conflict for one document,
aren't learned from. With no labelled row of either class every probability is 0.5, so the base rule decides.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import text_of
from .textbytes import windows
from .textstats import Counts
from .wordids import slices

#: labelled rows to learn from, at most; hash buckets of each feature group; documents need this probability
SAMPLE, BUCKETS, THRESHOLD = 3000, 1 << 16, 0.5
_SHIFT = np.uint64(64 - 16)
_WORD, _GRAM, _POINT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: characters (code points) of a character n-gram; feature groups: words, word pairs, characters
CHARACTERS, GROUPS = 4, 3
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def hashed(counts: Counts) -> tuple[np.ndarray, ...]:
    """Buckets of the words, of the pairs of neighbouring words, and of the windows of ``CHARACTERS`` characters, each group
    in buckets of its own."""
    points = np.frombuffer(counts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = max(0, len(points) - CHARACTERS + 1)
    grams = points[:n]
    for i in range(1, CHARACTERS):
        grams = grams * _POINT + points[i : i + n]
    parts = (counts.hashes, _WORD), (windows(counts.hashes, 2), _WORD), (grams, _GRAM)
    return tuple(((h * m) >> _SHIFT).astype(np.int64) + g * BUCKETS for g, (h, m) in enumerate(parts))


def deflated(features: np.ndarray) -> bytes:
    """Rising buckets and their shares, compressed behind their number."""
    at, share = features
    steps = np.diff(at, prepend=0).astype(np.int32)
    return len(at).to_bytes(4, "little") + zlib.compress(steps.tobytes() + share.astype(np.float32).tobytes(), 1)


def inflated(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data, n = zlib.decompress(packed[4:]), int.from_bytes(packed[:4], "little")
    return np.cumsum(np.frombuffer(data, np.int32, n)), np.frombuffer(data, np.float32, n, 4 * n)


@dataclass
class Model:
    """``weights`` of all groups; a probability is sigmoid(slope * logit + intercept)."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.intercept, -35, 35)))

    def logit(self, groups: tuple[np.ndarray, ...]) -> float:
        return self.bias + sum(float(self.weights[g].mean()) for g in groups if len(g))


def sample(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """At most ``most`` rows (key, label), one per key, whose labels agree."""
    agreed = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__id"))
    agreed = agreed.agg(F.min(label).alias("__y"), F.max(label).alias("__other")).where("__y = __other")
    return agreed.select("__id", "__y").orderBy(F.xxhash64("__id"), "__id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = SAMPLE) -> Model:
    """Learn P(label = 1). At most ``most`` label rows are broadcast and as many hashed rows are collected:
    of several texts under one id, the one with the smallest hash is learned from."""

    @F.arrow_udf("binary")
    def features(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(texts):
            for t in part.to_pylist():
                rows = []
                for g in hashed(Counts(t)):
                    at, n = np.unique(g, return_counts=True)
                    rows.append(np.stack([at, n / max(1, len(g))]))
                out.append(deflated(np.concatenate(rows, axis=1)))
        return pa.array(out, pa.binary())

    chosen = F.broadcast(sample(labels, key, label, most))
    texts = docs.join(chosen, F.col(key) == F.col("__id")).select("__id", "__y", text_of(text).alias("__t"))
    one = texts.groupBy("__id").agg(F.min("__y").alias("__y"), F.min(F.struct(F.xxhash64("__t").alias("h"), "__t")).alias("__m"))
    rows = one.select("__id", "__y", features(F.col("__m.__t")).alias("__x")).collect()
    rows.sort(key=lambda r: r["__id"])
    labelled = np.array([r["__y"] for r in rows], dtype=np.float64)
    packed = [bytes(r["__x"]) for r in rows]
    del rows
    return train(packed, labelled)


#: features summed at once
CHUNK = 1 << 20


def train(packed: list[bytes], y: np.ndarray, rounds: int = 150) -> Model:
    """Full-batch adaptive gradient steps with a small ridge; every fourth row calibrates. ``packed`` is emptied: features are
    held once, 12 bytes each."""
    model = Model(np.zeros(GROUPS * BUCKETS))
    if len(set(y)) < 2:
        return model
    sizes = np.array([int.from_bytes(x[:4], "little") for x in packed])
    ends = np.cumsum(sizes)
    at, share = np.empty(ends[-1], dtype=np.int32), np.empty(ends[-1], dtype=np.float32)
    for i in range(len(packed)):
        part = slice(ends[i] - sizes[i], ends[i])
        at[part], share[part] = inflated(packed[i])
        packed[i] = b""
    row = np.repeat(np.arange(len(packed), dtype=np.int32), sizes)
    parts = [slice(i, i + CHUNK) for i in range(0, len(at), CHUNK)]
    learn = np.arange(len(packed)) % 4 != 0
    if len(set(y[learn])) < 2 or len(set(y[~learn])) < 2:
        learn[:] = True
    importance = np.where(y == 1, 0.5 / max(1, (y[learn] == 1).sum()), 0.5 / max(1, (y[learn] == 0).sum())) * learn
    w, bias, seen, seen_bias = model.weights, 0.0, np.full(GROUPS * BUCKETS, 1e-12), 1e-12
    logits = np.zeros(len(y))
    for _ in range(rounds):
        error = importance * (1 / (1 + np.exp(-np.clip(logits, -35, 35))) - y)
        g = 1e-8 * w
        for p in parts:
            g += np.bincount(at[p], weights=share[p] * error[row[p]], minlength=GROUPS * BUCKETS)
        seen += g * g
        w -= 2.0 * g / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.2 * error.sum() / np.sqrt(seen_bias)
        logits = np.full(len(y), bias)
        for p in parts:
            logits += np.bincount(row[p], weights=share[p] * w[at[p]], minlength=len(y))
    model.bias = bias
    held = ~learn if (~learn).any() else learn
    model.slope, model.intercept = calibrate(logits[held], y[held])
    return model


def calibrate(logits: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton steps for P(y = 1) = sigmoid(a * logit + b), with smoothed targets so that separable rows stay finite."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(logits.std()), 1e-9)
    x = np.stack([logits / spread, np.ones(len(y))], axis=1)
    v = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        v -= np.linalg.solve(h, x.T @ (p - target) + 1e-3 * v)
    return float(v[0] / spread), float(v[1])


def counts(text: Column, model: Model) -> Column:
    """A struct of the base counts and ``probability`` for each whole text."""
    weights = Model(model.weights.astype(np.float32), model.bias, model.slope, model.intercept)

    @F.arrow_udf(BASE + ", probability double")
    def scored(texts: pa.Array) -> pa.Array:
        rows, logits = [], []
        for part in slices(texts):
            for t in part.to_pylist():
                c = Counts(t)
                rows.append((c.n_words, c.word_chars, c.n_symbols, c.lines()[1], c.repeated_words()))
                logits.append(weights.logit(hashed(c)))
        columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * 5
        columns.append(pa.array(weights.probability(np.array(logits, dtype=np.float64)), pa.float64()))
        return pa.StructArray.from_arrays(columns, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"])

    return scored(text)


def rules(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs``, with the counts, ``probability``, ``base_failed`` and ``kept``. Columns of
    these names are replaced."""
    made = [c.split()[0] for c in BASE.split(", ")] + ["probability", "base_failed", "kept"]
    own = [c for c in docs.columns if c not in made]
    out = docs.select(*own, counts(F.col(text), model).alias("__c")).select(*own, "__c.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
