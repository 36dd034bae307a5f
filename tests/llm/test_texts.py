"""Operators on single texts, against plain Python."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from llm_rows import docs, no_rows, odd  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import byte_bpe, packing, qda, quality_rules, queries, textbytes, textstats

DATA = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    "", "  a  b\n\n c\t", "\x00\x01 ", "Ω≈ç√ 你好 🎉👩‍👩‍👧", "   x", "a" * 3000, "'s 'S don't I'LL", "\r\n \r\n", "1234567890 ½ ²", "ſ's", "İ i̇",
    "<|endoftext|> Ab,. c", "Foo.,bar, x. Σας ΣΣ. É. don't, 's. Á. ,", "  a\u0085b\x1cc ", "a., b.. c , . d. ", "é. x, ª º. ʰ.", "n't, 've. it's, x's. ",
    "foo&&& bar.$$$ x'' y-' z'!", "é. É, ́. ",
]


def sample(spark, n=60):
    return [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(n).collect()]


def test_every_vocabulary_entry_is_its_own_id():
    codec = byte_bpe.codec(*BPE)
    found = codec.model.encode([byte_bpe.letters(p) for p in codec.pieces], out_type=int)
    assert all(ids == [i] for i, ids in enumerate(found))


def test_ids_are_those_of_the_library_and_decode_exactly(spark):
    codec = byte_bpe.codec(*BPE)
    library = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=byte_bpe.read_ranks(BPE[0]), special_tokens={})
    texts = sample(spark) + TRICKY
    for text, ids in zip(texts, codec.encode(texts).to_pylist()):
        want = library.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(want)}I", *want)
        assert codec.decode(ids) == text.encode()


def test_op1(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op1_byte_bpe"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        assert rows[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_odd_texts_round_trip(odd):
    back = odd.withColumn("ids", byte_bpe.encode(F.col("text"), *BPE)).withColumn("back", byte_bpe.decode(F.col("ids"), *BPE))
    for r in back.collect():
        assert bytes(r["back"]) == (r["text"] or "").encode()


def test_word_ids_are_those_of_the_library(spark):
    own, library = packing.word_tokenizer(WORDS), Tokenizer.from_file(WORDS)
    import pyarrow as pa

    texts = sample(spark) + TRICKY
    for text, ids in zip(texts, own.encode(pa.array(texts)).to_pylist()):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want), text[:80]


def one_by_one(lengths, size):
    """Best-fit decreasing, piece after piece: the number of windows and their rooms."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    size = 64
    lengths = rng.integers(1, size + 1 if seed % 2 else 12, 400).tolist()
    histogram = Counter(lengths)
    used, seen = {}, Counter()
    for run in packing.plan(histogram, size):
        pass
    runs = packing.plan(histogram, size)
    for n, count in histogram.items():
        own = sorted((r for r in runs if r.length == n), key=lambda r: r.first)
        for rank in range(count):
            run = [r for r in own if r.first <= rank][-1]
            at = rank - run.first
            used.setdefault(run.sequence + at // run.each, []).append((run.offset + at % run.each * n, n))
            seen[n] += 1
    assert seen == histogram
    for places in used.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= size
    assert sorted(size - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, size)


def check_pieces(rows, docs):
    """Each id in one piece, windows gapless and never too long."""
    library = Tokenizer.from_file(WORDS)
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        end = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == end and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            end += r["length"]
        assert end == len(ids)
    for pieces in by_window.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= packing.WINDOW
    tokens = sum(r["length"] for r in rows)
    return len(by_window), -(-tokens // packing.WINDOW)


def test_op2(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    windows, least = check_pieces(queries.QUERIES["op2_packing"](spark, DATA).collect(), docs)
    assert windows <= 1.02 * least + 1


def test_packing_of_odd_texts(docs, no_rows):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (None, "a b"), (5, "x" * 70_000)]
    check_pieces(queries.packed(docs(rows)).collect(), rows)
    assert queries.packed(no_rows).count() == 0


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [line for line in text.split("\n") if SPACE.search(line)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    for text in sample(spark, 200) + TRICKY + ["a b c a b c", "x x x x", "l\nl\n\n\nl \nl"]:
        c = textstats.Counts(text)
        assert (c.n_words, c.word_chars, c.n_symbols, c.lines()[1], c.repeated_words()) == plain_counts(text)


def test_op4(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_quality_rules"](spark, DATA).collect()
    right = total = 0
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= quality_rules.THRESHOLD)
        if r["doc_id"] in labels:
            total += 1
            right += (r["probability"] >= 0.5) == labels[r["doc_id"]]
    assert len(rows) == len(texts) and right > 0.8 * total


def plain_grams(text):
    """Word, word-pair and 4-character counts of a text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    characters = [text[i : i + 4] for i in range(len(text or "") - 3)]
    return Counter(words), Counter(zip(words, words[1:])), Counter(characters)


def test_features_are_word_and_character_n_grams(spark):
    """Equal n-grams share a bucket, in any text; buckets differ about as often as n-grams do."""
    seen = [{}, {}, {}]
    for text in sample(spark, 100) + TRICKY + [None, "", "ab", "abcd", "é🎉é🎉é🎉", "一二三四五 一二三四五", "a b", "ab c a bc"]:
        groups = quality_rules.hashed(textstats.Counts(text))
        for g, (got, want) in enumerate(zip(groups, plain_grams(text))):
            assert len(got) == want.total() and all(b // quality_rules.BUCKETS == g for b in got)
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            listed = (words, list(zip(words, words[1:])), [text[i : i + 4] for i in range(len(text or "") - 3)])[g]
            for gram, bucket in zip(listed, got.tolist()):
                assert seen[g].setdefault(gram, bucket) == bucket
    for of in seen:
        expected = quality_rules.BUCKETS * (1 - (1 - 1 / quality_rules.BUCKETS) ** len(of))
        assert len(set(of.values())) > 0.97 * expected


def test_features_are_packed_without_loss():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        at = np.sort(rng.choice(quality_rules.GROUPS * quality_rules.BUCKETS, n, replace=False))
        share = rng.random(n)
        got = quality_rules.inflated(quality_rules.deflated(np.stack([at, share])))
        assert (got[0] == at).all() and (got[1] == share.astype(np.float32)).all()


def test_rules_on_rows_not_learned_from(spark):
    """A fifth of the labels is held out."""
    path = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = quality_rules.fit(docs, labels.where(~held))
    rows = quality_rules.rules(docs.where(held), model).join(labels.where("quality is not null"), "doc_id")
    rows = rows.select("probability", "quality").collect()
    assert len(rows) > 50 and sum((r["probability"] >= 0.5) == (r["quality"] == 1) for r in rows) > 0.85 * len(rows)


def test_rules_of_odd_rows(spark, odd, no_rows):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_rules.fit(spark.read.parquet(f"{DATA}/documents.parquet"), labels)
    named = odd.withColumns({"kept": F.lit("clash"), "n_words": F.lit(1)})
    out = quality_rules.rules(named, model)
    assert out.count() == odd.count() and out.where("text is null and kept").count() == 0
    assert quality_rules.rules(no_rows, model).count() == 0
    nothing = quality_rules.fit(odd, labels.limit(0))
    assert quality_rules.rules(odd, nothing).where("probability <> 0.5").count() == 0


def test_op10(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.QUERIES["op10_quality_qda"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) > 0.9 * len(held)


def test_qda_is_the_textbook_formula():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (200, qda.D)), rng.normal(0.5, 2, (300, qda.D))])
    y = np.repeat([0, 1], [200, 300])
    one = np.concatenate([np.ones((500, 1)), x], axis=1)
    model = qda.from_moments([one[y == k].T @ one[y == k] for k in (0, 1)], pooled=0.0, round_=0.0)
    density = []
    for k in (0, 1):
        own = x[y == k]
        c = np.cov(own.T, bias=True)
        d = x - own.mean(0)
        density.append(np.log(len(own) / 500) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(density[1] - density[0], -35, 35))), atol=1e-5)


def test_statistics_of_odd_rows(odd, no_rows):
    out = odd.select(qda.features(F.col("text")).alias("x"))
    assert all(np.isfinite(r["x"]).all() and len(r["x"]) == qda.D for r in out.collect())
    labelled = no_rows.select(qda.features(F.col("text")).alias("x"), F.lit(1).alias("y"))
    model = qda.fit(labelled, "x", "y")
    assert {r["s"] for r in out.select(qda.score(F.col("x"), model).alias("s")).collect()} == {0.5}


def test_shingles_are_equal_for_equal_words_only():
    a = textbytes.shingles("The cat sat on the mat", 3)
    assert len(a) == 4
    assert len(np.intersect1d(a, textbytes.shingles("x the CAT  sat\non", 3))) == 2
    assert len(textbytes.shingles("a b", 3)) == 1 and len(textbytes.shingles("", 3)) == 0
    assert textbytes.shingles("a b", 3)[0] != textbytes.shingles("ab", 3)[0]


def test_rules_learn_from_one_text_of_an_id(spark, docs, monkeypatch):
    rows = [(7, f"text {i} of the id that many have") for i in range(40)] + [(i, f"the only text {i}") for i in range(3)] + [(None, "a b")]
    labels = spark.createDataFrame([(i, i % 2) for i in (0, 1, 2, 7)], "doc_id long, quality int")
    learned = []
    monkeypatch.setattr(quality_rules, "train", lambda packed, y: learned.append((len(packed), sorted(y))))
    quality_rules.fit(docs(rows), labels)
    assert learned == [(4, [0.0, 0.0, 1.0, 1.0])]
