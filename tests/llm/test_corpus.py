"""Operators over the whole corpus, against plain Python and SQL."""

import itertools
import random
import re
import zlib

import numpy as np
import oracle
import pyarrow as pa
import pytest
from llm_rows import docs, no_rows, odd  # noqa: F401
from pyspark.sql import functions as F

from runlens.llm import licenses, lineruns, links, neardup, queries, sharding, substring, topk
from runlens.llm.textbytes import shingles


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    found = oracle.differences(con, queries.QUERIES[name](spark, DATA), queries.ORACLES[name])
    assert not found, "\n".join(found)


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_license_scan_of_odd_rows(docs, odd, no_rows):
    rows = [(1, "x MIT\nLicense mit license"), (2, "cc by cc by by"), (3, "the apache  license, apache"), (None, "cc-by"), (None, "cc-by"), (7, "mitlicense émit license")]
    out = {(r["doc_id"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs(rows)).collect()}
    assert out == {(1, 2, 1, 3, "mit"), (2, 2, 0, 2, "cc-by"), (3, 1, 1, 1, "apache"), (None, 1, 0, 0, "cc-by"), (7, 0, None, None, "")}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(no_rows).count() == 0


def test_template_containment_is_exact(spark, docs):
    rng = random.Random(5)
    known = licenses.templates()
    pool = sorted({w for t in known for w in t.words})
    rows = []
    for i in range(300):
        t = rng.choice([t for t in known if not t.whole])
        rows.append((i, " ".join(rng.sample(t.words, rng.randint(1, len(t.words))) + rng.sample(pool, 4))))
    found = licenses.blocks(licenses.keyed(docs(rows), "doc_id", "text"), "text", known)
    got = {(r["__id"], r["template"]) for r in licenses.join(found, known).where("block >= 0").collect()}
    want = {(i, n) for i, text in rows for n, t in enumerate(known) if not t.whole and len(set(text.split()) & set(t.words)) >= t.need}
    assert got == want and want


def plain_labels(text):
    """Labels and best share by lines and by windows around the line feeds of a paragraph, one after another."""
    found, paragraphs = {}, [[]]

    def meet(words, t):
        share = len(set(words) & set(t.words)) / len(set(t.words))
        if share >= licenses.THRESHOLD - 1e-9:
            found[t.label] = max(share, found.get(t.label, 0))

    known = [t for t in licenses.templates() if not t.whole]
    for line in text.split("\n"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.translate({c: c + 32 for c in range(65, 91)}))
        for t in known:
            meet(words, t)
        if words:
            paragraphs[-1].append(words)
        if not words or line.rstrip(" \t\r)]\"'*").endswith((".", "!", "?")):
            paragraphs.append([])
    for lines in paragraphs:
        for i in range(1, len(lines)):
            before, after = sum(lines[:i], []), sum(lines[i:], [])
            for t in known:
                meet(before[-len(t.words) :] + after[: len(t.words)], t)
    return found


def test_license_windows_against_brute_force(spark, docs):
    """Notices with words left out, wrapped at any width behind comment marks, broken by stops and empty lines."""
    rng, fill = random.Random(12), vocabulary(30, 9)
    notices = [t.words for t in licenses.templates() if not t.whole]
    rows = []
    for n in range(400):
        words = []
        for _ in range(rng.randint(1, 3)):
            words += [rng.choice(fill) for _ in range(rng.randint(0, 6))]
            words += [w.upper() if rng.random() < 0.1 else w for w in rng.choice(notices) if rng.random() > 0.12]
        wrap, text = rng.choice([2, 3, 5, 9, 40]), ""
        for w in words:
            text += w + rng.choices([" ", "\n", ".\n", "\n\n", '." \n', ". ", "\r\n", "\n # "], [30, 30 / wrap, 0.3, 0.3, 0.3, 1, 1, 1])[0]
        rows.append((n, rng.choice(["", "\n", "* "]) + text))
    want = {n: plain_labels(text) for n, text in rows}
    assert sum(map(bool, want.values())) > 150
    data = docs(rows)
    got = {}
    for r in licenses.scan(data).collect():
        own = {x for x in r["labels"].split(",") if x} - set(licenses.PHRASES.values())
        got[r["doc_id"]] = own, r["score"] if not r["n_base"] else None
    assert {n: g[0] for n, g in got.items()} == {n: set(w) for n, w in want.items()}
    for n, (_, score) in got.items():
        assert score is None or score == pytest.approx(max(want[n].values(), default=0))
    fresh = oracle.duckdb.connect()
    fresh.register("documents", pa.table({"doc_id": [n for n, _ in rows], "text": [x for _, x in rows]}))
    assert not oracle.differences(fresh, licenses.scan(data), queries.ORACLES["op3_license_scan"])


def test_wrapped_license_notices(docs):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    gpl = "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published"
    narrow = "\r\n".join(f" * {w}" for w in "This is free and unencumbered software released into the public domain".split())
    rows = [(1, bsd), (2, f"Some words.\n\n{gpl}"), (3, narrow + "\n"), (4, bsd.replace("\n", "\n\n")), (5, "\n# " + bsd.replace("\n", "\n# \t"))]
    rows += [(7, "Viele Worte mit.\nLicensed under the Apache License, Version 2.0.\nmit Worten"), (6, "Redistribution and use in source and\n" + "other words here\n" * 40 + "binary forms with or without modification are permitted")]
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs(rows)).collect()}
    assert out == {1: ("bsd", 1.0), 2: ("gpl,gpl-notice", 1.0), 3: ("unlicense", 1.0), 4: ("", 0.0), 5: ("bsd", 1.0), 6: ("", 0.0), 7: ("apache,apache-2.0", 1.0)}


def check_shards(rows, tolerance):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(8))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(8)]
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * max(tolerance * sum(sizes) / 8, largest) + 1


def test_op5(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_sharding"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    check_shards(rows, 0.002)


def test_a_hot_text_is_spread_and_others_stay_together(docs):
    rng, words = random.Random(2), vocabulary(50, 3)
    rows = [(i, "the same text") for i in range(2000)] + [(2000 + i, prose(rng, words, rng.randint(1, 30))) for i in range(3000)]
    rows += [(9000 + i, f"copy {i % 50}") for i in range(200)]
    out = sharding.shard(docs(rows).withColumn("name", F.col("text")), "doc_id", "text").collect()
    assert len(out) == len(rows)
    check_shards(out, 0.002)
    of = {}
    for r in out:
        of.setdefault(r["name"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in of.values()) <= 8


def test_shards_of_odd_rows(odd, no_rows):
    out = sharding.shard(odd, "doc_id", "text").collect()
    assert len(out) == odd.count() and sum(r["size"] == 1 for r in out) == 3
    assert sharding.shard(no_rows, "doc_id", "text").count() == 0


def brute_topk(rows, k):
    whole = {}
    for i, (key, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = (key, [int(np.floor(64 * x)) for x in v])
    out = set()
    for key, q in whole.values():
        if key is not None and key % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), key2 is None, key2) for key2, v in whole.values() if key2 != key)
            out |= {(key, n, key2, -s) for n, (s, _, key2) in enumerate(scored[:k], 1)}
    return out


def test_topk_with_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1 + i % 3, 6).tolist()) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(60)]
    rows += [(None, [9.0] * 6), (501, None), (502, [None] + [1.0] * 5), (520, [float("nan")] * 6), (540, [float("inf")] * 6), (560, [1e6] * 6), (580, [2e7] * 6), (600, [1.0, 2.0]), (620, [])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(data, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, pivots=12)
    assert {tuple(r) for r in got.collect()} == brute_topk(rows, 20)
    assert topk.search(data.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0
    few = data.where("vec_id < 5")
    assert topk.search(few, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 4


def test_topk_with_repeated_query_ids(spark):
    """Rows of one id fill a tight cell; a query id's result is taken over all of its rows, as in the SQL."""
    rng = np.random.default_rng(6)
    rows = [(20, [8.0, 0.0, 0.0])] * 30 + [(None, [0.0, 0.0, 9.0])] * 25 + [(None, rng.normal(0, 1, 3).tolist())]
    rows += [(i, rng.normal(0, 1 + i % 3, 3).tolist()) for i in range(21, 300)] + [(40, rng.normal(0, 2, 3).tolist()) for _ in range(7)]
    whole = [(key, [int(np.floor(64 * x)) for x in v]) for key, v in rows]
    want = []
    for key in {key for key, _ in whole if key is not None and key % 20 == 0}:
        pairs = [(sum(a * b for a, b in zip(q, v)), other) for own, q in whole if own == key for other, v in whole if other != key]
        pairs.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0))
        want += [(key, n, other, score) for n, (score, other) in enumerate(pairs[:20], 1)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for pivots in (3, 48, 400):
        got = topk.search(data, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, pivots=pivots).collect()
        assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
        # alone in its group, where no other query asks for more cells
        got = topk.search(data, "vec_id", "embedding", F.col("vec_id") == 20, 20, pivots=pivots).collect()
        assert sorted(map(tuple, got)) == sorted(w for w in want if w[0] == 20)


def test_topk_replicates_what_is_near(spark):
    """Of 40 clusters, a group of queries gets the vectors of few; hot equal vectors count as one cluster's few ids."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (40, 32))
    rows = [(i, (3 * centres[i % 40] + rng.normal(0, 0.05, 32)).tolist()) for i in range(4000)]
    rows += [(4000 + i, (3 * centres[7]).tolist()) for i in range(2000)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    is_query = F.pmod("vec_id", F.lit(20)) == 0
    got = topk.search(data, "vec_id", "embedding", is_query, 20, group=16)
    assert {tuple(r) for r in got.collect()} == brute_topk(rows, 20)
    join = topk.divided(data, "vec_id", "embedding", is_query, 20, 64.0, topk.PIVOTS, 16)
    groups, kept = join.queries.count(), join.data.count()
    assert kept == 4000 + 21 and groups >= 300 / 16
    assert join.bounds.count() < 0.5 * groups * join.data.select("cell").distinct().count()
    assert join.replicated().count() < 0.25 * groups * kept


def plain_earlier(rows):
    """Units of each row that occur earlier, by their words."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        data = text.encode()
        starts, ends, size, _ = substring.units(text)
        for i, (a, b, n) in enumerate(zip(starts, ends, size)):
            unit = tuple(data[a:b].decode().lower().split())
            if n >= substring.UNIT_WORDS and seen.setdefault(unit, (doc_id, i)) != (doc_id, i):
                out.setdefault(doc_id, set()).add(i)
    return out


def test_passages_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    earlier = plain_earlier(rows)
    want = {(d, a, b, n) for d, text in rows for a, b, n, _ in substring.passages(text, earlier.get(d, set()))}
    got = {(r["doc_id"], r["start"], r["end"], r["n_words"]) for r in queries.QUERIES["op7_substring_dedup"](spark, DATA).collect()}
    assert got == want and want


def test_planted_passage_goes_from_all_but_the_first(docs, odd, no_rows):
    rng, words = random.Random(8), vocabulary(400, 9)
    sentence = lambda n: prose(rng, words, n).capitalize() + "."
    passage = " ".join(sentence(11) for _ in range(6))
    rows, clean = [], {}
    for i in range(60):
        own = [" ".join(sentence(rng.randint(4, 12)) for _ in range(4)) for _ in range(5)]
        clean[i] = "\n".join(own)
        if i % 3 == 0:
            own[2] += " " + passage if i % 2 else "\n" + passage
        rows.append((i, "\n".join(own)))
    out = {r["doc_id"]: r for r in substring.dedup(docs(rows).withColumn("removed", F.lit(0))).collect()}
    for i, text in rows:
        assert out[i]["text"] == (text if i == 0 else clean[i])
        assert [(x["n_words"], x["kept_id"]) for x in out[i]["removed"]] == ([(66, 0)] if i % 3 == 0 and i else [])
        for x in out[i]["removed"]:
            assert text.encode()[x["start"] : x["end"]].decode() == passage
    assert substring.dedup(odd).count() == odd.count() and substring.dedup(no_rows).count() == 0


def test_passages_within_sentences_and_in_any_script(docs):
    rng, words = random.Random(18), vocabulary(900, 19)
    plain = prose(rng, words, 80)
    cut = prose(rng, words, 15) + ". " + prose(rng, words, 60).capitalize()
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    block, sentences = signs(150), "".join(signs(30) + "。" for _ in range(5))
    rows = []
    for i in range(12):
        around = [prose(rng, words, 12) for _ in range(5)]
        rows += [(i, f"{around[0]} {plain} {around[1]}"), (100 + i, f"{around[2].capitalize()} {cut} {around[3]}.")]
        rows += [(200 + i, f"{around[4]}\n{block}\n{signs(40)}"), (300 + i, f"{signs(30)}。{sentences}{signs(30)}")]
    out = {r["doc_id"]: r for r in substring.dedup(docs(rows)).collect()}
    for i, text in rows:
        spans = [text.encode()[x["start"] : x["end"]].decode() for x in out[i]["removed"]]
        if i % 100 == 0:
            assert not spans and out[i]["text"] == text
        elif i < 200:
            assert len(spans) == 1 and spans[0] in (plain if i < 100 else cut) and len(spans[0].split()) >= 50
        else:
            assert spans == [block if i < 300 else sentences]


def test_runs_level_up_and_keep_counts(spark):
    runs = lineruns.LineRuns(spark, settled=3, fanout=2)
    want = {}
    for batch in range(7):
        digests = [bytes([d]) for d in range(20) if (d + batch) % (d % 5 + 1) == 0]
        for d in digests:
            want[d] = want.get(d, 0) + 1
        runs.add(spark.createDataFrame([(bytearray(d),) for d in digests], "digest binary"))
    assert max(map(len, runs.levels)) < 2 and len(runs.levels) == 3
    got = {bytes(r["digest"]): r["n"] for r in runs.counts().collect()}
    assert {d for d, n in got.items() if n >= 3} == {d for d, n in want.items() if n >= 3}


def test_lines_of_odd_rows(docs, odd, no_rows):
    rows = [(i, f"own {i}\n  Common line \nlast") for i in range(10)] + [(None, "common LINE\t"), (11, None), (12, "\n\n")]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lineruns.dedup(docs(rows)).collect()}
    assert out[3] == ("own 3", 3, 2) and out[None] == ("", 1, 1) and out[11] == ("", 1, 0) and out[12] == ("\n\n", 3, 0)
    assert lineruns.dedup(odd).count() == odd.count() and lineruns.dedup(no_rows).count() == 0


def brute_components(rows, k, percent):
    own = {i: set(shingles(t, k).tolist()) for i, t in rows}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(own, 2):
        n = len(own[a] & own[b])
        if own[a] and own[b] and 100 * n >= percent * (len(own[a]) + len(own[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in own}


def test_near_groups_of_all_sizes(docs, monkeypatch):
    """Small leaves, so that nodes branch and stay large."""
    monkeypatch.setattr(neardup, "LEAF", 8)
    monkeypatch.setattr(neardup, "DEPTH", 2)
    rng, words = random.Random(21), vocabulary(900, 22)
    rows = []
    for size in (1, 1, 1, 2, 3, 10, 120, 40):
        base = prose(rng, words, 120).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    shared = prose(rng, words, 30)
    rows += [(len(rows) + i, shared + " " + prose(rng, words, 60)) for i in range(80)]
    got = {r["__id"]: r["component_id"] for r in neardup.link(docs(rows)).collect()}
    assert got == brute_components(rows, 3, 85)


def test_large_group_of_loose_copies(docs, monkeypatch):
    """Copies around the threshold, compared in many small blocks."""
    for name, value in (("LEAF", 24), ("SMALL", 4), ("PROBES", 7), ("BLOCK", 16)):
        monkeypatch.setattr(neardup, name, value)
    rng, words = random.Random(31), vocabulary(900, 32)
    base, rows = prose(rng, words, 120).split(), []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    got = {r["__id"]: r["component_id"] for r in neardup.link(docs(rows)).collect()}
    want = brute_components(rows, 3, 85)
    assert 10 < len(set(want.values())) < 140
    assert got == want


def test_joining_links_components_once():
    own = [bytes(shingles(t, 1).tobytes()) for t in ("a b c d", "a b c d e", "a b c d f", "x y")]
    rows = {"probe": [True, True, False, False, False], "digest": [b"0", b"3", b"1", b"2", b"3"],
            "root": [b"0", b"3", b"1", b"1", b"3"], "set": [own[0], own[3], own[1], own[2], own[3]]}
    links = neardup.joining(80)(pa.table(rows)).to_pylist()
    assert links == [{"a": b"0", "b": b"1"}]
    assert neardup.joining(80)(pa.table({k: v[:2] for k, v in rows.items()})).num_rows == 0


def test_near_dedup_of_odd_rows(docs, odd, no_rows):
    linked = neardup.link(odd).collect()
    assert len(linked) == odd.count()
    assert all(r["component_id"] == r["__id"] for r in linked if r["n_shingles"] == 0)
    rows = [(5, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (9, None), (8, ""), (None, "a b c d e f"), (7, "a b")]
    out = sorted((r["doc_id"] for r in neardup.dedup(docs(rows).withColumn("n", F.lit(1))).collect()))
    assert out == [2, 7, 8, 9]
    assert neardup.dedup(no_rows).count() == 0


def test_trees_follow_the_threshold():
    for percent, n in ((85, 12), (80, 18)):
        assert neardup.trees(percent) == n
        assert 1 - (1 - (percent / 100) ** (neardup.DEPTH + 1)) ** n >= neardup.RECALL
    assert neardup.trees(100) == 1 and neardup.trees(1) == neardup.SKETCH


def test_near_dedup_keeps_unlinked_texts_of_null_and_repeated_ids(docs):
    rng, words = random.Random(41), vocabulary(900, 42)
    own = [prose(rng, words, 40) for _ in range(8)]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (None, own[2]), (4, own[3]), (4, own[4]), (4, own[5]), (4, ""), (4, None), (None, "")]
    rows += [(4, own[6] + " a b"), (9, own[6]), (None, own[7] + " c"), (None, own[7])]
    out = neardup.dedup(docs(rows)).collect()
    assert len(out) == len({tuple(r) for r in out})
    kept = [(r["doc_id"], r["text"] or "") for r in out]
    copies = {(None, own[7] + " c"), (None, own[7])}
    assert len(copies & set(kept)) == 1
    assert sorted(set(kept) - copies, key=str) == sorted({(i, t or "") for i, t in rows} - copies - {(9, own[6])}, key=str)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    got = dict(links.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    root = {v: v for p in pairs for v in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if v != r}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    assert 0 < len(kept["near_dedup"]) < len(kept["line_dedup"]) <= len(kept["quality_rules"]) < len(texts)
    near = brute_components(sorted(kept["line_dedup"].items()), 5, 80)
    assert set(kept["near_dedup"]) == set(near.values())
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(kept["substring_dedup"])


def test_pipeline_keeps_one_of_many_equal_texts(spark, docs):
    """From the output of the first stage on: 12 equal texts, 11 near copies, one line in every document."""
    import corpus_pipeline

    rng, words = random.Random(51), vocabulary(900, 52)
    text = lambda: "\n".join(prose(rng, words, 12) for _ in range(6))
    hot, near, line = text(), text(), "this line stands in every document of the table"
    rows = [(100 + i, f"{line}\n{text()}") for i in range(15)]
    rows += [(200 + i, hot) for i in range(10)] + [(None, hot)] * 2 + [(300 + i, f"{near}\n{words[i]} {words[i + 20]}") for i in range(11)]
    out = docs(rows)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, out, DATA).cache()
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert [i for i, t in kept if hot in t] == [200] and [i for i, t in kept if near in t] == [300]
    assert [i for i, t in kept if line in t] == [100]
    assert {i for i, _ in kept} >= {100 + i for i in range(15)}
