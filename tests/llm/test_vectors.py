"""Operators over vectors, against plain Python and numpy."""

import hashlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from runlens.llm import centroids, hashing, qd, queries, whitening
from runlens.llm.vectors import squared
from runlens.session import materialise

DATA = "/root/testdata/sf0.01"
VECTORS = StructType(
    [StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("cluster", StringType()), StructField("row", LongType())]
)
NAN, INF = float("nan"), float("inf")


@pytest.fixture
def vectors(spark):
    """Rows (vec_id, embedding), with extra columns whose names the operators use themselves."""
    return lambda rows: spark.createDataFrame([(i, v, "x", 7) for i, v in rows], VECTORS)


def odd_vectors(width, n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=width).tolist()) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(60)]  # one common vector
    rows += [(None, rows[7][1]), (None, rng.normal(size=width).tolist()), (3, rows[9][1]), (3, rows[9][1]), (20, rows[11][1])]
    rows += [(900, None), (901, [None] * width), (902, [NAN] + [0.0] * (width - 1)), (903, [-INF] + [0.0] * (width - 1))]
    return rows


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def plain_clusters(rows, k, rounds, width):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if good(v) and len(v) == width]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    means = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(means))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(means)):
            own = [v for (_, v), n in zip(kept, of) if n == c]
            if own:
                means[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=repr), means


@pytest.mark.parametrize("k", [1, 5, 16, 400])
def test_clusters_are_exact(vectors, k):
    rows = odd_vectors(4)
    rows += [(950, [1.0, 2.0]), (951, [1.0] * 5), (952, [])]
    found = centroids.cluster(vectors(rows), "vec_id", "embedding", k=k, rounds=3, width=4)
    want, means = plain_clusters(rows, k, 3, 4)
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found.assigned.collect()), key=repr) == want
    assert {r["cluster"]: r["centroid"] for r in found.centroids.collect()} == dict(enumerate(means))
    per = {}
    for _, c, d in want:
        per[c] = per.get(c, 0) + d
    got = centroids.inertia(found).collect()
    assert {r["cluster"]: r["cluster_inertia"] for r in got} == per and {r["inertia"] for r in got} == {sum(per.values())}


def test_clusters_of_large_and_no_vectors(vectors):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 17), 3.0 + i]) for i in range(40)]
    found = centroids.cluster(vectors(rows), "vec_id", "embedding", k=4, rounds=2, width=2).assigned.collect()
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found), key=repr) == [(i, c, min(d, 1 << 62)) for i, c, d in plain_clusters(rows, 4, 2, 2)[0]]
    none = centroids.cluster(vectors([(1, None)]), "vec_id", "embedding", k=4, width=2)
    assert none.assigned.count() == 0 and centroids.inertia(none).count() == 0
    assert centroids.inertia(none).columns == ["cluster", "centroid", "cluster_inertia", "inertia"]


def test_the_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(1)
    middles = rng.integers(-5000, 5000, size=(64, 8))
    x = middles[rng.integers(0, 64, 3000)] + rng.integers(-9, 9, size=(3000, 8))
    at, best, measured = centroids.nearest(x, centroids.build(middles))
    exact = squared(x, middles)
    assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert measured < 0.6 * exact.size
    # equal centroids and points half-way between two
    line = np.array([[i * 2, 0] for i in range(20)] * 2)
    points = np.array([[i, 1] for i in range(40)])
    at, best, _ = centroids.nearest(points, centroids.build(line))
    exact = squared(points, line)
    assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all()


def brute_nearest(rows, k):
    """Query id -> all candidates by falling product: (product, vec_id)."""
    rows = [(i, np.array(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if good(v) and any(v))]
    out = {}
    for key, q in rows:
        if key is not None and key % 20 == 0:
            out.setdefault(key, []).extend((float(q @ v), i) for i, v in rows if i != key)
    return {key: sorted(found, key=lambda x: (-round(x[0], 12), x[1] is None, x[1] or 0))[:k] for key, found in out.items()}


def search(df, k=20):
    out = {}
    for r in hashing.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_search_of_odd_vectors(vectors):
    """With few rows every code is ranked again, so the lists are those of brute force."""
    rows = [r for r in odd_vectors(6, n=60) if r[0] != 20 or r[1] is None] + [(20, [0.0] * 6), (1000, [0.0] * 6), (21, [1.0, -2.0]), (40, [3.0])]
    got = search(vectors(rows), 100)
    want = brute_nearest([(i, v + [0.0] * (6 - len(v)) if v is not None else None) for i, v in rows], 100)
    assert set(got) == set(want) and len(got) == 5
    for key in want:
        assert len(got[key]) == len(want[key])
        assert np.allclose([s for s, _ in got[key]], [s for s, _ in want[key]])
        assert [i for _, i in got[key]] == [i for _, i in want[key]] or len({i for _, i in want[key]}) < len(want[key])
    assert search(vectors([])) == {} and search(vectors([(0, [0.0]), (20, None)])) == {} and search(vectors([(0, [1.0])])) == {}


def test_equal_vectors_give_the_smallest_ids(vectors):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(500)] + [(500 + i, [0.0, 1.0, i / 100]) for i in range(40)]
    got = search(vectors(rows))
    assert set(got) == {i for i in range(540) if i % 20 == 0}
    assert [i for _, i in got[480]] == list(range(20)) and [i for _, i in got[0]] == list(range(1, 21))
    assert all(len(x) == 20 for x in got.values())


def test_recall_against_brute_force(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 20)
    got = {}
    for r in queries.QUERIES["op12_hashing"](spark, DATA).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    hits = [(i in got[q], abs(got[q].get(i, s) - s)) for q, found in want.items() for s, i in found]
    assert np.mean([h for h, _ in hits]) >= 0.97 and max(e for _, e in hits) < 1e-12


@pytest.mark.parametrize("radius", [0, 5, 60, 200, 240, 511, 512])
def test_probing_finds_every_code_within_the_radius_once(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 63, size=(400, hashing.PARTS)).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, size=(400, 30), dtype=np.uint64)
    q = codes.copy()[:300]
    for i in range(300):
        for j in range(rng.integers(0, 30)):
            q[i, rng.integers(0, hashing.PARTS)] ^= flips[i, j]
    limits = hashing.radii(radius)
    assert sum(x + 1 for x in limits) >= radius + 1 or limits[0] == hashing.WORD
    found = [list(zip(*(x.tolist() for x in hashing.within(q, codes, p, limits, radius)))) for p in range(hashing.PARTS) if limits[p] >= 0]
    found = [x for part in found for x in part]
    apart = np.bitwise_count(q[:, None] ^ codes[None]).sum(2)
    want = {(i, j, apart[i, j]) for i, j in zip(*np.nonzero(apart <= radius))}
    assert len(found) == len(set(found)) and set(found) == want


def test_cells_and_blocks_lose_no_code(spark, monkeypatch):
    """Small cells, blocks and groups: the same pairs as brute force, for queries beyond the first radius too."""
    monkeypatch.setattr(hashing, "BLOCK", 16)
    monkeypatch.setattr(hashing, "GROUP", 8)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 16)), rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(200, 16))])
    coder = hashing.Coder(hashing.rotations(np.hstack([x, np.zeros((len(x), 1))])), float(np.linalg.norm(x, axis=1).max()))
    words = coder.words(x, False)
    rows = spark.createDataFrame(list(zip(range(len(x)), hashing.packed(np.arange(len(x)), words))), "row long, e binary")
    blocks, sizes, bits = hashing.index(rows, len(x))
    assert bits == 5 and blocks.select(F.max(F.size("entries"))).first()[0] < 64
    apart = np.bitwise_count(words[:40, None] ^ words[None]).sum(2)
    for radius in (40, 150, 512):
        got = {(r["query"], r["row"]): r["h"] for r in hashing.probe(rows.where("row < 40"), blocks, sizes, bits, radius, 500).collect()}
        assert got == {(i, j): apart[i, j] for i, j in zip(*np.nonzero(apart <= radius))}
        few = {(r["query"], r["row"]) for r in hashing.probe(rows.where("row < 40"), blocks, sizes, bits, radius, 3).collect()}
        limit = np.minimum(hashing.reach(np.sort(apart, axis=1)[:, 2]), radius)
        assert {(i, j) for i, j in zip(*np.nonzero(apart <= limit[:, None]))} <= few <= set(got)


def test_shares_of_queries_give_the_same_lists(spark, vectors, monkeypatch):
    """Queries in several shares, also those of one id: the same lists as at once. No vector of a pair is dealt by query."""
    rng = np.random.default_rng(12)
    rows = [(i % 150 or None, [float(c) for c in rng.normal(size=5)]) for i in range(400)]
    find = lambda: hashing.search(vectors(rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 7)
    once = find()
    dealt = [x for x in once._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(query#" in x]
    assert not any("asked#" in x for x in dealt)
    want = {(r["query_id"], r["rank"]): r for r in once.collect()}
    monkeypatch.setattr(hashing, "ASKED", 5 * 8 * 3)
    got = {(r["query_id"], r["rank"]): r for r in find().collect()}
    assert len(want) == 49 and got == want


def test_probing_meets_few_codes_of_a_large_table(spark, monkeypatch):
    """The sample is far smaller than the table: no round goes much beyond the radii that the queries need."""
    monkeypatch.setattr(hashing, "SAMPLE", 128)
    tried, needed, real = [], [], hashing.probe

    def noted(todo, blocks, sizes, bits, radius, k):
        found = materialise(real(todo, blocks, sizes, bits, radius, k))
        nearest = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("h"))).where(F.col("at") == k)
        needed.append(nearest.agg(F.max("h")).first()[0] or 0)
        tried.append(radius)
        return found

    monkeypatch.setattr(hashing, "probe", noted)
    x = np.random.default_rng(11).normal(size=(6000, 16))
    rows = [(i, [float(c) for c in v / np.linalg.norm(v)]) for i, v in enumerate(x)]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2)
    want = brute_nearest(rows, 2)
    assert set(got) == set(want) and all(len(v) == 2 for v in got.values())
    assert np.mean([i in [j for _, j in got[q]] for q, found in want.items() for _, i in found]) >= 0.9
    assert max(tried) <= hashing.reach(max(needed)) + 20, (tried, needed)


def test_the_radius_is_that_of_the_other_codes():
    """A query's own code in the sample doesn't make the radius small; equal codes do, and no sample leaves all codes."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, size=(1000, hashing.PARTS)).astype(np.uint64) << np.uint64(1)
    for n in (10**4, 10**5, 10**6, 10**7):  # 504 bits differ or not, by chance
        kth = NormalDist(252, 504**0.5 / 2).inv_cdf(21 / n)
        assert abs(hashing.likely_radius(codes[:100], codes, n, 20) - hashing.reach(kth)) <= 6
    radius, steps = hashing.likely_radius(codes[:100], codes, 10**6, 20), []
    while radius < hashing.BITS:
        steps.append(radius)
        radius = hashing.wider_radius(codes[:100], codes, 10**6, 20, radius)
    assert steps == sorted(set(steps)) and 3 <= len(steps) <= 5
    same = np.repeat(codes[:1], 50, axis=0)
    assert hashing.likely_radius(same, same, 1000, 5) == 0 and hashing.wider_radius(same, same, 1000, 5, 0) == hashing.BITS
    assert hashing.likely_radius(codes[:1], codes[:1], 10, 2) == hashing.likely_radius(codes, codes, 10, 20) == hashing.BITS


def test_pairs_are_handed_on_in_pieces(monkeypatch):
    """Whatever the radius, a piece is bounded; no pair within a query's own radius that may count is lost."""
    monkeypatch.setattr(hashing, "HELD", 2000)
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 63, size=(700, hashing.PARTS)).astype(np.uint64)
    apart = np.bitwise_count(codes[:300, None] ^ codes[None]).sum(2)
    entries, own = hashing.packed(np.arange(700), codes), rng.integers(0, hashing.BITS + 1, size=300)
    queries = [e + int(r).to_bytes(2, "big") for e, r in zip(entries, own)]
    pieces = list(hashing.pairs_of([(0, queries, entries[:400]), (0, queries, entries[400:])], hashing.BITS, 700))
    assert max(len(x) for x, _, _ in pieces) <= 2000 + hashing.SLICE * 400
    found = [x for piece in pieces for x in zip(*(c.tolist() for c in piece))]
    assert len(found) == len(set(found)) and set(found) == {(i, j, apart[i, j]) for i, j in zip(*np.nonzero(apart <= own[:, None]))}


def test_queries_ask_up_to_their_own_radius(spark):
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 1 << 63, size=(200, hashing.PARTS)).astype(np.uint64)
    rows = spark.createDataFrame(list(zip(range(200), hashing.packed(np.arange(200), codes))), "row long, e binary")
    blocks, sizes, bits = hashing.index(rows, 200)
    todo = rows.where("row < 30").withColumn("own", (230 + F.col("row")).cast("int"))
    got = {(r["query"], r["row"]) for r in hashing.probe(todo, blocks, sizes, bits, 250, 200).collect()}
    apart = np.bitwise_count(codes[:30, None] ^ codes[None]).sum(2)
    assert got == {(i, j) for i, j in zip(*np.nonzero(apart <= np.minimum(230 + np.arange(30), 250)[:, None]))}


MATRICES = {
    "plain": lambda rng: rng.normal(size=(200, 24)),
    "graded": lambda rng: rng.normal(size=(200, 24)) * np.logspace(0, -7, 24),
    "equal values": lambda rng: np.diag([4.0] * 8 + [2.0] * 16) @ np.linalg.qr(rng.normal(size=(24, 24)))[0],
    "identity": lambda rng: np.eye(24),
    "low rank": lambda rng: rng.normal(size=(200, 6)) @ rng.normal(size=(6, 24)),
    "zero columns": lambda rng: rng.normal(size=(200, 24)) * (np.arange(24) % 5 > 0),
    "one": lambda rng: rng.normal(size=(9, 1)),
    "two": lambda rng: rng.normal(size=(9, 2)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_vectors(name):
    a = MATRICES[name](np.random.default_rng(2))
    r = np.linalg.qr(a, mode="r")
    want = np.linalg.svd(r, compute_uv=False) ** 2
    k = int((want > 1e-20 * want[0]).sum())
    values, v = qd.principal(r, k)
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-11
    assert np.abs(r.T @ r @ v - v * values[:k]).max() < 1e-13 * want[0]


def test_zero_matrix():
    values, v = qd.principal(np.zeros((3, 3)), 0)
    assert values.tolist() == [0, 0, 0] and v.shape == (3, 0)


def plain_whitening(rows, width, components):
    kept = [(i, [int(np.floor(64 * x)) + 1_000_000 for x in v] + [1_000_000] * (width - len(v))) for i, v in rows if good(v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    lifted = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], dtype=np.float64) / n
    e, v = np.linalg.eigh(lifted.T @ lifted / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in kept:
        y = [n * a - s for a, s in zip(x, sums)]
        z = (np.array(y, dtype=np.float64) / n) @ v / np.sqrt(np.maximum(e, 1e-30))
        out += [(i, c + 1, n, sum(d * d for d in y), z[c], e[c] / e.sum()) for c in range(min(components, int((e > 1e-12 * e[0]).sum())))]
    return out


def same_whitening(got, want):
    assert len(got) == len(want)
    key = lambda r: (repr(r[0]), r[1], r[3], abs(round(r[4], 6)))
    got = sorted(((r["id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key)):
        assert a[:4] == b[:4] and abs(abs(a[4]) - abs(b[4])) < 1e-7 and abs(a[5] / b[5] - 1) < 1e-9


def test_whitening_of_odd_vectors(vectors):
    rows = odd_vectors(5) + [(950, [1.0, 2.0]), (951, [1.0, 2.0, 0.0, 0.0, 0.0]), (952, [])]
    got = whitening.whiten(vectors(rows), "vec_id", "embedding", components=4).collect()
    same_whitening(got, plain_whitening(rows, 5, 4))
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    # one sign for all rows of a component: the whitened fit list has mean 0 and no correlation
    first = {r["id"]: r["whitened"] for r in got if r["component"] == 1 and r["id"] is not None and r["id"] < 180 and r["id"] not in (3, 20)}
    assert first[5] == first[120]


def test_whitening_without_variance(vectors):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(50)]
    same_whitening(whitening.whiten(vectors(line), "vec_id", "embedding").collect(), plain_whitening(line, 3, 1))
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, [])]):
        none = whitening.whiten(vectors(rows), "vec_id", "embedding")
        assert none.count() == 0 and none.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_triangles_are_merged_in_rounds(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rows = [(i, np.random.default_rng(i).normal(size=6).tolist()) for i in range(300)]
    got = whitening.whiten(vectors(rows).repartition(40), "vec_id", "embedding", components=6).collect()
    same_whitening(got, plain_whitening(rows, 6, 6))


def test_whitened_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = queries.QUERIES["op13_whitening"](spark, DATA).withColumnRenamed("vec_id", "id").collect()
    same_whitening(got, plain_whitening(rows, 64, 16))
