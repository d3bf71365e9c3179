"""N-gram join, neighbour search and top-k against brute force."""

import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tidepanel.llm import components, jaccard, neighbours, topk

FIELDS = "ts_code long, features array<float>, score string, rank int, vec string, key int"


def brute_groups(rows, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        n = min(words, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if sets[i] and key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return Counter((key, len(sets[i]), least.get(top(i)) if sets[i] else key) for i, (key, _) in enumerate(rows))


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, words, percent):
    rng = random.Random(words)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    long = [f"v{rng.randrange(5000)}" for _ in range(900)]
    texts = [edited(rng, base, rng.randrange(0, 9)) for _ in range(120)]  # a large family near the threshold
    texts += [edited(rng, long, rng.randrange(0, 60)) for _ in range(20)]
    texts += [" ".join([*base[:40], *(f"u{i}_{j}" for j in range(60))]) for i in range(30)]  # a passage that many share
    texts += ["Same Words here now and then"] * 5 + ["same  words\there NOW and then", "a b c", "A B C", "a b", None, None, "", " \n", "é É", "É É"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[-1] = None
    rows = list(zip(ids, texts))
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "external_id long, content_text string, node int, group_id string, size int")
    got = jaccard.near_duplicates(table.repartition(5), words=words, percent=percent)
    assert got.columns == ["external_id", "n_tokens", "group_id"]
    assert Counter(map(tuple, got.collect())) == brute_groups(rows, words, percent)


def test_join_blocks_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 8)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, edited(rng, base, rng.randrange(1, 5))) for i in range(70)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "external_id long, content_text string"), words=4, percent=85)
    assert Counter(map(tuple, got.collect())) == brute_groups(rows, 4, 85)


def test_join_of_nothing(spark):
    table = spark.createDataFrame([(1, None), (None, "")], "external_id long, content_text string")
    assert sorted(map(str, map(tuple, jaccard.near_duplicates(table).collect()))) == sorted(map(str, [(1, 0, 1), (None, 0, None)]))
    assert jaccard.near_duplicates(table.limit(0)).collect() == []


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


def exposures(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", 1, "b", 2) for i, v in zip(ids or range(len(vectors)), vectors)], FIELDS)


def doubles(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "ts_code long, features array<double>")


def odd_vectors(n, dims, seed, dups=0):
    rng = np.random.default_rng(seed)
    x = np.float32(rng.normal(size=(n, dims)) / 4).tolist()
    x += [x[0]] * dups
    return x + [None, [], [0.0] * dims, [float("nan")] * dims, [None] * dims, [1.0] * (dims - 1), [float("inf")] + [0.0] * (dims - 1)]


@pytest.mark.parametrize("n,dups", [(15, 0), (700, 90)])
def test_top_k_equals_brute_force(spark, n, dups, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(topk, "CELL_BLOCKS", 8)
    monkeypatch.setattr(topk, "CELL_QUERIES", 16)
    vectors = odd_vectors(n, 12, 1, dups)
    units = {i: np.floor(np.array(v, dtype=np.float64) * 64) for i, v in enumerate(vectors) if v and len(v) == 12 and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in units if i % 5 == 0):
        best = sorted(((-int(units[q] @ v), i) for i, v in units.items() if i != q))[:20]
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    got = topk.top_exposures(exposures(spark, vectors), "ts_code % 5 = 0")
    assert got.columns == ["query_code", "rank", "ts_code", "score"]
    rows = list(map(tuple, got.collect()))
    assert set(rows) == want and len(rows) == len(want)


def test_top_k_odd_tables(spark):
    assert topk.top_exposures(exposures(spark, [[1.0, 2.0]]).limit(0), "ts_code % 5 = 0").collect() == []
    assert topk.top_exposures(exposures(spark, [None, [float("nan")]]), "true").collect() == []
    twice = exposures(spark, [[1.0, 0.0], [1.0, 0.0], [0.5, 0.0]], ids=[0, 0, 1])
    assert sorted(map(tuple, topk.top_exposures(twice, "ts_code = 1").collect())) == [(1, 1, 0, 64 * 32)]
    far = doubles(spark, [[1e306, 0.0], [1e308, 1.0], [1.0, 0.0]])  # 64e308 is no double
    assert set(map(tuple, topk.top_exposures(far, "true").collect())) == {(0, 1, 2, None), (2, 1, 0, None)}


@pytest.mark.parametrize("size", [1e6, 1e8, 1e14, 1e160, None])
def test_top_k_of_large_components(spark, monkeypatch, size):
    """Scores beyond 2**53 are ranked in whole numbers, ties and neighbours by one unit included."""
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(topk, "CELL_BLOCKS", 4)
    monkeypatch.setattr(topk, "CELL_QUERIES", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 8))
    x = x * size if size else x * 10.0 ** rng.integers(-2, 12, size=(240, 1))
    x[100:130] = x[100]
    x[110:120, 0] += 1 / 64
    units = [[Fraction(v) * 64 // 1 for v in row] for row in x.tolist()]
    want = set()
    for q in range(0, len(x), 5):
        best = sorted((-sum(a * b for a, b in zip(units[q], v)), i) for i, v in enumerate(units) if i != q)[:20]
        want |= {(q, rank + 1, i, -s if abs(s) < 1 << 63 else None) for rank, (s, i) in enumerate(best)}
    rows = list(map(tuple, topk.top_exposures(doubles(spark, x.tolist()), "ts_code % 5 = 0").collect()))
    assert set(rows) == want and len(rows) == len(want)


def recall(spark, vectors, lists, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_VECTORS", lists)
    monkeypatch.setattr(neighbours, "CHUNK_VECTORS", 64)
    table = exposures(spark, vectors)
    valid = {i: np.array(v, dtype=np.float64) for i, v in enumerate(vectors) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    rows = neighbours.nearest_stocks(table, table.where("ts_code % 5 = 0")).collect()
    found = {}
    for r in rows:
        assert abs(r.score - valid[r.query_code] @ valid[r.ts_code]) < 1e-12
        found.setdefault(r.query_code, []).append((r.rank, -r.score, r.ts_code))
    hits = total = 0
    for q in (i for i in valid if i % 5 == 0):
        hit = sorted(found[q])
        assert [h[0] for h in hit] == list(range(1, len(hit) + 1)) and [h[1:] for h in hit] == sorted(h[1:] for h in hit)
        best = sorted((-(valid[q] @ v), i) for i, v in valid.items() if i != q)[:20]
        assert len(hit) == len(best)
        hits += len({i for _, i in best} & {h[2] for h in hit})
        total += len(best)
    return hits / total


def test_neighbours_reach_the_recall(spark, monkeypatch):
    assert recall(spark, odd_vectors(1500, 16, 3, 60), 100, monkeypatch) >= 0.9
    assert recall(spark, odd_vectors(12, 16, 4), 100, monkeypatch) == 1.0


def test_the_fit_of_the_index_takes_little_memory():
    sample = np.random.default_rng(1).normal(size=(20_000, 64))
    tracemalloc.start()
    index = neighbours.fit_index(np.arange(len(sample)), sample, 64, float(np.linalg.norm(sample, axis=1).max()), 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and len(index.home) == len(sample)
    rows, lists = index.lists_of_vectors(sample[:500])
    assert np.array_equal(index.home[:500], lists[np.unique(rows, return_index=True)[1]])


def test_neighbours_of_given_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as ts_code", "embedding as features")
    rows = {r.ts_code: np.array(r.features, dtype=np.float64) for r in table.collect()}
    found = {}
    for r in neighbours.nearest_stocks(table, table.where("ts_code % 20 = 0")).collect():
        found.setdefault(r.query_code, set()).add(r.ts_code)
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    share = [len(found[q] & set(ids[np.argsort(-np.where(ids == q, -9, x @ rows[q]), kind="stable")[:20]].tolist())) / 20 for q in found]
    assert len(found) == sum(i % 20 == 0 for i in rows) and np.mean(share) >= 0.9


def test_neighbours_odd_tables(spark):
    none = exposures(spark, [None, [0.0, 0.0]])
    assert neighbours.nearest_stocks(none, none).collect() == []
    twice = exposures(spark, [[1.0, 0.0], [0.5, 0.0], [0.25, 0.0]], ids=[0, 0, 1])
    assert sorted(map(tuple, neighbours.nearest_stocks(twice, twice.where("ts_code = 1")).collect())) == [(1, 1, 0, 0.25)]
    assert neighbours.nearest_stocks(twice, twice.limit(0)).collect() == []


def by_code(vectors, ids, queries):
    """Brute force: the 20 codes with the best scores, a code counted once."""
    want = {}
    for q in queries:
        best = {}
        for own in (v for i, v in zip(ids, vectors) if i == q):
            for i, v in zip(ids, vectors):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.array(own) @ np.array(v)))
        want[q] = sorted(((-s, i) for i, s in best.items()))[:20]
    return want


@pytest.mark.parametrize("copies", [1, 2, 25])
def test_repeated_codes_take_one_place_each(spark, copies):
    rng = np.random.default_rng(8)
    base = np.float32(rng.normal(size=(60, 8)) / 4).astype(float)
    vectors, ids = np.repeat(base, copies, axis=0), np.repeat(np.arange(60), copies).tolist()
    for shift in (0.0, 1e-3):  # equal rows, then a code with many vectors
        moved = np.float32(vectors + shift * rng.normal(size=vectors.shape)).astype(float)
        table = exposures(spark, moved.tolist(), ids)
        rows = neighbours.nearest_stocks(table, table.where("ts_code % 20 = 0")).collect()
        got = {q: [r.ts_code for r in sorted((r for r in rows if r.query_code == q), key=lambda r: r.rank)] for q in (0, 20, 40)}
        assert got == {q: [i for _, i in best] for q, best in by_code(moved.tolist(), ids, (0, 20, 40)).items()}


def test_a_hot_code_is_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_VECTORS", 32)
    seen = spark.sparkContext.accumulator(0)
    plain = neighbours._kth_of_codes

    def counted(scores, keys, k):
        if scores.shape[1] > 120:
            seen.add(1)
        return plain(scores, keys, k)

    monkeypatch.setattr(neighbours, "_kth_of_codes", counted)
    rng = np.random.default_rng(9)
    vectors = np.float32(rng.normal(size=(900, 8)) / 4).astype(float).tolist()
    ids = [7 if i % 3 == 0 else 1000 + i for i in range(900)]
    table = exposures(spark, vectors, ids)
    rows = neighbours.nearest_stocks(table, table.where("ts_code = 7 or ts_code = 1001")).collect()
    want = by_code(vectors, ids, (7, 1001))
    assert {q: [r.ts_code for r in sorted((r for r in rows if r.query_code == q), key=lambda r: r.rank)] for q in (7, 1001)} == {q: [i for _, i in b] for q, b in want.items()}
    assert seen.value == 0


def test_top_k_counts_a_code_of_many_vectors_once(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 16)
    rng = np.random.default_rng(10)
    vectors = np.float32(np.repeat(rng.normal(size=(40, 8)), 25, axis=0) + rng.normal(size=(1000, 8)) / 8).astype(float)
    ids = np.repeat(np.arange(40), 25).tolist()
    units = np.floor(vectors * 64)
    got = topk.top_exposures(exposures(spark, vectors.tolist(), ids), "ts_code % 20 = 0").collect()
    want = {(q, rank + 1, i, int(-s)) for q, best in by_code(units.tolist(), ids, (0, 20)).items() for rank, (s, i) in enumerate(best)}
    assert set(map(tuple, got)) == want and len(got) == len(want) == 40


def test_postings_are_shuffled_once(spark):
    """The postings of tokens that several nodes hold come from one shuffle of all postings, at any size."""
    rows = [(t, n, n % 3) for n in range(30) for t in (n // 2, 100 + n, 200 + n // 10)]
    postings = spark.createDataFrame(rows, "token long, node long, step int")
    got = jaccard._shared(postings)
    want = {r for r in rows if r[0] < 100 or r[0] >= 200}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and got.columns == ["token", "node", "step"]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
