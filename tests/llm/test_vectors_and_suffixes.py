"""Whitening, hard negatives and suffix sorting against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import negatives, suffixes, whitening

STOCKS = "ts_code long, industry string, features array<float>, units string, mark int, label int, score int, code int"


def stocks(rows):
    return [(c, i, f, "x", 1, 2, 3, 4) for c, i, f in rows]


def taking_part(rows):
    rows = [r for r in rows if r[2] is not None and len(r[2]) and all(x is not None and np.isfinite(x) for x in r[2])]
    count = Counter(len(r[2]) for r in rows)
    width = min(count, key=lambda k: (-count[k], k), default=0)
    return [r for r in rows if len(r[2]) == width]


def units(rows, scale):
    return [[int(np.floor(scale * float(np.float32(x)))) for x in r[2]] for r in rows]


def odd_vectors(rng):
    rows = [(i, f"i{rng.integers(4)}", [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(240)]
    rows += [rows[10], rows[10], (20, None, rows[3][2]), (None, "i1", rows[4][2]), (500, "i0", None), (501, "i0", []), (502, "i0", [1.0] * 3), (503, "i0", [float("nan")] * 8),
             (504, "i2", [float("inf")] + [0.0] * 7), (505, "i2", [None] + [0.0] * 7), (600, "i1", [0.0] * 8), (700, "i3", rows[7][2]), (701, "i2", rows[7][2]), (100, "i9", rows[8][2])]
    return rows


def test_whitening_equals_plain_eigenvectors(spark):
    rows = odd_vectors(np.random.default_rng(1))
    fit = taking_part(rows)
    x = np.array(units(fit, 64), dtype=object) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (x * n - s)
    values, vectors = np.linalg.eigh((y.T.dot(y) / n ** 3).astype(float))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = whitening.whitened_exposures(spark.createDataFrame(stocks(rows), STOCKS), components=5).toPandas()
    assert len(out) == 5 * n and (out["n"] == n).all() and out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-12
    want = (y.astype(float) / n) @ vectors[:, :5] / np.sqrt(values[:5])
    for k in range(5):
        part = out[out["component"] == k + 1]
        assert np.allclose(part["explained"], values[k] / values.sum(), rtol=1e-12)
        got = np.sort(part["whitened"])
        assert np.allclose(got, np.sort(want[:, k]), atol=1e-9) or np.allclose(got, np.sort(-want[:, k]), atol=1e-9)
    deviation = Counter(str(c) + ":" + str((row * row).sum()) for (c, _, _), row in zip(fit, y))
    first = out[out["component"] == 1]
    assert Counter(f"{'None' if c is None or c != c else int(c)}:{d}" for c, d in zip(first["ts_code"], first["deviation"])) == deviation


def test_whitening_of_equal_and_missing_variance(spark):
    """Repeated eigenvalues, and features that never vary or depend on others."""
    rows = [(i, "a", [float(a), float(b), float(c), 2.0, float(a)]) for i, (a, b, c) in enumerate((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1))]
    out = whitening.whitened_exposures(spark.createDataFrame(stocks(rows), STOCKS)).toPandas()
    assert sorted(out["component"].unique()) == [1, 2, 3] and out["identity_error"].max() < 1e-12
    assert np.allclose(out.groupby("component")["explained"].first(), [0.5, 0.25, 0.25])
    for same in ([], rows[:1], [rows[0], (9, "b", rows[0][2])], [(1, "a", None)]):
        assert whitening.whitened_exposures(spark.createDataFrame(stocks(same), STOCKS)).count() == 0
    large = [(i, "a", [float(2 ** 40 * (i % 5)), float(i), float(-(2 ** 30)) * (i % 3)]) for i in range(40)]
    out = whitening.whitened_exposures(spark.createDataFrame(stocks(large), STOCKS)).toPandas()
    assert len(out) == 120 and out["identity_error"].max() < 1e-4  # variances 23 orders apart, vectors are doubles
    exact = np.array(units(large, 64), dtype=object)
    rest = exact * 40 - exact.sum(axis=0)
    assert Counter(map(int, out[out["component"] == 2]["deviation"])) == Counter(int((r * r).sum()) for r in rest)


def test_polynomials_and_roots(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(-9, 10, (7, 5))
    matrix = (a @ a.T).tolist()
    poly = whitening.characteristic_polynomial(spark, matrix)
    assert poly[-2:] == [0, 0] and np.allclose(poly, np.poly(np.array(matrix, dtype=float)), atol=1e-3 * max(map(abs, poly)))
    roots = whitening.positive_roots(poly, 7)
    assert np.allclose([at / 2 ** s for at, s, _ in roots], np.linalg.eigvalsh(np.array(matrix, dtype=float))[::-1][:5])
    close = np.diag([10 ** 12, 10 ** 12 + 1, 10 ** 12 + 1, 5, 0]).tolist()
    poly = whitening.characteristic_polynomial(spark, close)
    assert [(round(at / 2 ** s), t) for at, s, t in whitening.positive_roots(poly, 5)] == [(10 ** 12 + 1, 2), (10 ** 12, 1), (5, 1)]
    assert [(t) for _, _, t in whitening.positive_roots(poly, 1)] == [2]


def brute_negatives(rows, anchor, positives=5, negatives_=10, low=30, high=90, scale=256):
    rows = sorted({(c, i, tuple(f)) for c, i, f in taking_part(rows) if c is not None and i is not None})
    u = np.array(units(rows, scale), dtype=object)
    out = []
    for k, (code, industry, _) in enumerate(rows):
        if anchor(code):
            other = sorted((-int(u[j].dot(u[k])), rows[j][0], rows[j][1]) for j in range(len(rows)) if rows[j][0] != code)
            for score, positive, _ in [x for x in other if x[2] == industry][:positives]:
                near = [x for x in other if x[2] != industry and low * -score <= 100 * -x[0] <= high * -score]
                out += [(code, positive, r, c, -score, -s) for r, (s, c, _) in enumerate(near[:negatives_], 1)]
    return Counter(out)


@pytest.mark.parametrize("factor", [1.0, 1e6])
def test_negatives_equal_brute_force(spark, factor, monkeypatch):
    monkeypatch.setattr(negatives, "HELD_ROWS", 50)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 60)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 7)
    rows = [(c, i, f and [x and float(np.float32(x * factor)) for x in f]) for c, i, f in odd_vectors(np.random.default_rng(5))]
    rows += [(1000 + i, "i5", rows[3][2]) for i in range(30)] + [(1100 + i, "i6", rows[3][2]) for i in range(30)]  # ties
    out = negatives.hard_negatives(spark.createDataFrame(stocks(rows), STOCKS), "ts_code % 10 = 0")
    assert Counter(map(tuple, out.collect())) == brute_negatives(rows, lambda c: c % 10 == 0)


def test_negatives_of_small_tables(spark):
    for rows in ([], [(0, "a", [1.0])], [(0, "a", [1.0]), (1, "a", [2.0])], [(0, "a", [0.0]), (1, "a", [2.0]), (2, "b", [0.0])]):
        out = negatives.hard_negatives(spark.createDataFrame(stocks(rows), STOCKS), "ts_code % 10 = 0")
        assert Counter(map(tuple, out.collect())) == (brute_negatives(rows, lambda c: c % 10 == 0) if len(rows) else Counter())
    named = spark.createDataFrame([(f"s{i}", f"k{i % 2}", [1.0 + i % 3, 0.5 * (i % 5)]) for i in range(40)], "ts_code string, industry string, features array<double>")
    out = negatives.hard_negatives(named, "ts_code in ('s0', 's7')")
    assert Counter(map(tuple, out.collect())) == brute_negatives([tuple(r) for r in named.collect()], lambda c: c in ("s0", "s7"))


def test_intervals_hold_the_product():
    rng = np.random.default_rng(7)
    x, y = np.floor(256 * rng.normal(0, 0.3, (400, 70))), np.floor(256 * rng.normal(0, 0.3, (60, 70)))
    turns = negatives.rotations(70)
    low, high = negatives.AnchorPlanes(y, turns).intervals(*negatives.encode(x, turns))
    exact = y @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    lengths = np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    assert ((high - low) / lengths).mean() < 0.5


def brute_removed(reports, length=100):
    """Ordered reports -> flags of removed bytes."""
    seen, out = set(), []
    for text in reports:
        flags = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - length + 1):
            if text[i:i + length] in seen:
                flags[i:i + length] = True
            seen.add(text[i:i + length])
        out.append(flags)
    return out


def letters(rng, n, alphabet="abcdefgh "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def suffix_rows():
    rng = random.Random(4)
    base, line = letters(rng, 4000), letters(rng, 64)
    texts = [base, base[:1000] + letters(rng, 50) + base[1050:], base[500:600], base[500:599], letters(rng, 120) + base[3000:3250] + letters(rng, 90), "a" * 700, "ab" * 300, "", None, "é" * 260, "xé" * 200]
    texts += [letters(rng, 40) + line + letters(rng, 40) for _ in range(60)]  # a short run that many share
    texts += [base] * 4 + [letters(rng, 30) + base[100:400] for _ in range(30)] + ["日本語テキスト" * 60]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("hot", [1 << 21, 500])
def test_removed_passages_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "BLOCK_SUFFIXES", 300)
    rows = suffix_rows()
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "external_id long, content_text string, run int, id string, last int").repartition(3)
    got = {r.external_id: (bytes(r.content_bytes), r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.drop_earlier_passages(table).collect()}
    order = sorted(rows)
    for (key, text), flags in zip(order, brute_removed([(t or "").encode() for _, t in order])):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        spans = int(np.sum(np.diff(np.concatenate([[0], flags.astype(int)])) == 1))
        assert got[key] == (raw[~flags].tobytes(), len(raw), int(flags.sum()), spans), key
    assert len(got) == len(rows)


def test_removed_passages_of_odd_tables(spark):
    rng = random.Random(6)
    text, other = letters(rng, 300), letters(rng, 300)
    schema = "external_id string, content_text string"
    rows = [("b", text), ("b", text), ("a", other), (None, other), (None, text), ("c", None), ("d", text[:150] + other[150:])]
    out = Counter((r.external_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.drop_earlier_passages(spark.createDataFrame(rows, schema)).collect())
    assert out == Counter([("b", 300, 0, 0), ("b", 300, 0, 0), ("a", 300, 0, 0), (None, 300, 300, 1), (None, 300, 300, 1), ("c", 0, 0, 0), ("d", 300, 300, 1)])
    assert suffixes.drop_earlier_passages(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        suffixes.drop_earlier_passages(spark.createDataFrame(rows, schema), length=10)


def test_a_very_long_text_is_cut_in_parts():
    rng = random.Random(8)
    text = letters(rng, 600_000).encode()
    text = text + text[1000:1500] + text[100_000:100_200]
    of, first, count, _ = suffixes.pieces([b"", text, b"short"], 100)
    assert set(of) == {1} and count.sum() == len(text) - 99 and sorted(first) == list(first)
    runs = suffixes.pieces([text[:2000], text[1000:1900]], 100)
    shared = set(runs[3][runs[0] == 0]) & set(runs[3][runs[0] == 1])
    assert len(shared) >= len(set(runs[3][runs[0] == 1])) - 1
