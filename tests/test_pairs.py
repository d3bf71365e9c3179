"""Tiled pair products and the pruned neighbour graph against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidepanel.operators import joins as jn
from tidepanel.operators import flow, moments, tiles


def sectors(days=37, names=11, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"d{d:03d}", f"s{n:02d}", float(rng.normal())) for d in range(days) for n in range(names) if rng.random() < 0.8]
    rows += [("d005", "late", 1.0), ("d006", "late", None)]  # a sector without values in most spans
    return pd.DataFrame(rows, columns=["date", "sector_name", "main_force_net"])


@pytest.mark.parametrize("split", [False, True])
def test_tiles_and_spans_do_not_change_pairs(spark, split, monkeypatch):
    df = spark.createDataFrame(sectors())
    columns = ["source", "target", "lag", "n", "src_pos", "both_pos", "cxx", "cyy", "czz", "cxy", "cxz", "cyz"]
    one = flow.pair_statistics(df, 3, split).toPandas().sort_values(columns[:3])[columns].reset_index(drop=True)
    monkeypatch.setattr(tiles.pair_sums, "__kwdefaults__", {**tiles.pair_sums.__kwdefaults__, "span": 10})
    many = flow.pair_statistics(df, 3, split, tile=3)
    assert many.rdd.getNumPartitions() >= 1 and tiles.blocks(df.selectExpr("sector_name", "int(substr(date, 2)) t", "main_force_net"), "sector_name", "main_force_net", 3, 3, 10)[1:] == (4, 4)
    many = many.toPandas().sort_values(columns[:3])[columns].reset_index(drop=True)
    assert len(one) == len(many) == 12 * 11 * 3
    pd.testing.assert_frame_equal(one, many, atol=1e-9)


def test_pairs_equal_plain_sums(spark):
    pdf = sectors()
    got = flow.pair_statistics(spark.createDataFrame(pdf), 2, tile=4).toPandas().set_index(["source", "target", "lag"])
    scale = pdf.groupby("sector_name")["main_force_net"].apply(lambda v: v.abs().mean())
    wide = (pdf.assign(v=pdf["main_force_net"] / pdf["sector_name"].map(scale)).pivot(index="date", columns="sector_name", values="v"))
    for a, b, lag in (("s00", "s01", 1), ("s07", "s02", 2), ("late", "s03", 1)):
        x, y = wide[a].shift(lag)[lag:], wide[b][lag:]
        ok = x.notna() & y.notna()
        row = got.loc[(a, b, lag)]
        assert row["n"] == ok.sum()
        if ok.sum():
            assert np.isclose(row["cxy"], ((x[ok] - x[ok].mean()) * (y[ok] - y[ok].mean())).sum())


def test_no_row_carries_all_names(spark):
    """Plans hold tiles of names, no array of all keys, and no cross product."""
    plan = flow.pair_statistics(spark.createDataFrame(sectors()), 1, tile=3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "scalar-subquery" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_key_covariance_in_tiles(spark):
    pdf = sectors()
    wide = pdf.pivot(index="date", columns="sector_name", values="main_force_net")
    out = moments.key_covariance(spark.createDataFrame(pdf), "date", "sector_name", "main_force_net", tile=3).toPandas()
    assert not out.duplicated(["a", "b"]).any() and (out["a"] <= out["b"]).all()
    cov, corr = wide.cov(), wide.corr()
    for r in out.itertuples():
        assert np.isclose(r.cov, cov.loc[r.a, r.b]) and (np.isclose(r.corr, corr.loc[r.a, r.b]) or r.corr != r.corr or r.n < 3)
    assert len(out) == sum(np.isfinite(cov.loc[a, b]) for a in wide for b in wide if a <= b)


@pytest.mark.parametrize("threshold,k", [(0.6, 4), (0.9, 3), (-1.0, 2)])
def test_pruned_graph_equals_brute_force(spark, threshold, k, monkeypatch):
    monkeypatch.setattr(moments, "BOUND_CLUSTERS", 5)
    rng = np.random.default_rng(9)
    around = rng.normal(size=(12, 6)) * 3
    x = np.vstack([around[i % 12] + rng.normal(size=6) * 0.15 for i in range(300)])
    x[250:] *= -1  # opposite directions are neighbours too
    x[7] = x[8]
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(6)]).assign(k=[f"n{i:03d}" for i in range(300)])
    df = spark.createDataFrame(pdf)
    cols = [f"f{i}" for i in range(6)]
    got = {(r.a, r.b): r.corr for r in moments.neighbour_graph(df, "k", cols, threshold, k, block=16).collect()}
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
    c = np.round(np.corrcoef(z), 12)
    np.fill_diagonal(c, 0)
    want = {}
    for i in range(300):
        for j in np.argsort(-np.abs(c[i]), kind="stable")[:k]:
            if i != j and abs(c[i, j]) >= threshold:
                want[tuple(sorted((f"n{i:03d}", f"n{j:03d}")))] = c[i, j]
    assert set(got) == set(want) and all(np.isclose(got[p], want[p]) for p in want)
    clusters = moments.node_clusters(df, "k", cols, threshold, k, 16)
    n = clusters.count()
    met = moments.cluster_pairs(clusters).distinct().count()
    assert n >= 12 and (met <= 0.5 * n * (n + 1) / 2 if threshold > 0 else met == n * (n + 1) / 2)  # at least half is skipped


def test_contained_pairs_equal_plain_search(spark):
    from tidepanel.operators import joins

    rng = np.random.default_rng(4)
    word = lambda lo, hi: "".join(rng.choice(list("abcé "), rng.integers(lo, hi)))
    texts, names = [word(0, 12) for _ in range(200)] + [None, "", "日本語"], [word(0, 5) for _ in range(80)] + [None, "本", "日本語日"]
    left = spark.createDataFrame([(x, 1) for x in texts], "t string, name string")
    right = spark.createDataFrame([(x, 1) for x in names], "n string, text string")
    want = {(t, n) for t in texts for n in names if t is not None and n is not None and n in t}
    out = joins.contained_pairs(left, "t", right, "n")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hits = {(r.t, r.hit) for r in joins.fuzzy_match(left, "t", right, "n", "hit").collect()}
    known = sorted({n for n in names if n is not None})
    assert hits == {(t, next((n for n in known if t is not None and (n in t or t in n)), None)) for t in texts}
    plan = joins.fuzzy_match(left, "t", right, "n", "hit")._jdf.queryExecution().executedPlan().toString()
    assert "scalar-subquery" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_alias_match_takes_exact_then_first(spark):
    from tidepanel.operators import joins

    aliases = spark.createDataFrame([("ab", "T1", 2), ("b", "T2", 1), ("abc", "T3", 3), ("abc", "T0", 3)], "alias string, target string, prio int")
    df = spark.createDataFrame([("abc",), (" abc ",), ("xab",), ("zz",), (None,), ("",)], "s string")
    assert {(r.s, r.o) for r in joins.alias_match(df, "s", aliases, "o").collect()} == {("abc", "T0"), (" abc ", "T0"), ("xab", "T2"), ("zz", "zz"), (None, None), ("", "")}


def test_an_alias_meets_a_text_once_however_many_rows_it_has(spark, monkeypatch):
    """A text that holds an alias must not be joined with every row of that alias."""
    seen, pairs = [], jn.contained_pairs
    monkeypatch.setattr(jn, "contained_pairs", lambda texts, text, names, name: seen.append(names) or pairs(texts, text, names, name))
    aliases = spark.range(3000).select(F.element_at(F.array(*[F.lit(a) for a in ("ab", "b", " abc")]), (F.col("id") % 3 + 1).cast("int")).alias("alias"),
                                       F.concat(F.lit("T"), F.lpad((F.col("id") % 7).cast("string"), 2, "0")).alias("target"), (F.col("id") % 11 + F.col("id") % 3).cast("int").alias("prio"))
    rows = [tuple(r) for r in aliases.collect()]
    texts = ["abc", " abc ", "xab", "x abc", "b", "zz", None, ""]

    def want(text):
        if text is None:
            return None
        key, order = text.strip(), lambda r: (r[2], r[0], r[1])
        found = [r for r in rows if r[0].strip() == key] or [r for r in rows if r[0] in key]
        return min(found, key=order)[1] if found else key

    out = jn.alias_match(spark.createDataFrame([(t,) for t in texts], "s string"), "s", aliases, "o").collect()
    assert {(r.s, r.o) for r in out} == {(t, want(t)) for t in texts}
    assert len(seen) == 1 and seen[0].count() == 3


def test_short_names_are_paired_with_their_texts_only(spark):
    """Names of digits share their pieces of three characters with most texts; only true pairs may be joined."""
    texts = spark.range(400).select(F.concat(F.lit("Customer#"), F.lpad((F.col("id") * 7919).cast("string"), 9, "0")).alias("t"))
    names = spark.range(400).select(F.lpad((F.col("id") * 37).cast("string"), 4, "0").alias("n")).unionAll(spark.sql("select explode(array('', 'Customer#0000', 'Customer#x', '00000791')) n"))
    a, b = [r.t for r in texts.collect()], {r.n for r in names.collect()}
    out = jn.contained_pairs(texts, "t", names, "n")
    assert sorted((r.text, r.name) for r in out.collect()) == sorted((x, y) for x in a for y in b if y in x)
    short = jn.contained_pairs(texts, "t", names.where(F.length("n") <= 8), "n")
    assert "Contains" not in short._jdf.queryExecution().optimizedPlan().toString()
