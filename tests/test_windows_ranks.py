import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import factors as fx
from tidepanel.operators import ranks
from tidepanel.operators import windows as wn


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("alpha", [2 / 13, 1 / 3, 1 / 14, 0.9])
def test_ewm_matches_sequential_recursion_across_segments(spark, alpha):
    rng = random.Random(3)
    rows = [("a", i, rng.uniform(-5, 5)) for i in range(700)] + [("b", i, rng.uniform(0, 1)) for i in range(3)]
    df = frame(spark, rows, "k string, t int, x double")
    out = wn.ewm(df, wn.Series("k", "t"), {"y": ("x", alpha)}, segment=60.0).orderBy("k", "t").toPandas()
    for key, part in out.groupby("k"):
        want = part["x"].ewm(alpha=alpha, adjust=False).mean()
        assert np.allclose(part["y"], want, rtol=1e-11, atol=1e-12)


@pytest.mark.parametrize("alpha", [0.05, 1 / 3, 0.9])
def test_ewm_inner_nulls_match_pandas(spark, alpha):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(4):
        x = rng.normal(size=900) * 10
        x[rng.random(900) < (0.0, 0.3, 0.9, 0.5)[k]] = np.nan
        x[300:700 if k == 3 else 300] = np.nan
        rows += [(k, t, None if np.isnan(v) else float(v), None if np.isnan(v) else 2 * float(v)) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, t int, x double, z double")
    out = wn.ewm(df, wn.Series("k", "t"), {"y": ("x", alpha), "w": ("z", alpha)}, segment=90.0, alike={"z": "x"}).orderBy("k", "t").toPandas()
    for _, part in out.groupby("k"):
        want = part["x"].ewm(alpha=alpha, adjust=False).mean()
        np.testing.assert_allclose(part["y"], want, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(part["w"], 2 * want, rtol=1e-9, atol=1e-9)


def test_ewm_leading_nulls(spark):
    df = frame(spark, [("a", 0, None), ("a", 1, 2.0), ("a", 2, 4.0)], "k string, t int, x double")
    y = [r.y for r in wn.ewm(df, wn.Series("k", "t"), {"y": ("x", 0.5)}).orderBy("t").collect()]
    assert y[0] is None and y[1] == pytest.approx(2.0) and y[2] == pytest.approx(3.0)


def test_roll_needs_min_rows_and_skips_nulls(spark):
    df = frame(spark, [("a", i, None if i == 1 else float(i)) for i in range(5)], "k string, t int, x double")
    s = wn.Series("k", "t")
    out = df.withColumn("m", s.roll(F.avg, "x", 3, 2)).orderBy("t").toPandas()
    want = out["x"].rolling(3, min_periods=2).mean()
    assert [None if math.isnan(v) else v for v in out["m"]] == [None if math.isnan(v) else v for v in want]


def test_equal_averages_are_no_trend(spark):
    """The means of 5, 10 and 20 equal prices differ in their last bits, both upwards and downwards."""
    rows = [(f"{p}", d, p, 1.0) for p in (0.13, 0.17, 0.03, 0.06) for d in range(25)] + [("up", d, 10.0 + d, 1.0) for d in range(25)]
    df = frame(spark, rows, "ts_code string, trade_date int, close double, vol double")
    last = {r.ts_code: r for r in fx.moving_averages(df).where("trade_date = 24").collect()}
    assert {k: r.ma_trend_score for k, r in last.items()} == {"0.13": 0.0, "0.17": 0.0, "0.03": 0.0, "0.06": 0.0, "up": 1.0}
    assert any(r.ma5 > r.ma10 > r.ma20 for r in last.values() if r.ts_code != "up") and any(r.ma5 < r.ma10 < r.ma20 for r in last.values())
    odd = frame(spark, [(math.inf, math.inf, False), (math.inf, 1.0, True), (1.0, math.inf, False), (math.nan, 1.0, True), (1.0, math.nan, False),
                        (0.0, 0.0, False), (1.0, 0.0, True), (1.0, None, None)], "a double, b double, want boolean")
    assert all(r.got == r.want for r in odd.withColumn("got", wn.above(F.col("a"), F.col("b"))).collect())


def test_roll_prev_is_shifted_rolling_mean(spark):
    x = [float(v) for v in (5, 1, 4, 2, 8, 3, 9)]
    df = frame(spark, [("a", i, v) for i, v in enumerate(x)], "k string, t int, x double")
    out = df.withColumn("m", wn.Series("k", "t").roll_prev(F.avg, "x", 4, 2)).orderBy("t").toPandas()
    want = out["x"].rolling(4, min_periods=2).mean().shift(1)
    assert np.allclose(out["m"].fillna(-1), want.fillna(-1))


@pytest.mark.parametrize("group_rows", [10, ranks.WINDOW_ROWS + 1])
def test_average_rank_equals_pandas_with_ties_nulls_and_signs(spark, group_rows):
    rng = random.Random(5)
    pool = [None, 0.0, -0.0, 1e-70, -3.5, -3.5, 2.25, 1e9, -1e9, 0.1]
    rows = [(d, i, rng.choice(pool)) for d in "xy" for i in range(60)]
    df = frame(spark, rows, "d string, i int, v double")
    out = ranks.average_ranks(df, ["d"], {"r": "v"}, group_rows).toPandas()
    for _, part in out.groupby("d"):
        assert np.allclose(part["r"].fillna(-1), part["v"].rank(pct=True).fillna(-1))
    assert out["r"].dropna().between(0, 1).all()


@pytest.mark.parametrize("group_rows", [10, ranks.WINDOW_ROWS + 1])
def test_quantiles_interpolate_like_pandas(spark, group_rows):
    rng = random.Random(6)
    rows = [(d, rng.choice([0.0, rng.gauss(0, 3), 7.0])) for d in "xyz" for _ in range(41)]
    df = frame(spark, rows, "d string, v double")
    specs = {"a": ("v", 0.01), "b": ("v", 0.5), "c": ("v", 0.9)}
    got = {r.d: (r.a, r.b, r.c) for r in ranks.quantiles(df, ["d"], specs, group_rows).collect()}
    for d, part in pd.DataFrame(rows, columns=["d", "v"]).groupby("d"):
        assert np.allclose(got[d], [part["v"].quantile(q) for q in (0.01, 0.5, 0.9)])


@pytest.mark.parametrize("value", ["id + 1700000000", "10 + id / 4000000", "-exp(id / 1000)"])
def test_cells_grow_with_the_value_and_stay_even(spark, value):
    df = spark.range(400_000).selectExpr("1 as g", f"cast({value} as double) as _x")
    cells = ranks._with_cells(df, ["g"]).groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).orderBy("_cell").collect()
    assert len(cells) > 200 and max(c.n for c in cells) < 400_000 / 100
    assert all(a.hi < b.lo for a, b in zip(cells, cells[1:]))


@pytest.mark.parametrize("n", [3, 1200])
def test_top_n_is_exact_on_a_hot_group(spark, n):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("g"), ((F.col("id") * 7919) % 3001).alias("v"), "id")
    got = ranks.top_n(df, ["g"], [F.col("v").desc(), F.col("id")], n, "id").toPandas()
    base = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    want = base.groupby("g").head(n)
    assert set(got["id"]) == set(want["id"]) and got.groupby("g")["pick_rank"].max().tolist() == [min(n, 100), min(n, 2900)]


@pytest.mark.parametrize("rows", [None, 10])
def test_cumulative_cells_equal_plain_running_values(spark, rows):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), ((F.col("id") * 37) % 101 - 50).alias("x"), F.floor(F.col("id") / 60).alias("b"))
    out = wn.cumulative(df, ["k"], "t", "b", {"s": ("x", "sum"), "m": ("x", "max"), "m0": ("x", "max_before")}, rows).toPandas().sort_values(["k", "t"])
    g = out.groupby("k")["x"]
    assert (out["s"] == g.cumsum()).all() and (out["m"] == g.cummax()).all()
    want = g.cummax().groupby(out["k"]).shift(1)
    assert np.allclose(out["m0"].astype(float).fillna(-999), want.fillna(-999))


@pytest.mark.parametrize("backfill", [False, True])
def test_asof_join_matches_merge_asof(spark, backfill):
    rng = random.Random(8)
    days = pd.date_range("2020-01-01", periods=400)
    left = [(k, d.date()) for k in "ab" for d in days if rng.random() < 0.5]
    right = [(k, d.date(), float(i)) for k in "ab" for i, d in enumerate(days[40:]) if rng.random() < 0.05]
    lf, rf = frame(spark, left, "k string, d date"), frame(spark, right, "k string, e date, f double")
    got = wn.asof_join(lf, rf, "k", "d", "e", ["f"], bucket="month", backfill=backfill).toPandas()
    lp = pd.DataFrame(left, columns=["k", "d"]).assign(d=lambda x: pd.to_datetime(x.d)).sort_values("d")
    rp = pd.DataFrame(right, columns=["k", "e", "f"]).assign(e=lambda x: pd.to_datetime(x.e)).sort_values("e")
    want = pd.merge_asof(lp, rp, left_on="d", right_on="e", by="k").sort_values(["k", "d"])
    if backfill:
        want["f"] = want.groupby("k")["f"].bfill()
    got = got.assign(d=pd.to_datetime(got.d)).sort_values(["k", "d"])
    assert len(got) == len(want) and np.allclose(got["f"].fillna(-1), want["f"].fillna(-1))


def test_upsert_keeps_highest_version_and_order_does_not_matter(spark):
    old = frame(spark, [("d1", "s", 1.0, 1), ("d2", "s", 2.0, 1)], "date string, sector string, x double, version int")
    new = frame(spark, [("d2", "s", 9.0, 2), ("d3", "s", 3.0, 2)], "date string, sector string, x double, version int")
    for a, b in ((old, new), (new, old)):
        got = {(r.date, r.x) for r in wn.upsert_latest(a, b, ["date", "sector"], "version").collect()}
        assert got == {("d1", 1.0), ("d2", 9.0), ("d3", 3.0)}


def test_split_groups_are_exact_with_hot_ties_nulls_and_a_null_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CELL_ROWS", 500)
    rng = random.Random(8)
    size = {"hot": 6000, "mid": 700, "few": 40, None: 900}
    rows = [(d, rng.choice([None, 0.0, 7.0, *[rng.gauss(0, 3) for _ in range(3)]])) for d, n in size.items() for _ in range(n)]
    df = frame(spark, rows, "d string, v double").repartition(5)
    want = pd.DataFrame(rows, columns=["d", "v"])
    for pct in (True, False):
        out = ranks.average_ranks(df, ["d"], {"r": "v", "s": "v"}, ranks.WINDOW_ROWS + 1, pct=pct).toPandas()
        assert len(out) == len(want) and list(out.columns) == ["d", "v", "r", "s"]
        for _, part in out.groupby("d", dropna=False):
            assert np.allclose(part["r"].fillna(-1), part["v"].rank(pct=pct).fillna(-1)) and part["r"].equals(part["s"])
    specs = {"a": ("v", 0.01), "b": ("v", 0.5), "c": ("v", 0.9)}
    got = {r.d: (r.a, r.b, r.c) for r in ranks.quantiles(df, ["d"], specs, ranks.WINDOW_ROWS + 1).collect()}
    assert set(got) == set(size)
    for d, part in want.groupby("d", dropna=False):
        assert np.allclose(got[None if pd.isna(d) else d], [part["v"].quantile(q) for q in (0.01, 0.5, 0.9)])


def test_cuts_of_cells_are_stored_before_they_are_used_twice(spark):
    """Approximate quantiles may differ between two computations, so no plan may hold them beside a use of the cells."""
    df = spark.range(300_000).selectExpr("1 as g", "cast(id as double) as v")
    for out in (ranks._positions(df, ["g"], "v"), ranks.average_ranks(df, ["g"], {"r": "v"}, ranks.WINDOW_ROWS + 1), ranks.quantiles(df, ["g"], {"m": ("v", 0.5)}, ranks.WINDOW_ROWS + 1)):
        assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
