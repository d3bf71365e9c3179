"""Assertions of the method on hand-made rows; expected values are worked out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scalars as sc
from tidepanel.operators import factors as fx
from tidepanel.operators import flow as fl
from tidepanel.operators import macro as ma
from tidepanel.operators import market as mk
from tidepanel.operators import moments as mo
from tidepanel.operators import portfolio as pf
from tidepanel.operators import research as rs
from tidepanel.operators import strategies as st
from tidepanel.operators import xsection as xs
from tidepanel.sources import panels as pn


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def test_short_panel_has_five_day_factors(spark):
    rows = [("000001.SZ", day(i), 10.0 + i, 10.5 + i, 9.5 + i, 10.2 + i, 1000.0 + 50 * i, 9000.0 + 500 * i, 1.0 + i / 10) for i in range(8)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, vol double, amount double, turnover_rate double")
    out = fx.price_position(fx.volume_price(fx.volatility(fx.returns(df)))).orderBy(F.col("trade_date").desc()).first()
    for c in ("pmt_return_5d", "volat_hist_5d", "price_position_5d", "drawdown_5d", "range_position_5d", "vol_ratio_5d", "amount_ratio_5d", "turnover_mean_5d"):
        assert out[c] is not None
    assert out["pmt_return_5d"] == pytest.approx(17.2 / 12.2 - 1)


def flow_rows(spark):
    series = {
        "old_energy": [-10, -50, -15, -80, -20, -110, -30, -140, -40, -170, -50, -200],
        "new_ai": [0, 0, 10, 50, 15, 80, 20, 110, 30, 140, 40, 170],
        "banks": [25, -10, 18, -8, 14, -6, 10, -5, 9, -3, 6, -2],
    }
    rows = [(f"202601{i + 1:02d}", s, v * 1e8, 0.5, 1e10) for s, vals in series.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "date string, sector_name string, main_force_net double, change_pct double, turnover double"), series


def test_rotation_finds_lagged_route(spark):
    flow, _ = flow_rows(spark)
    best = fl.rotation_edges(flow).first()
    assert (best.source, best.target, best.lag_days) == ("old_energy", "new_ai", 2)
    assert best.confidence >= 0.7


def test_pair_statistics_match_brute_force(spark):
    flow, series = flow_rows(spark)
    got = {(r.source, r.target): r for r in fl.network_edges(flow, 0.0).collect()}
    for a, x in series.items():
        for b, y in series.items():
            if a != b:
                c = np.corrcoef(x[:-1], y[1:])[0, 1]
                assert got[a, b].correlation == pytest.approx(round(c, 4), abs=1e-4)
    f = {(r.source, r.target): r.f_score for r in fl.granger_edges(flow, 50).collect()}
    x, y = np.array(series["banks"], float), np.array(series["new_ai"], float)
    now, lag_y, lag_x = y[1:], y[:-1], x[:-1]
    rss = lambda m: np.sum((now - m @ np.linalg.lstsq(m, now, rcond=None)[0]) ** 2)
    one = np.ones(11)
    r0, r1 = rss(np.column_stack([one, lag_y])), rss(np.column_stack([one, lag_y, lag_x]))
    if ("banks", "new_ai") in f:
        assert f["banks", "new_ai"] == pytest.approx((r0 - r1) / (r1 / 8), rel=1e-3)


@pytest.mark.parametrize("small", [0, 200])
def test_page_rank_equals_dense_iteration(spark, small):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("d", "c", 1.0)]
    got = {r.sector_name: r.pagerank for r in fl.page_rank(spark.createDataFrame(edges, "source string, target string, weight double"), iterations=12, small=small).collect()}
    names = sorted(got)
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((4, 4))
    for s, t, w in edges:
        m[at[t], at[s]] = w
    out = m.sum(0)
    r = np.full(4, 0.25)
    for _ in range(12):
        r = 0.15 / 4 + 0.85 * (m @ np.where(out > 0, r / np.where(out > 0, out, 1), 0) + r[out == 0].sum() / 4)
    assert np.allclose([got[n] for n in names], r, atol=1e-6)
    assert sum(got.values()) == pytest.approx(1.0, abs=1e-5)


def test_industry_flow_units(spark):
    money = spark.createDataFrame([("a", "20260101", 10.0, 20.0, 5.0, 5.0), ("b", "20260101", 20.0, 10.0, 0.0, 1.0), ("c", "20260101", 8.0, 3.0, 0.0, 0.0)],
                                  "ts_code string, trade_date string, buy_lg_amount double, sell_lg_amount double, buy_elg_amount double, sell_elg_amount double")
    basic = spark.createDataFrame([("a", "bank"), ("b", "bank"), ("c", "robot")], "ts_code string, industry string")
    daily = spark.createDataFrame([("a", "20260101", 1.0, 1.0), ("b", "20260101", -2.0, 1.0), ("c", "20260101", 3.0, 1.0)], "ts_code string, trade_date string, pct_chg double, amount double")
    got = {r.sector_name: r for r in fl.industry_flow(money, basic, daily).collect()}
    assert got["bank"].main_force_net == pytest.approx(-10000.0) and got["bank"].change_pct == -0.5
    assert got["robot"].main_force_net == pytest.approx(50000.0)


def strategy_rows(spark):
    rows = []
    for code, cap, px in (("000001.SZ", 600000.0, 10.0), ("000002.SZ", 600000.0, 10.0), ("000003.SZ", 600000.0, 10.0), ("000004.SZ", 8000000.0, 10.0), ("000005.SZ", 600000.0, 30.0)):
        close = px
        for i in range(25):
            move = 0.2
            if i == 24 and code != "000003.SZ":
                move = 10.0
            if i == 23 and code == "000002.SZ":
                move = 10.0
            prev, close = close, round(close * (1 + move / 100), 4)
            rows.append((code, day(i), code, "ind", prev, close * 1.001, prev * 0.999, close, 1e5, 2e5, 8.0, cap, move))
    return spark.createDataFrame(rows, "ts_code string, trade_date date, name string, industry string, open double, high double, low double, close double, vol double, amount double, turnover_rate double, circ_mv double, pct_chg double")


def test_first_board_picks_only_the_fresh_limit_up(spark):
    picks = st.run(fx.strategy_history(strategy_rows(spark)), "first_board").where(F.col("trade_date") == day(24)).collect()
    assert [p.ts_code for p in picks] == ["000001.SZ"]
    p = picks[0]
    assert (p.position_pct, p.max_total_position_pct, p.stop_loss_pct, p.market_value) == (10.0, 60.0, -5.0, 60.0)


def test_strategy_overrides_and_unknown_parameters(spark):
    hist = fx.strategy_history(strategy_rows(spark))
    wide = st.run(hist, "first_board", price_max=60, nonsense=1).where(F.col("trade_date") == day(24))
    assert {r.ts_code for r in wide.collect()} == {"000001.SZ", "000005.SZ"}


def test_market_value_falls_back_per_row(spark):
    df = spark.createDataFrame([(0.0, None, 600000.0), (5.0, 1.0, 1.0), (-1.0, 2.0, 3.0)], "circ_mv double, float_mv double, total_mv double")
    assert [r[0] for r in df.select(sc.first_positive(["circ_mv", "float_mv", "total_mv"])).collect()] == [600000.0, 5.0, 2.0]


def ledger(spark, rows):
    return spark.createDataFrame([("main", "600000", i, s, day(i), p, n) for i, (s, p, n) in enumerate(rows)],
                                 "account string, code string, seq long, side string, trade_date date, price double, shares long")


@pytest.mark.parametrize("group_rows", [None, 10])
@pytest.mark.parametrize("trades, shares, avg, cost, pnl", [
    ([("BUY", 10.0, 700), ("ADD", 12.0, 300)], 1000, 10.6, 10600.0, 0.0),
    ([("BUY", 10.0, 1000), ("CLOSE", 11.0, 0)], 0, 10.0, 0.0, 1000.0),
    ([("BUY", 10.0, 1000), ("REDUCE", 12.0, 500)], 500, 10.0, 5000.0, 1000.0),
    ([("BUY", 10.0, 150), ("REDUCE", 12.0, 50), ("REDUCE", 12.0, 900), ("BUY", 5.0, 200)], 200, 5.0, 1000.0, 200.0),
])
def test_ledger_average_cost(spark, trades, shares, avg, cost, pnl, group_rows):
    h = pf.holdings(ledger(spark, trades), F.floor(F.col("seq") / 2), group_rows).first()
    assert h.shares == shares and float(h.avg_cost) == pytest.approx(avg) and float(h.cost_amount) == pytest.approx(cost)
    assert float(h.realized_pnl) == pytest.approx(pnl)


def test_profit_percent_after_add(spark):
    h = pf.holdings(ledger(spark, [("BUY", 10.0, 700), ("ADD", 12.0, 300)]), F.lit(0), 10)
    px = spark.createDataFrame([("600000", 11.0)], "code string, close double")
    assert pf.mark_to_market(h, px, 1e5).first().pnl_pct == pytest.approx(3.77)


def test_exit_rules_first_match_wins(spark):
    cols = "code string, buy_date date, buy_price double, peak_price double, close double, ma20 double, ai_score double, buy_ai_score double, score double, buy_score double, volatility double"
    base = dict(ma=9.0, ai=50.0, bai=50.0, sc=50.0, bsc=50.0, vol=0.02)

    def row(code, close, peak=None, age=1, **kw):
        b = base | kw
        return (code, day(0) - dt.timedelta(days=age), 10.0, peak or 10.0, close, b["ma"], b["ai"], b["bai"], b["sc"], b["bsc"], b["vol"])

    rows = [row("hard", 9.0), row("time", 9.75, age=12), row("take", 12.5), row("trail", 10.6, peak=12.2), row("ma", 10.1, ma=10.5), row("ai", 10.3, ai=20.0),
            row("idle", 10.05, age=6), row("watch", 9.9, age=3, ma=8.0), row("hold", 10.5)]
    got = {r.code: r.signal for r in pf.exit_scan(spark.createDataFrame(rows, cols), F.lit(day(0))).collect()}
    assert got == {"hard": "HARD_STOP", "time": "HARD_STOP", "take": "TAKE_PROFIT", "trail": "TAKE_PROFIT", "ma": "SOFT_STOP", "ai": "SOFT_STOP", "idle": "SOFT_STOP", "watch": "WATCH", "hold": "HOLD"}


def report(spark, text):
    return spark.createDataFrame([(1, "600519", "N", "I", text)], "report_id long, stock_code string, stock_name string, institution string, text string")


def test_chinese_extraction(spark):
    r = report(spark, "给予目标价12.5元。预计2026年归母净利润为40.5亿，2027年净利润 46亿。2026年EPS为1.25元。")
    assert r.select(rs.target_price(F.col("text"))).first()[0] == "12.5"
    got = {(x.year, x.value) for x in rs.profit_forecasts(r).collect()}
    assert {(2026, 40.5), (2027, 46.0)} <= got
    assert (2026, 1.25) in {(x.year, x.value) for x in rs.eps_forecasts(r).collect()}


def test_chinese_events_drop_bad_dates(spark):
    r = report(spark, "股东大会于2026年5月20。解禁2026年13月40。2026年4月30日披露年报")
    got = {(x.event_type, x.event_date) for x in rs.text_events(r, F.lit("2026-04-01").cast("date")).collect()}
    assert got == {("股东大会", dt.date(2026, 5, 20)), ("财报披露", dt.date(2026, 4, 30))}


def test_institution_tiers(spark):
    df = spark.createDataFrame([("中信证券研究所",), ("某某证券",), ("外部网站",), (None,)], "i string")
    assert [r[0] for r in df.select(rs.institution_weight(F.col("i"))).collect()] == [1.5, 1.0, 0.8, 0.8]


def test_consensus_divergence(spark):
    rows = [(i, "600519", "N", f"i{i}", "summarized", dt.date(2026, 1, 2), ["600519"], ["t"], "bullish", "买入", None) for i in range(3)]
    r = spark.createDataFrame(rows, "report_id long, stock_code string, stock_name string, institution string, status string, report_date date, target_stocks array<string>, tags array<string>, sentiment string, rating string, target_price double")
    chg = spark.createDataFrame([("600519", -8.0)], "code string, price_change_20d double")
    top = rs.consensus(r, F.lit("2026-01-01").cast("date"), chg).first()
    assert (top.report_count, top.buy_count, top.divergence) == (3, 3, True)
    assert rs.consensus(r, F.lit("2026-01-01").cast("date"), chg, count_twice=True).first().report_count == 6


def test_forecast_consensus_mean(spark):
    f = spark.createDataFrame([("600519", 2026, v, 1.0) for v in (40.0, 42.0, 46.0)], "stock_code string, forecast_year int, profit_value double, eps_value double")
    assert rs.forecast_consensus(f, 2026).first().avg_profit == 42.67


def test_number_provenance(spark):
    df = spark.createDataFrame([("跌了近25%，目标 88.888，2026年，99", "回撤-24.9%，价格 1300")], "a string, c string")
    assert sorted(df.select(rs.unverifiable_numbers(F.col("a"), F.col("c"))).first()[0]) == ["88.888", "99"]


def test_parse_amount_and_percent(spark):
    df = spark.createDataFrame([("1.2亿",), ("-35万元",), ("1,234",), ("--",), (None,), ("x",)], "s string")
    assert [r[0] for r in df.select(sc.parse_amount("s")).collect()] == pytest.approx([1.2e8, -3.5e5, 1234.0, 0.0, 0.0, 0.0])
    assert spark.createDataFrame([("3.5%",)], "s string").select(sc.parse_percent("s")).first()[0] == 3.5


def test_board_filter_and_suffix(spark):
    df = spark.createDataFrame([("300001",), ("301002",), ("688003",), ("689009",), ("600000",), ("000001",), ("830001",)], "c string")
    kept = [r.c for r in df.where(sc.board_kept("c", True, True)).collect()]
    assert kept == ["600000", "000001", "830001"]
    assert [r[0] for r in df.select(sc.exchange_suffix("c")).collect()][-3:] == ["600000.SH", "000001.SZ", "830001.BJ"]


def test_last_completed_day_rolls_over_weekends(spark):
    df = spark.createDataFrame([("2026-01-05 10:00:00",), ("2026-01-05 17:00:00",), ("2026-01-04 12:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in df.select(pn.last_completed_day(F.col("t"))).collect()] == [dt.date(2026, 1, 2), dt.date(2026, 1, 5), dt.date(2026, 1, 2)]


def test_as_of_slice_never_sees_later_rows(spark):
    from tidepanel.operators.joins import as_of_slice

    df = spark.createDataFrame([("a", day(i)) for i in range(10)], "ts_code string, trade_date date")
    got = sorted(r.trade_date for r in as_of_slice(df, F.lit(day(6)), 3).collect())
    assert got == [day(4), day(5), day(6)]


def test_series_change_and_heat(spark):
    df = spark.createDataFrame([("s", day(i), 100 * 1.001**i) for i in range(70)], "series_name string, obs_date date, value double")
    r = ma.asset_heat(df).first()
    assert r.chg_20 == pytest.approx(round((1.001**20 - 1) * 100, 2)) and r.heat_20 == 2 and len(r.spark) == 20
    empty = ma.wide(ma.latest_changes(df), {"eq": "missing"})
    assert ma.risk_appetite(empty, ["eq"]).first().score is None


@pytest.mark.parametrize("g, i, q", [(1, 1, "overheat"), (1, -1, "recovery"), (-1, 1, "stagflation"), (-1, -1, "reflation"), (0, 1, "recovery")])
def test_quadrants(spark, g, i, q):
    assert spark.range(1).select(ma.quadrant(F.lit(g), F.lit(i))).first()[0] == q


def test_day_cycle_anchor(spark):
    df = spark.createDataFrame([(dt.date(1949, 10, 1),), (dt.date(1949, 11, 30),), (dt.date(1984, 2, 4),)], "d date")
    got = [(r.day_cycle, r.year_cycle) for r in fx.calendar_cycles(df, "d").collect()]
    assert got[0][0] == 0 and got[1][0] == 0 and got[2][1] == 0


def test_style_residual_is_orthogonal(spark, sf):
    from tidepanel.plans import section_queries as q

    df = xs.style_neutral(q.styled(spark, sf), "roe").toPandas()
    for _, part in df.groupby("trade_date"):
        x = part[list(xs.STYLE)].fillna(0).to_numpy()
        res = part["style_neutral_score"].to_numpy()
        want = np.column_stack([np.ones(len(x)), x])
        y = part["roe"].to_numpy()
        assert np.allclose(res, y - want @ np.linalg.lstsq(want, y, rcond=None)[0], atol=1e-6)


def test_vif_elimination_drops_the_copy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(f=lambda d: d.a + d.b + 0.001 * rng.normal(size=200))
    df = spark.createDataFrame(pdf)
    kept = mo.select_orthogonal(df, list("abcdef"))
    assert len(kept) == 5 and max(mo.vif(mo.gram_matrix(df, kept)[0])) <= 5
    assert len(mo.prune_correlated(df.withColumn("g", F.col("a") * 2), list("abcdefg"))) < 7


def test_neighbour_graph_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(30, 6)), columns=[f"f{i}" for i in range(6)]).assign(k=[f"n{i:02d}" for i in range(30)])
    cols = [f"f{i}" for i in range(6)]
    got = {(r.a, r.b) for r in mo.neighbour_graph(spark.createDataFrame(pdf), "k", cols, 0.7, 4).collect()}
    z = (pdf[cols] - pdf[cols].mean()) / pdf[cols].std(ddof=0)
    c = np.corrcoef(z.to_numpy())
    np.fill_diagonal(c, 0)
    want = set()
    for i in range(30):
        for j in np.argsort(-np.abs(c[i]))[:4]:
            if abs(c[i, j]) >= 0.7:
                want.add((f"n{min(i, j):02d}", f"n{max(i, j):02d}"))
    assert got == want


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (2000 + F.col("id") % 3).cast("int").alias("y"))
    a = mk.stratified_sample(df, F.col("y"), ["k"], 100)
    assert {r["count"] for r in a.groupBy("y").count().collect()} == {100}
    assert {r.k for r in a.collect()} == {r.k for r in mk.stratified_sample(df.repartition(7), F.col("y"), ["k"], 100).collect()}
    w = mk.whole_key_sample(df, "k", 0.25).count()
    assert 0.2 < w / 5000 < 0.3


def test_item_view_vetoes_and_bounds(spark):
    rows = [("a", 200.0, 2.0, 5.0, 20.0, 0.0), ("b", 20.0, 2.0, 20.0, 20.0, 0.5), ("c", -3.0, 1.0, -9.0, 5.0, 0.1)]
    df = spark.createDataFrame(rows, "ts_code string, pe double, pb double, roe double, close double, negative_ratio double")
    df = df.withColumns({"rule_score": F.lit(90.0), "trend_score": F.lit(80.0), "bottom_score": F.lit(70.0), "ai_score": F.lit(0.0), "rsi": F.lit(50.0), "ma20_distance": F.lit(0.01),
                         "ma_bull": F.lit(1.0), "multi_oversold_flag": F.lit(0.5), "volat_hist_20d": F.lit(0.02), "profit_yoy": F.lit(0.0), "pledge_ratio": F.lit(0.0)})
    got = {r.ts_code: r for r in xs.item_view(df).collect()}
    assert got["a"].veto_reason == "pe_bubble" and got["b"].nlp_veto and got["c"].veto_reason == "lasting_loss"
    score = 0.40 * 90 + 0.25 * 80 + 0.15 * 70 + 0.10 * 60 + 0.10 * 50
    assert got["a"].buy_score == pytest.approx(score)
    assert all(35 <= r.confidence <= 95 and 0.02 <= r.position_weight <= 0.12 for r in got.values())
