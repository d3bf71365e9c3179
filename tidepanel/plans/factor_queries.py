"""Queries over the per-entity factor operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as fx
from ..operators.windows import PANEL
from ..session import cut_lineage
from . import views as v
from .registry import query, r, rounded

W = "over (partition by ts_code order by trade_date)"


def fr(lo, hi=0):
    a = "unbounded preceding" if lo is None else f"{-lo} preceding"
    b = "current row" if hi == 0 else f"{-hi} preceding"
    return f"over (partition by ts_code order by trade_date rows between {a} and {b})"


def roll(agg, c, n, m=1):
    return f"case when count({c}) {fr(-(n - 1))} >= {m} then {agg}({c}) {fr(-(n - 1))} end"


def rollp(agg, c, n, m):
    return f"case when count({c}) {fr(-n, -1)} >= {m} then {agg}({c}) {fr(-n, -1)} end"


def pct(c, n=1):
    return f"({c} / nullif(lag({c}, {n}) {W}, 0) - 1)"


def ewm_sql(c, a, part="ts_code", order="trade_date"):
    """Exact sequential fold over the series so far (nulls lead only)."""
    return (f"list_reduce(list({c}) filter ({c} is not null) over (partition by {part} order by {order} "
            f"rows between unbounded preceding and current row), lambda x, y: {1 - a!r}::double * x + {a!r}::double * y)")


def e_panel(spark, sf):
    return v.panel_e(spark, sf)


def pick(df, *cols, places=6):
    return rounded(df.select("ts_code", "trade_date", *cols), places)


def sel(*cols):
    return "select ts_code, trade_date, " + ", ".join(cols)


@query("factor_returns", v.with_views(
    sel(*[r(pct('"close"', n), f"pmt_return_{n}d") for n in (1, 5, 20, 60)],
        r("-" + pct('"close"', 5), "rev_5d_reversal"), r("-" + pct('"close"', 1), "rev_1d_reversal")) + " from panel_e",
    "panel_e"))
def factor_returns(spark, sf):
    return pick(fx.returns(e_panel(spark, sf)), "pmt_return_1d", "pmt_return_5d", "pmt_return_20d", "pmt_return_60d",
                "rev_5d_reversal", "rev_1d_reversal")


@query("factor_volume_price", v.with_views(
    sel(r(f"vol / ({rollp('avg', 'vol', 20, 5)} + 1e-9)", "vol_ratio_raw"),
        r(f"amount / ({rollp('avg', 'amount', 20, 5)} + 1e-9)", "vol_amount_ratio"),
        r(f"vol / ({rollp('avg', 'vol', 5, 3)} + 1e-9)", "vol_ratio_5d"),
        r(f"amount / ({rollp('avg', 'amount', 5, 3)} + 1e-9)", "amount_ratio_5d"),
        f"cast(sign({pct(chr(34) + 'close' + chr(34))}) * sign({pct('vol')}) as double) + 0.0::double vol_price_corr",
        r(roll("avg", "turnover_rate", 5, 3), "turnover_mean_5d")) + " from panel_e", "panel_e"))
def factor_volume_price(spark, sf):
    return pick(fx.volume_price(e_panel(spark, sf)), "vol_ratio_raw", "vol_amount_ratio", "vol_ratio_5d",
                "amount_ratio_5d", "vol_price_corr", "turnover_mean_5d")


@query("factor_valuation", v.with_views(
    sel("pb fund_pb", "greatest(-100.0::double, least(200.0::double, pe)) fund_pe") + " from panel_e", "panel_e"))
def factor_valuation(spark, sf):
    return fx.valuation(e_panel(spark, sf)).select("ts_code", "trade_date", "fund_pb", "fund_pe")


APR_SIZE = """(rank() over (partition by trade_date order by total_mv) +
  (count(*) over (partition by trade_date, total_mv) - 1) / 2.0) / count(total_mv) over (partition by trade_date)"""


@query("factor_size", v.with_views(
    sel(r("ln(1 + total_mv)", "size_mkt_cap_log"), r(f"1.0::double - {APR_SIZE}", "size_score")) + " from panel_e", "panel_e"))
def factor_size(spark, sf):
    return pick(fx.size(e_panel(spark, sf), v.section_rows(spark, sf, "panel_e")), "size_mkt_cap_log", "size_score")


@query("factor_size_split", v.with_views(
    sel(r(f"1.0::double - {APR_SIZE}", "size_score")) + " from panel_e", "panel_e"))
def factor_size_split(spark, sf):
    """The same rank through the value-split plan used for very wide sections."""
    return pick(fx.size(e_panel(spark, sf), fx.ranks.WINDOW_ROWS + 1), "size_score")


@query("factor_size_latest", v.with_views(
    f"""select p.ts_code, p.trade_date, round(coalesce(s.score, 0.5::double), 6) size_score from panel_e p left join
    (select ts_code, 1.0::double - {APR_SIZE} score from panel_e
     where trade_date = (select max(trade_date) from panel_e)) s on p.ts_code = s.ts_code""", "panel_e"))
def factor_size_latest(spark, sf):
    df = e_panel(spark, sf).withColumn("size_mkt_cap_log", F.log1p("total_mv"))
    return pick(fx.latest_size_score(df, v.section_rows(spark, sf, "panel_e")), "size_score")


RET1 = "r as (select *, " + pct('"close"') + " r1 from panel_e)"


@query("factor_volatility", v.with_views(
    sel(r(roll("stddev_samp", "r1", 20, 5), "volat_hist_20d"), r(roll("stddev_samp", "r1", 5, 3), "volat_hist_5d")) + " from r",
    "panel_e", extra=RET1))
def factor_volatility(spark, sf):
    return pick(fx.volatility(e_panel(spark, sf)), "volat_hist_20d", "volat_hist_5d")


@query("factor_illiquidity", v.with_views(
    f"""select ts_code, trade_date, {r('il', 'amihud_illiq', 2)}, {r(roll('avg', 'il', 20, 5), 'amihud_illiq_20d', 2)},
      {r(f"case when {roll('avg', 'il', 20, 5)} is not null then -ln(1 + greatest(0.0::double, least(10.0::double, {roll('avg', 'il', 20, 5)}))) end", 'liquidity_amihud')},
      {r(f"ln(1 + {roll('avg', 'amount', 20, 5)})", 'liquidity_score')} from i""",
    "panel_e", extra=RET1 + f""", i as (select *, abs(r1) / (last_value(nullif(amount / 1e8, 0) ignore nulls) {fr(None)} + 1e-9) il from r)"""))
def factor_illiquidity(spark, sf):
    df = fx.illiquidity(e_panel(spark, sf)).select(
        "ts_code", "trade_date", F.round("amihud_illiq", 2).alias("amihud_illiq"),
        F.round("amihud_illiq_20d", 2).alias("amihud_illiq_20d"), "liquidity_amihud", "liquidity_score")
    return rounded(df)


MA = "m as (select *, " + ", ".join(f'{roll("avg", chr(34) + "close" + chr(34), n)} ma{n}' for n in (5, 10, 20, 60)) + " from panel_e)"


@query("factor_moving_averages", v.with_views(
    sel(*[r(f"ma{n}", f"ma{n}") for n in (5, 10, 20, 60)],
        "case when ma5 > ma10 and ma10 > ma20 then 1.0::double when ma5 < ma10 and ma10 < ma20 then -1.0::double else 0.0::double end ma_trend_score",
        r('("close" - ma20) / (ma20 + 1e-9)', "ma20_distance"), r('("close" - ma60) / (ma60 + 1e-9)', "ma60_distance")) + " from m",
    "panel_e", extra=MA))
def factor_moving_averages(spark, sf):
    return pick(fx.moving_averages(e_panel(spark, sf)), "ma5", "ma10", "ma20", "ma60", "ma_trend_score",
                "ma20_distance", "ma60_distance")


MACD = (f"""x as (select *, {ewm_sql('"close"', 2 / 13)} - {ewm_sql('"close"', 2 / 27)} macd from panel_e),
y as (select *, {ewm_sql('macd', 0.2)} sig from x)""")


@query("factor_macd", v.with_views(
    sel(r("macd", "macd"), r("sig", "macd_signal"), r("macd - sig", "macd_hist"),
        "case when macd > sig + 1e-9 then 1.0::double else 0.0::double end macd_golden") + " from y", "panel_e", extra=MACD))
def factor_macd(spark, sf):
    df = fx.macd(e_panel(spark, sf))
    df = df.withColumn("macd_golden", fx.flag(F.col("macd") > F.col("macd_signal") + 1e-9))
    return pick(df, "macd", "macd_signal", "macd_hist", "macd_golden")


KDJ = f"""k0 as (select *, ("close" - min(low) {fr(-8)}) / (max(high) {fr(-8)} - min(low) {fr(-8)} + 1e-9) * 100 rsv,
    -100 * (max(high) {fr(-8)} - "close") / (max(high) {fr(-8)} - min(low) {fr(-8)} + 1e-9) wr from panel_e),
k1 as (select *, {ewm_sql('rsv', 1 / 3)} k from k0), k2 as (select *, {ewm_sql('k', 1 / 3)} d from k1)"""


@query("factor_kdj", v.with_views(
    sel(r("k", "kdj_k"), r("d", "kdj_d"), r("3 * k - 2 * d", "kdj_j"), r("wr", "wr")) + " from k2", "panel_e", extra=KDJ))
def factor_kdj(spark, sf):
    return pick(fx.kdj(e_panel(spark, sf)), "kdj_k", "kdj_d", "kdj_j", "wr")


@query("factor_kdj_flags", v.with_views(
    sel("case when round(3 * k - 2 * d, 9) < 20 then 1.0::double else 0.0::double end kdj_oversold",
        "case when round(3 * k - 2 * d, 9) > 80 then 1.0::double else 0.0::double end kdj_overbought",
        f"""case when round(k - d, 9) > 0 and round(lag(k) {W} - lag(d) {W}, 9) <= 0 and k < 50 then 1.0::double
          else 0.0::double end kdj_low_golden""",
        "case when wr < -80 then 1.0::double else 0.0::double end wr_oversold") + " from k2", "panel_e", extra=KDJ))
def factor_kdj_flags(spark, sf):
    return fx.kdj(e_panel(spark, sf)).select(
        "ts_code", "trade_date", "kdj_oversold", "kdj_overbought", "kdj_low_golden", "wr_oversold")


RSI = f"""d0 as (select *, "close" - lag("close") {W} chg from panel_e),
d1 as (select *, greatest(chg, 0.0::double) g, greatest(-chg, 0.0::double) l from d0 where true),
d1b as (select * replace (case when chg is null then null else g end as g, case when chg is null then null else l end as l) from d1),
d2 as (select *, {ewm_sql('g', 1 / 14)} ag, {ewm_sql('l', 1 / 14)} al from d1b),
d3 as (select *, 100 - 100 / (1 + ag / (al + 1e-9)) rsi from d2)"""


@query("factor_rsi", v.with_views(
    sel(r("rsi", "rsi"), "case when rsi < 30 then 1.0::double else 0.0::double end rsi_oversold",
        "case when rsi > 70 then 1.0::double else 0.0::double end rsi_overbought",
        f"""case when "close" = {roll('min', '"close"', 20, 5)} and rsi > {roll('min', 'rsi', 5, 3)} + 5 then 1.0::double
            else 0.0::double end rsi_divergence""") + " from d3", "panel_e", extra=RSI))
def factor_rsi(spark, sf):
    return pick(fx.rsi(e_panel(spark, sf)), "rsi", "rsi_oversold", "rsi_overbought", "rsi_divergence")


@query("factor_bollinger", v.with_views(
    sel(r("ma + 2 * sd", "boll_upper"), r("ma - 2 * sd", "boll_lower"),
        r('("close" - (ma - 2 * sd)) / ((ma + 2 * sd) - (ma - 2 * sd) + 1e-9)', "boll_position"),
        "case when sd / (ma + 1e-9) < 0.02 then 1.0::double else 0.0::double end boll_squeeze") + " from b",
    "panel_e", extra=f"""b as (select *, {roll('avg', '"close"', 20)} ma, {roll('stddev_samp', '"close"', 20, 5)} sd from panel_e)"""))
def factor_bollinger(spark, sf):
    return pick(fx.bollinger(e_panel(spark, sf)), "boll_upper", "boll_lower", "boll_position", "boll_squeeze")


def place_sql(n, m):
    lo, hi = roll("min", '"close"', n, m), roll("max", '"close"', n, m)
    return f'("close" - {lo}) / ({hi} - {lo} + 1e-9)'


@query("factor_price_position", v.with_views(
    sel(r(place_sql(60, 10), "price_position_60d"), r(place_sql(5, 3), "price_position_5d"),
        r(f"""case when {roll('max', 'high', 5, 3)} is not null then greatest(-1.0::double, least(0.0::double,
          "close" / ({roll('max', 'high', 5, 3)} + 1e-9) - 1.0::double)) end""", "drawdown_5d"),
        r(f'("close" - {roll("min", "low", 5, 3)}) / ({roll("max", "high", 5, 3)} - {roll("min", "low", 5, 3)} + 1e-9)', "range_position_5d"))
    + " from panel_e", "panel_e"))
def factor_price_position(spark, sf):
    return pick(fx.price_position(e_panel(spark, sf)), "price_position_60d", "price_position_5d", "drawdown_5d",
                "range_position_5d")


@query("factor_return_acceleration", v.with_views(
    sel(r(f"""coalesce({pct('"close"', 5)}, 0) - coalesce({pct('"close"', 20)}, 0) / 4.0::double""", "return_accel_5d")) + " from panel_e", "panel_e"))
def factor_return_acceleration(spark, sf):
    df = fx.returns(e_panel(spark, sf))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return pick(df.withColumn("return_accel_5d", zero("pmt_return_5d") - zero("pmt_return_20d") / 4.0), "return_accel_5d")


@query("factor_risk_flags", v.with_views(
    sel("case when pledge_ratio > 30 then 1.0::double else 0.0::double end risk_pledge",
        "case when pledge_ratio > 60 then 1.0::double else 0.0::double end risk_pledge_high",
        """case when contains("name", 'ST') then 1.0::double else 0.0::double end risk_st""") + " from panel_e", "panel_e"))
def factor_risk_flags(spark, sf):
    return fx.risk_flags(e_panel(spark, sf)).select("ts_code", "trade_date", "risk_pledge", "risk_pledge_high", "risk_st")


@query("pledge_latest", """
  select ts_code, round(greatest(0.0::double, least(100.0::double, arg_max(ratio, (end_date, ratio)))), 6) pledge_ratio from (
    select lpad(cast(l_suppkey as varchar), 6, '0') ts_code, cast(l_shipdate as date) end_date,
      (l_quantity + l_tax * 100) / nullif(l_linenumber * 10, 0) * 100 ratio from lineitem) group by 1""")
def pledge_latest(spark, sf):
    li = v.table(spark, sf, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("ts_code"), F.to_date("l_shipdate").alias("end_date"),
        F.col("l_quantity").alias("unrest_pledge"), (F.col("l_tax") * 100).alias("rest_pledge"),
        (F.col("l_linenumber") * 10).cast("double").alias("total_share"))
    return rounded(fx.pledge_snapshot(li))


COMPOSITE_COLS = ("multi_oversold_flag", "reversal_signal", "small_cap_momentum", "oversold_volume_flag",
                  "low_pb_reversal", "liquidity_score", "return_accel_5d")


@query("factor_panel", v.with_views(f"""
  select ts_code, trade_date, {r('coalesce(mo, 0)', 'multi_oversold_flag')},
    case when mo > 0.5 and coalesce(vr, 1) > 1.5 and coalesce(r5, 0) < -0.05 then 1.0::double else 0.0::double end reversal_signal,
    {r('ss * coalesce(r20, 0)', 'small_cap_momentum')}, {r('mo * coalesce(vr, 1)', 'oversold_volume_flag')},
    case when pb < 2.0 and nb > 0 then 1.0::double else 0.0::double end low_pb_reversal,
    {r('coalesce(ls, 0)', 'liquidity_score')}, {r('coalesce(r5, 0) - coalesce(r20, 0) / 4.0::double', 'return_accel_5d')}
  from (select *, (case when round(3 * k - 2 * d, 9) < 20 then 1.0::double else 0.0::double end
      + case when rsi < 30 then 1.0::double else 0.0::double end + case when wr < -80 then 1.0::double else 0.0::double end + nb) / 4.0::double mo
    from (select k2.*, d3.rsi,
      {pct('k2."close"', 5).replace('ts_code', 'k2.ts_code').replace('by trade_date', 'by k2.trade_date')} r5,
      {pct('k2."close"', 20).replace('ts_code', 'k2.ts_code').replace('by trade_date', 'by k2.trade_date')} r20, f.vr, f.ls, f.ss, f.nb
      from k2 join d3 using (ts_code, trade_date) join f using (ts_code, trade_date)))""",
    "panel_e", extra=KDJ + ", " + RSI + f""", f as (select ts_code, trade_date, vol / ({rollp('avg', 'vol', 20, 5)} + 1e-9) vr,
      ln(1 + {roll('avg', 'amount', 20, 5)}) ls, 1.0::double - {APR_SIZE} ss,
      case when ("close" - ({roll('avg', '"close"', 20)} - 2 * {roll('stddev_samp', '"close"', 20, 5)})) /
        (4 * {roll('stddev_samp', '"close"', 20, 5)} + 1e-9) < 0.2 then 1.0::double else 0.0::double end nb from panel_e)"""))
def factor_panel(spark, sf):
    """The composite factors and what they depend on, over a panel that is stored once."""
    return pick(fx.rule_factors(cut_lineage(e_panel(spark, sf)), v.section_rows(spark, sf, "panel_e")), *COMPOSITE_COLS)


@query("forward_returns", v.with_views(
    sel(*[r(f'lead("close", {n}) {W} / "close" - 1', f"future_ret_{n}d") for n in (5, 10, 20)]) + " from panel_l", "panel_l"))
def forward_returns(spark, sf):
    return pick(fx.forward_returns(v.panel_l(spark, sf)), "future_ret_5d", "future_ret_10d", "future_ret_20d")


@query("lagged_fundamentals", v.with_views(
    sel(*[f"lag({c}) {W} {c}_lag1" for c in ("pe", "pb", "roe", "total_mv", "turnover_rate")]) + " from panel_e", "panel_e"))
def lagged_fundamentals(spark, sf):
    cols = ("pe", "pb", "roe", "total_mv", "turnover_rate")
    return fx.lagged(e_panel(spark, sf), cols).select("ts_code", "trade_date", *[f"{c}_lag1" for c in cols])


GAPPY = "g as (select ts_code, trade_date, case when vol > 2 then pe end pe, case when vol > 3 then pb end pb from panel_e)"


@query("fill_gaps", v.with_views(
    "select ts_code, trade_date, " + ", ".join(
        f"""coalesce(last_value({c} ignore nulls) {fr(None)}, first_value({c} ignore nulls) over (partition by ts_code
        order by trade_date rows between current row and unbounded following)) {c}""" for c in ("pe", "pb")) + " from g",
    "panel_e", extra=GAPPY))
def fill_gaps(spark, sf):
    df = e_panel(spark, sf).select("ts_code", "trade_date", F.when(F.col("vol") > 2, F.col("pe")).alias("pe"),
                                   F.when(F.col("vol") > 3, F.col("pb")).alias("pb"))
    return fx.fill_series(df, ["pe", "pb"])


def hist_sql(src):
    c = '"close"'
    return f"""h0 as (select *, coalesce({pct(c)} * 100, 0) pct_chg from {src}),
h1 as (select *, pct_chg >= 9.5 is_limit_up, {roll('avg', c, 5, 3)} ma5, {roll('avg', c, 10, 5)} ma10, {roll('avg', c, 20, 10)} ma20,
  {roll('max', 'high', 20, 10)} high20, {roll('avg', 'amount', 20, 5)} avg_amount20, coalesce(lag(pct_chg) {W}, 0) prev_pct_chg,
  coalesce({pct(c, 5)}, 0) * 100 return_5d, coalesce({pct(c, 20)}, 0) * 100 return_20d from h0),
hist as (select *, coalesce(lag(is_limit_up) {W}, false) prev_limit_up,
  {', '.join(f"cast(sum(cast(is_limit_up as bigint)) {fr(-(n - 1))} as bigint) limit_up_{n}d" for n in (5, 10, 20, 30))},
  case when avg_amount20 > 0 then amount / avg_amount20 else 1.0::double end volume_ratio,
  round("open", 3) = round("close", 3) and round(high, 3) = round("close", 3) and round(low, 3) = round("close", 3) one_word_limit from h1)"""


HIST_COLS = ("ma5", "ma10", "ma20", "high20", "avg_amount20", "prev_pct_chg", "return_5d", "return_20d", "volume_ratio")


@query("strategy_history", v.with_views(
    "select ts_code, trade_date, is_limit_up, prev_limit_up, one_word_limit, limit_up_5d, limit_up_10d, limit_up_20d, limit_up_30d, "
    + ", ".join(r(c, c) for c in HIST_COLS) + ", " + r("circ_mv / 10000", "market_value_yi") + " from hist",
    "panel_e", extra=hist_sql("panel_e")))
def strategy_history(spark, sf):
    df = fx.strategy_history(e_panel(spark, sf))
    return pick(df, "is_limit_up", "prev_limit_up", "one_word_limit", "limit_up_5d", "limit_up_10d", "limit_up_20d",
                "limit_up_30d", *HIST_COLS, "market_value_yi")


@query("style_exposures", v.with_views(
    sel(r(roll("sum", "r2", 20, 5), "factor_mom"), r("ln(total_mv)", "factor_sze"), r("1.0::double / greatest(pb, 0.1::double)", "factor_val"))
    + " from r2", "panel_e", extra=RET1 + f", r2 as (select *, lag(r1) {W} r2 from r)"))
def style_exposures(spark, sf):
    return pick(fx.momentum_exposure(e_panel(spark, sf)), "factor_mom", "factor_sze", "factor_val")


@query("liquidity_check", v.with_views(
    sel(r(roll("avg", "amount", 20, 5), "avg_amount"), f"coalesce(10.0 <= {roll('avg', 'amount', 20, 5)} * 0.05, false) tradable")
    + " from panel_e", "panel_e"))
def liquidity_check(spark, sf):
    return pick(fx.liquidity_check(e_panel(spark, sf), 10.0), "avg_amount", "tradable")


PREV = f"""pv as (select * from (select *, lag("close") {W} prev_close from panel_l) where prev_close > 0)"""


@query("daily_breadth", v.with_views(
    f"""select trade_date, {r('avg(case when "close" > prev_close then 1.0::double else 0.0::double end)', 'up_ratio')} from pv group by 1""",
    "panel_l", extra=PREV))
def daily_breadth(spark, sf):
    return rounded(fx.daily_breadth(v.panel_l(spark, sf)))


@query("limit_statistics", v.with_views(
    f"""select trade_date, count(*) filter ("close" / prev_close - 1 >= 0.097) limit_up, count(*) filter ("close" / prev_close - 1 <= -0.097) limit_down,
    {r('avg(case when "close" / prev_close - 1 > 0 then 1.0::double else 0.0::double end)', 'up_ratio')} from pv group by 1""",
    "panel_l", extra=PREV))
def limit_statistics(spark, sf):
    return rounded(fx.limit_statistics(v.panel_l(spark, sf)))


@query("overnight_gap", v.with_views(
    f"""select trade_date, {r('quantile_cont("open" / prev_close - 1, 0.5)', 'gap')} from pv group by 1""", "panel_l", extra=PREV))
def overnight_gap(spark, sf):
    return rounded(fx.overnight_gap(v.panel_l(spark, sf), v.section_rows(spark, sf, "panel_l")))


@query("limit_pool_emotion", """
  select cast(o_orderdate as date) trade_date, count(*) zt, count(*) filter (o_orderstatus = 'F') zb,
    max(o_orderkey % 9) max_lb, round(count(*) filter (o_orderstatus = 'F') / count(*), 3) zha_rate from orders group by 1""")
def limit_pool_emotion(spark, sf):
    pool = v.table(spark, sf, "orders").select(
        F.to_date("o_orderdate").alias("trade_date"), (F.col("o_orderkey") % 9).cast("double").alias("limit_times"),
        F.when(F.col("o_orderstatus") == "F", 1.0).alias("open_times"))
    return fx.limit_pool_emotion(pool)


@query("board_breadth", v.with_views(
    f"""select trade_date, count(*) filter (p > 0) up, count(*) filter (p < 0) down,
    count(*) filter (p >= case when regexp_matches(ts_code, '^(60|00)') then 9.9 else 19.9 end) limit_up,
    count(*) filter (p <= -case when regexp_matches(ts_code, '^(60|00)') then 9.9 else 19.9 end) limit_down,
    round(sum(amount), 2) amount from (select *, round({pct('"close"')} * 100, 6) p from panel_e) group by 1""", "panel_e"))
def board_breadth(spark, sf):
    df = e_panel(spark, sf)
    df = df.withColumn("pct_chg", F.round(PANEL.pct_change("close") * 100, 6))
    return rounded(fx.board_breadth(df), 2)


def idx_fr(n, hi=0):
    tail = "current row" if hi == 0 else f"{-hi} preceding"
    return f"over (order by obs_date rows between {n} preceding and {tail})"


def idx_pct(n):
    return f"""("value" / lag("value", {n}) over (order by obs_date) - 1)"""


def idx_pos(n):
    lo, hi = f'min("value") {idx_fr(n - 1)}', f'max("value") {idx_fr(n - 1)}'
    return f'("value" - {lo}) / greatest({hi} - {lo}, 1e-9) * 100'


IDX_BASE = f"""i0 as (select *, {idx_pct(1)} r, "value" - lag("value") over (order by obs_date) d,
  {ewm_sql('"value"', 2 / 13, 'series_name', 'obs_date')} - {ewm_sql('"value"', 2 / 27, 'series_name', 'obs_date')} macd from series_d),
i1 as (select *, macd - {ewm_sql('macd', 0.2, 'series_name', 'obs_date')} hist from i0)"""
IDX_MA = {n: f'avg("value") {idx_fr(n - 1)}' for n in (5, 20, 60)}
GAIN = f"(sum(greatest(d, 0.0::double)) {idx_fr(13)} / 14)"
LOSS = f"(sum(greatest(-d, 0.0::double)) {idx_fr(13)} / 14)"


@query("index_features", v.with_views(
    "select obs_date, " + ", ".join([
        *[r(f"coalesce({idx_pct(n)} * 100, 0)", f"r{n}") for n in (1, 5, 20, 60)],
        r(f"coalesce({idx_pct(121)} * 100, 0)", "r120"), r(idx_pos(60), "pos60"),
        r(f'case when count("value") {idx_fr(249)} >= 250 then {idx_pos(250)} else 50.0::double end', "pos250"),
        r(f"stddev_pop(r) {idx_fr(19)} * 100", "vol20"),
        r(f"100 - 100 / (1 + coalesce(nullif({GAIN}, 0), 1e-9) / coalesce(nullif({LOSS}, 0), 1e-9))", "rsi14"),
        "case when hist > 0 then 1.0::double else -1.0::double end hist_sign",
        f"""case when {IDX_MA[5]} > {IDX_MA[20]} and {IDX_MA[20]} > {IDX_MA[60]} then 1.0::double
          when {IDX_MA[5]} < {IDX_MA[20]} and {IDX_MA[20]} < {IDX_MA[60]} then -1.0::double else 0.0::double end ma_align""",
        r(f"avg(amount) {idx_fr(4)} / (avg(amount) {idx_fr(19)})", "amt_ratio")]) + " from i1", "series_d", extra=IDX_BASE))
def index_features(spark, sf):
    df = fx.index_features(v.series_d(spark, sf), "series_name", "obs_date", "value", "amount")
    return rounded(df.drop("series_name", "value", "amount"))


@query("technical_states", v.with_views(
    f"""select obs_date, case when hist > 0 and lag(hist) over (order by obs_date) <= 0 then 'golden'
      when hist <= 0 and lag(hist) over (order by obs_date) > 0 then 'dead' when hist > 0 then 'long' else 'short' end macd_state,
    case when {IDX_MA[5]} > {IDX_MA[20]} and {IDX_MA[20]} > {IDX_MA[60]} then 'bull'
      when {IDX_MA[5]} < {IDX_MA[20]} and {IDX_MA[20]} < {IDX_MA[60]} then 'bear' else 'mixed' end ma_state,
    case when "value" > lag("value", 5) over (order by obs_date) and {idx_pct(20)} > 0 then 'rising'
      when "value" <= lag("value", 5) over (order by obs_date) then 'fading' else 'mild' end momentum_state from i1""",
    "series_d", extra=IDX_BASE))
def technical_states(spark, sf):
    df = fx.technical_states(v.series_d(spark, sf), "series_name", "obs_date", "value")
    return df.select("obs_date", "macd_state", "ma_state", "momentum_state")


@query("trend_features", v.with_views(
    f"""select obs_date, {r(f"{idx_pct(120)} * 100", 'trend_120', 2)}, {r(f"{idx_pct(250)} * 100", 'trend_250', 2)},
    "value" >= max("value") {idx_fr(20, -1)} breakout_20,
    {r(f'''avg(case when lag_v is null then null when "value" > lag_v then 1.0::double else 0.0::double end) {idx_fr(128)} * 100''', 'base_up_prob', 1)}
    from (select *, lag("value") over (order by obs_date) lag_v from series_d)""", "series_d"))
def trend_features(spark, sf):
    df = fx.trend_features(v.series_d(spark, sf), "series_name", "obs_date", "value")
    return df.select("obs_date", "trend_120", "trend_250", "breakout_20", "base_up_prob")


@query("sentiment_composite", v.with_views(f"""
  select trade_date, round(greatest(-100, least(100, 60 * greatest(-1, least(1, (up - 0.5) / 0.15))
    + case when ld > 0 then 20 * greatest(-1, least(1, (lu - ld) / greatest(20.0::double, lu + ld))) else 0 end
    + 10 * greatest(-1, least(1, (vr - 1.0) / 0.25)))), 6) + 0.0::double sentiment from (
    select trade_date, avg(case when "close" > prev_close then 1.0::double else 0.0::double end) up,
      cast(count(*) filter ("close" / prev_close - 1 >= 0.097) as double) lu,
      cast(count(*) filter ("close" / prev_close - 1 <= -0.097) as double) ld, sum(amount) / sum(prev_close * vol) vr from pv group by 1)""",
    "panel_l", extra=PREV))
def sentiment_composite(spark, sf):
    df = fx._with_previous(v.panel_l(spark, sf)).withColumn("chg", F.col("close") / F.col("prev_close") - 1)
    day = df.groupBy("trade_date").agg(
        F.avg((F.col("close") > F.col("prev_close")).cast("double")).alias("up"),
        F.count_if(F.col("chg") >= 0.097).cast("double").alias("lu"),
        F.count_if(F.col("chg") <= -0.097).cast("double").alias("ld"),
        (F.sum("amount") / F.sum(F.col("prev_close") * F.col("vol"))).alias("vr"))
    score = fx.sentiment_composite(F.col("up"), F.col("lu"), F.col("ld"), F.col("vr"), F.lit(None).cast("double"))
    return rounded(day.select("trade_date", score.alias("sentiment")))


@query("semantic_labels", v.with_views(
    sel("""case when p is null then null when p <= -2 then 'weak' when p >= 2 then 'strong' else 'neutral' end move_label""",
        """case when turnover_rate <= 3 then 'quiet' when turnover_rate >= 6 then 'busy' else 'neutral' end turnover_label""")
    + f""" from (select *, {pct('"close"', 5)} * 100 p from panel_e)""", "panel_e"))
def semantic_labels(spark, sf):
    df = e_panel(spark, sf).withColumn("p", PANEL.pct_change("close", 5) * 100)
    return df.select("ts_code", "trade_date", fx.band_label(F.col("p"), -2, 2, "weak", "strong").alias("move_label"),
                     fx.band_label(F.col("turnover_rate"), 3, 6, "quiet", "busy").alias("turnover_label"))


@query("calendar_cycles", """
  select distinct cast(o_orderdate as date) d, ((cast(o_orderdate as date) - date '1949-10-01') % 60 + 60) % 60 day_cycle,
    ((year(o_orderdate) - case when month(o_orderdate) < 2 or (month(o_orderdate) = 2 and day(o_orderdate) < 4) then 1 else 0 end - 1984) % 60 + 60) % 60 year_cycle,
    isodow(o_orderdate) weekday from orders""")
def calendar_cycles(spark, sf):
    days = v.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    out = fx.calendar_cycles(days, "d")
    return out.select("d", *[F.col(c).cast("long").alias(c) for c in ("day_cycle", "year_cycle", "weekday")])


SOLAR = """c(m, h, k, c) as (values """ + ", ".join(
    f"({m}, {i}, {m * 2 - 2 + i}, {c}::double)" for m, pair in enumerate(fx.SOLAR_CONSTANTS, 1) for i, c in enumerate(pair)) + """),
t as (select k, make_date(y, m, cast(floor((y % 100) * 0.2422::double + c) - case when m <= 2 then floor((y % 100 - 1) / 4.0)
   else floor((y % 100) / 4.0) end as integer)) td from c, range(2023, 2026) yy(y)),
s as (select k, td, lead(td) over (order by td) nd, lead(k) over (order by td) nk from t)"""


@query("solar_position", v.with_views("""
  select e.d, cast(k as bigint) term, cast(nk as bigint) next_term, e.d - td + 1 days_in, nd - e.d days_to_next,
    round(least(1.0, (e.d - td) / 15.2::double), 2) progress
  from (select distinct cast(ts as date) d from events) e left join s on e.d >= td and e.d < nd""", extra=SOLAR))
def solar_position(spark, sf):
    days = v.table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    out = fx.solar_position(days, "d", fx.solar_terms(spark, 2023, 2025))
    return out.select("d", *[F.col(c).cast("long").alias(c) for c in ("term", "next_term", "days_in", "days_to_next")], "progress")


SECTOR_FR = "over (partition by sector_name order by \"date\" rows between {} preceding and current row)"


@query("sector_features", v.with_views(f"""
  select sector_name, "date", {r(f"avg(change_pct) {SECTOR_FR.format(4)}", 'mom5')},
    {r(f"avg(turnover) {SECTOR_FR.format(4)} / avg(turnover) {SECTOR_FR.format(19)}", 'amt_ratio')},
    case when lead(change_pct) over (partition by sector_name order by "date") is null then null
      when lead(change_pct) over (partition by sector_name order by "date") > 0 then 1.0::double else 0.0::double end up_next
  from sector_flow""", "sector_flow"))
def sector_features(spark, sf):
    df = fx.sector_features(v.sector_flow(spark, sf), "sector_name", "date", "change_pct", "turnover")
    return rounded(df.select("sector_name", "date", "mom5", "amt_ratio", "up_next"))


ISLANDS = """s1 as (select *, cast(sign(main_force_net) as integer) sg, case when sign(main_force_net) =
    lag(sign(main_force_net)) over (partition by sector_name order by "date") then 0 else 1 end brk from sector_flow),
s2 as (select *, sum(brk) over (partition by sector_name order by "date") blk from s1),
s3 as (select *, row_number() over (partition by sector_name, blk order by "date") rn from s2)"""


@query("inflow_streak", v.with_views(
    """select sector_name, "date", case when sg > 0 then rn else 0 end streak, rn * sg signed_streak from s3""",
    "sector_flow", extra=ISLANDS))
def inflow_streak(spark, sf):
    df = fx.inflow_streak(v.sector_flow(spark, sf), "sector_name", "date", "main_force_net")
    df = fx.signed_streak(df, "sector_name", "date", "main_force_net")
    return df.select("sector_name", "date", F.col("streak").cast("long").alias("streak"), "signed_streak")


@query("sector_breadth", v.with_views(f"""
  select g.trade_date, g.industry, {r('coalesce(a.u, m.u)', 'breadth')} from (select distinct trade_date, industry from panel_l) g
  left join (select trade_date, industry, avg(case when "close" > prev_close then 1.0::double else 0.0::double end) u from pv group by 1, 2) a
    on g.trade_date = a.trade_date and g.industry = a.industry
  left join (select trade_date, avg(case when "close" > prev_close then 1.0::double else 0.0::double end) u from pv group by 1) m
    on g.trade_date = m.trade_date""", "panel_l", extra=PREV))
def sector_breadth(spark, sf):
    return rounded(fx.sector_breadth(v.panel_l(spark, sf)).select("trade_date", "industry", "breadth"))


@query("technical_profile", v.with_views(
    sel(r("ma5", "ma5"), r("ma20", "ma20"), r("ma60", "ma60"), r("chg20", "chg20"), r("oh", "off_high60"), r("ol", "off_low60"))
    + f""" from (select *, {roll('avg', '"close"', 5)} ma5, {roll('avg', '"close"', 20)} ma20, {roll('avg', '"close"', 60)} ma60,
      {pct('"close"', 20)} * 100 chg20, ("close" / max(high) {fr(-59)} - 1) * 100 oh, ("close" / min(low) {fr(-59)} - 1) * 100 ol,
      row_number() over (partition by ts_code order by trade_date desc) rn from panel_l) where rn = 1""", "panel_l"))
def technical_profile(spark, sf):
    return pick(fx.technical_profile(v.panel_l(spark, sf)), "ma5", "ma20", "ma60", "chg20", "off_high60", "off_low60")


@query("adjusted_prices", v.with_views("""
  select ts_code, trade_date, round(high * f / lf, 2) high, round("close" * f / lf, 2) "close" from (
    select *, sqrt(2 + day(trade_date) % 4) f, last_value(sqrt(2 + day(trade_date) % 4)) over
      (partition by ts_code order by trade_date rows between unbounded preceding and unbounded following) lf from panel_l)""", "panel_l"))
def adjusted_prices(spark, sf):
    df = v.panel_l(spark, sf).withColumn("adj_factor", F.sqrt(2 + F.dayofmonth("trade_date") % 4))
    return fx.adjusted_prices(df).select("ts_code", "trade_date", "high", "close")


def _bars(unit):
    return v.with_views(f"""select ts_code, cast(date_trunc('{unit}', trade_date) as date) bar, arg_min("open", trade_date) "open", max(high) high,
      min(low) low, arg_max("close", trade_date) "close", sum(vol) vol, round(sum(amount), 2) amount from panel_l group by 1, 2""", "panel_l")


@query("weekly_bars", _bars("week"))
def weekly_bars(spark, sf):
    return rounded(fx.resample(v.panel_l(spark, sf), "week"), 2)


@query("monthly_bars", _bars("month"))
def monthly_bars(spark, sf):
    return rounded(fx.resample(v.panel_l(spark, sf), "month"), 2)


@query("last_bars", v.with_views("""select ts_code, trade_date, "close" from panel_l
  qualify row_number() over (partition by ts_code order by trade_date desc) <= 30""", "panel_l"))
def last_bars(spark, sf):
    return fx.last_bars(v.panel_l(spark, sf), 30).select("ts_code", "trade_date", "close")
