"""Queries over the cross-sectional operators (panel of the event stream)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as fx
from ..operators import market as mk
from ..operators import ranks
from ..operators import xsection as xs
from ..session import cut_lineage
from . import views as v
from .factor_queries import APR_SIZE, KDJ, RSI, W, fr, pct, roll, rollp
from .registry import query, r, rounded

C = '"close"'


def apr(col, by="trade_date"):
    return (f"(rank() over (partition by {by} order by {col} nulls last) + (count(*) over (partition by {by}, {col}) - 1) / 2.0) "
            f"/ count({col}) over (partition by {by})")


def panel(spark, sf):
    return v.panel_e(spark, sf)


def rows(spark, sf):
    return v.section_rows(spark, sf, "panel_e")


def pick(df, *cols, places=6):
    return rounded(df.select("ts_code", "trade_date", *cols), places)


@query("rank_pct", v.with_views(
    f"select ts_code, trade_date, {r(apr('vol'), 'by_date')}, {r(apr('pe', 'trade_date, industry'), 'by_industry')} from panel_e", "panel_e"))
def rank_pct(spark, sf):
    df = ranks.average_ranks(panel(spark, sf), ["trade_date"], {"by_date": "vol"}, rows(spark, sf))
    df = ranks.average_ranks(df, ["trade_date", "industry"], {"by_industry": "pe"}, rows(spark, sf))
    return pick(df, "by_date", "by_industry")


@query("rank_pct_global", v.with_views(
    f"select ts_code, trade_date, {r(apr('vol', '1'), 'global_rank')} from panel_l", "panel_l"))
def rank_pct_global(spark, sf):
    """One group over the whole panel always takes the value-split plan."""
    df = v.panel_l(spark, sf).withColumn("_all", F.lit(1))
    return pick(ranks.average_ranks(df, ["_all"], {"global_rank": "vol"}, ranks.WINDOW_ROWS + 1), "global_rank")


@query("quantiles_split", v.with_views(
    f"select trade_date, {r('quantile_cont(amount, 0.1)', 'p10')}, {r('quantile_cont(amount, 0.5)', 'p50')}, "
    f"{r('quantile_cont(amount, 0.9)', 'p90')} from panel_e group by 1", "panel_e"))
def quantiles_split(spark, sf):
    specs = {"p10": ("amount", 0.1), "p50": ("amount", 0.5), "p90": ("amount", 0.9)}
    return rounded(ranks.quantiles(panel(spark, sf), ["trade_date"], specs, ranks.WINDOW_ROWS + 1))


FWD = "fw as (select *, " + ", ".join(f"lead({C}, {n}) {W} / nullif({C}, 0) - 1 f{n}" for n in (5, 10, 20)) + " from panel_e)"


@query("rank_labels", v.with_views(
    "select ts_code, trade_date, " + r("(" + " + ".join(
        f"coalesce(case when f{n} is not null then {apr(f'f{n}')} end, 0.5) * {w}::double" for n, w in ((5, 0.5), (10, 0.3), (20, 0.2)))
        + " - 0.5::double) * 2", "label") + " from fw", "panel_e", extra=FWD))
def rank_labels(spark, sf):
    return pick(xs.rank_labels(fx.forward_returns(panel(spark, sf)), rows(spark, sf)), "label")


def z(col, ddof, by="trade_date"):
    sd = f"stddev_{'pop' if ddof == 0 else 'samp'}({col}) over (partition by {by})"
    return f"({col} - avg({col}) over (partition by {by})) / ({sd} + 1e-9)"


@query("z_scores", v.with_views(
    f"""select ts_code, trade_date, {r("(pe - avg(pe) over (partition by trade_date)) / stddev_pop(pe) over (partition by trade_date)", 'z_pe')},
    {r(z('amount', 1), 'z_amount')} from panel_e""", "panel_e"))
def z_scores(spark, sf):
    df = xs.z_scores(panel(spark, sf), ["trade_date"], {"z_pe": "pe"}, ddof=0, group_rows=rows(spark, sf))
    return pick(xs.z_scores(df, ["trade_date"], {"z_amount": "amount"}, ddof=1, guard=False), "z_pe", "z_amount")


ROBUST = """q0 as (select trade_date, quantile_cont(amount, 0.01) a, quantile_cont(amount, 0.99) b from panel_e group by 1),
q1 as (select p.*, least(greatest(amount, a), b) w from panel_e p join q0 using (trade_date)),
q2 as (select trade_date, quantile_cont(w, 0.5) m, quantile_cont(w, 0.75) - quantile_cont(w, 0.25) iqr from q1 group by 1)"""


@query("robust_z", v.with_views(
    f"select ts_code, trade_date, {r('(w - m) / (iqr * 0.7413::double)', 'rz')} from q1 join q2 using (trade_date)", "panel_e", extra=ROBUST))
def robust_z(spark, sf):
    return pick(xs.robust_z(panel(spark, sf), ["trade_date"], {"rz": "amount"}, rows(spark, sf)), "rz")


@query("winsorize", v.with_views(f"select ts_code, trade_date, {r('w', 'amount')} from q1", "panel_e", extra=ROBUST))
def winsorize(spark, sf):
    return pick(xs.winsorize(panel(spark, sf), ["trade_date"], ["amount"], group_rows=rows(spark, sf)), "amount")


def band(col, base, span):
    lo, hi = f"min({col}) over (partition by trade_date)", f"max({col}) over (partition by trade_date)"
    return (f"{base}::double + case when stddev_pop({col}) over (partition by trade_date) > 1e-9 "
            f"then ({col} - {lo}) / ({hi} - {lo} + 1e-9) else 0.5::double end * {span}::double")


@query("score_band", v.with_views(
    f"select ts_code, trade_date, {r(band('amount', 60.0, 35.0), 'score')} from panel_e", "panel_e"))
def score_band(spark, sf):
    return pick(xs.score_band(panel(spark, sf), ["trade_date"], "amount", "score"), "score")


SUB_WEIGHTS = ("pmt_return_5d", "pmt_return_20d", "rev_5d_reversal", "vol_ratio_raw", "vol_turnover", "fund_pb", "fund_pe",
               "size_score", "size_mkt_cap_log", "risk_pledge", "risk_pledge_high", "risk_st", "price_position_60d")
TOTAL_W = sum(abs(w) for w in xs.RULE_WEIGHTS.values())
LO60, HI60 = roll("min", C, 60, 10), roll("max", C, 60, 10)
SUB = f"""f0 as (select *, {pct(C, 5)} pmt_return_5d, {pct(C, 20)} pmt_return_20d, -{pct(C, 5)} rev_5d_reversal,
  vol / ({rollp('avg', 'vol', 20, 5)} + 1e-9) vol_ratio_raw, turnover_rate vol_turnover, pb fund_pb,
  greatest(-100.0::double, least(200.0::double, pe)) fund_pe, 1.0::double - {APR_SIZE} size_score, ln(1 + total_mv) size_mkt_cap_log,
  case when pledge_ratio > 30 then 1.0::double else 0.0::double end risk_pledge,
  case when pledge_ratio > 60 then 1.0::double else 0.0::double end risk_pledge_high,
  case when contains("name", 'ST') then 1.0::double else 0.0::double end risk_st,
  ({C} - {LO60}) / ({HI60} - {LO60} + 1e-9) price_position_60d from panel_e),
f1 as (select * replace ({', '.join(f'coalesce({c}, 0) as {c}' for c in SUB_WEIGHTS)}) from f0),
f2 as (select *, {' + '.join(
    f"(case when stddev_pop({c}) over (partition by trade_date) > 1e-9 then {apr(c) if xs.RULE_WEIGHTS[c] > 0 else '1.0::double - ' + apr(c)} else 0.5 end) * {abs(xs.RULE_WEIGHTS[c]) / TOTAL_W!r}::double"
    for c in SUB_WEIGHTS)} rule_raw from f1)"""


def sub_factors(spark, sf):
    df = fx.price_position(fx.volume_price(fx.returns(panel(spark, sf))))
    return fx.fill_numeric(fx.risk_flags(fx.size(fx.valuation(df), rows(spark, sf))))


def sub_weights():
    return {c: (w if c in SUB_WEIGHTS else 0.0) for c, w in xs.RULE_WEIGHTS.items()}


def _sub_score(spark, sf, group_rows):
    df = sub_factors(spark, sf)
    keep = df.select("ts_code", "trade_date", "close", *SUB_WEIGHTS)
    return xs.weighted_rank_score(keep, group_rows=group_rows)


@query("weighted_rank_score", v.with_views(
    f"select ts_code, trade_date, {r('rule_raw', 'rule_raw')} from f2", "panel_e", extra=SUB))
def weighted_rank_score(spark, sf):
    return pick(_sub_score(spark, sf, rows(spark, sf)), "rule_raw")


@query("weighted_rank_score_split", v.with_views(
    f"select ts_code, trade_date, {r('rule_raw', 'rule_raw')} from f2", "panel_e", extra=SUB))
def weighted_rank_score_split(spark, sf):
    return pick(_sub_score(spark, sf, ranks.WINDOW_ROWS + 1), "rule_raw")


@query("relaxed_risk_selection", v.with_views(
    f"""select trade_date, ts_code, {r('rule_score', 'rule_score')}, pick_rank from (
      select *, row_number() over (partition by trade_date order by round(rule_score, 9) desc, ts_code) pick_rank from (
        select *, count(*) filter (ok) over (partition by trade_date) n_ok from (
          select *, {band('rule_raw', 60.0, 35.0)} rule_score, risk_pledge_high = 0 and risk_st = 0 ok from f2)) where ok or n_ok < 20)
      where pick_rank <= 20""", "panel_e", extra=SUB))
def relaxed_risk_selection(spark, sf):
    df = sub_factors(spark, sf).select("ts_code", "trade_date", "close", "risk_delist_score", *SUB_WEIGHTS)
    flatless = df.withColumn("risk_delist_score", F.lit(0.0))
    scored = xs.score_band(xs.weighted_rank_score(flatless.drop("risk_delist_score"), group_rows=rows(spark, sf)),
                           ["trade_date"], "rule_raw", "rule_score", group_rows=rows(spark, sf))
    safe = (F.col("risk_pledge_high") == 0) & (F.col("risk_st") == 0)
    kept = xs.relax_if_few(scored, safe, 20, group_rows=rows(spark, sf))
    top = ranks.top_n(kept, ["trade_date"], [F.round("rule_score", 9).desc(), F.col("ts_code")], 20, "ts_code")
    return rounded(top.select("trade_date", "ts_code", "rule_score", "pick_rank"))


ALL_FACTORS = [c for c in xs.RULE_WEIGHTS]
SD20, MA20S = roll("stddev_samp", C, 20, 5), roll("avg", C, 20)
FULL = KDJ + ", " + RSI + f""", u0 as (select *, {pct(C)} r1 from panel_e),
u1 as (select *, abs(r1) / (last_value(nullif(amount / 1e8, 0) ignore nulls) {fr(None)} + 1e-9) il from u0),
u2 as (select *, {pct(C, 5)} pmt_return_5d, {pct(C, 20)} pmt_return_20d, {pct(C, 60)} pmt_return_60d, -{pct(C, 5)} rev_5d_reversal, r1 pmt_return_1d,
  vol / ({rollp('avg', 'vol', 20, 5)} + 1e-9) vol_ratio_raw, turnover_rate vol_turnover, pb fund_pb, greatest(-100.0::double, least(200.0::double, pe)) fund_pe,
  1.0::double - {APR_SIZE} size_score, ln(1 + total_mv) size_mkt_cap_log, {roll('stddev_samp', 'r1', 20, 5)} volat_hist_20d,
  ({C} - ({MA20S} - 2 * {SD20})) / (({MA20S} + 2 * {SD20}) - ({MA20S} - 2 * {SD20}) + 1e-9) boll_position, ({C} - {LO60}) / ({HI60} - {LO60} + 1e-9) price_position_60d,
  {roll('avg', 'il', 20, 5)} il20 from u1),
u3 as (select u2.*, k2.wr, k, d, lag(k2.k) over (partition by k2.ts_code order by k2.trade_date) pk, lag(k2.d) over (partition by k2.ts_code order by k2.trade_date) pd, rsi,
  case when d3."close" = {roll('min', 'd3."close"', 20, 5).replace('by ts_code order by trade_date', 'by d3.ts_code order by d3.trade_date')} and rsi > {roll('min', 'rsi', 5, 3).replace('by ts_code order by trade_date', 'by d3.ts_code order by d3.trade_date')} + 5 then 1.0::double else 0.0::double end rsi_divergence
  from u2 join k2 on k2.ts_code = u2.ts_code and k2.trade_date = u2.trade_date join d3 on d3.ts_code = u2.ts_code and d3.trade_date = u2.trade_date),
mfl as (select ts_code, round(avg(net_flow), 6) mf_net_main, round(sum(greatest(net_flow, 0)) / (sum(greatest(net_flow, 0)) + sum(greatest(-net_flow, 0)) + 1e-9), 6) mf_main_ratio from panel_e group by 1),
lim as (select ts_code, count(*) filter (r1 >= 0.095)::double sent_limit_gene, count(*) filter (r1 >= 0.095 and trade_date >= (select max(trade_date) from panel_e) - 20)::double sent_limit_active from u0 group by 1),
fav as (select ts_code, 1.0::double sent_hsgt_fav from panel_e group by 1 having sum(net_flow) > 0 and count(*) >= 3),
u4 as (select *, case when cast(substr(ts_code, 1, 6) as integer) % 41 = 0 then 1.0::double else 0.0::double end risk_delist_score,
  case when pledge_ratio > 30 then 1.0::double else 0.0::double end risk_pledge, case when pledge_ratio > 60 then 1.0::double else 0.0::double end risk_pledge_high,
  case when contains("name", 'ST') then 1.0::double else 0.0::double end risk_st, case when round(3 * k - 2 * d, 9) < 20 then 1.0::double else 0.0::double end kdj_oversold,
  case when round(k - d, 9) > 0 and round(pk - pd, 9) <= 0 and k < 50 then 1.0::double else 0.0::double end kdj_low_golden, case when rsi < 30 then 1.0::double else 0.0::double end rsi_oversold,
  case when wr < -80 then 1.0::double else 0.0::double end wr_oversold, case when boll_position < 0.2 then 1.0::double else 0.0::double end near_boll_lower,
  case when price_position_60d < 0.2 then 1.0::double else 0.0::double end in_bottom_zone,
  case when il20 is not null then -ln(1 + greatest(0.0::double, least(10.0::double, il20))) end liquidity_amihud from u3 join mfl using (ts_code) join lim using (ts_code) left join fav using (ts_code) where trade_date = (select max(trade_date) from panel_e)),
u5 as (select *, (kdj_oversold + rsi_oversold + wr_oversold + near_boll_lower) / 4 multi_oversold_flag from u4),
u6 as (select *, case when multi_oversold_flag > 0.5 and coalesce(vol_ratio_raw, 1) > 1.5 and coalesce(pmt_return_5d, 0) < -0.05 then 1.0::double else 0.0::double end reversal_signal from u5),
u7 as (select * replace ({', '.join(f'coalesce({c}, 0) as {c}' for c in ALL_FACTORS)}) from u6),
u8 as (select *, {' + '.join(
    f"(case when stddev_pop({c}) over (partition by trade_date) > 1e-9 then {apr(c) if xs.RULE_WEIGHTS[c] > 0 else '1.0::double - ' + apr(c)} else 0.5 end) * {abs(xs.RULE_WEIGHTS[c]) / TOTAL_W!r}::double"
    for c in ALL_FACTORS)} rule_raw from u7),
u9 as (select *, {band('rule_raw', 60.0, 35.0)} rule_score, risk_pledge_high = 0 and risk_st = 0 and risk_delist_score = 0 ok from u8)"""


@query("rule_selection", v.with_views(f"""
  select trade_date, ts_code, industry, "close", {r('rule_score', 'rule_score')}, pick_rank from (select *, row_number() over (order by round(rule_score, 9) desc, ts_code) pick_rank from (
    select *, count(*) filter (ok) over () n_ok from u9) where ok or n_ok < 20) where pick_rank <= 20""", "panel_e", extra=FULL))
def rule_selection(spark, sf):
    """Flagship: all factors, 33 weights, risk filter with relaxation, top names of the newest date."""
    base = cut_lineage(panel(spark, sf))  # read for factors, flows, limits, favourites and dates
    flow = mk.money_flow_by_code(base.select("ts_code", "net_flow", F.greatest("net_flow", F.lit(0.0)).alias("buy_amount"), F.greatest(-F.col("net_flow"), F.lit(0.0)).alias("sell_amount")))
    flow = rounded(flow, 6)
    pool = base.withColumn("limit_type", F.when(fx.W.pct_change("close") >= 0.095, "U").otherwise("D"))
    since = F.date_sub(base.agg(F.max("trade_date").alias("newest")).scalar(), 20)
    hits, liked = mk.limit_hits(pool, since), mk.favourites(base, "ts_code", "net_flow", 3)
    listed = base.withColumn("de_listed_date", F.when(F.substring("ts_code", 1, 6).cast("int") % 41 == 0, F.col("trade_date")))
    df = fx.latest_section(fx.rule_factors(listed, rows(spark, sf), lambda d: mk.enrich(d, flow, hits, liked)), base)
    picks = xs.rule_selection(df, 20, rows(spark, sf))
    return rounded(picks.select("trade_date", "ts_code", "industry", "close", "rule_score", "pick_rank"), 6)


@query("degenerate_score", v.with_views(
    f"select ts_code, trade_date, {r(f'round(60.0::double + ({apr(C)}) * 35.0::double, 1)', 'rule_score')} from panel_e", "panel_e"))
def degenerate_score(spark, sf):
    flat = panel(spark, sf).withColumn("pmt_return_1d", F.lit(0.5))
    return pick(xs.degenerate_rule_score(flat, {"pmt_return_1d": 5.0}, rows(spark, sf)), "rule_score")


IND = f"""n0 as (select *, case when count(*) over (partition by trade_date, industry) > 1 then {z('amount', 1, 'trade_date, industry')} else 0.0::double end zi from panel_e)"""


@query("industry_neutral", v.with_views(
    f"select ts_code, trade_date, {r(z('zi', 1), 'industry_neutral_score')} from n0", "panel_e", extra=IND))
def industry_neutral(spark, sf):
    return pick(xs.industry_neutral(panel(spark, sf), "amount", group_rows=rows(spark, sf)), "industry_neutral_score")


@query("industry_median_neutral", v.with_views(
    f"""select ts_code, trade_date, {r('pe - m1', 'pe_neutral')}, {r('roe - m2', 'roe_neutral')} from panel_e join
    (select trade_date, industry, quantile_cont(pe, 0.5) m1, quantile_cont(roe, 0.5) m2 from panel_e group by 1, 2) using (trade_date, industry)""", "panel_e"))
def industry_median_neutral(spark, sf):
    return pick(xs.industry_median_neutral(panel(spark, sf), ["pe", "roe"], group_rows=rows(spark, sf)), "pe_neutral", "roe_neutral")


def mmx(c):
    return f"({c} - min({c}) over (partition by trade_date)) / (max({c}) over (partition by trade_date) - min({c}) over (partition by trade_date) + 1e-9)"


STYLES = f"""y0 as (select *, coalesce({pct(C, 20)}, 0) mom, coalesce({roll('stddev_samp', 'r1', 20, 5)}, 0) vo,
    greatest(0.0::double, least(300.0::double, pe)) pe3, greatest(0.0::double, least(30.0::double, pb)) pb3,
    -(pb + greatest(-100.0::double, least(200.0::double, pe))) val, revenue_yoy + profit_yoy gr, ln(total_mv + 1) sz
  from (select *, {pct(C)} r1 from panel_e)),
y1 as (select y0.*, q.a, q.b from y0 join (select trade_date, quantile_cont(pe3, 0.9) a, quantile_cont(pb3, 0.9) b from y0 group by 1) q using (trade_date)),
y2 as (select *, {z('sz', 1)} style_size, {z('val', 1)} style_value, {z('gr', 1)} style_growth, {z('mom', 1)} style_momentum,
    {mmx('vo')} volatility_risk, 1 - {mmx('amount')} liquidity_risk,
    greatest(0.0::double, least(2.0::double, (pe3 / a + pb3 / b) / 2)) valuation_risk from y1)"""
STYLE_COLS = ("style_size", "style_value", "style_growth", "style_momentum", "volatility_risk", "liquidity_risk", "valuation_risk")


def styled(spark, sf):
    return xs.style_factors(fx.volatility(fx.returns(panel(spark, sf))), rows(spark, sf))


@query("style_factors", v.with_views(
    "select ts_code, trade_date, " + ", ".join(r(c, c) for c in STYLE_COLS)
    + ", " + r("(volatility_risk + liquidity_risk + valuation_risk) / 3", "risk_score") + " from y2", "panel_e", extra=STYLES))
def style_factors(spark, sf):
    return pick(styled(spark, sf), *STYLE_COLS, "risk_score")


VAL_BASE = f"""v0 as (select *, greatest(1.0::double, least(200.0::double, pe)) pc, greatest(0.1::double, least(50.0::double, pb)) bc from panel_e),
v1 as (select *, ((1 - greatest(0.01, least(0.99, {apr('pc', 'trade_date, industry')}))) + (1 - greatest(0.01, least(0.99, {apr('bc', 'trade_date, industry')})))) / 2 base,
  {apr('roe', 'trade_date, industry')} rr from v0)"""


@query("valuation_attractiveness", v.with_views(
    f"""select ts_code, trade_date, {r('''greatest(0.0::double, least(2.0::double, base * case when "close" > 150 then 0.55 when "close" > 80 then 0.7
      when "close" >= 15 and "close" <= 40 then 1.25 when "close" < 15 then 1.4 else 1.0 end))''', 'style_valuation_attractiveness')} from v1""",
    "panel_e", extra=VAL_BASE))
def valuation_attractiveness(spark, sf):
    return pick(xs.valuation_attractiveness(panel(spark, sf), rows(spark, sf)), "style_valuation_attractiveness")


@query("profit_quality", v.with_views(
    f"""select ts_code, trade_date, {r('''case when pe < 0 then 0.6 else greatest(0.6, least(1.4, 1.0 + case when rr > 0.8 then 0.3 when rr > 0.6 then 0.15 else 0 end
      + case when profit_yoy > 30 then 0.2 when profit_yoy > 10 then 0.1 when profit_yoy < -50 then -0.25 when profit_yoy < -20 then -0.15 else 0 end)) end''', 'profit_quality')} from v1""",
    "panel_e", extra=VAL_BASE))
def profit_quality(spark, sf):
    return pick(xs.profit_quality(panel(spark, sf), rows(spark, sf)), "profit_quality")


@query("fundamental_attractiveness", v.with_views(
    f"""select ts_code, trade_date, {r('''greatest(0.0::double, least(2.0::double, base * (1.0 + greatest(0.0::double, least(1.0::double, (greatest(0.0::double, least(2.0::double, roe / 15))
      + case when profit_yoy > 60 then 0.5 when profit_yoy > 30 then 0.3 when profit_yoy < -50 then -0.4 when profit_yoy < -20 then -0.2 else 0 end) / 2)))))
      * case when negative_ratio > 0.3 then 0.7 else 1.0 end''', 'fundamental_attractiveness')} from v1""", "panel_e", extra=VAL_BASE))
def fundamental_attractiveness(spark, sf):
    return pick(xs.fundamental_attractiveness(panel(spark, sf), rows(spark, sf)), "fundamental_attractiveness")


def _residual(y, x):
    over = "over (partition by trade_date)"
    return f"{y} - avg({y}) {over} - coalesce(regr_slope({y}, {x}) {over}, 0) * ({x} - avg({x}) {over})"


# Sequential orthogonalisation of the styles gives the multivariate residual in SQL.
ORTHO = STYLES + f""", z1 as (select *, style_size e1 from y2), z2 as (select *, {_residual('style_value', 'e1')} e2 from z1),
z3 as (select *, {_residual('style_growth', 'e1')} g1 from z2), z4 as (select *, {_residual('g1', 'e2')} e3 from z3),
z5 as (select *, {_residual('style_momentum', 'e1')} h1 from z4), z6 as (select *, {_residual('h1', 'e2')} h2 from z5), z7 as (select *, {_residual('h2', 'e3')} e4 from z6),
z8 as (select *, {_residual('roe', 'e1')} q1 from z7), z9 as (select *, {_residual('q1', 'e2')} q2 from z8), za as (select *, {_residual('q2', 'e3')} q3 from z9),
zb as (select *, case when stddev_pop(style_momentum) over (partition by trade_date) > 1e-9 then {_residual('q3', 'e4')} else q3 end q4 from za)"""


@query("style_neutral", v.with_views(f"select ts_code, trade_date, {r('q4', 'style_neutral_score')} from zb", "panel_e", extra=ORTHO))
def style_neutral(spark, sf):
    """Residual on four styles: per-date sufficient statistics, solved per date."""
    return pick(xs.style_neutral(styled(spark, sf), "roe"), "style_neutral_score")


def slope_part(c):
    return f"case when stddev_pop({c}) over (partition by trade_date) > 1e-9 then regr_slope(roe, {c}) over (partition by trade_date) * {c} else 0 end"


@query("style_neutral_single", v.with_views(
    "select ts_code, trade_date, " + r("roe - " + " - ".join(slope_part(c) for c in STYLE_COLS[:4]), "neutral_score") + " from y2",
    "panel_e", extra=STYLES))
def style_neutral_single(spark, sf):
    return pick(xs.style_neutral_single(styled(spark, sf), "roe", xs.STYLE, group_rows=rows(spark, sf)), "neutral_score")


@query("factor_return_estimates", v.with_views(
    f"""select trade_date, {r('regr_intercept(fr, lx)', 'intercept')}, {r('regr_slope(fr, lx)', 'b_size')} from (
      select trade_date, ln(total_mv) lx, lead({C}) {W} / {C} - 1 fr from panel_e) where fr is not null group by 1 having count(*) > 1""", "panel_e"))
def factor_return_estimates(spark, sf):
    df = panel(spark, sf).withColumns({"size": F.log("total_mv"), "ret": fx.W.forward_return("close", 1)})
    return rounded(xs.factor_returns(df, ["size"], "ret"))


@query("concentration_penalty", v.with_views(
    f"""select ts_code, trade_date, {r('''case when industry = t.top and share > 0.15 then amount * 0.7::double else amount end''', 'amount')} from panel_e join (
      select trade_date, arg_max(industry, (n, industry)) top, max(n) / sum(n) share from (select trade_date, industry, count(*) n from panel_e group by 1, 2) group by 1) t
      using (trade_date)""", "panel_e"))
def concentration_penalty(spark, sf):
    return pick(xs.concentration_penalty(panel(spark, sf), "amount", 0.15), "amount")


@query("risk_filters", v.with_views(
    """select ts_code, trade_date, amount from y2 where not contains("name", 'ST') and amount >= 50
      and (volatility_risk + liquidity_risk + valuation_risk) / 3 < 0.55""", "panel_e", extra=STYLES))
def risk_filters(spark, sf):
    return xs.apply_risk_filters(styled(spark, sf), 50.0, 0.55).select("ts_code", "trade_date", "amount")


@query("neutrality_report", v.with_views(f"""
  select trade_date, {r('avg(pe)', 'pe_mean')}, {r('avg(case when pe < 0 then 1.0::double else 0.0::double end)', 'loss_ratio')},
    {r('avg(roe)', 'roe_mean')}, {r('avg(profit_yoy)', 'profit_yoy_mean')}, {r('avg(style_size)', 'style_size_mean')},
    {r('quantile_cont(va, 0.25)', 'va_p25')}, {r('quantile_cont(va, 0.75)', 'va_p75')},
    {r('avg(case when "close" between 10 and 40 then 1.0::double else 0.0::double end)', 'mid_price_share')}, {r('max(share)', 'max_industry_concentration')}
  from (select *, count(*) over (partition by trade_date, industry) * 1.0::double / count(*) over (partition by trade_date) share from (
    select y2.*, va.va, row_number() over (partition by y2.trade_date order by round(y2.amount, 9) desc, y2.ts_code) rk from y2 join (
      select ts_code, trade_date, greatest(0.0::double, least(2.0::double, base * case when "close" > 150 then 0.55 when "close" > 80 then 0.7
      when "close" >= 15 and "close" <= 40 then 1.25 when "close" < 15 then 1.4 else 1.0 end)) va from v1) va using (ts_code, trade_date)) where rk <= 50) group by 1""",
    "panel_e", extra=STYLES + ", " + VAL_BASE))
def neutrality_report(spark, sf):
    df = xs.valuation_attractiveness(styled(spark, sf), rows(spark, sf))
    rep = xs.neutrality_report(df.withColumn("neutral_score", F.col("amount")), "neutral_score", 50)
    pe = ranks.top_n(df, ["trade_date"], [F.round("amount", 9).desc(), F.col("ts_code")], 50, "ts_code", "_rk")
    pe = pe.groupBy("trade_date").agg(F.avg("pe").alias("pe_mean"))
    cols = ("pe_mean", "loss_ratio", "roe_mean", "profit_yoy_mean", "style_size_mean", "va_p25", "va_p75", "mid_price_share",
            "max_industry_concentration")
    return rounded(rep.join(pe, "trade_date").select("trade_date", *cols))


VETO = """case when pe > 150 then 'pe_bubble' when pb > 15 then 'pb_high' when pe < 0 and roe < -5 then 'lasting_loss' end"""
VETO_REASON = f"array_to_string(list_filter([case when negative_ratio > 0.35 then 'negative_posts' end, {VETO}], lambda x: x is not null), ' | ')"


@query("veto_flags", v.with_views(
    f"""select ts_code, trade_date, negative_ratio > 0.35 nlp_veto, {VETO} is not null fundamental_veto, {VETO_REASON} veto_reason from panel_e""", "panel_e"))
def veto_flags(spark, sf):
    return xs.veto_columns(panel(spark, sf)).select("ts_code", "trade_date", "nlp_veto", "fundamental_veto", "veto_reason")


@query("veto_counts", v.with_views(
    f"""select trade_date, veto_reason, count, pos from (select *, row_number() over (partition by trade_date order by count desc, veto_reason) pos from (
      select trade_date, veto_reason, count(*) count from (select *, {VETO_REASON} veto_reason,
        row_number() over (partition by trade_date order by round(amount, 9) desc, ts_code) rk from panel_e) where rk <= 100 and veto_reason <> '' group by 1, 2)) where pos <= 5""", "panel_e"))
def veto_counts(spark, sf):
    return xs.veto_counts(xs.veto_columns(panel(spark, sf)), "amount").select("trade_date", "veto_reason", "count", "pos")


SMALL = f"""c0 as (select *, {pct(C, 5)} ret_5, {pct(C, 20)} ret_20, {roll('avg', 'vol', 20)} vma, {roll('stddev_samp', 'r1', 20, 5)} v20
   from (select *, {pct(C)} r1 from panel_e)),
c1 as (select *, {apr('total_mv')} sq, {apr('circ_mv')} fq, case when v20 is not null then {apr('v20')} end vq from c0),
c2 as (select *, case when fq <= 0.3 and circ_mv between 1e4 and 1e6 then 1.0::double else 0.0::double end sc, 1 - sq tilt,
   vol * "close" / (circ_mv * 1e8 + 1e-9) tu from c1),
c3 as (select *, tilt * revenue_yoy a, tilt * coalesce(ret_20, 0) b, tilt * roe c, tilt * tu d, tilt / (pb + 1e-9) e from c2),
c4 as (select *, sc * ({' + '.join(f"case when stddev_samp({x}) over (partition by trade_date) > 1e-9 then ({x} - avg({x}) over (partition by trade_date)) / stddev_samp({x}) over (partition by trade_date) else 0 end" for x in 'abcde')}) / 5 comp from c3)"""


def small(spark, sf):
    return xs.small_cap_factors(fx.small_cap_series(panel(spark, sf)), group_rows=rows(spark, sf))


@query("small_cap_factors", v.with_views(
    f"""select ts_code, trade_date, {r('sq', 'size_quantile')}, {r('fq', 'float_size_quantile')}, sc is_small_cap, {r('a', 'small_cap_revenue_growth')},
    {r('b', 'small_cap_momentum_20d')}, {r('c', 'small_cap_roe')}, {r('e', 'small_cap_pb')}, {r('sc * -coalesce(ret_5, 0)', 'small_cap_reversal')},
    {r('sc * vol / (vma + 1e-9)', 'small_cap_liquidity_spike')}, {r('tilt * coalesce(v20, 0)', 'small_cap_volatility')},
    sc * case when vq < 0.3 then 1.0::double else 0.0::double end small_cap_low_vol, {r('comp', 'small_cap_composite_score')} from c4""", "panel_e", extra=SMALL))
def small_cap_factors(spark, sf):
    return pick(small(spark, sf), "size_quantile", "float_size_quantile", "is_small_cap", "small_cap_revenue_growth",
                "small_cap_momentum_20d", "small_cap_roe", "small_cap_pb", "small_cap_reversal", "small_cap_liquidity_spike",
                "small_cap_volatility", "small_cap_low_vol", "small_cap_composite_score")


@query("small_cap_selection", v.with_views(
    f"""select trade_date, ts_code, {r('comp', 'small_cap_composite_score')}, pick_rank from (select *, row_number() over (
      partition by trade_date order by round(comp, 9) desc, ts_code) pick_rank from c4 where sc = 1 and comp >= 0.1) where pick_rank <= 10""", "panel_e", extra=SMALL))
def small_cap_selection(spark, sf):
    df = xs.small_cap_selection(small(spark, sf), 0.1, 10)
    return rounded(df.select("trade_date", "ts_code", "small_cap_composite_score", "pick_rank"))


def rz(c):
    return f"(w_{c} - m_{c}) / (i_{c} * 0.7413::double)"


RC = ("rs", "ts", "bs", "ai", "ag")
COMPOSITE = f"""g0 as (select *, amount / 10 rs, pe ts, roe bs, revenue_yoy ai, coalesce({roll('stddev_samp', 'r1', 20, 5)}, null) vo from (select *, {pct(C)} r1 from panel_e)),
g1 as (select *, 1 - least(abs(ai - rs), 20) / 20 ag from g0),
g2 as (select trade_date, avg(vo) mv, {', '.join(f'quantile_cont({c}, 0.01) a_{c}, quantile_cont({c}, 0.99) b_{c}' for c in RC)} from g1 group by 1),
g3 as (select g1.*, mv, {', '.join(f'least(greatest({c}, a_{c}), b_{c}) w_{c}' for c in RC)} from g1 join g2 using (trade_date)),
g4 as (select trade_date, {', '.join(f'quantile_cont(w_{c}, 0.5) m_{c}, quantile_cont(w_{c}, 0.75) - quantile_cont(w_{c}, 0.25) i_{c}, avg(w_{c}) av_{c}, stddev_samp(w_{c}) sd_{c}' for c in RC)} from g3 group by 1),
g5 as (select g3.*, {', '.join(f'case when i_{c} > 1e-9 then {rz(c)} when sd_{c} > 1e-9 then (w_{c} - av_{c}) / sd_{c} else 0 end z_{c}' for c in RC)} from g3 join g4 using (trade_date)),
g6 as (select *, (case when coalesce(mv, 0) > 0.025 then 0.5 * z_rs + 0.2 * z_ts + 0.12 * z_bs + 0.08 * z_ai + 0.1 * z_ag
  else 0.4 * z_rs + 0.25 * z_ts + 0.15 * z_bs + 0.1 * z_ai + 0.1 * z_ag end) * greatest(0.85, least(1.05, 1.05 - least(pledge_ratio, 50) / 1000)) fs from g5)"""


@query("final_composite", v.with_views(
    f"select ts_code, trade_date, {r('fs', 'v19_final_score')} from g6", "panel_e", extra=COMPOSITE))
def final_composite(spark, sf):
    df = fx.volatility(panel(spark, sf)).withColumns({
        "rule_score": F.col("amount") / 10, "trend_score": F.col("pe"), "bottom_score": F.col("roe"), "ai_score": F.col("revenue_yoy")})
    return pick(xs.final_composite(df, rows(spark, sf)), "v19_final_score")


@query("fallback_scores", v.with_views(
    f"""select ts_code, trade_date, {r(band('t', 60.0, 30.0), 'trend_score')}, {r(band('b', 60.0, 30.0), 'bottom_score')} from (
      select *, coalesce({pct(C, 20)}, 0) t, case when ({C} - {LO60}) / ({HI60} - {LO60} + 1e-9) < 0.2 then 1.0::double else 0.0::double end + (1.0::double - vol / 100) * 0.5::double b from panel_e)""", "panel_e"))
def fallback_scores(spark, sf):
    df = fx.price_position(fx.returns(panel(spark, sf)))
    zero = {c: F.lit(0.0) for c in ("ma_trend_score", "macd_golden", "ma_bull", "multi_oversold_flag", "rsi_divergence", "reversal_signal")}
    return pick(xs.fallback_scores(df.withColumns({**zero, "rsi": F.col("vol")})), "trend_score", "bottom_score")


#: Columns besides the weighted factors that the item view and its scores read.
VIEWED = frozenset("""ts_code trade_date industry close pe pb roe revenue_yoy profit_yoy negative_ratio pledge_ratio rsi ma20_distance multi_oversold_flag ma_bull
    volat_hist_20d kdj_j pmt_return_20d ma_trend_score macd_golden rsi_divergence reversal_signal in_bottom_zone""".split())


@query("item_view")
def item_view(spark, sf):
    """Scores, confidence, position and signals of the newest date (hand-made rows in tests)."""
    base = cut_lineage(panel(spark, sf))  # read for factors, the median size and dates
    df = fx.latest_section(fx.rule_factors(base, rows(spark, sf), tasks=fx.series_tasks(base)), base)
    df = cut_lineage(df.select(*[c for c in df.columns if c in xs.RULE_WEIGHTS or c in VIEWED]))  # read for ranks and for the rows they join
    df = xs.valuation_attractiveness(xs.fallback_scores(df, rows(spark, sf)), rows(spark, sf))
    df = xs.score_band(xs.weighted_rank_score(df, group_rows=rows(spark, sf)), ["trade_date"], "rule_raw", "rule_score", group_rows=rows(spark, sf))
    return rounded(xs.item_view(df).select("ts_code", "trade_date", "buy_score", "confidence", "position_weight", "position_level",
                              "buy_signals", "veto_reason"), 4)


QUAL = f"""w0 as (select *, {roll('avg', C, 20)} m20, {pct(C, 20)} r20 from panel_e),
w1 as (select *, ({C} - m20) / (m20 + 1e-9) dist from w0),
w2 as (select *, dist >= -0.03 or coalesce(r20, 0) > 0.01 tq, dist < -0.07 bq from w1)"""


@query("qualification", v.with_views("select ts_code, trade_date, tq trend_qualified, bq bottom_qualified from w2", "panel_e", extra=QUAL))
def qualification(spark, sf):
    return _qualified(spark, sf).select("ts_code", "trade_date", "trend_qualified", "bottom_qualified")


def _qualified(spark, sf):
    df = fx.moving_averages(fx.returns(panel(spark, sf))).select("ts_code", "trade_date", "amount", "ma20_distance", "pmt_return_20d")
    return xs.qualification(df.withColumns({c: F.lit(None).cast("double") for c in ("ma_bull", "multi_oversold_flag", "rsi", "kdj_j")}))


@query("qualified_half", v.with_views(
    """select ts_code, trade_date, tq trend_qualified, pos from (select *, row_number() over (partition by trade_date
      order by tq desc, round(amount, 9) desc, ts_code) pos from w2) where pos <= 15""", "panel_e", extra=QUAL))
def qualified_half(spark, sf):
    out = xs.qualified_half(_qualified(spark, sf), "trend_qualified", "amount", 15)
    return out.select("ts_code", "trade_date", "trend_qualified", "pos")


@query("largest_caps", v.with_views(
    "select ts_code, trade_date, total_mv from panel_e qualify row_number() over (partition by trade_date order by total_mv desc, ts_code) <= 40", "panel_e"))
def largest_caps(spark, sf):
    return xs.largest_caps(panel(spark, sf), 40).select("ts_code", "trade_date", "total_mv")


@query("largest_caps_salted", v.with_views(
    "select ts_code, trade_date, total_mv from panel_l qualify row_number() over (partition by trade_date order by total_mv desc, ts_code) <= 1200", "panel_l"))
def largest_caps_salted(spark, sf):
    return xs.largest_caps(v.panel_l(spark, sf), 1200).select("ts_code", "trade_date", "total_mv")


@query("smallest_caps", v.with_views(
    "select ts_code, total_mv from panel_e where trade_date = (select max(trade_date) from panel_e) order by total_mv, ts_code limit 25", "panel_e"))
def smallest_caps(spark, sf):
    return xs.smallest_caps(panel(spark, sf), 25).select("ts_code", "total_mv")


@query("latest_constituents", """
  select l_suppkey con_code from lineitem where cast(l_shipdate as date) = (select max(cast(l_shipdate as date)) from lineitem) group by 1""")
def latest_constituents(spark, sf):
    li = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("con_code"), F.to_date("l_shipdate").alias("d"))
    return xs.latest_constituents(li, "con_code", "d").select("con_code")


@query("industry_anchors", v.with_views(
    f"""select ts_code, trade_date, industry, {r('sc', 'anchor_score')}, pos from (select *, row_number() over (partition by trade_date, industry
      order by round(sc, 9) desc, ts_code) pos from (select *, 0.6::double * total_mv / (max(total_mv) over (partition by trade_date, industry) + 1e-9)
        + 0.4::double * amount / (max(amount) over (partition by trade_date, industry) + 1e-9) sc, count(*) over (partition by trade_date, industry) n from panel_e))
      where pos <= case when n >= 5 then 2 else 1 end""", "panel_e"))
def industry_anchors(spark, sf):
    return rounded(xs.industry_anchors(panel(spark, sf), group_rows=rows(spark, sf)).select("ts_code", "trade_date", "industry", "anchor_score", "pos"))
