"""Queries over market aggregates and rule strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as fx
from ..operators import market as mk
from ..operators import strategies as st
from ..operators import xsection as xs
from ..operators.windows import Series, latest_per_key
from . import views as v
from .factor_queries import W, fr, hist_sql, pct, roll, rollp
from .registry import query, r, rounded
from .section_queries import APR_SIZE, apr

C = '"close"'


def rows(spark, sf):
    return v.section_rows(spark, sf, "panel_e")


@query("money_flow_by_code", """
  select l_suppkey ts_code, round(avg(case l_returnflag when 'A' then c when 'R' then -c else 0 end), 4) + 0.0::double mf_net_main,
    round(sum(case when l_returnflag = 'A' then c else 0 end)::double / (sum(case when l_returnflag = 'A' then c else 0 end) + sum(case when l_returnflag = 'R' then c else 0 end) + 1e-9), 6) mf_main_ratio
  from (select *, round(l_extendedprice * 100)::bigint c from lineitem) group by 1""")
def money_flow_by_code(spark, sf):
    li = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ts_code"), "l_returnflag", v.cents("l_extendedprice").alias("c"))
    side = lambda f: F.when(F.col("l_returnflag") == f, F.col("c")).otherwise(0)
    df = li.select("ts_code", (side("A") - side("R")).alias("net_flow"), side("A").alias("buy_amount"), side("R").alias("sell_amount"))
    out = mk.money_flow_by_code(df)
    return out.select("ts_code", (F.round("mf_net_main", 4) + F.lit(0.0)).alias("mf_net_main"), F.round("mf_main_ratio", 6).alias("mf_main_ratio"))


@query("limit_hits", """
  select o_custkey ts_code, count(*) filter (o_orderstatus = 'F') sent_limit_gene, count(*) filter (o_orderstatus = 'F' and cast(o_orderdate as date) >= date '2000-01-01') sent_limit_active from orders group by 1""")
def limit_hits(spark, sf):
    o = v.table(spark, sf, "orders")
    pool = o.select(F.col("o_custkey").alias("ts_code"), F.when(F.col("o_orderstatus") == "F", "U").otherwise("D").alias("limit_type"), F.to_date("o_orderdate").alias("trade_date"))
    return mk.limit_hits(pool, F.lit("2000-01-01").cast("date"))


@query("favourites", v.with_views("select ts_code, round(sum(net_flow), 2) total, count(*) n from panel_e group by 1 having sum(net_flow) > 0 and count(*) >= 3", "panel_e"))
def favourites(spark, sf):
    return rounded(mk.favourites(v.panel_e(spark, sf), "ts_code", "net_flow", 3), 2)


@query("latest_per_group", """
  select l_suppkey, max(l_shipdate)::date last_date, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) l_orderkey from lineitem group by 1""")
def latest_per_group(spark, sf):
    li = v.table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("last_date"), "l_orderkey", "l_linenumber")
    return latest_per_key(li, ["l_suppkey"], "last_date", ["l_orderkey", "l_linenumber"]).drop("l_linenumber")


@query("latest_non_null", v.with_views("""
  select ts_code, arg_max(pe, (trade_date, pe)) filter (pe is not null) pe, arg_max(pb, (trade_date, pb)) filter (pb is not null) pb
  from (select ts_code, trade_date, case when vol > 2 then pe end pe, case when vol > 3 then pb end pb from panel_e) group by 1""", "panel_e"))
def latest_non_null(spark, sf):
    df = v.panel_e(spark, sf).select("ts_code", "trade_date", F.when(F.col("vol") > 2, F.col("pe")).alias("pe"), F.when(F.col("vol") > 3, F.col("pb")).alias("pb"))
    return mk.first_non_null_latest(df, "ts_code", "trade_date", ["pe", "pb"])


PC = f"""pc as (select *, coalesce({pct(C)} * 100, 0) p from panel_e)"""


def with_pct(spark, sf):
    df = v.panel_e(spark, sf)
    return df.withColumn("pct_chg", F.coalesce(fx.W.pct_change("close") * 100, F.lit(0.0)))


def emo(src, p):
    return f"""em0 as (select trade_date, count(*) n, count(*) filter ({p} >= 9.5) lu, count(*) filter ({p} <= -9.5) ld, count(*) filter ({p} >= 3) s, count(*) filter ({p} <= -3) w, quantile_cont({p}, 0.5) md from {src} group by 1),
em as (select *, greatest(0.0::double, least(100.0::double, least(lu, 120) / 120 * 32 + least(s / n, 0.25) / 0.25 * 24 + greatest(0.0::double, least(100.0::double, (md + 2) / 4.5 * 22))
  + greatest(0, 22 - least(ld, 80) / 80 * 22) - least(w / n, 0.2) / 0.2 * 10)) es from em0)"""


LEVEL = "case when es >= 72 then 'climax' when es >= 56 then 'recovery' when es >= 40 then 'divided' else 'retreat' end"


@query("market_emotion", v.with_views(
    f"select trade_date, lu limit_up_count, ld limit_down_count, s strong_count, w weak_count, {r('md', 'median_pct')}, {r('es', 'emotion_score')}, {LEVEL} emotion_level from em",
    "panel_e", extra=PC + ", " + emo("pc", "p")))
def market_emotion(spark, sf):
    return rounded(mk.emotion(with_pct(spark, sf), group_rows=rows(spark, sf)))


def heat(src, p, amt, name, mix):
    first = "least(greatest(a, 0), 8) / 8 * 45 + least(n, 20) / 20 * 20" if mix else "least(greatest(a, 0), 8) / 8 * 38 + least(s, 20) / 20 * 22"
    return f"""{name}0 as (select trade_date, industry, count(*) n, count(*) filter ({p} >= 9.5) a, count(*) filter ({p} >= 3) s, avg({p}) ap, sum({amt}) am from {src} group by 1, 2),
{name} as (select *, {first} + least(greatest(ap, 0), 10) / 10 * 20 + {apr('am')} * {15 if mix else 20} hot from {name}0)"""


@query("industry_heat", v.with_views(
    f"select trade_date, industry, n industry_count, a industry_limit_up, s industry_strong, {r('ap', 'industry_avg_pct')}, {r('am', 'industry_amount_yi')}, {r('hot', 'hot_score')} from ht",
    "panel_e", extra=PC + ", " + heat("pc", "p", "round(amount * 100)::bigint", "ht", False)))
def industry_heat(spark, sf):
    df = with_pct(spark, sf).withColumns({"is_limit_up": F.col("pct_chg") >= 9.5, "amount_yi": v.cents("amount")})
    out = mk.industry_heat(df)
    return rounded(out.withColumn("industry_amount_yi", F.col("industry_amount_yi").cast("double")))


TIMING = f"""t0 as (select *, {pct(C)} r1, {pct(C, 20)} r20, vol / ({rollp('avg', 'vol', 20, 5)} + 1e-9) vr, 1.0::double - {APR_SIZE} ss from panel_e),
t1 as (select *, {roll('stddev_samp', 'r1', 20, 5)} v20 from t0),
t2 as (select trade_date, avg(coalesce(r20, 0)) m, quantile_cont(coalesce(r20, 0), 0.5) md, coalesce(avg(v20), 0) vo, avg(case when ss > 0.7 then 1.0::double else 0.0::double end) sm, count(r20)::double n,
  avg(r20) mm, stddev_samp(r20) sd, count(*) filter (r20 > 0) up from t1 group by 1),
t3 as (select *, md > 0.02 and m > 0.01 and vo <= 0.028 bull, md < -0.02 and m < -0.01 bear, vo > 0.028 hot from t2),
t4 as (select *, case when bull then 'bull' when bear then 'bear' when hot and m <= -0.01 then 'bear' else 'neutral' end rg,
  0.5 * (0.5 + 0.5 * (1 - exp(-(abs(up / n - 0.5) / (0.5 / sqrt(n))) / 3))) + 0.3 * tanh(abs(case when sd > 1e-9 then mm / sd * sqrt(n) else 0 end) / 4) + 0.2 * least(1, 0.4 + 0.12 * log10(greatest(n, 1))) cf from t3)"""


@query("market_timing", v.with_views(f"""
  select trade_date, case when sm > 0.6 then rg || '_small_dominant' else rg end regime, case when bull then true when bear then false when hot then m > -0.01 else true end trend_allowed,
    case when bull then 0.65::double when bear then 0.0::double when hot then case when m > -0.01 then 0.3::double else 0.0::double end else 0.5::double end trend_weight,
    {r('case when bull then least(95, 60 + m * 300) when bear then greatest(15, 40 + m * 200) when hot then greatest(25, 45 + m * 150) else 50.0::double end', 'market_score')},
    {r('vo', 'volatility')}, round(case when n >= 30 then 100 * greatest(0.35, least(0.85, cf)) when n > 0 then 45.0::double else 50.0::double end, 1) confidence from t4""", "panel_e", extra=TIMING))
def market_timing(spark, sf):
    df = fx.volume_price(fx.volatility(fx.returns(fx.size(v.panel_e(spark, sf), rows(spark, sf)))))
    return rounded(mk.market_timing(df, rows(spark, sf)))


@query("size_regime", v.with_views(f"""
  select trade_date, {r('s', 'small_ret')}, {r('l', 'large_ret')}, {r('sd', 'ret_std')}, case when s - l > 0.025 then 'small_cap_rally' when s - l < -0.025 then 'large_cap_rally' when sd > 0.045 then 'volatile' else 'balanced' end regime
  from (select trade_date, avg(r5) filter (q <= 0.3) s, avg(r5) filter (q >= 0.7) l, stddev_samp(r5) sd from (select *, {apr('total_mv')} q, {pct(C, 5)} r5 from panel_e) group by 1)""", "panel_e"))
def size_regime(spark, sf):
    df = v.panel_e(spark, sf).withColumn("ret_5", fx.W.pct_change("close", 5))
    df = xs.ranks.average_ranks(df, ["trade_date"], {"size_quantile": "total_mv"}, rows(spark, sf))
    return rounded(mk.size_regime(df, "ret_5"))


LOOK = 60
STATES = f"""m0 as (select *, row_number() over (order by obs_date) - 1 i, ("value" / max("value") over (order by obs_date rows between {LOOK - 1} preceding and current row) - 1) * 100 dd,
  ("value" / lag("value", 20) over (order by obs_date) - 1) * 100 r20, {', '.join(f'(lead("value", {h}) over (order by obs_date) / "value" - 1) * 100 f{h}' for h in (5, 20, 60))} from series_d),
m1 as (select *, case when dd > -5 then 'shallow' when dd > -10 then 'medium' when dd > -20 then 'deep' else 'crash' end dd_state,
  case when r20 > 3 then 'strong' when r20 >= -3 then 'flat' when r20 > -8 then 'sliding' else 'plunge' end r20_state from m0 where i >= {LOOK})"""


@query("market_states", v.with_views(f"select obs_date, {r('dd', 'dd')}, {r('r20', 'r20')}, dd_state, r20_state, {r('f20', 'f20')} from m1", "series_d", extra=STATES))
def market_states(spark, sf):
    df = mk.market_states(v.series_d(spark, sf), "series_name", "obs_date", "value", LOOK)
    return rounded(df.select("obs_date", "dd", "r20", "dd_state", "r20_state", "f20"))


def at(h, q):
    return f"round(l{h}[least(cast(floor(len(l{h}) * {q}) as bigint), len(l{h}) - 1) + 1], 1) + 0.0::double"


@query("state_probabilities", v.with_views("""
  select dd_state, r20_state, samples, """ + ", ".join(
    f"case when samples >= 15 then {e} end {n}" for n, e in [
        *[x for h in (5, 20, 60) for x in ((f"mean_{h}", f"round(a{h}, 1) + 0.0::double"), (f"p10_{h}", at(h, 0.1)), (f"p50_{h}", at(h, 0.5)), (f"p90_{h}", at(h, 0.9)), (f"up_{h}", f"round(u{h} * 100)"))],
        ("rebound_5", "round(rb * 100)"), ("below_5_in_20", "round(b5 * 100)")])
    + " from (select dd_state, r20_state, count(f20) samples, avg(case when f5 is not null then case when f5 > 0 then 1.0::double else 0.0::double end end) rb, avg(case when f20 is not null then case when f20 < -5 then 1.0::double else 0.0::double end end) b5, "
    + ", ".join(f"avg(f{h}) filter (f20 is not null) a{h}, avg(case when f{h} > 0 then 1.0::double when f{h} is not null then 0.0::double end) filter (f20 is not null) u{h}, list_sort(list(f{h}) filter (f20 is not null and f{h} is not null)) l{h}" for h in (5, 20, 60))
    + " from m1 group by 1, 2)", "series_d", extra=STATES))
def state_probabilities(spark, sf):
    states = mk.market_states(v.series_d(spark, sf), "series_name", "obs_date", "value", LOOK)
    df = mk.state_probabilities(states, "series_name").drop("series_name")
    return rounded(df, 4)


@query("same_state_recent", v.with_views("""
  select obs_date, round(f20, 1) + 0.0::double f20 from m1 where (dd_state, r20_state) = (select (arg_max(dd_state, obs_date), arg_max(r20_state, obs_date)) from m1) and f20 is not null
  order by obs_date desc limit 8""", "series_d", extra=STATES))
def same_state_recent(spark, sf):
    states = mk.market_states(v.series_d(spark, sf), "series_name", "obs_date", "value", LOOK)
    return rounded(mk.same_state_recent(states, "series_name", "obs_date").drop("series_name"), 1)


@query("stratified_sample", v.with_views("""select ts_code, trade_date, "close" from panel_l
  qualify row_number() over (partition by year(trade_date) order by md5(ts_code || '|' || cast(trade_date as varchar)), ts_code, trade_date) <= 200""", "panel_l"))
def stratified_sample(spark, sf):
    df = v.panel_l(spark, sf).select("ts_code", "trade_date", "close")
    return mk.stratified_sample(df, F.year("trade_date"), ["ts_code", "trade_date"], 200)


@query("whole_key_sample", v.with_views("""select ts_code, trade_date, "close" from panel_l where cast('0x' || substr(md5(ts_code), 1, 8) as bigint) % 10000 < 3000""", "panel_l"))
def whole_key_sample(spark, sf):
    return mk.whole_key_sample(v.panel_l(spark, sf).select("ts_code", "trade_date", "close"), "ts_code", 0.3)


# ---- sentiment -----------------------------------------------------------------------

POSTS = """po as (select user_id, ts, (value - 50) / 500 s, (1 + user_id % 5) * 1.0::double w, event_id from events),
se as (select lpad(cast(user_id as varchar), 6, '0') k, count(*) pc, sum(s * w) / sum(w) ws, avg(s) sm, stddev_pop(s) sd, avg(case when s < -0.15 then 1.0::double else 0.0::double end) ng, avg(case when s > 0.15 then 1.0::double else 0.0::double end) ps, avg(w) im from po group by 1),
sg as (select *, case when pc < 8 then 0.0::double else greatest(-1.0::double, least(1.0::double, ws)) end wsent, case when pc < 8 then 0.42::double else ng end neg from se)"""


def detail(spark, sf):
    e = v.table(spark, sf, "events")
    posts = e.select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("k"), ((F.col("value") - 50) / 500).alias("s"), (1 + F.col("user_id") % 5).cast("double").alias("w"))
    return mk.sentiment_aggregate(posts, "k", "s", "w")


@query("sentiment_aggregate", v.with_views(
    f"select k, pc post_count, {r('sm', 'sentiment_mean')}, {r('sd', 'sentiment_std')}, {r('ps', 'positive_ratio')}, {r('im', 'importance_mean')}, {r('wsent', 'weighted_sentiment')}, {r('neg', 'negative_ratio')}, neg > 0.48 veto from sg", extra=POSTS))
def sentiment_aggregate(spark, sf):
    return rounded(detail(spark, sf))


SECTOR_S = POSTS + """, dt as (select p.ts_code, any_value(wsent) ws, any_value(neg) neg, any_value(neg > 0.10) veto from (select distinct ts_code from panel_e) p join sg on sg.k = substr(p.ts_code, 1, 6) group by 1),
an as (select trade_date, industry, ts_code from (select *, row_number() over (partition by trade_date, industry order by round(sc, 9) desc, ts_code) pos from (select *, 0.6::double * total_mv / (max(total_mv) over (partition by trade_date, industry) + 1e-9)
   + 0.4::double * amount / (max(amount) over (partition by trade_date, industry) + 1e-9) sc, count(*) over (partition by trade_date, industry) n from panel_e)) where pos <= case when n >= 5 then 2 else 1 end),
gi as (select trade_date, industry, avg(coalesce(ws, 0)) s, avg(coalesce(neg, 0)) ng, count(*) filter (veto) vv, count(*) n from an left join dt using (ts_code) group by 1, 2),
gj as (select *, vv >= greatest(1, ceil(n / 2)) vt, case when count(*) over (partition by trade_date) < 3 then s when stddev_pop(s) over (partition by trade_date) > 1e-9
   then greatest(-3, least(3, (s - avg(s) over (partition by trade_date)) / (stddev_pop(s) over (partition by trade_date) + 1e-9))) else 0 end z from gi),
gk as (select *, (z - min(z) over (partition by trade_date)) / (max(z) over (partition by trade_date) - min(z) over (partition by trade_date) + 1e-9) rk from gj)"""


@query("sector_sentiment", v.with_views(
    f"select p.ts_code, p.trade_date, {r('coalesce(z, 0)', 'nlp_score')}, {r('coalesce(ng, 0)', 'sector_negative_ratio')}, coalesce(vt, false) veto, {r('coalesce(rk, 0.5)', 'industry_sentiment_rank')} from panel_e p left join gk using (trade_date, industry)",
    "panel_e", extra=SECTOR_S))
def sector_sentiment(spark, sf):
    df = v.panel_e(spark, sf)
    d = detail(spark, sf).withColumn("veto", F.col("negative_ratio") > 0.10)
    codes = df.select("ts_code").distinct().withColumn("k", F.substring("ts_code", 1, 6))
    d = codes.join(d, "k").select("ts_code", "weighted_sentiment", "negative_ratio", "veto")
    anchors = xs.industry_anchors(df, group_rows=rows(spark, sf))
    out = mk.sector_sentiment(df.select("ts_code", "trade_date", "industry"), anchors, d)
    return rounded(out.select("ts_code", "trade_date", "nlp_score", "sector_negative_ratio", "veto", "industry_sentiment_rank"))


@query("sentiment_factors", v.with_views(f"""
  select ts_code, trade_date, {r('s - first_value(s) ' + fr(-6), 'sentiment_momentum')}, case when abs(s) > 0.7 then 1 else 0 end sentiment_spike,
    {r('(s - avg(s) over (partition by trade_date)) / (stddev_samp(s) over (partition by trade_date) + 1e-9)', 'sentiment_z')} from (select *, net_flow / (amount + 1) s from panel_e)""", "panel_e"))
def sentiment_factors(spark, sf):
    df = v.panel_e(spark, sf).select("ts_code", "trade_date", (F.col("net_flow") / (F.col("amount") + 1)).alias("sentiment"))
    return rounded(mk.sentiment_factors(df).drop("sentiment"))


# ---- strategies ----------------------------------------------------------------------

SP = """sp as (select * replace (amount * 20000 as amount, circ_mv * 4 as circ_mv), net_flow * 1e7 fd_amount, cast(vol - 1 as double) open_times from panel_e)"""


def strategy_panel(spark, sf):
    df = v.panel_e(spark, sf).withColumns({
        "amount": F.col("amount") * 20000, "circ_mv": F.col("circ_mv") * 4, "fd_amount": F.col("net_flow") * 1e7, "open_times": F.col("vol") - 1})
    return fx.strategy_history(df)


def bs(x, lo, hi, slo, shi):
    return (f"(case when {x} between {lo} and {hi} then 100.0::double when {x} < {lo} then case when {x} <= {slo} then 0.0::double else ({x} - {slo}) / ({lo} - {slo}) * 100 end "
            f"else case when {x} >= {shi} then 0.0::double else ({shi} - {x}) / ({shi} - {hi}) * 100 end end)")


def clip100(x):
    return f"greatest(0.0::double, least(100.0::double, {x}))"


ST = SP + ", " + hist_sql("sp") + ", " + emo("hist", "pct_chg") + """,
pp as (select h.*, amount / 100000 ay, fd_amount / 1e8 fy, open_times ot, turnover_rate tv, circ_mv / 10000 mv, round(es, 2) mood from hist h join em using (trade_date)
  where not contains("name", 'ST') and not ts_code like '%.BJ')"""


def strategy_sql(cfg, where, cols, total, trend, bottom, level_extra, heat_cte=None):
    c = st.CONFIGS[cfg]
    joined = f"fl as (select f.*, h.* exclude (trade_date, industry) from {'pp' if heat_cte == 'all' else 'fx'} f join ht h using (trade_date, industry))" if heat_cte else "fl as (select * from fx)"
    fx_src = "pp"
    if heat_cte == "all":
        extra = f"{heat('pp', 'pct_chg', 'ay', 'ht', False)}, {joined}, fz as (select * from fl where {where})"
    elif heat_cte == "mix":
        extra = f"fx as (select * from {fx_src} where {where}), {heat('fx', 'pct_chg', 'ay', 'ht', True)}, {joined}, fz as (select * from fl)"
    else:
        extra = f"fx as (select * from {fx_src} where {where}), fz as (select * from fx)"
    body = f"""select trade_date, pick_rank, ts_code, strategy_score, trend_score, bottom_score, position_pct, position_level from (
      select *, row_number() over (partition by trade_date order by strategy_score desc, ts_code) pick_rank from (
        select trade_date, ts_code, round({total}, 3) + 0.0::double strategy_score, round({trend}, 3) + 0.0::double trend_score, round({bottom}, 3) + 0.0::double bottom_score,
          {level_extra} from (select *, {cols} from fz))) where pick_rank <= {c.top_n}"""
    return v.with_views(body, "panel_e", extra=ST + ", " + extra)


def tiers(c, strong):
    return (f"case when mood >= 72 then least(15.0::double, {c.position} + {strong}) when mood >= 56 then {c.position}::double when mood >= 40 then least(6.0::double, {c.position}::double) else 3.0::double end position_pct, "
            "case when mood >= 72 then 'aggressive' when mood >= 56 then 'normal' when mood >= 40 then 'cautious' else 'light' end position_level")


MV = lambda c: f'"close" between {c.price_min} and {c.price_max} and mv between {c.mv_min} and {c.mv_max}'
BULL = 'case when ma5 > 0 and "close" >= ma5 then {} else 0 end + case when ma10 > 0 and ma5 >= ma10 then {} else 0 end + case when ma20 > 0 and ma10 >= ma20 then {} else 0 end'
c1, c2, c3, c4, c5 = (st.CONFIGS[n] for n in ("first_board", "emotion_leader", "second_board", "strong_pullback", "big_turnover_trend"))
OUT = ("trade_date", "pick_rank", "ts_code", "strategy_score", "trend_score", "bottom_score", "position_pct", "position_level")


def run(spark, sf, name):
    return rounded(st.run(strategy_panel(spark, sf), name, rows(spark, sf)).select(*OUT), 3)


TECH = clip100(BULL.format(25, 20, 15) + ' + case when high20 > 0 and "close" >= high20 * 0.98::double then 25 else 0 end + case when return_20d < 80 then 15 else 0 end')
SEAL = clip100("50 + least(fy, 20) * 2 + greatest(0, 8 - ot) * 3")
ACT = clip100(f"{bs('tv', 3.0, 18.0, 0.5, 35.0)} * 0.65 + least(volume_ratio, 3) / 3 * 35")


@query("strategy_first_board", strategy_sql(
    "first_board", f"is_limit_up and not prev_limit_up and limit_up_10d <= 3 and limit_up_30d <= 5 and not one_word_limit and {MV(c1)}",
    f"{TECH} tech, {SEAL} seal, {ACT} act, fy > 0 or ot > 0 hs, tv > 0 or ay > 0 ha",
    "(case when hs then seal * 0.35 else 0 end + tech * 0.35 + case when ha then act * 0.3 else 0 end) / (case when hs then 0.35 else 0 end + 0.35 + case when ha then 0.3 else 0 end)",
    "tech", "0", "10.0::double position_pct, 'aggressive' position_level"))
def strategy_first_board(spark, sf):
    return run(spark, sf, "first_board")


LEAD = clip100("case when is_limit_up then 100.0::double else least(greatest(pct_chg, 0), 10) / 10 * 45 end + least(limit_up_5d, 3) / 3 * 18 + least(greatest(return_5d, 0), 35) / 35 * 17 + case when \"close\" >= high20 * 0.97::double then 20 else 0 end")
CONS2 = clip100(f"{bs('tv', 4, 22, 1, 45)} * 0.4 + least(ay, 80) / 80 * 24 + least(fy, 20) / 20 * 22 + greatest(0, 14 - least(ot, 7) * 2)")
RR = clip100(BULL.format(18, 15, 12) + f" + {bs('mv', 20.0, 300.0, 8, 540)} * 0.25 + {bs(C, 3.0, 80.0, 1, 120)} * 0.15 + case when return_20d < 120 then 15 else 0 end")


@query("strategy_emotion_leader", strategy_sql(
    "emotion_leader", f"{MV(c2)} and not one_word_limit and pct_chg > 0 and (is_limit_up or limit_up_5d >= 1 or (\"close\" >= high20 * 0.94::double and return_5d >= 3)) and limit_up_10d <= 5 and limit_up_30d <= 10",
    f"{LEAD} lead_, {CONS2} cons, {RR} rr, {clip100('hot')} h", "mood * 0.22 + h * 0.23 + lead_ * 0.23 + cons * 0.17 + rr * 0.15", "lead_", "rr",
    "case when mood >= 72 then 15.0::double when mood >= 56 then 12.0::double when mood >= 40 then 6.0::double else 3.0::double end position_pct, case when mood >= 72 then 'aggressive' when mood >= 56 then 'normal' when mood >= 40 then 'cautious' else 'light' end position_level", "mix"))
def strategy_emotion_leader(spark, sf):
    return run(spark, sf, "emotion_leader")


BOARD = clip100("55 + least(limit_up_5d, 3) / 3 * 30 + greatest(0, 8 - ot) * 2")
MONEY = clip100(f"{bs('tv', 5, 25, 1, 45)} * 0.45 + least(ay, 60) / 60 * 35 + least(fy, 15) / 15 * 20")
RISK3 = clip100(f"{bs('mv', 20, 250, 8, 500)} * 0.45 + {bs(C, 3, 60, 1, 100)} * 0.25 + case when return_20d < 110 then 30 else 0 end")


@query("strategy_second_board", strategy_sql(
    "second_board", f"{MV(c3)} and not one_word_limit and is_limit_up and limit_up_5d between 2 and 4 and limit_up_10d <= 5 and limit_up_30d <= 9",
    f"{BOARD} bo, {MONEY} mo, {RISK3} ri, {clip100('hot')} h", "mood * 0.18 + h * 0.27 + bo * 0.25 + mo * 0.18 + ri * 0.12", "bo", "ri", tiers(c3, "case when h >= 70 and bo >= 80 then 4 else 2 end"), "all"))
def strategy_second_board(spark, sf):
    return run(spark, sf, "second_board")


STR4 = clip100("least(return_20d, 80) / 80 * 45 + least(return_5d + 8, 30) / 30 * 25 + least(limit_up_20d, 4) / 4 * 30")
DIP = clip100('100 - abs("close" / greatest(coalesce(nullif(ma10, 0), ma5, 1), 1) - 1) * 800')
SUP = clip100(f"{bs('tv', 2.5, 14, 0.8, 28)} * 0.55 + least(ay, 40) / 40 * 25 + case when \"close\" >= coalesce(ma20, 0) then 20 else 0 end")


@query("strategy_strong_pullback", strategy_sql(
    "strong_pullback", f"{MV(c4)} and return_20d >= 8 and limit_up_20d >= 1 and limit_up_30d <= 10 and ((\"close\" <= ma5 * 1.035::double and \"close\" >= ma20 * 0.97::double) or (pct_chg between -4.5 and 2.5 and return_20d > 8)) and ma5 >= ma20 * 0.98::double",
    f"{STR4} sg, {DIP} dp, {SUP} su, {clip100('hot')} h", "mood * 0.12 + h * 0.2 + sg * 0.25 + dp * 0.25 + su * 0.18", "sg", "dp", tiers(c4, "2"), "all"))
def strategy_strong_pullback(spark, sf):
    return run(spark, sf, "strong_pullback")


ROOM = clip100(f"least(ay, 150) / 150 * 55 + {bs('mv', 80, 2000, 40, 3000)} * 0.45")
TRND = clip100("least(greatest(return_20d, 0), 80) / 80 * 35 + least(greatest(pct_chg, 0), 10) / 10 * 15 + case when \"close\" >= coalesce(high20, 0) * 0.96::double then 30 else 0 end + case when ma5 >= ma10 and ma10 >= ma20 then 20 else 0 end")
CONS5 = clip100(f"{bs('tv', 2, 18, 0.5, 35)} * 0.45 + least(ay, 120) / 120 * 35 + least(fy, 20) / 20 * 20")


@query("strategy_big_turnover", strategy_sql(
    "big_turnover_trend", f"{MV(c5)} and ay >= 8 and \"close\" >= ma20 and ma5 >= ma20 * 0.98::double and (return_20d >= 10 or \"close\" >= high20 * 0.95::double) and pct_chg > -3",
    f"{ROOM} ro, {TRND} tr, {CONS5} cs, {clip100('hot')} h", "mood * 0.12 + h * 0.22 + ro * 0.24 + tr * 0.27 + cs * 0.15", "tr", "ro", tiers(c5, "case when ro >= 70 and tr >= 70 then 4 else 2 end"), "all"))
def strategy_big_turnover(spark, sf):
    return run(spark, sf, "big_turnover_trend")


@query("strategy_grid")
def strategy_grid(spark, sf):
    """Three settings of two strategies in one job."""
    grid = [("first_board", {"price_max": 60}), ("first_board", {"price_max": 25, "top_n": 5}), ("second_board", {})]
    out = st.run_grid(strategy_panel(spark, sf), grid, rows(spark, sf))
    return rounded(out.groupBy("setting", "strategy_id").agg(F.count(F.lit(1)).alias("picks"), F.max("strategy_score").alias("best")), 3)
