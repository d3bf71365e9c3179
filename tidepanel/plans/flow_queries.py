"""Queries over the flow operators (monthly flows of the supplier nations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow as fl
from ..session import cut_lineage
from . import views as v
from .registry import query, r, rounded

YI = "round({} / 1e8, 3)"


def flows(spark, sf):
    """The small monthly flow table, stored once: one pass over the line items per query."""
    return cut_lineage(v.sector_flow(spark, sf))


@query("flow_summary", v.with_views(f"""
  select "date", count(*) sector_count, {r("sum(case when x > 0 then x else 0 end)", 'total_inflow', 2)}, {r("abs(sum(case when x < 0 then x else 0 end))", 'total_outflow', 2)},
    {r('sum(x)', 'net_flow', 2)}, count(*) filter (x > 0) positive_count, count(*) filter (x < 0) negative_count
  from (select *, main_force_net x from sector_flow) group by 1""", "sector_flow"))
def flow_summary(spark, sf):
    df = fl.summary(flows(spark, sf)).drop("total_inflow_yi", "total_outflow_yi", "net_flow_yi")
    return rounded(df, 2)


@query("flow_most_active", v.with_views("""
  select sector_name, count(*) n from sector_flow where sector_name in (select sector_name from sector_flow group by 1
    order by avg(abs(main_force_net)) desc, sector_name limit 10) group by 1""", "sector_flow"))
def flow_most_active(spark, sf):
    return fl.most_active(flows(spark, sf), 10).groupBy("sector_name").agg(F.count(F.lit(1)).alias("n"))


LAGGED = """dd as (select "date", row_number() over (order by "date") - 1 t from (select distinct "date" from sector_flow)),
sf as (select sector_name s, t, main_force_net x from sector_flow join dd using ("date")),
cells as (select a.s, dd.t, sf.x from (select distinct sector_name s from sector_flow) a cross join dd left join sf on sf.s = a.s and sf.t = dd.t),
sc as (select s, avg(abs(x)) u from sf group by 1)"""

NET = LAGGED + """, pr as (select a.s source, b.s target, count(*) n, corr(a.x, b.x) c, stddev_samp(a.x) sa, stddev_samp(b.x) sb
   from sf a join sf b on b.t = a.t + 1 and a.s <> b.s group by 1, 2),
pos as (select c.s source, c2.s target, count(*) filter (c.x > 0) sp, count(*) filter (c.x > 0 and c2.x > 0) bp
   from cells c join cells c2 on c2.t = c.t + 1 and c.s <> c2.s group by 1, 2),
bs as (select s target, round(count(*) filter (x > 0) / (select count(*) from dd), 3) b from sf group by 1)"""


@query("flow_network_edges", v.with_views("""
  select source, target, abs(round(c, 4)) weight, round(c, 4) correlation, 1 lead_days, case when sp >= 3 then round(bp / sp, 3) end hit_rate,
    case when sp >= 3 then b end hit_base, sp samples from pr join pos using (source, target) join bs using (target)
  where n >= 3 and sa > 0 and sb > 0 and abs(c) >= 0.2 order by (case when sp >= 3 then 1 else 0 end) desc, weight desc, source, target limit 30""",
    "sector_flow", extra=NET))
def flow_network_edges(spark, sf):
    return fl.network_edges(flows(spark, sf), 0.2)


GRANGER = LAGGED + """, tr as (select a.s source, b.s target, a.x / ua.u x, b.x / ub.u y, coalesce(z.x, 0) / ub.u z from sf a join sf b on b.t = a.t + 1 and a.s <> b.s
    left join sf z on z.s = b.s and z.t = a.t join sc ua on ua.s = a.s join sc ub on ub.s = b.s),
mo as (select source, target, count(*) n, corr(x, y) c, covar_pop(x, x) * count(*) cxx, covar_pop(y, y) * count(*) cyy, covar_pop(z, z) * count(*) czz,
    covar_pop(x, y) * count(*) cxy, covar_pop(x, z) * count(*) cxz, covar_pop(y, z) * count(*) cyz from tr group by 1, 2),
rs as (select *, cyy - cyz * cyz / czz r0, cyy - (cyz * cyz * cxx - 2 * cyz * cxy * cxz + cxy * cxy * czz) / (czz * cxx - cxz * cxz) r1 from mo)"""


@query("flow_granger_edges", v.with_views("""
  select source, target, f f_score, l lag_correlation, 1 lag_days from (select *, round(greatest(0, (r0 - r1) / (r1 / greatest(n - 3, 1))), 4) f, round(c, 4) l from rs where n >= 5)
  where f >= 1.0 or abs(l) >= 0.4 order by f desc, abs(l) desc, source, target limit 20""", "sector_flow", extra=GRANGER))
def flow_granger_edges(spark, sf):
    return fl.granger_edges(flows(spark, sf))


STREAKS = """i1 as (select *, case when (main_force_net > 0) = lag(main_force_net > 0) over (partition by sector_name order by "date") then 0 else 1 end brk from sector_flow),
i2 as (select *, sum(brk) over (partition by sector_name order by "date") blk, lead(main_force_net > 0) over (partition by sector_name order by "date") nx from i1),
i3 as (select *, case when main_force_net > 0 then row_number() over (partition by sector_name, blk order by "date") else 0 end run from i2)"""
STREAK_AGG = """select sector_name, arg_max(run, "date") streak, count(*) filter (run >= 2 and nx is not null) continue_n, max(run) longest_run,
    case when count(*) filter (run >= 2 and nx is not null) >= 5 then round(count(*) filter (run >= 2 and nx) / count(*) filter (run >= 2 and nx is not null), 3) end continue_prob
  from i3 group by 1"""


@query("flow_streak_statistics", v.with_views(STREAK_AGG, "sector_flow", extra=STREAKS))
def flow_streak_statistics(spark, sf):
    return fl.streak_statistics(flows(spark, sf))


ROTATION = STREAKS + ", st as (" + STREAK_AGG + "), " + LAGGED + """, nd as (select count(*) n from dd),
fl as (select s, t, greatest(-coalesce(x, 0), 0.0::double) o, greatest(coalesce(x, 0), 0.0::double) i from cells),
ps as (select s, sum(o) filter (t >= n - 5) / 5 pressure, count(*) filter (t >= n - 5 and o > 0) / 5 oshare, sum(i) filter (t >= n - 5) / 5 momentum,
   count(*) filter (t >= n - 5 and i > 0) / 5 ishare, avg(o) obase, avg(i) ibase from fl cross join nd group by 1),
tr as (select a.s source, b.s target, g lag, a.o / ua.u x, b.i / ub.u y, z.i / ub.u z from range(1, 4) g(g) join fl a on true join fl b on b.t = a.t + g and a.s <> b.s
   join fl z on z.s = b.s and z.t = b.t - 1 join sc ua on ua.s = a.s join sc ub on ub.s = b.s),
mo as (select source, target, lag, count(*) n, corr(x, y) c, covar_pop(x, x) * count(*) cxx, covar_pop(y, y) * count(*) cyy, covar_pop(z, z) * count(*) czz,
    covar_pop(x, y) * count(*) cxy, covar_pop(x, z) * count(*) cxz, covar_pop(y, z) * count(*) cyz from tr group by 1, 2, 3),
rs as (select *, cyy - cyz * cyz / czz r0, cyy - (cyz * cyz * cxx - 2 * cyz * cxy * cxz + cxy * cxy * czz) / (czz * cxx - cxz * cxz) r1 from mo where n >= 5 and c >= 0.05),
cf as (select source, target, lag, c, greatest(0, (r0 - r1) / (r1 / greatest(n - 3, 1))) f, a.pressure, a.oshare, a.obase, b.momentum, b.ishare, b.ibase, streak, continue_prob
   from rs join ps a on a.s = source join ps b on b.s = target join st on st.sector_name = target where a.pressure > 0 and b.momentum > 0 and b.ishare >= 0.6),
cg as (select *, greatest(0.0::double, least(1.0::double, 0.45 * c + 0.2 * (oshare + ishare) / 2 + 0.2 * least(1.0::double, f / 5) + 0.15 * least(1.0::double,
     (pressure / greatest(coalesce(nullif(obase, 0), pressure), 1) + momentum / greatest(coalesce(nullif(ibase, 0), momentum), 1)) / 4))) conf,
   greatest(0.0::double, least(1.0::double, 0.45 * ishare + 0.3 * least(1.0::double, streak / 4) + 0.25 * coalesce(continue_prob, 0.5))) pers from cf where (oshare + ishare) / 2 >= 0.4),
ch as (select *, row_number() over (partition by source, target order by round(conf, 4) desc, lag) b from cg)"""


@query("flow_rotation_edges", v.with_views(f"""
  select source, target, round(conf, 4) confidence, cast(lag as integer) lag_days, round(c, 4) lag_correlation, round(f, 4) f_score, streak target_streak,
    continue_prob target_continue_prob, round(pers, 4) persistence, round(0.6 * conf + 0.4 * pers, 4) final_score
  from ch where b = 1 and round(conf, 4) >= 0.05 order by final_score desc, confidence desc, least(pressure, momentum) * conf desc, source, target limit 20""",
    "sector_flow", extra=ROTATION))
def flow_rotation_edges(spark, sf):
    df = fl.rotation_edges(flows(spark, sf), threshold=0.05)
    return df.drop("amount_yi", "source_pressure_yi", "target_momentum_yi", "amount")


RANKED = NET + """, ed as (select source, target, abs(round(c, 4)) w from pr join pos using (source, target) where n >= 3 and sa > 0 and sb > 0 and abs(c) >= 0.1
   order by (case when sp >= 3 then 1 else 0 end) desc, w desc, source, target limit 30),
nn as (select node, row_number() over (order by node) i, count(*) over () m from (select distinct unnest([source, target]) node from ed)),
mt as (select t.i ti, s.i si, case when ow is null then 1.0::double / t.m else coalesce(w, 0) / ow end x from nn t cross join nn s left join ed on ed.source = s.node and ed.target = t.node
   left join (select source, sum(w) ow from ed group by 1) o on o.source = s.node),
mx as (select list(rw order by ti) mat from (select ti, list(x order by si) rw from mt group by 1)),
ini as (select list(1.0::double / m) v, max(m) m from nn),
it as (select list_reduce(list_transform(range(41), lambda q: v), lambda acc, q: list_transform(mat, lambda rw: 0.15::double / m + 0.85::double * list_dot_product(rw, acc))) res from mx, ini)"""


@query("flow_page_rank", v.with_views("select node sector_name, round(res[i], 6) pagerank from nn, it", "sector_flow", extra=RANKED))
def flow_page_rank(spark, sf):
    """Iterative; also compared with a dense power iteration in the tests."""
    return fl.page_rank(fl.network_edges(flows(spark, sf), 0.1))


SIDES = """o as (select *, row_number() over (partition by "date" order by main_force_net, sector_name) p from sector_flow where main_force_net < 0),
i as (select *, row_number() over (partition by "date" order by main_force_net desc, sector_name) p from sector_flow where main_force_net > 0),
ot as (select "date", sum(abs(main_force_net)) t from o where p <= 5 group by 1), it as (select "date", sum(main_force_net) t from i where p <= 5 group by 1)"""


@query("flow_proportional_edges", v.with_views(f"""
  select "date", source, target, {r('amount', 'amount', 2)}, pos from (select *, row_number() over (partition by "date" order by round(amount, 6) desc, source, target) pos from (
    select o."date", o.sector_name source, i.sector_name target, abs(o.main_force_net) / ot.t * i.main_force_net / it.t * least(ot.t, it.t) amount
    from o join i on o."date" = i."date" join ot on ot."date" = o."date" join it on it."date" = o."date" where o.p <= 5 and i.p <= 5)) where pos <= 10""",
    "sector_flow", extra=SIDES))
def flow_proportional_edges(spark, sf):
    return rounded(fl.proportional_edges(flows(spark, sf)).drop("amount_yi"), 2)


@query("flow_anomalies", v.with_views("""
  select sector_name, main_force_net, change_pct, round(z, 3) z_score, case when z > 0 then 'surge' else 'flight' end anomaly_type from (
    select s.*, (main_force_net - m) / nullif(sd, 0) z from sector_flow s join (select sector_name, avg(main_force_net) m, stddev_samp(main_force_net) sd from sector_flow group by 1)
    using (sector_name) where "date" = (select max("date") from sector_flow)) where abs(z) >= 0.02 order by abs(z_score) desc, sector_name limit 10""", "sector_flow"))
def flow_anomalies(spark, sf):
    return fl.anomalies(flows(spark, sf), 0.02)


MULTI = """m0 as (select *, max(t) over () tm from sector_flow join (select "date", row_number() over (order by "date") - 1 t from (select distinct "date" from sector_flow)) using ("date")),
m1 as (select *, sign(main_force_net) sg, case when sign(main_force_net) = lag(sign(main_force_net)) over (partition by sector_name order by "date") then 0 else 1 end brk from m0),
m2 as (select *, sum(brk) over (partition by sector_name order by "date") blk from m1),
m3 as (select *, row_number() over (partition by sector_name, blk order by "date") * sg ss from m2),
md as (select sector_name, max(main_force_net) filter (t = tm) main_force_net, max(change_pct) filter (t = tm) change_pct, max(turnover) filter (t = tm) turnover,
   sum(main_force_net) filter (t > tm - 5) net_5d, sum(main_force_net) filter (t > tm - 10) net_10d, sum(turnover) filter (t > tm - 5) turnover_5d,
   sum(change_pct) filter (t > tm - 5) chg_5d, cast(arg_max(ss, "date") as bigint) streak from m3 group by 1 having max(main_force_net) filter (t = tm) is not null),
me as (select *, round(main_force_net / nullif(turnover, 0) * 100, 2) intensity, round(net_5d / nullif(turnover_5d, 0) * 100, 2) intensity_5d from md)"""


@query("flow_multi_day_frame", v.with_views(
    f"""select sector_name, {r('net_5d', 'net_5d', 2)}, {r('net_10d', 'net_10d', 2)}, {r('chg_5d', 'chg_5d')}, intensity, intensity_5d, streak from me""",
    "sector_flow", extra=MULTI))
def flow_multi_day_frame(spark, sf):
    df = fl.multi_day_frame(flows(spark, sf))
    return df.select("sector_name", *[(F.round(c, p) + F.lit(0.0)).alias(c) for c, p in (("net_5d", 2), ("net_10d", 2), ("chg_5d", 6))],
                     "intensity", "intensity_5d", "streak")


def rk(c):
    return f"((rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0) / count({c}) over ())"


ATT = MULTI + f""", at0 as (select *, main_force_net - net_5d / 5 acc from me),
au as (select *, {rk('net_10d')} r10, (0.38::double * (0.5::double * {rk('intensity')} + 0.5::double * {rk('main_force_net')}) + 0.34::double * {rk('net_5d')} + 0.18::double * {rk('net_10d')} + 0.1::double * {rk('acc')}) * 100 att from at0),
av as (select *, row_number() over (order by round(att, 9) desc, sector_name) pos, count(*) over () n, case when main_force_net > 0 and net_5d > 0 and acc > 0 and chg_5d < 3 then 'accelerating accumulation'
  when main_force_net > 0 and net_5d > 0 and acc > 0 then 'accelerating inflow' when main_force_net > 0 and net_5d > 0 and chg_5d < 2 then 'accumulation'
  when main_force_net > 0 and net_5d > 0 then 'steady inflow' when main_force_net > 0 and net_5d <= 0 then 'turning warm'
  when main_force_net <= 0 and net_5d > 0 and (r10 >= 0.6 or chg_5d >= 5) then 'distribution at high' when main_force_net < 0 and net_5d <= 0 then 'steady outflow' else 'tug of war' end label from au),
aw as (select * from av where pos <= 14 or (n > 14 and pos > n - 3))"""


@query("flow_attention", v.with_views(
    "select pos, sector_name, cast(round(att) as bigint) attention, label, intensity intensity_pct, streak from aw", "sector_flow", extra=ATT))
def flow_attention(spark, sf):
    df = fl.attention(fl.multi_day_frame(flows(spark, sf)))
    return df.select("pos", "sector_name", "attention", "label", "intensity_pct", "streak")


@query("flow_market_read", v.with_views("""
  select (select arg_min(sector_name, pos) from aw) focus, (select cast(round(arg_min(att, pos)) as bigint) from aw) focus_attention,
    coalesce((select arg_max(sector_name, pos) from aw where round(net_5d / 1e8, 3) < 0), (select arg_max(sector_name, pos) from aw)) risk,
    (select case when b >= 0.55 then 'broad inflow' when b >= 0.45 then 'narrow focus' else 'defensive' end from (
      select count(*) filter (main_force_net > 0) / count(*) b from sector_flow where "date" = (select max("date") from sector_flow))) breadth_hint""",
    "sector_flow", extra=ATT))
def flow_market_read(spark, sf):
    f = flows(spark, sf)
    return fl.market_read(fl.attention(fl.multi_day_frame(f)), fl.summary(f))


FORE = ROTATION + ", " + MULTI + f""", ed as (select target sector_name, arg_max(source, (round(conf, 4), source)) src, max(round(conf, 4)) conf from (
    select *, least(pressure, momentum) * conf am from ch where b = 1 and round(conf, 4) >= 0.05 order by round(0.6 * conf + 0.4 * pers, 4) desc, round(conf, 4) desc, am desc, source, target limit 20) group by 1),
f0 as (select me.*, src, coalesce(conf, 0) conf, main_force_net > 0 and net_5d > 0 and chg_5d < 2 g, {rk('net_5d')} rr from me left join ed using (sector_name)),
f1 as (select *, 0.35::double * (rr - 0.5) * 2 + 0.25::double * greatest(least(streak, 5), -5) / 5 + 0.2::double * case when g then 1 else 0 end + 0.2::double * least(conf * 2, 1.0) raw from f0),
f2 as (select *, case when raw > 0 then 'inflow' else 'outflow' end direction, round(raw * 100, 1) score from f1),
f3 as (select *, row_number() over (partition by direction order by case when direction = 'inflow' then -score else score end, sector_name) pos from f2)"""


@query("flow_forecast", v.with_views(
    "select direction, pos, sector_name, score from f3 where (direction = 'inflow' and pos <= 8) or (direction = 'outflow' and pos <= 4)",
    "sector_flow", extra=FORE))
def flow_forecast(spark, sf):
    f = flows(spark, sf)
    df = fl.forecast(fl.multi_day_frame(f), fl.rotation_edges(f, threshold=0.05))
    return df.select("direction", "pos", "sector_name", "score")


@query("industry_flow", """
  with m as (select l_suppkey k, cast(l_shipdate as date) d, sum(case l_returnflag when 'A' then round(l_extendedprice * 100) when 'R' then -round(l_extendedprice * 100) else 0 end) / 100 * 10000 net,
      sum(round(l_extendedprice * 100)) / 100 amt, sum(round(l_discount * 100)) p, count(*) c from lineitem group by 1, 2)
  select d "date", n_name sector_name, round(sum(net), 2) + 0.0::double main_force_net, round(avg(p / c), 4) change_pct, round(sum(amt) * 1000, 2) turnover
  from m join supplier on k = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2""")
def industry_flow(spark, sf):
    li = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("ts_code"), F.to_date("l_shipdate").alias("trade_date"), "l_returnflag",
        v.cents("l_extendedprice").alias("cents"), v.cents("l_discount").alias("disc"))
    day = li.groupBy("ts_code", "trade_date").agg(
        (F.sum(F.when(F.col("l_returnflag") == "A", F.col("cents")).otherwise(0)) / 100.0).alias("buy_lg_amount"),
        (F.sum(F.when(F.col("l_returnflag") == "R", F.col("cents")).otherwise(0)) / 100.0).alias("sell_lg_amount"),
        F.lit(0.0).alias("buy_elg_amount"), F.lit(0.0).alias("sell_elg_amount"),
        (F.sum("cents") / 100.0).alias("amount"), (F.sum("disc") / F.count(F.lit(1))).alias("pct_chg"))
    sup = v.table(spark, sf, "supplier").join(v.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    basic = sup.select(F.col("s_suppkey").alias("ts_code"), F.col("n_name").alias("industry"))
    out = fl.industry_flow(day, basic, day)
    return out.select("date", "sector_name", (F.round("main_force_net", 2) + F.lit(0.0)).alias("main_force_net"),
                      "change_pct", F.round("turnover", 2).alias("turnover"))


@query("normalize_flow_text", """
  select strftime(cast(o_orderdate as date), '%Y%m%d') "date", o_orderpriority sector_name,
    arg_max(cast(round(o_totalprice * 100) as bigint) * 100.0 * case when o_orderstatus = 'F' then -1 else 1 end, o_orderkey) + 0.0::double main_force_net,
    arg_max((o_orderkey % 700) / 100.0, o_orderkey) change_pct
  from orders group by 1, 2""")
def normalize_flow_text(spark, sf):
    """Amounts as text with unit words and percents as text, newest order per key wins."""
    o = v.table(spark, sf, "orders")
    sign = F.when(F.col("o_orderstatus") == "F", "-").otherwise("")
    raw = o.select(
        F.to_date("o_orderdate").alias("trade_date"), F.col("o_orderpriority").alias("名称"),
        F.concat(sign, (v.cents("o_totalprice") / 100).cast("decimal(18,2)").cast("string"), F.lit("万元")).alias("主力净流入"),
        F.concat((F.col("o_orderkey") % 700 / 100).cast("decimal(6,2)").cast("string"), F.lit("%")).alias("涨跌幅"), "o_orderkey")
    out = fl.normalize_flow(raw, version="o_orderkey")
    return out.withColumn("main_force_net", F.round("main_force_net", 0) + F.lit(0.0))
