"""Input views over the driver tables, in Spark and as SQL text for the oracle.

The SQL below and the Spark builders state the same derivations. Money is summed in whole
cents and prices are whole ticks, as market data is, so the order of a distributed sum
cannot change an input.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from ..session import dealt


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(c: str):
    """Money in whole cents: integer sums do not depend on the order of addition."""
    return F.round(F.col(c) * 100).cast("long")


def signed_by_flag(c: str):
    flag = F.col("l_returnflag")
    return F.when(flag == "A", F.col(c)).when(flag == "R", -F.col(c)).otherwise(F.lit(0).cast("long"))


def _code(c):
    suffix = F.when(c % 3 == 0, ".SH").when(c % 3 == 1, ".SZ").otherwise(".BJ")
    return F.concat(F.lpad(c.cast("string"), 6, "0"), suffix)


def panel_e(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per user from the event stream (short histories, wide sections)."""
    e = table(spark, sf, "events").select("user_id", "ts", "value", "event_type")
    value = F.col("value")
    bars = e.groupBy("user_id", F.to_date("ts").alias("trade_date")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("vol"),
        F.round(F.sum("value"), 2).alias("amount"),
        F.count_if(F.col("event_type") == "purchase").alias("n_buy"),
        F.count_if(F.col("event_type") == "error").alias("n_err"),
        F.round(F.sum(F.when(F.col("event_type").isin("purchase", "signup"), value)
                      .when(F.col("event_type") == "error", -value).otherwise(0.0)), 2).alias("net_flow"),
    )
    u = F.col("user_id")
    return bars.select(
        _code(u).alias("ts_code"), "trade_date",
        F.concat(F.when(u % 17 == 0, "ST").otherwise("N"), u.cast("string")).alias("name"),
        F.concat(F.lit("IND"), (u % 7).cast("string")).alias("industry"),
        "open", "high", "low", "close", "vol", "amount", "net_flow",
        F.round(F.col("vol") * 1.5, 2).alias("turnover_rate"),
        F.round((u % 97 + 3) * 10000.0 + F.col("close") * 10, 2).alias("total_mv"),
        F.round((u % 89 + 2) * 8000.0 + F.col("open") * 10, 2).alias("circ_mv"),
        F.round(F.col("close") - 20.0, 2).alias("pe"),
        F.round(F.col("high") / 25.0 + 0.25, 4).alias("pb"),
        F.round((u % 41) - 8.0 + F.col("n_buy"), 2).alias("roe"),
        F.round((u % 53) * 2.0 - 30.0, 2).alias("revenue_yoy"),
        F.round((u % 59) * 2.0 - 40.0 + F.col("n_err"), 2).alias("profit_yoy"),
        F.round((u % 73) * 1.0, 2).alias("pledge_ratio"),
        F.round(F.col("n_err") / F.col("vol"), 4).alias("negative_ratio"),
    )


PANEL_E = """
panel_e0 as (
  select user_id u, cast(ts as date) trade_date, arg_min(value, ts) "open", max(value) high, min(value) low,
    arg_max(value, ts) "close", cast(count(*) as double) vol, round(sum(value), 2) amount,
    count(*) filter (event_type = 'purchase') n_buy, count(*) filter (event_type = 'error') n_err,
    round(sum(case when event_type in ('purchase','signup') then value when event_type = 'error' then -value
      else 0.0 end), 2) net_flow
  from events group by 1, 2),
panel_e as (
  select lpad(cast(u as varchar), 6, '0') || case u % 3 when 0 then '.SH' when 1 then '.SZ' else '.BJ' end ts_code,
    trade_date, case when u % 17 = 0 then 'ST' else 'N' end || cast(u as varchar) "name",
    'IND' || cast(u % 7 as varchar) industry, "open", high, low, "close", vol, amount, net_flow,
    round(vol * 1.5, 2) turnover_rate,
    round((u % 97 + 3) * 10000.0::double + "close" * 10, 2) total_mv,
    round((u % 89 + 2) * 8000.0::double + "open" * 10, 2) circ_mv,
    round("close" - 20.0::double, 2) pe, round(high / 25.0::double + 0.25::double, 4) pb,
    round((u % 41) - 8.0::double + n_buy, 2) roe, round((u % 53) * 2.0::double - 30.0::double, 2) revenue_yoy,
    round((u % 59) * 2.0::double - 40.0::double + n_err, 2) profit_yoy,
    round((u % 73) * 1.0::double, 2) pledge_ratio, round(n_err / vol, 4) negative_ratio
  from panel_e0)"""


def panel_l(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per supplier from shipments (long histories)."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("trade_date"), "l_quantity", "l_extendedprice", "l_returnflag")
    li = li.withColumns({"cents": cents("l_extendedprice"), "qty": F.col("l_quantity").cast("long")})
    unit = F.expr("cents div qty")
    # Most cells hold one row, so combining them before the exchange would only fill memory.
    li = dealt(li, "l_suppkey", "trade_date")
    bars = li.groupBy("l_suppkey", "trade_date").agg(
        (F.expr("sum(cents) div sum(qty)") / 100.0).alias("close"),
        (F.max(unit) / 100.0).alias("high"), (F.min(unit) / 100.0).alias("low"),
        F.sum("qty").cast("double").alias("vol"), (F.sum("cents") / 100.0).alias("amount"),
        (F.sum(signed_by_flag("cents")) / 100.0).alias("net_flow"),
    )
    sup = table(spark, sf, "supplier").join(
        F.broadcast(table(spark, sf, "nation").select("n_nationkey", "n_name")),
        F.col("s_nationkey") == F.col("n_nationkey"))
    sup = sup.select("s_suppkey", F.col("n_name").alias("industry"), F.col("s_acctbal").alias("total_mv"))
    return bars.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("ts_code"), "trade_date", "industry",
        F.col("close").alias("open"), "high", "low", "close", "vol", "amount", "net_flow", "total_mv")


PANEL_L = """
panel_l0 as (
  select l_suppkey k, cast(l_shipdate as date) trade_date,
    cast(sum(c) // sum(q) as double) / 100 "close", cast(max(c // q) as double) / 100 high,
    cast(min(c // q) as double) / 100 low, cast(sum(q) as double) vol, cast(sum(c) as double) / 100 amount,
    cast(sum(case l_returnflag when 'A' then c when 'R' then -c else 0 end) as double) / 100 net_flow
  from (select *, cast(round(l_extendedprice * 100) as bigint) c, cast(l_quantity as bigint) q from lineitem) group by 1, 2),
panel_l as (
  select lpad(cast(k as varchar), 6, '0') ts_code, trade_date, n_name industry, "close" "open", high, low, "close",
    vol, amount, net_flow, s_acctbal total_mv
  from panel_l0 join supplier on k = s_suppkey join nation on s_nationkey = n_nationkey)"""


def sector_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly signed flow, turnover and mean change per nation of the supplier."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_returnflag", cents("l_extendedprice").alias("cents"), cents("l_discount").alias("disc"))
    by_supplier = li.groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("date").alias("date")).agg(
        F.sum(signed_by_flag("cents")).alias("net"), F.sum("cents").alias("turn"),
        F.sum(F.col("disc") - 5).alias("chg"), F.count(F.lit(1)).alias("n"))
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        by_supplier.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(nat), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("date", F.col("n_name").alias("sector_name"))
        .agg((F.sum("net") / 100.0).alias("main_force_net"),
             (F.sum("chg") / F.sum("n")).alias("change_pct"),
             (F.sum("turn") / 100.0).alias("turnover"))
    )


SECTOR_FLOW = """
sector_flow as (
  select cast(date_trunc('month', l_shipdate) as date) "date", n_name sector_name,
    cast(sum(case l_returnflag when 'A' then c when 'R' then -c else 0 end) as double) / 100 main_force_net,
    cast(sum(d - 5) as double) / count(*) change_pct, cast(sum(c) as double) / 100 turnover
  from (select *, cast(round(l_extendedprice * 100) as bigint) c, cast(round(l_discount * 100) as bigint) d from lineitem)
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2)"""


def series_r(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly mean order value per region: a handful of long close series."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", cents("o_totalprice").alias("cents"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf, "region")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("series_name"), F.date_trunc("month", "o_orderdate").cast("date").alias("obs_date"))
        .agg((F.expr("sum(cents) div count(1)") / 100.0).alias("value"), (F.sum("cents") / 100.0).alias("amount"),
             F.count(F.lit(1)).alias("n_obs"))
    )


SERIES_R = """
series_r as (
  select r_name series_name, cast(date_trunc('month', o_orderdate) as date) obs_date,
    cast(sum(c) // count(*) as double) / 100 "value", cast(sum(c) as double) / 100 amount, count(*) n_obs
  from (select *, cast(round(o_totalprice * 100) as bigint) c from orders) join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey group by 1, 2)"""


def series_d(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean order value as one index series (long enough for 250-row windows)."""
    o = table(spark, sf, "orders").select("o_orderdate", cents("o_totalprice").alias("cents"))
    return o.groupBy(F.lit("ALL").alias("series_name"), F.to_date("o_orderdate").alias("obs_date")).agg(
        (F.expr("sum(cents) div count(1)") / 100.0).alias("value"), (F.sum("cents") / 100.0).alias("amount"))


SERIES_D = """
series_d as (
  select 'ALL' series_name, cast(o_orderdate as date) obs_date, cast(sum(c) // count(*) as double) / 100 "value",
    cast(sum(c) as double) / 100 amount from (select *, cast(round(o_totalprice * 100) as bigint) c from orders) group by 2)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents seen as research reports."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    k = F.col("doc_id")
    bull = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return d.join(lab, "doc_id", "left").select(
        k.alias("report_id"), F.col("source").alias("institution"), "lang", "text", "n_chars",
        F.lpad((k % 50).cast("string"), 6, "0").alias("stock_code"),
        F.concat(F.lit("NAME"), (k % 50).cast("string")).alias("stock_name"),
        F.array(F.lpad((k % 37).cast("string"), 6, "0"), F.lit("bad"), F.lpad((k % 50).cast("string"), 6, "0")).alias("target_stocks"),
        F.array(F.concat(F.lit("tag"), (k % 11).cast("string")), F.concat(F.lit("tag"), (k % 7).cast("string"))).alias("tags"),
        F.when(bull, "bullish").when(F.col("toxic") == 1, "bearish").otherwise("neutral").alias("sentiment"),
        F.when(k % 4 == 0, "buy upgrade").when(k % 4 == 1, "buy").when(k % 4 == 2, "first hold").otherwise("hold").alias("rating"),
        F.when(k % 3 == 0, (F.col("n_chars") % 90 + 10).cast("double")).alias("target_price"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("report_date"),
        F.when(k % 10 == 9, "pending").otherwise("summarized").alias("status"),
    )


REPORTS = """
reports as (
  select d.doc_id report_id, source institution, lang, "text", n_chars,
    lpad(cast(d.doc_id % 50 as varchar), 6, '0') stock_code, 'NAME' || cast(d.doc_id % 50 as varchar) stock_name,
    [lpad(cast(d.doc_id % 37 as varchar), 6, '0'), 'bad', lpad(cast(d.doc_id % 50 as varchar), 6, '0')] target_stocks,
    ['tag' || cast(d.doc_id % 11 as varchar), 'tag' || cast(d.doc_id % 7 as varchar)] tags,
    case when quality = 1 and toxic = 0 then 'bullish' when toxic = 1 then 'bearish' else 'neutral' end sentiment,
    case d.doc_id % 4 when 0 then 'buy upgrade' when 1 then 'buy' when 2 then 'first hold' else 'hold' end rating,
    case when d.doc_id % 3 = 0 then cast(n_chars % 90 + 10 as double) end target_price,
    date '2024-01-01' + cast(d.doc_id % 30 as integer) report_date,
    case when d.doc_id % 10 = 9 then 'pending' else 'summarized' end status
  from documents d left join labels l on d.doc_id = l.doc_id)"""


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Orders seen as a trade ledger of one account per region of keys."""
    k = F.col("o_orderkey")
    side = F.when(F.col("o_orderstatus") == "O", "BUY").when(F.col("o_orderstatus") == "F", "REDUCE").otherwise("CLOSE")
    return table(spark, sf, "orders").select(
        F.lit("main").alias("account"), F.lpad((F.col("o_custkey") % 200).cast("string"), 6, "0").alias("code"),
        k.alias("seq"), side.alias("side"), F.to_date("o_orderdate").alias("trade_date"),
        F.round(F.col("o_totalprice") / 1000, 2).alias("price"), ((k % 5 + 1) * 100).alias("shares"))


TRADES = """
trades as (
  select 'main' account, lpad(cast(o_custkey % 200 as varchar), 6, '0') code, o_orderkey seq,
    case o_orderstatus when 'O' then 'BUY' when 'F' then 'REDUCE' else 'CLOSE' end side,
    cast(o_orderdate as date) trade_date, round(o_totalprice / 1000, 2) price, (o_orderkey % 5 + 1) * 100 shares
  from orders)"""

SQL = {"panel_e": PANEL_E, "panel_l": PANEL_L, "sector_flow": SECTOR_FLOW, "series_r": SERIES_R,
       "series_d": SERIES_D, "reports": REPORTS, "trades": TRADES}


def with_views(body: str, *names: str, extra: str = "") -> str:
    """Oracle text: a WITH clause of the named views, optional extra CTEs, then the body."""
    parts = [SQL[n].strip() for n in names] + ([extra.strip()] if extra.strip() else [])
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


@lru_cache(maxsize=64)
def _measured(app: str, sf: str, view: str) -> int:
    spark = SparkSession.active()
    if view == "panel_e":
        keys = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("trade_date"))
    else:
        keys = table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("trade_date"))
    return ranks.widest_group(keys, ["trade_date"])


def section_rows(spark: SparkSession, sf: str, view: str) -> int:
    """Upper bound of the rows of one date of a panel view, measured once per session.

    Counting the raw rows needs no distinct and can only overstate the section.
    """
    return _measured(spark.sparkContext.applicationId, sf, view)
