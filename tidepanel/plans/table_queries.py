"""Queries over sources, ingest rules, joins, set operations, top-k and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import joins as jn
from ..operators import macro as ma
from ..operators import ranks
from ..operators import windows as wn
from ..session import checkpoint_dir
from ..sources import panels as pn
from ..streaming import jobs as sj
from . import views as v
from .registry import query, r, rounded

D = lambda s: F.lit(s).cast("date")


def t(spark, sf, name):
    return v.table(spark, sf, name)


def _shared(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources -------------------------------------------------------------------------


@query("panel_scan", "select l_suppkey, l_shipdate, l_extendedprice from lineitem")
def panel_scan(spark, sf):
    return pn.scan(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_shipdate", "l_extendedprice"])


@query("union_common_columns", """
  select k, arg_max(b, src) bal from (select s_suppkey k, s_acctbal b, 0 src from supplier union all select c_custkey, c_acctbal, 1 from customer) group by 1""")
def union_common_columns(spark, sf):
    a = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), "s_name")
    b = t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), "c_mktsegment")
    return pn.union_common([a, b], ["k"])


@query("largest_source_file")
def largest_source_file(spark, sf):
    """Of the given tables' files the heaviest, with line items as the favourite (sizes are no table, so there is no SQL)."""
    files = pn.pick_largest_source(spark, [f"{sf}/{name}.parquet" for name in ("orders", "lineitem", "events", "customer")], "lineitem")
    return files.select(F.element_at(F.split("file_path", "/"), -1).alias("file"))


@query("monthly_layout", v.with_views("select strftime(trade_date, '%Y%m') as month, count(*) n, round(sum(amount), 2) amount from panel_l group by 1", "panel_l"))
def monthly_layout(spark, sf):
    """Write by month with dynamic overwrite, then read the partitions back."""
    path = _shared(spark, "monthly")
    pn.write_monthly(v.panel_l(spark, sf), path)
    back = spark.read.schema("amount double, month string").parquet(path)
    return rounded(back.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount")), 2)


@query("missing_dates", """
  select cast(d as date) cal_date from range(date '1995-01-01', date '2001-12-01', interval 1 day) x(d) where isodow(d) < 6 and cast(d as date) not in (select cast(o_orderdate as date) from orders where o_orderpriority = '1-URGENT')""")
def missing_dates(spark, sf):
    o = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("trade_date"))
    return pn.missing_dates(pn.calendar(spark, "1995-01-01", "2001-11-30"), o)


@query("newer_rows", "select l_orderkey, l_linenumber from lineitem where l_shipdate > (select max(l_shipdate) from lineitem where l_shipdate < timestamp '2001-06-01')")
def newer_rows(spark, sf):
    li = t(spark, sf, "lineitem")
    out = pn.newer_than_stored(li, li.where(F.col("l_shipdate") < F.lit("2001-06-01").cast("timestamp")), "l_shipdate")
    return out.select("l_orderkey", "l_linenumber")


@query("snapshot_upsert", v.with_views("""
  select "date", sector_name, case when month("date") % 2 = 0 then main_force_net * 2 else main_force_net end main_force_net from sector_flow""", "sector_flow"))
def snapshot_upsert(spark, sf):
    f = v.sector_flow(spark, sf).select("date", "sector_name", "main_force_net")
    new = f.where(F.month("date") % 2 == 0).withColumn("main_force_net", F.col("main_force_net") * 2)
    return pn.merge_snapshot(f.withColumn("version", F.lit(1)), new.withColumn("version", F.lit(2))).drop("version")


@query("dataset_span", "select count(*) as rows, min(l_shipdate) start_date, max(l_shipdate) end_date from lineitem")
def dataset_span(spark, sf):
    return pn.span(t(spark, sf, "lineitem"), "l_shipdate")


@query("freshness", "select max(cast(o_orderdate as date)) end_date, max(cast(o_orderdate as date)) >= date '2001-08-03' fresh from orders")
def freshness(spark, sf):
    o = t(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return pn.is_fresh(o, "d", F.lit("2001-08-05 10:00:00").cast("timestamp"))


@query("quality_issues", v.with_views("""
  select count(distinct ts_code) codes, round(avg(case when "name" = ts_code or "name" = split_part(ts_code, '.', 1) then 1.0::double else 0.0::double end), 6) name_equals_code,
    round(avg(case when industry = '未知' then 1.0::double else 0.0::double end), 6) industry_missing,
    list_filter([case when avg(case when industry = '未知' then 1.0::double else 0.0::double end) > 0.2 then 'industry_missing' end], lambda x: x is not null) issues
  from (select ts_code, "name", case when industry in ('IND1', 'IND2', 'IND3') then '未知' else industry end industry from panel_e where trade_date = (select max(trade_date) from panel_e))""", "panel_e"))
def quality_issues(spark, sf):
    df = v.panel_e(spark, sf)
    return pn.quality_issues(df.withColumn("industry", F.when(F.col("industry").isin("IND1", "IND2", "IND3"), "未知").otherwise(F.col("industry"))))


@query("set_difference", """
  select coalesce(a.k, b.k) k, case when b.k is null then 'missing' else 'extra' end side from (select distinct o_custkey k from orders where o_orderstatus = 'F') a full join (select c_custkey k from customer where c_acctbal > 0) b on a.k = b.k where a.k is null or b.k is null""")
def set_difference(spark, sf):
    a = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return pn.set_difference(a, b, "k")


@query("column_profile", """
  select 'l_discount' "column", round(avg(case when l_discount <> 0 then 1.0::double else 0.0::double end), 6) nonzero_rate, 0.0::double null_rate from lineitem
  union all select 'l_tax', round(avg(case when l_tax <> 0 then 1.0::double else 0.0::double end), 6), 0.0::double from lineitem""")
def column_profile(spark, sf):
    return rounded(pn.profile_columns(t(spark, sf, "lineitem"), ["l_discount", "l_tax"]))


SHIFT = """tc as (select distinct cast(l_shipdate as date) cal_date from lineitem where month(l_shipdate) % 2 = 1), rk as (select *, row_number() over (order by cal_date) k from tc),
dy as (select distinct cast(o_orderdate as date) d from orders)"""


@query("next_trading_day", v.with_views("select d as day, (select min(cal_date) from tc where cal_date > d) target from dy", extra=SHIFT))
def next_trading_day(spark, sf):
    return pn.shift_days(*_days(spark, sf), 1)


@query("third_previous_trading_day", v.with_views("select d as day, (select cal_date from rk where k = (select max(k) from rk r2 where r2.cal_date < d) - 2) target from dy", extra=SHIFT))
def third_previous_trading_day(spark, sf):
    return pn.shift_days(*_days(spark, sf), -3)


def _days(spark, sf):
    odd = lambda c: F.month(c) % 2 == 1
    cal = t(spark, sf, "lineitem").where(odd("l_shipdate")).select(F.to_date("l_shipdate").alias("cal_date")).distinct()
    days = t(spark, sf, "orders")
    return days.select(F.to_date("o_orderdate").alias("day")).distinct(), cal


@query("latest_valid_date", "select max(d) valid_date from (select cast(o_orderdate as date) d, count(*) n from orders where o_orderpriority = '1-URGENT' group by 1) where d between date '2000-05-01' - 30 and date '2000-05-01'")
def latest_valid_date(spark, sf):
    c = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("trade_date")).agg(F.count(F.lit(1)).alias("rows"))
    return pn.latest_valid_date(c, D("2000-05-01"))


@query("back_filled_rows", """
  select l_orderkey, l_linenumber from lineitem where cast(l_shipdate as date) in (select cast(d as date) from range(date '2000-01-01', date '2000-04-01', interval 1 day) x(d) where isodow(d) < 6
    and cast(d as date) not in (select cast(o_orderdate as date) from orders where o_orderpriority = '1-URGENT') order by 1 desc limit 7)""")
def back_filled_rows(spark, sf):
    stored = t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("trade_date"))
    src = t(spark, sf, "lineitem").withColumn("trade_date", F.to_date("l_shipdate"))
    return pn.back_fill(src, pn.calendar(spark, "2000-01-01", "2000-03-31"), stored, 7).select("l_orderkey", "l_linenumber")


@query("status_counts", v.with_views("""
  select 'status' kind, status item, count(*) count from reports group by 2 union all select 'table', 'reports', count(*) from reports union all select 'table', 'labels', count(*) from labels""", "reports"))
def status_counts(spark, sf):
    return pn.status_counts({"reports": v.reports(spark, sf), "labels": t(spark, sf, "labels")}, "reports")


@query("legacy_import", """
  select e.event_id external_id, c.c_custkey + 100000 source_id, ['a' || cast(e.user_id % 3 as varchar)] tags from events e join customer c on c.c_custkey = e.user_id where e.event_type <> 'error'""")
def legacy_import(spark, sf):
    e = t(spark, sf, "events")
    legacy = e.select(F.col("event_id").alias("external_id"), F.col("user_id").alias("source_id"), F.concat(F.lit('["a'), (F.col("user_id") % 3).cast("string"), F.lit('"]')).alias("tags"))
    parents = t(spark, sf, "customer").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 100000).alias("new_id"))
    stored = e.where("event_type = 'error'").select(F.col("event_id").alias("external_id"))
    return pn.import_legacy(legacy, parents, stored, ["external_id"], "source_id", ["tags"])


@query("wide_exposures", v.with_views("""
  select ts_code, max("close") filter (trade_date = date '2024-01-29') "20240129", max("close") filter (trade_date = date '2024-01-30') "20240130" from panel_e group by 1""", "panel_e"))
def wide_exposures(spark, sf):
    return pn.exposures_wide(v.panel_e(spark, sf).select("ts_code", "trade_date", "close"), ["close"], ["20240129", "20240130"])


# ---- ingest rules --------------------------------------------------------------------


@query("numeric_coercion", """select event_id, try_cast(case when user_id % 3 = 0 then 'x' else cast(value as varchar) end as double) num from events""")
def numeric_coercion(spark, sf):
    text = F.when(F.col("user_id") % 3 == 0, "x").otherwise(F.col("value").cast("string"))
    return t(spark, sf, "events").select("event_id", sc.number(text).alias("num"))


@query("defaults_and_aliases", "select s_suppkey, s_acctbal float_mv, 0.0::double revenue_yoy, coalesce(nullif(s_acctbal, s_acctbal), 1.5)::double pb from supplier")
def defaults_and_aliases(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("float_mv"), F.lit(None).cast("double").alias("pb"))
    return sc.with_defaults(s, {"float_mv": ("double", None), "revenue_yoy": ("double", 0.0), "pb": ("double", 1.5)})


@query("parsed_amounts", """
  select c_custkey, c_acctbal * 10000 amount, c_custkey % 500 / 100 pct from customer""")
def parsed_amounts(spark, sf):
    c = t(spark, sf, "customer")
    money = F.concat(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("万元"))
    share = F.concat((F.col("c_custkey") % 500 / 100).cast("decimal(6,2)").cast("string"), F.lit("%"))
    return c.select("c_custkey", sc.parse_amount(money).alias("amount"), sc.parse_percent(share).alias("pct"))


@query("unit_conversion", "select o_orderkey, round(o_totalprice * 1000 / 1e8, 3) yi from orders")
def unit_conversion(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", sc.to_yi(F.col("o_totalprice") * 1000).alias("yi"))


@query("first_positive", "select c_custkey, case when c_acctbal > 5000 then c_acctbal when c_nationkey > 0 then c_nationkey::double else 0.0::double end mv from customer")
def first_positive(spark, sf):
    c = t(spark, sf, "customer").withColumns({"a": F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).otherwise(-1.0), "b": F.col("c_nationkey").cast("double")})
    return c.select("c_custkey", sc.first_positive(["a", "b"]).alias("mv"))


@query("code_normalisation", """
  select c_custkey, k || case when substr(k, 1, 1) in ('6', '9') then '.SH' when substr(k, 1, 1) in ('4', '8') then '.BJ' else '.SZ' end ts_code, substr(k, 1, 3) not in ('300', '301', '688', '689') board_kept
  from (select *, lpad(cast(c_custkey * 977 % 1000000 as varchar), 6, '0') k from customer)""")
def code_normalisation(spark, sf):
    c = t(spark, sf, "customer").withColumn("k", F.lpad((F.col("c_custkey") * 977 % 1000000).cast("string"), 6, "0"))
    return c.select("c_custkey", sc.exchange_suffix("k").alias("ts_code"), sc.board_kept("k", True, True).alias("board_kept"))


@query("blank_and_flags", """
  select c_custkey, x in ('', 'nan', 'none') blank, case when x in ('nan', 'none') then '' else x end cleaned, x not in ('0', 'no') truth from (select c_custkey, ['', 'nan', 'no', '0', 'yes', 'none'][c_custkey % 6 + 1] x from customer)""")
def blank_and_flags(spark, sf):
    words = F.array(*[F.lit(w) for w in ("", "nan", "no", "0", "yes", "none")])
    c = t(spark, sf, "customer").withColumn("x", F.get(words, (F.col("c_custkey") % 6).cast("int")))
    return c.select("c_custkey", sc.is_blank("x").alias("blank"), sc.clean_text("x").alias("cleaned"), sc.to_bool("x").alias("truth"))


@query("dimension_back_fill", """
  select o_orderkey, case when o_orderkey % 3 = 0 then c_name else 'n' end "name", case when o_orderkey % 4 = 0 then c_mktsegment else 'i' end industry from orders join customer on o_custkey = c_custkey""")
def dimension_back_fill(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("ts_code"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise("n").alias("name"),
                                      F.when(F.col("o_orderkey") % 4 == 0, "未知").otherwise("i").alias("industry"))
    info = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("ts_code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"))
    return jn.fill_basic(o, info).select("o_orderkey", "name", "industry")


@query("limit_pool_back_fill", v.with_views("""
  select ts_code, trade_date, coalesce(nullif(case when vol > 2 then 1.5::double else 0.0::double end, 0), amount, 0.0::double) fd_amount, case when vol > 2 then 'own' else 'pool' end first_time from panel_e""", "panel_e"))
def limit_pool_back_fill(spark, sf):
    p = v.panel_e(spark, sf)
    base = p.select("ts_code", "trade_date", F.when(F.col("vol") > 2, 1.5).otherwise(0.0).alias("fd_amount"), F.when(F.col("vol") > 2, "own").otherwise(" ").alias("first_time"))
    pool = p.select("ts_code", "trade_date", F.col("amount").alias("fd_amount"), F.lit("pool").alias("first_time"))
    return jn.fill_limit_pool(base, pool, ["fd_amount"], ["first_time"])


@query("sentinel_valuation", v.with_views("select ts_code, trade_date, case when vol > 3 or pe = 0 then 999.0::double else pe end pe from panel_e", "panel_e"))
def sentinel_valuation(spark, sf):
    p = v.panel_e(spark, sf).select("ts_code", "trade_date", F.when(F.col("vol") <= 3, F.col("pe")).alias("pe"))
    return jn.sentinel_valuation(p, ["pe"])


@query("estimated_turnover", v.with_views(f"select ts_code, trade_date, {r('vol / (circ_mv * 1e4)', 'turnover_rate', 12)}, total_mv from panel_e", "panel_e"))
def estimated_turnover(spark, sf):
    p = v.panel_e(spark, sf).withColumn("turnover_rate", F.lit(0.0))
    out = jn.estimate_missing(p).select("ts_code", "trade_date", "turnover_rate", "total_mv")
    return rounded(out, 12, skip=("total_mv",))


@query("as_of_slice", v.with_views("""select ts_code, trade_date from panel_l where trade_date <= date '1999-06-30' qualify row_number() over (partition by ts_code order by trade_date desc) <= 40""", "panel_l"))
def as_of_slice(spark, sf):
    return jn.as_of_slice(v.panel_l(spark, sf), D("1999-06-30"), 40).select("ts_code", "trade_date")


@query("latest_section_newest", v.with_views("select ts_code, trade_date from panel_l where trade_date = (select max(trade_date) from panel_l)", "panel_l"))
def latest_section_newest(spark, sf):
    return jn.latest_or_last(v.panel_l(spark, sf).select("ts_code", "trade_date"), 1)


@query("latest_section", v.with_views("select ts_code, arg_max(trade_date, trade_date) trade_date from panel_l group by 1", "panel_l"))
def latest_section(spark, sf):
    return jn.latest_or_last(v.panel_l(spark, sf).select("ts_code", "trade_date"), 10**9)


@query("repaired_text", """select doc_id, "text" from documents""")
def repaired_text(spark, sf):
    """Text mangled through Latin-1 comes back unchanged."""
    d = t(spark, sf, "documents")
    broken = d.select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    return broken.select("doc_id", sc.repair_mojibake("text", r"[\x{80}-\x{ff}]").alias("text"))


@query("tolerant_json", """select event_id, cast(regexp_extract(props, '"k": (\\d+)', 1) as bigint) k from events""")
def tolerant_json(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.concat(F.lit("noise "), "props", F.lit(" tail")).alias("s"))
    return e.select("event_id", pn.tolerant_json("s", "k bigint")["k"].alias("k"))


# ---- joins ---------------------------------------------------------------------------


@query("merge_on_two_keys", """
  select o_orderkey, l_linenumber, c_mktsegment from orders join lineitem on l_orderkey = o_orderkey and cast(l_shipdate as date) <> cast(o_orderdate as date) left join customer on c_custkey = o_custkey""".replace("and cast(l_shipdate as date) <> cast(o_orderdate as date)", "and l_suppkey % 7 = o_custkey % 7"))
def merge_on_two_keys(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 7).alias("m"), "o_custkey")
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 7).alias("m"), "l_linenumber")
    seg = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), "c_mktsegment")
    return jn.merge_keyed(o, li, seg, ("k", "m")).select(F.col("k").alias("o_orderkey"), "l_linenumber", "c_mktsegment")


@query("snapshot_dimension", v.with_views("select ts_code, trade_date, s_acctbal snap_mv from panel_l left join supplier on s_suppkey = cast(ts_code as bigint)", "panel_l"))
def snapshot_dimension(spark, sf):
    snap = t(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("ts_code"), F.col("s_acctbal").alias("snap_mv"))
    return jn.attach_snapshot(v.panel_l(spark, sf).select("ts_code", "trade_date"), snap, ["snap_mv"])


ADJ = """aj as (select ts_code, cast(date_trunc('month', trade_date) as date) d, 1 + count(*) / 100 f from panel_l where month(trade_date) % 3 <> 0 group by 1, 2)"""


@query("asof_join", v.with_views("""
  select p.ts_code, p.trade_date, coalesce(a.f, (select arg_min(f, d) from aj x where x.ts_code = p.ts_code)) f from panel_l p asof left join aj a on a.ts_code = p.ts_code and p.trade_date >= a.d""", "panel_l", extra=ADJ))
def asof_join(spark, sf):
    p = v.panel_l(spark, sf).select("ts_code", "trade_date")
    adj = p.where(F.month("trade_date") % 3 != 0).groupBy("ts_code", F.trunc("trade_date", "month").alias("d")).agg((1 + F.count(F.lit(1)) / 100).alias("f"))
    return wn.asof_join(p, adj, "ts_code", "trade_date", "d", ["f"], bucket="year", backfill=True)


@query("month_snapshot_join", v.with_views("""
  select p.ts_code, p.trade_date, m.v first_vol from panel_l p left join (select ts_code, date_trunc('month', trade_date) m, arg_min(vol, trade_date) v from panel_l where extract(day from trade_date) > 5 group by 1, 2) m
    on m.ts_code = p.ts_code and m.m = date_trunc('month', p.trade_date)""", "panel_l"))
def month_snapshot_join(spark, sf):
    p = v.panel_l(spark, sf)
    return jn.month_snapshot(p.select("ts_code", "trade_date"), p.where(F.dayofmonth("trade_date") > 5).withColumnRenamed("vol", "first_vol"), ["first_vol"])


@query("membership_flag", "select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 400000) then 1.0::double else 0.0::double end fav from customer")
def membership_flag(spark, sf):
    m = t(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return jn.membership_flag(t(spark, sf, "customer").select("c_custkey"), m, "c_custkey", "fav")


@query("candidate_history", v.with_views("""
  select ts_code, count(*) n from panel_l where ts_code in (select ts_code from panel_l group by 1 order by arg_max(amount, trade_date) desc, ts_code limit 12) group by 1""", "panel_l"))
def candidate_history(spark, sf):
    p = v.panel_l(spark, sf)
    snap = p.groupBy("ts_code").agg(F.max_by("amount", "trade_date").alias("score"))
    return jn.candidates_history(p, snap, "score", 12).groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"))


@query("insert_new_only", """
  select doc_id from documents where lang <> 'en' and source <> 'src1'""")
def insert_new_only(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", "source", F.col("doc_id").cast("string").alias("external_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), D("2024-01-01").alias("report_date"))
    stored = d.where("lang = 'en'").unionByName(d.where("source = 'src1'").withColumn("external_id", F.lit("other")))
    return jn.skip_existing(d, stored).select("doc_id")


@query("map_back", v.with_views("select p.ts_code, p.trade_date, coalesce(s.vol, 0.5::double) vol from panel_l p left join (select ts_code, vol from panel_l where trade_date = (select max(trade_date) from panel_l)) s using (ts_code)", "panel_l"))
def map_back(spark, sf):
    p = v.panel_l(spark, sf)
    snap = p.where(F.col("trade_date") == p.agg(F.max("trade_date").alias("newest")).scalar()).select("ts_code", "vol")
    return jn.map_back(p.select("ts_code", "trade_date"), snap, "vol", 0.5)


ALIASES = (("an", "ALPHA", 0), ("the", "BETA", 1), ("src1", "ONE", 2), ("src", "ANY", 3))


@query("alias_lookup", """
  select source, case when source = 'src1' then 'ONE' when contains(source, 'src1') then 'ONE' when contains(source, 'src') then 'ANY' else source end grp from (select distinct source from documents)""")
def alias_lookup(spark, sf):
    a = spark.createDataFrame(list(ALIASES), "alias string, target string, prio int")
    return jn.alias_match(t(spark, sf, "documents").select("source").distinct(), "source", a, "grp")


@query("fuzzy_lookup", """
  select source, (select min(n_name) from nation where contains('NATION_' || substr(source, 4), n_name) or contains(n_name, 'NATION_' || substr(source, 4))) hit from (select distinct source from documents)""")
def fuzzy_lookup(spark, sf):
    d = t(spark, sf, "documents").select("source").distinct().withColumn("k", F.concat(F.lit("NATION_"), F.expr("substr(source, 4)")))
    return jn.fuzzy_match(d, "k", t(spark, sf, "nation"), "n_name", "hit").select("source", "hit")


PART_CODES = "pc as (select distinct lpad(cast(p_partkey as varchar), 4, '0') code, p_brand, p_size from part)"


def part_codes(spark, sf):
    """A large dictionary: four digits of every part key."""
    code = F.lpad(F.col("p_partkey").cast("string"), 4, "0")
    return t(spark, sf, "part").select(code.alias("code"), "p_brand", "p_size").distinct()


@query("part_code_lookup", f"""with {PART_CODES}
  select c_custkey, (select min(code) from pc where contains(c_name, code) or contains(code, c_name)) code from customer""")
def part_code_lookup(spark, sf):
    """First part code inside every customer's name."""
    return jn.fuzzy_match(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", part_codes(spark, sf), "code", "code").select("c_custkey", "code")


@query("part_alias_lookup", f"""with {PART_CODES}
  select c_custkey, coalesce((select p_brand from pc where code = trim(c_name) order by p_size, code, p_brand limit 1),
    (select arg_min(p_brand, (p_size, code, p_brand)) from pc where contains(trim(c_name), code)), trim(c_name)) brand from customer""")
def part_alias_lookup(spark, sf):
    """Brand of the first part code, by size, inside every customer's name."""
    aliases = part_codes(spark, sf).select(F.col("code").alias("alias"), F.col("p_brand").alias("target"), F.col("p_size").alias("prio"))
    return jn.alias_match(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", aliases, "brand").select("c_custkey", "brand")


@query("merged_rankings", v.with_views("""
  select s.sector_name, main_force_net, n5, n10 from (select * from sector_flow where "date" = date '2000-05-01') s left join (select sector_name, a.main_force_net n5, b.main_force_net n10 from
    (select * from sector_flow where "date" = date '2000-04-01') a full join (select * from sector_flow where "date" = date '2000-03-01') b using (sector_name)) m using (sector_name)""", "sector_flow"))
def merged_rankings(spark, sf):
    f = v.sector_flow(spark, sf)
    at = lambda d, n: f.where(F.col("date") == D(d)).select("sector_name", F.col("main_force_net").alias(n), "turnover")
    five = at("2000-04-01", "n5").drop("turnover")
    return jn.merge_rankings(at("2000-05-01", "main_force_net").drop("turnover"), five, at("2000-03-01", "n10").drop("turnover"), "sector_name")


@query("attached_flow", v.with_views("""select g."date", g.sector_name, coalesce(f.main_force_net, 0.0::double) main_force_net from (select d."date", n_name sector_name from (select distinct "date" from sector_flow) d, nation) g left join sector_flow f using ("date", sector_name)""", "sector_flow"))
def attached_flow(spark, sf):
    f = v.sector_flow(spark, sf)
    names = t(spark, sf, "nation").agg(F.collect_list("n_name").alias("names"))
    grid = f.select("date").distinct().withColumn("n", names.scalar()).select("date", F.explode("n").alias("sector_name"))
    return jn.attach_flow(grid, f)


@query("close_fallback", v.with_views("""
  select ts_code, trade_date, "close" from panel_l where industry >= 'NATION_2' union all select ts_code, trade_date, "close" + 1 from panel_l where industry < 'NATION_2'""", "panel_l"))
def close_fallback(spark, sf):
    p = v.panel_l(spark, sf).select("ts_code", "trade_date", "close", "industry")
    full = F.col("industry") >= "NATION_2"
    start = p.agg(F.min("trade_date").alias("first")).scalar()
    return jn.close_map(p.where(full | (F.col("trade_date") == start)), p.withColumn("close", F.col("close") + 1), 10)


@query("latest_price", """
  select lpad(cast(c_custkey as varchar), 6, '0') code, coalesce(p, c_acctbal) price from customer left join (select l_suppkey k, cast(sum(round(l_extendedprice * 100)::bigint) filter (d = md) // sum(l_quantity::bigint) filter (d = md) as double) / 100 p
    from (select *, cast(l_shipdate as date) d, max(cast(l_shipdate as date)) over (partition by l_suppkey) md from lineitem) group by 1) on k = c_custkey""")
def latest_price(spark, sf):
    picks = t(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), D("2001-01-01").alias("pick_date"), F.col("c_acctbal").alias("price_at_pick"))
    return jn.latest_price(v.panel_l(spark, sf), picks)


@query("snapshot_change", v.with_views("""
  select ts_code, max("close") filter (b = 1) as last, round((max("close") filter (b = 1) / max("close") filter (b = 2) - 1) * 100, 2) + 0.0::double chg_1d, round((max("close") filter (b = 1) / max("close") filter (b = 21) - 1) * 100, 2) + 0.0::double chg_20d
  from (select *, row_number() over (partition by ts_code order by trade_date desc) b from panel_l) group by 1""", "panel_l"))
def snapshot_change(spark, sf):
    return rounded(jn.snapshot_change(v.panel_l(spark, sf)), 2)


@query("best_constituents", """
  select m snapshot, l_suppkey con_code from (select distinct strftime(l_shipdate, '%Y%m') m, l_suppkey from lineitem) where m = (select max(m) from (select strftime(l_shipdate, '%Y%m') m, count(distinct l_suppkey) n from lineitem group by 1) where n >= 100)""")
def best_constituents(spark, sf):
    f = t(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyyMM").alias("snapshot"), F.col("l_suppkey").alias("con_code"))
    return jn.best_constituents(f, 100)


# ---- sets and top-k ------------------------------------------------------------------


@query("distinct_union", "select c_nationkey k from customer union select s_nationkey from supplier")
def distinct_union(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set_intersection", "select o_custkey k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def set_intersection(spark, sf):
    side = lambda s: t(spark, sf, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").intersect(side("O"))


@query("keep_last_duplicates", "select o_custkey, o_orderpriority, max(o_orderkey) o_orderkey from orders group by 1, 2")
def keep_last_duplicates(spark, sf):
    return wn.latest_per_key(t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("unpivoted_prices", v.with_views("""select ts_code, trade_date, field, value from (select ts_code, trade_date, "open", high, low from panel_e) unpivot (value for field in ("open", high, low))""", "panel_e"))
def unpivoted_prices(spark, sf):
    return v.panel_e(spark, sf).unpivot(["ts_code", "trade_date"], ["open", "high", "low"], "field", "value")


@query("global_top_k", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 100")
def global_top_k(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(100).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("top_k_per_group", "select o_custkey, o_orderkey, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rank from orders) where rank <= 3")
def top_k_per_group(spark, sf):
    return wn.topk_per_group(t(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("head_and_tail", "(select s_suppkey, 'head' side from supplier order by s_acctbal desc, s_suppkey limit 14) union all (select s_suppkey, 'tail' from supplier order by s_acctbal, s_suppkey limit 3)")
def head_and_tail(spark, sf):
    return jn.ends(t(spark, sf, "supplier"), "s_acctbal", "s_suppkey", 14, 3).select("s_suppkey", "side")


@query("paged_rows", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def paged_rows(spark, sf):
    return t(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("salted_top_n", "select o_orderpriority, o_orderkey, pick_rank from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) pick_rank from orders) where pick_rank <= 1500")
def salted_top_n(spark, sf):
    out = ranks.top_n(t(spark, sf, "orders"), ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1500, "o_orderkey", value=F.col("o_totalprice"))
    return out.select("o_orderpriority", "o_orderkey", "pick_rank")


@query("running_totals", "select o_orderkey, cast(sum(o_orderkey % 7) over (partition by o_orderstatus order by o_orderkey) as bigint) total, max(o_orderkey % 101) over (partition by o_orderstatus order by o_orderkey) top from orders")
def running_totals(spark, sf):
    """Running sum and maximum of three huge groups, split into cells."""
    o = t(spark, sf, "orders").select("o_orderstatus", "o_orderkey", (F.col("o_orderkey") % 7).alias("a"), (F.col("o_orderkey") % 101).alias("b"), F.floor(F.col("o_orderkey") / 1000).alias("cell"))
    out = wn.cumulative(o, ["o_orderstatus"], "o_orderkey", "cell", {"total": ("a", "sum"), "top": ("b", "max")})
    return out.select("o_orderkey", "total", "top")


# ---- streams -------------------------------------------------------------------------


@query("stream_daily_bars", """
  select user_id, cast(ts as date) trade_date, arg_min(value, ts) "open", max(value) high, min(value) low, arg_max(value, ts) "close", count(*) vol, round(sum(value), 2) amount from events group by 1, 2
  having cast(ts as date) + 1 <= (select max(ts) - interval 1 hour from events)""")
def stream_daily_bars(spark, sf):
    bars = sj.daily_bars(sj.table_stream(spark, sf, "events.parquet"), "user_id", "ts", "value")
    return rounded(sj.drain(bars, "bars"), 2)


@query("stream_sliding_sums", """
  select user_id, e.d::timestamp window_end, round(sum(value), 2) total, count(*) n from events, (select unnest(generate_series(date '2024-01-02', date '2024-02-10', interval 1 day)) d) e
  where ts < e.d and ts >= e.d - interval 5 day and e.d <= (select max(ts) - interval 1 hour from events) group by 1, 2""")
def stream_sliding_sums(spark, sf):
    out = sj.drain(sj.sliding_sums(sj.table_stream(spark, sf, "events.parquet"), "user_id", "ts", "value"), "sliding")
    return rounded(out, 2)


@query("stream_sector_flow", """
  select 'S' || cast(user_id % 7 as varchar) sector_name, cast(ts as date) "date", round(sum(value), 2) main_force_net, count(*) n from events group by 1, 2 having cast(ts as date) + 1 <= (select max(ts) - interval 1 hour from events)""")
def stream_sector_flow(spark, sf):
    ids = t(spark, sf, "events").select("user_id").distinct()
    dim = ids.withColumn("sector_name", F.concat(F.lit("S"), (F.col("user_id") % 7).cast("string")))
    return rounded(sj.drain(sj.sector_flow(sj.table_stream(spark, sf, "events.parquet"), dim, "user_id", "ts", "value"), "flow"), 2)


@query("stream_deduplicated", "select count(*) n, count(distinct event_id) ids from events")
def stream_deduplicated(spark, sf):
    s = sj.table_stream(spark, sf, "events.parquet")
    twice = s.select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = sj.drain(sj.without_duplicates(twice, ["event_id"], "ts"), "dedup")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("stream_trailing_peaks", """
  select lpad(cast(user_id as varchar), 6, '0') code, event_id, value as "close", max(value) over w peak, (max(value) over w > first_value(value) over w * 1.05) and ((max(value) over w - value) / max(value) over w >= 0.12) signal
  from events window w as (partition by user_id order by ts rows unbounded preceding)""".replace("event_id, ", ""))
def stream_trailing_peaks(spark, sf):
    s = sj.table_stream(spark, sf, "events.parquet").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), "ts", F.col("value").alias("close"))
    return sj.drain(sj.trailing_peaks(s), "peaks").select("code", "close", "peak", "signal")


@query("stream_ic_monitor", f"""
  select event_type factor, {r('avg(x) over w', 'ic_mean', 8)}, {r('avg(x) over w / (stddev_pop(x) over w + 1e-9)', 'ir', 5)} from (select *, (value - 50) / 500 x from events)
  window w as (partition by event_type order by ts rows between 19 preceding and current row)""")
def stream_ic_monitor(spark, sf):
    s = sj.table_stream(spark, sf, "events.parquet").select(F.col("event_type").alias("factor"), "ts", ((F.col("value") - 50) / 500).alias("ic"))
    out = sj.drain(sj.ic_monitor(s), "monitor")
    return out.select("factor", (F.round("ic_mean", 8) + F.lit(0.0)).alias("ic_mean"), (F.round("ir", 5) + F.lit(0.0)).alias("ir"))


@query("stream_upserts", "select user_id, event_type, arg_max(value, ts) as value from events group by 1, 2")
def stream_upserts(spark, sf):
    path = _shared(spark, "upserts")
    s = sj.table_stream(spark, sf, "events.parquet").select("user_id", "event_type", "ts", "value")
    sj.upsert_log(s, f"{path}/log", ["user_id", "event_type"], "ts", f"{path}/ckpt").awaitTermination()
    return sj.read_upserts(spark, f"{path}/log", ["user_id", "event_type"], "ts").select("user_id", "event_type", "value")


@query("stream_upserts_compacted", "select user_id, event_type, arg_max(value, ts) as value from events group by 1, 2")
def stream_upserts_compacted(spark, sf):
    """The same over many batches, with the log compacted on the way."""
    path, keys = _shared(spark, "upserts"), ["user_id", "event_type"]
    t(spark, sf, "events").select("user_id", "event_type", "ts", "value").repartition(6, "event_id").write.parquet(f"{path}/source")
    s = sj.table_stream(spark, f"{path}/source", "*.parquet")
    sj.upsert_log(s, f"{path}/log", keys, "ts", f"{path}/ckpt", compact_every=4).awaitTermination()
    return sj.read_upserts(spark, f"{path}/log", keys, "ts").select("user_id", "event_type", "value")
