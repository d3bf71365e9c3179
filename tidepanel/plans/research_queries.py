"""Queries over research, portfolio and macro operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import macro as ma
from ..operators import portfolio as pf
from ..operators import ranks
from ..operators import research as rs
from . import views as v
from .registry import query, r, rounded

D = lambda s: F.lit(s).cast("date")
LATIN = {"buy": ("buy",), "upgrade": ("upgrade",), "first": ("first",)}
# Latin patterns for the driver text, which carries plain numbers only.
NUMBERS = ((r"(20\d{2})[^0-9]{1,20}(\d+)", 1, 2), (r"(\d{2,4})\.(\d+)", 0, 1))


def reps(spark, sf):
    return v.reports(spark, sf)


@query("text_cleaning", v.with_views(r"""select report_id, trim(regexp_replace("text", '[ \t\n\x0B\f\r]+', ' ', 'g')) clean from reports""", "reports"))
def text_cleaning(spark, sf):
    return reps(spark, sf).select("report_id", rs.clean(F.col("text")).alias("clean"))


@query("extract_first_number", v.with_views(
    r"""select report_id, coalesce(nullif(regexp_extract("text", '(\d+)\.(\d+)', 1), ''), nullif(regexp_extract("text", '(\d+)', 1), '')) target from reports""", "reports"))
def extract_first_number(spark, sf):
    return reps(spark, sf).select("report_id", rs.target_price(F.col("text"), (r"(\d+)\.(\d+)", r"(\d+)")).alias("target"))


EXTRACT = r"""ex as (select report_id, 0 p, unnest(regexp_extract_all("text", '(20\d{2})[^0-9]{1,20}(\d+)', 1)) y, unnest(regexp_extract_all("text", '(20\d{2})[^0-9]{1,20}(\d+)', 2)) vv,
    unnest(generate_series(1, len(regexp_extract_all("text", '(20\d{2})[^0-9]{1,20}(\d+)', 2)))) i from reports
  union all select report_id, 1, unnest(list_transform(regexp_extract_all("text", '(\d{2,4})\.(\d+)', 1), lambda x: null::varchar)), unnest(regexp_extract_all("text", '(\d{2,4})\.(\d+)', 1)),
    unnest(generate_series(1, len(regexp_extract_all("text", '(\d{2,4})\.(\d+)', 1)))) from reports),
ey as (select report_id, cast(y as integer) as "year", try_cast(vv as double) as "value", p, i from ex where try_cast(vv as double) > 0.01 and try_cast(vv as double) < 100000),
ez as (select report_id, "year", "value", min((p, i)) f from ey group by 1, 2, 3),
er as (select *, row_number() over (partition by report_id order by f, "value") pos from ez)"""


@query("extract_numbers", v.with_views('select report_id, "year", "value", pos from er where pos <= 5', "reports", extra=EXTRACT))
def extract_numbers(spark, sf):
    return rs.extract_numbers(reps(spark, sf), "report_id", "text", NUMBERS, 0.01, 100000, 5).drop("match_text")


@query("forecast_rows", v.with_views("""
  select er.report_id, stock_code, "year" forecast_year, "value" profit_value, cast(null as double) eps_value, pos from er join reports using (report_id) where pos <= 5 and status = 'summarized'""", "reports", extra=EXTRACT))
def forecast_rows(spark, sf):
    df = reps(spark, sf)
    done = df.where("status = 'pending'").select("report_id")
    return rs.forecast_rows(df, done, NUMBERS, ((r"(no) such (text)", 0, 1),), profits=5, earnings=3, most=5)


EVENT = ((r"(2\d{3})\d*?([1-9])\d*?([1-9])", "notice"),)


@query("text_events", v.with_views(r"""
  select event_date, stock_code, stock_name || ' notice' title, 'notice' event_type, min(report_id) report_id from (select *, try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') as date) event_date from (
    select report_id, stock_code, stock_name, unnest(regexp_extract_all("text", '(2\d{3})\d*?([1-9])\d*?([1-9])', 1)) y, unnest(regexp_extract_all("text", '(2\d{3})\d*?([1-9])\d*?([1-9])', 2)) m, unnest(regexp_extract_all("text", '(2\d{3})\d*?([1-9])\d*?([1-9])', 3)) d from reports))
  where event_date between date '1900-01-01' and date '1900-01-01' + 100000 group by 1, 2, 3""", "reports"))
def text_events(spark, sf):
    """Date-like digits of the driver text; hand-made Chinese rows are in the tests."""
    out = rs.text_events(reps(spark, sf), D("1900-01-01"), EVENT, 100_000)
    return out.select("event_date", "stock_code", "title", "event_type", "report_id")


@query("name_map", v.with_views("select stock_code code, arg_max(stock_name, report_id) name from reports group by 1", "reports"))
def name_map(spark, sf):
    return rs.name_map(reps(spark, sf).withColumn("title", F.col("text")))


@query("resolved_codes", v.with_views("""
  select report_id, coalesce(case when report_id % 2 = 0 then stock_code end, case when len(t) = 1 then t[1] end) code from (
    select *, list_filter(case when report_id % 3 = 0 then target_stocks[1:2] else target_stocks end, lambda x: regexp_matches(x, '^[0-9]{6}$')) t from reports)""", "reports"))
def resolved_codes(spark, sf):
    k = F.col("report_id")
    own = F.when(k % 2 == 0, F.col("stock_code"))
    targets = F.when(k % 3 == 0, F.slice("target_stocks", 1, 2)).otherwise(F.col("target_stocks"))
    return reps(spark, sf).select("report_id", rs.resolve_code(own, targets).alias("code"))


@query("institution_weights", v.with_views(
    "select institution, case when contains(institution, 'src1') then 1.5::double when contains(institution, 'src') and contains(institution, '2') then 1.0::double else 0.8::double end weight from (select distinct institution from reports)", "reports"))
def institution_weights(spark, sf):
    d = reps(spark, sf).select("institution").distinct()
    return d.select("institution", rs.institution_weight(F.col("institution"), ("src1",), ("2",)).alias("weight"))


WEIGHT = rs.institution_weight


def weight():
    return WEIGHT(F.col("institution"), ("src1",), ("2",))


WSQL = "case when contains(institution, 'src1') then 1.5 when contains(institution, '2') then 1.0 else 0.8 end"


def cons_sql(dup):
    lst = "list_distinct(list_concat([stock_code], list_filter(target_stocks, lambda x: regexp_matches(x, '^[0-9]{6}$'))))"
    if dup:
        lst = "list_concat([stock_code], list_distinct(list_filter(target_stocks, lambda x: regexp_matches(x, '^[0-9]{6}$'))))"
    return f"""rf as (select *, contains(rating, 'buy') or sentiment = 'bullish' b, contains(rating, 'upgrade') u, contains(rating, 'first') f, {WSQL} w from reports where status = 'summarized' and report_date >= date '2024-01-05'),
me as (select rf.*, unnest({lst}) code from rf),
cs as (select code, count(*) report_count, count(*) filter (b) buy_count, count(*) filter (sentiment = 'bullish') bullish_count, count(*) filter (u) upgrade_count, count(*) filter (f) first_cover_count,
  count(distinct institution) institution_count, list_sort(list(distinct institution)) institutions, round(sum(w * case when b then 2 else 1 end + case when u then 1 else 0 end + case when f then 0.8 else 0 end), 1)::double score,
  arg_min(target_price, report_id) filter (target_price is not null) target_price, max(report_date) latest_date, list_sort(list_distinct(flatten(list(tags)))) industries from me group by 1),
ch as (select lpad(cast(s_suppkey % 50 as varchar), 6, '0') code, round(avg(s_acctbal) / 1000, 2) - 4 price_change_20d from supplier group by 1)"""


CONS_OUT = """select cs.*, price_change_20d, coalesce(price_change_20d <= -5 and buy_count / report_count >= 0.6 and report_count >= 3, false) divergence from cs left join ch using (code) order by score desc, report_count desc, code limit 15"""


def changes(spark, sf):
    s = v.table(spark, sf, "supplier")
    return s.groupBy(F.lpad((F.col("s_suppkey") % 50).cast("string"), 6, "0").alias("code")).agg((F.round(F.avg("s_acctbal") / 1000, 2) - 4).alias("price_change_20d"))


@query("research_consensus", v.with_views(CONS_OUT, "reports", extra=cons_sql(False)))
def research_consensus(spark, sf):
    return rs.consensus(reps(spark, sf), D("2024-01-05"), changes(spark, sf), weight=weight(), **LATIN)


@query("research_consensus_double", v.with_views(CONS_OUT, "reports", extra=cons_sql(True)))
def research_consensus_double(spark, sf):
    return rs.consensus(reps(spark, sf), D("2024-01-05"), changes(spark, sf), weight=weight(), count_twice=True, **LATIN)


@query("report_recommendations", v.with_views(f"""
  select report_id, rank, score, case when len(rr) = 0 then 'new report' else array_to_string(rr, '; ') end reason from (select *, row_number() over (order by score desc, report_id) rank from (
    select report_id, round((st * 0.4 + least(1, len(m) / 3) * 0.3 + case when ag = 0 then 1.0 when ag <= 2 then 0.6 else 0.2 end * 0.2 + 0.1) * {WSQL}, 4)::double score,
      list_filter([case when st = 1.0 then 'watched stock' when st = 0.8 then 'mentions a watched stock' end, case when len(m) > 0 then 'industry ' || m[1] end], lambda x: x is not null) rr
    from (select *, case when stock_code in ('000001', '000007') then 1.0 when list_has_any(target_stocks, ['000001', '000007']) then 0.8 else 0 end st, list_filter(list_distinct(tags), lambda x: x in ('tag3')) m,
      date '2024-01-30' - report_date ag from reports where status = 'summarized' and report_date >= date '2024-01-23'))) where rank <= 20""", "reports"))
def report_recommendations(spark, sf):
    return rs.recommendations(reps(spark, sf), D("2024-01-30"), ["000001", "000007"], ["tag3"], 20, weight=weight())


PX = """px as (select lpad(cast(l_suppkey % 50 as varchar), 6, '0') code, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) current_price from lineitem group by 1)"""


def prices(spark, sf):
    li = v.table(spark, sf, "lineitem")
    return li.groupBy(F.lpad((F.col("l_suppkey") % 50).cast("string"), 6, "0").alias("code")).agg(
        F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("current_price"))


@query("target_upside", v.with_views("""
  select code, target_price, round(current_price, 2) current_price, round((target_price - current_price) / current_price * 100, 1) + 0.0::double upside, institution from (
    select stock_code code, arg_max(target_price, (report_date, -report_id)) target_price, max(report_date) rd, arg_max(institution, (report_date, -report_id)) institution from reports where target_price is not null group by 1) join px using (code) where current_price > 0 order by upside desc, code limit 12""", "reports", extra=PX))
def target_upside(spark, sf):
    return rs.target_upside(reps(spark, sf), prices(spark, sf))


EV = """ev as (select report_id, stock_code, date '2024-01-01' + cast(report_id % 90 as integer) event_date, case report_id % 3 when 0 then 'growth ahead' when 1 then 'loss ahead' else 'meeting' end title, lang event_type from reports)"""


def events(spark, sf):
    k = F.col("report_id")
    return reps(spark, sf).select("report_id", "stock_code", F.date_add(D("2024-01-01"), (k % 90).cast("int")).alias("event_date"),
                                  F.when(k % 3 == 0, "growth ahead").when(k % 3 == 1, "loss ahead").otherwise("meeting").alias("title"), F.col("lang").alias("event_type"))


@query("upcoming_events", v.with_views("""
  select stock_code, event_type, max((event_date, title))[1] event_date, max((event_date, title))[2] title from ev where event_date between date '2024-01-25' and date '2024-03-02' group by 1, 2 order by event_date desc, stock_code, event_type limit 30""".replace("max((event_date, title))[1]", "max(event_date)").replace("max((event_date, title))[2]", "arg_max(title, (event_date, title))"), "reports", extra=EV))
def upcoming_events(spark, sf):
    return rs.upcoming_events(events(spark, sf), D("2024-02-01"))


@query("result_surprises", v.with_views("""
  select stock_code, ty event_type, title, event_date, bull with_research_support, case when ty = 'beat' and bull then 'confirmed beat' when ty = 'beat' then 'improving' when bull then 'disappointment risk' else 'under pressure' end signal from (
    select e.*, case when contains(title, 'growth') then 'beat' when contains(title, 'loss') then 'miss' end ty, b.code is not null bull from
      (select stock_code, max(event_date) event_date, arg_max(title, (event_date, title)) title from ev where event_date >= date '2024-02-10' group by 1) e
      left join (select distinct unnest(list_concat([stock_code], list_filter(target_stocks, lambda x: regexp_matches(x, '^[0-9]{6}$')))) code from reports where status = 'summarized' and report_date >= date '2024-01-11'
        and (contains(rating, 'buy') or sentiment = 'bullish')) b on b.code = e.stock_code)
  where ty is not null order by event_date desc, stock_code limit 12""", "reports", extra=EV))
def result_surprises(spark, sf):
    return rs.surprises(events(spark, sf), reps(spark, sf), D("2024-02-10"), 12, ("growth",), ("loss",), buy=("buy",))


@query("watch_pool", v.with_views("""
  select distinct code from (select stock_code code from reports where report_date >= date '2024-01-20' union all select unnest(list_filter(target_stocks, lambda x: regexp_matches(x, '^[0-9]{6}$'))) from reports where report_date >= date '2024-01-20'
    union all select lpad(cast(s_suppkey as varchar), 6, '0') from supplier where s_suppkey % 9 = 0 union all select '000777')""", "reports"))
def watch_pool(spark, sf):
    s = v.table(spark, sf, "supplier").where(F.col("s_suppkey") % 9 == 0)
    briefs = s.select(F.array(F.struct(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"))).alias("stocks"))
    prefs = spark.createDataFrame([("000777",), ("x",)], "code string")
    return rs.watch_pool(reps(spark, sf), D("2024-01-20"), briefs, prefs)


@query("disclosure_calendar", """
  select distinct code, event_date, case month(p) when 3 then 'Q1 report' when 6 then 'half-year report' when 9 then 'Q3 report' else 'annual report' end title, strftime(p, '%Y%m%d') end_date from (
    select lpad(cast(o_custkey as varchar), 6, '0') code, cast(last_day(date_trunc('quarter', o_orderdate) - interval 1 day) as date) p, cast(o_orderdate as date) + cast(o_orderkey % 90 as integer) event_date from orders)
  where p in (date '1998-12-31', date '1998-09-30') and event_date between date '1999-02-01' and date '1999-03-18'""")
def disclosure_calendar(spark, sf):
    o = v.table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    sched = o.select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("code"), F.date_format(F.date_sub(F.trunc(d, "quarter"), 1), "yyyyMMdd").alias("end_date"),
                     F.date_format(F.date_add(d, (F.col("o_orderkey") % 90).cast("int")), "yyyyMMdd").alias("pre_date"))
    pool = sched.select("code").distinct()
    return rs.disclosure_calendar(sched, pool, D("1999-02-01"))


@query("brief_picks", v.with_views("""
  select distinct date '2024-01-30' pick_date, code, current_price price_at_pick from (select lpad(cast(report_id % 60 as varchar), 6, '0') code from reports where report_date = date '2024-01-30' and report_id % 60 % 4 <> 0) left join px using (code)""", "reports", extra=PX))
def brief_picks(spark, sf):
    k = F.lpad((F.col("report_id") % 60).cast("string"), 6, "0")
    df = reps(spark, sf)
    briefs = df.groupBy(F.col("report_date").alias("brief_date")).agg(F.collect_set(F.struct(k.alias("code"))).alias("stocks"))
    stored = df.where(F.col("report_id") % 60 % 4 == 0).select(D("2024-01-30").alias("pick_date"), k.alias("code"))
    return rs.brief_picks(briefs, stored, prices(spark, sf))


@query("today_items", v.with_views("select report_id, 'newest report' reason from reports order by report_date desc, report_id desc limit 20", "reports"))
def today_items(spark, sf):
    recs = rs.recommendations(reps(spark, sf), D("2030-01-01"), [""], [""], 20)
    return rs.today_items(recs, reps(spark, sf))


@query("stock_risk_flags", v.with_views("select distinct stock_code code, price_change_20d, coalesce(price_change_20d <= -5, false) risk from reports left join ch on ch.code = stock_code", "reports",
                                        extra="ch as (select lpad(cast(s_suppkey % 50 as varchar), 6, '0') code, round(avg(s_acctbal) / 1000, 2) - 4 price_change_20d from supplier group by 1)"))
def stock_risk_flags(spark, sf):
    return rs.with_changes(reps(spark, sf).select(F.col("stock_code").alias("code")).distinct(), changes(spark, sf))


@query("source_stats", v.with_views("select source, coalesce(n, 0) report_count from (select distinct source from documents) left join (select institution source, count(*) n from reports group by 1) using (source)", "reports"))
def source_stats(spark, sf):
    src = v.table(spark, sf, "documents").select("source").distinct()
    return rs.source_stats(src, reps(spark, sf).withColumnRenamed("institution", "source"))


@query("research_view", v.with_views("""
  select stock_code, count(*) reports, count(*) filter (sentiment = 'bullish') bullish, count(*) filter (sentiment = 'neutral') neutral, count(*) filter (sentiment = 'bearish') bearish,
    list(report_id order by k)[1:4] newest, case when count(*) filter (sentiment = 'bullish') >= greatest(count(*) filter (sentiment = 'neutral'), count(*) filter (sentiment = 'bearish')) then 'bullish'
     when count(*) filter (sentiment = 'neutral') >= count(*) filter (sentiment = 'bearish') then 'neutral' else 'bearish' end lean
  from (select *, row_number() over (partition by stock_code order by report_date desc, report_id desc) k from reports where report_date >= date '2024-01-10') where k <= 8 group by 1""", "reports"))
def research_view(spark, sf):
    return rs.research_view(reps(spark, sf), D("2024-01-10"))


POS, NEG = ("the", "and", "le", "der"), ("of", "de", "die", "el")


@query("lexicon_sentiment", v.with_views(f"""
  select report_id, p positive_count, g negative_count, case when p + g = 0 then 0.0::double else (p - g) / (p + g) end sentiment_score, n word_count,
    least(1.0, case when len("text") between 50 and 1000 then 0.3 when len("text") > 1000 then 0.2 else 0 end + case when kw > 0 then least(0.5, kw * 0.1) else 0 end + case when contains("text", 'token') then 0.2 else 0 end)::double importance
  from (select report_id, "text", len(list_filter(w, lambda x: x in {POS})) p, len(list_filter(w, lambda x: x in {NEG})) g, len(list_filter(w, lambda x: contains(x, 'tion'))) kw, len(w) n from (
    select *, list_filter(regexp_split_to_array("text", '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w from reports))""", "reports"))
def lexicon_sentiment(spark, sf):
    out = rs.lexicon_sentiment(reps(spark, sf), "text", POS, NEG, {"form": ("tion",)}, ("token",))
    return out.select("report_id", *[F.col(c).cast("long").alias(c) for c in ("positive_count", "negative_count", "word_count")], "sentiment_score", F.round("importance", 6).alias("importance"))


DENSE = "replace(replace(lower(\"text\"), ' ', ''), '.', '行')"


@query("lexicon_unsegmented", v.with_views(f"""
  select report_id, len(regexp_extract_all(t, 'x行|行')) positive_count, len(regexp_extract_all(t, '行d')) negative_count from (select report_id, {DENSE} t from reports)""", "reports"))
def lexicon_unsegmented(spark, sf):
    """Words of a script without blanks, counted in text without blanks."""
    text = F.replace(F.replace(F.lower("text"), F.lit(" "), F.lit("")), F.lit("."), F.lit("行"))
    out = rs.lexicon_sentiment(reps(spark, sf).withColumn("dense", text), "dense", ("行", "x行"), ("行d",), {}, ("token",))
    return out.select("report_id", *[F.col(c).cast("long").alias(c) for c in ("positive_count", "negative_count")])


@query("number_provenance", r"""
  select doc_id, list_sort(list_distinct(list_concat(list_filter(toks, lambda t: not (not contains(t, '.') and try_cast(t as double) between 2010 and 2029)
      and not contains(ctx, t) and len(list_filter([-1, 0, 1], lambda k: contains(ctx, cast(try_cast(split_part(t, '.', 1) as decimal(38,0)) + k as varchar)))) = 0),
    list_filter(fine, lambda t: not contains(ctx, t))))) flagged from (
    select a.doc_id, regexp_extract_all(a."text", '\d+(?:\.\d+)?') toks, regexp_extract_all(a."text", '\d+\.\d{3,}') fine, b."text" ctx from documents a join documents b on b.doc_id = a.doc_id + 1)""")
def number_provenance(spark, sf):
    d = v.table(spark, sf, "documents")
    ctx = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("ctx"))
    j = d.join(ctx, "doc_id")
    return j.select("doc_id", F.array_sort(rs.unverifiable_numbers(F.col("text"), F.col("ctx"))).alias("flagged"))


@query("common_tags", v.with_views("select item, count(*) count from (select unnest(tags) item from reports) group by 1 order by count desc, item limit 10", "reports"))
def common_tags(spark, sf):
    return rs.most_common(reps(spark, sf), "tags", 10)


FC = """fc as (select lpad(cast(l_suppkey as varchar), 6, '0') stock_code, 2024 + l_linenumber % 3 forecast_year, case when l_linenumber = 7 then 0.0::double else round(l_quantity * (1 + l_tax), 2) end profit_value, l_discount eps_value, l_orderkey, l_linenumber from lineitem)"""


@query("forecast_consensus", v.with_views("""
  with t as (select * from fc where forecast_year >= 2025), nz as (select * from t where profit_value <> 0),
  md as (select stock_code, list_sort(list(profit_value))[count(*) // 2 + 1] med from nz group by 1),
  s as (select stock_code, avg(profit_value) a, min(profit_value) lo, max(profit_value) hi from nz join md using (stock_code) where profit_value between med / 10 and med * 10 group by 1),
  yc as (select stock_code, forecast_year, row_number() over (partition by stock_code order by count(*) desc, forecast_year) k from t group by 1, 2),
  n as (select stock_code, count(*) forecast_count, avg(eps_value) filter (eps_value <> 0) eps from t group by 1)
  select stock_code, forecast_count, forecast_year, round(a, 2) avg_profit, round(lo, 2) min_profit, round(hi, 2) max_profit, round((hi - lo) / a * 100, 1) dispersion, round(eps, 2) avg_eps
  from n join s using (stock_code) join yc using (stock_code) where k = 1 and forecast_count >= 3 order by dispersion, forecast_count desc, stock_code limit 16""".replace("with t as", "select * from (with t as") + ")", extra=FC))
def forecast_consensus(spark, sf):
    li = v.table(spark, sf, "lineitem")
    f = li.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"), (2024 + F.col("l_linenumber") % 3).alias("forecast_year"),
                  F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.round(F.col("l_quantity") * (1 + F.col("l_tax")), 2)).alias("profit_value"), F.col("l_discount").alias("eps_value"))
    return rs.forecast_consensus(f, 2025)


@query("report_page", v.with_views("select report_id, report_date, institution from reports where institution ilike '%rc1%' and sentiment = 'bullish' order by report_date desc, report_id desc limit 10 offset 5", "reports"))
def report_page(spark, sf):
    page, _ = rs.list_reports(reps(spark, sf), "RC1", "bullish", limit=10, offset=5)
    return page.select("report_id", "report_date", "institution")


@query("report_total", v.with_views("select count(*) total from reports where institution ilike '%rc1%'", "reports"))
def report_total(spark, sf):
    return rs.list_reports(reps(spark, sf), "rc1")[1]


@query("purged_reports", v.with_views("select report_id from reports where report_date >= date '2024-01-20' or sentiment = 'bullish'", "reports"))
def purged_reports(spark, sf):
    df = reps(spark, sf)
    return rs.purge(df, df.where("sentiment = 'bullish'"), D("2024-01-20")).select("report_id")


# ---- portfolio -----------------------------------------------------------------------

FOLD = """vt as (select * replace (case when side = 'BUY' then shares // 100 * 100 else shares end as shares) from trades),
li as (select account, code, list({'b': side = 'BUY', 'q': cast(case when side = 'CLOSE' then 1000000000000 else shares end as double), 'p': price, 's': 0.0::double, 'c': 0.0::double, 'r': 0.0::double, 'a': 0.0::double} order by seq) l, count(*) n from vt group by 1, 2),
fo as (select account, code, list_reduce(list_concat([{'b': true, 'q': 0.0::double, 'p': 0.0::double, 's': 0.0::double, 'c': 0.0::double, 'r': 0.0::double, 'a': 0.0::double}], l), lambda z, x:
  case when x.b then {'b': x.b, 'q': x.q, 'p': x.p, 's': z.s + x.q, 'c': z.c + round(x.p * x.q, 2), 'r': z.r, 'a': (z.c + round(x.p * x.q, 2)) / (z.s + x.q)}
  when z.s = 0 then z else {'b': x.b, 'q': x.q, 'p': x.p, 's': greatest(z.s - x.q, 0), 'c': z.c / z.s * greatest(z.s - x.q, 0), 'r': z.r + (x.p - z.c / z.s) * least(x.q, z.s), 'a': z.a} end) f from li)"""


def ledger(spark, sf):
    t = v.trades(spark, sf)
    return t, F.floor(F.col("seq") / 2000), ranks.widest_group(t, ["account", "code"])


@query("ledger_holdings", v.with_views("""
  select account, code, cast(f.s as bigint) shares, round(f.a, 3) avg_cost, round(f.c, 1) + 0.0::double cost_amount, round(f.r, 0) + 0.0::double realized_pnl, case when f.s > 0 then 'holding' else 'closed' end status from fo""", "trades", extra=FOLD))
def ledger_holdings(spark, sf):
    h = pf.holdings(*ledger(spark, sf))
    d = lambda c, p: (F.round(F.col(c).cast("double"), p) + F.lit(0.0)).alias(c)
    return h.select("account", "code", "shares", d("avg_cost", 3), d("cost_amount", 1), d("realized_pnl", 0), "status")


MTM = FOLD + """, cl as (select code, arg_max(price, seq) px from trades group by 1),
mk as (select code, cast(f.s as bigint) shares, px current_price, round(px * f.s, 2) market_value, round(round(f.a, 4), 4) ac from fo join cl using (code) where f.s > 0),
mm as (select *, round((current_price - ac) / ac * 100, 2) + 0.0::double pnl_pct from mk)"""


def marked(spark, sf):
    t, b, n = ledger(spark, sf)
    closes = t.groupBy("code").agg(F.max_by("price", "seq").alias("close"))
    return pf.mark_to_market(pf.holdings(t, b, n), closes, 1e7)


@query("ledger_holdings_split", v.with_views("select code, cast(f.s as bigint) shares, round(f.a, 3) avg_cost, round(f.r, 0) + 0.0::double realized_pnl from fo", "trades", extra=FOLD))
def ledger_holdings_split(spark, sf):
    """The same replay through (key, bucket) cells, the plan for very long ledgers."""
    t, b, _ = ledger(spark, sf)
    d = lambda c, p: (F.round(F.col(c).cast("double"), p) + F.lit(0.0)).alias(c)
    return pf.holdings(t, b).select("code", "shares", d("avg_cost", 3), d("realized_pnl", 0))


@query("mark_to_market", v.with_views("select code, shares, current_price, market_value, pnl_pct from mm", "trades", extra=MTM))
def mark_to_market(spark, sf):
    return rounded(marked(spark, sf).select("code", "shares", "current_price", "market_value", "pnl_pct"), 2)


@query("exposure_advice", v.with_views("""
  select round(sum(market_value), 2) total_mv, round(sum(market_value) / 1e7 * 100, 2) held_pct, case when sum(market_value) > 5e6 * 1.2 then 'reduce' when sum(market_value) < 5e6 * 0.8 then 'add' else 'match' end advice,
    count(*) filter (pnl_pct <= -8) deep_losses from mm""", "trades", extra=MTM))
def exposure_advice(spark, sf):
    return rounded(pf.exposure_advice(marked(spark, sf), 1e7, 0.5), 2)


POSN = """ps as (select lpad(cast(l_suppkey as varchar), 6, '0') code, cast(min(l_shipdate) as date) d0 from lineitem group by 1),
pp as (select ts_code code, min(trade_date) filter (trade_date >= date '2001-09-01') buy_date, arg_min("close", trade_date) filter (trade_date >= date '2001-09-01') buy_price from panel_l group by 1),
pk as (select code, any_value(buy_date) buy_date, any_value(buy_price) buy_price, greatest(any_value(buy_price), max("close")) peak_price, arg_max("close", trade_date) px from pp p join panel_l l on l.ts_code = p.code and l.trade_date >= buy_date group by code),
xs as (select *, px / buy_price - 1 pnl, date '2001-11-05' - buy_date hd, (greatest(peak_price, px) - px) / greatest(peak_price, px) dn, px * 1.005::double ma, 80.0 - cast(code as integer) % 31 ai, 70.0 - cast(code as integer) % 23 sc, (cast(code as integer) % 8) / 100 vo from pk),
xx as (select *, case when pnl <= -0.08 then 'fixed stop' when hd >= 10 and pnl <= -0.02 then 'time stop' when pnl >= 0.2 then 'fixed profit' when peak_price > buy_price * 1.05 and dn >= 0.12 then 'trailing stop'
   when px < ma * 0.99 then 'below ma20' when 80 - ai >= 25 then 'ai score drop' when 70 - sc >= 20 then 'score drop' when vo >= 0.055 then 'high volatility' when hd >= 5 and pnl < 0.01 then 'idle money' end rule,
   array_to_string(list_filter([case when pnl <= -0.05 then 'near stop' end, case when px < ma * 1.02 and px > ma * 0.99 then 'near ma20' end, case when hd >= 3 and pnl < 0 then 'still losing' end], lambda x: x is not null), '; ') notes from xs),
xr as (select code, round(pnl * 100, 2) + 0.0::double pnl_pct, hd hold_days, case when rule in ('fixed stop', 'time stop') then 'HARD_STOP' when rule in ('fixed profit', 'trailing stop') then 'TAKE_PROFIT' when rule is not null then 'SOFT_STOP' when notes <> '' then 'WATCH' else 'HOLD' end signal,
   coalesce(rule, notes) reason from xx)"""


def scanned(spark, sf):
    p = v.panel_l(spark, sf)
    late = p.where(F.col("trade_date") >= D("2001-09-01"))
    pos = late.groupBy(F.col("ts_code").alias("code")).agg(F.min("trade_date").alias("buy_date"), F.min_by("close", "trade_date").alias("buy_price"), F.max_by("close", "trade_date").alias("close"))
    pos = pf.peak_since(pos, p.select(F.col("ts_code").alias("code"), "trade_date", "close"))
    n = F.col("code").cast("int")
    pos = pos.withColumns({"ma20": F.col("close") * 1.005, "ai_score": 80.0 - n % 31, "buy_ai_score": F.lit(80.0), "score": 70.0 - n % 23, "buy_score": F.lit(70.0), "volatility": (n % 8) / 100})
    return pf.exit_scan(pos, D("2001-11-05"))


@query("exit_scan", v.with_views("select code, pnl_pct, hold_days, signal, reason from xr", "panel_l", extra=POSN))
def exit_scan(spark, sf):
    return rounded(scanned(spark, sf).select("code", "pnl_pct", F.col("hold_days").cast("long").alias("hold_days"), "signal", "reason"), 2)


@query("exit_summary", v.with_views("""
  select count(*) total_positions, count(*) filter (signal = 'HARD_STOP') hard_stop_count, count(*) filter (signal = 'TAKE_PROFIT') take_profit_count, count(*) filter (signal = 'SOFT_STOP') soft_stop_count,
    count(*) filter (signal = 'WATCH') watch_count, count(*) filter (signal = 'HOLD') clean_count, count(*) filter (signal in ('HARD_STOP', 'TAKE_PROFIT')) > 0 action_required from xr""", "panel_l", extra=POSN))
def exit_summary(spark, sf):
    return pf.exit_summary(scanned(spark, sf))


@query("aligned_signals", v.with_views("""
  with h as (select lpad(cast(s_suppkey as varchar), 6, '0') code, case when s_suppkey % 4 = 0 then '' else n_name end ind0 from supplier join nation on s_nationkey = n_nationkey),
  pk as (select lpad(cast(c_custkey as varchar), 6, '0') code, case when c_custkey % 2 = 0 then 'trend' else 'bottom' end bucket, c_acctbal buy_score, c_mktsegment industry from customer),
  nf as (select n_name, round(avg(main_force_net), 2) + 0.0::double f from sector_flow join nation on n_name = sector_name group by 1),
  j as (select h.code, coalesce(nullif(ind0, ''), pk.industry, '') industry, bucket, buy_score from h left join pk using (code))
  select code, industry, bucket, buy_score, p_up sector_p_up, coalesce(nf.f, nf2.f) industry_net from j left join (select n_name ind, r_name broad from nation join region on n_regionkey = r_regionkey) m on m.ind = industry
  left join (select r_name sector, r_regionkey / 10.0::double p_up from region) s on s.sector = coalesce(broad, industry) left join nf on nf.n_name = industry left join nf nf2 on nf2.n_name = coalesce(broad, industry)""".replace("with h as", "select * from (with h as") + ")", "sector_flow"))
def aligned_signals(spark, sf):
    sup, nat, reg, cus = (v.table(spark, sf, t) for t in ("supplier", "nation", "region", "customer"))
    h = sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("industry"))
    picks = cus.select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("code"), F.when(F.col("c_custkey") % 2 == 0, "trend").otherwise("bottom").alias("bucket"),
                       F.col("c_acctbal").alias("buy_score"), F.col("c_mktsegment").alias("industry"), F.lit(0).alias("priority"))
    imap = nat.join(reg, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("industry"), F.col("r_name").alias("broad"))
    fc = reg.select(F.col("r_name").alias("sector"), (F.col("r_regionkey") / 10.0).alias("p_up"))
    fl = v.sector_flow(spark, sf).groupBy("sector_name").agg((F.round(F.avg("main_force_net"), 2) + F.lit(0.0)).alias("main_force_net"))
    return pf.align_signals(h, picks, fc, fl, imap)


@query("stock_profiles", """
  select lpad(cast(s_suppkey as varchar), 6, '0') code, n.n quote_n, n.q quote_max, o.c cust_bal from supplier left join (select l_suppkey k, count(*) n, max(l_quantity) q from lineitem group by 1) n on n.k = s_suppkey
  left join (select c_custkey k, c_acctbal c from customer) o on o.k = s_suppkey""")
def stock_profiles(spark, sf):
    code = lambda c: F.lpad(F.col(c).cast("string"), 6, "0").alias("code")
    quote = v.table(spark, sf, "lineitem").groupBy(code("l_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    bal = v.table(spark, sf, "customer").select(code("c_custkey"), F.col("c_acctbal").alias("c"))
    out = pf.profile(v.table(spark, sf, "supplier").select(code("s_suppkey")), {"quote": quote, "account": bal}, market=v.table(spark, sf, "region").select("r_name"))
    return out.select("code", F.col("quote.n").alias("quote_n"), F.col("quote.q").alias("quote_max"), F.col("account.c").alias("cust_bal"))


# ---- macro ---------------------------------------------------------------------------

SW = 'over (partition by series_name order by obs_date)'


def chg(n):
    return f'round(("value" - lag("value", {n}) {SW}) / lag("value", {n}) {SW} * 100, 2) + 0.0::double'


LATEST = f"""c0 as (select * exclude (n_obs), {', '.join(f'{chg(n)} chg_{n}' for n in (1, 5, 20, 60))}, count(*) over (partition by series_name) n_obs, row_number() over (partition by series_name order by obs_date desc) b from series_r),
lt as (select * from c0 where b = 1)"""


def ser(spark, sf):
    return v.series_r(spark, sf)


@query("series_changes", v.with_views('select series_name, n_obs, "value" last, chg_1, chg_5, chg_20, chg_60 from lt', "series_r", extra=LATEST))
def series_changes(spark, sf):
    return rounded(ma.latest_changes(ser(spark, sf)), 2)


HEAT = "case when {0} >= 5 then 3 when {0} >= 1.5 then 2 when {0} >= 0.15 then 1 when {0} <= -5 then -3 when {0} <= -1.5 then -2 when {0} <= -0.15 then -1 else 0 end"
PCT = LATEST + f""", p0 as (select series_name, obs_date, ("value" / lag("value", 20) {SW} - 1) * 100 c from series_r),
pr as (select p0.series_name, case when count(*) >= 60 then cast(round(avg(case when c <= nw then 1.0::double when c is not null then 0.0::double end) * 100) as integer) end pct_rank from p0 join (select series_name, arg_max(c, obs_date) nw from p0 group by 1) using (series_name) group by 1),
sp as (select series_name, list(round(18 - ("value" - lo) / (hi - lo) * 18, 1) order by obs_date) spark from (select *, min("value") over (partition by series_name) lo, max("value") over (partition by series_name) hi from c0 where b <= 20) group by 1)"""


@query("asset_heat", v.with_views(
    f'select series_name, n_obs, "value" last, chg_1, chg_5, chg_20, chg_60, pct_rank, spark, {HEAT.format("chg_20")} heat_20, {HEAT.format("chg_1")} heat_1 from lt join pr using (series_name) join sp using (series_name)', "series_r", extra=PCT))
def asset_heat(spark, sf):
    return ma.asset_heat(ser(spark, sf))


def npct(c, span=3):
    return f"greatest(-1, least(1, coalesce({c}, 0) / {span}))"


@query("risk_appetite", v.with_views(f"""
  select s score, case when s >= 65 then 'risk on' when s <= 35 then 'risk off' else 'mixed' end label from (select cast(round(((({npct('a.chg_20')} + {npct('b.chg_20')}) / 2 * 0.4 - {npct('c.chg_5', 1)} * 0.25
    + greatest(-1, least(1, {npct('e.chg_20')} - {npct('d.chg_20')})) * 0.15) / 0.8 + 1) / 2 * 100) as integer) s from lt a, lt b, lt c, lt d, lt e
    where a.series_name = 'AFRICA' and b.series_name = 'AMERICA' and c.series_name = 'ASIA' and d.series_name = 'EUROPE' and e.series_name = 'MIDDLE EAST')""", "series_r", extra=LATEST))
def risk_appetite(spark, sf):
    w = ma.wide(ma.latest_changes(ser(spark, sf)), {"eq1": "AFRICA", "eq2": "AMERICA", "dollar": "ASIA", "gold": "EUROPE", "oil": "MIDDLE EAST"})
    return ma.risk_appetite(w, ["eq1", "eq2"])


@query("realized_volatility", v.with_views(
    f"""select series_name, round(arg_max(sd, obs_date) * sqrt(252) * 100, 2) realized_vol from (select *, stddev_samp(r) over (partition by series_name order by obs_date rows between 19 preceding and current row) sd from
      (select *, "value" / lag("value") {SW} - 1 r from series_r)) group by 1""", "series_r"))
def realized_volatility(spark, sf):
    return ma.realized_vol(ser(spark, sf))


@query("fear_greed", v.with_views("""
  select s score, case when s >= 80 then 'extreme greed' when s >= 60 then 'greed' when s <= 20 then 'extreme fear' when s <= 40 then 'fear' else 'neutral' end label from (
    select cast(round(((greatest(-1, least(1, (22 - rv) / 10)) * 0.4 + greatest(-1, least(1, mc / 1.5)) * 0.2 + (up - dn) / (up + dn) * 0.2 + greatest(-1, least(1, ic / 3)) * 0.2) / 1.0 + 1) / 2 * 100) as integer) s from (
      select 18.0::double rv, (select chg_5 from lt where series_name = 'ASIA') mc, (select count(*) filter (net_flow > 0) from panel_e) up, (select count(*) filter (net_flow < 0) from panel_e) dn, (select chg_20 from lt where series_name = 'EUROPE') ic))""",
    "series_r", "panel_e", extra=LATEST))
def fear_greed(spark, sf):
    w = ma.wide(ma.latest_changes(ser(spark, sf)), {"m": "ASIA", "i": "EUROPE"})
    b = v.panel_e(spark, sf).agg(F.struct(F.count_if(F.col("net_flow") > 0).alias("up"), F.count_if(F.col("net_flow") < 0).alias("down")).alias("b"))
    nul = F.lit(None).cast("double")
    row = w.withColumn("b", b.scalar()).select(nul.alias("vix_last"), nul.alias("vix_ma20"), F.lit(0).alias("vix_n"), F.lit(18.0).alias("realized_vol"), F.col("m.chg_5").alias("margin_chg5"), "b.up", "b.down", F.col("i.chg_20").alias("index_chg20"))
    return ma.fear_greed(row)


DIR = f"""dr as (select series_name, arg_max(case when n >= 6 and (a - b) / abs(b) > 0.002 then 1 when n >= 6 and (a - b) / abs(b) < -0.002 then -1 else 0 end, obs_date) d, arg_max("value", obs_date) v from (select *, avg("value") over (partition by series_name order by obs_date rows between 2 preceding and current row) a,
  avg("value") over (partition by series_name order by obs_date rows between 5 preceding and 3 preceding) b, count(*) over (partition by series_name order by obs_date rows between 5 preceding and current row) n from series_r) group by 1)"""
QUAD = "case when g = 1 and i = 1 then 'overheat' when g = 1 and i = -1 then 'recovery' when g = -1 and i = 1 then 'stagflation' when g = -1 and i = -1 then 'reflation' when g >= 0 then 'recovery' else 'reflation' end"


@query("series_direction", v.with_views('select series_name, d direction, v last from dr', "series_r", extra=DIR))
def series_direction(spark, sf):
    return ma.direction(ser(spark, sf)).select("series_name", "direction", "last")


@query("macro_clock", v.with_views(f"""select g growth_axis, i inflation_axis, {QUAD} quadrant from (select case when (select v from dr where series_name = 'ASIA') >= 250000 and gd >= 0 then 1 when gd < 0 then -1 when gd > 0 then 1 else 0 end g, i from (
  select (select d from dr where series_name = 'ASIA') gd, (select d from dr where series_name = 'EUROPE') i))""", "series_r", extra=DIR))
def macro_clock(spark, sf):
    return ma.clock_macro(ser(spark, sf), "ASIA", "EUROPE", 250000.0)


@query("market_clock", v.with_views(f"""select g growth_axis, i inflation_axis, {QUAD} quadrant from (select case when coalesce(a.chg_60, 0) > 1 then 1 when coalesce(a.chg_60, 0) < -1 then -1 else 0 end g,
  case when ({npct('b.chg_20')} + {npct('c.chg_20')}) / 2 > 0.15 then 1 when ({npct('b.chg_20')} + {npct('c.chg_20')}) / 2 < -0.15 then -1 else 0 end i from lt a, lt b, lt c where a.series_name = 'AMERICA' and b.series_name = 'ASIA' and c.series_name = 'AFRICA')""", "series_r", extra=LATEST))
def market_clock(spark, sf):
    return ma.clock_market(ma.latest_changes(ser(spark, sf)), "AMERICA", ("ASIA", "AFRICA"))


def trd(c, t):
    return f"case when {c} > {t} then 1 when {c} < -{t} then -1 else 0 end"


@query("transmission_chains", v.with_views(f"""select 'dollar' chain, (select {trd('chg_20', 1.0)} from lt where series_name = 'ASIA') state union all select 'commodity', coalesce((select nullif({trd('chg_20', 50.0)}, 0) from lt where series_name = 'EUROPE'), (select nullif({trd('chg_20', 3.0)}, 0) from lt where series_name = 'AFRICA'), 0)""", "series_r", extra=LATEST))
def transmission_chains(spark, sf):
    return ma.transmission(ma.latest_changes(ser(spark, sf)), [("dollar", [("ASIA", 1.0)]), ("commodity", [("EUROPE", 50.0), ("AFRICA", 3.0)])])


@query("theme_directions", v.with_views(f"""
  with ru as (select r_name series_name, g.w want, 'NATION_' || r_regionkey theme, 1.0::double + r_regionkey weight, 'rule ' || r_regionkey reason from region cross join (values (1), (-1), (0)) g(w)),
  hi as (select theme direction, round(sum(weight), 1) score, [min(reason)] reasons from ru join (select series_name, {trd('chg_20', 1.0)} want from lt) using (series_name, want) group by 1)
  select direction, score, reasons, (select min(sector_name) from sector_flow where contains(direction, sector_name) or contains(sector_name, direction)) flow_hit, cast(null as varchar) research_hit, cast(0 as bigint) research_count,
    cast(1 as integer) confirms, 'medium' as level from hi order by score desc, direction limit 8""".replace("with ru as", "select * from (with ru as") + ")", "series_r", "sector_flow", extra=LATEST))
def theme_directions(spark, sf):
    k = F.col("r_regionkey")
    reg = v.table(spark, sf, "region")
    rules = reg.select(F.col("r_name").alias("series_name"), F.explode(F.array(F.lit(1), F.lit(-1), F.lit(0))).alias("want"), F.array(F.concat(F.lit("NATION_"), k.cast("string"))).alias("themes"),
                       (1.0 + k).alias("weight"), F.concat(F.lit("rule "), k.cast("string")).alias("reason"), k.alias("rule_id"))
    tags = v.table(spark, sf, "region").groupBy(F.concat(F.lit("tag"), k.cast("string")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return ma.theme_directions(ma.latest_changes(ser(spark, sf)), rules, v.sector_flow(spark, sf), tags)


@query("direction_compass", """
  select round(least(100, greatest(0, m * 40 + sp * 0.3 + cy * 0.15 + ad * 15))) score, case when round(m * 40 + sp * 0.3 + cy * 0.15 + ad * 15) >= 58 then 'bullish' when round(m * 40 + sp * 0.3 + cy * 0.15 + ad * 15) <= 42 then 'bearish' else 'neutral' end label
  from (select count(*) filter (o_orderstatus = 'O') / count(*) m, count(*) filter (o_orderstatus = 'F') * 100 / count(*) sp, 30.0 cy, count(*) filter (o_orderpriority = '1-URGENT') / count(*) ad from orders)""")
def direction_compass(spark, sf):
    o = v.table(spark, sf, "orders")
    share = lambda c: F.avg(c.cast("double"))
    row = o.agg(share(F.col("o_orderstatus") == "O").alias("model_p"), (share(F.col("o_orderstatus") == "F") * 100).alias("state_p"), share(F.col("o_orderpriority") == "1-URGENT").alias("adviser_p"))
    row = row.withColumns({"selective": F.lit(True), "cycle_score": F.lit(85.0), "cycle_position": F.lit(0.5)})
    return ma.compass(row).select("score", "label")


@query("history_tail", v.with_views('select obs_date, "value" from series_d order by obs_date desc limit 260', "series_d"))
def history_tail(spark, sf):
    return ma.history_tail(v.series_d(spark, sf).select("obs_date", "value"), "obs_date")


@query("known_macro", v.with_views("""
  select trade_date, series_name, obs_date known_month, "value" from (select distinct cast(o_orderdate as date) trade_date from orders) d cross join (select distinct series_name from series_r) s asof join series_r r using (series_name) where false""".replace("asof join series_r r using (series_name) where false", "cross join lateral (select obs_date, \"value\" from series_r r where r.series_name = s.series_name and r.obs_date < date_trunc('month', d.trade_date) and month(r.obs_date) % 3 <> 0 order by obs_date desc limit 1) x"), "series_r"))
def known_macro(spark, sf):
    days = v.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("trade_date")).distinct()
    macro = ser(spark, sf).where(F.month("obs_date") % 3 != 0).select("series_name", F.col("obs_date").alias("month"), "value")
    return ma.known_macro(days, macro).select("trade_date", "series_name", "known_month", "value")


@query("complete_dates", """
  select cast(l_shipdate as date) d, sum(l_quantity) qty from lineitem group by 1 having count(distinct l_returnflag) >= 3""")
def complete_dates(spark, sf):
    li = v.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_returnflag", F.col("l_quantity").alias("qty"))
    return ma.complete_dates(li, "d", "l_returnflag", "qty", 3)
