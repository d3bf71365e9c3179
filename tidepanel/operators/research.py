"""Research-corpus analytics: extraction from whole texts, consensus, scoring, events.

Reports: report_id, title, stock_code, stock_name, institution, report_date, text, status;
summaries: tags, target_stocks (arrays), sentiment, rating, target_price. Pattern lists and
word lists are parameters; the defaults are for Chinese reports.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import ranks

# Extraction patterns, tried in order.
TARGET_PRICE_PATTERNS = (
    r"目标价[为：:\s]*([0-9]+(?:\.[0-9]+)?)\s*元",
    r"目标价格[为：:\s]*([0-9]+(?:\.[0-9]+)?)\s*元",
    r"目标市值[为：:\s]*([0-9]+(?:\.[0-9]+)?)\s*亿",
    r"给予目标价([0-9]+(?:\.[0-9]+)?)\s*元",
    r"A股目标价([0-9]+(?:\.[0-9]+)?)\s*元",
    r"合理价值[为：:\s]*([0-9]+(?:\.[0-9]+)?)\s*元",
    r"合理估值[为：:\s]*([0-9]+(?:\.[0-9]+)?)\s*元",
)
# (pattern, year group or 0, value group)
PROFIT_PATTERNS = (
    (r"(20\d{2})\s*[-/—~]\s*(20\d{2})\s*年[^。；]{0,40}?净利润[^0-9]{0,8}([0-9]+\.?[0-9]*)", 1, 3),
    (r"(20\d{2})\s*年[^。；，,]{0,30}?归母净利润[^0-9]{0,8}([0-9]+\.?[0-9]*)\s*亿", 1, 2),
    (r"(20\d{2})\s*年[^。；，,]{0,30}?净利润[^0-9]{0,8}([0-9]+\.?[0-9]*)\s*亿", 1, 2),
    (r"归母净利润[^0-9]{0,10}([0-9]+\.?[0-9]*)\s*亿", 0, 1),
    (r"净利润[^0-9]{0,10}([0-9]+\.?[0-9]*)\s*亿", 0, 1),
    (r"预计[^。；，,]{0,25}?盈利[^0-9]{0,8}([0-9]+\.?[0-9]*)\s*亿", 0, 1),
)
EPS_PATTERNS = (
    (r"(20\d{2})\s*年[^。；，,]{0,25}?EPS[^0-9]{0,6}([0-9]+\.?[0-9]*)\s*元", 1, 2),
    (r"(20\d{2})\s*年[^。；，,]{0,25}?每股收益[^0-9]{0,6}([0-9]+\.?[0-9]*)\s*元", 1, 2),
    (r"EPS[^0-9]{0,6}([0-9]+\.?[0-9]*)\s*元", 0, 1),
    (r"每股收益[^0-9]{0,6}([0-9]+\.?[0-9]*)\s*元", 0, 1),
)
# (pattern with year, month, day groups, event type)
EVENT_PATTERNS = (
    (r"股东大会[于在]?(20\d{2})[年/-](\d{1,2})[月/-](\d{1,2})", "股东大会"),
    (r"解禁[于在]?(20\d{2})[年/-](\d{1,2})[月/-](\d{1,2})", "解禁"),
    (r"(20\d{2})[年/-](\d{1,2})[月/-](\d{1,2})[日号]?[^。；]{0,20}?(?:发布|披露|公布)(?:年报|中报|季报|财报)", "财报披露"),
    (r"(?:年报|中报|季报|财报)[^。；]{0,15}?(20\d{2})[年/-](\d{1,2})[月/-](\d{1,2})", "财报披露"),
)
#: Fixed values.
TITLE_NAME_PATTERNS = ((r"[-—]([一-龥A-Za-z]{2,8})[-—](\d{6})[-—]", 1, 2), (r"([一-龥A-Za-z]{2,8})[（(](\d{6})[)）]", 1, 2))
#: Fixed values.
TIER_ONE = (
    "中信证券", "中金公司", "中金", "华泰证券", "国泰君安", "招商证券", "广发证券", "申万宏源", "海通证券", "兴业证券",
    "国信证券", "中信建投", "东吴证券", "国金证券", "光大证券", "平安证券", "银河证券", "东方证券", "方正证券", "中泰证券",
    "长江证券", "安信证券", "财通证券", "浙商证券", "国盛证券", "华西证券", "西南证券", "民生证券", "天风证券", "东兴证券",
)
#: Fixed values.
HOUSE_WORDS = ("证券", "基金", "期货")
BUY_WORDS, UPGRADE_WORDS, FIRST_WORDS = ("买入", "增持"), ("上调",), ("首次",)
#: Fixed values.
BEAT_WORDS = ("预增", "略增", "扭亏", "减亏", "续盈")
MISS_WORDS = ("预减", "略减", "首亏", "续亏")
#: Fixed values.
POSITIVE_WORDS = (
    "增长", "上涨", "盈利", "利好", "大涨", "突破", "新高", "超预期", "强劲", "改善", "扭亏", "扭亏为盈", "龙头", "领先", "优势",
    "技术突破", "创新", "研发成功", "利好政策", "支持", "鼓励", "扶持", "补贴", "减税", "看好", "推荐", "买入", "增持", "跑赢",
    "优于大盘", "中标", "获得订单", "签约", "合作", "重组", "收购", "放量", "主力进场", "底部", "反弹", "启动", "拉升", "连板",
    "涨停", "量增价升", "政策利好",
)
#: Fixed values.
NEGATIVE_WORDS = (
    "下降", "下跌", "亏损", "利空", "暴跌", "跌破", "新低", "不及预期", "疲软", "恶化", "预亏", "风险", "违规", "处罚", "调查",
    "停牌", "退市", "诉讼", "赔偿", "索赔", "看空", "卖出", "减持", "跑输", "劣于大盘", "失败", "终止", "解除合作", "违约", "破产",
    "出逃", "割肉", "套牢", "崩盘", "闪崩", "连续下跌", "跌停", "量增价跌", "主力出货", "骗局",
)
#: Fixed values.
KEYWORDS = {
    "performance": ("营收", "净利润", "利润", "业绩", "收入", "ROE", "EPS"), "industry": ("行业", "板块", "赛道", "市场份额", "竞争"),
    "policy": ("政策", "法规", "监管", "改革"), "technology": ("技术", "研发", "专利", "创新", "AI", "5G"),
    "finance": ("融资", "并购", "重组", "定增", "回购"), "risk": ("风险", "诉讼", "处罚", "违规", "调查"),
}
#: Fixed values.
URGENT_WORDS = ("公告", "重大", "业绩", "预告", "涨停", "暴涨", "暴跌")


def _any_word(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.coalesce(text.contains(w), F.lit(False))
    return hit


def clean(text: Column, limit: int | None = None) -> Column:
    """Collapse white space; optionally cut for display."""
    c = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.substring(c, 1, limit) if limit else c


def target_price(text: Column, patterns: Sequence[str] = TARGET_PRICE_PATTERNS) -> Column:
    """First pattern that matches anywhere in the text."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def _numbered(k: int):
    def shape(z: Column, i: Column) -> Column:
        return F.struct(F.lit(k).alias("p"), i.alias("i"), z["y"].try_cast("int").alias("year"),
                        z["v"].try_cast("double").alias("value"), z["t"].alias("text"))

    return shape


def _dated(k: int, kind: str):
    def shape(z: Column) -> Column:
        day = F.concat_ws("-", z["y"], F.lpad(z["m"], 2, "0"), F.lpad(z["d"], 2, "0"))
        return F.struct(F.lit(k).alias("p"), F.lit(kind).alias("event_type"), F.try_to_date(day, "yyyy-MM-dd").alias("event_date"),
                        z["w"].alias("detail"))

    return shape


def _has_word(words: Sequence[str]):
    return lambda w: _any_word(w, words)


def _all_matches(text: Column, patterns, low: float, high: float) -> Column:
    """Array of (p, i, year, value, text) over all patterns, in pattern then text order."""
    parts = []
    for k, (p, year, value) in enumerate(patterns):
        vals = F.regexp_extract_all(text, F.lit(p), F.lit(value))
        years = F.regexp_extract_all(text, F.lit(p), F.lit(year)) if year else F.transform(vals, lambda x: F.lit(None).cast("string"))
        whole = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        packed = F.zip_with(F.zip_with(vals, years, lambda v, y: F.struct(v.alias("v"), y.alias("y"))), whole, lambda z, t: F.struct(z["v"].alias("v"), z["y"].alias("y"), t.alias("t")))
        parts.append(F.transform(packed, _numbered(k)))
    return F.filter(F.flatten(F.array(*parts)), lambda x: (x["value"] > low) & (x["value"] < high))


def extract_numbers(df: DataFrame, key: str, text: str, patterns, low: float, high: float, keep: int | None = None) -> DataFrame:
    """One row per distinct (year, value) of a text, in match order; all, or the first ``keep``."""
    m = df.select(key, F.explode(_all_matches(F.col(text), patterns, low, high)).alias("m")).select(key, "m.*")
    m = m.groupBy(key, "year", "value").agg(F.min(F.struct("p", "i", "text")).alias("f"))
    m = m.select(key, "year", "value", F.col("f.text").alias("match_text"), F.col("f.p").alias("_p"), F.col("f.i").alias("_i"))
    order = [F.col("_p"), F.col("_i"), F.col("value")]
    if keep is None:
        return m.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).drop("_p", "_i")
    return ranks.top_n(m, [key], order, keep, key, "pos").drop("_p", "_i")


def profit_forecasts(df: DataFrame, key="report_id", text="text", patterns=PROFIT_PATTERNS, keep: int | None = None) -> DataFrame:
    return extract_numbers(df.withColumn("_t", F.regexp_replace(text, ",", "")), key, "_t", patterns, 0.01, 100000, keep)


def eps_forecasts(df: DataFrame, key="report_id", text="text", patterns=EPS_PATTERNS, keep: int | None = None) -> DataFrame:
    return extract_numbers(df, key, text, patterns, 0.001, 1000, keep)


def forecast_rows(reports: DataFrame, done: DataFrame, profit=PROFIT_PATTERNS, eps=EPS_PATTERNS, profits: int | None = None,
                  earnings: int | None = None, most: int | None = None) -> DataFrame:
    """Forecast rows of reports not yet processed: profits with the EPS of their year, or
    EPS alone where no profit was found. ``profits``, ``earnings`` and ``most`` keep the first
    profits, EPS values and rows of a report; all by default."""
    todo = reports.join(done.select("report_id").distinct(), "report_id", "left_anti").where(F.col("stock_code").isNotNull())
    p = profit_forecasts(todo, patterns=profit, keep=profits).withColumnRenamed("value", "profit_value")
    e = eps_forecasts(todo, patterns=eps, keep=earnings).withColumnRenamed("value", "eps_value")
    by_year = e.groupBy("report_id", "year").agg(F.max_by("eps_value", "pos").alias("eps_value"))
    y = by_year.select(F.col("report_id").alias("_r"), F.col("year").alias("_y"), "eps_value")
    with_profit = p.join(y, (p.report_id == y["_r"]) & p.year.eqNullSafe(y["_y"]), "left").select("report_id", "year", "profit_value", "eps_value", "pos")
    alone = e.join(p.select("report_id").distinct(), "report_id", "left_anti").select("report_id", "year", F.lit(None).cast("double").alias("profit_value"), "eps_value", "pos")
    rows = with_profit.unionByName(alone)
    rows = rows if most is None else rows.where(F.col("pos") <= most)
    return rows.join(todo.select("report_id", "stock_code"), "report_id").select("report_id", "stock_code", F.col("year").alias("forecast_year"), "profit_value", "eps_value", "pos")


def text_events(df: DataFrame, today: Column, patterns=EVENT_PATTERNS, ahead: int = 120, key="report_id", text="text") -> DataFrame:
    """Dated events within the next ``ahead`` days, one per (date, code, title)."""
    parts = []
    t = F.col(text)
    for k, (p, kind) in enumerate(patterns):
        y, m, d, w = (F.regexp_extract_all(t, F.lit(p), F.lit(i)) for i in (1, 2, 3, 0))
        ym = F.zip_with(y, m, lambda a, b: F.struct(a.alias("y"), b.alias("m")))
        dw = F.zip_with(d, w, lambda a, b: F.struct(a.alias("d"), b.alias("w")))
        both = F.zip_with(ym, dw, lambda a, b: F.struct(a["y"].alias("y"), a["m"].alias("m"), b["d"].alias("d"), b["w"].alias("w")))
        parts.append(F.transform(both, _dated(k, kind)))
    e = df.select(key, "stock_code", "stock_name", "institution", F.explode(F.flatten(F.array(*parts))).alias("e")).select(key, "stock_code", "stock_name", "institution", "e.*")
    e = e.where((F.col("event_date") >= today) & (F.col("event_date") <= F.date_add(today, ahead)))
    e = e.withColumns({"stock_code": F.coalesce("stock_code", F.lit("")), "title": F.concat_ws(" ", F.coalesce("stock_name", "institution", F.lit("market")), "event_type")})
    first = F.min(F.struct(key, "p", "detail", "event_type", F.coalesce("stock_name", F.lit("")).alias("stock_name")))
    return e.groupBy("event_date", "stock_code", "title").agg(first.alias("f")).select(
        "event_date", "stock_code", "title", "f.event_type", "f.stock_name", "f.detail", f"f.{key}")


def insert_if_absent(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.unionByName(fresh.join(stored.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def name_map(reports: DataFrame, patterns=TITLE_NAME_PATTERNS) -> DataFrame:
    """code -> name: report fields first (newest row wins), then title patterns."""
    field = reports.where((F.col("stock_code") != "") & (F.col("stock_name") != "")).select(
        F.col("stock_code").alias("code"), F.col("stock_name").alias("name"), F.lit(0).alias("prio"), (-F.col("report_id")).alias("o"))
    out = field
    for k, (p, n, c) in enumerate(patterns, 1):
        hit = reports.select(F.regexp_extract("title", p, c).alias("code"), F.regexp_extract("title", p, n).alias("name"), F.lit(k).alias("prio"), F.col("report_id").alias("o"))
        out = out.unionByName(hit.where(F.col("code") != ""))
    return out.groupBy("code").agg(F.min_by("name", F.struct("prio", "o", "name")).alias("name"))


def listed_codes(codes: Column) -> Column:
    return F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: c.rlike(r"^\d{6}$"))


def resolve_code(own: Column, targets: Column) -> Column:
    """Own code, else the only listed target."""
    t = listed_codes(targets)
    return F.coalesce(F.nullif(own, F.lit("")), F.when(F.size(t) == 1, F.get(t, F.lit(0))))


def institution_weight(c: Column, tier_one: Sequence[str] = TIER_ONE, house: Sequence[str] = HOUSE_WORDS) -> Column:
    return F.when(c.isNull() | (c == ""), 0.8).when(_any_word(c, tier_one), 1.5).when(_any_word(c, house), 1.0).otherwise(0.8)


def mentions(reports: DataFrame, count_twice: bool = False) -> DataFrame:
    """One row per (report, code). ``count_twice`` keeps the own code and its listing apart."""
    own, listed = F.array_compact(F.array(F.nullif("stock_code", F.lit("")))), F.array_distinct(listed_codes(F.col("target_stocks")))
    codes = F.concat(own, listed) if count_twice else F.array_distinct(F.concat(own, listed))
    return reports.withColumn("code", F.explode(codes))


def report_flags(df: DataFrame, buy=BUY_WORDS, upgrade=UPGRADE_WORDS, first=FIRST_WORDS) -> DataFrame:
    rating = F.coalesce(F.col("rating"), F.lit(""))
    return df.withColumns({
        "is_buy": _any_word(rating, buy) | (F.coalesce("sentiment", F.lit("neutral")) == "bullish"), "is_upgrade": _any_word(rating, upgrade),
        "is_first": _any_word(rating, first)})


def consensus(reports: DataFrame, since: Column, changes: DataFrame, limit: int = 15, weight: Column | None = None, count_twice: bool = False, **words) -> DataFrame:
    """Bullish consensus per code with counts, institutions, score and price divergence."""
    r = report_flags(reports.where((F.col("status") == "summarized") & (F.col("report_date") >= since)), **words)
    w = weight if weight is not None else institution_weight(F.col("institution"))
    n = lambda c: F.count_if(F.col(c))
    pts = F.col("_w") * F.when(F.col("is_buy"), 2.0).otherwise(1.0) + F.when(F.col("is_upgrade"), 1.0).otherwise(0.0) + F.when(F.col("is_first"), 0.8).otherwise(0.0)
    m = mentions(r.withColumn("_w", w), count_twice)
    g = m.groupBy("code").agg(
        F.count(F.lit(1)).alias("report_count"), n("is_buy").alias("buy_count"), F.count_if(F.col("sentiment") == "bullish").alias("bullish_count"),
        n("is_upgrade").alias("upgrade_count"), n("is_first").alias("first_cover_count"), F.count_distinct("institution").alias("institution_count"),
        F.round(F.sum(pts), 1).alias("score"), F.min_by("target_price", F.when(F.col("target_price").isNotNull(), F.col("report_id"))).alias("target_price"),
        F.max("report_date").alias("latest_date"))
    top = cut_lineage(g.orderBy(F.col("score").desc(), F.col("report_count").desc(), "code").limit(limit))
    mine = m.join(F.broadcast(top.select("code")), "code", "left_semi") if limit <= 10_000 else m.join(top.select("code"), "code", "left_semi")
    lists = {"institutions": F.col("institution"), "industries": F.explode("tags")}
    for out, value in lists.items():  # only values of the chosen codes, each once, are gathered
        once = mine.select("code", value.alias("value")).where("value is not null").distinct().groupBy("code").agg(F.array_sort(F.collect_list("value")).alias(out))
        top = top.join(once, "code", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    top = top.join(changes.select("code", "price_change_20d"), "code", "left")
    return top.withColumn("divergence", F.coalesce((F.col("price_change_20d") <= -5) & (F.col("buy_count") / F.col("report_count") >= 0.6) & (F.col("report_count") >= 3), F.lit(False)))


def recommendations(reports: DataFrame, today: Column, watch_codes: Sequence[str], watch_tags: Sequence[str], limit: int = 20,
                    source_weight: Column | None = None, weight: Column | None = None) -> DataFrame:
    """Watch list, industry, freshness and source, times institution weight; ranked."""
    codes, tags = F.array(*[F.lit(c) for c in watch_codes]), F.array(*[F.lit(t) for t in watch_tags])
    stock = F.when(F.array_contains(codes, F.col("stock_code")), 1.0).when(F.arrays_overlap(F.col("target_stocks"), codes), 0.8).otherwise(0.0)
    match = F.array_intersect("tags", tags)
    age = F.datediff(today, F.col("report_date"))
    fresh = F.when(age == 0, 1.0).when(age <= 2, 0.6).otherwise(0.2)
    w = weight if weight is not None else institution_weight(F.col("institution"))
    src = source_weight if source_weight is not None else F.lit(1.0)
    score = (F.coalesce(stock, F.lit(0.0)) * 0.4 + F.least(F.lit(1.0), F.size(match) / 3.0) * 0.3 + fresh * 0.2 + src * 0.1) * w
    reason = F.array_compact(F.array(F.when(stock == 1.0, "watched stock").when(stock == 0.8, "mentions a watched stock"),
                                     F.when(F.size(match) > 0, F.concat(F.lit("industry "), F.get(match, F.lit(0))))))
    r = reports.where((F.col("status") == "summarized") & (F.col("report_date") >= F.date_sub(today, 7)))
    r = r.withColumns({"score": F.round(score, 4), "reason": F.when(F.size(reason) == 0, "new report").otherwise(F.array_join(reason, "; "))})
    r = r.withColumn("_all", F.lit(1))
    return ranks.top_n(r, ["_all"], [F.col("score").desc(), F.col("report_id")], limit, "report_id", "rank").select("report_id", "rank", "score", "reason")


def target_upside(reports: DataFrame, prices: DataFrame, limit: int = 12) -> DataFrame:
    """Newest target price per code against the current price; the ``limit`` largest of all codes."""
    r = reports.withColumn("code", resolve_code(F.col("stock_code"), F.col("target_stocks"))).where(F.col("code").isNotNull() & F.col("target_price").isNotNull())
    t = r.groupBy("code").agg(F.max_by(F.struct("target_price", "report_date", "institution"), F.struct("report_date", -F.col("report_id"))).alias("t")).select("code", "t.*")
    t = t.join(prices.select("code", "current_price"), "code").where(F.col("current_price") > 0)
    t = t.withColumn("upside", F.round((F.col("target_price") - F.col("current_price")) / F.col("current_price") * 100, 1))
    return t.orderBy(F.col("upside").desc(), "code").limit(limit).select("code", "target_price", F.round("current_price", 2).alias("current_price"), "upside", "institution")


def upcoming_events(events: DataFrame, today: Column, ahead: int = 30, limit: int = 30) -> DataFrame:
    e = events.where((F.col("event_date") >= F.date_sub(today, 7)) & (F.col("event_date") <= F.date_add(today, ahead)))
    f = e.groupBy("stock_code", "event_type").agg(F.max(F.struct("event_date", "title")).alias("x")).select("stock_code", "event_type", "x.*")
    return f.orderBy(F.col("event_date").desc(), "stock_code", "event_type").limit(limit)


def watch_pool(reports: DataFrame, since: Column, briefs: DataFrame, preferences: DataFrame) -> DataFrame:
    """Distinct codes of reports, their targets, brief stocks and the watch list."""
    r = reports.where(F.col("report_date") >= since)
    ok = F.col("code").rlike(r"^\d{6}$")
    own = r.select(F.col("stock_code").alias("code")).where(F.col("code") != "")
    listed = r.select(F.explode(listed_codes(F.col("target_stocks"))).alias("code"))
    brief = briefs.select(F.explode("stocks").alias("s")).select(F.trim("s.code").alias("code")).where(ok)
    return own.union(listed).union(brief).union(preferences.select("code").where(ok)).distinct()


def disclosure_calendar(schedule: DataFrame, pool: DataFrame, today: Column, ahead: int = 45) -> DataFrame:
    """Announced dates of the two newest standard periods within the window."""
    period = F.try_to_date("end_date", "yyyyMMdd")
    ends = [F.last_day(F.add_months(F.trunc(today, "quarter"), -k)) for k in (1, 4)]
    d = schedule.withColumns({"_p": period, "event_date": F.try_to_date(F.substring("pre_date", 1, 8), "yyyyMMdd")})
    d = d.where((F.col("_p").isin(*ends)) & F.col("event_date").between(today, F.date_add(today, ahead))).join(pool, "code", "left_semi")
    label = F.when(F.month("_p") == 3, "Q1 report").when(F.month("_p") == 6, "half-year report").when(F.month("_p") == 9, "Q3 report").otherwise("annual report")
    return d.select("code", "event_date", label.alias("title"), "end_date").distinct()


def brief_picks(briefs: DataFrame, stored: DataFrame, prices: DataFrame) -> DataFrame:
    """New picks of the newest brief with the last price."""
    newest = briefs.agg(F.max("brief_date").alias("newest"))
    b = briefs.where(F.col("brief_date") == newest.scalar()).select(F.col("brief_date").alias("pick_date"), F.explode("stocks").alias("s"))
    b = b.select("pick_date", F.trim("s.code").alias("code")).where(F.col("code").rlike(r"^\d{6}$")).distinct()
    b = b.join(stored.select("pick_date", "code"), ["pick_date", "code"], "left_anti")
    return b.join(prices.select("code", F.col("current_price").alias("price_at_pick")), "code", "left")


def today_items(recs: DataFrame, reports: DataFrame, limit: int = 20) -> DataFrame:
    """Recommendations of the day, or the newest reports where there are none."""
    have = recs.agg(F.count(F.lit(1)).alias("n"))
    new = reports.orderBy(F.col("report_date").desc(), F.col("report_id").desc()).limit(limit)
    new = new.withColumn("_n", have.scalar()).where(F.col("_n") == 0)
    return recs.select("report_id", "reason").unionByName(new.select("report_id", F.lit("newest report").alias("reason"))).limit(limit)


def with_changes(items: DataFrame, changes: DataFrame) -> DataFrame:
    j = items.join(changes, "code", "left")
    return j.withColumn("risk", F.coalesce(F.col("price_change_20d") <= -5, F.lit(False)))


def source_stats(sources: DataFrame, reports: DataFrame) -> DataFrame:
    n = reports.groupBy("source").agg(F.count(F.lit(1)).alias("report_count"))
    return sources.join(n, "source", "left").withColumn("report_count", F.coalesce("report_count", F.lit(0)))


def research_view(reports: DataFrame, since: Column, keep: int = 8, lines: int = 4) -> DataFrame:
    """Mood counts, leaning and newest lines of the newest ``keep`` reports per code."""
    r = ranks.top_n(reports.where(F.col("report_date") >= since), ["stock_code"], [F.col("report_date").desc(), F.col("report_id").desc()], keep, "report_id", "_k")
    m = lambda s: F.count_if(F.coalesce("sentiment", F.lit("neutral")) == s)
    g = r.groupBy("stock_code").agg(
        F.count(F.lit(1)).alias("reports"), m("bullish").alias("bullish"), m("neutral").alias("neutral"), m("bearish").alias("bearish"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_k", "report_id"))), lambda x: x["report_id"]), 1, lines).alias("newest"))
    top = F.greatest("bullish", "neutral", "bearish")
    return g.withColumn("lean", F.when(F.col("bullish") == top, "bullish").when(F.col("neutral") == top, "neutral").otherwise("bearish"))


def _word_pattern(words: Sequence[str]) -> str:
    """Longest word first. Words of letters that stand between blanks match as wholes, others
    (scripts without blanks) wherever they occur, so no segmenter is needed."""
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    spaced = [w for w in ordered if re.fullmatch(r"[\x00-\u024f]+", w)]
    dense = [w for w in ordered if w not in spaced]
    parts = ["|".join(map(re.escape, dense))] if dense else []
    if spaced:
        parts.append(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, spaced)) + r")(?![\p{L}\p{N}])")
    return "|".join(parts)


def lexicon_sentiment(df: DataFrame, text: str, positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS, keywords=None, urgent=URGENT_WORDS) -> DataFrame:
    """Word counts on whole texts -> score, keyword counts per category, importance."""
    keywords = KEYWORDS if keywords is None else keywords
    d = df.withColumn("_w", F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    count = lambda words: F.coalesce(F.regexp_count(F.col(text), F.lit(_word_pattern(words))), F.lit(0)) if words else F.lit(0)
    dense = lambda ws: [w for w in ws if not re.fullmatch(r"[\x00-\u024f]+", w)]
    d = d.withColumns({"positive_count": count(positive), "negative_count": count(negative),
                       **{f"kw_{k}": F.size(F.filter("_w", _has_word([w for w in ws if w not in dense(ws)]))) + count(dense(ws)) for k, ws in keywords.items()}})
    both = F.col("positive_count") + F.col("negative_count")
    n, kw = F.length(text), sum((F.col(f"kw_{k}") for k in keywords), F.lit(0))
    imp = (F.when(n.between(50, 1000), 0.3).when(n > 1000, 0.2).otherwise(0.0) + F.when(kw > 0, F.least(F.lit(0.5), kw * 0.1)).otherwise(0.0)
           + F.when(_any_word(F.col(text), urgent), 0.2).otherwise(0.0))
    return d.withColumns({"sentiment_score": F.coalesce(F.try_divide(F.col("positive_count") - F.col("negative_count"), both), F.lit(0.0)),
                          "importance": F.least(F.lit(1.0), imp), "word_count": F.size("_w")}).drop("_w")


def unverifiable_numbers(answer: Column, context: Column) -> Column:
    """Numbers of the answer that the context does not carry (exact, integer or +-1); years
    2010-2029 are exempt, numbers with three or more decimals must match exactly."""
    toks = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    whole = lambda t: F.split_part(t, F.lit("."), F.lit(1)).try_cast("decimal(38,0)")
    near = lambda t: context.contains(t) | F.exists(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: F.coalesce(context.contains((whole(t) + k).cast("string")), F.lit(False)))
    year = lambda t: ~t.contains(".") & F.coalesce(whole(t).between(2010, 2029), F.lit(False))
    loose = F.filter(toks, lambda t: ~year(t) & ~near(t))
    strict = F.filter(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\d+\.\d{3,}"), F.lit(0))), lambda t: ~context.contains(t))
    return F.array_union(loose, strict)


def most_common(df: DataFrame, array_col: str, limit: int = 20) -> DataFrame:
    return df.select(F.explode(array_col).alias("item")).groupBy("item").count().orderBy(F.col("count").desc(), "item").limit(limit)


def forecast_consensus(forecasts: DataFrame, year: int, limit: int = 16) -> DataFrame:
    """Trimmed profit consensus per code (within a tenth and ten times the upper median)."""
    f = forecasts.where(F.col("profit_value").isNotNull() & (F.col("forecast_year").isNull() | (F.col("forecast_year") >= year)))
    nz = f.where(F.col("profit_value") != 0)
    n = f.groupBy("stock_code").agg(F.count(F.lit(1)).alias("forecast_count"), F.mode("forecast_year", deterministic=True).alias("forecast_year"),
                                    F.avg(F.when(F.col("eps_value") != 0, F.col("eps_value"))).alias("_eps"))
    pos = ranks._positions(nz, ["stock_code"], "profit_value")
    half = F.floor(F.col("_total") / 2)
    med = pos.where((F.col("_before") <= half) & (half < F.col("_before") + F.col("_copies"))).select("stock_code", F.col("_x").alias("_med"))
    t = nz.join(med, "stock_code").where(F.col("profit_value").between(F.col("_med") / 10, F.col("_med") * 10))
    s = t.groupBy("stock_code").agg(F.avg("profit_value").alias("_a"), F.min("profit_value").alias("_lo"), F.max("profit_value").alias("_hi"))
    j = n.where(F.col("forecast_count") >= 3).join(s, "stock_code")
    j = j.select("stock_code", "forecast_count", "forecast_year", F.round("_a", 2).alias("avg_profit"), F.round("_lo", 2).alias("min_profit"), F.round("_hi", 2).alias("max_profit"),
                 F.round((F.col("_hi") - F.col("_lo")) / F.col("_a") * 100, 1).alias("dispersion"), F.round("_eps", 2).alias("avg_eps"))
    return j.orderBy("dispersion", F.col("forecast_count").desc(), "stock_code").limit(limit)


def surprises(events: DataFrame, reports: DataFrame, start: Column, limit: int = 12, beat=BEAT_WORDS, miss=MISS_WORDS, **words) -> DataFrame:
    """Newest result event per code against the bullish set of the reports."""
    r = report_flags(reports.where((F.col("status") == "summarized") & (F.col("report_date") >= F.date_sub(start, 30))), **words)
    bull = mentions(r.where("is_buy")).select(F.col("code").alias("stock_code")).distinct().withColumn("in_consensus", F.lit(True))
    e = events.where((F.col("event_date") >= start) & (F.coalesce("stock_code", F.lit("")) != ""))
    e = e.groupBy("stock_code").agg(F.max(F.struct("event_date", "title")).alias("x")).select("stock_code", "x.*")
    kind = F.when(_any_word(F.col("title"), beat), "beat").when(_any_word(F.col("title"), miss), "miss")
    e = e.withColumn("event_type", kind).where(F.col("event_type").isNotNull()).join(bull, "stock_code", "left")
    sup = F.coalesce("in_consensus", F.lit(False))
    sig = (F.when((F.col("event_type") == "beat") & sup, "confirmed beat").when(F.col("event_type") == "beat", "improving")
           .when(sup, "disappointment risk").otherwise("under pressure"))
    return e.withColumns({"with_research_support": sup, "signal": sig}).orderBy(F.col("event_date").desc(), "stock_code").limit(limit).select(
        "stock_code", "event_type", "title", "event_date", "with_research_support", "signal")


def list_reports(reports: DataFrame, search: str = "", sentiment: str = "", source: str = "", since: Column | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): filtered reports, newest first."""
    r = reports
    if since is not None:
        r = r.where(F.col("report_date") >= since)
    if search:
        like = f"%{search}%"
        cols = [c for c in ("title", "stock_name", "institution") if c in reports.columns]
        cond = F.col(cols[0]).ilike(like)
        for c in cols[1:]:
            cond = cond | F.col(c).ilike(like)
        r = r.where(cond)
    if sentiment:
        r = r.where(F.col("sentiment") == sentiment)
    if source:
        r = r.where(F.col("source") == source)
    page = r.orderBy(F.col("report_date").desc(), F.col("report_id").desc()).offset(offset).limit(limit)
    return page, r.agg(F.count(F.lit(1)).alias("total"))


def purge(reports: DataFrame, forecasts: DataFrame, cutoff: Column) -> DataFrame:
    """Recent reports plus old ones that forecasts refer to."""
    old = reports.where(F.col("report_date") < cutoff)
    kept = old.join(forecasts.select("report_id").distinct(), "report_id", "left_semi")
    return reports.where(F.col("report_date") >= cutoff).unionByName(kept)
