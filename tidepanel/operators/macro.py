"""Cross-asset and macro analytics on one long table (series_name, obs_date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound
from .joins import fuzzy_match
from .windows import Series

SERIES = Series("series_name", "obs_date")


def change(n: int, col: str = "value") -> Column:
    """Percent change over n observations, two places; null when history is short."""
    prev = SERIES.lag(col, n)
    return F.round(F.try_divide(F.col(col) - prev, prev) * 100, 2)


def heat_level(pct: Column) -> Column:
    return (F.when(pct >= 5.0, 3).when(pct >= 1.5, 2).when(pct >= 0.15, 1).when(pct <= -5.0, -3).when(pct <= -1.5, -2)
            .when(pct <= -0.15, -1).otherwise(0))


def change_percentile(df: DataFrame, n: int = 20) -> DataFrame:
    """Share of all n-row changes so far that are at most the newest one (per series)."""
    d = df.withColumn("_c", (F.try_divide(F.col("value"), SERIES.lag("value", n)) - 1) * 100)
    now = d.groupBy("series_name").agg(F.max_by("_c", "obs_date").alias("_now"), F.count(F.lit(1)).alias("_n"))
    a = d.join(now, "series_name").groupBy("series_name").agg(
        F.max("_n").alias("_n"), F.avg(F.when(F.col("_c").isNotNull(), (F.col("_c") <= F.col("_now")).cast("double"))).alias("_p"))
    return a.select("series_name", F.when(F.col("_n") >= 3 * n, F.round(F.col("_p") * 100).cast("int")).alias("pct_rank"))


def sparkline(df: DataFrame, n: int = 20, height: int = 18) -> DataFrame:
    """Last n values scaled to 0..height (downwards), flat series in the middle."""
    w = Window.partitionBy("series_name").orderBy(F.col("obs_date").desc())
    d = df.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= n)
    a = d.groupBy("series_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("_b")).alias("o"), "value"))).alias("_v"),
                                     F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_hi") <= F.col("_lo")
    pts = F.transform("_v", lambda x: F.when(flat, F.lit(height / 2)).otherwise(
        F.round(height - (x["value"] - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * height, 1)))
    return a.select("series_name", F.when(F.size("_v") >= n, pts).alias("spark"))


def latest_changes(df: DataFrame, steps=(1, 5, 20, 60)) -> DataFrame:
    d = df.withColumns({f"chg_{n}": change(n) for n in steps})
    pack = F.struct(F.col("value").alias("last"), *[f"chg_{n}" for n in steps])
    return d.groupBy("series_name").agg(F.max_by(pack, "obs_date").alias("x"), F.count(F.lit(1)).alias("n_obs")).select("series_name", "n_obs", "x.*")


def asset_heat(df: DataFrame) -> DataFrame:
    t = latest_changes(df).join(change_percentile(df), "series_name", "left").join(sparkline(df), "series_name", "left")
    return t.withColumns({"heat_20": heat_level(F.col("chg_20")), "heat_1": heat_level(F.col("chg_1"))})


def norm_pct(c: Column, span: float = 3.0) -> Column:
    return bound(F.coalesce(c, F.lit(0.0)) / span, -1.0, 1.0)


def score_from(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the available -1..1 parts (null = absent) on a 0..100 scale."""
    top = sum((F.when(p.isNotNull(), p * w).otherwise(0.0) for p, w in parts), F.lit(0.0))
    den = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts), F.lit(0.0))
    return F.when(den > 0, F.round((top / den + 1) / 2 * 100).cast("int"))


def wide(latest: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row with a struct of changes per role; roles without a series are null."""
    fields = [c for c in latest.columns if c != "series_name"]
    aggs = [F.max(F.when(F.col("series_name") == s, F.struct(*fields))).alias(role) for role, s in names.items()]
    return latest.agg(*aggs)


def risk_appetite(w: DataFrame, equities: list[str], dollar="dollar", rate="rate", gold="gold", oil="oil") -> DataFrame:
    """Equity momentum, dollar, rate move, and oil against gold."""
    have = lambda r: F.col(r).isNotNull() if r in w.columns else F.lit(False)
    get = lambda r, f: F.col(f"{r}.{f}") if r in w.columns else F.lit(None).cast("double")
    n = sum((have(e).cast("int") for e in equities), F.lit(0))
    mom = sum((F.when(have(e), norm_pct(get(e, "chg_20"))).otherwise(0.0) for e in equities), F.lit(0.0))
    parts = [
        (F.when(n > 0, F.try_divide(mom, n)), 0.40), (F.when(have(dollar), -norm_pct(get(dollar, "chg_5"), 1.0)), 0.25),
        (F.when(have(rate) & (get(rate, "n_obs") >= 6), -bound(F.coalesce(get(rate, "diff_5"), F.lit(0.0)) / 0.25, -1.0, 1.0)), 0.20),
        (F.when(have(gold), bound(norm_pct(get(oil, "chg_20")) - norm_pct(get(gold, "chg_20")), -1.0, 1.0)), 0.15)]
    s = score_from(parts)
    return w.select(s.alias("score"), F.when(s.isNull(), "no data").when(s >= 65, "risk on").when(s <= 35, "risk off").otherwise("mixed").alias("label"))


def realized_vol(df: DataFrame, n: int = 20) -> DataFrame:
    """Annualised deviation of the last n returns per series."""
    d = df.withColumn("_r", F.try_divide(F.col("value"), SERIES.lag("value")) - 1)
    d = d.withColumn("_v", SERIES.roll(F.stddev_samp, "_r", n, n))
    return d.groupBy("series_name").agg(F.max_by(F.round(F.col("_v") * (252**0.5) * 100, 2), "obs_date").alias("realized_vol"))


def fear_greed(inputs: DataFrame) -> DataFrame:
    """Mood score from one row: implied or realised volatility, margin, breadth, index move.

    Columns: vix_last, vix_ma20, vix_n, realized_vol, margin_chg5, up, down, index_chg20.
    """
    c = F.col
    vix = c("vix_last").isNotNull() & (c("vix_n") >= 21)
    parts = [
        (F.when(vix, bound(-(c("vix_last") - c("vix_ma20")) / F.greatest(c("vix_ma20"), F.lit(1.0)) / 0.15, -1.0, 1.0)), 0.25),
        (F.when(vix, bound((25.0 - c("vix_last")) / 10.0, -1.0, 1.0)), 0.15),
        (F.when(~F.coalesce(vix, F.lit(False)), bound((22.0 - c("realized_vol")) / 10.0, -1.0, 1.0)), 0.40),
        (F.when(c("margin_chg5").isNotNull(), bound(c("margin_chg5") / 1.5, -1.0, 1.0)), 0.20),
        (F.when(c("up") + c("down") > 0, (c("up") - c("down")) / (c("up") + c("down"))), 0.20),
        (F.when(c("index_chg20").isNotNull(), norm_pct(c("index_chg20"))), 0.20)]
    parts[2] = (F.when(c("realized_vol").isNotNull(), parts[2][0]), 0.40)
    s = score_from(parts)
    label = (F.when(s.isNull(), "no data").when(s >= 80, "extreme greed").when(s >= 60, "greed").when(s <= 20, "extreme fear")
             .when(s <= 40, "fear").otherwise("neutral"))
    return inputs.select(s.alias("score"), label.alias("label"))


def direction(df: DataFrame) -> DataFrame:
    """Mean of the last three against the three before (0.2 % dead band), per series."""
    recent, earlier = F.avg("value").over(SERIES.frame(-2)), F.avg("value").over(SERIES.frame(-5, -3))
    diff = F.try_divide(recent - earlier, F.abs(earlier))
    full = F.count("value").over(SERIES.frame(-5)) >= 6
    d = df.withColumn("_d", F.when(full & (diff > 0.002), 1).when(full & (diff < -0.002), -1).otherwise(0))
    return d.groupBy("series_name").agg(F.max_by("_d", "obs_date").alias("direction"), F.max_by("value", "obs_date").alias("last"), F.max("obs_date").alias("obs_date"))


def quadrant(growth: Column, inflation: Column) -> Column:
    return (F.when((growth == 1) & (inflation == 1), "overheat").when((growth == 1) & (inflation == -1), "recovery")
            .when((growth == -1) & (inflation == 1), "stagflation").when((growth == -1) & (inflation == -1), "reflation")
            .when(growth >= 0, "recovery").otherwise("reflation"))


def _pick(d: DataFrame, name: str, col: str) -> Column:
    return F.max(F.when(F.col("series_name") == name, F.col(col)))


def clock_macro(df: DataFrame, growth_name: str, price_name: str, neutral: float = 50.0) -> DataFrame:
    """Growth against its neutral level and direction, price direction -> quadrant."""
    d = direction(df)
    a = d.agg(_pick(d, growth_name, "last").alias("level"), _pick(d, growth_name, "direction").alias("gd"), _pick(d, price_name, "direction").alias("pd"))
    g = F.when((F.col("level") >= neutral) & (F.col("gd") >= 0), 1).when(F.col("gd") < 0, -1).when(F.col("gd") > 0, 1).otherwise(0)
    return a.select(g.alias("growth_axis"), F.col("pd").alias("inflation_axis"), quadrant(g, F.col("pd")).alias("quadrant"))


def clock_market(latest: DataFrame, growth_name: str, price_names: tuple[str, str]) -> DataFrame:
    """Market proxy: 60-row equity change and mean 20-row change of two commodities."""
    a = latest.agg(_pick(latest, growth_name, "chg_60").alias("g"), *[_pick(latest, p, "chg_20").alias(f"p{i}") for i, p in enumerate(price_names)],
                   F.count_if(F.col("series_name").isin(*price_names)).alias("n"))
    g = F.when(F.coalesce("g", F.lit(0.0)) > 1.0, 1).when(F.coalesce("g", F.lit(0.0)) < -1.0, -1).otherwise(0)
    avg = (norm_pct(F.col("p0")) + norm_pct(F.col("p1"))) / 2
    i = F.when(F.col("n") < 2, 0).when(avg > 0.15, 1).when(avg < -0.15, -1).otherwise(0)
    return a.select(g.alias("growth_axis"), i.alias("inflation_axis"), quadrant(g, i).alias("quadrant"))


def trend(c: Column, threshold: float = 1.0) -> Column:
    return F.when(c > threshold, 1).when(c < -threshold, -1).otherwise(0)


def transmission(latest: DataFrame, chains: list[tuple[str, list[tuple[str, float]]]]) -> DataFrame:
    """State of each chain: the first of its series with a non-zero 20-row trend."""
    one = latest.agg(F.map_from_entries(F.collect_list(F.struct("series_name", "chg_20"))).alias("m"))
    rows = []
    for name, series in chains:
        states = [F.nullif(trend(F.try_element_at("m", F.lit(s)), t), F.lit(0)) for s, t in series]
        rows.append(F.struct(F.lit(name).alias("chain"), F.coalesce(*states, F.lit(0)).alias("state")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def theme_directions(latest: DataFrame, rules: DataFrame, flow_names: DataFrame, research: DataFrame, keep: int = 8) -> DataFrame:
    """Rule table joined with series trends; themes scored and confirmed by flow and research.

    rules: series_name, want, themes array, weight, reason. A theme is confirmed by the first sector or tag
    that contains it or is contained in it (:func:`joins.fuzzy_match`).
    """
    t = latest.select("series_name", trend(F.col("chg_20")).alias("want"))
    hit = rules.join(t, ["series_name", "want"]).select(F.explode("themes").alias("direction"), "weight", "reason", "rule_id")
    s = hit.groupBy("direction").agg(F.sum("weight").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("rule_id", "reason"))), lambda x: x["reason"]).alias("reasons"))
    for hit, names, name in (("flow_hit", flow_names, "sector_name"), ("research_hit", research, "tag")):
        s = fuzzy_match(s, "direction", names, name, hit)
    s = s.join(research.select(F.col("tag").alias("research_hit"), F.col("n").alias("_n")), "research_hit", "left")
    s = s.withColumns({"confirms": F.col("flow_hit").isNotNull().cast("int") + F.col("research_hit").isNotNull().cast("int"), "research_count": F.coalesce("_n", F.lit(0))})
    s = s.withColumn("level", F.when(F.col("confirms") >= 2, "strong").when(F.col("confirms") == 1, "medium").otherwise("weak"))
    return s.orderBy(F.col("confirms").desc(), F.col("score").desc(), "direction").limit(keep).select(
        "direction", F.round("score", 1).alias("score"), "reasons", "flow_hit", "research_hit", "research_count", "confirms", "level")


def compass(row: DataFrame) -> DataFrame:
    """Blend of model, same-state, cycle and adviser probabilities with votes and dissent.

    Columns: model_p, selective, state_p (0..100), cycle_score, cycle_position, adviser_p.
    """
    c = F.col
    model = F.when(c("selective"), c("model_p")).otherwise(0.5) * 100
    cyc = F.when(c("cycle_score") < 20, 100.0).when(c("cycle_score") >= 80, 30.0).otherwise(F.coalesce("cycle_position", F.lit(0.5)) * 100)
    adviser = F.coalesce("adviser_p", F.lit(0.5)) * 100
    score = F.round(bound(model * 0.40 + F.coalesce("state_p", F.lit(50.0)) * 0.30 + cyc * 0.15 + adviser * 0.15))
    d = row.withColumns({"score": score, "_v": F.array(
        F.struct(F.lit("model").alias("n"), (model / 100).alias("v")), F.struct(F.lit("state").alias("n"), c("state_p").alias("v")),
        F.struct(F.lit("cycle").alias("n"), cyc.alias("v")), F.struct(F.lit("adviser").alias("n"), (adviser / 100).alias("v")))})
    d = d.withColumn("_v", F.filter("_v", lambda x: x["v"].isNotNull()))
    d = d.withColumn("agree", F.size(F.filter("_v", lambda x: (x["v"] >= 50) == (F.col("score") >= 50))))
    return d.select(
        "score", F.when(F.col("score") >= 58, "bullish").when(F.col("score") <= 42, "bearish").otherwise("neutral").alias("label"),
        F.when(F.col("agree") >= 3, "high").when(F.col("agree") == 2, "medium").otherwise("low").alias("confidence"),
        F.transform(F.filter("_v", lambda x: F.abs(x["v"] - F.col("score")) >= 15), lambda x: x["n"]).alias("dissent"))


def history_tail(df: DataFrame, order: str, n: int = 260) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def known_macro(days: DataFrame, macro: DataFrame, day: str = "trade_date") -> DataFrame:
    """Newest macro month published before the month of each day (no look-ahead).

    Months form a dense generated key: each value is valid until the next known month.
    """
    w = Window.partitionBy("series_name").orderBy("month")
    m = macro.where(F.col("value").isNotNull()).withColumn("_next", F.lead("month").over(w))
    m = m.withColumn("_end", days.agg(F.max(F.trunc(day, "month")).alias("last")).scalar())
    upto = F.greatest(F.coalesce("_next", "_end"), F.add_months("month", 1))
    m = m.withColumn("_m", F.explode(F.sequence(F.add_months("month", 1), upto, F.expr("interval 1 month"))))
    d = days.withColumn("_m", F.trunc(day, "month"))
    return d.join(m.select("_m", "series_name", F.col("month").alias("known_month"), "value"), "_m").drop("_m")


def complete_dates(df: DataFrame, day: str, exchange: str, value: str, at_least: int = 2) -> DataFrame:
    """Sum over exchanges, only for dates on which at least two reported."""
    a = df.groupBy(day).agg(F.count_distinct(exchange).alias("_n"), F.sum(value).alias(value))
    return a.where(F.col("_n") >= at_least).drop("_n")
