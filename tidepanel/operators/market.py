"""Market-wide aggregates: emotion, industry heat, timing, regime, state probabilities,
money flow and sentiment roll-ups, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, is_blank
from ..session import cut_lineage
from . import ranks
from .windows import Series
from .xsection import join_stats

DATE = ["trade_date"]
TINY = 1e-9


ENRICHED = ("mf_net_main", "mf_main_ratio", "sent_limit_gene", "sent_limit_active", "sent_hsgt_fav")


def money_flow_by_code(df: DataFrame) -> DataFrame:
    """Mean net flow and buy share per entity (partial aggregation on both sides)."""
    return df.groupBy("ts_code").agg(
        F.avg("net_flow").alias("mf_net_main"),
        (F.sum("buy_amount") / (F.sum("buy_amount") + F.sum("sell_amount") + TINY)).alias("mf_main_ratio"))


def limit_hits(pool: DataFrame, since: Column) -> DataFrame:
    """Limit-ups per entity over the window and since a later date."""
    up = F.col("limit_type") == "U"
    return pool.groupBy("ts_code").agg(F.count_if(up).alias("sent_limit_gene"), F.count_if(up & (F.col("trade_date") >= since)).alias("sent_limit_active"))


def favourites(df: DataFrame, key: str, value: str, at_least: int = 1) -> DataFrame:
    """Keys with a positive total over at least ``at_least`` rows. Amounts are added as decimals of six places, so
    a total of nothing is zero in whatever order its rows come."""
    return df.groupBy(key).agg(F.sum(F.col(value).try_cast("decimal(28,6)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n")).where((F.col("total") > 0) & (F.col("n") >= at_least))


def enrich(df: DataFrame, flow: DataFrame, hits: DataFrame, liked: DataFrame) -> DataFrame:
    """Money flow, limit-up memory and a favourite flag per entity; an entity without rows gets 0."""
    flag = liked.select("ts_code", F.lit(1.0).alias("sent_hsgt_fav"))
    for side in (flow.select("ts_code", "mf_net_main", "mf_main_ratio"), hits.select("ts_code", "sent_limit_gene", "sent_limit_active"), flag):
        df = df.join(side, "ts_code", "left")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ENRICHED})


def first_non_null_latest(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Newest non-null value of each column per key (each column on its own)."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in cols])


def emotion(df: DataFrame, by: Sequence[str] = DATE, group_rows=None) -> DataFrame:
    """Limit and strength counts with the median move -> 0..100 mood and four levels."""
    pct = F.coalesce(F.col("pct_chg"), F.lit(0.0))
    rows = df.withColumn("_p", pct)
    med = ranks.quantiles(rows, by, {"median_pct": ("_p", 0.5)}, group_rows)
    p = F.col("_p")
    a = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(p >= 9.5).alias("limit_up_count"), F.count_if(p <= -9.5).alias("limit_down_count"),
        F.count_if(p >= 3.0).alias("strong_count"), F.count_if(p <= -3.0).alias("weak_count")).join(med, list(by))
    n = F.greatest("_n", F.lit(1))
    score = bound(
        F.least("limit_up_count", F.lit(120)) / 120 * 32 + F.least(F.col("strong_count") / n, F.lit(0.25)) / 0.25 * 24
        + bound((F.col("median_pct") + 2.0) / 4.5 * 22) + F.greatest(F.lit(0.0), 22 - F.least("limit_down_count", F.lit(80)) / 80 * 22)
        - F.least(F.col("weak_count") / n, F.lit(0.20)) / 0.20 * 10)
    a = a.withColumn("emotion_score", score)
    level = (F.when(F.col("emotion_score") >= 72, "climax").when(F.col("emotion_score") >= 56, "recovery")
             .when(F.col("emotion_score") >= 40, "divided").otherwise("retreat"))
    return a.withColumn("emotion_level", level).drop("_n")


def industry_heat(df: DataFrame, leader_mix: bool = False) -> DataFrame:
    """Per (date, industry) counts, mean move, amount and a hot score with the amount rank.

    ``leader_mix`` uses the second weighting (member count instead of strong members).
    """
    a = df.groupBy("trade_date", "industry").agg(
        F.count(F.lit(1)).alias("industry_count"), F.count_if("is_limit_up").alias("industry_limit_up"),
        F.count_if(F.col("pct_chg") >= 3).alias("industry_strong"), F.avg("pct_chg").alias("industry_avg_pct"),
        F.sum("amount_yi").alias("industry_amount_yi"))
    a = ranks.average_ranks(a, DATE, {"_r": "industry_amount_yi"}, ranks.WINDOW_ROWS)
    cut = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(top)) / top
    if leader_mix:
        hot = cut("industry_limit_up", 8) * 45 + cut("industry_count", 20) * 20 + cut("industry_avg_pct", 10) * 20 + F.col("_r") * 15
    else:
        hot = cut("industry_limit_up", 8) * 38 + cut("industry_strong", 20) * 22 + cut("industry_avg_pct", 10) * 20 + F.col("_r") * 20
    return a.withColumn("hot_score", hot).drop("_r")


def market_timing(df: DataFrame, group_rows=None) -> DataFrame:
    """Per date: regime, trend permission and weight, market score, confidence."""
    d = df.withColumn("_r", F.coalesce("pmt_return_20d", F.lit(0.0)))
    med = ranks.quantiles(d, DATE, {"median_ret": ("_r", 0.5)}, group_rows)
    a = d.groupBy("trade_date").agg(
        F.avg("_r").alias("mean_ret"), F.coalesce(F.avg("volat_hist_20d"), F.lit(0.0)).alias("volatility"),
        F.avg(F.coalesce("vol_ratio_raw", F.lit(1.0))).alias("mean_volume_ratio"),
        F.avg((F.coalesce("size_score", F.lit(0.5)) > 0.7).cast("double")).alias("small_share"),
        F.count("pmt_return_20d").alias("_n"), F.avg("pmt_return_20d").alias("_m"), F.stddev_samp("pmt_return_20d").alias("_s"),
        F.count_if(F.col("pmt_return_20d") > 0).alias("_up")).join(med, DATE)
    m, med_, hot = F.col("mean_ret"), F.col("median_ret"), F.col("volatility") > 0.028
    bull, bear = (med_ > 0.02) & (m > 0.01) & ~hot, (med_ < -0.02) & (m < -0.01)
    allowed = F.when(bull, True).when(bear, False).when(hot, m > -0.01).otherwise(True)
    regime = F.when(bull, "bull").when(bear, "bear").when(hot & (m <= -0.01), "bear").otherwise("neutral")
    score = (F.when(bull, F.least(F.lit(95.0), 60 + m * 300)).when(bear, F.greatest(F.lit(15.0), 40 + m * 200))
             .when(hot, F.greatest(F.lit(25.0), 45 + m * 150)).otherwise(50.0))
    weight = F.when(bull, 0.65).when(bear, 0.0).when(hot, F.when(m > -0.01, 0.30).otherwise(0.0)).otherwise(0.50)
    n = F.col("_n").cast("double")
    z = F.abs(F.col("_up") / n - 0.5) / (0.5 / F.sqrt(n))
    t = F.when(F.col("_s") > TINY, F.col("_m") / F.col("_s") * F.sqrt(n)).otherwise(0.0)
    agree = 0.5 + 0.5 * (1.0 - F.exp(-z / 3.0))
    cover = F.least(F.lit(1.0), 0.4 + 0.12 * F.log10(n))
    conf = 100.0 * bound(0.5 * agree + 0.3 * F.tanh(F.abs(t) / 4.0) + 0.2 * cover, 0.35, 0.85)
    return a.select(
        "trade_date", F.when(F.col("small_share") > 0.6, F.concat(regime, F.lit("_small_dominant"))).otherwise(regime).alias("regime"),
        allowed.alias("trend_allowed"), weight.alias("trend_weight"), score.alias("market_score"), "volatility",
        F.round(F.when(n >= 30, conf).when(n > 0, 45.0).otherwise(50.0), 1).alias("confidence"))


def size_regime(df: DataFrame, ret: str = "ret_20") -> DataFrame:
    """Small against large caps per date: rally side, volatile or balanced."""
    small, large = F.col("size_quantile") <= 0.3, F.col("size_quantile") >= 0.7
    a = df.groupBy("trade_date").agg(
        F.avg(F.when(small, F.col(ret))).alias("small_ret"), F.avg(F.when(large, F.col(ret))).alias("large_ret"), F.stddev_samp(ret).alias("ret_std"))
    spread = F.col("small_ret") - F.col("large_ret")
    regime = (F.when(spread > 0.025, "small_cap_rally").when(spread < -0.025, "large_cap_rally")
              .when(F.col("ret_std") > 0.045, "volatile").otherwise("balanced"))
    return a.withColumn("regime", regime)


# Drawdown and 20-row return buckets of the state table.
def drawdown_bucket(d: Column) -> Column:
    return F.when(d > -5, "shallow").when(d > -10, "medium").when(d > -20, "deep").otherwise("crash")


def momentum_bucket(c: Column) -> Column:
    return F.when(c > 3, "strong").when(c >= -3, "flat").when(c > -8, "sliding").otherwise("plunge")


def market_states(series: DataFrame, key: str, order: str, price: str, look: int = 250) -> DataFrame:
    """State per row (from row ``look`` on) with the forward 5/20/60-row returns."""
    s = Series(key, order)
    df = series.withColumns({
        "_i": s.row_index(), "dd": (F.col(price) / F.max(price).over(s.frame(-(look - 1))) - 1) * 100,
        "r20": s.pct_change(price, 20) * 100, **{f"f{h}": s.forward_return(price, h) * 100 for h in (5, 20, 60)}})
    return df.where(F.col("_i") >= look).drop("_i").withColumns({"dd_state": drawdown_bucket(F.col("dd")), "r20_state": momentum_bucket(F.col("r20"))})


def state_probabilities(states: DataFrame, key: str, min_samples: int = 15, group_rows: int | None = None) -> DataFrame:
    """Forward distribution per state; order statistics are taken by position (:func:`ranks.order_statistics`), not
    interpolated. A state may hold any share of the rows; ``group_rows`` is the size of the widest one, if known."""
    by, finished = [key, "dd_state", "r20_state"], F.col("f20").isNotNull()
    df = states.select(*by, "f20", *[F.when(finished, F.col(f"f{h}")).alias(f"v{h}") for h in (5, 20, 60)], F.col("f5").alias("f5"))
    share = lambda c, hit: F.avg(F.when(F.col(c).isNotNull(), hit.cast("double")))
    aggs = [F.count("f20").alias("samples"), share("f5", F.col("f5") > 0).alias("rebound_5"), share("f20", F.col("f20") < -5).alias("below_5_in_20")]
    for h in (5, 20, 60):
        aggs += [F.avg(f"v{h}").alias(f"mean_{h}"), share(f"v{h}", F.col(f"v{h}") > 0).alias(f"up_{h}")]
    places = ranks.order_statistics(df, by, {f"p{int(100 * q)}_{h}": (f"v{h}", q) for h in (5, 20, 60) for q in (0.1, 0.5, 0.9)}, group_rows)
    t = df.groupBy(*by).agg(*aggs).join(places, by)
    out = {}
    for h in (5, 20, 60):
        out |= {f"{c}_{h}": F.round(f"{c}_{h}", 1) for c in ("mean", "p10", "p50", "p90")} | {f"up_{h}": F.round(F.col(f"up_{h}") * 100)}
    out |= {"rebound_5": F.round(F.col("rebound_5") * 100), "below_5_in_20": F.round(F.col("below_5_in_20") * 100)}
    thin = F.col("samples") < min_samples
    return t.withColumns(out).select(*by, "samples", *[F.when(~thin, F.col(c)).alias(c) for c in out])


def same_state_recent(states: DataFrame, key: str, order: str, keep: int = 8) -> DataFrame:
    """Newest finished rows that share the state of the last row of their series."""
    now = states.groupBy(key).agg(F.max_by(F.struct("dd_state", "r20_state"), order).alias("_s"))
    same = states.join(now, key).where((F.col("dd_state") == F.col("_s.dd_state")) & (F.col("r20_state") == F.col("_s.r20_state")) & F.col("f20").isNotNull())
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return same.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= keep).select(key, order, F.round("f20", 1).alias("f20"))


# ---- samples -------------------------------------------------------------------------


def hash_text(key: Sequence[str]) -> Column:
    """MD5 of the key columns joined by a bar, which other engines can state too."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))


def hash_number(text: Column) -> Column:
    """Its first 32 bits as a number."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def stratified_sample(df: DataFrame, year: Column, key: Sequence[str], per_year: int) -> DataFrame:
    """Up to ``per_year`` rows of every year in hash order (the same on every run and for every dealing of rows).

    Hashes are uniform, so a year's rows are cut before the shuffle at a hash that keeps little more than
    ``per_year`` of them; a year where that cut, once counted, keeps too few rows is not cut.
    """
    d = df.withColumns({"_y": year, "_h": hash_text(key)}).withColumn("_x", hash_number(F.col("_h")))
    wide = per_year + 8 * per_year ** 0.5 + 16
    cut = (F.lit(float(1 << 32)) * F.lit(wide) / F.count(F.lit(1))).alias("_cut")
    sized = cut_lineage(d.groupBy(F.col("_y").alias("_z")).agg(F.count(F.lit(1)).alias("_n"), cut))
    same = F.col("_y").eqNullSafe(F.col("_z"))
    under = d.join(F.broadcast(sized), same).where("_x <= _cut")  # a row per year
    enough = under.groupBy("_y").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n")).where(F.col("_k") >= F.least(F.col("_n"), F.lit(per_year)))
    cuts = cut_lineage(sized.join(enough.select("_y", F.lit(True).alias("_ok")), same, "left").select("_z", F.when(F.col("_ok"), F.col("_cut")).alias("_cut")))
    kept = d.join(F.broadcast(cuts), same).where("_cut is null or _x <= _cut").drop("_z", "_cut", "_x")
    return ranks.top_n(kept, ["_y"], [F.col("_h"), *[F.col(k) for k in key]], per_year, key[0], "_rk").drop("_y", "_h", "_rk")


def whole_key_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """All rows of a hash-chosen share of the keys; no shuffle."""
    return df.where(F.pmod(hash_number(hash_text([key])), F.lit(10_000)) < int(fraction * 10_000))


# ---- sentiment roll-ups --------------------------------------------------------------


def sentiment_aggregate(posts: DataFrame, key: str, score: str, weight: str, first: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Weighted mean, sign shares and spread per key; short histories take the preset share."""
    rows = posts
    if first:
        rows = ranks.top_n(posts, [key], [F.col(o) for o in order], first, key, "_rk")
    s, w = F.col(score), F.col(weight)
    a = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("post_count"), F.try_divide(F.sum(s * w), F.sum(w)).alias("_ws"), F.avg(s).alias("sentiment_mean"),
        F.stddev_pop(s).alias("sentiment_std"), F.avg((s < -0.15).cast("double")).alias("_neg"), F.avg((s > 0.15).cast("double")).alias("positive_ratio"),
        F.avg(w).alias("importance_mean"))
    few = F.col("post_count") < 8
    return a.withColumns({
        "weighted_sentiment": F.when(few, 0.0).otherwise(bound(F.coalesce("_ws", "sentiment_mean"), -1.0, 1.0)),
        "negative_ratio": F.when(few, 0.42).otherwise(F.col("_neg")),
    }).withColumn("veto", F.col("negative_ratio") > 0.48).drop("_ws", "_neg")


def sector_sentiment(df: DataFrame, anchors: DataFrame, detail: DataFrame) -> DataFrame:
    """Anchor sentiment rolled up per (date, industry), standardised across industries,
    ranked and mapped back; names without industry keep their own values."""
    a = anchors.select("trade_date", "industry", "ts_code").join(detail, "ts_code", "left")
    g = a.groupBy("trade_date", "industry").agg(
        F.avg(F.coalesce("weighted_sentiment", F.lit(0.0))).alias("_s"), F.avg(F.coalesce("negative_ratio", F.lit(0.0))).alias("_neg"),
        F.count_if(F.coalesce("veto", F.lit(False))).alias("_v"), F.count(F.lit(1)).alias("_n"))
    g = join_stats(g, DATE, {"_m": F.avg("_s"), "_sd": F.stddev_pop("_s"), "_k": F.count(F.lit(1))}, ranks.WINDOW_ROWS)
    z = F.when(F.col("_k") < 3, F.col("_s")).when(F.col("_sd") > TINY, bound((F.col("_s") - F.col("_m")) / (F.col("_sd") + TINY), -3.0, 3.0)).otherwise(0.0)
    need = F.greatest(F.lit(1), F.ceil(F.col("_n") / 2))
    g = g.withColumns({"_z": z, "_veto": F.col("_v") >= need})
    g = join_stats(g, DATE, {"_lo": F.min("_z"), "_hi": F.max("_z")}, ranks.WINDOW_ROWS)
    g = g.select("trade_date", "industry", "_z", "_neg", "_veto", ((F.col("_z") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + TINY)).alias("_rank"))
    own = detail.select("ts_code", F.col("weighted_sentiment").alias("_os"), F.col("negative_ratio").alias("_on"), F.col("veto").alias("_ov"))
    j = df.join(g, ["trade_date", "industry"], "left").join(own, "ts_code", "left")
    lone = is_blank("industry", unknown_too=True)
    mix = lambda mine, group, d: F.coalesce(F.when(lone, F.col(mine)).otherwise(F.col(group)), F.lit(d))
    return j.withColumns({
        "nlp_score": mix("_os", "_z", 0.0), "sector_negative_ratio": mix("_on", "_neg", 0.0), "veto": mix("_ov", "_veto", False),
        "industry_sentiment_rank": F.coalesce("_rank", F.lit(0.5))}).drop("_z", "_neg", "_veto", "_rank", "_os", "_on", "_ov")


def sentiment_factors(daily: DataFrame, key: str = "ts_code", day: str = "trade_date") -> DataFrame:
    """Change over the last seven records, spike flag and z columns per key and date."""
    s = Series(key, day)
    d = daily.withColumns({
        "sentiment_momentum": F.coalesce(F.col("sentiment") - F.first("sentiment").over(s.frame(-6)), F.lit(0.0)),
        "sentiment_spike": (F.abs("sentiment") > 0.7).cast("int")})
    d = join_stats(d, [day], {"_m": F.avg("sentiment"), "_s": F.stddev_samp("sentiment")}, None)
    return d.withColumn("sentiment_z", F.when(F.col("_s") > TINY, (F.col("sentiment") - F.col("_m")) / (F.col("_s") + TINY))).drop("_m", "_s")
