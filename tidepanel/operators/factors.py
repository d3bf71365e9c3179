"""Per-entity time-series factors as window expressions.

Stages share one window specification each, so Spark plans a single exchange on the
entity key for the whole panel. Null closes are rejected at ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_positive, special_treatment
from . import ranks
from .windows import PANEL as W
from .windows import Series, above, clip, ewm, flag, run_lengths

TINY = 1e-9
#: Rows of a task that computes all series, about 1 GB of its memory; a task needs seconds to warm up, so more tasks take longer.
SERIES_ROWS = 250_000
KEEP_NULL = {"ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount", "name", "industry"}


def _ratio(a: Column, b: Column) -> Column:
    return a / (b + TINY)


def returns(df: DataFrame) -> DataFrame:
    """Momentum over 1/5/20/60 rows and the two reversal factors."""
    df = df.withColumns({f"pmt_return_{n}d": W.pct_change("close", n) for n in (1, 5, 20, 60)})
    return df.withColumns({
        "rev_5d_reversal": -F.col("pmt_return_5d"),
        "rev_1d_reversal": -F.col("pmt_return_1d"),
    })


def volume_price(df: DataFrame) -> DataFrame:
    """Volume and amount against their previous 20- and 5-row means, turnover, sign product."""
    df = df.withColumns({
        "vol_ratio_raw": _ratio(F.col("vol"), W.roll_prev(F.avg, "vol", 20, 5)),
        "vol_amount_ratio": _ratio(F.col("amount"), W.roll_prev(F.avg, "amount", 20, 5)),
        "vol_ratio_5d": _ratio(F.col("vol"), W.roll_prev(F.avg, "vol", 5, 3)),
        "amount_ratio_5d": _ratio(F.col("amount"), W.roll_prev(F.avg, "amount", 5, 3)),
        "vol_price_corr": F.signum(W.pct_change("close")) * F.signum(W.pct_change("vol")),
    })
    if "turnover_rate" in df.columns:
        turn = F.coalesce(F.col("turnover_rate"), F.lit(0.0))
        df = df.withColumn("vol_turnover", turn)
        df = df.withColumn("turnover_mean_5d", W.roll(F.avg, "vol_turnover", 5, 3))
    else:
        df = df.withColumns({
            "vol_turnover": F.coalesce(F.col("vol_ratio_raw"), F.lit(1.0)),
            "turnover_mean_5d": F.lit(0.0),
        })
    return df


def valuation(df: DataFrame) -> DataFrame:
    return df.withColumns({"fund_pb": F.col("pb"), "fund_pe": clip(F.col("pe"), -100.0, 200.0)})


def size(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Log market value (gaps take the global median) and its reversed rank per date."""
    whole = df.select("total_mv", F.lit(1).alias("_all"))
    mid = ranks.quantiles(whole, ["_all"], {"_mid": ("total_mv", 0.5)}, group_rows=ranks.WINDOW_ROWS + 1)
    df = df.withColumn("size_mkt_cap_log", F.log1p(F.coalesce(F.col("total_mv"), mid.select("_mid").scalar(), F.lit(1e5))))
    df = ranks.average_ranks(df, ["trade_date"], {"_size_rank": "size_mkt_cap_log"}, group_rows)
    return df.withColumn("size_score", F.lit(1.0) - F.col("_size_rank")).drop("_size_rank")


def latest_size_score(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Size score of the newest date mapped back onto every row of the entity (else 0.5)."""
    snap = latest_section(df).select("ts_code", "trade_date", "size_mkt_cap_log")
    snap = ranks.average_ranks(snap, ["trade_date"], {"_r": "size_mkt_cap_log"}, group_rows)
    snap = snap.select("ts_code", (F.lit(1.0) - F.col("_r")).alias("_score"))
    df = df.join(snap, "ts_code", "left")
    return df.withColumn("size_score", F.coalesce("_score", F.lit(0.5))).drop("_score")


def latest_section(df: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Rows of the newest date, which comes as a scalar subquery.

    ``dates`` is a cheap source of the dates (the base panel) when ``df`` is a deep plan.
    """
    newest = (df if dates is None else dates).agg(F.max("trade_date").alias("newest"))
    return df.where(F.col("trade_date") == newest.scalar())


def volatility(df: DataFrame) -> DataFrame:
    if "pmt_return_1d" not in df.columns:
        df = df.withColumn("pmt_return_1d", W.pct_change("close"))
    df = df.withColumns({
        "volat_hist_20d": W.roll(F.stddev_samp, "pmt_return_1d", 20, 5),
        "volat_hist_5d": W.roll(F.stddev_samp, "pmt_return_1d", 5, 3),
    })
    return df.withColumn("volat_ratio", _ratio(F.col("volat_hist_5d"), F.col("volat_hist_20d")))


def illiquidity(df: DataFrame) -> DataFrame:
    """Absolute return per hundred million of turnover, its mean, and its damped inverse."""
    if "pmt_return_1d" not in df.columns:
        df = df.withColumn("pmt_return_1d", W.pct_change("close"))
    df = df.withColumn("_amt", F.nullif(F.col("amount") / 1e8, F.lit(0.0)))
    df = df.withColumn("amihud_illiq", _ratio(F.abs("pmt_return_1d"), W.ffill("_amt")))
    df = df.withColumn("amihud_illiq_20d", W.roll(F.avg, "amihud_illiq", 20, 5))
    return df.withColumns({
        "liquidity_amihud": -F.log1p(clip(F.col("amihud_illiq_20d"), 0.0, 10.0)),
        "liquidity_score": F.log1p(W.roll(F.avg, "amount", 20, 5)),
    }).drop("_amt")


def moving_averages(df: DataFrame) -> DataFrame:
    df = df.withColumns({f"ma{n}": W.roll(F.avg, "close", n) for n in (5, 10, 20, 60)})
    ma5, ma10, ma20 = F.col("ma5"), F.col("ma10"), F.col("ma20")
    bull = above(ma5, ma10) & above(ma10, ma20)
    bear = above(ma10, ma5) & above(ma20, ma10)
    df = df.withColumns({"ma_bull": flag(bull), "ma_bear": flag(bear)})
    return df.withColumns({
        "ma_trend_score": F.col("ma_bull") - F.col("ma_bear"),
        "ma20_distance": _ratio(F.col("close") - F.col("ma20"), F.col("ma20")),
        "ma60_distance": _ratio(F.col("close") - F.col("ma60"), F.col("ma60")),
    })


def macd(df: DataFrame, series: Series = W, price: str = "close") -> DataFrame:
    df = ewm(df, series, {"_e12": (price, 2 / 13), "_e26": (price, 2 / 27)})
    df = df.withColumn("macd", F.col("_e12") - F.col("_e26")).drop("_e12", "_e26")
    df = ewm(df, series, {"macd_signal": ("macd", 0.2)})
    return df.withColumns({
        "macd_hist": F.col("macd") - F.col("macd_signal"),
        "macd_golden": flag(F.col("macd") > F.col("macd_signal")),
    })


def _stochastic_inputs(df: DataFrame) -> DataFrame:
    df = df.withColumns({"_lo9": W.roll(F.min, "low", 9), "_hi9": W.roll(F.max, "high", 9)})
    return df.withColumns({
        "_rsv": _ratio(F.col("close") - F.col("_lo9"), F.col("_hi9") - F.col("_lo9")) * 100,
        "wr": -100 * _ratio(F.col("_hi9") - F.col("close"), F.col("_hi9") - F.col("_lo9")),
    }).drop("_lo9", "_hi9")


def _stochastic_flags(df: DataFrame) -> DataFrame:
    df = df.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d"))
    gap = F.round(F.col("kdj_k") - F.col("kdj_d"), 9)
    cross = (gap > 0) & (W.lag(gap) <= 0) & (F.col("kdj_k") < 50)
    return df.withColumns({
        "kdj_oversold": flag(F.col("kdj_j") < 20),
        "kdj_overbought": flag(F.col("kdj_j") > 80),
        "kdj_low_golden": flag(cross),
        "wr_oversold": flag(F.col("wr") < -80),
    }).drop("_rsv")


def kdj(df: DataFrame) -> DataFrame:
    """Stochastic lines, partitioned by entity, and the low golden cross."""
    df = ewm(_stochastic_inputs(df), W, {"kdj_k": ("_rsv", 1 / 3)})
    return _stochastic_flags(ewm(df, W, {"kdj_d": ("kdj_k", 1 / 3)}))


def _gain_loss(df: DataFrame) -> DataFrame:
    df = df.withColumn("_chg", F.col("close") - W.lag("close"))
    return df.withColumns({"_gain": clip(F.col("_chg"), lo=0.0), "_loss": clip(-F.col("_chg"), lo=0.0)})


def _strength_flags(df: DataFrame) -> DataFrame:
    df = df.withColumn("rsi", 100 - 100 / (1 + _ratio(F.col("_ag"), F.col("_al"))))
    df = df.withColumns({"_low20": W.roll(F.min, "close", 20, 5), "_rlow5": W.roll(F.min, "rsi", 5, 3)})
    diverges = (F.col("close") == F.col("_low20")) & (F.col("rsi") > F.col("_rlow5") + 5)
    return df.withColumns({
        "rsi_oversold": flag(F.col("rsi") < 30),
        "rsi_overbought": flag(F.col("rsi") > 70),
        "rsi_divergence": flag(diverges),
    }).drop("_chg", "_gain", "_loss", "_ag", "_al", "_low20", "_rlow5")


def rsi(df: DataFrame) -> DataFrame:
    """Exponential RSI(14) and the price-low divergence."""
    return _strength_flags(ewm(_gain_loss(df), W, {"_ag": ("_gain", 1 / 14), "_al": ("_loss", 1 / 14)}, alike={"_loss": "_gain"}))


def oscillators(df: DataFrame) -> DataFrame:
    """MACD, stochastic lines and RSI together: their recursive means share two passes."""
    df = ewm(_gain_loss(_stochastic_inputs(df)), W, {
        "_e12": ("close", 2 / 13), "_e26": ("close", 2 / 27), "kdj_k": ("_rsv", 1 / 3),
        "_ag": ("_gain", 1 / 14), "_al": ("_loss", 1 / 14)}, alike={"_loss": "_gain"})
    df = df.withColumn("macd", F.col("_e12") - F.col("_e26")).drop("_e12", "_e26")
    df = ewm(df, W, {"macd_signal": ("macd", 0.2), "kdj_d": ("kdj_k", 1 / 3)})
    df = df.withColumns({
        "macd_hist": F.col("macd") - F.col("macd_signal"),
        "macd_golden": flag(F.col("macd") > F.col("macd_signal")),
    })
    return _strength_flags(_stochastic_flags(df))


def bollinger(df: DataFrame) -> DataFrame:
    if "ma20" not in df.columns:
        df = df.withColumn("ma20", W.roll(F.avg, "close", 20))
    df = df.withColumn("_sd20", W.roll(F.stddev_samp, "close", 20, 5))
    df = df.withColumns({
        "boll_upper": F.col("ma20") + 2 * F.col("_sd20"),
        "boll_lower": F.col("ma20") - 2 * F.col("_sd20"),
    })
    df = df.withColumn(
        "boll_position",
        (F.col("close") - F.col("boll_lower")) / (F.col("boll_upper") - F.col("boll_lower") + TINY),
    )
    return df.withColumns({
        "near_boll_lower": flag(F.col("boll_position") < 0.2),
        "boll_squeeze": flag(_ratio(F.col("_sd20"), F.col("ma20")) < 0.02),
    }).drop("_sd20")


def price_position(df: DataFrame) -> DataFrame:
    """Place of the close inside its 60- and 5-row range, five-row drawdown."""
    def place(n, m):
        lo, hi = W.roll(F.min, "close", n, m), W.roll(F.max, "close", n, m)
        return _ratio(F.col("close") - lo, hi - lo)

    hi5, lo5 = W.roll(F.max, "high", 5, 3), W.roll(F.min, "low", 5, 3)
    df = df.withColumns({
        "price_position_60d": place(60, 10),
        "price_position_5d": place(5, 3),
        "drawdown_5d": clip(_ratio(F.col("close"), hi5) - 1.0, -1.0, 0.0),
        "range_position_5d": _ratio(F.col("close") - lo5, hi5 - lo5),
    })
    return df.withColumn("in_bottom_zone", flag(F.col("price_position_60d") < 0.2))


def composites(df: DataFrame) -> DataFrame:
    """Acceleration, oversold blend, reversal signal and the interaction factors."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    oversold = sum(F.col(c) for c in ("kdj_oversold", "rsi_oversold", "wr_oversold", "near_boll_lower")) / 4.0
    df = df.withColumns({
        "return_accel_5d": zero("pmt_return_5d") - zero("pmt_return_20d") / 4.0,
        "multi_oversold_flag": oversold,
    })
    volume = F.coalesce(F.col("vol_ratio_raw"), F.lit(1.0))
    return df.withColumns({
        "reversal_signal": flag(
            (F.col("multi_oversold_flag") > 0.5) & (volume > 1.5) & (zero("pmt_return_5d") < -0.05)
        ),
        "small_cap_momentum": F.col("size_score") * zero("pmt_return_20d"),
        "oversold_volume_flag": F.col("multi_oversold_flag") * volume,
        "low_pb_reversal": flag((F.coalesce("fund_pb", F.lit(99.0)) < 2.0) & (F.col("near_boll_lower") > 0)),
    })


def pledge_snapshot(pledges: DataFrame) -> DataFrame:
    """Newest pledge ratio per entity, clipped to 0..100."""
    held = F.coalesce(F.col("unrest_pledge"), F.lit(0.0)) + F.coalesce(F.col("rest_pledge"), F.lit(0.0))
    ratio = F.coalesce(clip(F.try_divide(held, F.col("total_share")) * 100, 0.0, 100.0), F.lit(0.0))
    return pledges.withColumn("_ratio", ratio).groupBy("ts_code").agg(
        F.max_by("_ratio", F.struct("end_date", "_ratio")).alias("pledge_ratio")
    )


def risk_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "risk_pledge": flag(F.col("pledge_ratio") > 30),
        "risk_pledge_high": flag(F.col("pledge_ratio") > 60),
        "risk_st": flag(special_treatment("name")),
        "risk_delist_score": flag(F.col("de_listed_date").isNotNull())
        if "de_listed_date" in df.columns else F.lit(0.0),
    })


def fill_numeric(df: DataFrame) -> DataFrame:
    """Null factors become 0; keys, prices and texts keep their nulls."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in KEEP_NULL]
    return df.fillna(0.0, subset=numeric)


def series_tasks(df: DataFrame) -> int:
    """Tasks for the series of a (stored) panel: as many as there are cores, more beyond ``SERIES_ROWS`` rows each."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SERIES_ROWS))


def rule_factors(df: DataFrame, group_rows: int | None = None, enrich=None, tasks: int | None = None) -> DataFrame:
    """The full factor panel. ``enrich`` adds the flow, limit and favourite columns (one row per
    entity each) after the series are done, so a filter on dates still comes before its joins.
    ``tasks`` is the number of tasks that the series are dealt over; without it the planner takes few."""
    df = size(df, group_rows)
    df = df.repartition(tasks, "ts_code") if tasks else df
    for step in (returns, volume_price, valuation, volatility, illiquidity, moving_averages,
                 oscillators, bollinger, price_position):
        df = step(df)
    df = risk_flags(composites(df))
    df = enrich(df) if enrich else df
    absent = [c for c in ("mf_net_main", "mf_main_ratio", "sent_limit_gene", "sent_limit_active", "sent_hsgt_fav")
              if c not in df.columns]
    return fill_numeric(df.withColumns({c: F.lit(0.0) for c in absent}))


def forward_returns(df: DataFrame, horizons=(5, 10, 20)) -> DataFrame:
    return df.withColumns({f"future_ret_{n}d": W.forward_return("close", n) for n in horizons})


def lagged(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({f"{c}_lag1": W.lag(c) for c in cols})


def fill_series(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: W.ffill_bfill(c) for c in cols})


def strategy_history(df: DataFrame) -> DataFrame:
    """History features of the rule strategies: averages, limit-up memory, market value."""
    if "pct_chg" not in df.columns:
        df = df.withColumn("pct_chg", W.pct_change("close") * 100)
    df = df.withColumn("pct_chg", F.coalesce("pct_chg", F.lit(0.0)))
    df = df.withColumns({
        "ma5": W.roll(F.avg, "close", 5, 3), "ma10": W.roll(F.avg, "close", 10, 5),
        "ma20": W.roll(F.avg, "close", 20, 10), "high20": W.roll(F.max, "high", 20, 10),
        "avg_amount20": W.roll(F.avg, "amount", 20, 5),
        "prev_pct_chg": F.coalesce(W.lag("pct_chg"), F.lit(0.0)),
        "is_limit_up": F.col("pct_chg") >= 9.5,
        "return_5d": F.coalesce(W.pct_change("close", 5), F.lit(0.0)) * 100,
        "return_20d": F.coalesce(W.pct_change("close", 20), F.lit(0.0)) * 100,
    })
    hit = F.col("is_limit_up").cast("long")
    df = df.withColumns({
        "prev_limit_up": F.coalesce(W.lag("is_limit_up"), F.lit(False)),
        **{f"limit_up_{n}d": W.roll(F.sum, hit, n) for n in (5, 10, 20, 30)},
        "volume_ratio": F.when(F.col("avg_amount20") > 0, F.col("amount") / F.col("avg_amount20")).otherwise(1.0),
    })
    caps = [c for c in ("circ_mv", "float_mv", "total_mv") if c in df.columns]
    flat = [F.round(c, 3) == F.round("close", 3) for c in ("open", "high", "low")]
    return df.withColumns({
        "market_value_yi": first_positive(caps) / 10000 if caps else F.lit(0.0),
        "one_word_limit": F.coalesce(flat[0] & flat[1] & flat[2], F.lit(False)),
    })


def momentum_exposure(df: DataFrame) -> DataFrame:
    """Style exposures: summed lagged returns, log size, inverse book multiple."""
    df = df.withColumn("_ret", W.pct_change("close"))
    df = df.withColumn("_ret1", W.lag("_ret"))
    return df.withColumns({
        "factor_mom": W.roll(F.sum, "_ret1", 20, 5),
        "factor_sze": F.when(F.col("total_mv") > 0, F.log("total_mv")),
        "factor_val": 1.0 / F.greatest(F.col("pb"), F.lit(0.1)),
    }).drop("_ret", "_ret1")


def small_cap_series(df: DataFrame) -> DataFrame:
    df = df.withColumns({f"ret_{n}": W.pct_change("close", n) for n in (5, 10, 20, 60)})
    df = df.withColumn("_r1", W.pct_change("close"))
    return df.withColumns({
        "volume_ma20": W.roll(F.avg, "vol", 20),
        "volatility_20d": W.roll(F.stddev_samp, "_r1", 20, 5),
    }).drop("_r1")


def liquidity_check(df: DataFrame, position_size: float, share: float = 0.05) -> DataFrame:
    """Is a position below ``share`` of the mean amount of the last 20 rows?"""
    df = df.withColumn("avg_amount", W.roll(F.avg, "amount", 20, 5))
    return df.withColumn("tradable", F.coalesce(F.lit(position_size) <= F.col("avg_amount") * share, F.lit(False)))


# ---- per-date market statistics ------------------------------------------------------


def _with_previous(df: DataFrame) -> DataFrame:
    df = df.withColumn("prev_close", W.lag("close"))
    return df.where(F.col("prev_close").isNotNull() & (F.col("prev_close") > 0))


def daily_breadth(df: DataFrame) -> DataFrame:
    """Share of entities that closed above their previous close."""
    up = (F.col("close") > F.col("prev_close")).cast("double")
    return _with_previous(df).groupBy("trade_date").agg(F.avg(up).alias("up_ratio"))


def limit_statistics(df: DataFrame, limit: float = 0.097) -> DataFrame:
    chg = F.col("close") / F.col("prev_close") - 1
    return _with_previous(df).withColumn("chg", chg).groupBy("trade_date").agg(
        F.count_if(F.col("chg") >= limit).alias("limit_up"),
        F.count_if(F.col("chg") <= -limit).alias("limit_down"),
        F.avg((F.col("chg") > 0).cast("double")).alias("up_ratio"),
    )


def overnight_gap(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Median of open over previous close per date."""
    gaps = _with_previous(df).withColumn("_gap", F.col("open") / F.col("prev_close") - 1)
    return ranks.quantiles(gaps, ["trade_date"], {"gap": ("_gap", 0.5)}, group_rows)


def limit_pool_emotion(pool: DataFrame) -> DataFrame:
    """Per day: pool size, opened boards and their rate, highest run of boards."""
    opened = F.count_if(F.coalesce(F.col("open_times"), F.lit(0.0)) > 0)
    return pool.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("zt"), opened.alias("zb"),
        F.coalesce(F.max("limit_times"), F.lit(0.0)).cast("long").alias("max_lb"),
    ).withColumn("zha_rate", F.round(F.col("zb") / F.greatest(F.col("zt"), F.lit(1)), 3))


def board_breadth(df: DataFrame, code: str = "ts_code", pct: str = "pct_chg") -> DataFrame:
    """Advance/decline and limit counts; main-board codes move 9.9 %, others 19.9 %."""
    main = F.col(code).rlike("^(60|00)")
    cap = F.when(main, 9.9).otherwise(19.9)
    return df.groupBy("trade_date").agg(
        F.count_if(F.col(pct) > 0).alias("up"), F.count_if(F.col(pct) < 0).alias("down"),
        F.count_if(F.col(pct) >= cap).alias("limit_up"), F.count_if(F.col(pct) <= -cap).alias("limit_down"),
        F.sum("amount").alias("amount"),
    )


# ---- series features -----------------------------------------------------------------


def index_features(df: DataFrame, key: str, order: str, price: str, amount: str | None = None) -> DataFrame:
    """Feature vector of a close series (returns, range positions, volatility, RSI, MACD)."""
    s = Series(key, order)
    df = df.withColumn("_r", s.pct_change(price))
    df = df.withColumn("_d", F.col(price) - s.lag(price))
    df = macd(df, s, price)
    px = F.col(price)

    def position(n):
        lo, hi = F.min(price).over(s.frame(-(n - 1))), F.max(price).over(s.frame(-(n - 1)))
        return (px - lo) / F.greatest(hi - lo, F.lit(TINY)) * 100

    gain = F.sum(F.greatest(F.col("_d"), F.lit(0.0))).over(s.frame(-13)) / 14
    loss = F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(s.frame(-13)) / 14
    ma = {n: F.avg(price).over(s.frame(-(n - 1))) for n in (5, 20, 60)}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = {
        **{f"r{n}": zero(s.pct_change(price, n) * 100) for n in (1, 5, 20, 60)},
        "r120": zero(s.pct_change(price, 121) * 100),
        "pos60": position(60),
        "pos250": F.when(F.count(price).over(s.frame(-249)) >= 250, position(250)).otherwise(50.0),
        "vol20": F.stddev_pop("_r").over(s.frame(-19)) * 100,
        "rsi14": 100 - 100 / (1 + F.when(gain == 0, TINY).otherwise(gain) / F.when(loss == 0, TINY).otherwise(loss)),
        "hist_sign": F.when(F.col("macd_hist") > 0, 1.0).otherwise(-1.0),
        "ma_align": F.when((ma[5] > ma[20]) & (ma[20] > ma[60]), 1.0)
        .when((ma[5] < ma[20]) & (ma[20] < ma[60]), -1.0).otherwise(0.0),
    }
    if amount:
        a5, a20 = F.avg(amount).over(s.frame(-4)), F.avg(amount).over(s.frame(-19))
        out["amt_ratio"] = F.when(a20 > 0, a5 / a20).otherwise(1.0)
    return df.withColumns(out).drop("_r", "_d", "macd", "macd_signal", "macd_hist", "macd_golden")


def technical_states(df: DataFrame, key: str, order: str, price: str) -> DataFrame:
    """MACD state, average alignment and momentum quality as labels."""
    s = Series(key, order)
    df = macd(df, s, price)
    df = df.withColumn("_bar", F.col("macd_hist") * 2)
    now, prev = F.col("_bar"), s.lag("_bar")
    ma = {n: F.avg(price).over(s.frame(-(n - 1))) for n in (5, 20, 60)}
    back5, back20 = s.lag(price, 5), s.pct_change(price, 20)
    return df.withColumns({
        "macd_state": F.when((now > 0) & (prev <= 0), "golden").when((now <= 0) & (prev > 0), "dead")
        .when(now > 0, "long").otherwise("short"),
        "ma_state": F.when((ma[5] > ma[20]) & (ma[20] > ma[60]), "bull")
        .when((ma[5] < ma[20]) & (ma[20] < ma[60]), "bear").otherwise("mixed"),
        "momentum_state": F.when((F.col(price) > back5) & (back20 > 0), "rising")
        .when(F.col(price) <= back5, "fading").otherwise("mild"),
    }).drop("_bar", "macd", "macd_signal", "macd_hist", "macd_golden")


def trend_features(df: DataFrame, key: str, order: str, price: str) -> DataFrame:
    """Long trends, breakout of the previous 20 rows, share of rising rows so far (130 rows)."""
    s = Series(key, order)
    up = F.when(F.col(price) > s.lag(price), 1.0).when(s.lag(price).isNotNull(), 0.0)
    df = df.withColumn("_up", up)
    return df.withColumns({
        "trend_120": F.round(s.pct_change(price, 120) * 100, 2),
        "trend_250": F.round(s.pct_change(price, 250) * 100, 2),
        "breakout_20": F.col(price) >= F.max(price).over(s.frame(-20, -1)),
        "base_up_prob": F.round(F.avg("_up").over(s.frame(-128)) * 100, 1),
    }).drop("_up")


def sentiment_composite(up_ratio: Column, lu: Column, ld: Column, vol_ratio: Column, margin_chg: Column) -> Column:
    """Market mood in -100..100 from breadth, limit counts, volume and margin change."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))
    part = lambda w, ok, c: F.when(ok, w * unit(c)).otherwise(0.0)
    score = (
        part(60.0, up_ratio.isNotNull(), (up_ratio - 0.5) / 0.15)
        + part(20.0, lu.isNotNull() & (ld > 0), (lu - ld) / F.greatest(F.lit(20.0), lu + ld))
        + part(10.0, vol_ratio.isNotNull() & (vol_ratio != 0), (vol_ratio - 1.0) / 0.25)
        + part(10.0, margin_chg.isNotNull(), margin_chg / 3.0)
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(-100.0), score))


def band_label(c: Column, lo: float, hi: float, low: str, high: str, mid: str = "neutral") -> Column:
    """Three-way label of a number by two thresholds; null stays null."""
    return F.when(c.isNull(), None).when(c <= lo, low).when(c >= hi, high).otherwise(mid)


# ---- calendar ------------------------------------------------------------------------

# The century constants of the two solar terms of each month (21st century).
SOLAR_CONSTANTS = (
    (5.4055, 20.12), (3.87, 18.73), (5.63, 20.646), (4.81, 20.1),
    (5.52, 21.04), (5.678, 21.37), (7.108, 22.83), (7.5, 23.13),
    (7.646, 23.042), (8.318, 23.438), (7.438, 22.36), (7.18, 21.94),
)


def solar_terms(spark, first_year: int, last_year: int) -> DataFrame:
    """Generated dimension of the 24 solar-term dates per year (term number 0..23)."""
    terms = F.array(*[F.struct(F.lit(m).alias("month"), F.lit(m * 2 - 2 + i).alias("term"), F.lit(c).alias("c"))
                      for m, pair in enumerate(SOLAR_CONSTANTS, 1) for i, c in enumerate(pair)])
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"), F.explode(terms).alias("t"))
    years = years.select("year", "t.*")
    y = F.col("year") % 100
    leap = F.when(F.col("month") <= 2, F.floor((y - 1) / 4)).otherwise(F.floor(y / 4))
    day = (F.floor(y * 0.2422 + F.col("c")) - leap).cast("int")
    return years.select("term", F.make_date("year", "month", day).alias("term_date"))


def calendar_cycles(df: DataFrame, day: str) -> DataFrame:
    """Sixty-day and sixty-year cycle numbers (year turns on 4 February) and weekday."""
    d = F.col(day)
    early = (F.month(d) < 2) | ((F.month(d) == 2) & (F.dayofmonth(d) < 4))
    year = F.year(d) - F.when(early, 1).otherwise(0)
    return df.withColumns({
        "day_cycle": F.pmod(F.datediff(d, F.lit("1949-10-01").cast("date")), F.lit(60)),
        "year_cycle": F.pmod(year - 1984, F.lit(60)),
        "weekday": F.weekday(d) + 1,
    })


def solar_position(days: DataFrame, day: str, terms: DataFrame) -> DataFrame:
    """Current and next solar term per day: days in, days to go, progress.

    Terms are turned into half-open intervals and exploded to one row per day (a generated
    calendar), so the lookup is an equi-join.
    """
    w = Window.orderBy("term_date")
    spans = terms.withColumns({
        "next_date": F.lead("term_date").over(w), "next_term": F.lead("term").over(w),
    }).where(F.col("next_date").isNotNull())
    spans = spans.withColumn(day, F.explode(F.sequence("term_date", F.date_sub("next_date", 1))))
    spans = spans.withColumns({
        "days_in": F.datediff(F.col(day), F.col("term_date")) + 1,
        "days_to_next": F.datediff("next_date", F.col(day)),
    })
    spans = spans.withColumn("progress", F.round(F.least(F.lit(1.0), (F.col("days_in") - 1) / 15.2), 2))
    return days.join(spans.select(day, "term", "next_term", "days_in", "days_to_next", "progress"), day, "left")


# ---- streaks, bars, adjusted prices --------------------------------------------------


def inflow_streak(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per row: length of the current positive run, 0 on other rows."""
    s = Series(key, order)
    df = run_lengths(df, s, (F.col(value) > 0).cast("int"), "_run")
    return df.withColumn("streak", F.when(F.col(value) > 0, F.col("_run")).otherwise(0)).drop("_run")


def signed_streak(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Signed length of the run that ends at each row; a zero ends every run."""
    s = Series(key, order)
    sign = F.signum(F.col(value)).cast("int")
    df = run_lengths(df, s, sign, "_run")
    return df.withColumn("signed_streak", (F.col("_run") * sign).cast("long")).drop("_run")


def sector_features(df: DataFrame, key: str, order: str, chg: str, amount: str) -> DataFrame:
    """Sector momentum, amount ratio and the next-row direction label."""
    s = Series(key, order)
    base = F.avg(amount).over(s.frame(-19))
    return df.withColumns({
        "mom5": F.avg(chg).over(s.frame(-4)),
        "amt_ratio": F.when(base > 0, F.avg(amount).over(s.frame(-4)) / base).otherwise(1.0),
        "up_next": F.when(s.lead(chg).isNotNull(), flag(s.lead(chg) > 0)),
    })


def sector_breadth(df: DataFrame, industry: str = "industry") -> DataFrame:
    """Rising share per (date, group); groups without rows take the market's share."""
    rows = _with_previous(df).withColumn("_up", (F.col("close") > F.col("prev_close")).cast("double"))
    market = rows.groupBy("trade_date").agg(F.avg("_up").alias("market_up"))
    group = rows.groupBy("trade_date", industry).agg(F.avg("_up").alias("group_up"))
    grid = df.select("trade_date", industry).distinct()
    out = grid.join(group, ["trade_date", industry], "left").join(market, "trade_date", "left")
    return out.withColumn("breadth", F.coalesce("group_up", "market_up"))


def technical_profile(df: DataFrame) -> DataFrame:
    """Latest row per entity: MA5/20/60, 20-row change, distance to the 60-row extremes."""
    hi, lo = F.max("high").over(W.frame(-59)), F.min("low").over(W.frame(-59))
    out = df.withColumns({
        "ma5": W.roll(F.avg, "close", 5), "ma20": W.roll(F.avg, "close", 20), "ma60": W.roll(F.avg, "close", 60),
        "chg20": W.pct_change("close", 20) * 100,
        "off_high60": (F.col("close") / hi - 1) * 100, "off_low60": (F.col("close") / lo - 1) * 100,
        "_last": F.lead("trade_date").over(W.window).isNull(),
    })
    return out.where("_last").drop("_last")


def adjusted_prices(df: DataFrame, factor: str = "adj_factor") -> DataFrame:
    """Prices scaled to the latest factor of the entity, two places."""
    newest = df.groupBy("ts_code").agg(F.max_by(factor, "trade_date").alias("_latest"))
    df = df.join(newest, "ts_code")
    scale = F.try_divide(F.col(factor), F.col("_latest"))
    return df.withColumns({c: F.round(F.col(c) * scale, 2) for c in ("open", "high", "low", "close")}).drop("_latest")


def resample(df: DataFrame, unit: str) -> DataFrame:
    """Daily bars to weekly/monthly bars: first, max, min, last, sums."""
    return df.groupBy("ts_code", F.date_trunc(unit, "trade_date").cast("date").alias("bar")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"), F.sum("vol").alias("vol"), F.sum("amount").alias("amount"),
    )


def last_bars(df: DataFrame, n: int, key: str = "ts_code", order: str = "trade_date") -> DataFrame:
    """Last n rows per key; partitions are trimmed to n per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
