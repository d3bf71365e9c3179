"""Cross-sectional operators: one section = all entities of one date.

``group_rows`` is the measured size of the widest section. Small sections share one
exchange on the date for every statistic. Beyond ``ranks.WINDOW_ROWS``, or when the size
is unknown, means, deviations and bounds come from a grouped aggregate (map-side combine)
joined back, and ranks and quantiles from the value-split plans of ``ranks``; a deep input
is then materialised once. Results are per date; the newest date is the reference answer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, is_blank, special_treatment
from ..session import cut_lineage, dealt
from . import ranks
from .factors import latest_section
from .windows import clip, flag

TINY = 1e-9
DATE = ["trade_date"]

# The 2026 rule-factor weights (sign = direction).
RULE_WEIGHTS = {
    "pmt_return_5d": 15.0, "pmt_return_20d": 20.0, "pmt_return_60d": 12.0, "rev_5d_reversal": 8.0,
    "vol_ratio_raw": 10.0, "vol_turnover": 8.0, "fund_pb": -18.0, "fund_pe": -15.0, "size_score": 25.0,
    "size_mkt_cap_log": -5.0, "mf_net_main": 18.0, "mf_main_ratio": 12.0, "sent_limit_gene": 22.0,
    "sent_limit_active": 15.0, "sent_hsgt_fav": 20.0, "volat_hist_20d": -8.0, "risk_pledge": -15.0,
    "risk_pledge_high": -20.0, "risk_st": -25.0, "risk_delist_score": -30.0, "kdj_oversold": 10.0,
    "kdj_low_golden": 15.0, "rsi_oversold": 12.0, "rsi_divergence": 18.0, "wr_oversold": 8.0,
    "boll_position": -10.0, "near_boll_lower": 12.0, "multi_oversold_flag": 20.0, "reversal_signal": 25.0,
    "in_bottom_zone": 15.0, "price_position_60d": -30.0, "pmt_return_1d": 5.0, "liquidity_amihud": 8.0,
}


def join_stats(df: DataFrame, by: Sequence[str], aggs: dict[str, Column], group_rows: int | None = None) -> DataFrame:
    """Group aggregates on every row.

    A measured, small group stays in one window pass (no second scan of ``df``). Otherwise
    the rows are aggregated with map-side combine and joined back; null keys match.
    """
    if group_rows is not None and group_rows <= ranks.WINDOW_ROWS:
        w = Window.partitionBy(*by)
        return df.withColumns({n: c.over(w) for n, c in aggs.items()})
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    renamed = stats.select(*[F.col(k).alias(f"_k_{k}") for k in by], *aggs)
    cond = None
    for k in by:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return df.join(renamed, cond, "left").drop(*[f"_k_{k}" for k in by])


def z_scores(df: DataFrame, by: Sequence[str], cols: dict[str, str], ddof: int = 0, guard: bool = True,
             group_rows=None) -> DataFrame:
    """(x - mean) / std per group. ``guard``: 0 where std <= 1e-9; else std + 1e-9."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = {}
    for o, c in cols.items():
        aggs[f"_m_{o}"] = F.avg(c)
        aggs[f"_s_{o}"] = std(c)
    df = join_stats(df, by, aggs, group_rows)
    out = {}
    for o, c in cols.items():
        dev, sd = F.col(c) - F.col(f"_m_{o}"), F.col(f"_s_{o}")
        out[o] = F.when(sd > TINY, dev / sd).when(F.col(c).isNotNull(), 0.0) if guard else dev / (sd + TINY)
    return df.withColumns(out).drop(*aggs)


def min_max(df: DataFrame, by: Sequence[str], cols: dict[str, str], group_rows=None) -> DataFrame:
    aggs = {}
    for o, c in cols.items():
        aggs[f"_lo_{o}"], aggs[f"_hi_{o}"] = F.min(c), F.max(c)
    df = join_stats(df, by, aggs, group_rows)
    out = {o: (F.col(c) - F.col(f"_lo_{o}")) / (F.col(f"_hi_{o}") - F.col(f"_lo_{o}") + TINY) for o, c in cols.items()}
    return df.withColumns(out).drop(*aggs)


def score_band(df: DataFrame, by: Sequence[str], col: str, out: str, base: float = 60.0, span: float = 35.0,
               group_rows=None) -> DataFrame:
    """Min-max to ``base .. base+span``; a flat section takes the middle."""
    df = join_stats(df, by, {"_lo": F.min(col), "_hi": F.max(col), "_sd": F.stddev_pop(col)}, group_rows)
    mm = F.when(F.col("_sd") > TINY, (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + TINY)).otherwise(0.5)
    return df.withColumn(out, base + mm * span).drop("_lo", "_hi", "_sd")


def winsorize(df: DataFrame, by: Sequence[str], cols: Sequence[str], lo=0.01, hi=0.99, group_rows=None) -> DataFrame:
    specs = {}
    for c in cols:
        specs[f"_q1_{c}"], specs[f"_q9_{c}"] = (c, lo), (c, hi)
    df = df.join(ranks.quantiles(df, by, specs, group_rows), list(by), "left")
    clipped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, f"_q1_{c}"), F.col(f"_q9_{c}"))) for c in cols}
    return df.withColumns(clipped).drop(*specs)


def robust_z(df: DataFrame, by: Sequence[str], cols: dict[str, str], group_rows=None) -> DataFrame:
    """Winsorise 1/99 %, centre on the median, scale by IQR * 0.7413; mean/std if IQR is 0."""
    work = {f"_w_{o}": F.col(c) for o, c in cols.items()}
    df = winsorize(df.withColumns(work), by, list(work), group_rows=group_rows)
    specs, aggs = {}, {}
    for o in cols:
        for tag, q in (("m", 0.5), ("a", 0.25), ("b", 0.75)):
            specs[f"_{tag}_{o}"] = (f"_w_{o}", q)
        aggs[f"_mean_{o}"], aggs[f"_sd_{o}"] = F.avg(f"_w_{o}"), F.stddev_samp(f"_w_{o}")
    q = ranks.quantiles(df, by, specs, group_rows)
    df = join_stats(df.join(q, list(by), "left"), by, aggs, group_rows)
    out = {}
    for o in cols:
        w, iqr = F.col(f"_w_{o}"), F.col(f"_b_{o}") - F.col(f"_a_{o}")
        plain = F.when(F.col(f"_sd_{o}") > TINY, (w - F.col(f"_mean_{o}")) / F.col(f"_sd_{o}")).otherwise(w * 0)
        out[o] = F.when(iqr > TINY, (w - F.col(f"_m_{o}")) / (iqr * 0.7413)).otherwise(plain)
    return df.withColumns(out).drop(*work, *specs, *aggs)


def rank_labels(df: DataFrame, group_rows=None) -> DataFrame:
    """Training label: blended forward-return ranks mapped to -1..1."""
    horizons = {"cs5": ("future_ret_5d", 0.5), "cs10": ("future_ret_10d", 0.3), "cs20": ("future_ret_20d", 0.2)}
    df = ranks.average_ranks(df, DATE, {k: c for k, (c, _) in horizons.items()}, group_rows)
    blend = sum(F.coalesce(F.col(k), F.lit(0.5)) * w for k, (_, w) in horizons.items())
    return df.withColumn("label", (blend - 0.5) * 2)


def weighted_rank_score(df: DataFrame, weights: dict[str, float] | None = None, by=DATE, out="rule_raw",
                        group_rows=None) -> DataFrame:
    """Sum of factor ranks (reversed for negative weights); flat factors count 0.5.

    One unpivot makes narrow (section, factor) groups, so a section's factors are ranked in
    different tasks; sections beyond one task go through the value-split rank.
    """
    weights = weights or RULE_WEIGHTS
    total = sum(abs(w) for w in weights.values())
    used = [c for c in weights if c in df.columns]
    by = list(by)
    if group_rows is None:
        group_rows = ranks.widest_group(df, by)
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used})
    long = filled.select(
        *by, "ts_code",
        F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(f"_f_{c}").alias("x")) for c in used])).alias("_p"),
    ).select(*by, "ts_code", "_p.factor", "_p.x")
    if group_rows <= ranks.WINDOW_ROWS:
        long = dealt(long, *by, "factor")  # rows that lie by section would be ranked there, all factors in one task
    long = join_stats(long, [*by, "factor"], {"_s": F.stddev_pop("x")}, group_rows)
    long = ranks.average_ranks(long, [*by, "factor"], {"_r": "x"}, group_rows)
    w = F.create_map(*[F.lit(v) for c in used for v in (c, weights[c])])[F.col("factor")]
    r = F.when(F.col("_s") > TINY, F.col("_r")).otherwise(0.5)
    score = F.sum(F.when(w > 0, r).otherwise(1.0 - r) * F.abs(w) / total)
    scores = long.groupBy(*by, "ts_code").agg(score.alias(out))
    return df.join(scores, [*by, "ts_code"], "left")


def relax_if_few(df: DataFrame, keep: Column, at_least: int, by=DATE, group_rows=None) -> DataFrame:
    """Filter rows, but keep a whole section where fewer than ``at_least`` would survive."""
    df = join_stats(df.withColumn("_keep", F.coalesce(keep, F.lit(False))), by,
                    {"_n": F.sum(F.col("_keep").cast("long"))}, group_rows)
    return df.where(F.col("_keep") | (F.col("_n") < at_least)).drop("_keep", "_n")


def rule_selection(df: DataFrame, top_n: int = 100, group_rows=None) -> DataFrame:
    """Rank score -> 60..95 band -> risk filter with relaxation -> top names of each date."""
    if group_rows is None or group_rows > ranks.WINDOW_ROWS:
        df = cut_lineage(df)
    scored = score_band(weighted_rank_score(df, group_rows=group_rows), DATE, "rule_raw", "rule_score", group_rows=group_rows)
    safe = (F.col("risk_pledge_high") == 0) & (F.col("risk_st") == 0) & (F.col("risk_delist_score") == 0)
    kept = relax_if_few(scored, safe, top_n, group_rows=group_rows)
    return ranks.top_n(kept, DATE, [F.round("rule_score", 9).desc(), F.col("ts_code")], top_n, "ts_code")


def degenerate_rule_score(df: DataFrame, weights=None, group_rows=None) -> DataFrame:
    """Rule score, or the close rank (60..95) on dates where every factor is flat (std < .01)."""
    weights = weights or RULE_WEIGHTS
    used = [c for c in weights if c in df.columns]
    scored = score_band(weighted_rank_score(df, weights, group_rows=group_rows), DATE, "rule_raw", "_regular", group_rows=group_rows)
    scored = join_stats(scored, DATE, {f"_s_{c}": F.stddev_samp(c) for c in used}, group_rows)
    widest = F.greatest(*[F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) for c in used], F.lit(0.0))
    scored = scored.withColumn("_flat", widest < 0.01).drop(*[f"_s_{c}" for c in used])
    scored = ranks.average_ranks(scored, DATE, {"_close_rank": "close"}, group_rows)
    score = F.when(F.col("_flat"), F.round(60.0 + F.col("_close_rank") * 35.0, 1)).otherwise(F.col("_regular"))
    return scored.withColumn("rule_score", score).drop("_flat", "_close_rank", "_regular")


# ---- neutralisation ------------------------------------------------------------------


def industry_neutral(df: DataFrame, score: str, industry: str = "industry", out="industry_neutral_score",
                     group_rows=None) -> DataFrame:
    """z inside each industry (a single member gives 0), then z over the date."""
    df = join_stats(df, ["trade_date", industry],
                    {"_m": F.avg(score), "_s": F.stddev_samp(score), "_n": F.count(F.lit(1))}, group_rows)
    inner = F.when(F.col("_n") > 1, (F.col(score) - F.col("_m")) / (F.col("_s") + TINY)).otherwise(0.0)
    df = df.withColumn("_z", inner).drop("_m", "_s", "_n")
    return z_scores(df, DATE, {out: "_z"}, ddof=1, guard=False, group_rows=group_rows).drop("_z")


def industry_median_neutral(df: DataFrame, cols: Sequence[str], industry: str = "industry", group_rows=None) -> DataFrame:
    """Value minus the industry median of its date; rows without industry subtract 0."""
    filled = df.withColumns({f"_v_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in cols})
    med = ranks.quantiles(filled.where(F.col(industry).isNotNull()), ["trade_date", industry],
                          {f"_m_{c}": (f"_v_{c}", 0.5) for c in cols}, group_rows)
    joined = filled.join(med, ["trade_date", industry], "left")
    out = {f"{c}_neutral": F.col(f"_v_{c}") - F.coalesce(F.col(f"_m_{c}"), F.lit(0.0)) for c in cols}
    return joined.withColumns(out).drop(*[f"_{t}_{c}" for c in cols for t in "vm"])


def style_factors(df: DataFrame, group_rows=None) -> DataFrame:
    """Size, value, growth, momentum z-scores and the three risk scores with their mean."""
    num = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    med = ranks.quantiles(df, DATE, {"_pb_mid": ("pb", 0.5)}, group_rows)
    df = df.join(med, DATE, "left").withColumns({
        "_size": F.log(num("total_mv", 1e4) + 1),
        "_value": -(F.coalesce(F.col("pb"), F.col("_pb_mid")) + F.coalesce(clip(F.col("pe"), -100.0, 200.0), F.lit(30.0))),
        "_growth": num("revenue_yoy", 0.0) + num("profit_yoy", 0.0),
        "_mom": num("pmt_return_20d", 0.0), "_vol": num("volat_hist_20d", 0.0), "_amt": num("amount", 0.0),
        "_pe": F.coalesce(clip(F.col("pe"), 0.0, 300.0), F.lit(30.0)),
        "_pb": F.coalesce(clip(F.col("pb"), 0.0, 30.0), F.lit(3.0)),
    })
    df = z_scores(df, DATE, {"style_size": "_size", "style_value": "_value", "style_growth": "_growth",
                             "style_momentum": "_mom"}, ddof=1, guard=False, group_rows=group_rows)
    df = min_max(df, DATE, {"volatility_risk": "_vol", "_liq": "_amt"}, group_rows)
    q90 = ranks.quantiles(df, DATE, {"_pe90": ("_pe", 0.9), "_pb90": ("_pb", 0.9)}, group_rows)
    df = df.join(q90, DATE, "left")
    nonzero = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    df = df.withColumns({
        "liquidity_risk": 1 - F.col("_liq"),
        "valuation_risk": clip((F.col("_pe") / nonzero("_pe90") + F.col("_pb") / nonzero("_pb90")) / 2, 0.0, 2.0),
    })
    df = df.withColumn("risk_score", (F.col("volatility_risk") + F.col("liquidity_risk") + F.col("valuation_risk")) / 3)
    return df.drop("_pb_mid", "_size", "_value", "_growth", "_mom", "_vol", "_amt", "_pe", "_pb", "_liq", "_pe90", "_pb90")


def _valuation_base(df: DataFrame, by, group_rows) -> DataFrame:
    """Mean of the reversed PE and PB ranks inside the industry (0.01..0.99)."""
    df = df.withColumns({
        "_pe": F.coalesce(clip(F.col("pe"), 1.0, 200.0), F.lit(30.0)),
        "_pb": F.coalesce(clip(F.col("pb"), 0.1, 50.0), F.lit(3.0)),
    })
    df = ranks.average_ranks(df, by, {"_rpe": "_pe", "_rpb": "_pb"}, group_rows)
    base = ((1 - clip(F.col("_rpe"), 0.01, 0.99)) + (1 - clip(F.col("_rpb"), 0.01, 0.99))) / 2
    return df.withColumn("_base", base).drop("_pe", "_pb", "_rpe", "_rpb")


def price_band_multiplier(close: Column) -> Column:
    return (F.when(close > 150, 0.55).when(close > 80, 0.70).when((close >= 15) & (close <= 40), 1.25)
            .when(close < 15, 1.40).otherwise(1.0))


def valuation_attractiveness(df: DataFrame, group_rows=None, per_date: bool = True) -> DataFrame:
    by = ["trade_date", "industry"] if per_date else ["industry"]
    df = _valuation_base(df, by, group_rows)
    score = clip(F.col("_base") * price_band_multiplier(F.coalesce(F.col("close"), F.lit(30.0))), 0.0, 2.0)
    return df.withColumn("style_valuation_attractiveness", score).drop("_base")


def profit_quality(df: DataFrame, group_rows=None) -> DataFrame:
    """Multiplier 0.6..1.4 from the industry ROE rank and profit growth; losses take 0.6."""
    df = df.withColumn("_roe", F.coalesce(F.col("roe"), F.lit(0.0)))
    df = ranks.average_ranks(df, ["trade_date", "industry"], {"_rr": "_roe"}, group_rows)
    growth = F.coalesce(F.col("profit_yoy"), F.lit(0.0))
    bonus = F.when(F.col("_rr") > 0.8, 0.30).when(F.col("_rr") > 0.6, 0.15).otherwise(0.0)
    adj = (F.when(growth > 30, 0.20).when(growth > 10, 0.10).when(growth < -50, -0.25)
           .when(growth < -20, -0.15).otherwise(0.0))
    quality = F.when(F.col("pe") < 0, 0.60).otherwise(bound(1.0 + bonus + adj, 0.60, 1.40))
    return df.withColumn("profit_quality", quality).drop("_roe", "_rr")


def fundamental_attractiveness(df: DataFrame, group_rows=None) -> DataFrame:
    df = _valuation_base(df, ["trade_date", "industry"], group_rows)
    growth = F.coalesce(F.col("profit_yoy"), F.lit(0.0))
    bonus = (F.when(growth > 60, 0.50).when(growth > 30, 0.30).when(growth < -50, -0.40)
             .when(growth < -20, -0.20).otherwise(0.0))
    roe = bound(F.coalesce(F.col("roe"), F.lit(0.0)) / 15.0, 0.0, 2.0)
    score = bound(F.col("_base") * (1.0 + bound((roe + bonus) / 2.0, 0.0, 1.0)), 0.0, 2.0)
    if "negative_ratio" in df.columns:
        score = F.when(F.col("negative_ratio") > 0.3, score * 0.70).otherwise(score)
    return df.withColumn("fundamental_attractiveness", score).drop("_base")


def _gram(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Per group: counts, sums and products of [xs, y]; one row per group."""
    cols = [*xs, y]
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}")
             for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.groupBy(*by).agg(*aggs)


def ols_coefficients(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Least squares with intercept per group from sufficient statistics.

    The data stays in one distributed aggregate; the tiny normal equations of each group
    are solved in vectorised batches where the aggregate rows already are.
    """
    filled = df.select(*by, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in (*xs, y)])
    gram = _gram(filled, by, xs, y)
    k = len(xs)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in gram.select(*by).schema.fields],
                        "intercept double", *[f"`b_{c}` double" for c in xs]])

    def solve(batches):
        for b in batches:
            n = b["n"].to_numpy()
            mean = np.stack([b[f"s{i}"].to_numpy() / n for i in range(k + 1)], axis=1)
            cov = np.empty((len(b), k + 1, k + 1))
            for i in range(k + 1):
                for j in range(i, k + 1):
                    v = b[f"p{i}_{j}"].to_numpy() / n - mean[:, i] * mean[:, j]
                    cov[:, i, j] = cov[:, j, i] = v
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(cov[:, :k, :k], rcond=1e-12, hermitian=True), cov[:, :k, k])
            out = b[list(by)].copy()
            out["intercept"] = mean[:, k] - np.einsum("ni,ni->n", beta, mean[:, :k])
            for i, c in enumerate(xs):
                out[f"b_{c}"] = beta[:, i]
            yield pd.DataFrame(out)

    return gram.mapInPandas(solve, schema)


STYLE = ("style_size", "style_value", "style_growth", "style_momentum")


def style_neutral(df: DataFrame, score: str, xs: Sequence[str] = STYLE, out="style_neutral_score") -> DataFrame:
    """Residual of the score on the style factors, per date."""
    df = df.join(ols_coefficients(df, DATE, xs, score), DATE, "left")
    fit = F.col("intercept")
    for c in xs:
        fit = fit + F.col(f"b_{c}") * F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn(out, F.coalesce(F.col(score), F.lit(0.0)) - fit).drop("intercept", *[f"b_{c}" for c in xs])


def style_neutral_single(df: DataFrame, score: str, xs: Sequence[str], out="neutral_score",
                         group_rows=None) -> DataFrame:
    """Subtract slope_j * x_j for each style on its own (slopes all taken from the score)."""
    aggs = {}
    for c in xs:
        aggs[f"_b_{c}"] = F.regr_slope(F.col(score), F.coalesce(F.col(c), F.lit(0.0)))
        aggs[f"_s_{c}"] = F.stddev_pop(F.coalesce(F.col(c), F.lit(0.0)))
    df = join_stats(df, DATE, aggs, group_rows)
    rest = F.col(score)
    for c in xs:
        rest = rest - F.when(F.col(f"_s_{c}") > TINY, F.col(f"_b_{c}") * F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    return df.withColumn(out, rest).drop(*aggs)


def factor_returns(df: DataFrame, xs: Sequence[str], ret: str, top: int | None = None) -> DataFrame:
    """Per-date cross-sectional coefficients of returns on exposures: all names, or the ``top``
    largest caps of the date, chosen before rows without values go."""
    rows = df if top is None else largest_caps(df, top)
    return ols_coefficients(rows.dropna(subset=[*xs, ret]), DATE, xs, ret)


def largest_caps(df: DataFrame, n: int, cap: str = "total_mv") -> DataFrame:
    return ranks.top_n(df, DATE, [F.col(cap).desc(), F.col("ts_code")], n, "ts_code", "_rk", value=F.col(cap)).drop("_rk")


def concentration_penalty(df: DataFrame, score: str, limit: float = 0.30) -> DataFrame:
    """The largest industry of a date above ``limit`` of the names has its scores cut by 0.7."""
    sizes = df.where(F.col("industry").isNotNull()).groupBy("trade_date", "industry").agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.groupBy("trade_date").agg(
        F.max_by("industry", F.struct("_n", "industry")).alias("_top"), (F.max("_n") / F.sum("_n")).alias("_share"))
    df = df.join(top, DATE, "left")
    hit = (F.col("industry") == F.col("_top")) & (F.col("_share") > limit)
    return df.withColumn(score, F.when(hit, F.col(score) * 0.7).otherwise(F.col(score))).drop("_top", "_share")


def apply_risk_filters(df: DataFrame, min_liquidity: float = 1e6, max_risk: float = 0.8) -> DataFrame:
    ok = ~special_treatment("name") & (F.coalesce(F.col("amount"), F.lit(0.0)) >= min_liquidity)
    if "risk_score" in df.columns:
        ok = ok & (F.col("risk_score") < max_risk)
    return df.where(ok)


def neutrality_report(df: DataFrame, score: str = "neutral_score", top: int = 100, group_rows=None) -> DataFrame:
    """Diagnostics of the top names of each date."""
    best = ranks.top_n(df, DATE, [F.round(score, 9).desc(), F.col("ts_code")], top, "ts_code", "_rk")
    share = best.groupBy("trade_date", "industry").count().groupBy("trade_date").agg(
        (F.max("count") / F.sum("count")).alias("max_industry_concentration"))
    va = "style_valuation_attractiveness"
    stats = best.groupBy("trade_date").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("style_size", "style_value", "style_growth")],
        F.avg(va).alias("va_mean"), F.expr(f"percentile({va}, 0.25)").alias("va_p25"),
        F.expr(f"percentile({va}, 0.75)").alias("va_p75"),
        F.avg(F.col("close").between(10, 40).cast("double")).alias("mid_price_share"),
        F.avg((F.col("close") > 80).cast("double")).alias("high_price_share"),
        F.avg((F.col("pe") < 0).cast("double")).alias("loss_ratio"),
        F.avg(F.when(F.col("pe") > 0, F.col("pe"))).alias("positive_pe_mean"),
        F.avg("roe").alias("roe_mean"), F.avg("profit_yoy").alias("profit_yoy_mean"),
        F.avg("negative_ratio").alias("negative_ratio_mean"),
    )
    return stats.join(share, DATE)


def veto_counts(df: DataFrame, score: str, top: int = 100, keep: int = 5) -> DataFrame:
    """Most frequent veto reasons among the top names of each date."""
    rows = ranks.top_n(df, DATE, [F.round(score, 9).desc(), F.col("ts_code")], top, "ts_code", "_rk")
    counts = rows.where(F.coalesce(F.col("veto_reason"), F.lit("")) != "").groupBy("trade_date", "veto_reason").count()
    w = Window.partitionBy("trade_date").orderBy(F.col("count").desc(), "veto_reason")
    return counts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= keep)


# ---- small caps ----------------------------------------------------------------------


def small_cap_factors(df: DataFrame, size_pct: float = 0.3, min_mv: float = 1e4, max_mv: float = 1e6, group_rows=None) -> DataFrame:
    """Small-cap family on a panel that carries ret_5/ret_20, volume_ma20, volatility_20d."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = ranks.average_ranks(df, DATE, {"size_quantile": "total_mv", "float_size_quantile": "circ_mv",
                                        "volatility_quantile": "volatility_20d"}, group_rows)
    small = (F.col("float_size_quantile") <= size_pct) & F.col("circ_mv").between(min_mv, max_mv)
    tilt = 1 - F.col("size_quantile")
    df = df.withColumns({
        "float_ratio": F.col("circ_mv") / (F.col("total_mv") + TINY),
        "log_size": F.log(F.col("total_mv") + 1), "log_float_size": F.log(F.col("circ_mv") + 1),
        "is_small_cap": flag(small),
        "is_micro_cap": flag((F.col("float_size_quantile") <= 0.1) & (F.col("circ_mv") >= min_mv)),
        "est_turnover": F.col("vol") * F.col("close") / (F.col("circ_mv") * 1e8 + TINY),
    })
    member = F.col("is_small_cap")
    df = df.withColumns({
        "small_cap_revenue_growth": tilt * zero("revenue_yoy"),
        "small_cap_profit_growth": tilt * zero("profit_yoy"),
        "small_cap_high_growth": member * flag((F.col("revenue_yoy") > 20) & (F.col("profit_yoy") > 20)),
        "small_cap_momentum_5d": tilt * zero("ret_5"), "small_cap_momentum_20d": tilt * zero("ret_20"),
        "small_cap_reversal": member * -zero("ret_5"),
        "small_cap_momentum_strength": tilt * zero("ret_20") * F.col("vol") / (F.col("volume_ma20") + TINY),
        "small_cap_roe": tilt * zero("roe"), "small_cap_liquidity": tilt * F.col("est_turnover"),
        "small_cap_liquidity_spike": member * F.col("vol") / (F.col("volume_ma20") + TINY),
        "small_cap_volatility": tilt * zero("volatility_20d"),
        "small_cap_low_vol": member * flag(F.col("volatility_quantile") < 0.3),
        "small_cap_pb": tilt / (F.col("pb") + TINY), "small_cap_pe": tilt * F.try_divide(F.lit(1.0), F.col("pe") + TINY),
        "small_cap_undervalued": member * flag((F.col("pb") < 2) & (F.col("pe") < 30) & (F.col("pe") > 0)),
    })
    parts = ("small_cap_revenue_growth", "small_cap_momentum_20d", "small_cap_roe", "small_cap_liquidity", "small_cap_pb")
    df = z_scores(df, DATE, {f"_z_{c}": c for c in parts}, ddof=1, group_rows=group_rows)
    mean = sum(F.col(f"_z_{c}") for c in parts) / len(parts)
    return df.withColumn("small_cap_composite_score", F.col("is_small_cap") * mean).drop(*[f"_z_{c}" for c in parts])


def small_cap_selection(df: DataFrame, min_score: float = 0.0, top: int = 50) -> DataFrame:
    rows = df.where((F.col("is_small_cap") == 1) & (F.col("small_cap_composite_score") >= min_score))
    order = [F.round("small_cap_composite_score", 9).desc(), F.col("ts_code")]
    return ranks.top_n(rows, DATE, order, top, "ts_code")


# ---- composite score and item view ---------------------------------------------------


def final_composite(df: DataFrame, group_rows=None) -> DataFrame:
    """Blend of robust z-scores; a volatile date shifts weight to the rules."""
    agree = 1.0 - F.least(F.abs(F.coalesce(F.col("ai_score"), F.lit(0.0)) - F.coalesce(F.col("rule_score"), F.lit(0.0))), F.lit(20.0)) / 20.0
    parts = {"_zr": "rule_score", "_zt": "trend_score", "_zb": "bottom_score", "_za": "ai_score", "_zc": "_agree"}
    df = robust_z(df.withColumn("_agree", agree), DATE, parts, group_rows)
    df = join_stats(df, DATE, {"_vol": F.avg("volat_hist_20d")}, group_rows)
    calm, storm = (0.40, 0.25, 0.15, 0.10, 0.10), (0.50, 0.20, 0.12, 0.08, 0.10)
    hot = F.coalesce(F.col("_vol"), F.lit(0.0)) > 0.025
    score = sum(F.when(hot, s).otherwise(c) * F.col(z) for z, c, s in zip(parts, calm, storm))
    pledge = bound(1.05 - F.least(F.coalesce(F.col("pledge_ratio"), F.lit(0.0)), F.lit(50.0)) / 1000, 0.85, 1.05)
    return df.withColumn("v19_final_score", score * pledge).drop(*parts, "_agree", "_vol")


def fallback_scores(df: DataFrame, group_rows=None) -> DataFrame:
    """Trend and bottom scores from rule factors, 60..90, one decimal."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    trend = zero("pmt_return_20d") + zero("ma_trend_score") + zero("macd_golden") + zero("ma_bull")
    bottom = (zero("multi_oversold_flag") + zero("rsi_divergence") + zero("reversal_signal") + zero("in_bottom_zone")
              + (1.0 - F.coalesce(F.col("rsi"), F.lit(50.0)) / 100.0) * 0.5)
    df = df.withColumns({"_t": trend, "_b": bottom})
    df = score_band(df, DATE, "_t", "trend_score", 60.0, 30.0, group_rows)
    df = score_band(df, DATE, "_b", "bottom_score", 60.0, 30.0, group_rows)
    return df.drop("_t", "_b")


#: Fixed values.
REGIME_MULTIPLIER = {
    "small_cap_rally": 1.15, "bull": 1.10, "balanced": 1.00, "neutral": 1.00, "large_cap_rally": 0.95,
    "volatile": 0.88, "bear": 0.82, "high_vol_bear": 0.78, "high_vol_bull": 0.90,
}


def veto_columns(df: DataFrame) -> DataFrame:
    """Sentiment and valuation vetoes with distinct reasons in order."""
    pe, pb, roe, neg = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("pe", "pb", "roe", "negative_ratio"))
    engine = F.coalesce(F.col("veto"), F.lit(False)) if "veto" in df.columns else F.lit(False)
    said = F.coalesce(F.col("engine_reason"), F.lit("")) if "engine_reason" in df.columns else F.lit("")
    reason = (F.when(pe > 150, "pe_bubble").when(pb > 15, "pb_high").when((pe < 0) & (roe < -5), "lasting_loss"))
    parts = F.array_compact(F.array(F.when(engine & (said != ""), said), F.when(neg > 0.35, F.lit("negative_posts")), reason))
    return df.withColumns({
        "nlp_veto": (neg > 0.35) | engine,
        "fundamental_veto": reason.isNotNull(),
        "veto_reason": F.array_join(F.array_distinct(parts), " | "),
    })


def item_view(df: DataFrame, regime: str = "neutral", consistency: float = 0.5, uncertainty: float = 0.0) -> DataFrame:
    """Final score, confidence, volatility-target position, level and signal list per row."""
    v = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(float(d))
    df = veto_columns(df)
    rule = v("rule_score", 70.0)
    trend = F.coalesce(F.nullif(v("trend_score"), F.lit(0.0)), rule * 0.95)
    bottom = F.coalesce(F.nullif(v("bottom_score"), F.lit(0.0)), rule * 0.90)
    ai = bound(60.0 + v("ai_score") * 8.0, 35.0, 95.0)
    rsi, dist, over, bull = v("rsi", 50.0), v("ma20_distance"), v("multi_oversold_flag"), v("ma_bull")
    no_trend, no_bottom = (dist < 0) | (bull < 0.5), (over < 0.4) & (rsi > 35)
    cons = consistency * 100
    blend = (
        F.when(no_trend & no_bottom, (0.80 * rule + 0.10 * ai + 0.10 * cons) * 0.82)
        .when(no_trend, (0.65 * rule + 0.15 * bottom + 0.10 * ai + 0.10 * cons) * 0.90)
        .when(no_bottom, (0.55 * rule + 0.25 * trend + 0.10 * ai + 0.10 * cons) * 0.93)
        .otherwise(0.40 * rule + 0.25 * trend + 0.15 * bottom + 0.10 * ai + 0.10 * cons)
    )
    score = bound(F.when(blend < 50.0, F.greatest(F.lit(58.0), rule * 0.88)).otherwise(blend), 50.0, 99.0)
    df = df.withColumns({"buy_score": score, "trend_vetoed": no_trend, "bottom_vetoed": no_bottom})
    pe, pb, roe, close, neg = v("pe"), v("pb"), v("roe"), v("close"), v("negative_ratio")
    pe_s = F.when(pe > 0, F.greatest(pe, F.lit(1.0))).otherwise(30.0)
    pb_s = F.when(pb > 0, F.greatest(pb, F.lit(0.1))).otherwise(3.0)
    local = bound(1.0 / ((pe_s / 30.0 + pb_s / 2.5) / 2.0 + 0.5), 0.0, 1.0)
    given = v("style_valuation_attractiveness", -1.0)
    va = F.when(given < 0, local).otherwise(given)
    s = F.col("buy_score")
    conf = (40.0 + (s - 50.0) * 0.8 + consistency * 15.0 + F.least(F.lit(1.0), va) * 12.0
            + (1.0 - min(1.0, uncertainty)) * 10.0 + (1.0 - F.least(F.lit(1.0), neg)) * 18.0
            + F.when(close.between(10, 40) & (roe > 8) & (v("nlp_score") > 0.2), 15.0).otherwise(0.0))
    for veto, cut in (("nlp_veto", 0.72), ("fundamental_veto", 0.75), ("trend_vetoed", 0.90), ("bottom_vetoed", 0.93)):
        conf = F.when(F.col(veto), conf * cut).otherwise(conf)
    band = F.when(close < 15, 1.10).when(close <= 40, 1.05).when(close > 80, 0.85).otherwise(1.0)
    mult = bound(F.when(given >= 0, 0.72 + given * 0.63).otherwise((0.72 + local * 0.63) * band), 0.65, 1.35)
    mult = F.when(F.col("fundamental_veto"), mult * 0.50).otherwise(mult)
    quality = F.when(s >= 88, 1.20).when(s >= 80, 1.05).when(s < 68, 0.75).otherwise(1.0)
    for cond, cut in ((F.col("trend_vetoed"), 0.85), (F.col("bottom_vetoed"), 0.90), (v("pledge_ratio") > 40, 0.70),
                      (pe > 80, 0.85), (F.col("nlp_veto"), 0.25), (v("near_hist_high_flag") > 0.5, 0.65),
                      (v("parabolic_flag") > 0.5, 0.60)):
        quality = quality * F.when(cond, cut).otherwise(1.0)
    base_w = F.least(F.lit(0.12), 0.025 / F.greatest(v("volat_hist_20d", 0.02), F.lit(0.005)) * 0.10)
    weight = bound(base_w * mult * REGIME_MULTIPLIER.get(regime, 1.0) * quality * (0.75 if uncertainty > 0.40 else 1.0), 0.02, 0.12)
    level = F.when(weight >= 0.10, "aggressive").when(weight >= 0.07, "normal").when(weight >= 0.04, "cautious").otherwise("light")
    signals = F.array_compact(F.array(
        F.when(bull > 0.5, "ma_bull"), F.when(dist >= 0, "above_ma20"), F.when(rsi < 35, "rsi_oversold"),
        F.when(v("kdj_j", 50.0) < 10, "kdj_low"), F.when(over > 0.5, "multi_oversold"),
        F.when(v("pmt_return_20d") > 0.05, "strong_20d"), F.when(F.col("trend_vetoed"), "trend_vetoed"),
        F.when(F.col("bottom_vetoed"), "bottom_vetoed"), F.when(v("pledge_ratio") > 40, "high_pledge"),
        F.when(pe > 80, "rich_valuation"), F.when(dist < -0.08, "deep_below_ma20"), F.when(F.col("nlp_veto"), "nlp_veto"),
        F.when(F.col("fundamental_veto"), "fundamental_veto"),
        F.when((roe > 15) & (v("profit_yoy") > 10), "quality_growth")))
    return df.withColumns({
        "confidence": bound(F.floor(conf).cast("double"), 35.0, 95.0).cast("int"),
        "position_weight": weight, "position_level": level, "buy_signals": signals,
    })


def qualification(df: DataFrame) -> DataFrame:
    v = lambda c, d=0.0: F.coalesce(F.col(c), F.lit(d))
    trend = ((v("ma20_distance") >= 0) & (v("ma_bull") > 0.5)) | (v("ma20_distance") >= -0.03) | (v("pmt_return_20d") > 0.01)
    bottom = (v("multi_oversold_flag") > 0.2) | (v("rsi", 50.0) < 35) | (v("kdj_j", 50.0) < 10) | (v("ma20_distance") < -0.07)
    return df.withColumns({"trend_qualified": trend, "bottom_qualified": bottom})


def qualified_half(df: DataFrame, qualified: str, score: str, half: int, allowed: Column | None = None) -> DataFrame:
    """Qualified names first, by score, up to ``half`` per date; closed where not allowed."""
    rows = df if allowed is None else df.where(allowed)
    order = [F.col(qualified).desc(), F.round(score, 9).desc(), F.col("ts_code")]
    return ranks.top_n(rows, DATE, order, half, "ts_code", "pos")


def smallest_caps(df: DataFrame, target: int) -> DataFrame:
    """Fallback pool: smallest market values of the newest date."""
    return latest_section(df).where(F.col("total_mv") > 0).orderBy("total_mv", "ts_code").limit(target)


def latest_constituents(weights: DataFrame, code: str, day: str) -> DataFrame:
    rows = weights.where(F.col(day) == weights.agg(F.max(day).alias("newest")).scalar())
    return rows.dropDuplicates([code])


def industry_anchors(df: DataFrame, cap: str = "total_mv", liq: str = "amount", group_rows=None) -> DataFrame:
    """Representatives per (date, industry): two from groups of five or more, else one."""
    rows = df.where(~is_blank("industry", unknown_too=True))
    rows = join_stats(rows, ["trade_date", "industry"], {"_c": F.max(cap), "_l": F.max(liq), "_n": F.count(F.lit(1))}, group_rows)
    part = lambda c, m: F.when(F.col(m) > 0, F.coalesce(F.col(c), F.lit(0.0)) / (F.col(m) + TINY)).otherwise(0.0)
    rows = rows.withColumn("anchor_score", 0.6 * part(cap, "_c") + 0.4 * part(liq, "_l"))
    w = Window.partitionBy("trade_date", "industry").orderBy(F.round("anchor_score", 9).desc(), "ts_code")
    rows = rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= 2)
    return rows.where(F.col("pos") <= F.when(F.col("_n") >= 5, 2).otherwise(1)).drop("_c", "_l", "_n")
