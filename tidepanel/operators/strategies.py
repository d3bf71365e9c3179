"""Explainable rule strategies: history features -> section -> filters -> scores -> top-N.

Each strategy is a builder over a panel that carries ``factors.strategy_history``; it works
on every date at once, and the newest date is the reference answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band_score, bare_code, bound, clean_text, special_treatment
from ..session import cut_lineage
from . import ranks
from .market import emotion, industry_heat
from .windows import above


@dataclass(frozen=True)
class Config:
    strategy_id: str
    mv_min: float = 20.0
    mv_max: float = 100.0
    price_min: float = 3.0
    price_max: float = 25.0
    top_n: int = 30
    recent_days: int = 10
    recent_max: int = 3
    limit_10d_max: int = 3
    limit_30d_max: int = 5
    exclude_bj: bool = True
    position: float = 10.0
    total_position: float = 60.0
    stop_loss: float = -5.0
    hold_min: int = 1
    hold_max: int = 3


# The parameters of the five strategies.
CONFIGS = {
    "first_board": Config("first_board"),
    "emotion_leader": Config("emotion_leader", 20, 300, 3, 80, 30, 20, 6, 5, 10, True, 12, 70, -6, 1, 5),
    "second_board": Config("second_board", 20, 250, 3, 60, 30, 10, 4, 5, 9, True, 10, 70, -6, 1, 4),
    "strong_pullback": Config("strong_pullback", 20, 500, 3, 100, 30, 20, 5, 5, 10, True, 8, 50, -5, 2, 8),
    "big_turnover_trend": Config("big_turnover_trend", 80, 2000, 5, 180, 30, 20, 6, 6, 12, True, 10, 60, -7, 3, 15),
}
OPTIONAL = ("fd_amount", "limit_amount", "open_times", "turnover_rate", "turnover_ratio")


def prepare(df: DataFrame, cfg: Config) -> DataFrame:
    """Drop special-treatment and (optionally) .BJ names; unit columns; default industry."""
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    first = lambda a, b: F.when(v(a) != 0, v(a)).otherwise(v(b))
    ok = ~special_treatment("name")
    if cfg.exclude_bj:
        ok = ok & ~F.col("ts_code").endswith(".BJ")
    text = lambda c: clean_text(c) if c in df.columns else F.lit("")
    return df.where(ok).withColumns({
        "industry": F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.lit("unknown")),
        "amount_yi": v("amount") / 100000, "fd_amount_yi": first("fd_amount", "limit_amount") / 1e8, "open_times_num": v("open_times"),
        "turnover": first("turnover_rate", "turnover_ratio"), "first_limit_time": text("first_time"), "last_limit_time": text("last_time")})


def _between(c: str, lo: float, hi: float) -> Column:
    return F.col(c).between(lo, hi)


def position_tiers(cfg: Config, mood: Column, strong: Column, leader: bool = False) -> tuple[Column, Column, Column]:
    """(per name, total, level) by market mood."""
    bonus = F.lit(3.0) if leader else F.when(strong, 4.0).otherwise(2.0)
    low = F.lit(6.0 if leader else min(6.0, cfg.position))
    cap = F.lit(35.0 if leader else min(35.0, cfg.total_position))
    per = F.when(mood >= 72, F.least(F.lit(15.0), cfg.position + bonus)).when(mood >= 56, F.lit(float(cfg.position))).when(mood >= 40, low).otherwise(3.0)
    total = (F.when(mood >= 72, F.lit(min(80.0, cfg.total_position + 10.0))).when(mood >= 56, F.lit(float(cfg.total_position)))
             .when(mood >= 40, cap).otherwise(15.0))
    level = F.when(mood >= 72, "aggressive").when(mood >= 56, "normal").when(mood >= 40, "cautious").otherwise("light")
    return per, total, level


def _finish(df: DataFrame, cfg: Config, total: Column, confidence: Column, parts: dict[str, Column], trend: Column, bottom: Column,
            position: tuple[Column, Column, Column], signals: list[Column]) -> DataFrame:
    scored = df.withColumns({
        "strategy_score": F.round(total, 3), "confidence": F.round(bound(confidence), 1), "trend_score": F.round(trend, 3),
        "bottom_score": F.round(bottom, 3), "position_pct": F.round(position[0], 2), "max_total_position_pct": position[1],
        "position_level": position[2], "dimensions": F.create_map(*[x for k, c in parts.items() for x in (F.lit(k), F.round(c, 1))]),
        "buy_signals": F.array_compact(F.array(*signals))})
    top = ranks.top_n(scored, ["trade_date"], [F.col("strategy_score").desc(), F.col("ts_code")], cfg.top_n, "ts_code")
    return top.select(
        F.lit(cfg.strategy_id).alias("strategy_id"), "trade_date", "pick_rank", bare_code("ts_code").alias("code"), "ts_code", "name", "industry",
        F.round("close", 3).alias("current_price"), F.round("pct_chg", 3).alias("pct_chg"), "strategy_score", "confidence", "trend_score",
        "bottom_score", "position_pct", "max_total_position_pct", "position_level", F.round("market_value_yi", 3).alias("market_value"),
        F.round("turnover", 3).alias("turnover_rate"), F.round("fd_amount_yi", 3).alias("fd_amount_yi"),
        F.col("open_times_num").cast("int").alias("open_times"), "first_limit_time", "last_limit_time",
        F.round("return_5d", 3).alias("return_5d"), F.round("return_20d", 3).alias("return_20d"), "dimensions", "buy_signals",
        F.lit(float(cfg.stop_loss)).alias("stop_loss_pct"), F.lit(f"{cfg.hold_min}-{cfg.hold_max}").alias("holding_days_plan"))


def _points(*pairs) -> Column:
    total = F.lit(0.0)
    for cond, pts in pairs:
        total = total + F.when(cond, F.lit(float(pts))).otherwise(0.0)
    return total


def _bulls() -> tuple[Column, Column, Column]:
    c, m5, m10, m20 = F.col("close"), F.col("ma5"), F.col("ma10"), F.col("ma20")
    return (m5 > 0) & ~above(m5, c), (m10 > 0) & ~above(m10, m5), (m20 > 0) & ~above(m20, m10)


def first_board(df: DataFrame, cfg: Config, group_rows=None) -> DataFrame:
    """First limit-up: low price, small cap, not one-word, not over-run."""
    recent = f"limit_up_{cfg.recent_days}d" if f"limit_up_{cfg.recent_days}d" in df.columns else "limit_up_10d"
    d = prepare(df, cfg).where(
        F.col("is_limit_up") & ~F.col("prev_limit_up") & (F.col(recent) <= cfg.recent_max) & (F.col("limit_up_10d") <= cfg.limit_10d_max)
        & (F.col("limit_up_30d") <= cfg.limit_30d_max) & ~F.col("one_word_limit") & _between("close", cfg.price_min, cfg.price_max)
        & _between("market_value_yi", cfg.mv_min, cfg.mv_max))
    has_seal = (F.col("fd_amount_yi") > 0) | (F.col("open_times_num") > 0) | (F.col("first_limit_time") != "") | (F.col("last_limit_time") != "")
    seal = bound(50 + F.least("fd_amount_yi", F.lit(20.0)) * 2.0 + F.greatest(F.lit(0.0), 8 - F.col("open_times_num")) * 3.0)
    a, b, c = _bulls()
    tech = bound(_points((a, 25), (b, 20), (c, 15), ((F.col("high20") > 0) & (F.col("close") >= F.col("high20") * 0.98), 25), (F.col("return_20d") < 80, 15)))
    has_act = (F.col("turnover") > 0) | (F.col("amount_yi") > 0)
    act = bound(band_score(F.col("turnover"), 3.0, 18.0, 0.5, 35.0) * 0.65 + F.least(F.col("volume_ratio"), F.lit(3.0)) / 3.0 * 35)
    ws = F.when(has_seal, 0.35).otherwise(0.0) + 0.35 + F.when(has_act, 0.30).otherwise(0.0)
    total = (F.when(has_seal, seal * 0.35).otherwise(0.0) + tech * 0.35 + F.when(has_act, act * 0.30).otherwise(0.0)) / ws
    pos = (F.lit(min(cfg.position, cfg.total_position)), F.lit(float(cfg.total_position)), F.lit("aggressive"))
    return _finish(d, cfg, total, 55 + total * 0.40, {"seal": F.when(has_seal, seal), "technical": tech, "activity": F.when(has_act, act)},
                   tech, F.lit(0.0), pos, [F.lit("first_limit_up"), F.when(tech >= 60, "ma_bull").otherwise("unconfirmed"),
                                           F.when(F.col("limit_up_10d").between(1, 3), "recent_limit_memory")])


def _with_mood(df: DataFrame, cfg: Config, group_rows) -> DataFrame:
    mood = emotion(df, group_rows=group_rows).select("trade_date", "emotion_score", "emotion_level")
    return prepare(df, cfg).join(mood, "trade_date").withColumn("_mood", F.round("emotion_score", 2))


def emotion_leader(df: DataFrame, cfg: Config, group_rows=None) -> DataFrame:
    """Mood, main line, leadership, consensus and reward-to-risk."""
    near = (F.col("close") >= F.col("high20") * 0.94) & (F.col("return_5d") >= 3)
    d = _with_mood(df, cfg, group_rows).where(
        _between("close", cfg.price_min, cfg.price_max) & _between("market_value_yi", cfg.mv_min, cfg.mv_max) & ~F.col("one_word_limit")
        & (F.col("pct_chg") > 0) & (F.col("is_limit_up") | (F.col("limit_up_5d") >= 1) | near)
        & (F.col("limit_up_10d") <= cfg.limit_10d_max) & (F.col("limit_up_30d") <= cfg.limit_30d_max))
    d = d.join(industry_heat(d, leader_mix=True), ["trade_date", "industry"], "left")
    cap = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(top)) / top
    lead = bound(F.when(F.col("is_limit_up"), 100.0).otherwise(cap("pct_chg", 10) * 45) + F.least("limit_up_5d", F.lit(3)) / 3 * 18
                 + cap("return_5d", 35) * 17 + F.when(F.col("close") >= F.col("high20") * 0.97, 20.0).otherwise(0.0))
    cons = bound(band_score(F.col("turnover"), 4, 22, 1, 45) * 0.40 + F.least("amount_yi", F.lit(80.0)) / 80 * 24
                 + F.least("fd_amount_yi", F.lit(20.0)) / 20 * 22 + F.greatest(F.lit(0.0), 14 - F.least("open_times_num", F.lit(7.0)) * 2))
    a, b, c = _bulls()
    rr = bound(_points((a, 18), (b, 15), (c, 12), (F.col("return_20d") < 120, 15))
               + band_score(F.col("market_value_yi"), cfg.mv_min, cfg.mv_max, 8, max(cfg.mv_max * 1.8, 500)) * 0.25
               + band_score(F.col("close"), cfg.price_min, cfg.price_max, 1, max(cfg.price_max * 1.5, 120)) * 0.15)
    mood, hot = F.col("_mood"), bound(F.coalesce(F.col("hot_score"), F.lit(0.0)))
    total = mood * 0.22 + hot * 0.23 + lead * 0.23 + cons * 0.17 + rr * 0.15
    return _finish(d, cfg, total, 50 + total * 0.42, {"mood": mood, "main_line": hot, "leader": lead, "consensus": cons, "reward_risk": rr},
                   lead, rr, position_tiers(cfg, mood, F.lit(True), leader=True), [F.col("emotion_level"), F.when(F.col("is_limit_up") | (F.col("limit_up_5d") >= 1), "limit_memory"),
                                                                     F.when(rr >= 65, "ma_bull").otherwise("mind_position")])


def _heated(df: DataFrame, cfg: Config, group_rows) -> DataFrame:
    d = _with_mood(df, cfg, group_rows)
    return d.join(industry_heat(d), ["trade_date", "industry"], "left")


def second_board(df: DataFrame, cfg: Config, group_rows=None) -> DataFrame:
    d = _heated(df, cfg, group_rows).where(
        _between("close", cfg.price_min, cfg.price_max) & _between("market_value_yi", cfg.mv_min, cfg.mv_max) & ~F.col("one_word_limit")
        & F.col("is_limit_up") & F.col("limit_up_5d").between(2, cfg.recent_max) & (F.col("limit_up_10d") <= cfg.limit_10d_max)
        & (F.col("limit_up_30d") <= cfg.limit_30d_max))
    mood, hot = F.col("_mood"), bound(F.coalesce(F.col("hot_score"), F.lit(0.0)))
    board = bound(55 + F.least("limit_up_5d", F.lit(3)) / 3 * 30 + F.greatest(F.lit(0.0), 8 - F.col("open_times_num")) * 2)
    money = bound(band_score(F.col("turnover"), 5, 25, 1, 45) * 0.45 + F.least("amount_yi", F.lit(60.0)) / 60 * 35 + F.least("fd_amount_yi", F.lit(15.0)) / 15 * 20)
    risk = bound(band_score(F.col("market_value_yi"), cfg.mv_min, cfg.mv_max, 8, 500) * 0.45 + band_score(F.col("close"), cfg.price_min, cfg.price_max, 1, 100) * 0.25
                 + F.when(F.col("return_20d") < 110, 30.0).otherwise(0.0))
    total = mood * 0.18 + hot * 0.27 + board * 0.25 + money * 0.18 + risk * 0.12
    return _finish(d, cfg, total, 50 + total * 0.43, {"mood": mood, "main_line": hot, "board": board, "money": money, "reward_risk": risk}, board, risk,
                   position_tiers(cfg, mood, (hot >= 70) & (board >= 80)), [F.col("emotion_level"), F.lit("second_board")])


def strong_pullback(df: DataFrame, cfg: Config, group_rows=None) -> DataFrame:
    near = (F.col("close") <= F.col("ma5") * 1.035) & (F.col("close") >= F.col("ma20") * 0.97)
    rest = F.col("pct_chg").between(-4.5, 2.5) & (F.col("return_20d") > 8)
    d = _heated(df, cfg, group_rows).where(
        _between("close", cfg.price_min, cfg.price_max) & _between("market_value_yi", cfg.mv_min, cfg.mv_max) & (F.col("return_20d") >= 8)
        & (F.col("limit_up_20d") >= 1) & (F.col("limit_up_30d") <= cfg.limit_30d_max) & (near | rest) & (F.col("ma5") >= F.col("ma20") * 0.98))
    mood, hot = F.col("_mood"), bound(F.coalesce(F.col("hot_score"), F.lit(0.0)))
    strength = bound(F.least("return_20d", F.lit(80.0)) / 80 * 45 + F.least(F.col("return_5d") + 8, F.lit(30.0)) / 30 * 25 + F.least("limit_up_20d", F.lit(4)) / 4 * 30)
    ref = F.greatest(F.coalesce(F.nullif("ma10", F.lit(0.0)), "ma5", F.lit(1.0)), F.lit(1.0))
    dip = bound(100 - F.abs(F.col("close") / ref - 1) * 800)
    support = bound(band_score(F.col("turnover"), 2.5, 14, 0.8, 28) * 0.55 + F.least("amount_yi", F.lit(40.0)) / 40 * 25
                    + F.when(~above(F.coalesce("ma20", F.lit(0.0)), F.col("close")), 20.0).otherwise(0.0))
    total = mood * 0.12 + hot * 0.20 + strength * 0.25 + dip * 0.25 + support * 0.18
    return _finish(d, cfg, total, 50 + total * 0.42, {"mood": mood, "main_line": hot, "strength": strength, "pullback": dip, "support": support}, strength, dip,
                   position_tiers(cfg, mood, F.lit(False)), [F.lit("strong_pullback"), F.lit("near_average")])


def big_turnover_trend(df: DataFrame, cfg: Config, group_rows=None) -> DataFrame:
    d = _heated(df, cfg, group_rows).where(
        _between("close", cfg.price_min, cfg.price_max) & _between("market_value_yi", cfg.mv_min, cfg.mv_max) & (F.col("amount_yi") >= 8)
        & ~above(F.col("ma20"), F.col("close")) & (F.col("ma5") >= F.col("ma20") * 0.98)
        & ((F.col("return_20d") >= 10) | (F.col("close") >= F.col("high20") * 0.95)) & (F.col("pct_chg") > -3))
    mood, hot = F.col("_mood"), bound(F.coalesce(F.col("hot_score"), F.lit(0.0)))
    room = bound(F.least("amount_yi", F.lit(150.0)) / 150 * 55 + band_score(F.col("market_value_yi"), cfg.mv_min, cfg.mv_max, 40, 3000) * 0.45)
    cap = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(top))) / top
    trend = bound(cap("return_20d", 80) * 35 + cap("pct_chg", 10) * 15 + _points((F.col("close") >= F.coalesce("high20", F.lit(0.0)) * 0.96, 30), (
        ~above(F.col("ma10"), F.col("ma5")) & ~above(F.col("ma20"), F.col("ma10")), 20)))
    cons = bound(band_score(F.col("turnover"), 2, 18, 0.5, 35) * 0.45 + F.least("amount_yi", F.lit(120.0)) / 120 * 35 + F.least("fd_amount_yi", F.lit(20.0)) / 20 * 20)
    total = mood * 0.12 + hot * 0.22 + room * 0.24 + trend * 0.27 + cons * 0.15
    return _finish(d, cfg, total, 50 + total * 0.42, {"mood": mood, "main_line": hot, "capacity": room, "trend": trend, "consensus": cons}, trend, room,
                   position_tiers(cfg, mood, (room >= 70) & (trend >= 70)), [F.lit("big_turnover"), F.lit("trend_leader")])


Builder = Callable[..., DataFrame]
STRATEGIES: dict[str, Builder] = {
    "first_board": first_board, "emotion_leader": emotion_leader, "second_board": second_board,
    "strong_pullback": strong_pullback, "big_turnover_trend": big_turnover_trend,
}


def register(name: str, builder: Builder, cfg: Config) -> None:
    """Add a user strategy: a builder (panel, config, group_rows) -> picks."""
    STRATEGIES[name], CONFIGS[name] = builder, cfg


def run(df: DataFrame, name: str, group_rows=None, **params) -> DataFrame:
    """Run one strategy with parameter overrides (unknown or empty ones are ignored)."""
    base = CONFIGS[name]
    known = {k: type(getattr(base, k))(v) for k, v in params.items() if k in asdict(base) and v is not None}
    return STRATEGIES[name](df, replace(base, **known), group_rows)


def run_grid(df: DataFrame, grid: list[tuple[str, dict]], group_rows=None) -> DataFrame:
    """Several (strategy, overrides) settings in one job, labelled by position.

    The history panel is materialised once for all settings.
    """
    out, df = None, cut_lineage(df) if len(grid) > 1 else df
    for i, (name, params) in enumerate(grid):
        part = run(df, name, group_rows, **params).withColumn("setting", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
