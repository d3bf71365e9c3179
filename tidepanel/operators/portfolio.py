"""Holdings from a trade ledger, marks, exit scan, exposure advice and signal alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bare_code
from .windows import SEGMENT_DECAY, cumulative

ALL = 10**12
LEDGER = ["account", "code"]


def valid_trades(ledger: DataFrame) -> DataFrame:
    """Whole lots of 100 only; buys are cut to lots, odd sells are refused, prices positive."""
    lots = F.when(F.col("side").isin("BUY", "ADD"), F.floor(F.col("shares") / 100) * 100).otherwise(F.col("shares"))
    odd = (F.col("side") == "REDUCE") & (F.col("shares") % 100 != 0)
    return ledger.withColumn("shares", lots.cast("long")).where(
        (F.col("price") > 0) & ~odd & ((F.col("side") == "CLOSE") | (F.col("shares") > 0)))


def replay(ledger: DataFrame, bucket: Column, group_rows: int | None = None) -> DataFrame:
    """Position after every trade: shares, average cost, realised profit.

    A sell cannot exceed the holding, so shares are a clamped running sum: the plain sum
    lifted by the lowest point it has reached at a sell. Between two flat points the cost is
    a decayed sum of buys (a sell scales it). Both are running sums and maxima over
    (key, bucket) cells, so one busy key needs no single-task fold. Scales are relative to
    segments in which a position decays by a fixed factor, so no episode is too long.
    """
    buy = F.col("side").isin("BUY", "ADD")
    move = F.when(buy, F.col("shares")).when(F.col("side") == "CLOSE", F.lit(-ALL)).otherwise(-F.col("shares"))
    d = valid_trades(ledger).withColumns({"_b": bucket, "_buy": buy, "_move": move})
    d = cumulative(d, LEDGER, "seq", "_b", {"_sum": ("_move", "sum")}, group_rows)
    d = d.withColumn("_low", F.when(~F.col("_buy"), -F.col("_sum")))
    d = cumulative(d, LEDGER, "seq", "_b", {"_lift": ("_low", "max"), "_lift0": ("_low", "max_before")}, group_rows)
    zero = F.lit(0).cast("long")
    d = d.withColumns({
        "shares_after": F.col("_sum") + F.greatest(zero, F.col("_lift")),
        "shares_before": F.col("_sum") - F.col("_move") + F.greatest(zero, F.col("_lift0"))})
    d = d.where(F.col("_buy") | (F.col("shares_before") > 0)).withColumn("_flat", (F.col("shares_after") == 0).cast("long"))
    d = cumulative(d, LEDGER, "seq", "_b", {"_episode": ("_flat", "sum_before")}, group_rows)
    d = d.withColumns({
        "_episode": F.coalesce("_episode", zero),
        "_ln": F.when(~F.col("_buy") & (F.col("shares_after") > 0), F.log(F.col("shares_after") / F.col("shares_before"))).otherwise(0.0)})
    keys = [*LEDGER, "_episode"]
    d = cumulative(d, keys, "seq", "_b", {"_scale": ("_ln", "sum")}, group_rows)
    # Scales are taken within segments of bounded decay; of earlier segments only the end before shows.
    d = d.withColumn("_seg", F.floor(-F.col("_scale") / SEGMENT_DECAY).cast("long"))
    within = -F.col("_scale") - SEGMENT_DECAY * F.col("_seg")
    d = d.withColumn("_term", F.when(F.col("_buy"), F.round(F.col("price") * F.col("shares"), 2) * F.exp(within)).otherwise(0.0))
    d = cumulative(d, [*keys, "_seg"], "seq", "_b", {"_paid": ("_term", "sum")}, group_rows)
    d = d.withColumn("_held", F.exp(-within) * F.col("_paid"))
    ends = d.groupBy(*keys, "_seg").agg(F.max_by(F.struct("_held", "_scale"), "seq").alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_seg"))
    d = d.join(ends.select(*keys, "_seg", before.alias("_before")), [*keys, "_seg"])
    held = F.col("_held") + F.coalesce(F.col("_before._held") * F.exp(F.col("_scale") - F.col("_before._scale")), F.lit(0.0))
    base = F.when(F.col("shares_after") > 0, F.col("shares_after")).otherwise(F.col("shares_before"))
    d = d.withColumn("avg_cost", held / base)
    sold = F.when(~F.col("_buy"), F.col("shares_before") - F.col("shares_after")).otherwise(zero)
    return d.withColumns({
        "cost_amount": F.when(F.col("shares_after") > 0, held).otherwise(0.0), "sold": sold,
        "realized": F.when(~F.col("_buy"), (F.col("price") - F.col("avg_cost")) * sold).otherwise(0.0)})


def holdings(ledger: DataFrame, bucket: Column, group_rows: int | None = None) -> DataFrame:
    """Newest position per (account, code)."""
    r = replay(ledger, bucket, group_rows)
    opening = F.col("_buy") & (F.col("shares_before") == 0)
    now = F.struct("shares_after", "avg_cost", "cost_amount", "price", "trade_date")
    h = r.groupBy(*LEDGER).agg(F.max_by(now, "seq").alias("n"), F.sum("realized").alias("realized"), F.count(F.lit(1)).alias("n_trades"),
                               F.max_by("trade_date", F.when(opening, F.col("seq"))).alias("buy_date"))
    open_ = F.col("n.shares_after") > 0
    return h.select(
        *LEDGER, F.col("n.shares_after").alias("shares"), F.round("n.avg_cost", 4).cast("decimal(12,4)").alias("avg_cost"),
        F.round("n.cost_amount", 2).cast("decimal(16,2)").alias("cost_amount"), F.round("realized", 2).cast("decimal(16,2)").alias("realized_pnl"),
        "buy_date", F.col("n.trade_date").alias("last_trade_date"), F.col("n.price").alias("last_trade_price"), "n_trades",
        F.when(open_, "holding").otherwise("closed").alias("status"))


def mark_to_market(h: DataFrame, closes: DataFrame, total_capital: float) -> DataFrame:
    """Market value, profit percent and position percent of open holdings."""
    j = h.where(F.col("status") == "holding").join(closes.select("code", F.col("close").alias("current_price")), "code", "left")
    px = F.coalesce("current_price", "last_trade_price")
    return j.withColumns({
        "current_price": px, "market_value": F.round(px * F.col("shares"), 2),
        "pnl_pct": F.when(F.col("avg_cost") > 0, F.round((px - F.col("avg_cost").cast("double")) / F.col("avg_cost").cast("double") * 100, 2)).otherwise(0.0),
        "position_pct": F.round(F.col("cost_amount").cast("double") / total_capital * 100, 2)})


def peak_since(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Highest close of each position since its buy date (at least the buy price)."""
    p = positions.select("code", "buy_date").join(prices.select("code", "trade_date", "close"), "code")
    top = p.where(F.col("trade_date") >= F.col("buy_date")).groupBy("code").agg(F.max("close").alias("_peak"))
    return positions.join(top, "code", "left").withColumn("peak_price", F.greatest("buy_price", F.coalesce("_peak", "buy_price"))).drop("_peak")


# Thresholds of the exit rules.
EXIT = {
    "hard_stop": 0.08, "time_days": 10, "time_ret": -0.02, "take_profit": 0.20, "trail": 0.12, "trail_from": 1.05, "ma_slack": 0.99,
    "ai_drop": 25.0, "score_drop": 20.0, "high_vol": 0.055, "idle_days": 5, "idle_ret": 0.01, "warn_loss": -0.05, "warn_days": 3,
}


def exit_scan(positions: DataFrame, today: Column, cfg: dict | None = None) -> DataFrame:
    """First matching rule per position: hard stop, take profit, soft stop, watch, else hold.

    Positions carry buy_price, buy_date, peak_price, buy_ai_score, buy_score and the current
    close, ma20, ai_score, score, volatility (missing ones fall back to the buy values).
    """
    k = EXIT | (cfg or {})
    px = F.coalesce("close", "buy_price")
    pnl = F.col("_px") / F.col("buy_price") - 1
    days = F.datediff(today, F.col("buy_date"))
    d = positions.withColumns({
        "_px": px, "_ma": F.coalesce("ma20", px), "_ai": F.coalesce("ai_score", "buy_ai_score"), "_sc": F.coalesce("score", "buy_score"),
        "_vol": F.coalesce("volatility", F.lit(0.02)), "_peak": F.greatest("peak_price", px)})
    d = d.withColumns({"pnl": pnl, "hold_days": days})
    p, n, ma = F.col("pnl"), F.col("hold_days"), F.col("_ma")
    down = (F.col("_peak") - F.col("_px")) / F.col("_peak")
    rules = [
        ("HARD_STOP", "fixed stop", "sell all", p <= -k["hard_stop"]), ("HARD_STOP", "time stop", "sell all", (n >= k["time_days"]) & (p <= k["time_ret"])),
        ("TAKE_PROFIT", "fixed profit", "sell all", p >= k["take_profit"]),
        ("TAKE_PROFIT", "trailing stop", "sell all", (F.col("_peak") > F.col("buy_price") * k["trail_from"]) & (down >= k["trail"])),
        ("SOFT_STOP", "below ma20", "halve", F.col("_px") < ma * k["ma_slack"]), ("SOFT_STOP", "ai score drop", "halve", F.col("buy_ai_score") - F.col("_ai") >= k["ai_drop"]),
        ("SOFT_STOP", "score drop", "halve", F.col("buy_score") - F.col("_sc") >= k["score_drop"]), ("SOFT_STOP", "high volatility", "halve", F.col("_vol") >= k["high_vol"]),
        ("SOFT_STOP", "idle money", "switch", (n >= k["idle_days"]) & (p < k["idle_ret"])),
    ]
    watch = [("near stop", p <= k["warn_loss"]), ("near ma20", (F.col("_px") < ma * 1.02) & (F.col("_px") > ma * 0.99)), ("still losing", (n >= k["warn_days"]) & (p < 0))]
    notes = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in watch]))
    first = F.coalesce(*[F.when(c, F.struct(F.lit(s).alias("signal"), F.lit(r).alias("reason"), F.lit(a).alias("action"))) for s, r, a, c in rules],
                       F.when(F.size(notes) > 0, F.struct(F.lit("WATCH").alias("signal"), F.array_join(notes, "; ").alias("reason"), F.lit("review").alias("action"))),
                       F.struct(F.lit("HOLD").alias("signal"), F.lit("").alias("reason"), F.lit("").alias("action")))
    d = d.withColumn("_x", first)
    return d.select(*positions.columns, F.round(F.col("pnl") * 100, 2).alias("pnl_pct"), "hold_days", "_x.signal", "_x.reason", "_x.action")


def exit_summary(scanned: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("signal") == s)
    a = scanned.agg(F.count(F.lit(1)).alias("total_positions"), n("HARD_STOP").alias("hard_stop_count"), n("TAKE_PROFIT").alias("take_profit_count"),
                    n("SOFT_STOP").alias("soft_stop_count"), n("WATCH").alias("watch_count"), n("HOLD").alias("clean_count"))
    return a.withColumn("action_required", F.col("hard_stop_count") + F.col("take_profit_count") > 0)


def exposure_advice(marked: DataFrame, total_capital: float, position: float) -> DataFrame:
    """Held value against the advised exposure (20 % band) and the deep losses."""
    a = marked.agg(F.sum("market_value").alias("total_mv"), F.count_if(F.col("pnl_pct") <= -8).alias("deep_losses"))
    mv = F.coalesce("total_mv", F.lit(0.0))
    want = total_capital * position
    return a.select(mv.alias("total_mv"), F.round(mv / total_capital * 100, 2).alias("held_pct"),
                    F.when(mv > want * 1.2, "reduce").when(mv < want * 0.8, "add").otherwise("match").alias("advice"), "deep_losses")


def align_signals(h: DataFrame, picks: DataFrame, sector_forecast: DataFrame, sector_flow: DataFrame, industry_map: DataFrame) -> DataFrame:
    """Holdings x newest picks x sector forecast x sector flow; the industry falls back to
    the pick's, and to its broad group for the sector lookups."""
    p = picks.groupBy(bare_code("code").alias("code")).agg(F.min_by(F.struct("bucket", "buy_score", "industry"), F.struct("priority", "code")).alias("p"))
    j = h.join(p, "code", "left").withColumn("ind", F.coalesce(F.nullif("industry", F.lit("")), "p.industry", F.lit("")))
    j = j.join(F.broadcast(industry_map.select(F.col("industry").alias("ind"), "broad")), "ind", "left").withColumn("_sw", F.coalesce("broad", "ind"))
    j = j.join(sector_forecast.select(F.col("sector").alias("_sw"), "p_up"), "_sw", "left")
    f = sector_flow.select(F.col("sector_name"), F.col("main_force_net"))
    j = j.join(f.select(F.col("sector_name").alias("ind"), F.col("main_force_net").alias("_f1")), "ind", "left")
    j = j.join(f.select(F.col("sector_name").alias("_sw"), F.col("main_force_net").alias("_f2")), "_sw", "left")
    return j.select("code", F.col("ind").alias("industry"), F.col("p.bucket").alias("bucket"), F.col("p.buy_score").alias("buy_score"),
                    F.col("p_up").alias("sector_p_up"), F.coalesce("_f1", "_f2").alias("industry_net"))


def profile(codes: DataFrame, parts: dict[str, DataFrame], on: str = "code", market: DataFrame | None = None) -> DataFrame:
    """One row per code from several per-code tables, plus a one-row market context."""
    out = codes
    for name, part in parts.items():
        rest: Sequence[str] = [c for c in part.columns if c != on]
        out = out.join(part.select(on, F.struct(*rest).alias(name)), on, "left")
    if market is not None:
        out = out.withColumn("market", market.limit(1).select(F.struct(*market.columns).alias("market")).scalar())
    return out
