"""Money-flow analytics between groups (sectors): lead-lag network, rotation, causality,
rank, attention and forecast.

Input: one row per (date, sector_name) with main_force_net, change_pct, turnover. The
number of sectors is bounded by the classification; the pairwise operators keep the 40
most active ones, as the method prescribes. Pair statistics come from partial Gram
matrices: one vector per date, matrix products inside the tasks, sums across them. No
pair of rows is ever materialised.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, first_existing, parse_amount, parse_percent, to_yi
from ..session import cut_lineage, stage_folder
from . import ranks, tiles
from .windows import Series, latest_per_key, run_lengths

SECTOR = Series("sector_name", "date")

# Accepted source column names, in order of preference.
SECTOR_NAMES = ("sector_name", "名称", "板块", "行业名称")
AMOUNT_NAMES = ("main_force_net", "主力净流入数值", "今日主力净流入-净额", "主力净流入", "今日主力净流入")
CHANGE_NAMES = ("change_pct", "今日涨跌幅", "涨跌幅", "涨跌幅%")
DATE_NAMES = ("date", "trade_date", "日期")


def normalize_flow(df: DataFrame, day: str | None = None, amount_names=AMOUNT_NAMES, version: str | None = None) -> DataFrame:
    """Resolve source columns, parse amounts and percents, keep one row per (date, sector): the
    newest ``version``, ties (or no version) by the greatest values."""
    sector, amount = first_existing(df, SECTOR_NAMES), first_existing(df, amount_names)
    change, date = first_existing(df, CHANGE_NAMES), first_existing(df, DATE_NAMES)
    out = df.select(
        (F.regexp_replace(F.col(date).cast("string"), "-", "") if date else F.lit(day)).alias("date"),
        F.trim(F.col(sector or df.columns[0]).cast("string")).alias("sector_name"),
        (parse_amount(amount) if amount else F.lit(0.0)).alias("main_force_net"),
        (parse_percent(change) if change else F.lit(0.0)).alias("change_pct"),
        *[F.col(c).try_cast("double").alias(c) for c in ("net_5d", "net_10d", "turnover") if c in df.columns],
        (F.col(version) if version else F.lit(0)).alias("_version"),
    ).where(F.length("sector_name") > 0)
    return latest_per_key(out, ["date", "sector_name"], "_version").drop("_version")


def snapshot(flow: DataFrame) -> DataFrame:
    return flow.where(F.col("date") == flow.agg(F.max("date").alias("newest")).scalar())


def summary(flow: DataFrame) -> DataFrame:
    """In/out/net sums and sign counts per date."""
    x = F.col("main_force_net")
    return flow.groupBy("date").agg(
        F.count(F.lit(1)).alias("sector_count"),
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("total_inflow"),
        F.abs(F.sum(F.when(x < 0, x).otherwise(0.0))).alias("total_outflow"),
        F.sum(x).alias("net_flow"), F.count_if(x > 0).alias("positive_count"), F.count_if(x < 0).alias("negative_count"),
    ).withColumns({f"{c}_yi": to_yi(c) for c in ("total_inflow", "total_outflow", "net_flow")})


def most_active(flow: DataFrame, keep: int = 40) -> DataFrame:
    """Rows of the sectors with the largest mean absolute net flow."""
    active = flow.groupBy("sector_name").agg(F.avg(F.abs("main_force_net")).alias("_a"))
    top = active.orderBy(F.col("_a").desc(), "sector_name").limit(keep).select("sector_name")
    return flow.join(F.broadcast(top), "sector_name", "left_semi")


def date_index(flow: DataFrame) -> DataFrame:
    """Dense 0-based index of the dates; one row per calendar date."""
    return tiles.dense_steps(flow, "date")


#: Sums of a pair: x is the source some dates back, y the target now, z the target one date back.
PAIR_SUMS = ("n", "sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "sxz", "syz", "src_pos", "both_pos")


def _lagged_products(depth: int, split: bool):
    """Terms of :func:`tiles.pair_sums` for every lag up to ``depth``."""

    def run(sources: np.ndarray, targets: np.ndarray, before: int):
        for lag in range(1, depth + 1):
            now = np.arange(max(before, lag), len(targets))  # an earlier date must be there
            if not len(now):
                continue
            x, y, z = sources[now - lag], targets[now], targets[now - 1]
            px, py = (np.nan_to_num(x) > 0).astype(float), (np.nan_to_num(y) > 0).astype(float)
            if split:
                x, y, z = np.clip(-np.nan_to_num(x), 0, None), np.clip(np.nan_to_num(y), 0, None), np.clip(np.nan_to_num(z), 0, None)
            fx, fy = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            z = np.where(fy > 0, np.nan_to_num(z), 0.0)
            yield lag, [fx.T @ fy, x.T @ fy, fx.T @ y, fx.T @ z, (x * x).T @ fy, fx.T @ (y * y), fx.T @ (z * z),
                        x.T @ y, x.T @ z, fx.T @ (y * z), px.T @ np.ones_like(py), px.T @ py]

    return run


def pair_statistics(flow: DataFrame, depth: int = 1, split: bool = False, keep: int | None = None, tile: int = tiles.TILE_KEYS) -> DataFrame:
    """Centred second moments for every ordered sector pair and lag 1..depth.

    ``split`` uses source outflow and target inflow (missing = 0); else raw net flows with
    missing dates excluded. Values are scaled by each sector's mean size before the
    products, so the sums stay well conditioned; correlations and F are scale free.
    Pairs are worked out a tile of ``tile`` x ``tile`` sectors at a time.
    """
    pruned = flow if keep is None else most_active(flow, keep)
    scale = pruned.groupBy("sector_name").agg(F.avg(F.abs("main_force_net")).alias("_u"))
    scaled = pruned.join(scale, "sector_name").withColumn("main_force_net", F.try_divide(F.col("main_force_net"), F.col("_u")))
    panel = scaled.join(F.broadcast(date_index(pruned)), "date").select("sector_name", "t", "main_force_net")  # a row per calendar date
    s = tiles.pair_sums(panel, "sector_name", "main_force_net", _lagged_products(depth, split), PAIR_SUMS, depth=depth, tile=tile)
    n = F.nullif(F.col("n"), F.lit(0.0))  # no date in common: no moments
    mom = {f"c{a}{b}": F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / n
           for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))}
    return s.select("source", "target", "lag", "n", "src_pos", "both_pos", *[c.alias(k) for k, c in mom.items()])


FLAT = 1e-12


def _corr() -> Column:
    ok = (F.col("n") >= 3) & (F.col("cxx") > FLAT) & (F.col("cyy") > FLAT)
    return F.when(ok, F.col("cxy") / F.sqrt(F.col("cxx") * F.col("cyy"))).otherwise(0.0)


def _f_score() -> Column:
    """F of adding the lagged source to target ~ 1 + lagged target, in closed form."""
    cyy, czz, cxx = F.col("cyy"), F.col("czz"), F.col("cxx")
    cyz, cxy, cxz = F.col("cyz"), F.col("cxy"), F.col("cxz")
    restricted = F.when(czz > FLAT, cyy - cyz * cyz / czz).otherwise(cyy)
    det = czz * cxx - cxz * cxz
    both = cyy - (cyz * cyz * cxx - 2 * cyz * cxy * cxz + cxy * cxy * czz) / det
    single = F.when(cxx > FLAT, F.least(restricted, cyy - cxy * cxy / cxx)).otherwise(restricted)
    full = F.greatest(F.when(det > 1e-10 * F.greatest(czz * cxx, F.lit(FLAT)), both).otherwise(single), F.lit(0.0))
    gain = F.greatest(restricted - full, F.lit(0.0))
    den = full / F.greatest(F.col("n") - 3, F.lit(1.0))
    usable = (cxx > FLAT) & (cyy > FLAT)
    return F.when(~usable, 0.0).when(den > FLAT * cyy, gain / den).when(gain > FLAT * cyy, 9999.0).otherwise(0.0)


def network_edges(flow: DataFrame, threshold: float = 0.35, limit: int = 30) -> DataFrame:
    """Lag-1 correlation edges with the historical hit rate of their direction."""
    total = flow.select("date").distinct().agg(F.count(F.lit(1)).alias("days"))
    base = flow.groupBy("sector_name").agg(F.count_if(F.col("main_force_net") > 0).alias("_pos"))
    base = base.select(F.col("sector_name").alias("target"), F.round(F.col("_pos") / total.scalar(), 3).alias("_base"))
    e = pair_statistics(flow, 1).withColumn("correlation", F.round(_corr(), 4))
    e = e.where(F.abs(_corr()) >= threshold).join(F.broadcast(base), "target")
    tested = F.col("src_pos") >= 3
    e = e.select(
        "source", "target", F.abs("correlation").alias("weight"), "correlation", F.lit(1).alias("lead_days"),
        F.when(tested, F.round(F.col("both_pos") / F.col("src_pos"), 3)).alias("hit_rate"),
        F.when(tested, F.col("_base")).alias("hit_base"), F.col("src_pos").cast("long").alias("samples"))
    order = [F.col("hit_rate").isNotNull().desc(), F.col("weight").desc(), "source", "target"]
    return e.orderBy(*order).limit(limit)


def granger_edges(flow: DataFrame, limit: int = 20) -> DataFrame:
    """Pairs whose lagged flow explains the target beyond its own lag."""
    e = pair_statistics(flow, 1).where(F.col("n") >= 5)
    e = e.select("source", "target", F.round(_f_score(), 4).alias("f_score"), F.round(_corr(), 4).alias("lag_correlation"),
                 F.lit(1).alias("lag_days"))
    e = e.where((F.col("f_score") >= 1.0) | (F.abs("lag_correlation") >= 0.4))
    return e.orderBy(F.col("f_score").desc(), F.abs("lag_correlation").desc(), "source", "target").limit(limit)


def streak_statistics(flow: DataFrame) -> DataFrame:
    """Per sector: current inflow run, and how often a run of two or more went on."""
    s = SECTOR
    df = run_lengths(flow, s, (F.col("main_force_net") > 0).cast("int"), "_run")
    df = df.withColumn("_run", F.when(F.col("main_force_net") > 0, F.col("_run")).otherwise(0))
    df = df.withColumn("_next", s.lead((F.col("main_force_net") > 0).cast("int")))
    long_run = (F.col("_run") >= 2) & F.col("_next").isNotNull()
    out = df.groupBy("sector_name").agg(
        F.max_by("_run", "date").alias("streak"), F.count_if(long_run).alias("continue_n"),
        F.count_if(long_run & (F.col("_next") == 1)).alias("_hit"), F.max("_run").alias("longest_run"))
    prob = F.when(F.col("continue_n") >= 5, F.round(F.col("_hit") / F.col("continue_n"), 3))
    return out.withColumn("continue_prob", prob).drop("_hit")


def rotation_edges(flow: DataFrame, max_lag: int = 3, window: int = 5, threshold: float = 0.42, limit: int = 20) -> DataFrame:
    """Outflow-to-inflow routes: best lag per pair, confidence and persistence of the target."""
    days = date_index(flow)
    base = flow.join(F.broadcast(days), "date").withColumn("_t_max", days.agg(F.max("t").alias("last")).scalar())
    recent = F.col("t") > F.col("_t_max") - window
    out, inn = F.greatest(-F.col("main_force_net"), F.lit(0.0)), F.greatest(F.col("main_force_net"), F.lit(0.0))
    per = base.groupBy("sector_name").agg(
        (F.sum(F.when(recent, out).otherwise(0.0)) / window).alias("pressure"),
        (F.count_if(recent & (out > 0)) / window).alias("out_share"),
        (F.sum(F.when(recent, inn).otherwise(0.0)) / window).alias("momentum"),
        (F.count_if(recent & (inn > 0)) / window).alias("in_share"),
        (F.sum(out) / (F.max("_t_max") + 1)).alias("out_base"), (F.sum(inn) / (F.max("_t_max") + 1)).alias("in_base"))
    per = per.join(streak_statistics(flow), "sector_name")
    src = per.select(F.col("sector_name").alias("source"), "pressure", "out_share", "out_base").where(F.col("pressure") > 0)
    tgt = per.select(F.col("sector_name").alias("target"), "momentum", "in_share", "in_base", "streak", "continue_prob")
    tgt = tgt.where((F.col("momentum") > 0) & (F.col("in_share") >= 0.6))
    p = pair_statistics(flow, max_lag, split=True).withColumns({"lag_correlation": _corr(), "f_score": _f_score()})
    p = p.where((F.col("n") >= 5) & (F.col("lag_correlation") >= threshold))
    p = p.join(F.broadcast(src), "source").join(F.broadcast(tgt), "target")
    consistency = (F.col("out_share") + F.col("in_share")) / 2
    strength = bound((F.col("pressure") / F.greatest(F.coalesce(F.nullif("out_base", F.lit(0.0)), F.col("pressure")), F.lit(1.0))
                      + F.col("momentum") / F.greatest(F.coalesce(F.nullif("in_base", F.lit(0.0)), F.col("momentum")), F.lit(1.0))) / 4, 0.0, 1.0)
    conf = bound(0.45 * F.col("lag_correlation") + 0.20 * consistency + 0.20 * bound(F.col("f_score") / 5, 0.0, 1.0) + 0.15 * strength, 0.0, 1.0)
    persist = bound(0.45 * F.col("in_share") + 0.30 * F.least(F.lit(1.0), F.col("streak") / 4)
                    + 0.25 * F.coalesce("continue_prob", F.lit(0.5)), 0.0, 1.0)
    p = p.where(consistency >= 0.4).withColumns({
        "amount": F.least("pressure", "momentum") * conf, "confidence": F.round(conf, 4), "persistence": F.round(persist, 4),
        "final_score": F.round(0.6 * conf + 0.4 * persist, 4)})
    w = Window.partitionBy("source", "target").orderBy(F.col("confidence").desc(), "lag")
    best = p.withColumn("_b", F.row_number().over(w)).where((F.col("_b") == 1) & (F.col("confidence") >= threshold))
    best = best.select(
        "source", "target", to_yi("amount").alias("amount_yi"), "confidence", F.col("lag").alias("lag_days"),
        F.round("lag_correlation", 4).alias("lag_correlation"), F.round(F.least("f_score", F.lit(9999.0)), 4).alias("f_score"),
        to_yi("pressure").alias("source_pressure_yi"), to_yi("momentum").alias("target_momentum_yi"),
        F.col("streak").alias("target_streak"), F.col("continue_prob").alias("target_continue_prob"), "persistence", "final_score", "amount")
    return best.orderBy(F.col("final_score").desc(), F.col("confidence").desc(), F.col("amount").desc(), "source", "target").limit(limit)


SMALL_GRAPH = 200


def stored_links(edges: DataFrame) -> tuple[str, DataFrame]:
    """(table, links): the shares of every source's weight, stored once in buckets of the source, so that joins on the
    source move no link; the table lies in the application's stages."""
    spark = edges.sparkSession
    e = edges.groupBy("source", "target").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    out = e.groupBy("source").agg(F.sum("weight").alias("_out"))
    links = e.join(out, "source").select("source", "target", (F.col("weight") / F.col("_out")).alias("share"))
    name, buckets = f"links_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    links.repartition(buckets, "source").write.bucketBy(buckets, "source").sortBy("source").option("path", f"{stage_folder(spark)}/{name}").saveAsTable(name)
    return name, spark.table(name)


def received(links: DataFrame, rank: DataFrame) -> DataFrame:
    """What every node gets of the ranks of its sources: ranks move to the links, partial sums to the targets."""
    moved = links.join(rank.select(F.col("node").alias("source"), "rank"), "source")
    return moved.groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("_in"))


def page_rank(edges: DataFrame, damping: float = 0.85, iterations: int = 40, store_every: int = 8, small: int = SMALL_GRAPH, tolerance: float = 1e-10) -> DataFrame:
    """Weighted PageRank with dangling mass spread evenly.

    A counted small graph (the edge lists above keep at most 30 edges) is one row of arrays
    and a single fold. Larger graphs iterate by joins with links stored in buckets, until the ranks change by less
    than ``tolerance`` in total, or for ``iterations`` steps: the dangling mass and the change of a step come from the
    action that fills the step's cache, and every ``store_every`` steps the ranks are stored, so a lost executor
    replays few steps.
    """
    spark = edges.sparkSession
    table, links = stored_links(edges)
    try:
        ends = links.select(F.col("source").alias("node"), F.lit(False).alias("sink")).union(links.select("target", F.lit(True)))
        nodes = cut_lineage(ends.groupBy("node").agg(F.bool_and("sink").alias("sink")))
        count = nodes.count()
        if count <= small:
            return cut_lineage(_page_rank_fold(links, damping, iterations))
        rank, held = nodes.select("node", "sink", F.lit(1.0 / count).alias("rank"), F.lit(0.0).alias("old")), []
        for step in range(iterations):
            state = rank.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)), F.sum(F.abs(F.col("rank") - F.col("old")))).first()
            if state[1] < tolerance:
                break
            value = (1 - damping) / count + damping * (F.coalesce("_in", F.lit(0.0)) + state[0] / count)
            rank = rank.join(received(links, rank), "node", "left").select("node", "sink", value.alias("rank"), F.col("rank").alias("old"))
            if step % store_every == store_every - 1:
                rank = cut_lineage(rank)
                for old in held:
                    old.unpersist()
                held = []
            else:
                rank = rank.persist()
                held.append(rank)
        rank = cut_lineage(rank)
        for old in held:
            old.unpersist()
        return rank.select(F.col("node").alias("sector_name"), F.round("rank", 6).alias("pagerank"))
    finally:
        spark.sql(f"drop table if exists {table}")  # an outside table: its files stay with the stages


def _page_rank_fold(links: DataFrame, damping: float, iterations: int) -> DataFrame:
    rows = links.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("source", "share"))).alias("m"))
    g = rows.agg(F.map_from_entries(F.collect_list(F.struct("target", "m"))).alias("into"))
    names = links.agg(F.struct(F.array_sort(F.array_union(F.collect_set("source"), F.collect_set("target"))).alias("nodes"), F.collect_set("source").alias("srcs")).alias("n"))
    g = g.withColumn("n", names.scalar()).select("into", "n.*").withColumn("size", F.size("nodes").cast("double"))
    cell = lambda t, s: F.when(F.array_contains("srcs", s), F.coalesce(F.try_element_at(F.try_element_at("into", t), s), F.lit(0.0))).otherwise(1.0 / F.col("size"))
    g = g.withColumn("mat", F.transform("nodes", lambda t: F.transform("nodes", lambda s: cell(t, s))))
    dot = lambda row, acc: F.aggregate(F.zip_with(row, acc, lambda x, y: x * y), F.lit(0.0), lambda z, x: z + x)
    step = lambda acc, _: F.transform("mat", lambda row: (1 - damping) / F.col("size") + damping * dot(row, acc))
    start = F.transform("nodes", lambda s: 1.0 / F.col("size"))
    g = g.withColumn("res", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step))
    z = g.select(F.explode(F.arrays_zip("nodes", "res")).alias("z"))
    return z.select(F.col("z.nodes").alias("sector_name"), F.round("z.res", 6).alias("pagerank"))


def proportional_edges(flow: DataFrame, limit: int = 5) -> DataFrame:
    """Per date: the ``limit`` largest outflows and inflows linked in proportion (2 * limit kept)."""
    side = lambda cond, order: ranks.top_n(flow.where(cond), ["date"], [order, F.col("sector_name")], limit, "sector_name", "_p")
    pack = lambda df, name: df.groupBy("date").agg(
        F.array_sort(F.collect_list(F.struct("_p", "sector_name", F.abs("main_force_net").alias("v")))).alias(name),
        F.sum(F.abs("main_force_net")).alias(f"{name}_total"))
    x = F.col("main_force_net")
    both = pack(side(x < 0, x.asc()), "outs").join(pack(side(x > 0, x.desc()), "ins"), "date")
    scale = F.least("outs_total", "ins_total")
    e = both.select("date", F.explode("outs").alias("o"), "ins", "outs_total", "ins_total", scale.alias("scale"))
    e = e.select("date", "o", F.explode("ins").alias("i"), "outs_total", "ins_total", "scale")
    amount = F.col("o.v") / F.col("outs_total") * F.col("i.v") / F.col("ins_total") * F.col("scale")
    e = e.select("date", F.col("o.sector_name").alias("source"), F.col("i.sector_name").alias("target"), amount.alias("amount"))
    e = e.where(F.col("amount") > 0).withColumn("amount_yi", to_yi("amount"))
    return ranks.top_n(e, ["date"], [F.round("amount", 6).desc(), F.col("source"), F.col("target")], 2 * limit, "source", "pos")


def anomalies(flow: DataFrame, threshold: float = 1.5, limit: int = 10) -> DataFrame:
    """Newest flow of a sector against its own history, by |z|."""
    stats = flow.groupBy("sector_name").agg(F.avg("main_force_net").alias("_m"), F.stddev_samp("main_force_net").alias("_s"))
    z = F.try_divide(F.col("main_force_net") - F.col("_m"), F.nullif("_s", F.lit(0.0)))
    rows = snapshot(flow).join(stats, "sector_name").withColumn("z_score", z).where(F.abs("z_score") >= threshold)
    rows = rows.withColumns({"z_score": F.round("z_score", 3), "anomaly_type": F.when(F.col("z_score") > 0, "surge").otherwise("flight")})
    return rows.orderBy(F.abs("z_score").desc(), "sector_name").limit(limit).select(
        "sector_name", "main_force_net", "change_pct", "z_score", "anomaly_type")


def multi_day_frame(flow: DataFrame) -> DataFrame:
    """Newest row per sector with 5/10-date sums, intensity and signed streak."""
    days = date_index(flow)
    df = flow.join(F.broadcast(days), "date").withColumn("_tm", days.agg(F.max("t").alias("last")).scalar())
    within = lambda n: F.col("t") > F.col("_tm") - n
    tail = lambda c, n: F.sum(F.when(within(n), F.col(c)))
    sign = F.signum("main_force_net").cast("int")
    df = run_lengths(df.where(F.col("_tm") >= 2), SECTOR, sign, "_run").withColumn("_ss", F.col("_run") * sign)
    out = df.groupBy("sector_name").agg(
        F.max(F.when(F.col("t") == F.col("_tm"), F.col("main_force_net"))).alias("main_force_net"),
        F.max(F.when(F.col("t") == F.col("_tm"), F.col("change_pct"))).alias("change_pct"),
        F.max(F.when(F.col("t") == F.col("_tm"), F.col("turnover"))).alias("turnover"),
        tail("main_force_net", 5).alias("net_5d"), tail("main_force_net", 10).alias("net_10d"),
        tail("turnover", 5).alias("turnover_5d"), tail("change_pct", 5).alias("chg_5d"),
        F.max_by("_ss", "date").cast("long").alias("streak"))
    pct = lambda a, b: F.round(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0))) * 100, 2)
    return out.where(F.col("main_force_net").isNotNull()).withColumns({
        "intensity": pct("main_force_net", "turnover"), "intensity_5d": pct("net_5d", "turnover_5d")})


def attention(frame: DataFrame, limit: int = 14, lowest: int = 3, group_rows: int = ranks.WINDOW_ROWS) -> DataFrame:
    """0..100 attention from ranks of today, 5 and 10 dates and acceleration; top and bottom rows."""
    f = frame.withColumns({
        "_one": F.lit(1), "_n5": F.coalesce("net_5d", "main_force_net"),
        "_n10": F.coalesce("net_10d", "net_5d", "main_force_net")})
    f = f.withColumn("accel", F.col("main_force_net") - F.col("_n5") / 5)
    f = ranks.average_ranks(f, ["_one"], {"_rt": "main_force_net", "_ri": "intensity", "_r5": "_n5", "_r10": "_n10", "_ra": "accel"}, group_rows)
    w = Window.partitionBy("_one")
    enough = F.count("intensity").over(w) >= F.greatest(F.lit(3), F.floor(F.count(F.lit(1)).over(w) / 3))
    today = F.when(enough, 0.5 * F.col("_ri") + 0.5 * F.col("_rt")).otherwise(F.col("_rt"))
    f = f.withColumn("attention_raw", (0.38 * today + 0.34 * F.col("_r5") + 0.18 * F.col("_r10") + 0.10 * F.col("_ra")) * 100)
    t, n5, acc = F.col("main_force_net"), F.col("net_5d"), F.col("accel")
    c5 = F.coalesce("chg_5d", "change_pct")
    up = (t > 0) & (n5 > 0)
    label = (F.when(up & (acc > 0) & (c5 < 3.0), "accelerating accumulation").when(up & (acc > 0), "accelerating inflow")
             .when(up & (c5 < 2.0), "accumulation").when(up, "steady inflow").when((t > 0) & (n5 <= 0), "turning warm")
             .when((t <= 0) & (n5 > 0) & ((F.col("_r10") >= 0.6) | (c5 >= 5.0)), "distribution at high")
             .when((t < 0) & (n5 <= 0), "steady outflow").otherwise("tug of war"))
    f = f.withColumns({"label": label, "attention": F.round("attention_raw").cast("long"), "accel_yi": to_yi("accel"),
                       "main_force_net_yi": to_yi("main_force_net"), "net_5d_yi": to_yi("net_5d"), "net_10d_yi": to_yi("net_10d")})
    total = F.count(F.lit(1)).over(w)
    pos = F.row_number().over(w.orderBy(F.round("attention_raw", 9).desc(), "sector_name"))
    f = f.withColumns({"pos": pos, "_n": total})
    keep = (F.col("pos") <= limit) | ((F.col("_n") > limit) & (F.col("pos") > F.col("_n") - lowest))
    return f.where(keep).select("pos", "sector_name", "attention", "label", "main_force_net_yi", "net_5d_yi", "net_10d_yi",
                                "accel_yi", F.col("intensity").alias("intensity_pct"), "change_pct", "streak")


def forecast(frame: DataFrame, edges: DataFrame, limit: int = 8, group_rows: int = ranks.WINDOW_ROWS) -> DataFrame:
    """Tendency of the next dates: momentum, streak, accumulation, driven routes; both sides."""
    driven = edges.groupBy(F.col("target").alias("sector_name")).agg(
        F.max_by(F.struct("confidence", "source"), F.struct("confidence", "source")).alias("_d"))
    f = frame.join(driven, "sector_name", "left").withColumns({"_one": F.lit(1), "_n5": F.coalesce("net_5d", F.lit(0.0))})
    f = ranks.average_ranks(f, ["_one"], {"_r": "_n5"}, group_rows)
    c5 = F.coalesce("chg_5d", "change_pct", F.lit(0.0))
    gather = (F.col("main_force_net") > 0) & (F.col("net_5d") > 0) & (c5 < 2.0)
    drive = F.least(F.coalesce(F.col("_d.confidence"), F.lit(0.0)) * 2.0, F.lit(1.0))
    raw = (0.35 * (F.col("_r") - 0.5) * 2 + 0.25 * F.greatest(F.least("streak", F.lit(5)), F.lit(-5)) / 5
           + 0.20 * F.when(gather, 1.0).otherwise(0.0) + 0.20 * drive)
    reasons = F.array_compact(F.array(
        F.when(gather, "accumulation"), F.when(F.col("_d.source").isNotNull() & (drive > 0.2), F.concat(F.lit("route from "), F.col("_d.source"))),
        F.when(F.abs("streak") >= 3, F.concat(F.abs("streak").cast("string"), F.when(F.col("streak") > 0, " dates in").otherwise(" dates out"))),
        F.when(F.abs(F.coalesce("intensity_5d", F.lit(0.0))) >= 3.0, "strong intensity")))
    f = f.withColumns({"score": F.round(raw * 100, 1), "direction": F.when(raw > 0, "inflow").otherwise("outflow"),
                       "reasons": F.when(F.size(reasons) == 0, F.array(F.lit("trend goes on"))).otherwise(reasons)})
    key = F.when(F.col("direction") == "inflow", -F.col("score")).otherwise(F.col("score"))
    f = f.withColumn("pos", F.row_number().over(Window.partitionBy("direction").orderBy(key, "sector_name")))
    keep = F.when(F.col("direction") == "inflow", F.col("pos") <= limit).otherwise(F.col("pos") <= max(3, limit // 2))
    return f.where(keep).select("direction", "pos", "sector_name", "score", "reasons", to_yi("main_force_net").alias("main_force_net_yi"))


def market_read(att: DataFrame, totals: DataFrame) -> DataFrame:
    """Focus, risk side and breadth of the newest date in one row."""
    lead = att.agg(
        F.min_by("sector_name", "pos").alias("focus"), F.min_by("attention", "pos").alias("focus_attention"),
        F.coalesce(F.max_by("sector_name", F.when(F.col("net_5d_yi") < 0, F.col("pos"))), F.max_by("sector_name", "pos")).alias("risk"))
    now = totals.agg(F.max_by(F.struct("sector_count", "positive_count"), "date").alias("s"))
    b = F.col("s.positive_count") / F.col("s.sector_count")
    hint = F.when(b >= 0.55, "broad inflow").when(b >= 0.45, "narrow focus").otherwise("defensive")
    return lead.withColumn("s", now.scalar()).select(
        "focus", "focus_attention", "risk", hint.alias("breadth_hint"))


def payload(flow: DataFrame) -> dict[str, DataFrame]:
    """Every flow result, each a lazy DataFrame."""
    frame, routes, net = multi_day_frame(flow), rotation_edges(flow), network_edges(flow)
    att, totals = attention(frame), summary(flow)
    return {
        "summary": totals, "top_inflow": snapshot(flow).orderBy(F.col("main_force_net").desc(), "sector_name").limit(10),
        "top_outflow": snapshot(flow).orderBy("main_force_net", "sector_name").limit(10), "anomalies": anomalies(flow),
        "sankey_edges": proportional_edges(flow), "rotation_edges": routes, "network_edges": net,
        "granger_edges": granger_edges(flow), "attention_ranking": att, "forecast": forecast(frame, routes),
        "market_read": market_read(att, totals),
    }


def industry_flow(money: DataFrame, basic: DataFrame, daily: DataFrame) -> DataFrame:
    """Large and extra-large order flow per (date, industry) with mean change and turnover."""
    part = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    net = (part("buy_lg_amount") + part("buy_elg_amount") - part("sell_lg_amount") - part("sell_elg_amount")) * 10000.0
    m = money.select("ts_code", "trade_date", net.alias("net")).join(basic.select("ts_code", "industry"), "ts_code", "left")
    m = m.withColumn("sector_name", F.trim(F.coalesce("industry", F.lit("")))).where(~F.lower("sector_name").isin("", "nan"))
    d = daily.select("ts_code", "trade_date", F.col("pct_chg").try_cast("double").alias("pct"), F.col("amount").try_cast("double").alias("amt"))
    m = m.join(d, ["ts_code", "trade_date"], "left")
    return m.groupBy(F.col("trade_date").alias("date"), "sector_name").agg(
        F.sum("net").alias("main_force_net"), F.round(F.coalesce(F.avg("pct"), F.lit(0.0)), 4).alias("change_pct"),
        (F.sum(F.coalesce("amt", F.lit(0.0))) * 1000.0).alias("turnover"))
