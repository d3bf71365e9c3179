"""Factor and model evaluation: rank IC, decay, weights, folds, ensembles, drift."""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, safe_corr
from ..session import cut_lineage, dealt
from . import ranks
from .xsection import join_stats

TINY = 1e-9


def unpivot_factors(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ret: str) -> DataFrame:
    packed = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(*keys, F.col(ret).alias("y"), F.explode(packed).alias("p"))
    return long.select(*keys, "p.factor", "p.x", "y")


def spearman(long: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", min_rows: int = 11,
             short_is_zero: bool = False, group_rows=None) -> DataFrame:
    """Rank correlation per group over rows where both sides are present.

    Groups below ``min_rows`` are dropped or, with ``short_is_zero``, get 0.
    """
    rows = long.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = ranks.average_ranks(rows, by, {"_rx": x, "_ry": y}, group_rows, pct=False)
    ic = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(safe_corr("_rx", "_ry"), 12).alias("_c"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"))
    ok = (F.col("_sx") > 0) & (F.col("_sy") > 0) & (F.col("n") >= min_rows)
    ic = ic.withColumn("ic", F.when(ok, F.col("_c")).otherwise(F.lit(0.0) if short_is_zero else F.lit(None)))
    return ic.where(F.col("ic").isNotNull()).select(*by, "n", "ic")


def factor_ic(df: DataFrame, cols: Sequence[str], ret: str, group_rows=None, **kw) -> DataFrame:
    """(factor, trade_date) -> IC."""
    return spearman(unpivot_factors(df, ["trade_date"], cols, ret), ["factor", "trade_date"], group_rows=group_rows, **kw)


def ic_summary(ic: DataFrame, by: Sequence[str] = ("factor",), ddof: int = 1) -> DataFrame:
    std = F.stddev_samp if ddof else F.stddev_pop
    out = ic.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), std("ic").alias("ic_std"), F.count("ic").alias("periods"))
    return out.withColumn("ir", F.col("ic_mean") / (F.coalesce("ic_std", F.lit(0.0)) + TINY))


def _positions(ic: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key)
    return ic.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})


def crowding(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """1 - IQR / range of each factor (0 below 100 values)."""
    long = df.withColumn("_y", F.lit(0.0))
    long = unpivot_factors(long, [], cols, "_y").where(F.col("x").isNotNull())
    q = ranks.quantiles(long, ["factor"], {"_a": ("x", 0.25), "_b": ("x", 0.75)})
    s = long.groupBy("factor").agg(F.count("x").alias("_n"), F.max("x").alias("_hi"), F.min("x").alias("_lo"))
    span = F.col("_hi") - F.col("_lo")
    c = F.when((F.col("_n") >= 100) & (span > 0), bound(1 - (F.col("_b") - F.col("_a")) / span, 0.0, 1.0)).otherwise(0.0)
    return q.join(s, "factor").select("factor", c.alias("crowding_score"))


def factor_report(ic: DataFrame, crowd: DataFrame, min_ic: float = 0.02, alarm_periods: int = 3) -> DataFrame:
    """IC statistics, decay of the last five against the first five, alarm and score."""
    p = _positions(ic, "factor", "trade_date")
    edge = lambda cond: F.avg(F.when(cond, F.abs("ic")))
    tail = F.col("_i") >= F.col("_n") - alarm_periods
    r = p.groupBy("factor").agg(
        F.max_by("ic", "trade_date").alias("ic_current"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("_sd"),
        F.count("ic").alias("sample_count"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"),
        edge(F.col("_i") < 5).alias("_early"), edge(F.col("_i") >= F.col("_n") - 5).alias("_late"),
        F.count_if(tail & (F.abs("ic") >= min_ic)).alias("_alive"))
    sd = F.when(F.col("sample_count") > 1, F.col("_sd")).otherwise(0.01)
    r = r.withColumn("ic_std", sd).withColumns({
        "ir": F.col("ic_mean") / (F.col("ic_std") + TINY),
        "t_stat": F.col("ic_mean") / (F.col("ic_std") / F.sqrt("sample_count") + TINY),
        "decay_score": F.when(F.col("sample_count") >= 10, bound(1 - F.col("_late") / (F.col("_early") + TINY), 0.0, 1.0)).otherwise(0.0),
        "is_decaying": (F.col("sample_count") >= alarm_periods) & (F.col("_alive") == 0),
    }).join(crowd, "factor", "left").withColumn("crowding_score", F.coalesce("crowding_score", F.lit(0.0)))
    score = (0.35 * F.abs("ir") + 0.25 * F.col("positive_ratio") + 0.20 * (1 - F.col("decay_score"))
             + 0.10 * (1 - F.col("crowding_score")) + 0.10 * F.least(F.abs("t_stat") / 2, F.lit(1.0)))
    r = r.withColumn("composite_score", F.when(F.col("is_decaying"), score * 0.3).otherwise(score))
    return r.drop("_sd", "_early", "_late", "_alive")


def select_factors(report: DataFrame, min_ic: float = 0.02, min_ir: float = 0.3, top_k: int = 50, drop_decayed: bool = True) -> DataFrame:
    ok = (F.abs("ic_mean") >= min_ic) & (F.abs("ir") >= min_ir)
    if drop_decayed:
        ok = ok & ~F.col("is_decaying")
    return report.where(ok).orderBy(F.round("composite_score", 9).desc(), "factor").limit(top_k)


def decay_check(ic: DataFrame, ic_threshold=0.02, ir_threshold=0.3, lookback=20, periods=3) -> DataFrame:
    """At each period: did the last IC values stay low, or is the IR of the window low?"""
    w = Window.partitionBy("factor").orderBy("trade_date")
    far, near = w.rowsBetween(-(lookback - 1), 0), w.rowsBetween(-(periods - 1), 0)
    n = F.count("ic").over(far)
    ir = F.when(n < 2, 0.0).otherwise(F.avg("ic").over(far) / (F.stddev_pop("ic").over(far) + TINY))
    df = ic.withColumns({"periods": n, "ir": ir, "recent_ic": F.avg("ic").over(near), "_hi": F.max("ic").over(near)})
    low = F.col("_hi") < ic_threshold
    enough = F.col("periods") >= periods
    return df.withColumns({
        "is_decaying": enough & (low | (F.col("ir") < ir_threshold)),
        "reason": F.when(~enough, "short history").when(low, "low ic").when(F.col("ir") < ir_threshold, "low ir").otherwise("healthy"),
    }).drop("_hi")


def health_report(ic: DataFrame, lookback: int = 20, **kw) -> DataFrame:
    """Newest decay state per factor with the moments of its window."""
    w = Window.partitionBy("factor").orderBy("trade_date").rowsBetween(-(lookback - 1), 0)
    df = decay_check(ic, lookback=lookback, **kw).withColumns({"ic_mean": F.avg("ic").over(w), "ic_std": F.stddev_pop("ic").over(w)})
    pack = F.struct("ic_mean", "ic_std", "ir", "is_decaying", "reason", "periods")
    return df.groupBy("factor").agg(F.max_by(pack, "trade_date").alias("h")).select("factor", "h.*")


# Baseline weights of the score components and their regime adjustments
# (multiplier, cap).
BASELINE = {
    "rule_baseline": 0.25, "small_cap": 0.30, "xgboost": 0.15, "ai": 0.12, "dual": 0.08, "nlp": 0.05,
    "valuation_attractiveness": 0.10, "xgnn": 0.03, "original": 0.01, "advanced_factors": 0.01,
}
REGIME_ADJUST = {
    "small_cap_rally": {"small_cap": (1.40, 0.55), "valuation_attractiveness": (0.85, None), "ai": (1.10, None),
                        "xgnn": (1.10, None), "original": (0.80, None)},
    "balanced": {"small_cap": (1.10, 0.40), "valuation_attractiveness": (1.25, 0.18), "rule_baseline": (1.05, 0.35)},
    "large_cap_rally": {"small_cap": (0.75, None), "valuation_attractiveness": (1.10, 0.15), "xgboost": (1.10, None), "nlp": (1.10, None)},
    "volatile": {"small_cap": (0.85, None), "valuation_attractiveness": (0.80, None), "xgboost": (1.15, None),
                 "nlp": (0.85, None), "advanced_factors": (1.10, None)},
    "bear": {"valuation_attractiveness": (0.65, None)},
    "high_vol_bear": {"valuation_attractiveness": (0.65, None)},
}
PROTECTED = "rule_baseline"


def dynamic_weights(ic: DataFrame, components: Sequence[str], regime: str = "balanced", crowded: DataFrame | None = None,
                    last: DataFrame | None = None, lookback: int = 20, smooth: float = 0.5, floor: float = 0.03,
                    cap: float = 0.60, baseline: dict[str, float] | None = None) -> DataFrame:
    """Component weights: recency-weighted IC blended with a baseline, capped, adjusted to
    the regime, smoothed, clipped and normalised; decaying components fall to the floor.

    One row per component, so the normalising windows run over a handful of rows.
    """
    baseline = baseline or BASELINE
    spark = ic.sparkSession
    base = spark.createDataFrame(
        [(c, float(baseline.get(c, 0.02)), float(max(0.01, baseline.get(c, 0.01)))) for c in components],
        "factor string, base double, fallback double")
    w = Window.partitionBy("factor")
    h = ic.withColumn("_back", F.row_number().over(w.orderBy(F.col("trade_date").desc()))).where(F.col("_back") <= lookback)
    h = h.withColumn("_len", F.count(F.lit(1)).over(w)).withColumn("_e", F.exp((F.col("_len") - F.col("_back")) / 10.0))
    h = h.groupBy("factor").agg((F.sum(F.col("_e") * F.col("ic")) / F.sum("_e")).alias("_ew"), F.count("ic").alias("_n"))
    t = base.join(h, "factor", "left")
    icw = (F.when(F.col("factor") == PROTECTED, F.lit(float(baseline.get(PROTECTED, 0.20))))
           .when(F.col("_n") >= 3, F.greatest(F.lit(0.01), "_ew")).otherwise(F.col("fallback")))
    every = Window.partitionBy(F.lit(1))
    t = t.withColumn("_ic", icw)
    raw = 0.7 * F.col("_ic") / F.sum("_ic").over(every) + 0.3 * F.col("base") / F.sum("base").over(every)
    dual_cap = 0.06 if regime in ("high_vol_bear", "bear", "high_vol_bull") else 0.12
    t = t.withColumn("w", F.when(F.col("factor") == "dual", F.least(raw, F.lit(dual_cap))).otherwise(raw))
    if crowded is not None and len(components) >= 3:
        hits = crowded.select(F.col("a").alias("factor")).unionAll(crowded.select("b")).groupBy("factor").agg(F.count(F.lit(1)).alias("_hits"))
        t = t.join(hits, "factor", "left")
        t = t.withColumn("w", F.when(F.col("factor") == PROTECTED, F.col("w")).otherwise(
            F.col("w") * F.pow(F.lit(0.8), F.coalesce("_hits", F.lit(0)))))
    for name, (mult, top) in REGIME_ADJUST.get(regime, {}).items():
        v = F.col("w") * mult
        t = t.withColumn("w", F.when(F.col("factor") == name, F.least(v, F.lit(top)) if top else v).otherwise(F.col("w")))
    if last is not None:
        t = t.join(last.select("factor", F.col("weight").alias("_old")), "factor", "left")
        t = t.withColumn("w", smooth * F.coalesce("_old", "w") + (1 - smooth) * F.col("w"))
    t = t.withColumn("w", bound(F.col("w"), floor, cap))
    t = t.withColumn("w", F.col("w") / F.sum("w").over(every))
    dec = health_report(ic, lookback).select("factor", "is_decaying")
    t = t.join(dec, "factor", "left")
    mine = F.col("factor") == PROTECTED
    t = t.withColumn("_a", F.when(~mine, F.when(F.coalesce("is_decaying", F.lit(False)), F.lit(floor)).otherwise(F.col("w"))))
    kept = F.sum(F.when(mine, F.col("w")).otherwise(0.0)).over(every)
    return t.select("factor", F.when(mine, F.col("w")).otherwise(F.col("_a") / F.sum("_a").over(every) * (1 - kept)).alias("weight"))


def blended_score(long: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted sum of long (key, factor, score) rows."""
    return long.join(F.broadcast(weights), "factor").groupBy(*keys).agg(F.sum(F.col("weight") * F.col("score")).alias("score"))


# ---- folds, sample weights, training rows --------------------------------------------


def purged_folds(n: int, n_splits: int = 5, test: int = 20, embargo: int = 5, min_train: int = 200) -> list[tuple[int, int, int]]:
    """(train_end, val_start, val_end) positions; half/half when no fold fits."""
    folds = []
    for k in range(n_splits):
        start = n - (n_splits - k) * (test + embargo)
        train_end, end = start - embargo, start + test
        if end <= n and start >= min_train and train_end >= min_train and test >= 10:
            folds.append((train_end, start, end))
    return folds or [(n // 2, n // 2, n)]


def tag_folds(df: DataFrame, day: str = "trade_date", **kw) -> DataFrame:
    """Date index joined with the fold table: rows tagged train/validate per fold."""
    days = df.select(day).distinct().withColumn("_one", F.lit(1))
    days = days.withColumn("_i", F.row_number().over(Window.partitionBy("_one").orderBy(day)) - 1).drop("_one")
    folds = purged_folds(df.select(day).distinct().count(), **kw)
    role = lambda f: F.when(F.col("_i") < f[0], "train").when((F.col("_i") >= f[1]) & (F.col("_i") < f[2]), "validate")
    tags = days.select(day, F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), role(f).alias("role")) for i, f in enumerate(folds)])).alias("t"))
    tags = tags.select(day, "t.fold", "t.role").where(F.col("role").isNotNull())
    return df.join(F.broadcast(tags) if len(folds) <= 20 else tags, day)


def sample_weights(df: DataFrame, order: Sequence[str], strength: float = 2.0) -> DataFrame:
    """exp(linspace(-strength, 0)) by date position, scaled to mean 1."""
    days = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_c")).withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one").orderBy(*order)
    days = days.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("_one"))})
    days = days.withColumn("_w", F.exp(-strength + strength * F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1))))
    every = Window.partitionBy("_one")
    mean = F.sum(F.col("_w") * F.col("_c")).over(every) / F.sum("_c").over(every)
    days = days.select(*order, (F.col("_w") / mean).alias("sample_weight"))
    return df.join(days, list(order))


def training_rows(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Lagged feature where it exists, rows with every label, bottom-sample flag."""
    chosen = [f"{c}_lag1" if f"{c}_lag1" in df.columns else c for c in features]
    rows = df.dropna(subset=list(labels))
    rows = rows.select("ts_code", "trade_date", *[F.coalesce(F.col(s), F.lit(0.0)).alias(c) for c, s in zip(features, chosen)], *labels)
    return rows


def align_features(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Exactly the wanted columns, sorted; absent or unparsable values are 0."""
    cols = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in sorted(wanted)]
    return df.select(*cols)


# ---- models --------------------------------------------------------------------------


def _assemble(df: DataFrame, features: Sequence[str]):
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})  # as training_rows does; no row goes
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


#: Training rows of a task, which a fit keeps in memory as objects.
FIT_ROWS = 250_000


def _fit_table(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows to fit on, stored narrow (a fit makes several passes) and dealt evenly over tasks of bounded size."""
    rows = cut_lineage(train.where(F.col(label).isNotNull()).select(*features, label))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FIT_ROWS))
    return _assemble(rows.repartition(tasks), features)


def direction_model(train: DataFrame, score: DataFrame, features: Sequence[str], label: str, rounds: int = 20) -> DataFrame:
    """Up/down boosted trees (MLlib): p_up, confidence, selective flag."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    model = GBTClassifier(labelCol=label, featuresCol="features", maxDepth=3, maxIter=rounds, stepSize=0.1, seed=7).fit(_fit_table(train, features, label))
    out = model.transform(_assemble(score, features)).withColumn("p_up", vector_to_array("probability")[1])
    conf = F.abs(F.col("p_up") - 0.5) * 2
    return out.drop("features", "rawPrediction", "probability", "prediction").withColumns({"confidence": conf, "selective": conf >= 0.10})


#: Bins of a feature, as trees split between quantiles of it.
BINS = 32
#: Trees of a forest, and how many are fitted at a time.
TREES, FITS = 20, 4


def _cuts(rows: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Ascending values of each feature between which trees may split, from all rows: every value but the last where there
    are at most ``BINS``, else quantiles and, where one value holds several of them, the place just below it."""
    at = [i / BINS for i in range(1, BINS)]
    found, cuts = rows.agg(*[F.struct(F.percentile_approx(c, at, 10_000).alias("q"), F.approx_count_distinct(c).alias("n")).alias(c) for c in features]).first(), []
    for c in features:
        q = found[c]["q"] or []
        few = rows.select(c).distinct().limit(BINS + 1).collect() if found[c]["n"] <= 2 * BINS else None
        if few is not None and len(few) <= BINS:
            cuts.append(sorted(r[0] for r in few)[:-1])
        else:
            cuts.append(sorted(set(q) | {math.nextafter(v, -math.inf) for v in q if q.count(v) > 1}))
    return cuts


def _bin(x: Column, cuts: Sequence[float], first: int = 1) -> Column:
    """``first`` plus the number of cuts below the value."""
    if not cuts:
        return F.lit(float(first))
    m = len(cuts) // 2
    return F.when(x <= cuts[m], _bin(x, cuts[:m], first)).otherwise(_bin(x, cuts[m + 1:], first + m + 1))


def _draws(u: Column) -> Column:
    """How often a row is drawn with replacement for a tree (Poisson of mean 1), from a uniform number."""
    p, below = math.exp(-1), [math.exp(-1)]
    while below[-1] < 1 - 2.0**-53 and len(below) < 20:
        p /= len(below)
        below.append(below[-1] + p)
    out = F.when(u < below[0], 0.0)
    for n, b in enumerate(below[1:], 1):
        out = out.when(u < b, float(n))
    return out.otherwise(float(len(below)))


def _cells(train: DataFrame, values: Sequence[Column], label: str, trees: Sequence[int]) -> DataFrame:
    """Rows of equal bins as one row per tree: ``_tree``, ``_b0``..., ``_weight`` and the mean ``_label``, stored.

    Tree 0 takes every row once; each other one draws its rows with replacement, by a hash of the row's columns, so that
    the draws are the same however rows are dealt. Trees only see bins, weights and sums of labels, so a fit on cells splits
    as one on the rows, and its size no longer grows with them.
    """
    names = [f"_b{i}" for i in range(len(values))]
    rows = train.select(F.xxhash64(*train.columns).alias("_row"), F.col(label).cast("double").alias("_y"), *[v.alias(n) for v, n in zip(values, names)])
    rows = rows.where("_y is not null").withColumn("_tree", F.explode(F.array(*[F.lit(t) for t in trees])))
    rows = rows.withColumn("_u", F.shiftrightunsigned(F.xxhash64("_row", "_tree"), 11) * 2.0**-53)
    rows = rows.withColumn("_w", F.when(F.col("_tree") == 0, 1.0).otherwise(_draws(F.col("_u")))).where("_w > 0")
    total = F.sum("_w")
    return cut_lineage(rows.groupBy("_tree", *names).agg(total.alias("_weight"), (F.sum(F.col("_w") * F.col("_y")) / total).alias("_label")))


def rank_model(train: DataFrame, score: DataFrame, features: Sequence[str], label: str, kinds: Sequence[str] = ("gbt", "forest")) -> DataFrame:
    """Tree regressors (MLlib): long (model, keys, pred).

    Both tables are read twice: for the cuts and the cells of all rows with a label, and for the cells to score and their
    rows. Models are fitted on cells (rows of equal bins), and a cell is scored once.
    """
    from pyspark import inheritable_thread_target
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}  # as training_rows does; no row goes
    cuts = _cuts(train.where(F.col(label).isNotNull()).select(*[filled[c].alias(c) for c in features]), features)
    values, names = [_bin(filled[c], k) for c, k in zip(features, cuts)], [f"_b{i}" for i in range(len(features))]
    cells = _cells(train, values, label, [t for kind in kinds for t in ([0] if kind == "gbt" else range(1, TREES + 1))])
    sizes = {r["_tree"]: r["count"] for r in cells.groupBy("_tree").count().collect()}  # a row per tree
    bins = VectorAssembler(inputCols=names, outputCol="_features")

    def fitted(make, tree: int, **options):
        rows = bins.transform(cells.where(F.col("_tree") == tree).repartition(-(-sizes[tree] // FIT_ROWS)))
        most = max(2 * BINS, math.isqrt(sizes[tree]) + 1)  # so that MLlib looks at every cell for the bins
        return make(labelCol="_label", weightCol="_weight", featuresCol="_features", predictionCol=f"_p{tree}", maxBins=most, seed=7 + tree, **options).fit(rows)

    scored, preds = bins.transform(score.select(*[v.alias(n) for v, n in zip(values, names)]).distinct()), []
    for kind in kinds:
        if kind == "gbt":
            models = [fitted(GBTRegressor, 0, maxDepth=3, maxIter=10)]
        else:  # rows are drawn already; a node looks at a third of the features
            one = inheritable_thread_target(train.sparkSession)(lambda t: fitted(RandomForestRegressor, t, maxDepth=5, numTrees=1, bootstrap=False, featureSubsetStrategy="onethird"))
            with ThreadPool(FITS) as pool:
                models = pool.map(one, [t for t in range(1, TREES + 1) if t in sizes])
        for m in models:
            scored = m.transform(scored)
        pred = sum((F.col(m.getPredictionCol()) for m in models), F.lit(0.0)) / len(models)
        preds.append(F.struct(F.lit(kind).alias("model"), pred.alias("pred")))
    scored = cut_lineage(scored.select(*names, F.array(*preds).alias("_preds")))
    rows = score.select("ts_code", "trade_date", label, *[v.alias(n) for v, n in zip(values, names)]).join(scored, names)
    return rows.select("ts_code", "trade_date", label, F.explode("_preds").alias("_p")).select("ts_code", "trade_date", label, "_p.pred", "_p.model")


def date_folds(df: DataFrame, day: str = "trade_date", **kw) -> list[tuple]:
    """(first training-free date, first and last validation date) of each purged fold; reads the calendar only."""
    days = [r[0] for r in df.select(day).distinct().orderBy(day).collect()]  # a row per calendar date
    return [(days[train_end], days[start], days[end - 1]) for train_end, start, end in purged_folds(len(days), **kw)]


def cross_validated_ic(df: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", day: str = "trade_date", **kw) -> DataFrame:
    """Per fold: fit, predict, rank IC of the whole validation block. Folds are date ranges of one table; rows without label do not count."""
    rows, parts = cut_lineage(df.where(F.col(label).isNotNull()).select("ts_code", day, *features, label)), []
    for k, (free, first, last) in enumerate(date_folds(rows, day, **kw)):
        pred = rank_model(rows.where(F.col(day) < F.lit(free)), rows.where(F.col(day).between(F.lit(first), F.lit(last))), features, label, [kind])
        parts.append(pred.withColumn("fold", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = cut_lineage(out.select("fold", "pred", label))  # predictions are counted, then ranked
    return spearman(out, ["fold"], "pred", label, min_rows=10, short_is_zero=True)


def ensemble(preds: DataFrame, weights: DataFrame, group_rows=None) -> DataFrame:
    """z-score each model per date, weighted mean, spread as uncertainty, final z."""
    if group_rows is not None and group_rows <= ranks.WINDOW_ROWS:
        preds = dealt(preds, "trade_date")  # serves every step below
    z = join_stats(preds, ["model", "trade_date"], {"_m": F.avg("pred"), "_s": F.stddev_pop("pred")}, group_rows)
    z = z.withColumn("z", F.when(F.col("_s") > 1e-8, (F.col("pred") - F.col("_m")) / F.col("_s")).otherwise(0.0))
    z = z.join(F.broadcast(weights.select("model", F.greatest("weight", F.lit(1e-6)).alias("weight"))), "model")
    e = z.groupBy("trade_date", "ts_code").agg((F.sum(F.col("z") * F.col("weight")) / F.sum("weight")).alias("_e"), F.stddev_pop("z").alias("model_std"))
    e = join_stats(e, ["trade_date"], {"_m": F.avg("_e"), "_s": F.stddev_pop("_e"), "uncertainty": F.avg("model_std")}, group_rows)
    return e.withColumn("score", F.when(F.col("_s") > 1e-8, (F.col("_e") - F.col("_m")) / F.col("_s")).otherwise(F.col("_e"))).drop("_e", "_m", "_s")


def model_weights(ic: DataFrame, last: int = 20) -> DataFrame:
    """exp(linspace(-1, 0)) weighted mean of the last positive ICs, floor 1e-4."""
    w = Window.partitionBy("model")
    h = ic.withColumn("_back", F.row_number().over(w.orderBy(F.col("trade_date").desc()))).where(F.col("_back") <= last)
    h = h.withColumn("_n", F.count(F.lit(1)).over(w))
    h = h.withColumn("_e", F.exp(-(F.col("_back") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))))
    pos = F.greatest("ic", F.lit(0.0))
    a = h.groupBy("model").agg((F.sum(F.col("_e") * pos) / F.sum("_e")).alias("_s"), F.max("_n").alias("_n"),
                               F.max_by("ic", "trade_date").alias("_last"))
    return a.select("model", F.greatest(F.when(F.col("_n") >= 3, F.col("_s")).otherwise(F.col("_last")), F.lit(1e-4)).alias("weight"))


def ic_weighted_average(preds: DataFrame, weights: DataFrame) -> DataFrame:
    p = preds.join(F.broadcast(weights), "model")
    return p.groupBy("trade_date", "ts_code").agg((F.sum(F.col("pred") * F.col("weight")) / (F.sum("weight") + TINY)).alias("score"))


def consistency(ic: DataFrame) -> DataFrame:
    """1 - coefficient of variation of the models' recent ICs (0.5 below two models)."""
    m = ic.where(F.col("ic") > 0.001).agg(F.count("ic").alias("n"), F.avg("ic").alias("m"), F.stddev_pop("ic").alias("s"))
    score = bound(1.0 - F.col("s") / (F.col("m") + TINY), 0.0, 1.0)
    return m.select(F.round(F.when(F.col("n") < 2, 0.5).otherwise(score), 4).alias("consistency"))


def model_health(ic: DataFrame, weights: DataFrame, uncertainty: float = 0.0) -> DataFrame:
    """Recent IC, trend against the start, normalised weight and confidence per model."""
    p = _positions(ic, "model", "trade_date")
    h = p.groupBy("model").agg(
        F.avg(F.when(F.col("_i") >= F.col("_n") - 5, F.col("ic"))).alias("recent_ic"),
        F.avg(F.when(F.col("_i") < 5, F.col("ic"))).alias("_early"), F.count("ic").alias("periods"))
    trend = (F.when(F.col("periods") < 10, "stable").when((F.col("_early") > 0.01) & (F.col("recent_ic") < F.col("_early") * 0.5), "decaying")
             .when(F.col("recent_ic") > F.col("_early") * 1.2, "improving").otherwise("stable"))
    h = h.withColumn("trend", trend).join(weights, "model", "left")
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return h.select("model", F.round("recent_ic", 4).alias("recent_ic"), "trend", "periods",
                    F.round(F.col("weight") / total, 4).alias("current_weight"), F.lit(round(max(50.0, 95 - uncertainty * 45), 1)).alias("confidence"))


def drift_alerts(runs: DataFrame, alarm: float = 0.02, window: int = 20) -> DataFrame:
    """Per model over its last runs: IC decay, low IC, change of prediction spread."""
    w = Window.partitionBy("model").orderBy(F.col("trade_date").desc())
    h = runs.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= window)
    h = _positions(h, "model", "trade_date")
    last, first = F.col("_i") >= F.col("_n") - 5, F.col("_i") < 5
    mean = lambda c, v: F.avg(F.when(c, F.col(v)))
    a = h.groupBy("model").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic_ratio"),
        mean(last, "ic").alias("recent"), mean(first, "ic").alias("early"), mean(last, "std").alias("rs"), mean(first, "std").alias("es"),
        F.max(F.when(F.col("_i") >= F.col("_n") - 3, F.abs("ic"))).alias("_top3"))
    ready, ratio = F.col("sample_count") >= 5, F.col("rs") / (F.col("es") + TINY)
    return a.select(
        "model", "sample_count", F.round("ic_mean", 4).alias("ic_mean"), F.round("ic_std", 4).alias("ic_std"),
        F.round(F.col("ic_mean") / (F.col("ic_std") + TINY), 3).alias("ir"), F.round("positive_ic_ratio", 3).alias("positive_ic_ratio"),
        (ready & (F.col("early") > 0.01) & (F.col("recent") / (F.col("early") + TINY) < alarm / 0.02)).alias("ic_decay"),
        (ready & (F.col("_top3") < alarm)).alias("low_ic"),
        ((F.col("sample_count") >= 10) & ((ratio > 3.0) | (ratio < 0.3))).alias("distribution_drift"))


def prediction_distribution(df: DataFrame, by: Sequence[str], col: str, group_rows=None) -> DataFrame:
    q = ranks.quantiles(df, by, {"q25": (col, 0.25), "q50": (col, 0.5), "q75": (col, 0.75)}, group_rows)
    s = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.min(col).alias("lo"), F.max(col).alias("hi"),
                            F.count_if(F.col(col) != 0).alias("nonzero"))
    return s.join(q, list(by))
