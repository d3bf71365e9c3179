"""Queries over IC evaluation, weights, models, moments and backtests (long supplier panel)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import evaluate as ev
from ..operators import factors as fx
from ..operators import moments as mo
from ..operators import ranks
from ..session import cut_lineage, dealt
from . import views as v
from .factor_queries import W, fr, pct, roll, rollp
from .registry import query, r, rounded

C = '"close"'
FACTORS = ("mom5", "vol_ratio", "swing")


def base(spark, sf, panel=None):
    """Panel with three factors and the five-row forward return."""
    w = fx.W
    df = v.panel_l(spark, sf) if panel is None else panel
    return dealt(df, "ts_code").select(
        "ts_code", "trade_date", "industry", "close", "amount", w.pct_change("close", 5).alias("mom5"),
        (F.col("vol") / (w.roll_prev(F.avg, "vol", 20, 5) + 1e-9)).alias("vol_ratio"),
        ((F.col("high") - F.col("low")) / F.col("close")).alias("swing"), w.forward_return("close", 5).alias("fwd"))


def rows(spark, sf):
    return v.section_rows(spark, sf, "panel_l")


B = f"""b as (select ts_code, trade_date, industry, "close", amount, {pct(C, 5)} mom5, vol / ({rollp('avg', 'vol', 20, 5)} + 1e-9) vol_ratio,
  (high - low) / {C} swing, lead({C}, 5) {W} / {C} - 1 fwd from panel_l),
l as (""" + " union all ".join(f"select trade_date, ts_code, '{f}' factor, {f} x, fwd y from b where {f} is not null and fwd is not null" for f in FACTORS) + """),
rk as (select *, rank() over (partition by factor, trade_date order by x) + (count(*) over (partition by factor, trade_date, x) - 1) / 2.0 rx,
  rank() over (partition by factor, trade_date order by y) + (count(*) over (partition by factor, trade_date, y) - 1) / 2.0 ry from l),
ic as (select factor, trade_date, count(*) n, round(corr(rx, ry), 12) ic from rk group by 1, 2 having count(*) >= 11 and stddev_pop(rx) > 0 and stddev_pop(ry) > 0)"""


def ics(spark, sf, panel=None):
    return ev.factor_ic(base(spark, sf) if panel is None else panel, FACTORS, "fwd", rows(spark, sf))


def report(spark, sf):
    df = cut_lineage(base(spark, sf).select("trade_date", *FACTORS, "fwd"))  # read for the ICs, bounds, cells and quantiles
    return ev.factor_report(ics(spark, sf, df), ev.crowding(df, FACTORS))


@query("rank_ic", v.with_views(f"select factor, trade_date, n, {r('ic', 'ic')} from ic", "panel_l", extra=B))
def rank_ic(spark, sf):
    return rounded(ics(spark, sf))


@query("rank_ic_split", v.with_views(f"select factor, trade_date, n, {r('ic', 'ic')} from ic", "panel_l", extra=B))
def rank_ic_split(spark, sf):
    return rounded(ev.factor_ic(base(spark, sf), FACTORS, "fwd", ev.ranks.WINDOW_ROWS + 1))


@query("ic_summary", v.with_views(
    f"select factor, {r('avg(ic)', 'ic_mean')}, {r('stddev_samp(ic)', 'ic_std')}, count(*) periods, {r('avg(ic) / (stddev_samp(ic) + 1e-9)', 'ir')} from ic group by 1", "panel_l", extra=B))
def ic_summary(spark, sf):
    return rounded(ev.ic_summary(ics(spark, sf)))


REPORT = B + """, p as (select *, row_number() over (partition by factor order by trade_date) - 1 i, count(*) over (partition by factor) m from ic),
cw as (select factor, 1 - (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / (max(x) - min(x)) cs from (""" + " union all ".join(
    f"select '{f}' factor, {f} x from b where {f} is not null" for f in FACTORS) + """) group by 1),
rp as (select factor, arg_max(ic, trade_date) ic_current, avg(ic) ic_mean, stddev_pop(ic) ic_std, count(*) sample_count,
  avg(case when ic > 0 then 1.0::double else 0.0::double end) positive_ratio, avg(abs(ic)) filter (i < 5) ea, avg(abs(ic)) filter (i >= m - 5) la,
  count(*) filter (i >= m - 3 and abs(ic) >= 0.02) alive from p group by 1),
rq as (select *, ic_mean / (ic_std + 1e-9) ir, ic_mean / (ic_std / sqrt(sample_count) + 1e-9) t_stat, greatest(0.0::double, least(1.0::double, 1 - la / (ea + 1e-9))) decay_score,
  alive = 0 is_decaying from rp join cw using (factor)),
rs as (select *, (0.35 * abs(ir) + 0.25 * positive_ratio + 0.2 * (1 - decay_score) + 0.1 * (1 - cs) + 0.1 * least(abs(t_stat) / 2, 1)) * case when is_decaying then 0.3 else 1 end composite_score from rq)"""


@query("factor_report", v.with_views(
    "select factor, sample_count, is_decaying, " + ", ".join(r(c, c) for c in ("ic_current", "ic_mean", "ic_std", "ir", "t_stat", "positive_ratio", "decay_score", "composite_score"))
    + ", " + r("cs", "crowding_score") + " from rs", "panel_l", extra=REPORT))
def factor_report(spark, sf):
    return rounded(report(spark, sf))


@query("selected_factors", v.with_views(
    f"select factor, {r('composite_score', 'composite_score')} from rs where abs(ic_mean) >= 0.001 and abs(ir) >= 0.001 and not is_decaying order by round(composite_score, 9) desc, factor limit 2", "panel_l", extra=REPORT))
def selected_factors(spark, sf):
    return rounded(ev.select_factors(report(spark, sf), 0.001, 0.001, 2).select("factor", "composite_score"))


def fw(n):
    return f"over (partition by factor order by trade_date rows between {n - 1} preceding and current row)"


DECAY = B + f""", dc as (select *, count(ic) {fw(20)} periods, case when count(ic) {fw(20)} < 2 then 0 else avg(ic) {fw(20)} / (stddev_pop(ic) {fw(20)} + 1e-9) end ir,
  avg(ic) {fw(3)} recent_ic, max(ic) {fw(3)} hi, avg(ic) {fw(20)} im, stddev_pop(ic) {fw(20)} isd from ic),
dd as (select *, periods >= 3 and (hi < 0.02 or ir < 0.3) is_decaying, case when periods < 3 then 'short history' when hi < 0.02 then 'low ic' when ir < 0.3 then 'low ir' else 'healthy' end reason from dc),
hr as (select * from dd qualify row_number() over (partition by factor order by trade_date desc) = 1)"""


@query("decay_check", v.with_views(f"select factor, trade_date, periods, {r('ir', 'ir')}, {r('recent_ic', 'recent_ic')}, is_decaying, reason from dd", "panel_l", extra=DECAY))
def decay_check(spark, sf):
    return rounded(ev.decay_check(ics(spark, sf)).drop("n", "ic"))


@query("factor_health", v.with_views(f"select factor, periods, {r('ir', 'ir')}, {r('im', 'ic_mean')}, {r('isd', 'ic_std')}, is_decaying, reason from hr", "panel_l", extra=DECAY))
def factor_health(spark, sf):
    return rounded(ev.health_report(ics(spark, sf)))


WMAP = {"mom5": "small_cap", "vol_ratio": "dual", "swing": "nlp"}
WEIGHTS = DECAY + """, nm as (select *, case factor when 'mom5' then 'small_cap' when 'vol_ratio' then 'dual' else 'nlp' end f from ic),
bk as (select f, ic, row_number() over (partition by f order by trade_date desc) b, count(*) over (partition by f) c from nm),
ew as (select f, sum(exp((least(c, 20) - b) / 10.0) * ic) / sum(exp((least(c, 20) - b) / 10.0)) e from bk where b <= 20 group by 1),
w0 as (select 'rule_baseline' f, 0.25::double base, 0.25::double icw union all select f, case f when 'small_cap' then 0.3 when 'dual' then 0.08 else 0.05 end, greatest(0.01, e) from ew),
w1 as (select f, 0.7 * icw / sum(icw) over () + 0.3 * base / sum(base) over () w from w0),
w2 as (select f, case f when 'dual' then least(w, 0.12) when 'small_cap' then least(0.4, w * 1.1) when 'rule_baseline' then least(0.35, w * 1.05) else w end w from w1),
w3 as (select f, greatest(0.03, least(0.6, w)) w from w2), w4 as (select f, w / sum(w) over () w from w3),
w5 as (select w4.f, w, case when w4.f = 'rule_baseline' then null when is_decaying then 0.03 else w end a from w4 left join
  (select case factor when 'mom5' then 'small_cap' when 'vol_ratio' then 'dual' else 'nlp' end f, is_decaying from hr) h on h.f = w4.f),
w6 as (select f factor, case when f = 'rule_baseline' then w else a / sum(a) over () * (1 - sum(case when f = 'rule_baseline' then w else 0 end) over ()) end weight from w5)"""


def named_ics(spark, sf):
    m = F.create_map(*[F.lit(x) for kv in WMAP.items() for x in kv])
    return cut_lineage(ics(spark, sf).withColumn("factor", m[F.col("factor")]))  # a row per factor and date, read twice


@query("dynamic_weights", v.with_views(f"select factor, {r('weight', 'weight')} from w6", "panel_l", extra=WEIGHTS))
def dynamic_weights(spark, sf):
    comps = ["rule_baseline", "small_cap", "dual", "nlp"]
    return rounded(ev.dynamic_weights(named_ics(spark, sf), comps, "balanced", baseline={**ev.BASELINE}))


@query("tagged_folds", v.with_views("""
  select fold, role, count(*) n from (select d.i, f.fold, case when i < f.a then 'train' when i >= f.b and i < f.c then 'validate' end as role, p.k from
    (select distinct cast(l_shipdate as date) td, l_suppkey k from lineitem) p join (select td, row_number() over (order by td) - 1 i, count(*) over () n from (select distinct cast(l_shipdate as date) td from lineitem)) d using (td),
    lateral (select g fold, d.n - (5 - g) * 25 - 5 a, d.n - (5 - g) * 25 b, d.n - (5 - g) * 25 + 20 c from range(5) t(g)) f) where role is not null group by 1, 2"""))
def tagged_folds(spark, sf):
    df = v.panel_l(spark, sf).select("ts_code", "trade_date")
    out = ev.tag_folds(df).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("fold", F.col("fold").cast("long"))


@query("sample_weights", v.with_views(f"""
  select ts_code, trade_date, {r('e / (sum(e) over () / count(*) over ())', 'sample_weight')} from (select *, exp(-2.0::double + 2.0::double * i / (m - 1)) e from
    (select *, dense_rank() over (order by trade_date) - 1 i from panel_l), (select count(distinct trade_date) m from panel_l))""", "panel_l"))
def sample_weights(spark, sf):
    df = v.panel_l(spark, sf).select("ts_code", "trade_date")
    return rounded(ev.sample_weights(df, ["trade_date"]).select("ts_code", "trade_date", "sample_weight"))


@query("training_rows", v.with_views(f"select ts_code, trade_date, {r('coalesce(lag(mom5) ' + W + ', 0)', 'mom5')}, {r('coalesce(vol_ratio, 0)', 'vol_ratio')}, {r('fwd', 'fwd')} from b qualify fwd is not null", "panel_l", extra=B))
def training_rows(spark, sf):
    df = fx.lagged(base(spark, sf), ["mom5"])
    return rounded(ev.training_rows(df, ["mom5", "vol_ratio"], ["fwd"]))


@query("aligned_features", v.with_views("select 0.0::double absent, amount, swing from (select *, (high - low) / \"close\" swing from panel_l)", "panel_l"))
def aligned_features(spark, sf):
    return ev.align_features(base(spark, sf), ["swing", "amount", "absent"])


EMBARGO = 20  # days before the cut whose forward returns reach over it


def _split(spark, sf, cut="2000-06-01", panel=None):
    """Training rows with a forward return, up to the embargo before the cut; rows to score from the cut on."""
    df = (base(spark, sf) if panel is None else panel).withColumn("up", F.when(F.col("fwd").isNotNull(), (F.col("fwd") > 0).cast("double")))
    at = F.lit(cut).cast("date")
    return df.where((F.col("trade_date") < F.date_sub(at, EMBARGO)) & F.col("fwd").isNotNull()), df.where(F.col("trade_date") >= at)


@query("training_split", v.with_views(f"""
  select count(*) filter (trade_date < date '2000-06-01' - {EMBARGO} and fwd is not null) train_rows, count(*) filter (trade_date < date '2000-06-01' - {EMBARGO} and fwd > 0) risers,
    count(*) filter (trade_date >= date '2000-06-01') score_rows from b""", "panel_l", extra=B))
def training_split(spark, sf):
    """Sizes of the models' training and scoring rows."""
    train, score = _split(spark, sf)
    n = train.agg(F.count(F.lit(1)).alias("train_rows"), F.sum("up").cast("long").alias("risers"))
    return n.crossJoin(score.agg(F.count(F.lit(1)).alias("score_rows")))  # one row each


@query("direction_model")
def direction_model(spark, sf):
    """Boosted trees on the panel; newest rows scored and the most likely risers kept."""
    panel = cut_lineage(base(spark, sf).select("ts_code", "trade_date", *FACTORS, "fwd"))  # read by the fit and the scoring
    train, score = _split(spark, sf, panel=panel)
    out = ev.direction_model(train, score, FACTORS, "up", 5)
    return rounded(out.orderBy(F.round("p_up", 9).desc(), "ts_code", "trade_date").limit(50).select("ts_code", "trade_date", "p_up", "confidence", "selective"))


@query("rank_model_ensemble")
def rank_model_ensemble(spark, sf):
    """Two tree models blended by their rank ICs on dates before the cut that neither was fitted on."""
    panel = cut_lineage(base(spark, sf).select("ts_code", "trade_date", *FACTORS, "fwd"))  # read by both fits and both scorings
    train, score = _split(spark, sf, panel=panel)
    early, held = _split(spark, sf, "2000-01-01", panel)
    past = ev.rank_model(early, held.where("trade_date < date'2000-05-12' and fwd is not null"), FACTORS, "fwd")
    past = cut_lineage(past.select("model", "trade_date", "pred", "fwd"))  # predictions are counted, then ranked
    weights = ev.model_weights(ev.spearman(past, ["model", "trade_date"], "pred", "fwd", min_rows=10, short_is_zero=True))
    preds = ev.rank_model(train, score, FACTORS, "fwd")
    return rounded(ev.ensemble(preds, weights, rows(spark, sf)).select("ts_code", "trade_date", "score", "model_std"))


PREDS = B + """, pr as (select trade_date, ts_code, 'a' model, mom5 pred from b where mom5 is not null union all select trade_date, ts_code, 'b', swing from b),
zs as (select *, case when stddev_pop(pred) over (partition by model, trade_date) > 1e-8 then (pred - avg(pred) over (partition by model, trade_date)) / stddev_pop(pred) over (partition by model, trade_date) else 0 end z from pr),
en as (select trade_date, ts_code, sum(z * case model when 'a' then 0.7 else 0.3 end) / sum(case model when 'a' then 0.7 else 0.3 end) e, stddev_pop(z) model_std from zs group by 1, 2)"""


def two_models(spark, sf):
    df = base(spark, sf)
    a = df.where(F.col("mom5").isNotNull()).select("trade_date", "ts_code", F.lit("a").alias("model"), F.col("mom5").alias("pred"), "fwd")
    return a.unionByName(df.select("trade_date", "ts_code", F.lit("b").alias("model"), F.col("swing").alias("pred"), "fwd"))


@query("prediction_ensemble", v.with_views(f"""
  select ts_code, trade_date, {r('case when stddev_pop(e) over (partition by trade_date) > 1e-8 then (e - avg(e) over (partition by trade_date)) / stddev_pop(e) over (partition by trade_date) else e end', 'score')},
    {r('model_std', 'model_std')}, {r('avg(model_std) over (partition by trade_date)', 'uncertainty')} from en""", "panel_l", extra=PREDS))
def prediction_ensemble(spark, sf):
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "model string, weight double")
    return rounded(ev.ensemble(two_models(spark, sf), weights, rows(spark, sf)))


MW = B + """, mi as (select factor model, trade_date, ic, row_number() over (partition by factor order by trade_date desc) bk, row_number() over (partition by factor order by trade_date) - 1 i, count(*) over (partition by factor) m from ic),
mw as (select model, greatest(sum(exp(-(bk - 1) / 19.0) * greatest(ic, 0)) / sum(exp(-(bk - 1) / 19.0)), 1e-4) weight from mi where bk <= 20 group by 1)"""


def model_ics(spark, sf):
    return cut_lineage(ics(spark, sf).withColumnRenamed("factor", "model"))  # a row per model and date, read twice


@query("model_weights", v.with_views(f"select model, {r('weight', 'weight')} from mw", "panel_l", extra=MW))
def model_weights(spark, sf):
    return rounded(ev.model_weights(model_ics(spark, sf)))


@query("ic_weighted_average", v.with_views(
    f"select trade_date, ts_code, {r('sum(pred * w) / (sum(w) + 1e-9)', 'score')} from (select *, case model when 'a' then 0.7::double else 0.3::double end w from pr) group by 1, 2", "panel_l", extra=PREDS))
def ic_weighted_average(spark, sf):
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.3)], "model string, weight double")
    return rounded(ev.ic_weighted_average(two_models(spark, sf), weights))


@query("model_consistency", v.with_views(
    "select round(greatest(0.0::double, least(1.0::double, 1 - stddev_pop(ic) / (avg(ic) + 1e-9))), 4) + 0.0::double consistency from ic where ic > 0.001", "panel_l", extra=B))
def model_consistency(spark, sf):
    return ev.consistency(ics(spark, sf))


@query("model_health", v.with_views("""
  select model, round(recent, 4) + 0.0::double recent_ic, case when early > 0.01 and recent < early * 0.5 then 'decaying' when recent > early * 1.2 then 'improving' else 'stable' end trend,
    periods, round(weight / sum(weight) over (), 4) current_weight, 95.0::double confidence from (select model, avg(ic) filter (i >= m - 5) recent, avg(ic) filter (i < 5) early, count(*) periods from mi group by 1) join mw using (model)""", "panel_l", extra=MW))
def model_health(spark, sf):
    m = model_ics(spark, sf)
    return ev.model_health(m, ev.model_weights(m))


@query("drift_alerts", v.with_views("""
  select model, count(*) sample_count, round(avg(ic), 4) + 0.0::double ic_mean, round(stddev_pop(ic), 4) ic_std, round(avg(ic) / (stddev_pop(ic) + 1e-9), 3) + 0.0::double ir,
    round(avg(case when ic > 0 then 1.0::double else 0.0::double end), 3) positive_ic_ratio, avg(ic) filter (bk > 15) > 0.01 and avg(ic) filter (bk <= 5) / (avg(ic) filter (bk > 15) + 1e-9) < 1 ic_decay,
    max(abs(ic)) filter (bk <= 3) < 0.02 low_ic, avg(n) filter (bk <= 5) / (avg(n) filter (bk > 15) + 1e-9) > 3 or avg(n) filter (bk <= 5) / (avg(n) filter (bk > 15) + 1e-9) < 0.3 distribution_drift
  from (select *, row_number() over (partition by factor order by trade_date desc) bk, factor model from ic) where bk <= 20 group by 1""", "panel_l", extra=B))
def drift_alerts(spark, sf):
    runs = model_ics(spark, sf).withColumn("std", F.col("n").cast("double"))
    return ev.drift_alerts(runs)


@query("cross_validated_ic")
def cross_validated_ic(spark, sf):
    return rounded(ev.cross_validated_ic(base(spark, sf), FACTORS, "fwd", "forest", n_splits=2))


@query("prediction_distribution", v.with_views(f"""
  select trade_date, {r('avg(swing)', 'mean')}, {r('stddev_pop(swing)', 'std')}, {r('min(swing)', 'lo')}, {r('max(swing)', 'hi')}, count(*) filter (swing <> 0) nonzero,
    {r('quantile_cont(swing, 0.25)', 'q25')}, {r('quantile_cont(swing, 0.5)', 'q50')}, {r('quantile_cont(swing, 0.75)', 'q75')} from b group by 1""", "panel_l", extra=B))
def prediction_distribution(spark, sf):
    return rounded(ev.prediction_distribution(base(spark, sf), ["trade_date"], "swing", rows(spark, sf)))


# ---- moments -------------------------------------------------------------------------


@query("crowded_pairs", v.with_views(
    """select * from (select 'mom5' a, 'swing' b, round(corr(mom5, swing), 6) corr from b union all select 'mom5', 'vol_ratio', round(corr(mom5, vol_ratio), 6) from b
      union all select 'swing', 'vol_ratio', round(corr(swing, vol_ratio), 6) from b) where abs(corr) > 0.0001""", "panel_l", extra=B))
def crowded_pairs(spark, sf):
    return rounded(mo.crowded_pairs(base(spark, sf), sorted(FACTORS), 0.0001))


@query("orthogonal_factors")
def orthogonal_factors(spark, sf):
    """Names kept by VIF elimination and correlation pruning (checked against numpy in tests)."""
    df = fx.rule_factors(v.panel_e(spark, sf), v.section_rows(spark, sf, "panel_e"))
    cols = ["pmt_return_5d", "pmt_return_20d", "rev_5d_reversal", "vol_ratio_raw", "volat_hist_20d", "ma20_distance", "rsi", "wr", "kdj_j", "boll_position"]
    kept = [("vif", c) for c in mo.select_orthogonal(df, cols)] + [("corr", c) for c in mo.prune_correlated(df, cols)]
    return spark.createDataFrame(kept, "method string, factor string")


TOPN = "tp as (select ts_code from panel_l group by 1 order by sum(amount) desc, ts_code limit 8)"


@query("universe_covariance", v.with_views(f"""
  select x.ts_code a, y.ts_code b, count(*) n, {r('covar_samp(x.ret, y.ret)', 'cov', 4)}, {r('corr(x.ret, y.ret)', 'corr')} from rt x join rt y on x.trade_date = y.trade_date and x.ts_code <= y.ts_code
  group by 1, 2""", "panel_l", extra=TOPN + f""", rt as (select ts_code, trade_date, coalesce({pct(C)}, 0) ret from panel_l where ts_code in (select ts_code from tp))"""))
def universe_covariance(spark, sf):
    return rounded(_universe_cov(spark, sf).withColumn("cov", F.round("cov", 4)))


def _universe_cov(spark, sf):
    df = v.panel_l(spark, sf)
    top = df.groupBy("ts_code").agg(F.sum("amount").alias("a")).orderBy(F.col("a").desc(), "ts_code").limit(8).select("ts_code")
    ret = df.join(F.broadcast(top), "ts_code", "left_semi").withColumn("ret", F.coalesce(fx.W.pct_change("close"), F.lit(0.0)))
    return mo.key_covariance(ret, "trade_date", "ts_code", "ret")


def _quarter_cov(spark, sf):
    """Return covariances of the eight most traded names of each quarter (the rebalance periods)."""
    df = v.panel_l(spark, sf).withColumn("quarter", F.to_date(F.date_trunc("quarter", "trade_date")))
    df = df.withColumn("ret", F.coalesce(fx.W.pct_change("close"), F.lit(0.0)))
    top = ranks.top_n(df.groupBy("quarter", "ts_code").agg(F.sum("amount").alias("a")), ["quarter"], [F.col("a").desc(), F.col("ts_code")], 8, "ts_code").select("quarter", "ts_code")
    days = df.select("quarter", "trade_date").distinct().join(top, "quarter")  # eight rows a date; a day without trade has no return
    ret = days.join(df.select("trade_date", "ts_code", "ret"), ["trade_date", "ts_code"], "left").select("quarter", "trade_date", "ts_code", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    x, y = ret.withColumnsRenamed({"ts_code": "a", "ret": "x"}), ret.withColumnsRenamed({"ts_code": "b", "ret": "y"})
    pairs = x.join(y, ["quarter", "trade_date"]).where("a <= b")  # at most 36 pairs a date
    return pairs.groupBy("quarter", "a", "b").agg(F.coalesce(F.covar_samp("x", "y"), F.lit(0.0)).alias("cov"))


@query("risk_parity_weights")
def risk_parity_weights(spark, sf):
    """Weights per quarter; the solver is iterative, so tests hold it against its optimality condition."""
    return rounded(bt.risk_parity(_quarter_cov(spark, sf), "quarter"))


NODE_COLS = ("close", "vol", "pe", "pb", "roe", "profit_yoy", "turnover_rate")


NODES = f"""fe as (select ts_code, {', '.join(f'avg({c}) f_{c}' for c in NODE_COLS)} from panel_e group by 1),
  st as (select {', '.join(f'avg(coalesce(f_{c}, 0)) m_{c}, stddev_pop(coalesce(f_{c}, 0)) s_{c}' for c in NODE_COLS)} from fe),
  ze as (select ts_code, [{', '.join(f'(coalesce(f_{c}, 0) - m_{c}) / (s_{c} + 1e-8::double)' for c in NODE_COLS)}] z from fe, st),
  ce as (select ts_code, list_transform(z, lambda x: x - list_avg(z)) z from ze),
  co as (select a.ts_code x, b.ts_code y, round(coalesce(list_inner_product(a.z, b.z) / nullif(sqrt(list_inner_product(a.z, a.z)) * sqrt(list_inner_product(b.z, b.z)), 0), 0), 12) corr
    from ce a join ce b on a.ts_code <> b.ts_code),
  rk as (select *, row_number() over (partition by x order by abs(corr) desc, y) k from co where abs(corr) >= 0.9)"""


@query("neighbour_graph", v.with_views(f"select least(x, y) a, greatest(x, y) b, {r('max(corr)', 'corr')} from rk where k <= 5 group by 1, 2", "panel_e", extra=NODES))
def neighbour_graph(spark, sf):
    df = v.panel_e(spark, sf)
    feats = df.groupBy("ts_code").agg(*[F.avg(c).alias(f"f_{c}") for c in NODE_COLS])
    return rounded(mo.neighbour_graph(feats, "ts_code", [c for c in feats.columns if c.startswith("f_")], 0.9, 5))


# ---- backtest ------------------------------------------------------------------------

FREQ = 20
GRID = B + f""", dp as (select trade_date, row_number() over (order by trade_date) - 1 pos, count(*) over () m from (select distinct trade_date from panel_l)),
gr as (select a.trade_date rebalance_date, b2.trade_date next_date, a.pos // {FREQ} period from dp a join dp b2 on b2.pos = a.pos + {FREQ} where a.pos % {FREQ} = 0 and a.pos < a.m - {FREQ}),
ch as (select g.*, b.* exclude (trade_date) from gr g join b on b.trade_date = g.rebalance_date),
s1 as (select * from ch where mom5 is not null qualify row_number() over (partition by rebalance_date order by round(mom5, 9) desc, ts_code) <= 10),
hd as (select * from s1 union all select * from (select * from ch where rebalance_date not in (select rebalance_date from s1) qualify row_number() over (partition by rebalance_date order by ts_code) <= 10)),
pe as (select hd.period, hd.rebalance_date, hd.next_date, avg(coalesce(x."close", 0) * 0.999::double / (hd."close" * 1.001::double)) * (1 - 0.0013::double) - 1 ret, count(*) n_held, count(*) filter (x."close" is null) n_missing
  from hd left join panel_l x on x.ts_code = hd.ts_code and x.trade_date = hd.next_date group by 1, 2, 3),
eq as (select *, case when max(case when ret <= -1 then 1 else 0 end) over (order by period) = 1 then 0 else exp(sum(case when ret > -1 then ln(1 + ret) else 0 end) over (order by period)) end equity from pe),
ed as (select *, (equity - max(equity) over (order by period)) / max(equity) over (order by period) drawdown from eq)"""


def held(spark, sf, panel=None):
    """Holdings per rebalance date from a panel that is built and stored once."""
    panel = cut_lineage(v.panel_l(spark, sf)) if panel is None else panel
    return bt.select_holdings(base(spark, sf, panel), bt.rebalance_grid(panel, FREQ), bt.top_by_score("mom5", 10))


def periods(spark, sf):
    panel = cut_lineage(v.panel_l(spark, sf))
    return bt.period_returns(cut_lineage(held(spark, sf, panel)), panel)


@query("rebalance_grid", v.with_views("select rebalance_date, next_date, period from gr", "panel_l", extra=GRID))
def rebalance_grid(spark, sf):
    return bt.rebalance_grid(v.panel_l(spark, sf), FREQ)


@query("backtest_holdings", v.with_views("select rebalance_date, ts_code, period from hd", "panel_l", extra=GRID))
def backtest_holdings(spark, sf):
    return held(spark, sf).select("rebalance_date", "ts_code", "period")


@query("backtest_periods", v.with_views(f"select period, rebalance_date, next_date, {r('ret', 'ret')}, n_held, n_missing from pe", "panel_l", extra=GRID))
def backtest_periods(spark, sf):
    return rounded(periods(spark, sf))


@query("trade_log", v.with_views(f"""
  select rebalance_date, ts_code, 'buy' as action, {r('price', 'price')}, cast(floor(1e6 / n / price) as bigint) shares, {r('price * floor(1e6 / n / price) * 0.0003::double', 'cost')}
  from (select *, "close" * 1.001::double price, count(*) over (partition by rebalance_date) n from hd) where floor(1e6 / n / price) > 0""", "panel_l", extra=GRID))
def trade_log(spark, sf):
    return rounded(bt.trade_log(held(spark, sf)))


@query("equity_curve", v.with_views(f"select period, {r('equity', 'equity')}, {r('drawdown', 'drawdown')} from ed", "panel_l", extra=GRID))
def equity_curve(spark, sf):
    return rounded(bt.equity_curve(periods(spark, sf)).select("period", "equity", "drawdown"))


@query("backtest_performance", v.with_views(f"""
  select {r('eq - 1', 'total_return')}, {r(f'pow(eq, 252::double / (n * {FREQ})) - 1', 'annual_return')}, {r(f'ex / (sd + 1e-9) * sqrt(252::double / {FREQ})', 'sharpe_ratio')}, {r('mdd', 'max_drawdown')},
    {r('wr', 'win_rate')}, n n_periods, cast(nt as bigint) n_trades, {r('nt / (2 * n)', 'turnover')} from (select arg_max(equity, period) eq, count(*) n, avg(ret - 0.03::double / 252 * {FREQ}) ex, stddev_pop(ret) sd, min(drawdown) mdd,
    avg(case when ret > 0 then 1.0::double else 0.0::double end) wr, sum(n_held) nt from ed)""", "panel_l", extra=GRID))
def backtest_performance(spark, sf):
    return rounded(bt.performance(periods(spark, sf), FREQ).select("total_return", "annual_return", "sharpe_ratio", "max_drawdown", "win_rate", "n_periods", "n_trades", "turnover"))


@query("trade_costs", f"""select l_orderkey, l_linenumber, {r('''greatest(p * q * 0.0003::double, 5.0::double) + case when l_returnflag = 'R' then p * q * 0.001::double else 0 end
   + (p * 10 / 10000 + p * 0.1::double * sqrt(q / (q * 10))) * q''', 'cost', 4)} from (select *, l_extendedprice / l_quantity p, l_quantity q from lineitem)""")
def trade_costs(spark, sf):
    li = v.table(spark, sf, "lineitem").withColumn("p", F.col("l_extendedprice") / F.col("l_quantity"))
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    cost = bt.trade_cost(F.col("p"), F.col("l_quantity"), F.col("l_quantity") * 10, side)
    return rounded(li.select("l_orderkey", "l_linenumber", cost.alias("cost")), 4)


@query("cost_drag", v.with_views(f"""
  select period, {r("ret - (select sum(pr * sh * 0.0003::double) / 1e6 from (select pr, floor(1e6 / n / pr) sh from (select *, \"close\" * 1.001::double pr, count(*) over (partition by rebalance_date) n from hd)))", 'ret_after_cost')} from pe""", "panel_l", extra=GRID))
def cost_drag(spark, sf):
    return rounded(bt.apply_cost_drag(periods(spark, sf), bt.trade_log(held(spark, sf)), 1e6).select("period", "ret_after_cost"))


@query("strategy_capacity", v.with_views(f"select {r('sum(a * 0.05::double) * 252 / 2.0::double / 1e8', 'capacity')} from (select avg(amount) a from panel_l group by ts_code)", "panel_l"))
def strategy_capacity(spark, sf):
    return rounded(bt.capacity(v.panel_l(spark, sf)))


CAPW = GRID + """, c1 as (select *, least(1.0::double / count(*) over (partition by rebalance_date), 0.05::double) w from hd), c2 as (select * replace (w / sum(w) over (partition by rebalance_date) as w) from c1),
c3 as (select *, sum(w) over (partition by rebalance_date, industry) iw from c2), c4 as (select *, max((round(iw, 12), industry)) over (partition by rebalance_date) tp from c3),
c5 as (select *, case when industry = tp[2] and tp[1] > 0.25 then w * 0.7 else w end w2 from c4), c6 as (select *, case when tp[1] > 0.25 then w2 / sum(w2) over (partition by rebalance_date) else w2 end weight from c5)"""


@query("capped_weights", v.with_views(f"select rebalance_date, ts_code, {r('weight', 'weight')} from c6", "panel_l", extra=CAPW.replace("tp[1]", "tp.a").replace("tp[2]", "tp.b").replace("max((round(iw, 12), industry))", "max({'a': round(iw, 12), 'b': industry})")))
def capped_weights(spark, sf):
    return rounded(bt.capped_weights(held(spark, sf)).select("rebalance_date", "ts_code", "weight"))


PICKS = """pk as (select ts_code, date_trunc('quarter', trade_date) + interval 40 day q, case when max(total_mv) > 0 then 'trend' else 'bottom' end bucket, sum(amount) a from panel_l group by 1, 2),
pq as (select ts_code, cast(q as date) pick_date, bucket from pk qualify row_number() over (partition by q order by a desc, ts_code) <= 10)"""


def picks(spark, sf):
    df = v.panel_l(spark, sf)
    q = df.groupBy("ts_code", F.date_add(F.trunc("trade_date", "quarter"), 40).alias("pick_date")).agg(
        F.when(F.max("total_mv") > 0, "trend").otherwise("bottom").alias("bucket"), F.sum("amount").alias("a"))
    return bt.ranks.top_n(q, ["pick_date"], [F.col("a").desc(), F.col("ts_code")], 10, "ts_code", "_r").drop("_r", "a")


SCORE = PICKS + f""", fb as (select ts_code, trade_date, {', '.join(f'round((lead({C}, {n}) {W} / {C} - 1) * 100, 2) t{n}' for n in (1, 5, 20))} from panel_l),
sc as (select pq.ts_code, pick_date, bucket, trade_date signal_date, t1, t5, t20 from pq asof left join fb on pq.ts_code = fb.ts_code and pq.pick_date >= fb.trade_date)"""


@query("forward_scorecard", v.with_views("select ts_code, pick_date, bucket, signal_date, t1 + 0.0::double t1, t5 + 0.0::double t5, t20 + 0.0::double t20 from sc", "panel_l", extra=SCORE))
def forward_scorecard(spark, sf):
    return rounded(bt.forward_scorecard(picks(spark, sf), v.panel_l(spark, sf)), 2)


@query("scorecard_stats", v.with_views("""
  select horizon, coalesce(bucket, 'all') bucket, count(*) sample, round(avg(ret), 2) + 0.0::double mean_ret, round(avg(case when ret > 0 then 1.0::double else 0.0::double end) * 100, 1) win_rate
  from (select bucket, u.h horizon, u.x ret from (select bucket, unnest([{'h': 't1', 'x': t1}, {'h': 't5', 'x': t5}, {'h': 't20', 'x': t20}]) u from sc)) where ret is not null group by grouping sets ((horizon), (horizon, bucket))""", "panel_l", extra=SCORE))
def scorecard_stats(spark, sf):
    return rounded(bt.scorecard_stats(bt.forward_scorecard(picks(spark, sf), v.panel_l(spark, sf))), 2)


@query("nth_bar_after", v.with_views(f"""
  select pq.ts_code, pick_date, bucket, coalesce(n5, lc) price_after from pq asof left join (select ts_code, trade_date, lead({C}, 5) {W} n5, last_value({C}) over (partition by ts_code order by trade_date
    rows between unbounded preceding and unbounded following) lc from panel_l) n on pq.ts_code = n.ts_code and pq.pick_date <= n.trade_date""", "panel_l", extra=PICKS))
def nth_bar_after(spark, sf):
    return bt.nth_bar_after(picks(spark, sf), v.panel_l(spark, sf), 5)


@query("pick_hit_rates", v.with_views("""
  select horizon, count(*) count, round(avg(case when ret > 0 then 1.0::double else 0.0::double end) * 100, 1) win_rate, round(avg(ret), 2) + 0.0::double avg_return from (
    select u.h horizon, u.x ret from (select unnest([{'h': 't1', 'x': t1}, {'h': 't5', 'x': t5}, {'h': 't20', 'x': t20}, {'h': 'so_far', 'x': case when pick_date < date '2001-06-01' then t20 end}]) u from sc)) where ret is not null group by 1""", "panel_l", extra=SCORE))
def pick_hit_rates(spark, sf):
    df = bt.forward_scorecard(picks(spark, sf), v.panel_l(spark, sf))
    return rounded(bt.hit_rates(df, ("t1", "t5", "t20"), "t20", "pick_date", F.lit("2001-06-01").cast("date")), 2)


@query("pending_returns_filled", v.with_views("""
  select ts_code, pick_date, coalesce(case when hash_even then t1 end, t1) + 0.0::double t1, coalesce(case when not hash_even then 1.5::double end, t20) + 0.0::double t20
  from (select *, cast(ts_code as integer) % 2 = 0 hash_even from sc)""", "panel_l", extra=SCORE))
def pending_returns_filled(spark, sf):
    fresh = bt.forward_scorecard(picks(spark, sf), v.panel_l(spark, sf)).select("ts_code", "pick_date", "t1", "t20")
    even = F.col("ts_code").cast("int") % 2 == 0
    stored = fresh.select("ts_code", "pick_date", F.when(even, F.col("t1")).alias("t1"), F.when(~even, 1.5).alias("t20"))
    return rounded(bt.fill_pending(stored, fresh, ["ts_code", "pick_date"], ["t1", "t20"]), 2)


@query("selection_run_picks", """
  with p as (select cast(o_orderdate as date) data_date, o_orderstatus pool, max(o_orderkey) run_at from orders group by 1, 2)
  select data_date, pool, case when k.b = 0 then 'trend' else 'bottom' end bucket, cast(o_custkey as varchar) || k.b code, o_totalprice buy_score from p join orders on cast(o_orderdate as date) = data_date and o_orderstatus = pool and o_orderkey = run_at cross join (values (0), (1)) k(b)""")
def selection_run_picks(spark, sf):
    o = v.table(spark, sf, "orders")
    one = lambda n: F.array(F.struct(F.concat(F.col("o_custkey").cast("string"), F.lit(n)).alias("code"), F.col("o_totalprice").alias("buy_score")))
    runs = o.select(F.to_date("o_orderdate").alias("data_date"), F.col("o_orderstatus").alias("pool"), F.col("o_orderkey").alias("run_at"),
                    one("0").alias("trend_stocks"), one("1").alias("bottom_stocks"))
    return bt.selection_run_picks(runs)
