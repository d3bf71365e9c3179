"""Queries that read an input several times store it, and fits get tasks of bounded size."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import evaluate as ev
from tidepanel.operators import factors as fx
from tidepanel.operators import market
from tidepanel.operators import xsection as xs
from tidepanel.plans import catalog
from tidepanel.session import SHUFFLE_CLEANUP, cut_lineage


@pytest.mark.parametrize("name", ["factor_report", "selected_factors", "model_health", "dynamic_weights"])
def test_the_panel_is_not_computed_again_by_each_use(spark, sf, name):
    read = catalog.queries()[name](spark, sf).inputFiles()
    assert read and not [f for f in read if "lineitem" in f]


def test_the_series_of_the_item_view_are_computed_once(spark, sf, monkeypatch):
    """Ranks and the rows they join read one stored section, whose series were dealt by rows."""
    read = catalog.queries()["item_view"](spark, sf).inputFiles()
    assert read and not [f for f in read if "events" in f]
    monkeypatch.setattr(fx, "SERIES_ROWS", 10)
    assert fx.series_tasks(spark.range(1234)) == 124
    monkeypatch.setattr(fx, "SERIES_ROWS", 10**6)
    assert fx.series_tasks(spark.range(1234)) == spark.sparkContext.defaultParallelism


def test_rows_to_fit_on_are_dealt_over_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(ev, "FIT_ROWS", 100)
    df = spark.range(0, 5000, 1, 1).select((F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("b"), F.when(F.col("id") % 5 > 0, 1.0).alias("y"))
    rows = ev._fit_table(df, ["a", "b"], "y")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 40 and max(sizes) <= 200


def test_models_are_fitted_on_cells_in_place_of_rows(spark, monkeypatch):
    """A fit sees rows of equal bins as one, whatever their number, and predicts as one on the rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    a, b = (F.col("id") * 7919) % 5, (F.col("id") * 104729) % 7
    rows = spark.range(4000).select(F.col("id").cast("string").alias("ts_code"), F.lit("2000-01-01").cast("date").alias("trade_date"), F.when(a > 0, a.cast("double")).alias("a"),
                                    b.cast("double").alias("b"), F.when(F.col("id") % 10 < 9, F.sin(a * 3 + b) + (F.col("id") % 13) / 50).alias("y"))
    plain = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.fillna(0.0, ["a", "b"]))
    known = plain.where("y is not null")
    gbt = GBTRegressor(labelCol="y", maxDepth=3, maxIter=10, seed=7).fit(known).transform(plain).select("ts_code", "prediction").collect()
    forest = RandomForestRegressor(labelCol="y", maxDepth=5, numTrees=20, seed=7).fit(known).transform(plain).select("ts_code", "prediction").collect()
    sizes = []
    for kind in (GBTRegressor, RandomForestRegressor):
        monkeypatch.setattr(kind, "fit", lambda self, df, fit=kind.fit: sizes.append(df.count()) or fit(self, df))
    got = {(r.model, r.ts_code): r.pred for r in ev.rank_model(rows, rows, ["a", "b"], "y").collect()}
    assert len(sizes) == 1 + ev.TREES and max(sizes) <= 35 and len(got) == 8000
    assert max(abs(got["gbt", r.ts_code] - r.prediction) for r in gbt) < 1e-9
    x, y = [got["forest", r.ts_code] for r in forest], [r.prediction for r in forest]
    assert np.corrcoef(x, y)[0, 1] > 0.95 and abs(np.mean(x) - np.mean(y)) < 0.05


def test_a_forest_draws_its_rows_with_replacement_however_they_are_dealt(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 3).cast("double").alias("a"), F.lit(1.0).alias("y"))
    one, two = ({(r["_tree"], r["_b0"]): r["_weight"] for r in ev._cells(t, [F.col("a")], "y", range(21)).collect()} for t in (rows.repartition(7), rows.repartition(3, "a")))
    assert one == two and len(one) == 63 and len(set(one.values())) > 40
    totals = [sum(one[t, v] for v in range(3)) for t in range(21)]
    assert totals[0] == 20_000 and all(abs(n - 20_000) < 5 * 20_000**0.5 for n in totals[1:])
    n = np.array([r[0] for r in spark.range(100_000).select(ev._draws((F.col("id") + 0.5) / 100_000)).collect()])
    assert abs(n.mean() - 1) < 1e-3 and abs(n.var() - 1) < 1e-2 and n.max() >= 7


def test_cuts_come_from_all_rows(spark):
    x = F.when(F.col("id") < 5, F.col("id") - 10.0).otherwise(F.when(F.col("id") < 6000, 3.0).otherwise(F.col("id") / 7))
    rows = spark.range(10_000).select(x.alias("x"), (F.col("id") == 9).cast("double").alias("y"), F.lit(2.0).alias("z"), F.lit(None).cast("double").alias("n"))
    cuts = ev._cuts(rows.fillna(0.0), ["x", "y", "z", "n"])
    assert cuts[1:] == [[0.0], [], []] and 3.0 in cuts[0] and len(cuts[0]) <= 2 * ev.BINS
    got = rows.select("x", ev._bin(F.col("x"), cuts[0]).alias("b")).distinct().collect()
    assert all(r.b == 1 + sum(c < r.x for c in cuts[0]) for r in got)
    assert {r.b for r in got if r.x < 0} == {1.0} and {r.b for r in got if r.x == 3} == {2.0}


def test_a_total_of_nothing_is_no_favourite(spark):
    rows = [("a", 0.1), ("a", 0.2), ("a", -0.3), ("b", 0.1), ("b", 0.2), ("b", -0.29)]
    got = market.favourites(spark.createDataFrame(rows, "k string, v double"), "k", "v", 3).collect()
    assert [(r.k, r.total, r.n) for r in got] == [("b", 0.01, 3)]


def test_a_stored_stage_leaves_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = blocks.getAllFiles()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(SHUFFLE_CLEANUP)
    stored = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    until = time.monotonic() + 20  # files are deleted in the background
    while shuffles() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(SHUFFLE_CLEANUP) == setting and stored.count() == 100


def test_factors_of_a_section_are_ranked_in_different_tasks(spark):
    rows = spark.range(400).selectExpr("date_add(date'2024-01-01', cast(id % 4 as int)) trade_date", "cast(id as string) ts_code", "id % 7 * 1d a", "id % 5 * 1d b", "id % 3 * 1d c")
    by_date = rows.repartition(4, "trade_date")  # satisfies windows by date and factor
    scores = xs.weighted_rank_score(by_date, {"a": 1.0, "b": 1.0, "c": 1.0}, group_rows=400)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(trade_date#\d+, factor#\d+, \d+\), REPARTITION_BY_NUM", plan) and scores.count() == 400


@pytest.mark.parametrize("name", ["prediction_ensemble", "ic_weighted_average"])
def test_shipments_series_and_predictions_are_dealt_over_a_given_number_of_tasks(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    asked = [r"l_suppkey#\d+L, trade_date#\d+", r"ts_code#\d+", *([r"trade_date#\d+"] if name == "prediction_ensemble" else [])]
    assert all(re.search(rf"hashpartitioning\({keys}, \d+\), REPARTITION_BY_NUM", plan) for keys in asked)
