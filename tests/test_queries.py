"""Every fifth registered query runs on the smallest data (tools/scan_plans.py reads all plans); plans stay free of row-wise Python and
cross products; results do not depend on the order of input rows."""

import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tidepanel.operators import factors as fx
from tidepanel.operators import xsection as xs
from tidepanel.plans import catalog
from tidepanel.plans import views as v

HEAVY = ("stream_", "flow_page_rank", "rank_model", "direction_model", "cross_validated", "item_view", "orthogonal", "strategy_grid", "weighted_rank_score_split")
QUICK = [n for n in catalog.queries() if not n.startswith(HEAVY)]


@pytest.mark.parametrize("name", QUICK[::5])
def test_plan_has_no_cross_product_or_row_python(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan and "NestedLoop" not in plan


def test_entry_returns_picks(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["trade_date", "ts_code"] and df.count() > 0


def test_every_oracle_has_a_query_and_callables_take_two_arguments():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert all(len(inspect.signature(f).parameters) == 2 for f in entry_module.queries().values())


def test_scan_reads_only_needed_columns(spark, sf):
    plan = catalog.queries()["panel_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_results_do_not_depend_on_row_order(spark, sf):
    base = v.panel_e(spark, sf)
    for df in (base.orderBy(F.rand(1)), base.repartition(5)):
        got = xs.industry_neutral(fx.returns(df), "amount").select("ts_code", "trade_date", F.round("industry_neutral_score", 9)).collect()
        want = xs.industry_neutral(fx.returns(base), "amount").select("ts_code", "trade_date", F.round("industry_neutral_score", 9)).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_wide_and_narrow_plans_agree(spark, sf):
    df = v.panel_e(spark, sf)
    small = xs.z_scores(df, ["trade_date"], {"z": "amount"}, group_rows=100).select("ts_code", "trade_date", F.round("z", 9).alias("z"))
    wide = xs.z_scores(df, ["trade_date"], {"z": "amount"}).select("ts_code", "trade_date", F.round("z", 9).alias("z"))
    assert small.exceptAll(wide).count() == 0
