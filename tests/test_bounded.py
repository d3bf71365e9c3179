"""Cuts, order statistics, samples and lists that stay bounded in any group."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import market, ranks


@pytest.mark.parametrize("descending", [True, False])
def test_cut_keeps_the_first_rows_and_few_others(spark, descending):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["hot"] * 40_000 + ["small"] * 900 + ["ties"] * 5000 + [None] * 3000, "id": np.arange(48_900), "v": np.round(rng.normal(size=48_900), 4)})
    pdf.loc[pdf["g"] == "ties", "v"] = 1.0
    pdf.loc[::97, "v"] = None
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    n = 1500
    kept = ranks.threshold_cut(df, ["g"], F.col("v"), n, "id", descending)
    sizes = {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()}
    assert sizes["hot"] < (2 * n if descending else 2 * n + 40_000 // 97 + 1) and sizes["small"] == 900 and sizes["ties"] >= n and sizes[None] >= n
    order = [F.col("v").desc() if descending else F.col("v").asc(), F.col("id")]
    plain = ranks.top_n(df, ["g"], order, n, "id").select("g", "id", "pick_rank")
    cut = ranks.top_n(df, ["g"], order, n, "id", value=F.col("v"), descending=descending).select("g", "id", "pick_rank")
    assert plain.count() == 3 * n + 900 and plain.exceptAll(cut).count() == 0 and cut.count() == plain.count()


def test_order_statistics_take_values_by_position(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 3000), "x": np.round(rng.normal(size=3000), 2), "y": rng.integers(0, 4, 3000).astype(float)})
    pdf.loc[::11, "x"] = None
    pdf.loc[pdf["g"] == "c", "y"] = None
    df = spark.createDataFrame(pdf).select("g", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")])
    specs = {"x1": ("x", 0.1), "x9": ("x", 0.9), "xt": ("x", 1.0), "y5": ("y", 0.5)}
    want = {}
    for g, part in pdf.groupby("g"):
        for o, (c, q) in specs.items():
            values = np.sort(part[c].dropna())
            want[g, o] = values[min(int(len(values) * q), len(values) - 1)] if len(values) else None
    for limit in (10, 10_000):
        got = {(r["g"], o): r[o] for r in ranks.order_statistics(df, ["g"], specs, group_rows=3000, limit=limit).collect() for o in specs}
        assert got == want
    plan = ranks.order_statistics(df, ["g"], specs, group_rows=3000)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_samples_are_the_least_hashes(spark):
    rows = [(f"k{i:04d}", 2000 + (i % 7 == 0)) for i in range(4000)] + [("n1", None), ("n2", None)]
    df = spark.createDataFrame(rows, "k string, y int")
    got = {(r.k, r.y) for r in market.stratified_sample(df, F.col("y"), ["k"], 300).collect()}
    digest = lambda k: hashlib.md5(k.encode()).hexdigest()
    want = {x for y in (2000, 2001, None) for x in sorted((r for r in rows if r[1] == y), key=lambda r: (digest(r[0]), r[0]))[:300]}
    assert got == want
    kept = {r.k for r in market.whole_key_sample(df, "k", 0.25).collect()}
    assert kept == {k for k, _ in rows if int(digest(k)[:8], 16) % 10_000 < 2500}


def test_a_rank_step_moves_no_link(spark):
    from tidepanel.operators import flow

    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + j) % 50}", 1.0 + j) for i in range(50) for j in range(4)], "source string, target string, weight double")
    name, links = flow.stored_links(edges)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rank = links.select(F.col("source").alias("node")).distinct().withColumn("rank", F.lit(0.02))
        plan = flow.received(links, rank)._jdf.queryExecution().executedPlan().toString()
        scan = plan[:plan.index("Bucketed: true")].splitlines()
        join = max(i for i, line in enumerate(scan) if "Join" in line)
        assert not any("Exchange" in line for line in scan[join:])  # from the join down to the links
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"drop table {name}")
    few = {r.sector_name: r.pagerank for r in flow.page_rank(edges, iterations=200, small=1).collect()}
    assert len(few) == 50 and abs(sum(few.values()) - 1) < 1e-4 and few == {r.sector_name: r.pagerank for r in flow.page_rank(edges, iterations=60, small=1, tolerance=1e-16).collect()}
