"""Average-cost accounting over long open episodes against a sequential fold."""

import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import portfolio as pf

SCHEMA = "account string, code string, side string, shares long, price double, seq long, trade_date date"


def fold(trades):
    shares, cost, realized = 0, 0.0, 0.0
    for side, n, price in trades:
        if side in ("BUY", "ADD"):
            shares, cost = shares + n, cost + round(price * n, 2)
        else:
            sold = shares if side == "CLOSE" else min(n, shares)
            if not shares:
                continue
            average = cost / shares
            realized += (price - average) * sold
            shares, cost = shares - sold, cost - average * sold
    return shares, cost, realized


@pytest.mark.parametrize("group_rows", [None, 1000])
@pytest.mark.parametrize("count", [2_400, 100_000])
def test_long_open_episode(spark, count, group_rows):
    rng = random.Random(count)
    halves = [("BUY", 1000, 10.0)] + [("REDUCE", 500, 11.0) if i % 2 == 0 else ("BUY", 500, 12.5) for i in range(count - 1)]
    mixed = [(rng.choice(["BUY", "REDUCE", "ADD"]), 100 * rng.randrange(1, 9), rng.randrange(500, 1500) / 100) for _ in range(count // 4)]
    rows = [(code, *t, i) for code, trades in (("A", halves), ("B", mixed)) for i, t in enumerate(trades)]
    ledger = spark.createDataFrame([("acc", c, s, n, p, i) for c, s, n, p, i in rows], SCHEMA.rsplit(",", 1)[0]).withColumn("trade_date", F.date_add(F.lit("2000-01-01").cast("date"), (F.col("seq") % 3000).cast("int")))
    got = {r.code: r for r in pf.holdings(ledger, F.floor(F.col("seq") / 5000), group_rows).collect()}
    for code, trades in (("A", halves), ("B", mixed)):
        shares, cost, realized = fold(trades)
        r = got[code]
        assert r.shares == shares and r.avg_cost is not None
        assert float(r.cost_amount) == pytest.approx(cost, abs=0.02 + 1e-9 * abs(cost)) and float(r.realized_pnl) == pytest.approx(realized, abs=0.02 + 1e-7 * abs(realized))
