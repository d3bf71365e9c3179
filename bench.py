"""Headline queries, median of three timed runs after one warm-up; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
Each run writes to the noop sink, so every row and column is computed.
"""

import contextlib
import json
import os
import statistics
import sys
import time

from tidepanel.plans import catalog
from tidepanel.session import build_session, clear_stages

HEADLINE = {
    "q1_factor_panel": "factor_panel", "q2_rank_score": "weighted_rank_score", "q3_rank_ic": "rank_ic",
    "q4_state_probability": "state_probabilities", "q5_rotation_edges": "flow_rotation_edges", "q5_granger_edges": "flow_granger_edges",
    "q6_backtest": "backtest_performance", "q7_consensus": "research_consensus", "q8_asof_join": "asof_join",
    "q9_rule_selection": "rule_selection", "q10_ledger": "ledger_holdings",
}


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session("bench", f"local[{cpus}]", cpus, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                                "spark.driver.memory": "16g"})
        spark.sparkContext.setLogLevel("ERROR")
        queries, spent = catalog.queries(), {}
        for label, name in HEADLINE.items():
            runs = []
            for i in range(repeats + 1):
                t0 = time.perf_counter()
                queries[name](spark, sf).write.format("noop").mode("overwrite").save()
                if i:
                    runs.append(time.perf_counter() - t0)
                clear_stages(spark)
            spent[label] = round(statistics.median(runs), 3)
            print(label, spent[label], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
