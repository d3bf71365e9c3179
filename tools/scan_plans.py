"""Print physical-plan findings of every query: cross products, row-wise Python, global windows."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tidepanel.plans import catalog  # noqa: E402
from tidepanel.session import build_session  # noqa: E402

SIGNS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SinglePartition")


def main():
    spark = build_session("plans", "local[8]", 8, {"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    sf = "/root/testdata/sf0.001"
    skip = ("stream_", "flow_page_rank")
    for name, fn in catalog.queries().items():
        if name.startswith(skip) or (len(sys.argv) > 1 and name not in sys.argv[1:]):
            continue
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = {s: len(re.findall(s, plan)) for s in SIGNS if s in plan}
        shuffles = len(re.findall(r"Exchange (hash|range)partitioning", plan))
        scans = len(re.findall("FileScan", plan))
        print(f"{name:32s} exchanges={shuffles:3d} scans={scans:3d} {found or ''}", flush=True)


if __name__ == "__main__":
    main()
