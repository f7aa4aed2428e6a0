"""Dump the physical plan of every registered query and flag scale risks.

    python -m checks.plans [sf_dir] [out_dir]

Writes ``<out_dir>/<query>.txt`` (``explain("formatted")``) and prints one
line per query: number of exchanges, and counts of single-partition
exchanges, windows, broadcasts and subqueries.  Fails (exit code 1) on a
nested-loop or cartesian join or a Python UDF in any plan.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

RISKS = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython")
COUNTED = ("SinglePartition", "Window", "BroadcastExchange", "Subquery", "Expand")


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from agora.plans.catalog import registry
    from agora.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out_dir = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="agora-plans-")
    os.makedirs(out_dir, exist_ok=True)
    spark = build_session("local[8]", shuffle_partitions=8)
    bad = []
    for name, query in registry().items():  # not the operators of agora.llm, which use Python on purpose
        df = query(spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as fh:
            fh.write(text)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = " ".join(f"{k}={len(re.findall(k, plan))}" for k in COUNTED
                          if re.search(k, plan))
        risks = [k for k in RISKS if k in plan]
        bad += [(name, r) for r in risks]
        print(f"{name:28s} exchanges={plan.count('Exchange')} {counts} {' '.join(risks)}")
    # the staged parts: the per-order statistics and the written sides
    from agora.plans.catalog import tpch_workspace
    from agora.plans.fanout import _order_stats, _side_rows, build_fanout

    tables = tpch_workspace(spark, sf_dir).tables
    fan = build_fanout(tables)
    staged = {"staged_order_stats": _order_stats(_side_rows(tables)),
              **{f"staged_{n}": getattr(fan, n) for n in ("orders", "items", "payments", "reviews")}}
    for name, df in staged.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        risks = [k for k in RISKS if k in plan]
        bad += [(name, r) for r in risks]
        print(f"{name:28s} exchanges={plan.count('Exchange')} {' '.join(risks)}")
    print("plans in", out_dir)
    if bad:
        print("RISKS:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
