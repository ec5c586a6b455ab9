"""Print the formatted physical plan of registered queries, or a one-line
shape summary of every query after execution (exchanges, joins, windows).

    python -m seqframe.plans.explain kth_radius /root/testdata/sf0.01
    python -m seqframe.plans.explain --summary /root/testdata/sf0.01
"""

from __future__ import annotations

import re
import sys


def shape(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "exchanges": len(re.findall(r"Exchange", plan)),
        "single_partition": plan.count("SinglePartition"),
        "broadcast_hash_join": plan.count("BroadcastHashJoin"),
        "sort_merge_join": plan.count("SortMergeJoin"),
        "nested_loop_join": plan.count("BroadcastNestedLoopJoin"),
        "cartesian": plan.count("CartesianProduct"),
        "window": plan.count("Window "),
        "python": len(re.findall(r"InPandas|InArrow|ArrowEvalPython|BatchEvalPython", plan)),
    }


def main(argv: list[str]) -> None:
    from ..session import build_session
    from .catalog import queries

    spark = build_session()
    qs = queries()
    if argv and argv[0] == "--summary":
        sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
        cols = None
        for name, fn in qs.items():
            df = fn(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            s = shape(df)
            if cols is None:
                cols = list(s)
                print("| query | " + " | ".join(cols) + " |")
                print("|---" * (len(cols) + 1) + "|")
            print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)
        return
    name = argv[0]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    qs[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
