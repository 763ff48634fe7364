"""Physical-plan summary of the headline queries -> PLANS.md.

    python tools/plans.py [/root/testdata/sf0.1]

Plans are taken as they are made for large inputs (broadcast joins off), and of
every job of a query: each working table that it writes, and its result.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrameWriter  # noqa: E402

from bench import HEADLINE  # noqa: E402
from clicktrail.registry import SPARK_QUERIES, load_all  # noqa: E402
from clicktrail.session import get_spark  # noqa: E402

QUERIES = [*HEADLINE, "responses_with_traces", "coverage_report", "box_summary"]
PATTERNS = {
    "shuffles": r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
    "reused": r"ReusedExchange",
    "broadcasts": r"BroadcastExchange",
    "sort-merge joins": r"SortMergeJoin",
    "hash joins": r"ShuffledHashJoin|BroadcastHashJoin",
    "nested-loop joins": r"BroadcastNestedLoopJoin|CartesianProduct",
    "windows": r"\bWindow\b",
    "aggregates": r"HashAggregate|ObjectHashAggregate|SortAggregate",
    "Python stages": r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
    "table scans": r"FileScan parquet",
}


def summarize(plan: str) -> dict[str, int]:
    # a reused exchange prints its source ("ReusedExchange [...], Exchange hashpartitioning ...") on one line
    lines = "\n".join(ln for ln in plan.splitlines() if "ReusedExchange" not in ln)
    counts = {k: len(re.findall(v, lines)) for k, v in PATTERNS.items()}
    return counts | {"reused": plan.count("ReusedExchange")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main(argv: list[str]) -> None:
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    load_all()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written: list[str] = []
    write = DataFrameWriter.parquet
    DataFrameWriter.parquet = lambda self, *a, **k: (written.append(plan_of(self._df)), write(self, *a, **k))[1]
    out = [
        "# Plans of the headline queries",
        "",
        f"Generated by `python tools/plans.py {sf}`, as planned for large inputs (`autoBroadcastJoinThreshold` -1), before",
        "adaptive changes. One line for each job: the working tables a query writes on its way, in order, then its result.",
        "",
        "| query, job | " + " | ".join(PATTERNS) + " |",
        "|---|" + "---|" * len(PATTERNS),
    ]
    details = []
    for name in QUERIES:
        written.clear()
        last = plan_of(SPARK_QUERIES[name](spark, sf))
        jobs = [*written, last]
        for i, plan in enumerate(jobs, 1):
            s = summarize(plan)
            out.append(f"| {name}, {i} of {len(jobs)} | " + " | ".join(str(s[k]) for k in PATTERNS) + " |")
        every = "\n".join(jobs)
        pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", every) if p})
        schemas = sorted({x for x in re.findall(r"ReadSchema: (struct<[^>]*>)", every) if "event_id" in x or "props" in x or "o_" in x})
        details += [f"## {name}", "", "Pushed filters: " + ("; ".join(pushed) or "none"), ""]
        details += ["Read schemas of the input: " + ("; ".join(f"`{x}`" for x in schemas) or "none"), ""]
    DataFrameWriter.parquet = write
    Path("PLANS.md").write_text("\n".join(out + [""] + details) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main(sys.argv)
