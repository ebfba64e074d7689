"""Plans as text, and what they give away: scans, joins, exchanges, what was pushed down."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@dataclass
class PlanFacts:
    scans: int = 0
    exchanges: int = 0
    broadcast_joins: int = 0
    sort_merge_joins: int = 0
    cartesian: int = 0
    python: int = 0
    pushed: list[str] = field(default_factory=list)
    read_schemas: list[str] = field(default_factory=list)

    def warnings(self) -> list[str]:
        out = []
        if self.cartesian:
            out.append("a join pairs all rows with all rows")
        if self.scans and not any(self.pushed):
            out.append("no filter reaches a scan")
        if self.python:
            out.append("rows pass through Python")
        return out


def facts(df: DataFrame) -> PlanFacts:
    text = explain(df)
    tree, _, details = text.partition("\n\n")
    n = lambda pattern: len(re.findall(pattern, tree))
    inside = lambda label: [x for x in re.findall(rf"{label}: (.*)", details)]
    pushed = [x.strip("[]") for x in inside("PushedFilters")]
    return PlanFacts(n(r"Scan \w+|LocalTableScan"), n(r"\bExchange\b"), n("BroadcastHashJoin"), n("SortMergeJoin"), n("CartesianProduct|BroadcastNestedLoopJoin"), n("Python|Pandas|Arrow"), [x for x in pushed if x], inside("ReadSchema"))


def query_warnings(sql: str) -> list[str]:
    """What the text of a query alone gives away."""
    low = " ".join(sql.lower().split())
    checks = (
        (r"select \*", "selects all columns"),
        (r"like '%", "a pattern that begins with % can't prune"),
        (r"\bor\b", "OR may keep filters from the scan"),
        (r"\bdistinct\b", "DISTINCT shuffles"),
    )
    found = [text for pattern, text in checks if re.search(pattern, low)]
    if low.startswith("select") and " limit " not in f"{low} ":
        found.append("has no LIMIT")
    return found
