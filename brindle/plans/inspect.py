"""What a plan does: pushed filters, columns read, exchanges, and whether batches and generated code are used."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def report(df: DataFrame) -> dict:
    """For each file scan its columns and the filters pushed to it; the number of exchanges; batched scans."""
    execution = df._jdf.queryExecution()
    leaves = execution.sparkPlan().collectLeaves()
    scans = [leaf for leaf in (leaves.apply(i) for i in range(leaves.size())) if leaf.getClass().getSimpleName() == "FileSourceScanExec"]
    plan = execution.executedPlan().toString()
    return {
        "read": [list(s.requiredSchema().fieldNames()) for s in scans],
        "pushed": [s.dataFilters().mkString("; ") for s in scans],
        "exchanges": len(re.findall(r"\bExchange ", plan)),
        "batched": all(s.supportsColumnar() for s in scans),
    }
