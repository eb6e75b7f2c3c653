"""Dealing small scans over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than half the cores (a small file has one row group) is dealt over all of them before costly work."""
    plan, cores = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext.defaultParallelism
    if "Scan" not in plan.toString() or "Exchange" in plan.toString() or "StreamingRelation" in plan.toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
