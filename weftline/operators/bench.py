"""Statistics of repeated runs and of load steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., runs, median, min, max, mean, spread) of ``value``."""
    v = F.col(value)
    low, high = F.min(v), F.max(v)
    return runs.groupBy(*by).agg(F.count(v).alias("runs"), F.median(v).alias("median"), low.alias("min"), high.alias("max"), F.avg(v).alias("mean"), (high - low).alias("spread"))


def delta(baseline: Column, current: Column) -> tuple[Column, Column]:
    """Absolute and relative change; the relative one is NaN for a baseline of 0."""
    change = current - baseline
    return change, F.when(baseline == 0, F.lit(float("nan"))).otherwise(change / F.nullif(baseline, F.lit(0.0)))


def direction(change: Column, spread: Column) -> Column:
    """``unchanged`` within the spread, else ``improved`` for less and ``regressed``."""
    return F.when(F.abs(change) <= spread, "unchanged").when(change < 0, "improved").otherwise("regressed")


def capacity(steps: DataFrame, *by: str) -> DataFrame:
    """(by..., best_rps, first_breach): the best rate that steps within their objective
    achieved, and the least target that broke it. ``steps``: (target, achieved, ok)."""
    return steps.groupBy(*by).agg(F.max(F.when(F.col("ok"), F.col("achieved"))).alias("best_rps"), F.min(F.when(~F.col("ok"), F.col("target"))).alias("first_breach"))


def clamp_runs(runs: float | None) -> int:
    if runs is None or runs != runs or runs in (float("inf"), float("-inf")):
        return 5
    return min(50, max(1, int(runs // 1)))
