"""Shared measures of the cost and latency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.cost import ratio, round_half_up


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def total(column: str) -> Column:
    return F.sum(F.coalesce(F.col(column), F.lit(0.0)))


COUNTS = {
    "teacher_requests": lambda: F.col("routing_decision") == "teacher",
    "student_requests": lambda: F.col("routing_decision") == "student",
    "fallback_requests": lambda: F.col("routing_reason").contains("fallback"),
    "errors": lambda: F.col("status") == "error",
}


def measure(
    df: DataFrame,
    keys: list[str],
    counts: dict[str, Column],
    totals: list[str] = (),
    rows: str = "requests",
    avg_latency: bool = True,
    p95_latency: bool = False,
) -> DataFrame:
    """One row per key: row count, conditional counts, unrounded sums, latency figures.

    With the exact percentile the rows are first summed per (key, latency): that pass is an
    ordinary hash aggregation with map-side combine, and the percentile then weighs distinct
    latencies by their counts. A key with most of all rows costs no more than its number of
    distinct millisecond values."""
    if not p95_latency:
        aggs = [F.count(F.lit(1)).alias(rows)]
        aggs += [count_if(cond).alias(name) for name, cond in counts.items()]
        aggs += [total(c).alias(c) for c in totals]
        if avg_latency:
            aggs.append(F.avg("latency_ms").alias("avg_latency_ms"))
        return df.groupBy(*keys).agg(*aggs)

    first = [F.count(F.lit(1)).alias("_n")]
    first += [count_if(cond).alias(name) for name, cond in counts.items()]
    first += [total(c).alias(c) for c in totals]
    by_latency = df.groupBy(*keys, "latency_ms").agg(*first)
    timed = F.when(F.col("latency_ms").isNotNull(), F.col("_n"))
    second = [F.sum("_n").alias(rows)]
    second += [F.sum(name).alias(name) for name in counts]
    second += [F.sum(c).alias(c) for c in totals]
    second.append(
        (F.sum(F.col("latency_ms").cast("double") * F.col("_n")) / F.sum(timed))
        .alias("avg_latency_ms"))
    second.append(F.percentile("latency_ms", 0.95, F.col("_n")).alias("p95_latency_ms"))
    out = by_latency.groupBy(*keys).agg(*second)
    if not keys:
        # An empty log still has a row of zero counts and no sums.
        out = out.withColumn(rows, F.coalesce(F.col(rows), F.lit(0)))
    return out


def usd(column: str) -> Column:
    return round_half_up(F.col(column), 8).alias(column)


def ms(column: str) -> Column:
    return round_half_up(F.col(column), 2).alias(column)


def rate(part: str, whole: str, name: str) -> Column:
    return ratio(F.col(part), F.col(whole)).alias(name)


def top(df: DataFrame, descending: list[str], tie: list[str], limit: int | None) -> DataFrame:
    """Report order and length. Keys break ties, which makes the cut repeatable."""
    ordered = df.orderBy(*[F.desc(c) for c in descending], *[F.asc(c) for c in tie])
    return ordered if limit is None else ordered.limit(limit)
