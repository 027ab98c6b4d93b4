"""Request-anchored fixed-window quotas over micro-batches.

A key's window starts with its first request and the next one with the first request after it has
run out. What has to be walked in order is only (key, millisecond, count), which is summed before
the shuffle: a key with a third of all requests costs as many steps as the batch has milliseconds.
The requests themselves meet the outcome in a join with the milliseconds in which something is
refused. The counters live in a table with one version per batch, so a batch that is run again
starts from the same counters.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.config import Limits
from meterline.lineage import cut, stored
from meterline.operators.ratelimit import limit_table
from meterline.sources.logs import paths_matching

STATE = "kind string, key string, started_ms long, used long"
_WALKED = "key string, ms long, allowed long, started_ms long, used long"


def _walk(window_ms: int):
    def walk(key: tuple, slices: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        started = int(state["started_ms"].iloc[0]) if len(state) else None
        used = int(state["used"].iloc[0]) if len(state) else 0
        out = []
        ordered = slices.sort_values("ms")
        for ms, n, quota in zip(ordered["ms"], ordered["n"], ordered["quota"]):
            if started is None or ms - started >= window_ms:
                started, used = int(ms), 0
            allowed = max(0, min(int(n), int(quota) - used))
            used += allowed
            if allowed < n:
                out.append((key[0], int(ms), allowed, None, None))
        out.append((key[0], None, None, started, used))
        return pd.DataFrame(out, columns=["key", "ms", "allowed", "started_ms", "used"]).astype(
            {"ms": "Int64", "allowed": "Int64", "started_ms": "Int64", "used": "Int64"})

    return walk


def _stage(
    rows: DataFrame, state: DataFrame, kind: str, key: str, quota: Column, window_ms: int
) -> tuple[DataFrame, DataFrame]:
    reason = f"rate_limited_{kind}"
    counted = rows.withColumn("_ms", F.floor(F.unix_micros("ts") / F.lit(1000))) \
        .withColumn("_quota", F.when(
            F.col("limit_reason").isNull() & F.col("client_id").isNotNull()
            & F.col(key).isNotNull(), quota))
    asked = F.col("_quota").isNotNull()
    slices = counted.filter(asked).groupBy(F.col(key).alias("key"), F.col("_ms").alias("ms")).agg(
        F.count(F.lit(1)).alias("n"), F.max("_quota").alias("quota"))
    own = state.filter(F.col("kind") == kind)
    # Checkpointed: it feeds both the decisions and the next counters. Only milliseconds in which
    # something is refused come back.
    walked = cut(slices.groupBy("key").cogroup(own.groupBy("key"))
                 .applyInPandas(_walk(window_ms), _WALKED))
    refusing = walked.filter("ms is not null").select(
        F.col("key").alias(key), F.col("ms").alias("_ms"), F.col("allowed").alias("_allowed"))
    # Where a millisecond is allowed in part, its requests are ranked to find the last one allowed.
    rank = F.row_number().over(Window.partitionBy(key, "_ms").orderBy("_ord"))
    last = counted.filter(asked).select(key, "_ms", F.struct("ts", "request_id").alias("_ord")) \
        .join(refusing.filter("_allowed > 0"), [key, "_ms"]).withColumn("_rn", rank) \
        .filter("_rn = _allowed").select(key, "_ms", F.col("_ord").alias("_cut"))
    outcome = stored(refusing.join(last, [key, "_ms"], "left"), "outcome")
    late = F.col("_cut").isNull() | (F.struct("ts", "request_id") > F.col("_cut"))
    decided = counted.join(outcome, [key, "_ms"], "left").withColumn(
        "limit_reason", F.when(asked & F.col("_allowed").isNotNull() & late, reason)
        .otherwise(F.col("limit_reason"))
    ).drop("_ms", "_quota", "_allowed", "_cut", "_limit")
    counters = walked.filter("ms is null and started_ms is not null").select(
        F.lit(kind).alias("kind"), "key", "started_ms", "used")
    return decided, counters


def limit_batch(
    batch: DataFrame, state: DataFrame, limits: Limits
) -> tuple[DataFrame, DataFrame]:
    """Decide the requests of one batch. Returns them with `limit_reason`, and the new counters."""
    spark = batch.sparkSession
    rows = batch.withColumn("limit_reason", F.lit(None).cast("string"))
    counters = spark.createDataFrame([], STATE)
    if not limits.enabled:
        return rows, state
    if limits.clients or limits.default_per_window is not None:
        default = F.lit(limits.default_per_window).cast("long")
        named = rows.join(limit_table(spark, "client_id", limits.clients), "client_id", "left")
        rows, own = _stage(named, state, "client", "client_id",
                           F.coalesce(F.col("_limit"), default), limits.window_ms)
        counters = counters.unionByName(own)
    if limits.tasks:
        named = rows.join(limit_table(spark, "task_id", limits.tasks), "task_id", "left")
        rows, own = _stage(named, state, "task", "task_id", F.col("_limit"), limits.window_ms)
        counters = counters.unionByName(own)
    return rows, counters


def _counters_before(spark: SparkSession, root: str, number: int) -> DataFrame:
    done = paths_matching(spark, f"{root}/batch=*/_SUCCESS")
    numbers = [int(p.rsplit("batch=", 1)[1].split("/", 1)[0]) for p in done]
    earlier = [n for n in numbers if n < number]
    if not earlier:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{root}/batch={max(earlier)}")


def limiter(limits: Limits, state_root: str, out_root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: writes the decided requests and the counters of each batch."""
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _counters_before(spark, state_root, number)
        decided, counters = limit_batch(batch, state, limits)
        decided.write.mode("overwrite").parquet(f"{out_root}/batch={number}")
        # Keys without a request in this batch keep their counter until its window has run out.
        newest = batch.agg(F.floor(F.unix_micros(F.max("ts")) / 1000).alias("now")).first()["now"]
        idle = state.join(counters.select("kind", "key"), ["kind", "key"], "left_anti")
        if newest is not None:
            idle = idle.filter(F.col("started_ms") + F.lit(limits.window_ms) > F.lit(newest))
        idle.unionByName(counters).write.mode("overwrite") \
            .parquet(f"{state_root}/batch={number}")

    return run
