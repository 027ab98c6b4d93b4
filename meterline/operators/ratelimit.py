"""Fixed-window quotas per client and per task, over calendar-aligned windows.

The client quota is applied first, then the task quota over what the clients were allowed. A
request refused by the task quota has therefore already counted for its client; with one kind of
quota configured the result is exactly that of counting request by request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.config import Limits
from meterline.operators.ranking import mark_first_n
from meterline.tables import small_table

# Cuts of one window. They only bound how many rows of one key are ranked together.
WINDOW_SLICES = 1024


def limit_table(spark, name: str, limits: dict[str, int]) -> DataFrame:
    schema = T.StructType().add(name, "string").add("_limit", "long")
    return small_table(spark, [(k, int(v)) for k, v in limits.items()], schema)


def _stage(df: DataFrame, key: str, quota: Column, limits: Limits, reason: str) -> DataFrame:
    """Give `limit_reason` to the rows that are not among the first `quota` of key and window."""
    micros = F.unix_micros("ts")
    width = limits.window_ms * 1000
    slice_no = F.floor(F.pmod(micros, F.lit(width)) * WINDOW_SLICES / width)
    open_rows = F.col("limit_reason").isNull() & F.col("client_id").isNotNull() \
        & F.col(key).isNotNull()
    marked = mark_first_n(
        df.withColumn("_window", F.floor(micros / F.lit(width)))
        .withColumn("_quota", F.when(open_rows, quota)),
        [key, "_window"], ["ts", "request_id"], slice_no, "_quota", "_inside")
    return marked.withColumn(
        "limit_reason", F.when(~F.col("_inside"), reason).otherwise(F.col("limit_reason"))
    ).drop("_window", "_quota", "_inside", "_limit")


def apply_limits(requests: DataFrame, limits: Limits) -> DataFrame:
    """Add `limit_reason`: NULL where allowed, else rate_limited_client or rate_limited_task.

    Needs `ts` and a `request_id` that is unique; requests without client are always allowed."""
    out = requests.withColumn("limit_reason", F.lit(None).cast("string"))
    if not limits.enabled:
        return out
    spark = requests.sparkSession
    if limits.clients or limits.default_per_window is not None:
        default = F.lit(limits.default_per_window).cast("long")
        named = out.join(limit_table(spark, "client_id", limits.clients), "client_id", "left")
        out = _stage(named, "client_id", F.coalesce(F.col("_limit"), default), limits,
                     "rate_limited_client")
    if limits.tasks:
        named = out.join(limit_table(spark, "task_id", limits.tasks), "task_id", "left")
        out = _stage(named, "task_id", F.col("_limit"), limits, "rate_limited_task")
    return out
