"""Cost, savings, latency and error reports over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.cost import round_half_up
from meterline.functions.text import day_of, parse_timestamp
from meterline.operators.aggregate import COUNTS, measure, ms, rate, top, usd

COST, TEACHER_COST, SAVINGS = (
    "estimated_cost_usd", "estimated_teacher_cost_usd", "estimated_savings_usd")


def _counts(*names: str) -> dict:
    return {name: COUNTS[name]() for name in names}


def normalized_logs(logs: DataFrame) -> DataFrame:
    """Dashboard view of the log: text columns with a default instead of NULL, numbers as
    doubles with 0 instead of NULL."""
    texts = {
        "timestamp": "", "request_id": "", "task_id": "unknown_task",
        "client_id": "unknown_client", "cost_center": "unassigned",
        "selected_model": "unknown_model", "routing_decision": "unknown", "routing_reason": "",
        "status": "unknown", "error_code": "",
    }
    numbers = ["latency_ms", "input_tokens", "output_tokens", COST, TEACHER_COST, SAVINGS]
    return logs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(d)).alias(c) for c, d in texts.items()],
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers],
    )


def summary(logs: DataFrame) -> DataFrame:
    counts = _counts("teacher_requests", "student_requests", "errors")
    out = measure(logs, [], counts, [COST, TEACHER_COST, SAVINGS], p95_latency=True)
    return out.select("requests", *counts, usd(COST), usd(TEACHER_COST), usd(SAVINGS),
                      ms("avg_latency_ms"), ms("p95_latency_ms"))


def by_task(logs: DataFrame, limit: int | None = 20) -> DataFrame:
    out = measure(logs, ["task_id"], _counts("student_requests"), [COST, SAVINGS],
                  p95_latency=True)
    out = out.select("task_id", "requests", "student_requests", usd(COST), usd(SAVINGS),
                     ms("avg_latency_ms"), ms("p95_latency_ms"))
    return top(out, [SAVINGS, "requests"], ["task_id"], limit)


def by_model(logs: DataFrame) -> DataFrame:
    keys = ["selected_model", "routing_decision"]
    out = measure(logs, keys, {}, [COST, SAVINGS])
    out = out.select(*keys, "requests", usd(COST), usd(SAVINGS), ms("avg_latency_ms"))
    return top(out, ["requests"], keys, None)


def errors_by_code(logs: DataFrame, rows: str = "requests") -> DataFrame:
    """Grouped by the stored code: a missing code and the code 'none' stay two rows that are both
    shown as 'none'."""
    out = logs.filter(F.col("status") == "error").groupBy("error_code") \
        .agg(F.count(F.lit(1)).alias(rows))
    out = out.select(F.coalesce("error_code", F.lit("none")).alias("error_code"), rows)
    return top(out, [rows], ["error_code"], None)


def distillation_candidates(
    logs: DataFrame, min_requests: int = 20, limit: int | None = 20
) -> DataFrame:
    """Tasks by the savings still open: 70 % of the teacher cost where no student serves yet,
    25 % where one does."""
    counts = _counts("teacher_requests", "student_requests", "errors")
    out = measure(logs, ["task_id"], counts, [COST, TEACHER_COST]) \
        .filter(F.col("requests") >= min_requests)
    open_share = F.when(F.col("student_requests") == 0, F.lit(0.70).cast("double")) \
        .otherwise(F.lit(0.25).cast("double"))
    out = out.select(
        "task_id", "requests", "teacher_requests",
        round_half_up(F.col(TEACHER_COST), 8).alias("teacher_cost_usd"),
        round_half_up(F.col(TEACHER_COST) - F.col(COST), 8).alias("current_savings_usd"),
        ms("avg_latency_ms"), rate("errors", "requests", "error_rate"),
        round_half_up(F.col(TEACHER_COST) * open_share, 8)
        .alias("estimated_remaining_savings_usd"),
    )
    return top(out, ["estimated_remaining_savings_usd", "teacher_cost_usd"], ["task_id"], limit)


# --- dashboard: the same over the normalised view ----------------------------------------------

def dashboard_summary(logs: DataFrame) -> DataFrame:
    counts = _counts("teacher_requests", "student_requests", "fallback_requests", "errors")
    out = measure(normalized_logs(logs), [], counts, [COST, TEACHER_COST, SAVINGS],
                  p95_latency=True)
    return out.select("requests", *counts, usd(COST), usd(TEACHER_COST), usd(SAVINGS),
                      ms("avg_latency_ms"), ms("p95_latency_ms"),
                      rate("errors", "requests", "error_rate"))


def dashboard_by_task(logs: DataFrame, limit: int | None = 50) -> DataFrame:
    counts = _counts("teacher_requests", "student_requests", "fallback_requests", "errors")
    out = measure(normalized_logs(logs), ["task_id"], counts, [COST, TEACHER_COST, SAVINGS],
                  p95_latency=True)
    out = out.select("task_id", "requests", *counts, usd(COST), usd(TEACHER_COST), usd(SAVINGS),
                     ms("avg_latency_ms"), ms("p95_latency_ms"))
    return top(out, [TEACHER_COST, "requests"], ["task_id"], limit)


def by_client(logs: DataFrame, limit: int | None = 25) -> DataFrame:
    out = measure(normalized_logs(logs), ["client_id"], {}, [COST, TEACHER_COST, SAVINGS])
    out = out.select("client_id", "requests", usd(COST), usd(TEACHER_COST), usd(SAVINGS),
                     ms("avg_latency_ms"))
    return top(out, [COST, "requests"], ["client_id"], limit)


def by_cost_center(logs: DataFrame, limit: int | None = 25) -> DataFrame:
    out = measure(normalized_logs(logs), ["cost_center"], {}, [COST, SAVINGS], avg_latency=False)
    out = out.select("cost_center", "requests", usd(COST), usd(SAVINGS))
    return top(out, [COST, "requests"], ["cost_center"], limit)


def routing_mix(logs: DataFrame) -> DataFrame:
    out = measure(normalized_logs(logs), ["routing_decision"], {}, [COST], avg_latency=False)
    return top(out.select("routing_decision", "requests", usd(COST)), ["requests"],
               ["routing_decision"], None)


def daily_trend(logs: DataFrame, limit: int | None = 120, newest: bool = False) -> DataFrame:
    """Per day, oldest first. The cut keeps the oldest days unless `newest` is set."""
    dated = normalized_logs(logs).filter(F.length("timestamp") >= 10) \
        .withColumn("day", day_of(F.col("timestamp")))
    out = measure(dated, ["day"], {}, [COST, SAVINGS])
    out = out.select("day", "requests", usd(COST), usd(SAVINGS), ms("avg_latency_ms"))
    if limit is None:
        return out.orderBy("day")
    if newest:
        return out.orderBy(F.desc("day")).limit(limit).orderBy("day")
    return out.orderBy("day").limit(limit)


def task_log_summary(logs: DataFrame) -> DataFrame:
    """Per task: volume, errors, sums and the last time seen."""
    return logs.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).alias("errors"),
        F.sum(F.coalesce(F.col(TEACHER_COST), F.lit(0.0))).alias("teacher_cost_usd"),
        F.sum(F.coalesce(F.col(SAVINGS), F.lit(0.0))).alias(SAVINGS),
        F.max_by("timestamp", F.struct(parse_timestamp(F.col("timestamp")), "timestamp"))
        .alias("last_seen"),
    )


def traffic_counters(logs: DataFrame, shadow: DataFrame, feedback: DataFrame) -> DataFrame:
    """The gateway's ten counters, from the logged requests, probes and feedback."""
    reason = F.col("routing_reason")
    requests = logs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("routing_decision") == "teacher").alias("teacher"),
        F.count_if(F.col("routing_decision") == "student").alias("student"),
        F.count_if(reason == "student_connect_error_teacher_fallback").alias("fallback"),
        F.count_if(F.col("routing_decision") == "reject").alias("rejected"),
        F.count_if(reason.startswith("rate_limited")).alias("rate_limited"),
        F.count_if(F.col("error_code") == "proxy_error").alias("upstream_errors"),
    )
    probes = shadow.agg(
        F.count(F.lit(1)).alias("shadow"),
        F.count_if(F.col("error_code").isNotNull()).alias("shadow_errors"))
    notes = feedback.agg(F.count(F.lit(1)).alias("feedback"))

    def long_form(one_row: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value"))
                          for c in one_row.columns])
        return one_row.select(F.inline(pairs))

    return long_form(requests).unionByName(long_form(probes)).unionByName(long_form(notes))
