"""Drift guard: error, latency and feedback figures of the student routes, and the rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.config import ACTIVE_MODES, STUDENT_MODES, DriftThresholds
from meterline.functions.cost import ratio
from meterline.functions.text import parse_timestamp, strip
from meterline.operators.governance import replace_routes
from meterline.operators.ranking import latest_per_key

# Ratings that count as negative.
NEGATIVE_RATINGS = ("bad", "incorrect", "wrong", "negative", "thumbs_down", "0", "1")


def active_routes(routes: DataFrame, task_id: str | None = None) -> DataFrame:
    active = routes.filter(F.col("mode").isin(*ACTIVE_MODES))
    return active if task_id is None else active.filter(F.col("task_id") == task_id)


def in_window(df: DataFrame, as_of: str, window_hours: int) -> DataFrame:
    """Rows of the last hours before `as_of`; rows without a readable time are left out."""
    since = F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(window_hours))
    return df.withColumn("ts", parse_timestamp(F.col("timestamp"))).filter(F.col("ts") >= since)


def is_negative(rating: Column) -> Column:
    return F.coalesce(F.lower(strip(rating)).isin(*NEGATIVE_RATINGS), F.lit(False))


def student_stats(logs: DataFrame, student_routes: DataFrame) -> DataFrame:
    """Per task: student requests, errors and exact p95 latency, from (task, latency) counts."""
    served = logs.filter(F.col("routing_decision") == "student") \
        .join(student_routes.select("task_id"), "task_id", "left_semi")
    failed = (F.col("status") == "error") \
        | (F.coalesce(F.col("http_status").try_cast("int"), F.lit(0)) >= 400)
    by_latency = served.groupBy("task_id", F.col("latency_ms").try_cast("long").alias("ms")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"))
    return by_latency.groupBy("task_id").agg(
        F.sum("n").alias("student_requests"), F.sum("bad").alias("student_errors"),
        F.bround(F.percentile("ms", 0.95, F.col("n")), 0).cast("long")
        .alias("student_p95_latency_ms"))


def attribute_feedback(
    feedback: DataFrame, logs: DataFrame, active: DataFrame
) -> DataFrame:
    """Feedback counted per task it belongs to.

    Feedback on a logged request counts for that request's task, and only if a student answered;
    feedback on an unknown request counts for the task it names. Feedback is summed per (request,
    named task) before the join, so a request id that half of all feedback shares (or its absence)
    reaches the join as a handful of rows."""
    pre = feedback.groupBy("request_id", F.col("task_id").alias("named_task")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_negative(F.col("rating"))).alias("bad"))
    # Only requests that got feedback are needed; few ids reach the log as a broadcast.
    asked = pre.select("request_id").filter("request_id is not null").distinct()
    known = logs.join(asked, "request_id", "left_semi").join(active.select("task_id"), "task_id", "left_semi") \
        .filter(F.length("request_id") > 0) \
        .select("request_id", "ts", F.col("task_id").alias("log_task"), "routing_decision")
    latest = latest_per_key(
        known, [F.col("request_id")],
        [F.desc("ts"), F.desc("log_task"), F.desc("routing_decision")])
    joined = pre.join(latest, "request_id", "left")
    found = F.col("routing_decision").isNotNull()
    task = F.when(found & (F.col("routing_decision") == "student"), F.col("log_task")) \
        .when(~found, F.col("named_task"))
    return joined.select(task.alias("task_id"), "n", "bad").filter("task_id is not null") \
        .groupBy("task_id").agg(F.sum("n").alias("feedback_total"),
                                F.sum("bad").alias("feedback_negative"))


def drift_report(
    logs: DataFrame, feedback: DataFrame, routes: DataFrame, as_of: str,
    window_hours: int = 24, thresholds: DriftThresholds = DriftThresholds(),
    task_id: str | None = None,
) -> DataFrame:
    """One row per active route with its figures and the reasons to roll it back."""
    active = active_routes(routes, task_id)
    students = active.filter(F.col("mode").isin(*STUDENT_MODES))
    recent = in_window(logs, as_of, window_hours)
    stats = student_stats(recent, students)
    notes = attribute_feedback(in_window(feedback, as_of, window_hours), recent, active) \
        .join(students.select("task_id"), "task_id", "left_semi")
    zero = F.lit(0).cast("long")
    report = active.join(stats, "task_id", "left").join(notes, "task_id", "left").select(
        "task_id", F.col("mode").alias("route_mode"), "student_model",
        F.coalesce("student_requests", zero).alias("student_requests"),
        F.coalesce("student_errors", zero).alias("student_errors"),
        "student_p95_latency_ms",
        F.coalesce("feedback_total", zero).alias("feedback_total"),
        F.coalesce("feedback_negative", zero).alias("feedback_negative"),
    )
    return add_reasons(report, thresholds)


def add_reasons(report: DataFrame, t: DriftThresholds, keep: list[str] = ()) -> DataFrame:
    """Rates and rollback reasons of figures per route. Shadow routes are never judged."""
    errors = ratio(F.col("student_errors"), F.col("student_requests"), None)
    negative = ratio(F.col("feedback_negative"), F.col("feedback_total"), None)
    p95 = F.col("student_p95_latency_ms")
    enough = F.col("student_requests") >= t.min_requests

    def reason(name: str, value: Column, limit: float) -> Column:
        return F.format_string(f"{name} %.4f > {limit:.4f}", F.bround(value, 4))

    max_error, max_negative = F.lit(float(t.max_error_rate)), \
        F.lit(float(t.max_negative_feedback_rate))
    checks = [F.when(enough & (errors > max_error),
                     reason("student_error_rate", errors, t.max_error_rate))]
    if t.max_p95_latency_ms > 0:
        checks.append(F.when(
            enough & (p95 > t.max_p95_latency_ms),
            F.format_string(f"student_p95_latency_ms %d > {t.max_p95_latency_ms}", p95)))
    checks.append(F.when(
        (F.col("feedback_total") >= t.min_feedback) & (negative > max_negative),
        reason("negative_feedback_rate", negative, t.max_negative_feedback_rate)))
    reasons = F.array_compact(F.array(*checks))
    none = F.array().cast("array<string>")
    return report.select(
        *keep, "task_id", "route_mode", "student_model", "student_requests", "student_errors",
        ratio(F.col("student_errors"), F.col("student_requests")).alias("student_error_rate"),
        "student_p95_latency_ms", "feedback_total", "feedback_negative",
        ratio(F.col("feedback_negative"), F.col("feedback_total"))
        .alias("negative_feedback_rate"),
        F.when(F.col("route_mode") == "shadow", none).otherwise(reasons)
        .alias("rollback_reasons"),
    )


def rollback_routes(routes: DataFrame, report: DataFrame, version: int) -> DataFrame:
    """Route table after the rollback: breaching tasks go back to the teacher alone."""
    breaching = report.filter(F.size("rollback_reasons") > 0).select(
        "task_id", F.lit("teacher_only").alias("mode"),
        F.lit(None).cast("string").alias("student_model"),
        F.lit(None).cast("int").alias("student_traffic_percentage"),
        F.lit(None).cast("int").alias("teacher_probe_percentage"))
    return replace_routes(routes, breaching, version)


def rollback_event(report: DataFrame, timestamp: str, version: int, hours: int) -> DataFrame:
    """Registry events of a rollback, one per task."""
    return report.filter(F.size("rollback_reasons") > 0).select(
        F.lit(timestamp).alias("timestamp"), F.lit("drift_guard_rollback").alias("event"),
        "task_id", F.lit("teacher_only").alias("mode"),
        F.lit(version).cast("long").alias("snapshot_version"),
        F.to_json(F.struct(F.lit(hours).alias("window_hours"), F.struct(*report.columns)
                           .alias("task"))).alias("payload"))
