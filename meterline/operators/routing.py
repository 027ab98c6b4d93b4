"""Route decisions as a column chain over two small lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.config import Gateway, Snapshot
from meterline.functions.cost import hash_bucket
from meterline.functions.text import blank_to_null

UNKNOWN_TASK = "unknown_task"


def extract_metadata(requests: DataFrame, headers: str = "headers") -> DataFrame:
    """Request metadata from a map of lower-case header names."""
    def header(name: str) -> Column:
        return blank_to_null(F.try_element_at(F.col(headers), F.lit(name)))

    return requests.withColumns({
        "request_id": F.coalesce(header("x-request-id"), F.uuid()),
        "client_id": header("x-client-id"),
        "task_id": header("x-task-id"),
        "cost_center": header("x-cost-center"),
        "quality_mode": header("x-quality-mode"),
        "pii_level": header("x-pii-level"),
        "no_train": F.coalesce(F.lower(header("x-no-train")) == "true", F.lit(False)),
    }).drop(headers)


def _capped(percentage: Column, default: int) -> Column:
    return F.least(F.coalesce(percentage, F.lit(default)), F.lit(100))


def decide_routes(
    requests: DataFrame, routes: DataFrame, default_mode: str, gateway: Gateway
) -> DataFrame:
    """Add route_task_id, routing_decision, routing_reason, selected_model, shadow_model and
    reject_status.

    The route table and the price list carry no broadcast hint: both have a size Spark knows, so
    it broadcasts them below its own threshold and otherwise shuffles, with AQE splitting a task
    that dominates the traffic."""
    spark = requests.sparkSession
    task = F.when(F.length(blank_to_null(F.col("task_id"))) > 0, F.col("task_id"))
    named = requests.withColumn("route_task_id", F.coalesce(task, F.lit(UNKNOWN_TASK))) \
        .withColumn("_task_missing", task.isNull()) \
        .withColumn("_bucket", hash_bucket(F.col("request_id"), "route:"))
    table = routes.select(
        F.col("task_id").alias("route_task_id"), F.col("mode").alias("_mode"),
        F.col("student_model").alias("_student"),
        _capped(F.col("student_traffic_percentage"), 0).alias("_canary_pct"),
        _capped(F.col("teacher_probe_percentage"), 2).alias("_probe_pct"),
    )
    students = gateway.students_df(spark).select(
        F.col("name").alias("_student"), F.lit(True).alias("_served"))
    joined = named.join(table, "route_task_id", "left").join(students, "_student", "left")

    mode = F.coalesce(F.col("_mode"), F.lit(default_mode))
    bucket = F.col("_bucket")
    has_student = F.col("_student").isNotNull()
    served = F.coalesce(F.col("_served"), F.lit(False))
    # Without a route the percentages take their defaults as well.
    canary_hit = bucket < F.coalesce(F.col("_canary_pct"), F.lit(0))
    probe_hit = bucket < F.coalesce(F.col("_probe_pct"), F.lit(2))

    wants_student = F.when(mode == "student_only", "student_only") \
        .when((mode == "canary") & canary_hit, "canary_student") \
        .when((mode == "bandit") & ~probe_hit, "bandit_student")
    student_reason = F.when(~has_student, "student_unavailable_teacher_fallback") \
        .when(~served, "student_backend_missing_teacher_fallback") \
        .when(F.col("student_connect_error"), "student_connect_error_teacher_fallback") \
        .otherwise(wants_student)
    teacher_reason = (
        F.when(mode == "teacher_only",
               F.when(F.col("_mode").isNotNull(), "teacher_only").otherwise("default_teacher_only"))
        .when(mode == "shadow",
              F.when(has_student, "shadow_teacher")
              .otherwise("shadow_student_unavailable_teacher_fallback"))
        .when(mode == "canary", "canary_teacher")
        .when(mode == "bandit", "bandit_teacher_probe")
    )
    reject = F.when(F.col("client_id").isNull(), "missing_client_id")
    if gateway.missing_task == "reject":
        reject = reject.when(F.col("_task_missing"), "missing_task_id")
    strict = F.col("quality_mode").eqNullSafe("strict")
    to_student = ~strict & wants_student.isNotNull() & has_student & served \
        & ~F.coalesce(F.col("student_connect_error"), F.lit(False))

    return (
        joined.withColumn("_reject", reject).withColumn("_to_student", to_student)
        .withColumn("routing_reason", F.coalesce(
            F.col("_reject"),
            F.when(strict, "quality_mode_strict"),
            F.when(wants_student.isNotNull(), student_reason),
            teacher_reason))
        .withColumn("routing_decision", F.when(F.col("_reject").isNotNull(), "reject")
                    .when(F.col("_to_student"), "student").otherwise("teacher"))
        .withColumn("reject_status", F.when(F.col("_reject").isNotNull(), 400))
        .withColumn("selected_model", F.when(F.col("_reject").isNotNull(), "none")
                    .when(F.col("_to_student"), F.col("_student")).otherwise(F.lit(gateway.teacher.name)))
        .withColumn("shadow_model", F.when(
            F.col("_reject").isNull() & ~strict & (mode == "shadow") & served, F.col("_student")))
        .drop("_reject", "_task_missing", "_mode", "_student", "_canary_pct", "_probe_pct",
              "_served", "_bucket", "_to_student")
    )


def decide_with_snapshot(requests: DataFrame, snapshot: Snapshot, gateway: Gateway) -> DataFrame:
    routes = snapshot.routes_df(requests.sparkSession)
    return decide_routes(requests, routes, snapshot.default_mode, gateway)
