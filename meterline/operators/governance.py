"""Promotion gate, route changes, catalogue lookups and per-task status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators.ranking import latest_per_key

PROMOTABLE = ("offline_eval", "shadow", "canary", "production")
ROUTE_COLUMNS = ["task_id", "mode", "student_model", "student_traffic_percentage",
                 "teacher_probe_percentage"]


def promotion_gate(
    models: DataFrame, min_accuracy: Column | float = 0.0, min_macro_f1: Column | float = 0.0
) -> DataFrame:
    """Add `promotable` and `gate_reason` to the registry. Thresholds are numbers or columns of a
    joined threshold table. Missing metrics count as 0."""
    min_accuracy = min_accuracy if isinstance(min_accuracy, Column) else F.lit(float(min_accuracy))
    min_macro_f1 = min_macro_f1 if isinstance(min_macro_f1, Column) else F.lit(float(min_macro_f1))
    accuracy = F.coalesce(F.col("accuracy").cast("double"), F.lit(0.0))
    macro_f1 = F.coalesce(F.col("macro_f1").cast("double"), F.lit(0.0))
    status = F.col("status")
    quoted = F.coalesce(F.concat(F.lit("'"), status, F.lit("'")), F.lit("None"))
    promotable_status = F.coalesce(status.isin(*PROMOTABLE), F.lit(False))
    reason = (
        F.when(~promotable_status,
               F.concat(F.lit("model status "), quoted, F.lit(" is not promotable")))
        .when(accuracy < min_accuracy, F.concat(
            F.lit("model accuracy "), accuracy.cast("string"), F.lit(" is below threshold "),
            min_accuracy.cast("string")))
        .when(macro_f1 < min_macro_f1, F.concat(
            F.lit("model macro_f1 "), macro_f1.cast("string"), F.lit(" is below threshold "),
            min_macro_f1.cast("string")))
    )
    return models.withColumn("gate_reason", reason) \
        .withColumn("promotable", F.col("gate_reason").isNull())


def promotion_routes(
    models: DataFrame, mode: str, canary_percentage: int = 0, probe_percentage: int = 2
) -> DataFrame:
    """New routes for models that passed the gate: of each task the most accurate, then by macro-F1,
    age and id."""
    for name, value in (("canary", canary_percentage), ("bandit", probe_percentage)):
        if mode == name and not 0 <= value <= 100:
            raise ValueError("percentages must be between 0 and 100")
    canary = F.lit(canary_percentage if mode == "canary" else None).cast("int")
    probe = F.lit(probe_percentage if mode == "bandit" else None).cast("int")
    student = F.lit(None).cast("string") if mode == "teacher_only" else F.col("model_id")
    best = latest_per_key(models.filter("promotable"), [F.col("task_id")], [
        *[F.desc(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("accuracy", "macro_f1")],
        *[F.desc(c) for c in ("created_at", "model_id") if c in models.columns]])
    return best.select(
        "task_id", F.lit(mode).alias("mode"), student.alias("student_model"),
        canary.alias("student_traffic_percentage"), probe.alias("teacher_probe_percentage"))


def replace_routes(routes: DataFrame, changed: DataFrame, version: int) -> DataFrame:
    """Route table in which the changed tasks have their new route as a whole."""
    kept = routes.select(*ROUTE_COLUMNS).join(changed.select("task_id"), "task_id", "left_anti")
    return kept.unionByName(changed.select(*ROUTE_COLUMNS)) \
        .withColumn("snapshot_version", F.lit(version).cast("long"))


def routing_event(changed: DataFrame, timestamp: str, version: int) -> DataFrame:
    return changed.select(
        F.lit(timestamp).alias("timestamp"), F.lit("routing_updated").alias("event"), "task_id",
        "mode", F.lit(version).cast("long").alias("snapshot_version"),
        F.to_json(F.struct(*ROUTE_COLUMNS)).alias("payload"))


def latest_per_task(manifests: DataFrame, id_column: str) -> DataFrame:
    """Newest entry per task. `max_by` combines before the shuffle."""
    order = F.struct("created_at", id_column)
    return manifests.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("entries"), F.max_by(id_column, order).alias(f"latest_{id_column}"))


def task_status(
    routes: DataFrame, default_mode: str, datasets: DataFrame, models: DataFrame,
    log_summary: DataFrame,
) -> DataFrame:
    """Route, dataset, model and log figures of every task that appears anywhere. All four sides
    hold one row per task."""
    data = latest_per_task(datasets, "dataset_id").withColumnRenamed("entries", "datasets")
    registry = latest_per_task(models, "model_id").withColumnRenamed("entries", "models")
    sides = [routes.select(*ROUTE_COLUMNS), data, registry, log_summary]
    joined = sides[0]
    for side in sides[1:]:
        joined = joined.join(side, "task_id", "full")
    zero = F.lit(0).cast("long")
    return joined.select(
        "task_id", F.coalesce("mode", F.lit(default_mode)).alias("mode"), "student_model",
        F.coalesce("datasets", zero).alias("datasets"), "latest_dataset_id",
        F.coalesce("models", zero).alias("models"), "latest_model_id",
        F.coalesce("requests", zero).alias("requests"), F.coalesce("errors", zero).alias("errors"),
        F.coalesce("teacher_cost_usd", F.lit(0.0)).alias("teacher_cost_usd"),
        F.coalesce("estimated_savings_usd", F.lit(0.0)).alias("estimated_savings_usd"),
        "last_seen")


def find_model(models: DataFrame, model_id: str) -> DataFrame:
    return models.filter(F.col("model_id") == model_id)


def datasets_of(manifests: DataFrame, task_id: str) -> DataFrame:
    return manifests.filter(F.col("task_id") == task_id)
