"""Shadow probes: pairing of teacher and student answers, divergence reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.text import redacted_body
from meterline.operators.aggregate import measure, ms, rate, top
from meterline.operators.finops import errors_by_code


def shadow_log(pairs: DataFrame, log_mode: str = "redacted") -> DataFrame:
    """Log rows of probes. `pairs` holds the teacher's answer next to the student's, with the
    student's HTTP status (NULL: the probe got no answer)."""
    if log_mode == "disabled":
        pairs = pairs.filter(F.lit(False))
    status = F.col("student_http_status")
    failed = status.isNull()
    code = F.when(failed, "shadow_request_failed").when(status >= 400, "shadow_http_status")
    student_body = F.when(~failed, F.col("student_response_body"))
    out = pairs.select(
        "timestamp", "request_id", "task_id", "student_model", "path",
        F.col("student_latency_ms").alias("latency_ms"),
        status.cast("int").alias("http_status"),
        F.when(code.isNull(), "success").otherwise("error").alias("status"),
        code.alias("error_code"),
        redacted_body(F.col("teacher_response_body"), log_mode)
        .alias("teacher_response_redacted"),
        redacted_body(student_body, log_mode).alias("student_response_redacted"),
    )
    return out.withColumn(
        "response_exact_match",
        F.col("teacher_response_redacted") == F.col("student_response_redacted"))


def pair_probes(probes: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests sent to a probe with the student's answer to them, where one came. Both sides hold
    one row per request id, so the join key has no heavy value."""
    return probes.join(answers, "request_id", "left")


def _measured(shadow: DataFrame, keys: list[str]) -> DataFrame:
    counts = {
        "errors": F.col("status") == "error",
        "divergences": F.col("response_exact_match") == F.lit(False),
    }
    out = measure(shadow, keys, counts, rows="probes", p95_latency=True)
    return out.select(
        *keys, "probes", "errors", rate("errors", "probes", "error_rate"), "divergences",
        rate("divergences", "probes", "divergence_rate"), ms("avg_latency_ms"),
        ms("p95_latency_ms"))


def shadow_summary(shadow: DataFrame) -> DataFrame:
    return _measured(shadow, [])


def shadow_by_task(shadow: DataFrame) -> DataFrame:
    keys = ["task_id", "student_model"]
    return top(_measured(shadow, keys), ["divergence_rate", "probes"], keys, None)


def shadow_errors(shadow: DataFrame) -> DataFrame:
    return errors_by_code(shadow, rows="probes")
