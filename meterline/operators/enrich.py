"""From raw gateway records to request-log rows: quota, route, tokens, price, hash, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline import schemas
from meterline.config import Gateway, Limits
from meterline.functions.cost import content_hash, cost_usd, estimate_tokens, savings_usd
from meterline.functions.text import blank_to_null, redact, redacted_body
from meterline.operators.ratelimit import apply_limits
from meterline.operators.routing import UNKNOWN_TASK, decide_routes


def _captured(body: Column, max_bytes: int | None, is_binary: bool) -> Column:
    if max_bytes is None:
        return body
    head = F.substring(body.cast("binary"), 1, max_bytes)
    return head if is_binary else F.make_valid_utf8(head.cast("string"))


def routed_requests(
    raw: DataFrame, routes: DataFrame, default_mode: str, gateway: Gateway,
    limits: Limits | None = None,
) -> DataFrame:
    """Raw records with the quota and route outcome. A request over its quota is never routed."""
    if limits is not None:
        raw = apply_limits(raw, limits)
    else:
        raw = raw.withColumn("limit_reason", F.lit(None).cast("string"))
    routed = decide_routes(raw, routes, default_mode, gateway)
    limited = F.col("limit_reason").isNotNull()
    return routed.withColumns({
        "routing_reason": F.coalesce(F.col("limit_reason"), F.col("routing_reason")),
        "routing_decision": F.when(limited, "reject").otherwise(F.col("routing_decision")),
        "selected_model": F.when(limited, "none").otherwise(F.col("selected_model")),
        "shadow_model": F.when(~limited, F.col("shadow_model")),
        "reject_status": F.when(limited, 429).otherwise(F.col("reject_status")),
        # A request refused by the router never got a task; one over quota keeps the task it named.
        "log_task_id": F.when(limited, F.coalesce("task_id", F.lit(UNKNOWN_TASK)))
        .when(F.col("reject_status").isNotNull(), F.lit(UNKNOWN_TASK))
        .otherwise(F.col("route_task_id")),
    })


def log_rows(routed: DataFrame, gateway: Gateway) -> DataFrame:
    """Request-log rows of routed records. One projection and one price lookup.

    A rejected request was answered before its body was read: no body, no tokens, no cost."""
    if gateway.log_mode == "disabled":
        routed = routed.filter(F.lit(False))
    spark = routed.sparkSession
    is_binary = isinstance(routed.schema["request_body"].dataType, T.BinaryType)
    rejected = F.col("reject_status").isNotNull()
    prices = gateway.students_df(spark).select(
        F.col("name").alias("selected_model"),
        F.col("input_cost_per_million_tokens_usd").alias("_in"),
        F.col("output_cost_per_million_tokens_usd").alias("_out"))
    teacher_in, teacher_out = (
        F.lit(float(gateway.teacher.input_price)), F.lit(float(gateway.teacher.output_price)))
    is_teacher = F.col("routing_decision") == "teacher"
    cap = gateway.max_capture_bytes
    mode = gateway.log_mode

    out = routed.join(prices, "selected_model", "left").withColumns({
        "_body": F.when(~rejected, _captured(F.col("request_body"), cap, is_binary)),
        "_answer": F.when(~rejected, _captured(F.col("response_body"), cap, is_binary)),
        "input_tokens": F.when(rejected, 0).otherwise(estimate_tokens(F.col("request_bytes"))),
        "output_tokens": F.when(rejected, 0).otherwise(estimate_tokens(F.col("response_bytes"))),
        "http_status": F.coalesce("reject_status", "http_status"),
    })
    cost = F.when(rejected, F.lit(0.0)).otherwise(cost_usd(
        F.col("input_tokens"), F.col("output_tokens"),
        F.when(is_teacher, teacher_in).otherwise(F.coalesce("_in", F.lit(0.0))),
        F.when(is_teacher, teacher_out).otherwise(F.coalesce("_out", F.lit(0.0)))))
    out = out.withColumns({
        "estimated_cost_usd": cost,
        "estimated_teacher_cost_usd": cost_usd(
            F.col("input_tokens"), F.col("output_tokens"), teacher_in, teacher_out),
        "error_code": F.when(F.col("proxy_error"), "proxy_error")
        .when(F.col("http_status") >= 400, F.col("routing_reason")),
        "teacher_model": F.lit(gateway.teacher.name),
        "input_hash": content_hash(F.col("_body"), F.col("request_summary"), mode),
        "prompt_redacted": redacted_body(F.col("_body"), mode, is_binary),
        "response_redacted": redacted_body(F.col("_answer"), mode, is_binary),
        "training_eligible": (F.col("http_status") < 400) & ~F.col("no_train")
        & ~F.col("pii_level").eqNullSafe("high")
        & F.lit(mode in ("redacted", "full_encrypted")),
        "task_id": F.col("log_task_id"),
    }).withColumns({
        "estimated_savings_usd": savings_usd(
            F.col("estimated_teacher_cost_usd"), F.col("estimated_cost_usd")),
        "status": F.when(F.col("error_code").isNull() & (F.col("http_status") < 400), "success")
        .otherwise("error"),
    })
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.REQUEST_LOG])


def enrich_requests(
    raw: DataFrame, routes: DataFrame, default_mode: str, gateway: Gateway,
    limits: Limits | None = None,
) -> DataFrame:
    return log_rows(routed_requests(raw, routes, default_mode, gateway, limits), gateway)


def shadow_probes(routed: DataFrame) -> DataFrame:
    """Requests that are also sent to the student: shadow route, no transport error, no 5xx."""
    status = F.coalesce("reject_status", "http_status")
    return routed.filter(
        F.col("shadow_model").isNotNull() & ~F.col("proxy_error") & (status < 500)
    ).select(
        "timestamp", "request_id", F.col("log_task_id").alias("task_id"),
        F.col("shadow_model").alias("student_model"),
        F.element_at(F.split("request_summary", " "), -1).alias("path"),
        F.col("response_body").alias("teacher_response_body"))


def clean_feedback(intake: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split feedback posts into log rows and posts that are not JSON.

    Only JSON strings count; they are trimmed, empty ones are dropped, free text is redacted.
    `client_id` and `task_id` come with the request, not from the body."""
    parsed = intake.withColumn("_json", F.try_parse_json(F.col(body)))

    def text(field: str) -> Column:
        path = f"$.{field}"
        kind = F.schema_of_variant(F.try_variant_get("_json", path, "variant"))
        return blank_to_null(F.when(kind == "STRING", F.try_variant_get("_json", path, "string")))

    good = parsed.filter(F.col("_json").isNotNull()).select(
        "timestamp", text("request_id").alias("request_id"),
        blank_to_null(F.col("client_id")).alias("client_id"),
        blank_to_null(F.col("task_id")).alias("task_id"), text("rating").alias("rating"),
        redact(text("correct_output")).alias("correct_output_redacted"),
        redact(text("comment")).alias("comment_redacted"))
    bad = parsed.filter(F.col("_json").isNull()).drop("_json")
    return good, bad
