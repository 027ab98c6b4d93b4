"""Streaming operators: enrichment, counters, limits, probe pairing, drift, intake, dedupe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.config import STUDENT_MODES, DriftThresholds, Gateway
from meterline.functions.text import parse_timestamp
from meterline.operators.drift import active_routes, add_reasons, is_negative
from meterline.operators.enrich import clean_feedback, enrich_requests


def enrich_stream(
    raw: DataFrame, routes: DataFrame, default_mode: str, gateway: Gateway
) -> DataFrame:
    """Stateless enrichment of a stream of gateway records."""
    return enrich_requests(raw, routes, default_mode, gateway)


def enrich_with_reload(
    read_routes: Callable[[], tuple[int, str, DataFrame]], gateway: Gateway,
    write: Callable[[DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body that takes up the newest route table at every batch and keeps the
    previous one while the newest cannot be read."""
    current: dict[str, tuple[int, str, DataFrame]] = {}

    def batch_body(batch: DataFrame, number: int) -> None:
        try:
            current["routes"] = read_routes()
        except Exception:
            if "routes" not in current:
                raise
        _, default_mode, routes = current["routes"]
        write(enrich_requests(batch, routes, default_mode, gateway), number)

    return batch_body


def running_counters(logs: DataFrame) -> DataFrame:
    """Traffic counters over a stream of log rows, one row per counter."""
    reason = F.col("routing_reason")
    named = {
        "total": F.lit(True),
        "teacher": F.col("routing_decision") == "teacher",
        "student": F.col("routing_decision") == "student",
        "fallback": reason == "student_connect_error_teacher_fallback",
        "rejected": F.col("routing_decision") == "reject",
        "rate_limited": reason.startswith("rate_limited"),
        "upstream_errors": F.col("error_code") == "proxy_error",
    }
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in named.items()]))
    return logs.select(F.explode(hits).alias("counter")).groupBy("counter") \
        .agg(F.count(F.lit(1)).alias("value"))


def watermarked(rows: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Rows with a time, under a watermark; rows with `heartbeat` set only move it.

    They are dropped by an explode of nothing. A random value in it keeps the optimizer from pushing
    later filters, and those that joins imply, below the watermark, where they would take the
    heartbeats away before it sees them."""
    marked = rows.withWatermark(ts, lateness)
    if "heartbeat" not in rows.columns:
        return marked.where(F.col(ts).isNotNull())
    live = F.col(ts).isNotNull() & ~F.coalesce("heartbeat", F.lit(False))
    return marked.withColumn("_live", F.explode(F.when(live, F.array(F.rand())))) \
        .drop("_live", "heartbeat")


def pair_probe_streams(
    probes: DataFrame, answers: DataFrame, lateness: str = "10 minutes",
    answer_within: str = "5 minutes",
) -> DataFrame:
    """Probes with the student's answers. Both have a `ts`; an answer must come within the given time
    after its request. A probe without one comes out with empty answer columns once the watermark has
    passed that time, which is also when the join drops its state. Either side may carry heartbeats."""
    left = watermarked(probes, "ts", lateness)
    right = watermarked(answers.withColumnsRenamed({"ts": "answer_ts", "request_id": "answer_id"}),
                        "answer_ts", lateness)
    in_time = F.expr(
        f"answer_ts >= ts AND answer_ts <= ts + INTERVAL {answer_within}")
    return left.join(right, (F.col("request_id") == F.col("answer_id")) & in_time, "leftOuter") \
        .drop("answer_id", "answer_ts")


def sliding_drift(
    logs: DataFrame, routes: DataFrame, thresholds: DriftThresholds,
    window: str = "24 hours", slide: str = "1 hour", lateness: str = "1 hour",
) -> DataFrame:
    """Student figures per task and sliding window, with the reasons to roll back.

    The latency percentile is the approximate one here: its state is a bounded sketch per window,
    where the exact one would keep every latency."""
    students = routes.filter(F.col("mode").isin(*STUDENT_MODES)).select(
        "task_id", F.col("mode").alias("route_mode"), "student_model")
    failed = (F.col("status") == "error") | (F.coalesce("http_status", F.lit(0)) >= 400)
    served = logs.filter(F.col("routing_decision") == "student") \
        .withColumn("ts", parse_timestamp(F.col("timestamp"))).withWatermark("ts", lateness) \
        .join(students, "task_id")
    stats = served.groupBy(
        F.window("ts", window, slide), "task_id", "route_mode", "student_model").agg(
        F.count(F.lit(1)).alias("student_requests"),
        F.count_if(failed).alias("student_errors"),
        F.percentile_approx("latency_ms", 0.95, 1000).alias("student_p95_latency_ms"))
    zero = F.lit(0).cast("long")
    rows = stats.withColumns({"feedback_total": zero, "feedback_negative": zero})
    return add_reasons(rows, thresholds, keep=["window"]).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "task_id", "student_requests", "student_errors", "student_error_rate",
        "student_p95_latency_ms", "rollback_reasons")


LATENCY_BITS = 6


def latency_mark(ms: Column) -> Column:
    """The middle of the log-linear bucket of a latency: exact below 64, above it within 1/64 of the
    value. Buckets of 6 leading bits merge by adding counts, and there are 32 per power of two."""
    shift = F.greatest(F.length(F.bin(ms)) - LATENCY_BITS, F.lit(0))
    low = F.call_function("shiftright", ms, shift)
    middle = F.call_function("shiftleft", low, shift) \
        + F.call_function("shiftleft", F.lit(1).cast("long"), shift) / F.lit(2)
    return F.when(shift > 0, middle.cast("long")).otherwise(ms)


def rolling_drift(
    logs: DataFrame, feedback: DataFrame, routes: DataFrame, thresholds: DriftThresholds,
    window: str = "24 hours", slide: str = "1 hour", lateness: str = "1 hour",
    noted_within: str = "7 days",
) -> DataFrame:
    """Figures of the student routes per sliding window, with feedback and the latency percentile,
    and the reasons to roll back; a window comes out once, when the watermark has passed its end.

    Feedback on a request that came at most `noted_within` before it counts for the request's task if a
    student answered; feedback on an unknown one for the task it names. All rows are first counted
    per hour, task and latency bucket, then the hours are rolled up, so the state of a window is a
    task's buckets, and a row is counted once, not once per window. The percentile is that of the
    buckets: no rank is lost, each value is within 1/64. Request ids are taken to be unique."""
    students = routes.filter(F.col("mode").isin(*STUDENT_MODES)).select(
        "task_id", F.col("mode").alias("route_mode"), "student_model")
    timed = lambda rows, name: rows.withColumn(name, parse_timestamp(F.col("timestamp")))
    log = watermarked(timed(logs, "ts"), "ts", lateness)
    failed = (F.col("status") == "error") | (F.coalesce("http_status", F.lit(0)) >= 400)
    zero, one = (F.lit(x).cast("long") for x in (0, 1))
    served = log.filter(F.col("routing_decision") == "student").select(
        "ts", "task_id", latency_mark(F.col("latency_ms")).alias("ms"), one.alias("requests"),
        failed.cast("long").alias("errors"), zero.alias("notes"), zero.alias("negative"))
    asked = log.join(active_routes(routes).select("task_id"), "task_id").select(
        F.col("ts").alias("asked_ts"), F.col("request_id").alias("asked_id"),
        F.col("task_id").alias("asked_task"), F.col("routing_decision").alias("answered_by"))
    notes = watermarked(timed(feedback.drop("ts"), "note_ts"), "note_ts", lateness).select(
        "note_ts", *[c for c in ("request_id", "task_id", "rating")])
    known = notes.join(asked, (F.col("request_id") == F.col("asked_id")) & F.expr(
        f"asked_ts <= note_ts AND asked_ts >= note_ts - INTERVAL {noted_within}"), "leftOuter")
    task = F.when(F.col("asked_id").isNull(), F.col("task_id")).when(
        F.col("answered_by") == "student", F.col("asked_task"))
    noted = known.select(
        F.col("note_ts").alias("ts"), task.alias("task_id"), F.lit(None).cast("long").alias("ms"),
        zero.alias("requests"), zero.alias("errors"), one.alias("notes"),
        is_negative(F.col("rating")).cast("long").alias("negative"))
    sums = lambda: [F.sum(c).alias(c) for c in ("requests", "errors", "notes", "negative")]
    rows = served.unionByName(noted).join(students.select("task_id"), "task_id")
    hourly = rows.groupBy(F.window("ts", slide).alias("hour"), "task_id", "ms").agg(*sums())
    rolled = hourly.withColumn("at", F.window_time("hour")).groupBy(
        F.window("at", window, slide).alias("window"), "task_id").agg(
        *sums(), F.percentile("ms", 0.95, F.col("requests")).alias("p95"))
    figures = rolled.join(students, "task_id").select(
        "window", "task_id", "route_mode", "student_model",
        F.col("requests").alias("student_requests"), F.col("errors").alias("student_errors"),
        F.bround("p95", 0).cast("long").alias("student_p95_latency_ms"),
        F.col("notes").alias("feedback_total"), F.col("negative").alias("feedback_negative"))
    return add_reasons(figures, thresholds, keep=["window"]).select(
        F.col("window.start").alias("window_start"), "task_id", "student_requests",
        "student_errors", "student_error_rate", "student_p95_latency_ms", "feedback_total",
        "feedback_negative", "negative_feedback_rate", "rollback_reasons")


def newest_copies(logs: DataFrame, gap: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    """The newest log row of each run of copies: rows of one task and input less than `gap` apart.

    A run comes out once, when the watermark has passed its newest copy by `gap`; a later copy starts
    another run. Runs are merged in event time, so the answer does not depend on which trigger a row
    came with, as long as it is not later than `lateness`. The state is a row per open run. `copies`
    counts the run, `first_seen` is its first time. `logs` may carry heartbeats."""
    columns = [c for c in logs.columns if c != "heartbeat"]
    rows = watermarked(logs.withColumn("_ts", parse_timestamp(F.col("timestamp"))), "_ts", lateness)
    newest = F.max_by(F.struct(*columns), F.struct("_ts", "timestamp", "request_id"))
    runs = rows.groupBy(
        F.session_window("_ts", gap).alias("run"), F.col("task_id").alias("_task"),
        F.coalesce("input_hash", "request_id").alias("_input"),
    ).agg(newest.alias("newest"), F.count(F.lit(1)).alias("copies"))
    return runs.select("newest.*", "copies", F.col("run.start").alias("first_seen"))


def feedback_stream(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log rows and rejected posts of a stream of feedback; each is written by a query of its
    own."""
    return clean_feedback(posts)


def drop_repeats(logs: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """First log row of each input within the watermark (the batch dataset keeps the newest)."""
    return logs.withColumn("ts", parse_timestamp(F.col("timestamp"))) \
        .withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["input_hash"])
