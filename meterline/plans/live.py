"""Registered streaming queries: each drains the event files through a stream and returns what the
sink holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.lineage import work_folder
from meterline.operators.enrich import routed_requests, shadow_probes
from meterline.operators.shadow import shadow_log
from meterline.plans import derive
from meterline.streaming import jobs
from meterline.streaming.limiter import limiter
from meterline.streaming.runs import drain, heartbeats, read_files


def _events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/{{events}}.parquet"
    return read_files(spark, path, spark.read.parquet(path).schema)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    raw = derive.raw_of_events(_events(spark, sf))
    return jobs.enrich_stream(raw, derive.SNAPSHOT.routes_df(spark),
                              derive.SNAPSHOT.default_mode, derive.GATEWAY)


def stream_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return drain(_log(spark, sf), "enrichment")


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    return drain(jobs.running_counters(_log(spark, sf)), "counters", "complete")


def stream_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Every window, without the approximate percentile."""
    report = jobs.sliding_drift(_log(spark, sf), derive.SNAPSHOT.routes_df(spark), derive.DRIFT)
    return drain(report, "drift", "complete").select(
        F.date_format("window_start", derive.STAMP).alias("window_start"), "task_id",
        "student_requests", "student_errors", "student_error_rate",
        F.array_join("rollback_reasons", "; ").alias("rollback_reasons"))


def stream_shadow_join(spark: SparkSession, sf: str) -> DataFrame:
    """Probes the student does not answer send nothing: they fail when the time for it is over."""
    beats, closing = heartbeats(spark)
    events = _events(spark, sf)
    routed = routed_requests(derive.raw_of_events(events), derive.SNAPSHOT.routes_df(spark),
                             derive.SNAPSHOT.default_mode, derive.GATEWAY)
    probes = shadow_probes(routed).withColumn("ts", F.to_timestamp("timestamp"))
    answers = derive.student_answers(_events(spark, sf), with_time=True) \
        .filter("student_http_status is not null")
    pairs = jobs.pair_probe_streams(probes.unionByName(beats, allowMissingColumns=True),
                                    answers.unionByName(beats.drop("timestamp"), allowMissingColumns=True))
    return drain(shadow_log(pairs), "shadow", closing=closing)


def stream_rolling_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Every window, in append mode, with feedback and the latency percentile."""
    beats, closing = heartbeats(spark)
    logs = _log(spark, sf).unionByName(beats.drop("ts"), allowMissingColumns=True)
    feedback = derive.feedback_of(derive.raw_of_events(_events(spark, sf))) \
        .unionByName(beats.drop("ts"), allowMissingColumns=True)
    report = jobs.rolling_drift(logs, feedback, derive.SNAPSHOT.routes_df(spark), derive.DRIFT)
    return drain(report, "rolling-drift", closing=closing).withColumns({
        "window_start": F.date_format("window_start", derive.STAMP),
        "rollback_reasons": F.array_join("rollback_reasons", "; ")})


def stream_newest_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The newest request of each run of copies of an input."""
    beats, closing = heartbeats(spark)
    logs = _log(spark, sf).unionByName(beats.drop("ts"), allowMissingColumns=True)
    return drain(jobs.newest_copies(logs), "newest", closing=closing).select(
        "request_id", "task_id", "input_hash", "timestamp", "copies",
        F.date_format("first_seen", derive.STAMP).alias("first_seen"))


def stream_feedback(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = jobs.feedback_stream(derive.feedback_posts(_events(spark, sf)))
    return drain(good, "feedback")


def stream_feedback_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = jobs.feedback_stream(derive.feedback_posts(_events(spark, sf)))
    return drain(bad.select("timestamp", "body"), "rejects")


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return drain(jobs.drop_repeats(_log(spark, sf)).select("input_hash"), "dedupe")


def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of the request-anchored limiter per request."""
    root = work_folder(spark, "limits")
    raw = derive.raw_of_events(_events(spark, sf)) \
        .select("ts", "request_id", "client_id", "task_id")
    body = limiter(derive.LIMITS, f"{root}/counters", f"{root}/decided")
    raw.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True) \
        .foreachBatch(body).start().awaitTermination()
    decided = spark.read.option("basePath", f"{root}/decided").parquet(f"{root}/decided/batch=*")
    return decided.select(
        "request_id", F.coalesce("limit_reason", F.lit("allowed")).alias("outcome"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_enrichment": stream_enrichment,
        "stream_counters": stream_counters,
        "stream_drift": stream_drift,
        "stream_shadow_join": stream_shadow_join,
        "stream_rolling_drift": stream_rolling_drift,
        "stream_newest_copies": stream_newest_copies,
        "stream_feedback": stream_feedback,
        "stream_feedback_rejects": stream_feedback_rejects,
        "stream_dedupe": stream_dedupe,
        "stream_rate_limit": stream_rate_limit,
    }
