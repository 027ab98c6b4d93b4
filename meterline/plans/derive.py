"""Log tables derived row by row from the given tables, at any scale.

The given tables hold events, documents, conversations and vectors but no gateway logs, so each
log table here is a projection of one of them. `oracle.py` states the same projections in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.config import Backend, DriftThresholds, Gateway, Limits, Route, Snapshot
from meterline.functions.cost import hash_bucket
from meterline.operators.enrich import enrich_requests, log_rows, routed_requests, shadow_probes
from meterline.operators.evaluate import classification_metrics
from meterline.operators.shadow import pair_probes, shadow_log

GATEWAY = Gateway(
    teacher=Backend("teacher", 5.0, 15.0),
    students=(Backend("local_student", 0.05, 0.05),),
)
SNAPSHOT = Snapshot(version=1, default_mode="teacher_only", tasks={
    "task_0": Route("teacher_only"),
    "task_1": Route("canary", "local_student", student_traffic_percentage=25),
    "task_2": Route("student_only", "local_student"),
    "task_3": Route("bandit", "local_student", teacher_probe_percentage=10),
    "task_4": Route("shadow", "local_student"),
})
LIMITS = Limits(window_ms=86_400_000, default_per_window=12, clients={"client_3": 30},
                tasks={"task_2": 40})
DRIFT_AS_OF, DRIFT_HOURS = "2024-01-31T00:00:00Z", 30 * 24
DRIFT = DriftThresholds(max_error_rate=0.21, max_negative_feedback_rate=0.306)
RETENTION_AS_OF = "2024-04-15T00:00:00Z"
CREATED_AT = "2024-02-01T00:00:00Z"
SUMMARY = "POST /v1/chat/completions"
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), STAMP)


def _label(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def raw_of_events(events: DataFrame) -> DataFrame:
    """Gateway records of event rows (batch or stream)."""
    k, user = F.col("k"), F.col("user_id")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        stamp(F.col("ts")).alias("timestamp"), F.col("ts").cast("timestamp").alias("ts"),
        _label("req_", F.col("event_id")).alias("request_id"),
        F.when(k != 99, _label("client_", user % 20)).alias("client_id"),
        F.when(k != 98, _label("task_", user % 6)).alias("task_id"),
        F.when(user % 4 != 3, _label("cc_", user % 4)).alias("cost_center"),
        F.when(k % 10 == 0, "strict").otherwise("balanced").alias("quality_mode"),
        F.when(k % 13 == 0, "high").otherwise("low").alias("pii_level"),
        (k % 11 == 0).alias("no_train"), F.lit(SUMMARY).alias("request_summary"),
        F.col("props").alias("request_body"), F.col("event_type").alias("response_body"),
        (200 + 37 * k).cast("long").alias("request_bytes"),
        (40 + 11 * k).cast("long").alias("response_bytes"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http_status"),
        ((F.col("event_type") == "error") & (k % 4 == 0)).alias("proxy_error"),
        (k % 17 == 5).alias("student_connect_error"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"), k.alias("k"))


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_of_events(table(spark, sf_dir, "events"))


def routed(spark: SparkSession, sf_dir: str, limits: Limits | None = None) -> DataFrame:
    return routed_requests(raw_requests(spark, sf_dir), SNAPSHOT.routes_df(spark),
                           SNAPSHOT.default_mode, GATEWAY, limits)


def request_log(spark: SparkSession, sf_dir: str, limits: Limits | None = None) -> DataFrame:
    return log_rows(routed(spark, sf_dir, limits), GATEWAY)


def student_answers(events: DataFrame, with_time: bool = False) -> DataFrame:
    """What the student answered to a probe (no answer, a refusal, another or the same text), and
    when."""
    k = F.get_json_object("props", "$.k").cast("int")
    answered = F.timestamp_micros(
        F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 3) * 1000)
    return events.select(
        *([answered.alias("ts")] if with_time else []),
        _label("req_", F.col("event_id")).alias("request_id"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 5 == 0, 503).otherwise(200)
        .alias("student_http_status"),
        F.when(k % 7 == 0, F.concat(F.col("event_type"), F.lit("?")))
        .otherwise(F.col("event_type")).alias("student_response_body"),
        F.floor(F.col("value") * 3).cast("long").alias("student_latency_ms"))


def shadow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = shadow_probes(routed(spark, sf_dir))
    answers = student_answers(table(spark, sf_dir, "events"))
    return shadow_log(pair_probes(probes, answers))


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_of(raw_requests(spark, sf_dir))


def feedback_of(raw: DataFrame) -> DataFrame:
    """One feedback row per request; those of k = 14 name a request that was never logged."""
    return raw.select(
        "timestamp",
        F.when(F.col("k") == 14, F.concat(F.lit("lost_"), "request_id"))
        .otherwise(F.col("request_id")).alias("request_id"),
        "client_id", "task_id",
        F.when(F.col("http_status") == 500, " Bad ").when(F.col("k") % 9 == 0, "0")
        .otherwise("good").alias("rating"),
        F.lit(None).cast("string").alias("correct_output_redacted"),
        F.lit(None).cast("string").alias("comment_redacted"))


def feedback_posts(events: DataFrame) -> DataFrame:
    """Feedback posts as they arrive: JSON bodies with blanks, numbers and secrets in them, some
    cut off."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.concat(
        F.lit('{"request_id":" req_'), F.col("event_id").cast("string"),
        F.when(k % 9 == 0, F.lit(' ","rating":0')).otherwise(F.lit(' ","rating":" bad "')),
        F.when(k % 7 == 0, F.lit(',"comment":"write to user@example.com"')).otherwise(
            F.lit(',"comment":"  "')),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.lit("}")))
    return events.select(
        stamp(F.col("ts")).alias("timestamp"),
        _label("client_", F.col("user_id") % 20).alias("client_id"),
        F.when(k != 98, _label("task_", F.col("user_id") % 6)).alias("task_id"),
        body.alias("body"))


def _chat(role: str, content: str) -> Column:
    return F.to_json(F.struct(F.array(
        F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))).alias("messages")))


def completion(content: Column) -> Column:
    return F.to_json(F.struct(F.array(
        F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gateway records that carry the documents as chat requests, answered with their language."""
    doc = F.col("doc_id")
    minute = F.make_timestamp(*[F.lit(x) for x in (2024, 1, 1, 0, 0, 0)], timezone=F.lit("UTC"))
    return table(spark, sf_dir, "documents").select(
        stamp(minute + F.make_dt_interval(mins=doc.cast("int"))).alias("timestamp"),
        _label("doc_", doc).alias("request_id"), F.col("source").alias("client_id"),
        F.lit("lang_id").alias("task_id"), F.col("source").alias("cost_center"),
        F.lit("balanced").alias("quality_mode"), F.lit("low").alias("pii_level"),
        (doc % 11 == 0).alias("no_train"), F.lit(SUMMARY).alias("request_summary"),
        _chat("user", "text").alias("request_body"),
        completion(F.col("lang")).alias("response_body"),
        F.octet_length("text").cast("long").alias("request_bytes"),
        F.octet_length("lang").cast("long").alias("response_bytes"),
        F.lit(200).alias("http_status"), F.lit(False).alias("proxy_error"),
        F.lit(False).alias("student_connect_error"),
        (F.col("n_chars") % 400 + 5).alias("latency_ms"))


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_requests(traces(spark, sf_dir), SNAPSHOT.routes_df(spark),
                           SNAPSHOT.default_mode, GATEWAY)


def turn_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat bodies of each turn with the turn before it, from an equi-join on (conv_id, turn)."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"),
                          F.struct("role", F.col("text").alias("content")).alias("before"))
    now = F.struct("role", F.col("text").alias("content"))
    messages = F.array_compact(F.array("before", now))
    return turns.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.to_json(F.struct(messages.alias("messages"))).alias("body"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        _label("doc_", F.col("doc_id")).alias("request_id"), F.col("doc_id").alias("position"),
        "text", F.col("lang").alias("expected_intent"), "source", "n_chars")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with an answer that is right, wrong or empty depending on the text length."""
    n = F.col("n_chars")
    answer = F.when(n % 10 == 0, "").when(n % 5 == 1, "en").otherwise(
        F.concat(F.lit(" "), "expected_intent", F.lit(" ")))
    return labelled_documents(spark, sf_dir).select(
        "request_id", "position", "text", "expected_intent", "source",
        F.when(n % 13 == 0, 500).otherwise(200).alias("http_status"),
        F.when(n % 13 == 0, "error").otherwise("success").alias("status"),
        (n % 400 + 5).alias("latency_ms"), completion(answer).alias("response_body"),
        F.trim(answer).alias("answer"))


def source_number() -> Column:
    return F.substring("source", 4, 10).cast("int")


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per document source, scored on that source's calls."""
    scores = classification_metrics(calls(spark, sf_dir), "expected_intent", "answer", ["source"])
    n = source_number()
    status = F.element_at(F.array(*[F.lit(s) for s in (
        "offline_eval", "shadow", "canary", "retired")]), n % 4 + 1)
    return scores.select(
        F.concat(F.lit("student_"), "source").alias("model_id"),
        _label("task_", n).alias("task_id"), status.alias("status"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), n), "yyyy-MM-dd")
        .alias("created_at"), "accuracy", "macro_f1")


def dataset_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset manifest per document source and language."""
    n = source_number()
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("samples")).select(
        F.concat_ws("_", F.lit("ds"), "source", "lang").alias("dataset_id"),
        _label("task_", n).alias("task_id"),
        F.concat(F.date_format(F.date_add(
            F.lit("2022-10-01").cast("date"), (n * 30 + F.length("lang")).cast("int")),
            "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("created_at"), "samples")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an extraction task: the expected JSON, and an answer with other values, without
    fields, cut off, or missing, by the text length. `size_guess` is a number to be compared."""
    n = F.col("n_chars")

    def document(lang: Column, chars: Column, tags: Column, source: Column) -> Column:
        return F.concat(F.lit('{"lang":"'), lang, F.lit('","meta":{'), source, F.lit('"chars":'),
                        chars.cast("string"), F.lit('},"tags":'), tags, F.lit("}"))

    tags = F.concat(F.lit('["'), F.col("lang"), F.lit('","'), F.col("source"), F.lit('"]'))
    source = F.concat(F.lit('"source":"'), F.col("source"), F.lit('",'))
    answer = document(F.when(n % 5 == 0, "xx").otherwise(F.col("lang")),
                      F.when(n % 6 == 0, n + 1).otherwise(n), F.when(n % 4 == 0, "[]").otherwise(tags),
                      F.when(n % 9 == 0, "").otherwise(source))
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "n_chars", document(F.col("lang"), n, tags, source).alias("expected"),
        F.when(n % 29 == 0, F.lit(None)).when(n % 11 == 0, F.substring(answer, 1, 20))
        .otherwise(answer).alias("answer"),
        F.when(n % 19 != 0, n + n % 17 - 8).alias("size_guess"))


def confident_calls(log: DataFrame) -> DataFrame:
    """Requests a student served, with a confidence from 0 to 0.99 that is higher where it is right."""
    one, two = (hash_bucket(F.col("request_id"), salt) for salt in ("sure:", "unsure:"))
    right = F.col("status") == "success"
    return log.filter(F.col("routing_decision") == "student").select(
        "task_id", "selected_model", right.alias("right"),
        (F.when(right, F.greatest(one, two)).otherwise(F.least(one, two)) / 100).alias("confidence"))


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests of clients and, some of them, of conversations."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        _label("doc_", doc).alias("request_id"), _label("c", F.floor(doc / 3)).alias("client_id"),
        F.when(doc % 5 == 0, _label("v", F.floor(doc / 7))).alias("conversation_id"),
        F.col("text").alias("input"))


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests of a task per language."""
    return table(spark, sf_dir, "documents").select(
        _label("doc_", F.col("doc_id")).alias("request_id"), F.col("lang").alias("task_id"),
        F.sha2("text", 256).alias("input_hash"), F.col("text").alias("prompt_redacted"))


def sided_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts of six tasks: in half of them the later ones are of other languages, in the
    others the sides are drawn at random."""
    doc = F.col("doc_id")
    request = _label("doc_", doc)
    later = F.when(doc % 6 < 3, F.col("lang").isin("de", "fr")).otherwise(hash_bucket(request, "side:") < 40)
    return table(spark, sf_dir, "documents").select(
        request.alias("request_id"), _label("task_", doc % 6).alias("task_id"), "text", later.alias("later"))


def next_version(dataset: DataFrame) -> DataFrame:
    """The dataset as a later run finds it: rows gone, relabelled, and new."""
    bucket = lambda salt: hash_bucket(F.col("request_id"), salt)
    kept = dataset.filter(bucket("gone:") >= 3).withColumn("validated_output", F.when(
        bucket("relabelled:") < 4, F.lit("other")).otherwise(F.col("validated_output")))
    added = dataset.filter(bucket("new:") < 2).withColumn("request_id", F.concat("request_id", F.lit("|new")))
    return kept.unionByName(added)


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines as a file may hold them: some cut off, without a time, blank, or no object."""
    line = F.to_json(F.struct("timestamp", "request_id", "task_id"))
    k = F.col("k")
    return raw_requests(spark, sf_dir).select(
        F.substring("timestamp", 1, 10).alias("day"),
        F.when(k % 31 == 3, F.substring(line, 1, 25)).when(k % 37 == 5, "  ").when(k % 41 == 7, "17")
        .when(k % 23 == 9, F.to_json(F.struct("request_id", "task_id"))).otherwise(line).alias("value"))
