"""The registered queries: each reads the given tables whole and returns one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline import schemas
from meterline.functions import labels as lab
from meterline.functions import text as tx
from meterline.functions.cost import content_hash, hash_bucket, round_half_up
from meterline.lineage import stored, work_folder
from meterline.operators import (
    answers, confidence, dataset, drift, evaluate, finops, governance, groups, insights, knn, labelling, prompts,
    ratelimit, repeats, retention, sampling, shadow, students, synthetic, versions)
from meterline.plans import derive, live
from meterline.plans.derive import table
from meterline.sources import logs, tables

Query = Callable[[SparkSession, str], DataFrame]

TASK_DESCRIPTION = "Name the language of the text."
CODES = ("de", "en", "es", "fr")
INTENT_LABELS = (
    "the-nation", "reed", "con los otros", "pour les autres", "und der ein", "threat to others",
    "personal loan")
SAMPLE_LIMIT = 150
BUDGET = 1_000_000
TRAINING_COST = 0.25
DRIFT_SPLIT = "2024-01-15"
GATE_ACCURACY, GATE_MACRO_F1 = 0.74, 0.55
MAX_ERROR, CONFIDENCE_BINS = 0.1, 100


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: round_half_up(F.col(c), digits) for c in columns})


def _log(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: report(derive.request_log(spark, sf))


def _shadow(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: report(derive.shadow_rows(spark, sf))


def _documents(*columns: Callable[[], object]) -> Query:
    return lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", *[c() for c in columns])


# --- enrichment ------------------------------------------------------------------------------

def log_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return derive.request_log(spark, sf, derive.LIMITS)


def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    log = derive.request_log(spark, sf).select(
        "request_id", "input_tokens", "output_tokens",
        F.col("estimated_cost_usd").alias("cost_usd"),
        F.col("estimated_teacher_cost_usd").alias("teacher_cost_usd"),
        F.col("estimated_savings_usd").alias("savings_usd"))
    return _rounded(log, 10, "cost_usd", "teacher_cost_usd", "savings_usd")


def route_decision(spark: SparkSession, sf: str) -> DataFrame:
    return derive.routed(spark, sf).select(
        "request_id", F.col("log_task_id").alias("task_id"), "routing_decision",
        "routing_reason", "selected_model")


def percentage_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return derive.raw_requests(spark, sf).select(
        "request_id", hash_bucket(F.col("request_id"), "route:").alias("bucket"))


def rate_limit_aligned(spark: SparkSession, sf: str) -> DataFrame:
    checked = ratelimit.apply_limits(derive.raw_requests(spark, sf), derive.LIMITS)
    return checked.select(
        "request_id", F.coalesce("limit_reason", F.lit("allowed")).alias("outcome"))


# --- reports ---------------------------------------------------------------------------------

def task_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = finops.task_log_summary(derive.request_log(spark, sf))
    return _rounded(out, 8, "teacher_cost_usd", "estimated_savings_usd")


def task_status(spark: SparkSession, sf: str) -> DataFrame:
    out = governance.task_status(
        derive.SNAPSHOT.routes_df(spark), derive.SNAPSHOT.default_mode,
        derive.dataset_catalogue(spark, sf), derive.model_registry(spark, sf),
        finops.task_log_summary(derive.request_log(spark, sf)))
    out = out.drop("student_traffic_percentage", "teacher_probe_percentage")
    return _rounded(out, 8, "teacher_cost_usd", "estimated_savings_usd")


def traffic_counters(spark: SparkSession, sf: str) -> DataFrame:
    routed = derive.routed(spark, sf, derive.LIMITS)
    answers = derive.student_answers(table(spark, sf, "events"))
    probes = shadow.shadow_log(shadow.pair_probes(derive.shadow_probes(routed), answers))
    return finops.traffic_counters(
        derive.log_rows(routed, derive.GATEWAY), probes, derive.feedback_rows(spark, sf))


# --- drift and governance --------------------------------------------------------------------

def _drift(spark: SparkSession, sf: str) -> DataFrame:
    return drift.drift_report(
        derive.request_log(spark, sf), derive.feedback_rows(spark, sf),
        derive.SNAPSHOT.routes_df(spark), derive.DRIFT_AS_OF, derive.DRIFT_HOURS, derive.DRIFT)


def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).withColumn(
        "rollback_reasons", F.array_join("rollback_reasons", "; "))


def rollback_routes(spark: SparkSession, sf: str) -> DataFrame:
    return drift.rollback_routes(
        derive.SNAPSHOT.routes_df(spark), _drift(spark, sf), derive.SNAPSHOT.version + 1)


def feedback_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return drift.attribute_feedback(
        drift.in_window(derive.feedback_rows(spark, sf), derive.DRIFT_AS_OF, derive.DRIFT_HOURS),
        drift.in_window(derive.request_log(spark, sf), derive.DRIFT_AS_OF, derive.DRIFT_HOURS),
        drift.active_routes(derive.SNAPSHOT.routes_df(spark)))


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    return governance.promotion_gate(
        derive.model_registry(spark, sf), GATE_ACCURACY, GATE_MACRO_F1)


def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The reason without its numbers, which the two engines print differently."""
    reason = F.regexp_replace("gate_reason", r"(accuracy|macro_f1) \S+ (is below threshold).*",
                              "$1 $2")
    out = _gated(spark, sf).select("model_id", "task_id", "status", "accuracy", "macro_f1",
                                   "promotable", reason.alias("gate_reason"))
    return _rounded(out, 10, "accuracy", "macro_f1")


def promoted_routes(spark: SparkSession, sf: str) -> DataFrame:
    changed = governance.promotion_routes(_gated(spark, sf), "canary", canary_percentage=25)
    return governance.replace_routes(
        derive.SNAPSHOT.routes_df(spark), changed, derive.SNAPSHOT.version + 1)


def model_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return governance.latest_per_task(derive.model_registry(spark, sf), "model_id")


def retention_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines as they are stored, by task."""
    lines = derive.raw_requests(spark, sf).select(
        "task_id", F.to_json(F.struct("timestamp", "request_id", "task_id")).alias("value"))
    return retention.retention_report(
        retention.classify_lines(lines, derive.RETENTION_AS_OF, 90), ["task_id"])


def retention_datasets(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = derive.dataset_catalogue(spark, sf)
    return retention.dataset_retention(catalogue, derive.RETENTION_AS_OF) \
        .select("dataset_id", "task_id", "created_at", "expired")


# --- datasets --------------------------------------------------------------------------------

def _dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset of the log as the gateway leaves it: stored, so that its filters read single
    columns instead of redacting every text a second time to see whether it is NULL."""
    return dataset.build_dataset(stored(derive.trace_log(spark, sf), "log"))


def _stored_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset as the later steps find it: written once, read by column."""
    return stored(_dataset(spark, sf), "dataset")


def dataset_split(spark: SparkSession, sf: str) -> DataFrame:
    return _dataset(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("samples"))


def dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(dataset.dataset_manifest(_dataset(spark, sf)), 8, "teacher_cost_usd",
                    "estimated_savings_usd")


def openai_target(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", tx.completion_target(derive.completion(F.col("text"))).alias("target"))


def user_content(spark: SparkSession, sf: str) -> DataFrame:
    return derive.turn_bodies(spark, sf).select(
        "conv_id", "turn", tx.user_content(F.col("body")).alias("content"))


def synthetic_rows(spark: SparkSession, sf: str) -> DataFrame:
    return synthetic.synthetic_rows(_stored_dataset(spark, sf), derive.CREATED_AT)


def synthetic_manifest(spark: SparkSession, sf: str) -> DataFrame:
    augmented = synthetic.augment(_stored_dataset(spark, sf), derive.CREATED_AT)
    return _rounded(synthetic.synthetic_manifest(augmented), 10, "synthetic_ratio")


def sft_prompt(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stored_dataset(spark, sf)
    return dataset.sft_rows(rows, None, TASK_DESCRIPTION, "prompt").drop("task_id")


def sft_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stored_dataset(spark, sf)
    return dataset.sft_rows(rows, None, TASK_DESCRIPTION, "messages").select(
        "request_id", "split", F.to_json(F.struct("messages")).alias("record"))


# --- labels and samples ----------------------------------------------------------------------

def label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    codes = labelling.vocabulary(table(spark, sf, "documents"), "lang")
    return docs.select("doc_id", lab.normalize_label(F.col("text"), codes).alias("label"))


def label_normalize_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return labelling.normalize_by_join(
        docs, "doc_id", "text", labelling.distinct_labels(docs, "lang")).select("doc_id", "label")


def slug_labels(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    names = F.array(*[F.concat_ws(sep, "p_brand", "p_type") for sep in (" & ", " and ")])
    return labelling.unique_slugs(part.select(F.explode(names).alias("product")))


def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive.labelled_documents(spark, sf).select(
        "request_id", "position", "expected_intent")
    return sampling.balanced_sample(rows, "expected_intent", "position", SAMPLE_LIMIT)


def skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive.labelled_documents(spark, sf).select("request_id", "expected_intent")
    return labelling.skip_existing(rows, derive.calls(spark, sf))


def allowed_labels(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("label"))
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return labelling.allowed_rows(docs, "source", allowed)


def evaluate_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.evaluate_calls(derive.calls(spark, sf)), 10, "accuracy")


def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.classification_metrics(derive.calls(spark, sf), "expected_intent", "answer")
    return _rounded(out, 10, "accuracy", "macro_f1")


def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return evaluate.token_budget(docs, labelling.distinct_labels(docs, "lang"), BUDGET)


def majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stored_dataset(spark, sf).select(
        "request_id", "split", F.col("validated_output").alias("label"))
    train, evaluation = dataset.training_and_eval_rows(rows)
    return evaluate.majority_baseline(train, evaluation, "label").drop("split")


def knn_labels(spark: SparkSession, sf: str) -> DataFrame:
    vectors = derive.vectors(spark, sf)
    queries = vectors.select(F.col("vec_id").alias("query_id"),
                             F.col("embedding").alias("query_vector"))
    refs = vectors.select(F.col("vec_id").alias("ref_id"),
                          F.col("embedding").alias("ref_vector"),
                          F.col("label").alias("ref_label"))
    near = knn.nearest_references(queries, refs, 6).filter("query_id <> ref_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return _rounded(knn.vote(near.withColumn("rank", rank).filter("rank <= 5")), 8, "confidence")


# --- decisions -------------------------------------------------------------------------------

def savings_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = insights.savings_trend(derive.request_log(spark, sf), TRAINING_COST)
    return _rounded(out, 6, "savings_usd", "cumulative_savings_usd", "unrecovered_usd", "roi")


def training_triggers(spark: SparkSession, sf: str) -> DataFrame:
    out = insights.training_triggers(derive.request_log(spark, sf)).drop("errors")
    return _rounded(out, 6, "teacher_cost_usd", "error_rate")


def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    return insights.label_scores(insights.confusion(
        derive.calls(spark, sf), "expected_intent", "answer"))


def group_split(spark: SparkSession, sf: str) -> DataFrame:
    split = insights.group_split(F.col("client_id"), F.col("request_id"))
    return derive.request_log(spark, sf).groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("client_id").alias("clients"))


def label_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return insights.without_conflicts(docs, F.col("text"), "source").select("doc_id", "source")


def distribution_drift(spark: SparkSession, sf: str) -> DataFrame:
    return insights.distribution_drift(
        derive.request_log(spark, sf), ["task_id"], "selected_model", F.col("timestamp") >= DRIFT_SPLIT)


def route_policy(spark: SparkSession, sf: str) -> DataFrame:
    log = derive.request_log(spark, sf)
    models = log.select("selected_model").distinct().selectExpr(
        "selected_model", "900.0D as max_p95_ms", "0.2D as max_error_rate", "5L as min_requests")
    return insights.route_policy(log, models)


def dated_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log as dated Parquet, written and read back by day."""
    path = work_folder(spark, "dated-log")
    logs.append_columnar(derive.request_log(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.count_distinct("request_id").alias("ids"))


VERSIONED = ["input", "validated_output", "split"]


def dataset_version(spark: SparkSession, sf: str) -> DataFrame:
    return versions.dataset_version(_dataset(spark, sf), ["request_id", *VERSIONED])


def dataset_changes(spark: SparkSession, sf: str) -> DataFrame:
    old = _stored_dataset(spark, sf)
    return versions.version_changes(old, derive.next_version(old), ["request_id"], VERSIONED)


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return answers.field_accuracy(derive.json_answers(spark, sf), ["doc_id"], "expected", "answer")


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    return answers.json_report(derive.json_answers(spark, sf), ["doc_id", "lang"], "expected", "answer", ["lang"])


def regression_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = answers.regression_scores(derive.json_answers(spark, sf), "n_chars", "size_guess", ["lang"])
    return _rounded(out, 6, "mae", "rmse", "r2")


def confidence_limits(spark: SparkSession, sf: str) -> DataFrame:
    calls = derive.confident_calls(derive.request_log(spark, sf))
    return confidence.confidence_limits(calls, ["task_id", "selected_model"], "confidence", F.col("right"),
                                        MAX_ERROR, CONFIDENCE_BINS)


def confident_routes(spark: SparkSession, sf: str) -> DataFrame:
    return confidence.confident_routes(route_policy(spark, sf), confidence_limits(spark, sf))


def leak_free_split(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.col(c) for c in ("client_id", "conversation_id", "input")]
    return groups.leak_free_split(derive.linked_documents(spark, sf), "request_id", keys).select(
        "request_id", "component", "split")


def prompt_drift(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.prompt_drift(derive.sided_prompts(spark, sf), ["task_id"], "request_id", "text", F.col("later"))


def label_drift(spark: SparkSession, sf: str) -> DataFrame:
    return insights.distribution_drift(
        derive.request_log(spark, sf), ["task_id"], "response_redacted", F.col("timestamp") >= DRIFT_SPLIT)


def near_repetitive_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.near_repetitive_tasks(derive.document_log(spark, sf))


def label_balance(spark: SparkSession, sf: str) -> DataFrame:
    return insights.label_balance(derive.request_log(spark, sf), ["task_id"], "response_redacted", 0.2)


def sampled_requests(spark: SparkSession, sf: str) -> DataFrame:
    log = derive.request_log(spark, sf)
    quotas = insights.sampling_quotas(log, derive.shadow_rows(spark, sf), 0.1, 3, 40, 0.15)
    return insights.sampled_requests(log, quotas)


def sampling_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return insights.sampling_quotas(
        derive.request_log(spark, sf), derive.shadow_rows(spark, sf), 0.1, 3, 40, 0.15)


# --- files -----------------------------------------------------------------------------------

def log_files(spark: SparkSession, sf: str) -> DataFrame:
    """The log appended as JSON lines in two runs, the second without some columns, and read again
    through a glob."""
    root = work_folder(spark, "json-log")
    log = derive.request_log(spark, sf)
    early = F.col("timestamp") < DRIFT_SPLIT
    logs.append_log(log.filter(early), root)
    logs.append_log(log.filter(~early).drop("cost_center", "input_hash"), root)
    back = logs.read_request_log(spark, f"{root}/date=2024-*")
    return back.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count("cost_center").alias("with_center"),
        F.count("input_hash").alias("hashed"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("latency_ms").alias("latency_ms"))


def log_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Stored log lines, some of them broken, read tolerantly: what is read and what is set aside."""
    root = work_folder(spark, "lines")
    derive.stored_lines(spark, sf).select("value").write.text(root)
    good, bad = logs.read_tolerant(spark, root, schemas.REQUEST_LOG)
    return good.groupBy(F.lit("read").alias("fate"), F.col("task_id")).agg(F.count(F.lit(1)).alias("lines")) \
        .unionByName(bad.groupBy(F.lit("set aside").alias("fate"), F.lit(None).cast("string").alias("task_id"))
                     .agg(F.count(F.lit(1)).alias("lines")))


def retention_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Retention of stored lines per day, with broken, undated and blank ones."""
    return retention.retention_report(
        retention.classify_lines(derive.stored_lines(spark, sf), derive.RETENTION_AS_OF, 90), ["day"])


def dataset_files(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset written by task and split, and read again: rows per split, and how many come before
    the row above them in the same file."""
    root = work_folder(spark, "dataset-files")
    tables.write_dataset(_dataset(spark, sf), root)
    back = tables.read_dataset(spark, root).withColumn("place", F.col("_metadata.row_index")) \
        .withColumn("file", F.col("_metadata.file_path"))
    above = F.lag("timestamp").over(Window.partitionBy("file", F.floor(F.col("place") / 65536)).orderBy("place"))
    return back.withColumn("above", above).groupBy("split").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("request_id").alias("ids"),
        F.count_if(F.col("above") > F.col("timestamp")).alias("unsorted"))


def sft_files(spark: SparkSession, sf: str) -> DataFrame:
    """Fine-tuning records written by task and split, and read again."""
    root = work_folder(spark, "sft")
    records = dataset.sft_rows(_stored_dataset(spark, sf), list(CODES), TASK_DESCRIPTION, "prompt")
    tables.write_sft(records, root, by_task=True)
    back = spark.read.schema("prompt string, completion string, task_id string, split string").json(root)
    return back.groupBy("task_id", "split", "completion").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.char_length("prompt")).alias("chars"))


def _csv(rows: DataFrame, purpose: str) -> str:
    path = work_folder(rows.sparkSession, purpose)
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path)
    return path


def labelled_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled texts from CSV files: trimmed, numbered, labels from the rows."""
    docs = table(spark, sf, "documents")
    path = _csv(docs.select(F.concat(F.lit("  "), "text").alias("text"), F.when(
        F.col("doc_id") % 10 != 0, F.col("lang")).alias("category")), "labelled-csv")
    rows = tables.read_text_categories(spark, path, "train", "doc")
    return rows.groupBy("expected_intent").agg(
        F.count(F.lit(1)).alias("texts"), F.count_distinct("request_id").alias("ids"),
        F.sum(F.char_length("text")).alias("chars"))


def complaint_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Complaints from CSV files: allowed products, labels from their names, a balanced training
    sample, and an evaluation sample of the rest."""
    docs = table(spark, sf, "documents")
    path = _csv(docs.select(
        F.col("doc_id").alias("Complaint ID"), F.concat(F.lit("The "), "source").alias("Product"),
        F.col("lang").alias("Issue"), F.lit("").alias("Sub-product"), F.lit("2024-01-01").alias("Date received"),
        F.lit("Closed").alias("Company response to consumer"), F.col("text").alias("Consumer complaint narrative"),
    ), "complaints-csv")
    allowed = table(spark, sf, "nation").select(
        F.concat(F.lit("the_src"), F.col("n_nationkey").cast("string")).alias("label"))
    rows = labelling.prepare_complaints(tables.read_complaints(spark, path, min_chars=400), allowed) \
        .withColumn("position", F.col("complaint_id").cast("long"))
    train, evaluation = sampling.sample_train_and_eval(stored(rows.select(
        "request_id", "expected_intent", "position", "text"), "complaints"), "expected_intent", "position", 100, 40)
    return train.unionByName(evaluation).select(
        "request_id", "expected_intent", "split", F.char_length("text").cast("long").alias("chars"))


# --- students --------------------------------------------------------------------------------

def _text_student(spec: students.StudentSpec) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _stored_dataset(spark, sf).select(
            "split", tx.user_content(F.col("input")).alias("text"),
            F.col("validated_output").alias("label"))
        train, evaluation = dataset.training_and_eval_rows(rows)
        return students.student_report(train, evaluation, spec)
    return run


def _vector_student(spec: students.StudentSpec) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        key = F.concat(F.lit("vec_"), F.col("vec_id").cast("string"))
        rows = derive.vectors(spark, sf).select(
            dataset.split_of(key, key).alias("split"), "embedding", "label")
        train, evaluation = dataset.training_and_eval_rows(rows)
        return students.student_report(train, evaluation, spec)
    return run


def student_hybrid_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the vector of the same number, scored on their quality label."""
    docs = table(spark, sf, "documents").join(
        derive.vectors(spark, sf).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    rows = docs.join(table(spark, sf, "labels"), "doc_id").select(
        dataset.split_of(key, key).alias("split"), "text", "embedding",
        F.col("quality").cast("string").alias("label"))
    train, evaluation = dataset.training_and_eval_rows(rows)
    return students.student_report(train, evaluation,
                                   students.StudentSpec("hybrid_logistic"))


def queries() -> dict[str, Query]:
    return {
        "log_enrichment": log_enrichment,
        "redact_documents": _documents(lambda: tx.redact(F.col("text")).alias("redacted")),
        "content_hash": _documents(lambda: content_hash(
            F.col("text"), F.lit(derive.SUMMARY), "redacted").alias("input_hash")),
        "token_cost": token_cost,
        "route_decision": route_decision,
        "percentage_bucket": percentage_bucket,
        "rate_limit_aligned": rate_limit_aligned,
        "finops_summary": _log(finops.summary),
        "finops_by_task": _log(finops.by_task),
        "finops_by_model": _log(finops.by_model),
        "finops_errors": _log(finops.errors_by_code),
        "distillation_candidates": _log(finops.distillation_candidates),
        "dash_candidates": _log(lambda log: finops.distillation_candidates(
            finops.normalized_logs(log), limit=25)),
        "dash_summary": _log(finops.dashboard_summary),
        "dash_by_task": _log(finops.dashboard_by_task),
        "dash_by_client": _log(finops.by_client),
        "dash_by_cost_center": _log(finops.by_cost_center),
        "routing_mix": _log(finops.routing_mix),
        "daily_trend": _log(finops.daily_trend),
        "shadow_log": derive.shadow_rows,
        "shadow_summary": _shadow(shadow.shadow_summary),
        "shadow_by_task": _shadow(shadow.shadow_by_task),
        "shadow_errors": _shadow(shadow.shadow_errors),
        "task_log_summary": task_log_summary,
        "task_status": task_status,
        "traffic_counters": traffic_counters,
        "drift_report": drift_report,
        "rollback_routes": rollback_routes,
        "feedback_attribution": feedback_attribution,
        "promotion_gate": promotion_gate,
        "promoted_routes": promoted_routes,
        "model_catalogue": model_catalogue,
        "retention_logs": retention_logs,
        "retention_datasets": retention_datasets,
        "dataset_eligible": _dataset,
        "dataset_split": dataset_split,
        "dataset_manifest": dataset_manifest,
        "openai_target": openai_target,
        "user_content": user_content,
        "synthetic_rows": synthetic_rows,
        "synthetic_manifest": synthetic_manifest,
        "sft_prompt": sft_prompt,
        "sft_messages": sft_messages,
        "label_normalize": label_normalize,
        "label_normalize_join": label_normalize_join,
        "label_canonical": _documents(lambda: lab.normalize_label_canonical(
            F.col("text"), list(INTENT_LABELS)).alias("label")),
        "label_fallback": _documents(lambda: lab.best_label_by_words(
            F.col("lang"), F.col("text"), list(INTENT_LABELS)).alias("label")),
        "slug_labels": slug_labels,
        "balanced_sample": balanced_sample,
        "skip_existing": skip_existing,
        "allowed_labels": allowed_labels,
        "complaint_text": _documents(lambda: tx.complaint_text(
            F.col("text"), F.col("lang"), F.when(F.col("source") != "src0", F.col("source")))
            .alias("prompt_text")),
        "evaluate_calls": evaluate_calls,
        "macro_f1": macro_f1,
        "token_budget": token_budget,
        "majority_baseline": majority_baseline,
        "knn_labels": knn_labels,
        "training_triggers": training_triggers,
        "latency_by_model": _log(insights.latency_by_model),
        "savings_trend": savings_trend,
        "confusion_matrix": lambda spark, sf: insights.confusion(
            derive.calls(spark, sf), "expected_intent", "answer"),
        "label_scores": label_scores,
        "group_split": group_split,
        "label_conflicts": label_conflicts,
        "distribution_drift": distribution_drift,
        "repetitive_tasks": _log(insights.repetitive_tasks),
        "dataset_version": dataset_version,
        "dataset_changes": dataset_changes,
        "json_fields": json_fields,
        "json_report": json_report,
        "regression_scores": regression_scores,
        "confidence_limits": confidence_limits,
        "confident_routes": confident_routes,
        "leak_free_split": leak_free_split,
        "prompt_drift": prompt_drift,
        "label_drift": label_drift,
        "near_repetitive_tasks": near_repetitive_tasks,
        "label_balance": label_balance,
        "sampling_quotas": sampling_quotas,
        "sampled_requests": sampled_requests,
        "route_policy": route_policy,
        "dated_log": dated_log,
        "log_files": log_files,
        "log_quarantine": log_quarantine,
        "retention_lines": retention_lines,
        "dataset_files": dataset_files,
        "sft_files": sft_files,
        "labelled_csv": labelled_csv,
        "complaint_samples": complaint_samples,
        "teacher_sampling": _log(lambda log: insights.teacher_sampling(log, 0.1, 3, 40)),
        "evaluation_gate": _log(lambda log: insights.evaluation_gate(log, 0.5, 900.0, 10)),
        "student_tfidf_eval": _text_student(students.StudentSpec("tfidf_logistic")),
        "student_embedding_eval": _vector_student(students.StudentSpec("embedding_logistic")),
        "student_mlp_eval": _vector_student(students.StudentSpec("embedding_mlp")),
        "student_hybrid_eval": student_hybrid_eval,
        **live.queries(),
    }
