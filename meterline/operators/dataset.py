"""Training sets from the request log: eligibility, deduplication, split, manifest, SFT export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.cost import hash_bucket
from meterline.functions.text import blank_to_null, completion_target, input_text, label_prompt, parse_timestamp
from meterline.lineage import stored
from meterline.operators.ranking import latest_per_key
from meterline.schemas import DATASET_COLUMNS

TARGET_FIELDS = ("openai_content", "response_redacted")
SPLITS = ("train", "validation", "test")


def split_of(request_id: Column, input_hash: Column) -> Column:
    bucket = hash_bucket(F.coalesce(request_id, input_hash), "split:")
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def eligible_rows(logs: DataFrame, task_id: str | None = None) -> DataFrame:
    rows = logs if task_id is None else logs.filter(F.col("task_id") == task_id)
    return rows.filter(
        (F.col("status") == "success") & F.coalesce("training_eligible", F.lit(False))
        & F.col("prompt_redacted").isNotNull() & F.col("response_redacted").isNotNull())


def build_dataset(
    logs: DataFrame, task_id: str | None = None, target_field: str = "openai_content",
    min_samples: int = 0,
) -> DataFrame:
    """Deduplicated, split training rows of one task, or of all tasks at once.

    Of the copies of an input the newest counts, and only then is an empty target dropped. Tasks
    with fewer than `min_samples` rows give no dataset."""
    if target_field not in TARGET_FIELDS:
        raise ValueError(f"unknown target field: {target_field!r}")
    newest = latest_per_key(
        eligible_rows(logs, task_id),
        [F.col("task_id"), F.coalesce("input_hash", "request_id")],
        [F.desc(parse_timestamp(F.col("timestamp"))), F.desc("timestamp"), F.desc("request_id")])
    answer = F.col("response_redacted")
    target = completion_target(answer) if target_field == "openai_content" else answer
    rows = newest.withColumn("teacher_output", target) \
        .filter(F.length("teacher_output") > 0) \
        .withColumns({
            "input": F.col("prompt_redacted"),
            "validated_output": F.col("teacher_output"),
            "split": split_of(F.col("request_id"), F.col("input_hash")),
        }).select(*DATASET_COLUMNS)
    if min_samples > 1:
        enough = rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")) \
            .filter(F.col("n") >= min_samples).select("task_id")
        rows = rows.join(stored(enough, "tasks"), "task_id", "left_semi").select(*DATASET_COLUMNS)
    return rows


def split_counts() -> list[Column]:
    return [F.count_if(F.col("split") == s).alias(f"{s}_samples") for s in SPLITS]


def time_range(timestamp: Column) -> list[Column]:
    """First and last timestamp as they are spelled, by instant; unreadable ones count only where
    there is no other."""
    instant = parse_timestamp(timestamp)
    return [F.min_by(timestamp, F.struct(instant.isNull(), instant, timestamp)).alias("min_timestamp"),
            F.max_by(timestamp, F.struct(instant, timestamp)).alias("max_timestamp")]


def dataset_manifest(dataset: DataFrame) -> DataFrame:
    """Per task: sizes, time range and sums."""
    return dataset.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("samples"), *split_counts(),
        *time_range(F.col("timestamp")),
        F.sum(F.coalesce("estimated_teacher_cost_usd", F.lit(0.0))).alias("teacher_cost_usd"),
        F.sum(F.coalesce("estimated_savings_usd", F.lit(0.0))).alias("estimated_savings_usd"))


def manifest_documents(
    manifest: DataFrame, dataset_id: Column, created_at: str, source_logs: str, target_field: str
) -> DataFrame:
    """Manifest rows in the nested form that is stored beside a dataset."""
    return manifest.select(
        dataset_id.alias("dataset_id"), "task_id", F.lit(created_at).alias("created_at"),
        F.lit(source_logs).alias("source_logs"), F.lit("parquet").alias("format"), "samples",
        F.struct(*[F.col(f"{s}_samples").alias(s) for s in SPLITS]).alias("splits"),
        F.struct("min_timestamp", "max_timestamp").alias("time_range"),
        "teacher_cost_usd", "estimated_savings_usd",
        F.struct(
            F.lit("success").alias("status"), F.lit(True).alias("training_eligible"),
            F.array(F.lit("prompt_redacted"), F.lit("response_redacted"))
            .alias("required_fields"),
            F.lit(target_field).alias("target_field"),
            F.lit("coalesce(input_hash, request_id)").alias("dedupe_key"),
            F.lit("stable hash(request_id/input_hash): 70/15/15").alias("split_strategy"),
        ).alias("filters"))


def training_and_eval_rows(dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on (train, else everything) and to score (first non-empty of validation, test,
    the fitted rows)."""
    counts = dataset.agg(*split_counts()).first()
    rows = {s: dataset.filter(F.col("split") == s) for s in SPLITS}
    train = rows["train"] if counts["train_samples"] else dataset
    for name in ("validation", "test"):
        if counts[f"{name}_samples"]:
            return train, rows[name]
    return train, train


def sft_rows(
    dataset: DataFrame, labels: list[str] | None, task_description: str,
    record: str = "messages", input_format: str = "openai_user_content", max_input_chars: int = 0,
) -> DataFrame:
    """Fine-tuning records: `messages`, or `prompt` and `completion`. Without `labels` each task's
    prompts list the labels of its own rows, which meet the rows as one value per task."""
    if labels is None:
        lists = dataset.select("task_id", blank_to_null(F.col("validated_output")).alias("l")) \
            .groupBy("task_id").agg(F.array_sort(F.collect_set("l")).alias("_labels"))
        dataset = dataset.join(stored(lists, "labels"), "task_id")
        labels = F.col("_labels")
    text = input_text(F.col("input"), input_format, max_input_chars)
    prompt = label_prompt(task_description, labels, text)
    split = F.when(F.col("split") == "validation", "valid").otherwise(F.col("split"))
    base = [F.col("task_id"), F.col("request_id"), split.alias("split")]
    if record == "prompt":
        return dataset.select(*base, prompt.alias("prompt"),
                              F.col("validated_output").alias("completion"))
    if record != "messages":
        raise ValueError(f"unknown record format: {record!r}")

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return dataset.select(*base, F.array(
        turn("user", prompt), turn("assistant", F.col("validated_output"))).alias("messages"))
