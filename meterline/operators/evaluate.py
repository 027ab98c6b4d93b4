"""Accuracy, macro-F1, token budget and the majority baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.cost import ratio, round_half_up
from meterline.functions.text import completion_label


def evaluate_calls(calls: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Calls, correct and invalid answers (no label in the response), accuracy."""
    predicted = completion_label(F.col("response_body"))
    marked = calls.withColumn("_p", predicted)
    out = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if((F.length("_p") > 0) & (F.col("_p") == F.col("expected_intent")))
        .alias("correct"),
        F.count_if(F.coalesce(F.length("_p"), F.lit(0)) == 0).alias("invalid"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("calls"), None))


def label_scores(scored: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """True positives, false positives and false negatives per label. The rows are first counted
    per (truth, prediction); everything after runs on that small table."""
    keys = list(keys)
    cells = scored.groupBy(*keys, F.col(truth).alias("t"), F.col(predicted).alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("t").eqNullSafe(F.col("p"))
    sides = F.array(
        F.struct(F.col("t").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
                 F.lit(0).cast("long").alias("fn")))
    return cells.select(*keys, F.inline(sides)).filter("label is not null") \
        .groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                     F.sum("fn").alias("fn"))


def classification_metrics(
    scored: DataFrame, truth: str, predicted: str, keys: list[str] = ()
) -> DataFrame:
    """Accuracy and macro-F1 over the labels that occur as truth or prediction."""
    keys = list(keys)
    per_label = label_scores(scored, truth, predicted, keys)
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    f1 = ratio(2 * tp, 2 * tp + wrong, None)
    return per_label.groupBy(*keys).agg(
        F.sum(tp + F.col("fn")).alias("eval_samples"), F.count(F.lit(1)).alias("labels"),
        (F.sum("tp") / F.sum(tp + F.col("fn"))).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def token_budget(requests: DataFrame, labels: DataFrame, token_budget: int) -> DataFrame:
    """Four characters a token, over the texts and the label list (rows `label`) sent with each of
    them, a line per label."""
    sizes = labels.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("label") + 3)).first()
    n_labels, list_chars = sizes[0], (sizes[1] or 1) - 1
    out = requests.agg(F.count(F.lit(1)).alias("requests"),
                       F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("_chars"))
    tokens = F.floor((F.col("_chars") + F.lit(list_chars) * F.col("requests")) / F.lit(4))
    out = out.withColumn("estimated_prompt_tokens", tokens.cast("long"))
    each = ratio(F.col("estimated_prompt_tokens"), F.col("requests"), None)
    return out.select(
        "requests", F.lit(n_labels).cast("long").alias("labels"), "estimated_prompt_tokens",
        round_half_up(each, 2).alias("estimated_prompt_tokens_per_request"),
        F.lit(token_budget).cast("long").alias("token_budget"),
        F.when(each > 0, F.floor(F.lit(float(token_budget)) / each)).otherwise(0).cast("long")
        .alias("estimated_requests_for_budget"))


def majority_label(train: DataFrame, label: str, keys: list[str] = ()) -> DataFrame:
    """Most frequent label, the first in order on a tie."""
    keys = list(keys)
    counts = train.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))
    return counts.groupBy(*keys).agg(F.min_by(label, order).alias("prediction"))


def majority_baseline(train: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Predict the most frequent training label for every row, with confidence 1. The single label
    comes to the driver."""
    best = majority_label(train, label).first()
    prediction: Column = F.lit(best["prediction"] if best else None)
    return rows.withColumn("prediction", prediction).withColumn("confidence", F.lit(1.0))
