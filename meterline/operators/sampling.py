"""Balanced round-robin sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.lineage import stored
from meterline.operators.ranking import mark_first_n, quantile_slices


def round_robin_quotas(rows: DataFrame, label: str, limit: int) -> DataFrame:
    """How many rows each label gives when the labels take turns, in label order, until `limit`.

    Computed from the counts per label: the rounds every label can still take part in are found on
    the sorted counts, and what is left of the limit goes to the first labels that have more."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.orderBy("n", label)
    labels_left = F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)) \
        - F.row_number().over(by_size)
    # Rows taken once every label was asked n times, n being this label's count.
    reached = F.sum("n").over(by_size) + labels_left * F.col("n")
    levels = counts.withColumn("left", labels_left).withColumn("reached", reached)
    exhausted = levels.filter(F.col("reached") <= limit).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("base"),
        F.coalesce(F.max("reached"), F.lit(0)).alias("taken")).first()
    base, taken = exhausted["base"], exhausted["taken"]
    active = counts.filter(F.col("n") > base)
    n_active = active.count()
    whole, extra = divmod(limit - taken, n_active) if n_active else (0, 0)
    turn = F.row_number().over(Window.orderBy(label))
    more = active.select(label, F.when(turn <= extra, 1).otherwise(0).alias("extra"))
    return counts.join(more, label, "left").select(label, F.when(
        F.col("extra").isNull(), F.col("n")
    ).otherwise(F.lit(base + whole) + F.col("extra")).cast("long").alias("quota"))


def balanced_sample(
    rows: DataFrame, label: str, position: str, limit: int, tie: list[str] = ()
) -> DataFrame:
    """Rows a round-robin over the labels would take until `limit`, in the order of `position`
    (a number) within a label. A limit of 0, or one not below the row count, keeps all rows."""
    if limit <= 0 or rows.count() <= limit:
        return rows
    quotas = stored(round_robin_quotas(rows, label, limit), "quotas")
    slice_no = quantile_slices(rows, F.col(position))
    return mark_first_n(
        rows.join(quotas, label), [label], [position, *tie], slice_no, "quota", "_in"
    ).filter("_in").drop("_in", "quota")


def sample_train_and_eval(
    rows: DataFrame, label: str, position: str, train_limit: int, eval_limit: int
) -> tuple[DataFrame, DataFrame]:
    """A balanced training sample, and a balanced evaluation sample of the remaining rows."""
    train = balanced_sample(rows, label, position, train_limit)
    rest = rows.join(train.select("request_id"), "request_id", "left_anti")
    evaluation = balanced_sample(rest, label, position, eval_limit)
    return train.withColumn("split", F.lit("train")), \
        evaluation.withColumn("split", F.lit("test"))
