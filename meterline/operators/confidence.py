"""Confidence limits of students: calibration, the risk-coverage curve, and the lowest threshold.

Confidences are counted in BINS bins per key with map-side combine, so everything after the first
aggregation is at most BINS + 1 rows per key, however many requests a key has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1000


def confidence_bins(rows: DataFrame, keys: list[str], confidence: str, correct: Column,
                    bins: int = BINS) -> DataFrame:
    """(keys, bin, n, hits): answers and right answers per confidence, which lies from 0 to 1; others
    are left out. A bin is named by its lower end times `bins`."""
    value = F.col(confidence).cast("double")
    kept = rows.where((value >= 0) & (value <= 1))
    return kept.groupBy(*keys, F.floor(value * bins + F.lit(1e-9)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(correct, F.lit(False))).alias("hits"))


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators: the nearest shares of hits that never fall with the bin."""
    rows = rows.sort_values("bin")
    blocks: list[list[int]] = []
    for n, hits in zip(rows["n"].tolist(), rows["hits"].tolist()):
        blocks.append([n, hits, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, hits, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + hits, blocks[-1][2] + size]
    return rows.assign(calibrated=[hits / n for n, hits, size in blocks for _ in range(size)])


def calibrated(bins: DataFrame, keys: list[str]) -> DataFrame:
    """The bins with `calibrated`, the isotonic estimate of being right."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bins.schema.fields]
                       + ["calibrated double"])
    return bins.groupBy(*keys).applyInPandas(_pool, schema)


def risk_coverage(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Per bin, the share of answers at this confidence or above, and their calibrated error rate. As
    the calibration never falls, neither does the risk when the threshold goes down."""
    above = Window.partitionBy(*keys).orderBy(F.desc("bin")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("n").over(above)
    wrong = F.sum(F.col("n") * (1 - F.col("calibrated"))).over(above)
    return curve.withColumns({
        "coverage": n / F.sum("n").over(Window.partitionBy(*keys)),
        "risk": F.round(wrong / n, 10)})


def confidence_limits(rows: DataFrame, keys: list[str], confidence: str, correct: Column,
                      max_error: float, bins: int = BINS) -> DataFrame:
    """Per key, the lowest confidence at which the answers stay within `max_error`, with the coverage
    and the risk there; nulls where no threshold does."""
    curve = risk_coverage(calibrated(confidence_bins(rows, keys, confidence, correct, bins), keys), keys)
    good = F.col("risk") <= F.lit(float(max_error))
    lowest = lambda c: F.min_by(F.when(good, F.col(c)), F.when(good, F.col("bin")))
    return curve.groupBy(*keys).agg(
        F.sum("n").alias("answers"), (F.min(F.when(good, F.col("bin"))) / F.lit(bins)).alias("min_confidence"),
        F.round(lowest("coverage"), 10).alias("coverage"), lowest("risk").alias("risk"))


def confident_routes(policy: DataFrame, limits: DataFrame) -> DataFrame:
    """The route policy with the confidence each student has to reach per task. A student without a
    threshold that meets the error limit does not serve the task."""
    joined = policy.join(limits.select("task_id", "selected_model", "min_confidence", "coverage"),
                         ["task_id", "selected_model"], "left")
    reason = F.coalesce("reason", F.when(F.col("min_confidence").isNull(), "no safe confidence"))
    return joined.withColumn("reason", reason).withColumn(
        "decision", F.when(F.col("reason").isNull(), "student").otherwise("teacher_only"))
