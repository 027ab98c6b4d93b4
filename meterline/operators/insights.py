"""Decisions over log, calls and datasets: training triggers, latency, savings, splits, drift, gates.

Every operator is one or two grouped aggregations with map-side combine; percentiles weigh distinct
values by their counts, so a key with most of the rows costs no more than its distinct values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.cost import hash_bucket, ratio
from meterline.functions.text import day_of
from meterline.lineage import stored
from meterline.operators.aggregate import count_if
from meterline.operators.ranking import mark_first_n

SHARE_FLOOR = 1e-6


@dataclass(frozen=True)
class TriggerLimits:
    min_samples: int = 100
    min_clients: int = 5
    min_teacher_cost: float = 0.0
    min_age_days: int = 7
    max_error_rate: float = 0.5


def training_triggers(logs: DataFrame, limits: TriggerLimits = TriggerLimits()) -> DataFrame:
    """Per task, whether it has the volume, users, cost, age and quality to train a student."""
    day = F.to_date(day_of(F.col("timestamp")))
    stats = logs.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("client_id").alias("clients"),
        F.sum(F.coalesce("estimated_teacher_cost_usd", F.lit(0.0))).alias("teacher_cost_usd"),
        F.datediff(F.max(day), F.min(day)).cast("long").alias("age_days"),
        count_if(F.col("status") == "error").alias("errors"))
    rate = ratio(F.col("errors"), F.col("samples"), None)
    return stats.withColumn("error_rate", rate).withColumn("triggered", (
        (F.col("samples") >= limits.min_samples) & (F.col("clients") >= limits.min_clients)
        & (F.col("teacher_cost_usd") >= limits.min_teacher_cost)
        & (F.col("age_days") >= limits.min_age_days)
        & (F.col("error_rate") <= limits.max_error_rate)))


def latency_by_model(logs: DataFrame) -> DataFrame:
    """Requests, p50, p95, p99, error and fallback rate of each model."""
    by_latency = logs.groupBy("selected_model", "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("status") == "error").alias("errors"),
        count_if(F.col("routing_reason").contains("fallback")).alias("fallbacks"))
    steps = F.array(*[F.lit(p) for p in (0.5, 0.95, 0.99)])
    out = by_latency.groupBy("selected_model").agg(
        F.sum("n").alias("requests"), F.sum("errors").alias("errors"),
        F.sum("fallbacks").alias("fallbacks"), F.percentile("latency_ms", steps, F.col("n")).alias("p"))
    return out.select(
        "selected_model", "requests",
        *[F.round(F.col("p")[i], 2).alias(f"p{q}_latency_ms") for i, q in enumerate((50, 95, 99))],
        *[F.round(F.col(c) / F.col("requests"), 6).alias(name)
          for c, name in (("errors", "error_rate"), ("fallbacks", "fallback_rate"))])


def savings_trend(logs: DataFrame, training_cost: float) -> DataFrame:
    """Per task and day: savings, savings so far, what of the training cost is left, and the return
    on it."""
    daily = logs.groupBy("task_id", day_of(F.col("timestamp")).alias("day")).agg(
        F.sum(F.coalesce("estimated_savings_usd", F.lit(0.0))).alias("savings_usd"))
    so_far = F.sum("savings_usd").over(Window.partitionBy("task_id").orderBy("day"))
    daily = daily.withColumn("cumulative_savings_usd", so_far)
    cost = F.lit(float(training_cost))
    return daily.withColumns({
        "unrecovered_usd": F.greatest(cost - F.col("cumulative_savings_usd"), F.lit(0.0)),
        "roi": (F.col("cumulative_savings_usd") - cost) / cost})


def confusion(calls: DataFrame, truth: str, predicted: str) -> DataFrame:
    return calls.groupBy(F.col(truth).alias("expected"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def label_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label, from the counts of `confusion`."""
    each = matrix.select("n", F.inline(F.array(
        F.struct(F.col("expected").alias("label"), F.lit(1).alias("true"), F.lit(0).alias("guess")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("true"), F.lit(1).alias("guess")))),
        (F.col("expected") == F.col("predicted")).alias("hit"))
    sums = each.groupBy("label").agg(
        F.sum(F.col("n") * F.col("true")).alias("support"),
        F.sum(F.col("n") * F.col("guess")).alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("true")).otherwise(0)).alias("hits"))
    return sums.select("label", "support", "predicted", *[
        F.round(ratio(a * F.col("hits"), b, None), 10).alias(name) for name, a, b in (
            ("precision", 1, F.col("predicted")), ("recall", 1, F.col("support")),
            ("f1", 2, F.col("predicted") + F.col("support")))])


def group_split(group: Column, row_id: Column | None = None) -> Column:
    """Split by group (client, conversation, period), so that no group is in two of them. A row without
    a group is a group of its own, by its id; without both it is in no split."""
    bucket = hash_bucket(group if row_id is None else F.coalesce(group, row_id), "group:")
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").when(bucket < 100, "test")


def without_conflicts(rows: DataFrame, key: Column, label: str) -> DataFrame:
    """Rows of inputs that have one label only. A null label is a label like any other, so an input
    with a label and without one conflicts; rows without an input conflict with nothing and stay. The
    conflicting inputs meet the rows by their hash."""
    keyed = rows.withColumn("_key", F.sha2(key, 256))
    counted = keyed.where("_key is not null").groupBy("_key").agg(
        F.min(label).alias("a"), F.max(label).alias("b"), F.count(F.lit(1)).alias("n"), F.count(label).alias("known"))
    bad = counted.where("a <> b or (known > 0 and known < n)").select("_key")
    return keyed.join(bad, "_key", "left_anti").drop("_key")


def distribution_drift(rows: DataFrame, keys: list[str], label: str, later: Column) -> DataFrame:
    """Per key, L1 distance and population stability index between the label shares of the rows
    before and after; shares are taken as SHARE_FLOOR at least for the index."""
    counts = rows.groupBy(*keys, label).agg(count_if(~later).alias("before"), count_if(later).alias("after"))
    all_ = Window.partitionBy(*keys)
    p, q = (ratio(F.col(c), F.sum(c).over(all_), None) for c in ("before", "after"))
    shares = counts.withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("q", F.coalesce(q, F.lit(0.0)))
    fp, fq = (F.greatest(F.col(c), F.lit(SHARE_FLOOR)) for c in ("p", "q"))
    return shares.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("labels"), F.round(F.sum(F.abs(F.col("p") - F.col("q"))), 8).alias("l1"),
        F.round(F.sum((fq - fp) * F.log(fq / fp)), 8).alias("psi"))


def repetitive_tasks(logs: DataFrame, min_share: float = 0.05) -> DataFrame:
    """Per task, the share of requests that repeat an input, and whether it is at least
    `min_share`."""
    out = logs.groupBy("task_id").agg(
        F.count("input_hash").alias("requests"), F.count_distinct("input_hash").alias("inputs"))
    share = F.round(ratio(F.col("requests") - F.col("inputs"), F.col("requests"), None), 6)
    return out.withColumn("repeated_share", share).withColumn(
        "repetitive", F.coalesce(F.col("repeated_share") >= min_share, F.lit(False)))


def evaluation_gate(logs: DataFrame, max_cost_ratio: float, max_p95_ms: float, min_samples: int
                    ) -> DataFrame:
    """Students that are cheap, fast and tried often enough, by their served requests; the first
    limit that fails is the reason."""
    served = logs.filter(F.col("routing_decision") == "student")
    by_latency = served.groupBy("selected_model", "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_cost_usd").alias("cost"),
        F.sum("estimated_teacher_cost_usd").alias("teacher_cost"))
    out = by_latency.groupBy("selected_model").agg(
        F.sum("n").alias("samples"), F.round(F.percentile("latency_ms", 0.95, F.col("n")), 2).alias("p95_latency_ms"),
        F.round(ratio(F.sum("cost"), F.sum("teacher_cost"), None), 8).alias("cost_ratio"))
    reason = (F.when(F.col("samples") < min_samples, "too few samples")
              .when(~F.coalesce(F.col("cost_ratio") <= max_cost_ratio, F.lit(False)), "too expensive")
              .when(~F.coalesce(F.col("p95_latency_ms") <= max_p95_ms, F.lit(False)), "too slow"))
    return out.withColumn("gate_reason", reason).withColumn("passed", F.col("gate_reason").isNull())


def route_policy(logs: DataFrame, limits: DataFrame) -> DataFrame:
    """What each student may serve per task: `limits` has selected_model, max_p95_ms,
    max_error_rate and min_requests; the first limit that fails sends the task to the teacher."""
    served = logs.filter(F.col("routing_decision") == "student")
    by_latency = served.groupBy("task_id", "selected_model", "latency_ms").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("status") == "error").alias("errors"))
    stats = by_latency.groupBy("task_id", "selected_model").agg(
        F.sum("n").alias("requests"), F.round(F.percentile("latency_ms", 0.95, F.col("n")), 2).alias("p95_latency_ms"),
        F.round(F.sum("errors") / F.sum("n"), 6).alias("error_rate"))
    reason = (F.when(F.col("max_p95_ms").isNull(), "no limits set")
              .when(F.col("requests") < F.col("min_requests"), "too few requests")
              .when(F.col("p95_latency_ms") > F.col("max_p95_ms"), "too slow")
              .when(F.col("error_rate") > F.col("max_error_rate"), "too many errors"))
    return stats.join(limits, "selected_model", "left").select(
        "task_id", *stats.columns[1:], reason.alias("reason"),
        F.when(reason.isNull(), "student").otherwise("teacher_only").alias("decision"))


def teacher_sampling(logs: DataFrame, share: float, floor: int, ceiling: int) -> DataFrame:
    """Per task and day, how many requests the teacher answers as samples: a share of them, at least
    `floor`, at most `ceiling`, and never more than there are."""
    daily = logs.groupBy("task_id", day_of(F.col("timestamp")).alias("day")).agg(
        F.count(F.lit(1)).alias("requests"),
        count_if(F.col("routing_decision") == "teacher").alias("teacher_requests"))
    wanted = F.greatest(F.ceil(F.col("requests") * F.lit(float(share))), F.lit(floor))
    target = F.least(wanted, F.lit(ceiling), F.col("requests")).cast("long")
    return daily.withColumn("teacher_samples", target).withColumn(
        "missing", F.greatest(target - F.col("teacher_requests"), F.lit(0)).cast("long"))


def label_balance(rows: DataFrame, keys: list[str], label: str, min_ratio: float = 0.05) -> DataFrame:
    """Per key: labelled rows, labels, the share of the rarest one, and whether it is at least
    `min_ratio`, as a training trigger may ask for. Rows without a label do not count."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(*keys).agg(F.sum("n").alias("labelled"), F.count(F.lit(1)).alias("labels"),
                                    F.min("n").alias("least"))
    share = ratio(F.col("least"), F.col("labelled"), 6)
    return out.withColumn("balance_ratio", share).drop("least").withColumn(
        "balanced", F.col("balance_ratio") >= min_ratio)


def sampling_quotas(logs: DataFrame, shadow: DataFrame, share: float, floor: int, ceiling: int,
                    max_divergence: float = 0.03, window_days: int = 1, boost: float = 2.0) -> DataFrame:
    """Per task and day, how many requests the teacher samples: a share of them, more by `boost` while
    the shadow answers of the `window_days` days before diverged by more than `max_divergence`; at
    least `floor`, at most `ceiling`, and never more than there are."""
    day = day_of(F.col("timestamp")).alias("day")
    daily = logs.groupBy("task_id", day).agg(F.count(F.lit(1)).alias("requests"))
    compared = shadow.groupBy("task_id", day).agg(
        F.count("response_exact_match").alias("compared"),
        count_if(~F.col("response_exact_match")).alias("diverged"))
    before = Window.partitionBy("task_id").orderBy(F.unix_date(F.to_date("day"))) \
        .rangeBetween(-window_days, -1)
    days = daily.join(compared, ["task_id", "day"], "left").withColumn("divergence", F.round(ratio(
        F.sum("diverged").over(before), F.sum("compared").over(before), None), 6))
    raised = F.col("divergence") > F.lit(float(max_divergence))
    wanted = F.ceil(F.col("requests") * F.when(raised, float(share * boost)).otherwise(float(share)))
    quota = F.least(F.greatest(wanted, F.lit(floor)), F.lit(ceiling), F.col("requests")).cast("long")
    return days.select("task_id", "day", "requests", "divergence", raised.alias("raised"), quota.alias("quota"))


def sampled_requests(logs: DataFrame, quotas: DataFrame, salt: str = "probe:") -> DataFrame:
    """The requests that the teacher samples: of each task and day the first `quota` in the order of a
    keyed hash of their id, so reruns agree and a task's busiest day is never sorted in one place."""
    mark = F.md5(F.concat(F.lit(salt), "request_id"))
    rows = logs.where(F.col("request_id").isNotNull()).select(
        "task_id", day_of(F.col("timestamp")).alias("day"), "request_id", mark.alias("_mark"))
    rows = rows.join(stored(quotas.select("task_id", "day", "quota"), "quotas"), ["task_id", "day"])
    slice_no = F.conv(F.substring("_mark", 1, 2), 16, 10).cast("int")
    return mark_first_n(rows, ["task_id", "day"], ["_mark", "request_id"], slice_no, "quota", "_in") \
        .filter("_in").select("task_id", "day", "request_id")
