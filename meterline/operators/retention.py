"""Retention: which rows and datasets have outlived their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.text import parse_timestamp, strip

# Days each kind of record is kept.
RETENTION_DAYS = {"proxy_logs": 90, "shadow": 90, "feedback": 365, "registry": 1095,
                  "datasets": 365}


def cutoff(as_of: str, days: int) -> Column:
    return F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))


def classify_lines(lines: DataFrame, as_of: str, days: int, line: str = "value") -> DataFrame:
    """Add `fate` to raw log lines: removed, kept, blank, invalid or undated. Only lines with a
    readable time before the cut-off are removed."""
    parsed = F.try_parse_json(F.col(line))
    stamp = parse_timestamp(F.try_variant_get(parsed, "$.timestamp", "string"))
    return lines.withColumn("fate", F.when(F.length(strip(F.col(line))) == 0, "blank")
                            .when(parsed.isNull(), "invalid")
                            .when(stamp.isNull(), "undated")
                            .when(stamp < cutoff(as_of, days), "removed").otherwise("kept"))


def retained(lines: DataFrame, as_of: str, days: int, line: str = "value") -> DataFrame:
    """Lines to write to the new path (never the path being read)."""
    return classify_lines(lines, as_of, days, line).filter("fate <> 'removed'").drop("fate")


def retention_report(classified: DataFrame, keys: list[str]) -> DataFrame:
    fate = F.col("fate")
    return classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(fate == "removed").alias("removed_lines"),
        F.count_if(fate != "removed").alias("kept_lines"),
        F.count_if(fate == "invalid").alias("invalid_lines_kept"),
        F.count_if(fate == "undated").alias("missing_timestamp_kept"))


def dataset_retention(
    manifests: DataFrame, as_of: str, days: int = RETENTION_DAYS["datasets"]
) -> DataFrame:
    """Add `created` and `expired` to the manifest catalogue. Without a readable `created_at` the
    file time counts; an unreadable manifest is kept."""
    has_file_time = "file_modification_time" in manifests.columns
    fallback = F.col("file_modification_time") if has_file_time else F.lit(None).cast("timestamp")
    broken = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in manifests.columns \
        else F.lit(False)
    created = F.when(~broken, F.coalesce(parse_timestamp(F.col("created_at")), fallback))
    return manifests.withColumn("created", created) \
        .withColumn("expired", F.coalesce(created < cutoff(as_of, days), F.lit(False)))
