"""JSON-lines logs: typed, tolerant and strict reads, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline import schemas
from meterline.functions.text import day_of, strip


def paths_matching(spark: SparkSession, path: str) -> list[str]:
    """Files a glob (or a literal path) names, listed by the file system Spark would read from."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm_path) or []
    return [status.getPath().toString() for status in found]


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed scan of a glob. Columns a file lacks are NULL; no matching file gives an empty frame."""
    if not paths_matching(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).json(path)


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, schemas.REQUEST_LOG)


def read_shadow_log(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, schemas.SHADOW_LOG)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, schemas.FEEDBACK)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with the file they come from."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"))


def read_tolerant(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Rows of the JSON objects in the files, and the lines that are none (with their file). Blank
    lines and JSON values other than objects are passed over."""
    if not paths_matching(spark, path):
        return _empty(spark, schema), _empty(
            spark, T.StructType().add("file", "string").add("value", "string"))
    lines = read_lines(spark, path).withColumn("_line", strip(F.col("value"))) \
        .filter(F.length("_line") > 0)
    parsed = lines.withColumn("_json", F.try_parse_json("_line"))
    is_object = F.col("_json").isNotNull() & F.col("_line").startswith("{")
    good = parsed.filter(is_object).select(F.from_json("_line", schema).alias("_r")).select("_r.*")
    return good, parsed.filter(F.col("_json").isNull()).select("file", "value")


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan that fails on the first malformed line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    rows = read_strict(spark, path, schemas.REFERENCE)
    return rows.filter((F.length(strip(F.col("text"))) > 0)
                       & (F.length(strip(F.col("expected_intent"))) > 0))


def _dated(rows: DataFrame) -> DataFrame:
    """Rows with their day, gathered by day; AQE splits a day too large for one writer."""
    return rows.withColumn("date", day_of(F.col("timestamp"))).hint("rebalance", "date")


def append_log(rows: DataFrame, path: str, log_mode: str = "redacted") -> None:
    """Append log rows as JSON lines in one folder per day. Each task writes its own file and the
    commit is per job, so a lost executor leaves no half-written line."""
    if log_mode == "disabled":
        return
    _dated(rows).write.mode("append").partitionBy("date").json(path)


def append_columnar(rows: DataFrame, path: str) -> None:
    """The same as Parquet, for logs that are read often."""
    _dated(rows).write.mode("append").partitionBy("date").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_labelled(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
