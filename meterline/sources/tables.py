"""CSV sources, label vocabularies, datasets, manifests and route snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline import schemas
from meterline.config import Snapshot
from meterline.functions.text import blank_to_null, strip, parse_timestamp
from meterline.lineage import stored
from meterline.operators.dataset import SPLITS
from meterline.sources.logs import paths_matching
from meterline.tables import small_table

_CSV = {"header": "true", "multiLine": "true", "escape": '"', "mode": "PERMISSIVE"}


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_CSV).csv(path)


def _numbered(rows: DataFrame) -> DataFrame:
    """Position of each row in its file order. A source with an id of its own should carry that
    instead; this is only for files that have none. A row knows its partition and its place there;
    what comes before a partition is added up over one count per partition, two numbers each, which
    every task gets."""
    marked = rows.withColumn("_mark", F.monotonically_increasing_id()).withColumns({
        "_part": F.shiftright("_mark", 33), "_place": F.col("_mark").bitwiseAND((1 << 33) - 1)})
    counts = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before")), "offsets")
    return marked.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_place") + F.col("_before")) \
        .drop("_mark", "_part", "_place", "_before")


def read_text_categories(spark: SparkSession, path: str, split: str, prefix: str) -> DataFrame:
    """Labelled texts from a `text,category` CSV, ids by row."""
    rows = _numbered(_read_csv(spark, path).select("text", "category"))
    cleaned = rows.select(
        F.concat(F.lit(f"{prefix}_{split}_"), F.col("_at").cast("string")).alias("request_id"),
        F.lit(split).alias("split"), strip(F.col("text")).alias("text"),
        strip(F.col("category")).alias("expected_intent"), F.col("_at").alias("position"))
    return cleaned.filter((F.length("text") > 0) & (F.length("expected_intent") > 0))


def read_complaints(
    spark: SparkSession, path: str, max_rows: int = 0, min_chars: int = 0
) -> DataFrame:
    """Complaints with a product and a narrative of at least `min_chars`, of the first `max_rows`
    rows (0: all)."""
    rows = _numbered(_read_csv(spark, path))
    if max_rows > 0:
        rows = rows.filter(F.col("_at") < max_rows)

    def field(name: str):
        return F.coalesce(strip(F.col(f"`{name}`")), F.lit(""))

    out = rows.select(
        F.coalesce(blank_to_null(F.col("`Complaint ID`")), F.col("_at").cast("string"))
        .alias("complaint_id"),
        F.lit("train").alias("split"), field("Product").alias("product"),
        field("Issue").alias("issue"), field("Sub-product").alias("sub_product"),
        field("Date received").alias("date_received"),
        field("Company response to consumer").alias("company_response"),
        field("Consumer complaint narrative").alias("narrative"), F.col("_at").alias("position"))
    return out.filter((F.length("narrative") >= min_chars) & (F.length("product") > 0)) \
        .withColumn("request_id", F.concat(F.lit("cfpb_"), "complaint_id"))


def read_labels(spark: SparkSession, path: str, of_mapping: str = "values") -> DataFrame:
    """Distinct trimmed labels of a JSON list, or of the values, keys or `labels` list of a JSON
    object."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<string>")
    mapping = F.from_json("value", "map<string,string>")
    from_object = {
        "values": F.map_values(mapping), "keys": F.map_keys(mapping),
        "labels": F.from_json(F.get_json_object("value", "$.labels"), "array<string>"),
    }[of_mapping]
    is_list = F.col("value").rlike(r"^\s*\[")
    return text.select(F.explode(F.when(is_list, listed).otherwise(from_object)).alias("label")) \
        .select(blank_to_null(F.col("label")).alias("label")).filter("label is not null").distinct()


# --- datasets --------------------------------------------------------------------------------

def write_dataset(dataset: DataFrame, root: str) -> None:
    """One folder per task and split, each file ordered by time and id.

    The rebalance hint brings the rows of a folder together, so that there are not as many files
    as tasks times folders, and lets AQE split a folder that dominates over several writers."""
    dataset.hint("rebalance", "task_id", "split").sortWithinPartitions(
        "task_id", "split", parse_timestamp(F.col("timestamp")), "timestamp", "request_id") \
        .write.mode("errorifexists").partitionBy("task_id", "split").parquet(root)


def read_dataset(spark: SparkSession, root: str, task_id: str | None = None) -> DataFrame:
    """Dataset rows; a split (or dataset) that was not written has no rows."""
    fields = {f.name: f for f in schemas.REQUEST_LOG.fields}
    schema = T.StructType([
        fields.get(c, T.StructField(c, T.StringType())) for c in schemas.DATASET_COLUMNS])
    if not paths_matching(spark, root):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(root)
    rows = rows.select(*schemas.DATASET_COLUMNS).filter(F.col("split").isin(*SPLITS))
    return rows if task_id is None else rows.filter(F.col("task_id") == task_id)


def write_sft(records: DataFrame, root: str, by_task: bool = False) -> None:
    """Records as JSON lines in one folder per split, or per task and split where they are of several
    tasks; a fine-tuning run reads one folder."""
    folders = ["task_id", "split"] if by_task else ["split"]
    kept = records.drop("request_id") if by_task else records.drop("task_id", "request_id")
    kept.hint("rebalance", *folders).write.mode("errorifexists").partitionBy(*folders).json(root)


# --- manifests -------------------------------------------------------------------------------

def _read_manifests(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All `*/*/manifest.json` below a root, with folder and file time. A broken file keeps a row
    with its text in `_corrupt_record`."""
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    pattern = f"{root.rstrip('/')}/*/*/manifest.json"
    if not paths_matching(spark, pattern):
        extra = T.StructType(with_corrupt.fields + [
            T.StructField("path", T.StringType()),
            T.StructField("file_modification_time", T.TimestampType())])
        return spark.createDataFrame([], extra)
    rows = spark.read.schema(with_corrupt).option("multiLine", "true").json(pattern)
    return rows.select(
        "*", F.regexp_replace("_metadata.file_path", "/manifest.json$", "").alias("path"),
        F.col("_metadata.file_modification_time").alias("file_modification_time"))


def read_models(spark: SparkSession, root: str) -> DataFrame:
    rows = _read_manifests(spark, root, schemas.MODEL_MANIFEST)
    return rows.withColumn("accuracy", F.col("metrics.accuracy")) \
        .withColumn("macro_f1", F.col("metrics.macro_f1"))


def read_dataset_manifests(spark: SparkSession, root: str) -> DataFrame:
    return _read_manifests(spark, root, schemas.DATASET_MANIFEST)


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """Write one manifest row to `<folder>/manifest.json` through the table's file system."""
    spark = manifest.sparkSession
    row = manifest.select(F.to_json(F.struct("*")).alias("j")).limit(2).collect()
    if len(row) != 1:
        raise ValueError(f"a manifest is one row, got {len(row)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/manifest.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(row[0]["j"].encode("utf-8")))
    finally:
        stream.close()


# --- route snapshots -------------------------------------------------------------------------

def read_snapshot_file(spark: SparkSession, path: str) -> tuple[int, str, DataFrame]:
    """Version, default mode and route table of a snapshot document."""
    doc = spark.read.schema(schemas.SNAPSHOT).option("multiLine", "true") \
        .option("mode", "FAILFAST").json(path)
    head = doc.select("version", "default_mode").first()
    routes = doc.select(F.explode("tasks").alias("task_id", "route")).select("task_id", "route.*")
    return head["version"] or 0, head["default_mode"] or "teacher_only", routes


def write_routes(routes: DataFrame, default_mode: str, version: int, root: str) -> None:
    """Write a route table as a new version. A reader sees a version only once its commit marker
    exists, so it finds either the old table or the whole new one. A row without task carries the
    default mode, also for a table without routes."""
    default = small_table(routes.sparkSession, [(None, default_mode, None, None, None)],
                          schemas.ROUTE_ROW)
    routes.select(*default.columns).unionByName(default).coalesce(1) \
        .write.mode("errorifexists").parquet(f"{root.rstrip('/')}/version={version}")


def latest_version(spark: SparkSession, root: str) -> int | None:
    done = paths_matching(spark, f"{root.rstrip('/')}/version=*/_SUCCESS")
    versions = [int(p.rsplit("version=", 1)[1].split("/", 1)[0]) for p in done]
    return max(versions) if versions else None


def read_routes(spark: SparkSession, root: str) -> tuple[int, str, DataFrame]:
    """Latest committed route table; without one, version 0 and the teacher for everything."""
    version = latest_version(spark, root)
    if version is None:
        empty = Snapshot()
        return empty.version, empty.default_mode, empty.routes_df(spark)
    rows = spark.read.parquet(f"{root.rstrip('/')}/version={version}")
    default = rows.filter("task_id is null").first()["mode"]
    return version, default, rows.filter("task_id is not null")


def publish_routes(spark: SparkSession, routes: DataFrame, default_mode: str, root: str) -> int:
    """Write the next version and return its number."""
    version = (latest_version(spark, root) or 0) + 1
    write_routes(routes, default_mode, version, root)
    return version


def snapshot_document(routes: DataFrame, default_mode: str, version: int) -> str:
    """JSON document of a route table (small by nature)."""
    tasks = {}
    for row in routes.collect():
        fields = row.asDict()
        task = fields.pop("task_id")
        fields.pop("snapshot_version", None)
        tasks[task] = {k: v for k, v in fields.items() if v is not None}
    return json.dumps({"version": version, "default_mode": default_mode, "tasks": tasks},
                      sort_keys=True)
