"""Starting streams, and bounded runs over a folder of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meterline.lineage import work_folder


def read_files(spark: SparkSession, pattern: str, schema: T.StructType,
               per_trigger: int | None = None) -> DataFrame:
    """Stream over Parquet files of a folder or glob."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(pattern)


HEARTBEAT = "heartbeat boolean, ts timestamp, timestamp string"


def heartbeats(spark: SparkSession, at: str = "2200-01-01T00:00:00Z"
               ) -> tuple[DataFrame, Callable[[], None]]:
    """A stream of heartbeats, and what sends one. A heartbeat is a row whose time moves the watermark
    past everything that waits; operators that take heartbeats drop it after that."""
    folder = work_folder(spark, "heartbeats")
    spark.createDataFrame([], HEARTBEAT).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)

    def send() -> None:
        spark.sql(f"SELECT true AS heartbeat, CAST('{at}' AS timestamp) AS ts, '{at}' AS timestamp") \
            .write.mode("append").parquet(folder)

    return stream, send


def drain(stream: DataFrame, purpose: str, mode: str = "append",
          closing: Callable[[], None] | None = None) -> DataFrame:
    """Process what is available, then return the sink's rows. With `closing` (the sender of a
    heartbeat) the stream runs once more after it, so that rows come out that wait for time to pass.

    Append mode writes a Parquet sink with exactly-once commits. Complete mode rewrites the whole
    result, one folder per batch, and the last one counts: a batch that is run again after a
    failure replaces its own folder."""
    spark = stream.sparkSession
    root = work_folder(spark, purpose)
    out = f"{root}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state") \
        .trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
        writer.start().awaitTermination()
        if closing is not None:
            closing()
            writer.start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    last: list[int] = []

    def write_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last.append(number)

    writer.foreachBatch(write_batch).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(last)}")
