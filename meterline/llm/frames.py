"""Frames shared by the operators: reading tables, sizes, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.lineage import stored


UNKNOWN_SIZE = 1 << 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what goes to Python at once by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def plan_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects of the frame; for a scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards_for(texts: DataFrame, column: str, bytes_each: int, least: int = 4) -> int:
    """A power of two of shards, each for about `bytes_each` bytes of input. The size is the
    optimizer's; where it has none (it then says a huge number), the texts are summed."""
    size = plan_bytes(texts)
    if size > UNKNOWN_SIZE:
        size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    n = least
    while n * bytes_each < size:
        n *= 2
    return n


def lookup(rows: DataFrame, values: DataFrame, key: str, chunk: int = 8192) -> DataFrame:
    """`rows` left-joined with `values` (one row per key; no null keys) on `key`. Keys that more than
    `chunk` rows share are dealt out: their rows go to several tasks, their value to each of these.
    What is counted first is a key and a number; few keys come back from it."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = stored(counts.where(F.col("count") > chunk).selectExpr(
        f"`{key}` as _hot", f"cast(ceil(count / {chunk}) as int) as _copies"), "hot-keys")
    if hot.isEmpty():
        return rows.join(values, key, "left")
    dealt = (rows.withColumn("_uid", F.monotonically_increasing_id())
             .join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
                 "_copy", F.expr("if(_copies is null, 0, cast(pmod(xxhash64(_uid), _copies) as int))"))
             .drop("_hot", "_copies", "_uid"))
    copies = (values.join(hot, F.col(key) == F.col("_hot"), "left")
              .withColumn("_copy", F.explode(F.expr("sequence(0, coalesce(_copies, 1) - 1)")))
              .drop("_hot", "_copies"))
    return dealt.join(copies, [key, "_copy"], "left").drop("_copy")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in `edges`; the component is the smallest node of it.

    Alternating large-star and small-star rounds: each node sends its larger, then its smaller
    neighbours to the smallest one it sees, until nothing moves. A round is one grouped minimum
    and one join on it, so no neighbour list is ever gathered; its edges are written to the
    shared folder, which ends the lineage."""
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                         .alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = stored(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(hubs)
