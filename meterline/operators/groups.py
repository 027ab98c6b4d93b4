"""Splits without leaks: rows that share a client, a conversation, an input, ... stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.cost import hash_bucket
from meterline.lineage import stored


def linked_rows(rows: DataFrame, row_id: str, keys: list[Column]) -> DataFrame:
    """(row_id, component): the smallest id that a chain of shared key values leads to. Null keys link
    nothing, rows without an id are left out.

    Each round takes the smallest label per key value, then per row, and then follows the label's own
    label, so the distance that is left is halved. Key values are counted first and only those of
    several rows take part; a round is grouped minima with map-side combine, written before the next.
    Every join here has tables on both sides that grow with the rows, so all are merged: broadcasts of
    the smaller ones, some in every round, would all pass through the driver."""
    marks = F.array(*[F.struct(F.lit(i).alias("kind"), k.cast("string").alias("value"))
                      for i, k in enumerate(keys)])
    named = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id"), F.explode(marks).alias("m"))
    pairs = named.where("m.value is not null").select("id", F.sha2(F.concat_ws(
        ":", F.col("m.kind").cast("string"), F.col("m.value")), 256).alias("key")).distinct()
    shared = pairs.groupBy("key").count().where("count > 1").select("key")
    pairs = stored(pairs.join(shared.hint("merge"), "key"), "links")
    labels = stored(pairs.select("id").distinct().select("id", F.col("id").alias("label")), "labels")
    while True:
        least = pairs.join(labels.hint("merge"), "id").groupBy("key").agg(F.min("label").alias("low"))
        hooked = stored(pairs.join(least.hint("merge"), "key").groupBy("id").agg(F.min("low").alias("low")), "hooked")
        jumped = hooked.join(hooked.select(F.col("id").alias("low"), F.col("low").alias("next")).hint("merge"), "low")
        now = stored(jumped.select("id", F.least("low", "next").alias("label")), "labels")
        moved = now.join(labels.withColumnRenamed("label", "old").hint("merge"), "id").where("label <> old")
        if moved.isEmpty():
            break
        labels = now
    ids = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("id")).distinct()
    return ids.join(labels.hint("merge"), "id", "left").select(
        F.col("id").alias(row_id), F.coalesce("label", "id").alias("component"))


def leak_free_split(rows: DataFrame, row_id: str, keys: list[Column]) -> DataFrame:
    """The rows with `component` and `split` (about 70, 15 and 15 percent of the components). A row
    without an id is a component of its own, by none, and is left out of all splits."""
    bucket = hash_bucket(F.col("component").cast("string"), "group:")
    split = F.when(bucket < 70, "train").when(bucket < 85, "validation").when(bucket < 100, "test")
    return rows.join(linked_rows(rows, row_id, keys).hint("merge"), row_id, "left").withColumn("split", split)
