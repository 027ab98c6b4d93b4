"""Exact "first n rows per key" when one key may hold a large part of all rows.

`row_number() over (partition by key order by ...)` sends a whole key to one task. A quota only
needs to know where the quota runs out, so the key is cut into slices along its order, the slices
are counted (partial aggregation, a few rows per key), and only the one slice in which the quota
runs out is ranked. What comes out is one cut-off value per key; the wide table meets it in a
single join and is never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.lineage import stored

SLICES = 64


def quantile_slices(df: DataFrame, position: Column, n: int = SLICES) -> Column:
    """Slice number of `position`, from approximate quantiles of the whole frame.

    The bounds only balance the work: any bounds give the same final result. At most `n` numbers
    come to the driver."""
    steps = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = df.select(position.alias("p")).agg(F.percentile_approx("p", steps, 1000)).first()[0]
    if not bounds:
        return F.lit(0)
    marks = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    return F.size(F.filter(marks, lambda b: b <= position))


def latest_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """First row per key. Written as `row_number() = 1`, which Catalyst also applies before the
    shuffle (WindowGroupLimit), so each task sends at most one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def cutoffs(
    df: DataFrame, keys: list[str], order: list[str], slice_no: Column, quota: str
) -> DataFrame:
    """One row per key that exceeds its quota: the keys and `_cut`, the last order value inside.

    `slice_no` must not decrease along `order`; `order` must be unique within a key. Ranked
    together are at most the rows of one key in one slice, as narrow as key and order."""
    narrow = df.filter(F.col(quota).isNotNull()).select(
        *keys, F.struct(*order).alias("_ord"), F.col(quota).alias("_quota"),
        slice_no.alias("_slice"),
    )
    per_slice = narrow.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_quota").alias("_quota"))
    running = Window.partitionBy(*keys).orderBy("_slice") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    boundary = (
        per_slice.withColumn("_cum", F.sum("_n").over(running))
        .filter((F.col("_cum") >= F.col("_quota")) & (F.col("_cum") - F.col("_n") < F.col("_quota")))
        .select(*keys, "_slice", (F.col("_quota") - F.col("_cum") + F.col("_n")).alias("_left"))
    )
    in_boundary = narrow.drop("_quota").join(boundary, [*keys, "_slice"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("_ord"))
    return (
        in_boundary.withColumn("_rn", rank).filter(F.col("_rn") == F.col("_left"))
        .select(*keys, F.col("_ord").alias("_cut"))
    )


def mark_first_n(
    df: DataFrame, keys: list[str], order: list[str], slice_no: Column, quota: str, flag: str
) -> DataFrame:
    """Add `flag`: the row is among the first `quota` of its key (NULL quota: no limit).

    The cut-offs are computed before use: their size then decides how they are joined, and a second
    quota on top of the flag does not compute the first one again."""
    cut = stored(cutoffs(df, keys, order, slice_no, quota), "cutoffs")
    inside = (
        F.when(F.col(quota).isNull(), F.lit(True))
        .when(F.col(quota) <= 0, F.lit(False))
        .otherwise(F.col("_cut").isNull() | (F.struct(*order) <= F.col("_cut")))
    )
    return df.join(cut, keys, "left").withColumn(flag, inside).drop("_cut")
