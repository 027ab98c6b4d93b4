"""Drift of prompts: hashed n-gram counts before and after, with a permutation test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.cost import hash_bucket, ratio

BUCKETS, GROUPS, DRAWS = 128, 25, 99
SHARE_FLOOR = 1e-6


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def gram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the words and pairs of neighbouring words of a text."""
    words = F.filter(F.split(text, "[ \\t\\n\\r\\f\\x0b]+"), lambda x: x != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.concat(words, F.filter(pairs, lambda x: x.isNotNull()))
    return F.transform(grams, lambda g: _number(g) % buckets)


def _distance(counts: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """L1 and population stability index between the shares of two count columns."""
    whole = Window.partitionBy(*by)
    p, q = (F.coalesce(F.col(c) / F.nullif(F.sum(c).over(whole), F.lit(0)), F.lit(0.0)) for c in (a, b))
    shares = counts.withColumn("_p", p).withColumn("_q", q)
    fp, fq = (F.greatest(F.col(c), F.lit(SHARE_FLOOR)) for c in ("_p", "_q"))
    return shares.groupBy(*by).agg(F.round(F.sum(F.abs(F.col("_p") - F.col("_q"))), 8).alias("l1"),
                                   F.round(F.sum((fq - fp) * F.log(fq / fp)), 8).alias("psi"))


def prompt_drift(rows: DataFrame, keys: list[str], row_id: str, text: str, later: Column,
                 buckets: int = BUCKETS, draws: int = DRAWS, max_p: float = 0.01) -> DataFrame:
    """Per key, how far the n-gram shares of the rows before and after are apart, and how often a split
    at random is as far apart.

    Texts are never gathered: each becomes counts in `buckets`, summed per key, side and one of GROUPS
    groups that the row's id falls into. Which side a group stands for is drawn `draws` times, with as
    many groups on the later side as its share of the rows asks for; the p-value is the rank of the
    real distance among the drawn ones. So the test works on at most GROUPS * buckets counts a key.
    Rows without a text or a side are left out, rows without an id fall into one group. A key with
    rows on one side only has no p-value."""
    group = F.coalesce(hash_bucket(F.col(row_id), "drift:") % GROUPS, F.lit(0))
    sided = rows.where(F.col(text).isNotNull() & later.isNotNull()).select(
        *keys, group.alias("_g"), later.alias("_later"), F.col(text).alias("_text"))
    sizes = sided.groupBy(*keys).agg(F.count_if(~F.col("_later")).alias("before"),
                                     F.count_if("_later").alias("after"))
    counts = sided.select(*keys, "_g", "_later", F.explode(gram_buckets(F.col("_text"), buckets)).alias("_b")) \
        .groupBy(*keys, "_g", "_b").agg(F.count_if(~F.col("_later")).alias("n0"),
                                        F.count_if("_later").alias("n1"))
    real = _distance(counts.groupBy(*keys, "_b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")),
                     keys, "n0", "n1")
    spark = rows.sparkSession
    order = F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("_g").cast("string")))
    drawn = (spark.range(draws).withColumnRenamed("id", "draw")
             .withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long"))))
             .withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy(order))))
    taken = F.least(F.greatest(F.round(GROUPS * F.col("after") / (F.col("before") + F.col("after"))),
                               F.lit(1)), F.lit(GROUPS - 1))
    side = F.col("place") <= F.col("taken")
    n = F.col("n0") + F.col("n1")
    null = (counts.join(sizes.where("before > 0 and after > 0").withColumn("taken", taken), keys)
            .join(drawn, "_g").groupBy(*keys, "draw", "_b").agg(
                F.sum(F.when(side, 0).otherwise(n)).alias("n0"), F.sum(F.when(side, n).otherwise(0)).alias("n1")))
    ranks = _distance(null, [*keys, "draw"], "n0", "n1").select(*keys, F.col("l1").alias("drawn")) \
        .join(real, keys).groupBy(*keys).agg(F.count_if(F.col("drawn") >= F.col("l1")).alias("_above"))
    out = sizes.join(real, keys, "left").join(ranks, keys, "left")
    p = ratio(F.col("_above") + 1, F.lit(draws + 1), 6)
    return out.withColumn("p_value", F.when(F.col("_above").isNotNull(), p)).drop("_above") \
        .withColumn("drifted", F.coalesce(F.col("p_value") <= F.lit(max_p), F.lit(False)))
