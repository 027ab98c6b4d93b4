"""Label vocabularies, slugs, row selection and batch labelling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions.labels import (
    ALIASES, best_label_by_words, candidates, normalize_label_canonical)
from meterline.functions.text import blank_to_null, complaint_text, slugify, strip
from meterline.lineage import stored
from meterline.tables import small_table


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(blank_to_null(F.col(label).cast("string")).alias("label")) \
        .filter("label is not null").distinct()


def vocabulary(df: DataFrame, label: str) -> list[str]:
    """Sorted distinct labels on the driver, for the forms that take a label list; the forms over
    label tables bring none there."""
    return sorted(r["label"] for r in distinct_labels(df, label).collect())


def normalize_by_join(
    outputs: DataFrame, key: str, output: str, labels: DataFrame, drop_thinking: bool = False
) -> DataFrame:
    """`normalize_label` against a label table of any size. `key` is unique per output.

    Distinct candidates of one output meet the labels in an equi-join; what is shuffled back per
    output is the first hit only."""
    alias_rows = small_table(outputs.sparkSession, list(ALIASES.items()),
                             T.StructType().add("word", "string").add("label", "string"))
    words = labels.select(F.col("label").alias("word"), "label")
    aliased = alias_rows.join(labels, "label", "left_semi").select("word", "label")
    table = aliased.unionByName(words.join(aliased.select("word"), "word", "left_anti"))
    listed = outputs.select(
        key, F.posexplode(F.array_distinct(candidates(F.col(output), drop_thinking)))
        .alias("at", "word"))
    first = listed.join(table, "word").groupBy(key).agg(F.min_by("label", "at").alias("label"))
    return outputs.join(first, key, "left")


def label_outputs(
    df: DataFrame, output: str, text: str, labels: list[str], column: str = "label"
) -> DataFrame:
    """Label of each raw output: by name, else by shared words."""
    named = normalize_label_canonical(F.col(output), labels)
    return df.withColumn(column, F.coalesce(
        named, best_label_by_words(F.col(output), F.col(text), labels)))


def _number_slugs(group: pd.DataFrame) -> pd.DataFrame:
    taken: set[str] = set()
    slugs = []
    group = group.sort_values("product", ignore_index=True)
    for base in group["base"]:
        slug, number = base, 1
        while slug in taken:
            number += 1
            slug = f"{base}_{number}"
        taken.add(slug)
        slugs.append(slug)
    return pd.DataFrame({"product": group["product"], "slug": slugs})


def unique_slugs(products: DataFrame, product: str = "product") -> DataFrame:
    """One row per distinct product with a slug of its own: where a slug is taken, in product
    order, the next free of _2, _3, ... is used.

    Only slugs that agree up to their number suffix can meet, so the distinct products are numbered
    group by group of that common part."""
    distinct = products.select(F.col(product).alias("product")).distinct() \
        .withColumn("base", slugify(F.col("product")))
    root = F.regexp_replace("base", "(_[0-9]+)+$", "")
    return distinct.groupBy(root.alias("root")).applyInPandas(
        _number_slugs, "product string, slug string")


def allowed_rows(df: DataFrame, product: str, allowed: DataFrame) -> DataFrame:
    """Rows whose slug is an allowed label."""
    slugged = df.withColumn("_slug", slugify(F.col(product)))
    names = allowed.select(blank_to_null(F.col("label")).alias("_slug")).distinct()
    return slugged.join(names, "_slug", "left_semi").drop("_slug")


def succeeded(df: DataFrame) -> Column:
    status = F.coalesce(F.col("status") == "success", F.lit(False))
    http = F.coalesce(F.col("http_status") < 400, F.lit(False))
    return (status | http) & (F.length("request_id") > 0)


def skip_existing(requests: DataFrame, log: DataFrame, limit: int = 0) -> DataFrame:
    """Requests without a successful call so far, the first `limit` of them by id (0: all)."""
    done = log.filter(succeeded(log)).select("request_id").distinct()
    left = requests.join(done, "request_id", "left_anti")
    return left if limit <= 0 else left.orderBy("request_id").limit(limit)


def prepare_complaints(complaints: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Labelled requests from complaints: allowed products, slug as label, text with the reported
    issue."""
    rows = complaints if allowed is None else allowed_rows(complaints, "product", allowed)
    slugs = stored(unique_slugs(rows), "slugs")
    return rows.join(slugs, "product").withColumn(
        "text", complaint_text(F.col("narrative"), F.col("issue"), F.col("sub_product"))
    ).withColumnRenamed("slug", "expected_intent")


def clean_labelled(rows: DataFrame, text: str, label: str) -> DataFrame:
    """Trimmed text and label, rows lacking either left out."""
    return rows.withColumn(text, strip(F.col(text))).withColumn(label, strip(F.col(label))) \
        .filter((F.length(text) > 0) & (F.length(label) > 0))
