"""Scores of structured answers: JSON documents field by field, and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.cost import ratio
from meterline.lineage import stored

_NESTED = ("OBJECT", "ARRAY")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _step(key: Column, pos: Column) -> Column:
    """What an element adds to the path: `.key`, quoted where it is no plain word, or `[pos]`."""
    quoted = F.concat(F.lit('"'), F.replace(key, F.lit('"'), F.lit('\\"')), F.lit('"'))
    named = F.when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), key).otherwise(quoted)
    return F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))) \
        .otherwise(F.concat(F.lit("."), named))


def json_leaves(docs: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, value): every value of each document that is no object or array, or an empty one,
    with its path from `$`. Numbers that are equal are spelled alike. Documents that are no JSON have
    none. One level of nesting is opened per step, until no nested value is left."""
    spark = docs.sparkSession
    level = docs.select(*keys, F.lit("$").alias("path"), F.try_parse_json(json).alias("v")) \
        .where("v is not null")
    found: list[DataFrame] = []
    while True:
        kind = _kind(F.col("v"))
        text = F.to_json("v")
        nested = kind.isin(*_NESTED) & ~text.isin("{}", "[]")
        number = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), text.cast("double").cast("string"))
        found.append(level.where(~nested).select(*keys, "path", F.coalesce(number, text).alias("value")))
        inner = level.where(nested)
        if inner.isEmpty():
            break
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(
            "pos", "key", F.col("value").alias("inner")))
        # kept as text: what is stored is read again by the next level
        texts = stored(opened.select(
            *keys, F.concat("path", _step(F.col("key"), F.col("pos"))).alias("path"),
            F.to_json("inner").alias("text")), "json-level")
        level = texts.select(*keys, "path", F.parse_json("text").alias("v"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def matched_fields(answers: DataFrame, keys: list[str], expected: str, predicted: str) -> DataFrame:
    """(keys, path, expected, predicted): a row per path that either document of a pair has. `keys`
    tell the pairs apart, so no group of the join is larger than two documents."""
    sides = [json_leaves(answers, keys, side).withColumnRenamed("value", name)
             for side, name in ((expected, "expected"), (predicted, "predicted"))]
    return sides[0].join(sides[1], [*keys, "path"], "full")


def field_accuracy(answers: DataFrame, keys: list[str], expected: str, predicted: str,
                   by: list[str] = ()) -> DataFrame:
    """Per path: pairs whose expected document has it, whose answer has it, and where both agree;
    accuracy over the expected ones. `by` are further columns among `keys` to report by."""
    fields = matched_fields(answers, keys, expected, predicted)
    out = fields.groupBy(*by, "path").agg(
        F.count("expected").alias("expected"), F.count("predicted").alias("predicted"),
        F.count_if(F.col("expected") == F.col("predicted")).alias("matches"))
    return out.withColumn("accuracy", ratio(F.col("matches"), F.col("expected"), 10))


def json_report(answers: DataFrame, keys: list[str], expected: str, predicted: str,
                by: list[str] = ()) -> DataFrame:
    """Pairs, answers that are JSON, answers with exactly the expected fields and values, and the share
    of expected fields that are right over all pairs. An expected document that is no JSON has no
    fields and is never matched exactly."""
    per_pair = matched_fields(answers, keys, expected, predicted).groupBy(*keys).agg(
        F.count_if(F.col("expected").eqNullSafe(F.col("predicted"))).alias("same"),
        F.count(F.lit(1)).alias("paths"), F.count("expected").alias("fields"))
    valid = F.try_parse_json(predicted).isNotNull()
    rows = answers.select(*keys, valid.alias("valid"),
                          F.try_parse_json(expected).isNotNull().alias("known")).join(per_pair, keys, "left")
    exact = F.col("valid") & F.col("known") & (F.col("same") == F.col("paths"))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("answers"), F.count_if("valid").alias("valid_json"),
        F.count_if(exact).alias("exact_matches"),
        F.coalesce(F.sum("fields"), F.lit(0)).alias("fields"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("right_fields"))
    return out.withColumns({
        "valid_rate": ratio(F.col("valid_json"), F.col("answers"), 10),
        "exact_rate": ratio(F.col("exact_matches"), F.col("answers"), 10),
        "field_accuracy": ratio(F.col("right_fields"), F.col("fields"), 10)})


def regression_scores(rows: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """Pairs of numbers, rows that lack one of them, mean absolute error, root mean square error and
    R². R² is null where the truth does not vary."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    whole = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    error = F.when(whole, p - y)
    out = rows.groupBy(*keys).agg(
        F.count(error).alias("samples"), F.count_if(~whole).alias("missing"),
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
        F.var_pop(F.when(whole, y)).alias("spread"))
    return out.select(
        *keys, "samples", "missing", "mae", F.sqrt("mse").alias("rmse"),
        F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).alias("r2"))
