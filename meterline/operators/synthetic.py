"""Template augmentation of the training split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.cost import ratio
from meterline.functions.text import once, parse_timestamp, squeeze
from meterline.lineage import stored
from meterline.operators.ranking import latest_per_key, mark_first_n, quantile_slices
from meterline.schemas import DATASET_COLUMNS, SYNTHETIC_COLUMNS

# Text before and after the request in each of the four templates.
TEMPLATES = (
    ("Message utilisateur:\n", ""),
    ("Demande reformulee sans changer l'intention:\n", ""),
    ("", "\n\nRepondre pour la meme intention."),
    ("Contexte: requete client.\n", ""),
)


def with_synthetic_columns(dataset: DataFrame) -> DataFrame:
    defaults = {
        "is_synthetic": F.lit(False), "synthetic_parent_request_id": F.lit(None).cast("string"),
        "synthetic_method": F.lit(None).cast("string"),
        "synthetic_confidence": F.lit(None).cast("double"),
    }
    missing = {c: d for c, d in defaults.items() if c not in dataset.columns}
    return dataset.withColumns(missing) if missing else dataset


def _templated(squeezed: Column, variant: Column) -> Column:
    """Template text, NULL for an empty request."""
    before, after = (F.array(*[F.lit(x) for x in side]) for side in zip(*TEMPLATES))
    number = F.pmod(variant, F.lit(len(TEMPLATES))) + 1
    return F.when(F.length(squeezed) > 0, F.concat(
        F.element_at(before, number), squeezed, F.element_at(after, number)))


def synthetic_rows(
    dataset: DataFrame, created_at: str, multiplier: int = 2, max_ratio: float = 0.8,
    min_confidence: float = 1.0, require_validation: bool = True,
) -> DataFrame:
    """New training rows per task: whole rounds of templates over the real training rows (by time
    and id), without texts that exist already, up to the multiplier and to the share of synthetic
    rows allowed.

    Which (row, template) pairs stay is decided on hashes and ids only; texts are written once, for
    the pairs that stay. A template used a second time repeats its text, so templates beyond the
    four add nothing and are not generated."""
    if multiplier < 0:
        raise ValueError("multiplier must be >= 0")
    if not 0 <= max_ratio < 1:
        raise ValueError("max_ratio must be >= 0 and < 1")
    rows = with_synthetic_columns(dataset)
    real = rows.filter((F.col("split") == "train") & ~F.coalesce("is_synthetic", F.lit(False)))
    if require_validation:
        real = real.filter(F.length("validated_output") > 0)
    if min_confidence > 1.0 or multiplier == 0 or max_ratio == 0:
        real = real.filter(F.lit(False))
    variants = min(multiplier, len(TEMPLATES))
    keyed = real.withColumn("_row", F.sha2(F.to_json(
        F.struct("task_id", "request_id", "input_hash", "timestamp")), 256))

    pairs = keyed.select(
        "task_id", "_row", "timestamp",
        F.unix_micros(parse_timestamp(F.col("timestamp"))).alias("_when"),
        F.coalesce("request_id", F.lit("")).alias("request_id"),
        F.inline(once(squeeze(F.col("input")), lambda text: F.array(*[F.struct(
            F.lit(v).alias("_variant"), F.sha2(_templated(text, F.lit(v)), 256).alias("_hash"))
            for v in range(max(variants, 1))]))),
    ).filter("_hash is not null")
    known = real.select("task_id", F.sha2("input", 256).alias("_hash")).distinct()
    order = ["_variant", "_when", "timestamp", "request_id", "_row"]
    fresh = stored(latest_per_key(
        pairs, [F.col("task_id"), F.col("_hash")], [F.asc(c) for c in order]
    ).join(known, ["task_id", "_hash"], "left_anti"), "fresh")

    n = F.col("_n").cast("double")
    by_share = F.floor((n * F.lit(float(max_ratio))) / F.lit(1 - float(max_ratio)))
    targets = stored(real.groupBy("task_id").agg(F.count(F.lit(1)).alias("_n")).select(
        "task_id", F.least(F.col("_n") * multiplier, by_share).cast("long").alias("_target")),
        "targets")
    when = F.col("_when")
    slice_no = F.col("_variant") * 1000 + F.when(when.isNull(), 0).otherwise(
        quantile_slices(fresh, when))
    chosen = mark_first_n(fresh.join(targets, "task_id"), ["task_id"], order, slice_no, "_target",
                          "_in").filter("_in").select("task_id", "_row", "_variant")

    method = F.concat(F.lit("local_template_"), F.pmod("_variant", F.lit(len(TEMPLATES))))
    parent = F.coalesce(F.nullif("request_id", F.lit("")), "input_hash", F.lit("0"))
    return (
        keyed.join(chosen, ["task_id", "_row"])
        .withColumn("_parent", F.col("request_id")).withColumn("request_id", F.concat(
            parent, F.lit(":synthetic:"), F.col("_variant").cast("string")))
        .withColumn("input", once(
            squeeze(F.col("input")), lambda text: _templated(text, F.col("_variant"))))
        .withColumns({
            "teacher_output": F.col("validated_output"),
            "input_hash": F.sha2("input", 256),
            "timestamp": F.lit(created_at),
            "routing_decision": F.lit("synthetic"),
            "routing_reason": F.lit("local_template_augmentation"),
            "estimated_cost_usd": F.lit(0.0),
            "estimated_teacher_cost_usd": F.lit(0.0),
            "estimated_savings_usd": F.lit(0.0),
            "is_synthetic": F.lit(True),
            "synthetic_parent_request_id": F.col("_parent"),
            "synthetic_method": method,
            "synthetic_confidence": F.lit(1.0),
        }).select(*DATASET_COLUMNS, *SYNTHETIC_COLUMNS)
    )


def augment(dataset: DataFrame, created_at: str, **options) -> DataFrame:
    """The dataset with its synthetic training rows; validation and test stay real."""
    return with_synthetic_columns(dataset).select(*DATASET_COLUMNS, *SYNTHETIC_COLUMNS) \
        .unionByName(synthetic_rows(dataset, created_at, **options))


def synthetic_manifest(augmented: DataFrame) -> DataFrame:
    made = F.coalesce("is_synthetic", F.lit(False))
    counted = augmented.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_samples")
          for s in ("train", "validation", "test")],
        F.count_if(~made).alias("real_samples"), F.count_if(made).alias("synthetic_samples"))
    return counted.withColumn(
        "synthetic_ratio", ratio(F.col("synthetic_samples"), F.col("samples"), None))
