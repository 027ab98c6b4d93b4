"""Near-repeated inputs per task: MinHash signatures with banding, verified on whole shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions.cost import ratio
from meterline.functions.text import once
from meterline.lineage import stored

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
_SEEDS = np.random.default_rng(977).integers(1, 1 << 62, (2, BANDS * ROWS)).astype(np.uint64)


def shingles(text: Column, words: int = WORDS) -> Column:
    """Distinct hashes of the runs of `words` words of a text, ascending; a shorter text is one run, a
    text without words none."""
    split = F.filter(F.split(text, "[ \\t\\n\\r\\f\\x0b]+"), lambda x: x != "")

    def runs(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - words + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(parts, i, words), " ")))

    # the outer transform names the words, so that they are split off once and not once per run
    hashes = F.transform(F.array(split), runs)[0]
    return F.when(text.rlike("[^ \\t\\n\\r\\f\\x0b]"), F.array_sort(F.array_distinct(hashes)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def signature(sets: pa.Array) -> pa.Array:
    """MinHash per set: the least of each of BANDS * ROWS mixed orders of its hashes."""
    out = []
    for values in sets:
        x = np.array(values.as_py() or [], np.int64).view(np.uint64)
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 4096):
            mixed = (x[i:i + 4096, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
        out.append(low.view(np.int64) if len(x) else None)
    return pa.array(out, pa.list_(pa.int64()))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The stored pairs (a, b) whose sets are similar enough. Only sets that a pair names are shuffled."""
    named = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    some = stored(sets.join(named, "uid", "left_semi").select("uid", "task", "set"), "named")
    a, b = (some.select(F.col("uid").alias(n), F.struct("task", "set").alias(f"_{n}")) for n in ("a", "b"))

    def alike(x: Column, y: Column) -> Column:
        return once(F.size(F.array_intersect(x["set"], y["set"])),
                    lambda both: both / (F.size(x["set"]) + F.size(y["set"]) - both)) >= similarity

    return pairs.join(a, "a").join(b, "b").where(
        F.col("_a.task").eqNullSafe(F.col("_b.task")) & alike(F.col("_a"), F.col("_b"))).select("a", "b")


def near_repeats(inputs: DataFrame, task: str, input_id: str, text: str,
                 similarity: float = SIMILARITY) -> DataFrame:
    """(task, id) of the inputs that have another input of the task at `similarity` or more. `inputs`
    has a row per distinct input; rows without text have no partner.

    Inputs of one band value are compared with the smallest of them first, which settles a large group
    of near copies with a row per member; the ones that are left are then compared with all members
    of their bands. Sets whose sizes alone are too far apart are not compared. Candidates miss a pair of
    similarity s with probability (1 - s^ROWS)^BANDS, 0.0002 at 0.8; what is found is exact. Until the end
    an input is known by a number, so that a band entry is three numbers."""
    bands = F.array(*[F.xxhash64("task", F.lit(i), F.slice("sig", i * ROWS + 1, ROWS)) for i in range(BANDS)])
    sets = stored(
        inputs.select(F.col(task).alias("task"), F.col(input_id).alias("id"), shingles(F.col(text)).alias("set"))
        .where("set is not null").withColumn("sig", signature("set"))
        .select("task", "id", "set", bands.alias("bands"), F.monotonically_increasing_id().alias("uid")), "shingles")
    entries = sets.select("uid", F.size("set").alias("size"), F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(
        F.min(F.struct("uid", "size")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    entries = stored(entries.join(shared, "band"), "bands")

    def close(one: Column, other: Column) -> Column:
        return F.least(one, other) >= F.greatest(one, other) * F.lit(similarity) * F.lit(1 - 1e-9)

    pairs = stored(entries.where((F.col("uid") != F.col("least.uid")) & close(F.col("size"), F.col("least.size"))) \
        .select(F.col("uid").alias("a"), F.col("least.uid").alias("b")).distinct(), "pairs")
    found = stored(_verified(pairs, sets, similarity), "near")
    done = found.select(F.col("a").alias("uid")).unionByName(found.select(F.col("b").alias("uid"))).distinct()
    left = entries.join(done, "uid", "left_anti").select("band", F.col("uid").alias("a"), F.col("size").alias("n_a"))
    rest = left.join(entries.select("band", F.col("uid").alias("b"), F.col("size").alias("n_b")), "band") \
        .where((F.col("a") != F.col("b")) & close(F.col("n_a"), F.col("n_b"))) \
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct() \
        .join(pairs, ["a", "b"], "left_anti")  # those were compared above
    more = _verified(stored(rest, "pairs"), sets, similarity)
    uids = done.unionByName(more.select(F.col("a").alias("uid"))).unionByName(
        more.select(F.col("b").alias("uid"))).distinct()
    return sets.select("task", "id", "uid").join(uids, "uid", "left_semi").drop("uid")


def near_repetitive_tasks(logs: DataFrame, text: str = "prompt_redacted", min_share: float = 0.05,
                          similarity: float = SIMILARITY) -> DataFrame:
    """Per task: requests, distinct inputs, inputs with a near copy, and the share of requests whose
    input comes again, exactly or nearly. Requests without an input do not count."""
    known = logs.where(F.col("input_hash").isNotNull())
    # Grouped twice, with the texts and without: the texts are never written, only their shingles.
    inputs = known.groupBy("task_id", "input_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(text).alias("text")).withColumn(
            "id", F.sha2(F.concat_ws(":", F.coalesce("task_id", F.lit("")), "input_hash"), 256))
    near = near_repeats(inputs, "task_id", "id", "text", similarity).select("id", F.lit(1).alias("near"))
    marked = inputs.join(near, "id", "left")
    again = F.col("near").isNotNull() | (F.col("n") > 1)
    out = marked.groupBy("task_id").agg(
        F.sum("n").alias("requests"), F.count(F.lit(1)).alias("inputs"),
        F.count("near").alias("near_inputs"),
        F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("repeated_requests"))
    share = ratio(F.col("repeated_requests"), F.col("requests"), 6)
    return out.withColumn("repeated_share", share).withColumn(
        "repetitive", F.col("repeated_share") >= min_share)
