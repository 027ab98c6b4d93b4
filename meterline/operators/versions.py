"""Dataset versions: content hashes that do not depend on the order of rows, and what changed.

A row is spelled as its fields, each with its length in front and null as a mark of its own, so no
two different rows are spelled alike. A version is a tree of two levels: rows fall into leaves by the
hash of their key, leaves into branches; the hash of a node is the sum of its rows' digests in four
lanes, as decimals that cannot overflow. Two versions are compared from the top, and only rows of
leaves that differ meet in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.lineage import stored

LANES = 4


def spelled(columns: list[Column]) -> Column:
    """The fields of a row in one text that tells them apart: `length:text`, or `-` for null."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                      for t in texts])


def _lanes(digest: Column) -> list[Column]:
    return [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)"))
            .cast("decimal(38,0)").alias(f"_l{i}") for i in range(LANES)]


def _joined() -> Column:
    return F.concat_ws("-", *[F.col(f"_l{i}").cast("string") for i in range(LANES)])


def dataset_version(dataset: DataFrame, columns: list[str], by: list[str] = ["task_id"]) -> DataFrame:
    """Per task, rows and the content hash over `columns`."""
    digest = F.md5(spelled([F.col(c) for c in columns]))
    return dataset.withColumn("_digest", digest).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *_lanes(F.col("_digest"))).select(
        *by, "rows", _joined().alias("content_hash"))


def version_tree(dataset: DataFrame, key: list[str], columns: list[str], by: list[str] = ["task_id"]
                 ) -> DataFrame:
    """(by, level, bucket, rows, hash): the leaves (two hex digits of the key's hash), the branches
    (one), and the root (none) of each task's version."""
    place = F.md5(spelled([F.col(c) for c in key]))
    digest = F.md5(spelled([F.col(c) for c in (*key, *columns)]))
    leaves = stored(
        dataset.select(*by, F.substring(place, 1, 2).alias("bucket"), digest.alias("_digest"))
        .groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("rows"), *_lanes(F.col("_digest"))),
        "version-leaves")
    found = None
    for level, size in ((2, 2), (1, 1), (0, 0)):
        rolled = leaves.withColumn("bucket", F.substring("bucket", 1, size)).groupBy(*by, "bucket").agg(
            F.sum("rows").alias("rows"), *[F.sum(f"_l{i}").cast("decimal(38,0)").alias(f"_l{i}")
                                           for i in range(LANES)])
        part = rolled.select(*by, F.lit(level).alias("level"), "bucket", "rows", _joined().alias("hash"))
        found = part if found is None else found.unionByName(part)
    return found


def changed_buckets(old: DataFrame, new: DataFrame, by: list[str] = ["task_id"]) -> DataFrame:
    """Leaves of two trees that differ, found from the root down: a level is compared only below nodes
    that differ."""
    below = None
    for level in (0, 1, 2):
        a, b = (t.where(F.col("level") == level).select(*by, "bucket", F.col("hash").alias(n))
                for t, n in ((old, "a"), (new, "b")))
        if below is not None:
            up = below.select(*by, F.col("bucket").alias("_up"))
            a, b = (t.withColumn("_up", F.substring("bucket", 1, level - 1))
                    .join(up, [*by, "_up"], "left_semi").drop("_up") for t in (a, b))
        below = stored(a.join(b, [*by, "bucket"], "full").where("not (a <=> b)")
                       .select(*by, "bucket"), "changed")
    return below


def version_changes(old: DataFrame, new: DataFrame, key: list[str], columns: list[str],
                    by: list[str] = ["task_id"]) -> DataFrame:
    """(by, key, change): keys that were added, removed or changed between two versions. Repeated keys
    count as one row each side, changed if the multiset of their rows differs. Task and key may be
    null."""
    buckets = changed_buckets(version_tree(old, key, columns, by), version_tree(new, key, columns, by), by)
    place = F.substring(F.md5(spelled([F.col(c) for c in key])), 1, 2)
    digest = F.md5(spelled([F.col(c) for c in columns]))
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    sides = []
    for side in (old, new):
        placed = side.withColumn("bucket", place).alias("r")
        kept = placed.join(buckets.alias("c"), same("r", "c", [*by, "bucket"]), "left_semi")
        sides.append(kept.withColumn("_digest", digest).groupBy(*by, *key).agg(
            F.count(F.lit(1)).alias("n"), *_lanes(F.col("_digest")))
            .select(*by, *key, F.concat_ws("/", F.col("n").cast("string"), _joined()).alias("content")))
    a, b = sides[0].alias("a"), sides[1].alias("b")
    joined = a.join(b, same("a", "b", [*by, *key]), "full")
    change = F.when(F.col("a.content").isNull(), "added").when(F.col("b.content").isNull(), "removed") \
        .when(F.col("a.content") != F.col("b.content"), "changed")
    return joined.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in (*by, *key)],
                         change.alias("change")).where("change is not null")
