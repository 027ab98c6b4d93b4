"""Prefix trie of conversations, by collapsing whole sequences.

Conversations are rebuilt first: the opening turns come from the first conversation of their hundred.
Identical rebuilt conversations become one sequence with a weight and a list of the conversations that
end there. Sequences that are a proper prefix of another one are found by an anti-join; the others are
the leaves. A node is a distinct prefix; its figures are the weights, leaves and savings of the
sequences that pass through it, added up per prefix.

Only numbers and 16-byte hashes move: a turn's text is read once. A prefix is named by running sums of
hashes of (place, turn) in two lanes, so a conversation of any length is summed in slices of SLICE
turns that go to different tasks, and copies of a turn or of a conversation are collapsed where they
are read. Savings below a node are added along one carrier per node, the sequence of its smallest
member, from the end of the sequence up, and then per prefix. The list of a node's ends is hashed as a
stream of ordered pieces.

Turns are ordered by `turn`, null first, equal ones by a hash of role and text; repeated rows are turns
of their own. A null role or text is empty; rows without a conversation id belong to no conversation
and are left out. `id % 100` is the remainder with the sign of the id. Texts of any length count whole.
Other columns are not read, so they cannot clash. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.lineage import stored
from meterline.llm.frames import lookup

HUNDRED, OPENINGS = 100, 6
SLICE = 4096
IDS_PER_PIECE = 8192
NOTHING = hashlib.sha256(b"").hexdigest()


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- places in a conversation ----------------------------------------------------------------

def _local_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row in its conversation, counted within this sorted partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, before = None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        n = len(conv)
        if n == 0:
            continue
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        run = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        place = np.arange(n) - run + 1
        if conv[0] == last:
            place[run == 0] += before
        last, before = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn_hash"), batch.column("n_chars"),
             pa.array(place, pa.int64()), pa.array(np.full(n, part), pa.int32())],
            ["conv_id", "turn_hash", "n_chars", "place", "part"])


def places(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, n_chars) of every turn; places start at 1.

    Rows are dealt by ranges of (conversation, turn, hash), so a long conversation lies in several
    partitions; its places there are counted on from the partitions before."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = stored(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
        .alias("turn_hash"),
        F.length(text).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("uid")), "turns")
    order = ["conv_id", F.asc_nulls_first("turn"), "turn_hash", "uid"]
    local = stored(
        turns.repartitionByRange(_partitions(turns), *order).sortWithinPartitions(*order)
        .mapInArrow(_local_places, "conv_id long, turn_hash binary, n_chars long, place long, part int"),
        "places")
    several = local.where("place = 1").groupBy("conv_id").count().where("count > 1")
    ends = (local.join(several.select("conv_id"), "conv_id", "left_semi")
            .groupBy("conv_id", "part").agg(F.max("place").alias("n")))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(ends.select("conv_id", "part", before.alias("before"))
                     .where("before is not null"), "offsets")
    return local.join(offsets, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"),
        "turn_hash", "n_chars")


def opening_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations as (conv_id, place, turn_hash, n_chars, n_turns), and all
    conversations as (conv_id, n_turns), also those without a turn."""
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    firsts = sizes.where(f"conv_id % {HUNDRED} = 0").select(
        F.col("conv_id").alias("first"), F.col("own").alias("first_size"))
    convs = sizes.withColumn("h", opening_turns(F.col("conv_id"))) \
        .withColumn("first", F.col("conv_id") - F.col("conv_id") % HUNDRED) \
        .join(firsts, "first", "left") \
        .withColumn("taken", F.least("h", F.coalesce("first_size", F.lit(0)))) \
        .withColumn("n_turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))) \
        .select("conv_id", "first", "h", "taken", "n_turns")
    convs = stored(convs, "conversations")
    opening = turns.where(f"place < {OPENINGS} and conv_id % {HUNDRED} = 0") \
        .withColumnRenamed("conv_id", "first").join(convs, "first").where("place <= taken") \
        .select("conv_id", "place", "turn_hash", "n_chars", "n_turns")
    rest = turns.join(convs, "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_hash",
        "n_chars", "n_turns")
    return opening.unionByName(rest), convs.select("conv_id", "n_turns")


def running(rows: DataFrame, key: str, place: str, size: str, sums: dict[str, str]) -> DataFrame:
    """Running sums along `place` within `key`, for columns {sum: value}. `size` is the greatest
    place of the key. A key's rows are summed in slices of SLICE places."""
    sliced = rows.withColumn("_slice", F.floor((F.col(place) - 1) / F.lit(SLICE)))
    local = Window.partitionBy(key, "_slice").orderBy(place) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.where(F.col(size) > SLICE).groupBy(key, "_slice")
               .agg(*[F.sum(v).alias(s) for s, v in sums.items()])
               .select(key, "_slice", *[F.sum(s).over(before).alias(f"_{s}") for s in sums])
               .where("_slice > 0"))
    offsets = stored(offsets, "slices")
    out = sliced.withColumns({s: F.sum(v).over(local) for s, v in sums.items()})
    return out.join(offsets, [key, "_slice"], "left").withColumns(
        {s: F.col(s) + F.coalesce(F.col(f"_{s}"), F.lit(0)) for s in sums}) \
        .drop("_slice", *[f"_{s}" for s in sums])


def _name(place: Column, one: Column, two: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", place, one, two)))


def _root() -> Column:
    return _name(F.lit(0), F.lit(0), F.lit(0))


def named_prefixes(turns: DataFrame) -> DataFrame:
    """The rows of `rebuilt` with `node`, the name of the prefix that ends at the turn, and
    `parent`, that of the prefix before it."""
    lanes = turns.withColumns({
        "_a": F.xxhash64("place", "turn_hash").cast("decimal(38,0)"),
        "_b": F.xxhash64("turn_hash", F.lit("second"), "place").cast("decimal(38,0)")})
    summed = running(lanes, "conv_id", "place", "n_turns", {"_sa": "_a", "_sb": "_b"})
    whole = lambda c: c.cast("decimal(38,0)")
    return summed.select(
        "conv_id", "place", "n_chars", "n_turns",
        _name(F.col("place"), whole(F.col("_sa")), whole(F.col("_sb"))).alias("node"),
        _name(F.col("place") - 1, whole(F.col("_sa") - F.col("_a")),
              whole(F.col("_sb") - F.col("_b"))).alias("parent"))


# --- lists of ends ---------------------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as comma-joined pieces of one node and at most `most` ids each."""
    for batch in batches:
        node = batch.column("node").to_pylist()
        conv = batch.column("conv_id").to_pylist()
        out: list[tuple[bytes, int, str]] = []
        i = 0
        while i < len(node):
            j = i + 1
            while j < len(node) and node[j] == node[i] and j - i < most:
                j += 1
            out.append((node[i], conv[i], ",".join(map(str, conv[i:j]))))
            i = j
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))],
                ["node", "least", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its pieces, which come in order."""
    last, digest = None, hashlib.sha256()
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != last:
                if last is not None:
                    out.append((last, digest.hexdigest()))
                last, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)],
                                             ["node", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) over the ids of the conversations that end at each node, ascending.
    Conversations that end at one node are cut into ordered pieces in many tasks; one task then
    streams the pieces."""
    n, most = _partitions(ends), IDS_PER_PIECE
    pieces = (ends.select("node", "conv_id").repartitionByRange(n, "node", "conv_id")
              .sortWithinPartitions("node", "conv_id")
              .mapInArrow(lambda b: _pieces(b, most), "node binary, least long, ids string"))
    return (pieces.repartition(n, "node").sortWithinPartitions("node", "least")
            .mapInArrow(_digests, "node binary, ends_sha256 string"))


# --- the trie --------------------------------------------------------------------------------

def _savings_below(body: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, saved_tokens): savings of the nodes that hang on a carrier, from its end up to each
    prefix; a node's subtree is the sum of its rows. Only shared nodes save."""
    own = nodes.where("n_convs > 1 and depth > 0").select(
        "conv_id", F.col("depth").alias("place"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("own"))
    own = stored(own, "savings")
    deepest = own.groupBy("conv_id").agg(F.max("place").alias("deepest"))
    carriers = body.join(deepest, "conv_id").where("place <= deepest") \
        .join(own, ["conv_id", "place"], "left").select(
            "conv_id", "node", "deepest", F.coalesce("own", F.lit(0)).alias("own"),
            (F.col("deepest") - F.col("place") + 1).alias("up"))
    below = running(carriers, "conv_id", "up", "deepest", {"saved_tokens": "own"})
    whole = own.agg(F.sum("own").alias("saved_tokens")).where("saved_tokens is not null")
    return below.select("node", "saved_tokens").unionByName(whole.select(
        _root().alias("node"), "saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node: `conv_id` (its smallest member), `depth`, `parent_conv_id`, `n_convs`,
    `n_children`, `n_leaves`, `saved_tokens` of its subtree, and `ends_sha256`."""
    turns, convs = rebuilt(stored(places(conversations), "ordered"))
    named = stored(named_prefixes(turns), "prefixes")
    ends = named.where("place = n_turns").select("conv_id", "node", "n_turns").unionByName(
        convs.where("n_turns = 0").select("conv_id", _root().alias("node"), "n_turns"))
    sequences = stored(ends.groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"),
        F.max("n_turns").alias("n_turns")), "sequences")
    # the smallest conversation of a sequence stands for all that are identical
    body = stored(named.drop("n_turns").join(
        sequences.select("conv_id", "weight", "n_turns"), "conv_id"), "bodies")
    proper = body.where("place < n_turns").select("node").unionByName(
        sequences.where("n_turns > 0").select(_root().alias("node"))).distinct()
    leaves = sequences.join(proper, "node", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    leaf = F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")
    through = body.join(leaves, "conv_id", "left").select(
        "node", "parent", "conv_id", F.col("place").alias("depth"), "n_chars", "weight", leaf)
    at_root = sequences.drop("node").join(leaves, "conv_id", "left").select(
        _root().alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id",
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_chars"), "weight", leaf)
    nodes = stored(through.unionByName(at_root).groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"), F.max("n_chars").alias("n_chars"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves")), "nodes")
    figures = nodes.select("node", "parent", "conv_id", "depth", "n_convs", "n_leaves")
    for more in (
            nodes.where("parent is not null").select(
                F.col("parent").alias("node"), F.lit(1).cast("long").alias("n_children")),
            _savings_below(body, nodes), end_digests(ends)):
        figures = figures.unionByName(more, allowMissingColumns=True)
    figures = stored(figures.groupBy("node").agg(
        *[F.max(c).alias(c) for c in ("parent", "conv_id", "depth", "n_convs", "n_leaves")],
        F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.lit(NOTHING)).alias("ends_sha256")), "figures")
    parents = figures.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return lookup(figures, parents, "parent").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256")
