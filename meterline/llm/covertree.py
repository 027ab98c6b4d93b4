"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Unit vectors of cosine `t` or more lie within sqrt(2 - 2t) of each other. A cover tree nests levels of
halving radii: the points below a node lie in its ball, its children's balls have half that radius, and
a node's own centre is the centre of its first child. Two nodes are walked together: if their centres
are further apart than the threshold and both covering radii, nothing below them links; if even their
furthest points are near enough, everything below them links, without a look at the pairs; otherwise
their children are compared, by one matrix product a pair of nodes.

Spark holds the upper levels. The points of a label are split by halving radii while a cell has more
than TILE of them: a bounded number of centres per cell, each taking the points in its half-radius
ball; what no centre covers stays in the cell's own ball. Cells of many points are dealt to many tasks
in chunks. In the end cells are cut into tiles of bounded size, each with a ball and a cover tree of
its own, built once. Tiles whose balls are near enough meet in pairs; a task holds one tree and streams
its partners past it. Out of a pair come the number of links per vector and a spanning forest, never the
links themselves. In data without any structure nothing can be pruned, and all pairs of tiles of a label
meet: that work is quadratic in the largest label, its memory is not.

Equal vectors of a label are one class, so copies are never paired; a class counts its size. Vectors
that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows
without a label or of different dimension. A cosine within 1e-12 of the threshold is taken again
without rounding between the products. Each row counts as a vector, so repeated rows link with each
other. Null ids never name a component unless all ids of it are null. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored
from meterline.llm.frames import components, lookup, small_batches
from meterline.llm.simhash import forest

THRESHOLD = 0.93
TILE = 2048
CENTRES = 32
LEAF = 16
TILES_PER_BLOCK = 1024
EDGES = 1 << 20
SLACK = 1e-6
SMALLEST = 1e-6


# --- the tree of a tile ----------------------------------------------------------------------

class Tree(NamedTuple):
    """A cover tree. Points stand in tree order, so a node has a run of them; the children of a node
    are a run of nodes. A leaf has no children."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The cover tree of unit vectors, from radius 2 down."""
    n = len(points)
    order = np.empty(n, np.int64)
    nodes = [[0, n, 0, 2.0, 0, 0]]
    waiting = [(0, np.arange(n), 2.0)]
    for node, members, reach in waiting:
        start = nodes[node][0]
        while len(members) > leaf and reach > SMALLEST:
            reach /= 2
            runs, rest = [], members
            while len(rest):
                far = distances(points[rest], points[rest[:1]])[:, 0]
                far[0] = 0
                near = far <= reach
                runs.append((rest[near], float(far[near].max())))
                rest = rest[~near]
            if len(runs) > 1:
                nodes[node][4:] = len(nodes), len(nodes) + len(runs)
                for run, radius in runs:
                    waiting.append((len(nodes), run, reach))
                    nodes.append([start, start + len(run), 0, radius, 0, 0])
                    start += len(run)
                break
        else:
            order[start:start + len(members)] = members
        nodes[node][2] = int(members[0])
    table = np.array(nodes, np.float64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    start, end, centre, first, last = (table[:, k].astype(np.int64) for k in (0, 1, 2, 4, 5))
    return Tree(points[order], order, start, end, place[centre], table[:, 3], first, last)


class Found:
    """Links between the points of two trees: sums of partner weights, and a spanning forest."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray]):
        self.weights, self.ids = weights, ids
        self.sums = tuple(np.zeros(len(w), np.int64) for w in weights)
        self.upto = tuple(np.concatenate([[0], np.cumsum(w)]) for w in weights)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def links(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        np.add.at(self.sums[0], a, self.weights[1][b])
        np.add.at(self.sums[1], b, self.weights[0][a])
        self.connect(self.ids[0][a], self.ids[1][b])

    def all_of(self, a: slice, b: slice, same: bool) -> None:
        """Every point of run `a` links with every one of run `b`; with `same`, both are one run."""
        total = self.upto[1][b.stop] - self.upto[1][b.start]
        x, y = self.ids[0][a], self.ids[1][b]
        if same:
            self.sums[0][a] += total - self.weights[0][a]
            self.connect(x[1:], np.full(len(x) - 1, x[0]))
            return
        self.sums[0][a] += total
        self.sums[1][b] += self.upto[0][a.stop] - self.upto[0][a.start]
        self.connect(x, np.full(len(x), y[0]))
        self.connect(y, np.full(len(y), x[0]))

    def connect(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges.append((x, y))
        self.held += len(x)
        if self.held > EDGES:
            self.edges = [self.tree()]
            self.held = 0

    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        if not sum(len(x) for x, _ in self.edges):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return forest(*(np.concatenate(x) for x in zip(*self.edges)))


def _linked(cosines: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    linked = cosines >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosines - threshold) < 1e-12)):
        linked[i, j] = math.fsum((a[i] * b[j]).tolist()) >= threshold
    return linked


def traverse(a: Tree, b: Tree, found: Found, threshold: float, same: bool) -> None:
    """Walk two trees together, from their roots; with `same`, a tree with itself."""
    reach = math.sqrt(max(2 - 2 * threshold, 0))
    waiting = [(0, 0)]
    while waiting:
        i, j = waiting.pop()
        inner = same and i == j
        if a.last[i] == 0 and b.last[j] == 0:
            x, y = a.points[a.start[i]:a.end[i]], b.points[b.start[j]:b.end[j]]
            linked = _linked(x @ y.T, x, y, threshold)
            p, q = np.nonzero(np.triu(linked, 1) if inner else linked)
            found.links(p + a.start[i], q + b.start[j])
            continue
        p = np.arange(a.first[i], a.last[i]) if a.last[i] else np.array([i])
        q = np.arange(b.first[j], b.last[j]) if b.last[j] else np.array([j])
        x, y = a.points[a.centre[p]], b.points[b.centre[q]]
        cosines = x @ y.T
        apart = np.sqrt(np.maximum(2 - 2 * cosines, 0))
        if inner:
            np.fill_diagonal(apart, 0)
        cover = a.radius[p][:, None] + b.radius[q][None, :]
        near = apart - cover <= reach + SLACK
        if inner:
            near = np.triu(near)
        single = ((a.end[p] - a.start[p]) == 1)[:, None] & ((b.end[q] - b.start[q]) == 1)[None, :]
        u, v = np.nonzero(near & single & _linked(cosines, x, y, threshold))
        other = p[u] != q[v] if inner else np.ones(len(u), bool)
        found.links(a.start[p[u[other]]], b.start[q[v[other]]])
        near &= ~single
        whole = near & (apart + cover <= reach - SLACK)
        for u, v in zip(*np.nonzero(whole)):
            found.all_of(slice(a.start[p[u]], a.end[p[u]]), slice(b.start[q[v]], b.end[q[v]]),
                         inner and u == v)
        waiting.extend(zip(*(k[at].tolist() for k, at in zip((p, q), np.nonzero(near & ~whole)))))


# --- vectors and cells -----------------------------------------------------------------------

def _unit(column: pa.Array) -> pa.Array:
    """Unit vectors as bytes of doubles; scaled by the largest component first, so that no square
    leaves the range."""
    out = []
    for v in column:
        x = np.array(v.as_py(), np.float64)
        x = x / np.abs(x).max()
        out.append((x / np.sqrt(x @ x)).tobytes())
    return pa.array(out, pa.binary())


unit = F.arrow_udf(_unit, T.BinaryType())


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _net(points: np.ndarray, reach: float) -> np.ndarray:
    """Points of which no two lie within `reach`, and which cover all within it."""
    kept: list[int] = []
    for i in range(len(points)):
        if not kept or distances(points[kept], points[i:i + 1]).min() > reach:
            kept.append(i)
    return points[kept]


def _nearest(reach: float):
    def assign(points: pa.Table, centres: pa.Table) -> pa.Table:
        if points.num_rows == 0:
            return points.select(["space", "cell", "cls", "weight", "vec"]).append_column(
                "child", pa.array([], pa.int32()))
        net = _net(_matrix(centres.sort_by("rank").column("_vec")), reach)
        far = distances(_matrix(points.column("vec")), net)
        child = np.where(far.min(axis=1) <= reach, far.argmin(axis=1), -1)
        return points.select(["space", "cell", "cls", "weight", "vec"]).append_column(
            "child", pa.array(child, pa.int32()))

    return assign


_POINT = "space string, cell long, cls long, weight long, vec binary"


def cells(points: DataFrame, threshold: float) -> DataFrame:
    """The points with their `cell`: while a cell has more than TILE points, those in the half-radius
    balls of some of its points make cells of their own. Below half the threshold's distance all
    points of a cell link, and it is left as it is."""
    reach = math.sqrt(max(2 - 2 * threshold, 0))
    key = ["space", "cell"]
    now, radius = points.withColumn("cell", F.lit(0).cast("long")), 2.0
    done: list[DataFrame] = []
    while True:
        big = stored(now.groupBy(*key).count().where(F.col("count") > TILE), "cells")
        if radius <= reach / 2 or big.isEmpty():
            break
        done.append(now.join(big, key, "left_anti"))
        large = now.join(big, key).withColumn(
            "chunk", F.expr(f"cast(pmod(xxhash64(cls, 'chunk'), ceil(count / {TILE})) as int)"))
        order = Window.partitionBy(*key).orderBy(F.xxhash64("cls"), "cls")
        centres = (large.withColumn("rank", F.row_number().over(order)).where(f"rank <= {CENTRES}")
                   .withColumn("chunk", F.explode(F.expr(
                       f"sequence(0, cast(ceil(count / {TILE}) as int) - 1)")))
                   .select(*[F.col(c).alias(f"_{c}") for c in (*key, "chunk", "vec")], "rank"))
        dealt = stored(
            large.groupBy(*key, "chunk")
            .cogroup(centres.groupBy("_space", "_cell", "_chunk"))
            .applyInArrow(_nearest(radius / 2), f"{_POINT}, child int"), "children")
        kept = stored(dealt.where("child >= 0").groupBy(*key, "child").count()
                      .where(F.col("count") >= TILE // 8).drop("count"), "kept")
        done.append(dealt.join(kept, [*key, "child"], "left_anti").drop("child"))
        now = dealt.join(kept, [*key, "child"], "left_semi").withColumn(
            "cell", F.xxhash64("cell", "child", F.lit(radius))).drop("child")
        radius /= 2
    for part in done:
        now = now.unionByName(part.select(now.columns))
    return now


_TILE = T.StructType([
    T.StructField("space", T.StringType()), T.StructField("tile", T.LongType()),
    T.StructField("ball", T.BinaryType()), T.StructField("radius", T.DoubleType()),
    T.StructField("size", T.LongType()), T.StructField("cls", T.BinaryType()),
    T.StructField("weight", T.BinaryType()), T.StructField("points", T.BinaryType()),
    T.StructField("nodes", T.BinaryType())])


def _make_tile(points: pa.Table) -> pa.Table:
    matrix = _matrix(points.column("vec"))
    tree = build(matrix)
    ball = matrix.mean(axis=0)
    radius = float(np.sqrt(((matrix - ball) ** 2).sum(axis=1).max()))
    nodes = np.stack([tree.start, tree.end, tree.centre, tree.first, tree.last,
                      tree.radius.view(np.int64)])
    in_order = lambda c: points.column(c).to_numpy()[tree.order].astype(np.int64).tobytes()
    return pa.table({
        "space": points.column("space").combine_chunks()[:1],
        "tile": pa.array([int(points.column("cls").to_numpy().min())]),
        "ball": pa.array([ball.tobytes()], pa.binary()), "radius": pa.array([radius]),
        "size": pa.array([len(matrix)]), "cls": pa.array([in_order("cls")], pa.binary()),
        "weight": pa.array([in_order("weight")], pa.binary()),
        "points": pa.array([tree.points.tobytes()], pa.binary()),
        "nodes": pa.array([nodes.tobytes()], pa.binary())})


def tiles(points: DataFrame, threshold: float) -> DataFrame:
    """A row per tile: its ball, and its cover tree with the classes and weights of its points. A
    tile is named by its smallest class."""
    split = stored(cells(points, threshold), "dealt-cells")
    parts = split.groupBy("space", "cell").count().where(F.col("count") > TILE).select(
        "space", "cell", F.ceil(F.col("count") / TILE).alias("parts"))
    part = F.expr("pmod(xxhash64(cls, 'tile'), coalesce(parts, 1))").alias("part")
    return (split.join(stored(parts, "parts"), ["space", "cell"], "left").select(*split.columns, part)
            .groupBy("space", "cell", "part").applyInArrow(_make_tile, _TILE))


# --- pairs of tiles --------------------------------------------------------------------------

def _near_tiles(reach: float):
    def pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        x, y = _matrix(left.column("ball")), _matrix(right.column("_ball"))
        apart = np.sqrt(np.maximum(
            (x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1)[None, :] - 2 * x @ y.T, 0))
        a, b = left.column("tile").to_numpy(), right.column("_tile").to_numpy()
        near = apart <= (reach + SLACK + left.column("radius").to_numpy()[:, None]
                         + right.column("_radius").to_numpy()[None, :])
        if key[1].as_py() == key[2].as_py():
            near &= a[:, None] <= b[None, :]
        u, v = np.nonzero(near)
        return pa.table([a[u], b[v]], schema=out)

    return pair


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the tiles of a space whose balls are near enough, each pair once, with itself. The
    tiles of a space are compared in blocks of some TILES_PER_BLOCK."""
    narrow = tiles.select("space", "tile", "ball", "radius")
    blocks = stored(narrow.groupBy("space").agg(
        F.ceil(F.count(F.lit(1)) / TILES_PER_BLOCK).cast("int").alias("blocks")), "tile-blocks")
    placed = narrow.join(blocks, "space").withColumn("block", F.expr("cast(pmod(xxhash64(tile), blocks) as int)"))
    left = placed.withColumn("other", F.explode(F.expr("sequence(block, blocks - 1)")))
    right = placed.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("block"))))
    right = right.select(F.col("space").alias("_space"), "first", F.col("block").alias("second"),
                         *[F.col(c).alias(f"_{c}") for c in ("tile", "ball", "radius")])
    reach = math.sqrt(max(2 - 2 * threshold, 0))
    return (left.groupBy("space", "block", "other")
            .cogroup(right.groupBy("_space", "first", "second"))
            .applyInArrow(_near_tiles(reach), "a long, b long"))


def _read_tree(row: dict) -> tuple[Tree, np.ndarray, np.ndarray]:
    ints = np.frombuffer(row["nodes"], np.int64).reshape(6, -1)
    points = np.frombuffer(row["points"], np.float64).reshape(row["size"], -1)
    tree = Tree(points, np.arange(row["size"]), ints[0], ints[1], ints[2],
                ints[5].view(np.float64), ints[3], ints[4])
    return tree, np.frombuffer(row["cls"], np.int64), np.frombuffer(row["weight"], np.int64)


def _walk(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Sorted (home, guest) rows: the first guest of a home is its own tile, which stays in memory
    while the others pass."""
    home, held = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            tree, cls, weight = _read_tree(row)
            if row["home"] != home:
                home, held = row["home"], (tree, cls, weight)
            found = Found((held[2], weight), (held[1], cls))
            traverse(held[0], tree, found, threshold, row["own"])
            some, more = ([s > 0 for s in found.sums])
            a, b = found.tree()
            who = np.concatenate([held[1][some], cls[more], a])
            n = np.concatenate([found.sums[0][some], found.sums[1][more]])
            if len(who):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who), pa.concat_arrays([pa.array(n), pa.nulls(len(a), pa.int64())]),
                     pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(b, pa.int64())])],
                    ["cls", "links", "other"])


def links(points: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links of distinct points (space, cls, weight, vec): rows (cls, links, null) that sum up to the
    weight of each point's partners, and rows (cls, null, other) that connect what links connect."""
    made = stored(tiles(points, threshold), "tiles")
    pairs = stored(tile_pairs(made, threshold), "tile-pairs")
    # a pair goes to one of its tiles, in turn, so that no tile gets all of its partners
    odd = F.expr("pmod(xxhash64(a, b), 2) = 1")
    guests = pairs.where("a <> b").select(
        F.when(odd, F.col("a")).otherwise(F.col("b")).alias("home"),
        F.when(odd, F.col("b")).otherwise(F.col("a")).alias("guest"))
    own = pairs.where("a = b").select(F.col("a").alias("home"), F.col("a").alias("guest"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    visits = (guests.unionByName(own).withColumn("own", F.expr("home = guest"))
              .join(
                  made.select(F.col("tile").alias("guest"), "size", "cls", "weight", "points", "nodes"),
                  "guest")
              .repartition(n, "home").sortWithinPartitions("home", F.desc("own")))
    return visits.mapInArrow(lambda b: _walk(b, threshold), "cls long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id",
                    vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: its id, `n_links` (rows of the same label at cosine `threshold` or more, itself left
    out), `component_id` (the smallest id that links lead to) and `kept` (whether it is its own)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0, at most 1")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).cast("string").alias("label"),
                          F.col(vector).cast("array<double>").alias("vec"))
    sound = F.expr("label is not null and size(vec) > 0 and forall(vec, x -> x is not null and not "
                   "isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    size = F.size("vec").cast("string")
    space = F.concat(F.length("label").cast("string"), F.lit(":"), F.col("label"), F.lit(":"), size)
    rows = rows.withColumn("space", F.when(sound, space)).withColumn("key", F.when(
        F.col("space").isNotNull(), F.concat(
            F.hex(F.xxhash64("space", "vec")), F.hex(F.xxhash64("vec", F.lit("second"), "space")))))
    classes = stored(
        rows.where("key is not null").groupBy("key", "space", "vec").agg(
            F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
        .select("key", "space", unit("vec").alias("vec"), "weight", "least",
                F.monotonically_increasing_id().alias("cls")), "vectors")
    found = stored(links(classes.select("space", "cls", "weight", "vec"), threshold), "links")
    sums = found.where("links is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    tree = components(found.where("other is not null").select(
        F.col("cls").alias("a"), F.col("other").alias("b")))
    members = classes.select("key", "cls", "weight", "least").join(sums, "cls", "left") \
        .join(tree.withColumnRenamed("node", "cls"), "cls", "left").select(
            "key", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "cls").alias("component"))
    members = stored(members, "members")
    roots = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = lookup(members, roots, "component").select("key", "n_links", "component_id")
    out = lookup(rows.select("id", "key"), named, "key")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
