"""Exact k nearest neighbours by cosine over unit vectors, and the label vote on top.

No pair of a query and a reference is ever a row. References are cut into tiles around pivots; a
query goes only to tiles that can hold one of its k nearest (triangle inequality, so nothing is
lost), and per (tile, part of the queries) one matrix product in a task returns k rows a query.
Tiles and query parts have a bounded number of rows however the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.lineage import stored

TILE_ROWS = 4096
QUERY_PART_ROWS = 16384
MAX_PIVOTS = 256
# Scores whose maximum stands for them when the best are looked for.
BLOCK = 16
# Added to distance bounds: vectors stored as floats are unit vectors only up to rounding.
SLACK = 1e-3


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (vectors ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] \
        - 2.0 * vectors @ pivots.T
    return np.sqrt(np.maximum(squared, 0.0))


def _pivots(refs: DataFrame, n_refs: int) -> np.ndarray:
    n = max(1, min(MAX_PIVOTS, int(np.ceil(np.sqrt(n_refs)))))
    rows = refs.select("ref_id", "ref_vector").orderBy(F.xxhash64("ref_id"), "ref_id").limit(n)
    return np.array([r["ref_vector"] for r in rows.collect()], dtype=np.float64)


def _with_cells(refs: DataFrame, pivots: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            distance = _distances(_matrix(batch["ref_vector"]), pivots)
            nearest = distance.argmin(axis=1)
            yield batch.assign(cell=nearest.astype("int32"),
                               reach=distance[np.arange(len(batch)), nearest])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in refs.schema.fields)
    return refs.mapInPandas(assign, f"{fields}, cell int, reach double")


def _candidate_tiles(
    queries: DataFrame, pivots: np.ndarray, tiles: pd.DataFrame, k: int
) -> DataFrame:
    cell = tiles["cell"].to_numpy()
    nearest, farthest = tiles["nearest"].to_numpy(), tiles["farthest"].to_numpy()
    size, number = tiles["n"].to_numpy(), tiles["tile"].to_numpy()

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            to_pivots = _distances(_matrix(batch["query_vector"]), pivots)
            chosen = []
            for distance in to_pivots:
                to_pivot = distance[cell]
                upper = to_pivot + farthest
                lower = np.maximum(to_pivot - farthest, nearest - to_pivot)
                by_upper = np.argsort(upper, kind="stable")
                enough = np.searchsorted(np.cumsum(size[by_upper]), k)
                reach = upper[by_upper[min(enough, len(by_upper) - 1)]]
                chosen.append(number[lower <= reach + SLACK])
            yield pd.DataFrame({"query_id": batch["query_id"], "tile": chosen})

    id_type = dict(queries.dtypes)["query_id"]
    return queries.mapInPandas(choose, f"query_id {id_type}, tile array<long>") \
        .withColumn("tile", F.explode("tile"))


def _best_of_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k highest scores of each row, best first, the first column on a tie. The
    k-th highest of the maxima of blocks is no higher than the k-th score, so what is below it is left out
    without being ordered."""
    blocks = scores.shape[1] // BLOCK
    if blocks >= k:
        maxima = scores[:, :blocks * BLOCK].reshape(len(scores), blocks, BLOCK).max(axis=2)
        least = np.partition(maxima, blocks - k, axis=1)[:, blocks - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _best_of_tile(k: int):
    def best(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "ref_id", "ref_label", "score"]
        if len(queries) == 0 or len(refs) == 0:
            return pd.DataFrame(columns=columns)
        refs = refs.sort_values("ref_id", ignore_index=True)
        vectors = _matrix(refs["ref_vector"])
        take = min(k, len(refs))
        parts = []
        for start in range(0, len(queries), 1024):
            part = queries.iloc[start:start + 1024]
            scores = _matrix(part["query_vector"]) @ vectors.T
            row, column = _best_of_rows(scores, take)
            parts.append(pd.DataFrame({
                "query_id": part["query_id"].to_numpy()[row],
                "ref_id": refs["ref_id"].to_numpy()[column],
                "ref_label": refs["ref_label"].to_numpy()[column],
                "score": scores[row, column],
            }))
        return pd.concat(parts, ignore_index=True)[columns]

    return best


def nearest_references(queries: DataFrame, refs: DataFrame, k: int = 5) -> DataFrame:
    """The k best references of every query: query_id, ref_id, ref_label, score, rank.

    `queries` has a unique query_id and query_vector; `refs` has ref_id, ref_vector and ref_label;
    vectors have length 1. Ties go to the smaller ref_id."""
    n_refs = refs.count()
    id_type = dict(queries.dtypes)["query_id"]
    ref_type, label_type = dict(refs.dtypes)["ref_id"], dict(refs.dtypes)["ref_label"]
    schema = f"query_id {id_type}, ref_id {ref_type}, ref_label {label_type}, score double"
    if n_refs == 0:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    pivots = _pivots(refs, n_refs)
    celled = stored(_with_cells(refs, pivots), "cells")
    # A cell larger than a tile is spread over several tiles.
    parts = stored(celled.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(TILE_ROWS)).alias("parts")), "parts")
    tiled = celled.join(parts, "cell").withColumn(
        "tile", F.col("cell").cast("long") * F.lit(1 << 32)
        + F.pmod(F.xxhash64("ref_id"), F.col("parts"))).drop("parts")
    # To the driver comes one row of five numbers per tile, never a vector.
    tiles = tiled.groupBy("tile", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("reach").alias("nearest"),
        F.max("reach").alias("farthest")).toPandas()
    asked = stored(_candidate_tiles(queries, pivots, tiles, k), "asked")
    query_parts = stored(asked.groupBy("tile").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(QUERY_PART_ROWS)).alias("parts")), "parts")
    left = asked.join(query_parts, "tile").join(queries, "query_id").withColumn(
        "part", F.pmod(F.xxhash64("query_id"), F.col("parts"))) \
        .select("tile", "part", "query_id", "query_vector")
    right = tiled.join(query_parts, "tile").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))) \
        .select("tile", "part", "ref_id", "ref_vector", "ref_label")
    found = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")) \
        .applyInPandas(_best_of_tile(k), schema)
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ref_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def vote(neighbours: DataFrame) -> DataFrame:
    """Label with most votes among the neighbours, by best score (never below 0), then by name."""
    per_label = neighbours.groupBy("query_id", F.col("ref_label").alias("label")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.greatest(F.max("score"), F.lit(0.0)).alias("confidence"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(
        F.desc("votes"), F.desc("confidence"), F.asc("label")))
    return per_label.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def label_by_neighbours(queries: DataFrame, refs: DataFrame, k: int = 5) -> DataFrame:
    return vote(nearest_references(queries, refs, k))
