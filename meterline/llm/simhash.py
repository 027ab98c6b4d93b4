"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at `radius` or fewer differing bits differ by
at most `radius // segments` bits in one segment. Every fingerprint stands in a table under the
value of each segment, and asks each table for all values in the small Hamming ball around its own
segment; of two values one bit apart only the one that has the bit set asks. What a table returns is
verified on the whole fingerprint. Equal fingerprints are one class, so copies are never paired.

A table entry (segment, value) with very many fingerprints is split into chunks that its queries
visit one by one; within a chunk the queries stream past the entries, and only a spanning forest of
the links found leaves the task.

Null and empty texts have fingerprint zero. Repeated rows share a class. Null ids never name a
component unless all ids of it are null. Ties in `keep_one` go to the smallest id, then to the first
copy written. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored
from meterline.llm.frames import components, small_batches
from meterline.llm.words import LOWER, text_bytes

SHINGLE, SEED, RADIUS = 4, 42, 4
CHUNK = 8192
PAIRS = 1 << 20
_LOWER = LOWER.tobytes()


def _fingerprint(text: bytes, width: int) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    k = max(len(words) - width, 0)
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in
                       zip(starts[:k + 1].tolist(), ends[min(width, len(words)) - 1:].tolist())],
                      np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(column: pa.Array) -> pa.Array:
    """64-bit SimHash over word shingles, as a signed long."""
    data, offsets = text_bytes(column)
    raw = memoryview(data)
    out = np.array([_fingerprint(bytes(raw[a:b]), SHINGLE)
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
    return pa.array(out.view(np.int64), pa.int64())


def segment_widths(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    sizes = [64 // parts + (i < 64 % parts) for i in range(parts)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _masks(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)]


def _requests(batches: Iterator[pa.RecordBatch], parts: int, radius: int
              ) -> Iterator[pa.RecordBatch]:
    """Table entries (asks = 0) and requests (asks = 1) of each fingerprint."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for i in range(0, len(fp), 20_000):
            some = fp[i:i + 20_000]
            keys, who, asks = [], [], []
            for s, (low, width) in enumerate(segment_widths(parts)):
                value = (some >> np.uint64(low)) & np.uint64((1 << width) - 1)
                tag = np.uint64(s << 40)
                keys.append(value + tag)
                who.append(some)
                asks.append(np.zeros(len(some), np.int8))
                for mask in _masks(width, radius // parts):
                    top = 1 << (mask.bit_length() - 1) if mask else 0
                    ok = (value & np.uint64(top)) == np.uint64(top)  # one of the two sides asks
                    keys.append((value[ok] ^ np.uint64(mask)) + tag)
                    who.append(some[ok])
                    asks.append(np.ones(int(ok.sum()), np.int8))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)),
                 pa.array(np.concatenate(who).view(np.int64)), pa.array(np.concatenate(asks))],
                ["bucket", "fp", "asks"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, one fewer than nodes per component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Verified links of sorted (bucket, chunk, asks, fp) rows. The entries of the bucket at hand
    stay in memory (a chunk has a bound), requests stream past them."""
    key = fps = np.zeros(0, np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def edges() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate(x) for x in zip(*found)))
        found.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        bucket = batch.column("bucket").to_numpy().view(np.uint64) * np.uint64(1 << 20)
        bucket = bucket + batch.column("chunk").to_numpy().astype(np.uint64)
        fp = batch.column("fp").to_numpy().view(np.uint64)
        entry = batch.column("asks").to_numpy() == 0
        if len(bucket) == 0:
            continue
        last = key == bucket[0]
        key = np.concatenate([key[last], bucket[entry]])
        fps = np.concatenate([fps[last], fp[entry]])
        asks_key, asks = bucket[~entry], fp[~entry]
        lo, hi = np.searchsorted(key, asks_key, "left"), np.searchsorted(key, asks_key, "right")
        upto = np.concatenate([[0], np.cumsum(hi - lo)])
        i = 0
        while i < len(asks):
            j = max(int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1, i + 1)
            n = (hi - lo)[i:j]
            left = np.repeat(asks[i:j], n)
            right = fps[np.arange(int(n.sum())) + np.repeat(lo[i:j] - (upto[i:j] - upto[i]), n)]
            near = (np.bitwise_count(left ^ right) <= radius) & (left != right)
            if near.any():
                found.append((left[near], right[near]))
                held += int(near.sum())
            if held > PAIRS:
                a, b = forest(*(np.concatenate(x) for x in zip(*found)))
                found[:] = [(a, b)]
                held = 0
            i = j
        keep = key == bucket[-1]
        key, fps = key[keep], fps[keep]
    if found:
        yield edges()


def links(fingerprints: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """(a, b): links between distinct `fp` values that connect all fingerprints at `radius` or fewer
    differing bits. Segments get about as many bits as the number of fingerprints has."""
    fingerprints = fingerprints.select("fp").distinct()
    if parts is None:
        parts = 3 if fingerprints.count() < 1 << 26 else 2
    spark = fingerprints.sparkSession
    rows = fingerprints.mapInArrow(
        lambda batches: _requests(batches, parts, radius), "bucket long, fp long, asks byte")
    sizes = []
    for s, (low, width) in enumerate(segment_widths(parts)):
        mask = (1 << width) - 1
        sizes.append(fingerprints.select(F.expr(
            f"(shiftrightunsigned(fp, {low}) & {mask}L) + {s << 40}L").alias("bucket")))
    full = sizes[0]
    for other in sizes[1:]:
        full = full.union(other)
    full = stored(full.groupBy("bucket").count().where(F.col("count") > CHUNK)
                  .selectExpr("bucket", f"cast(ceil(count / {CHUNK}) as int) as chunks"), "full")
    if full.isEmpty():
        rows = rows.withColumn("chunk", F.lit(0))
    else:
        rows = rows.join(full, "bucket", "left").withColumn("chunk", F.explode(F.expr(
            "if(chunks is null, array(0), if(asks = 0, array(cast(pmod(xxhash64(fp), chunks) as int)),"
            " sequence(0, chunks - 1)))")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.select("bucket", "chunk", "asks", "fp").repartition(n, "bucket", "chunk")
             .sortWithinPartitions("bucket", "chunk", "asks"))
    return dealt.mapInArrow(lambda batches: _links(batches, radius), "a long, b long")


def _stored_fingerprints(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    small_batches(documents.sparkSession)
    return stored(documents.select(F.struct("*").alias("row"), F.col(id_column).alias("id"),
                                   fingerprint(F.col(text)).alias("fp"),
                                   F.monotonically_increasing_id().alias("uid")), "simhash")


def _components(fps: DataFrame) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint."""
    least = fps.groupBy("fp").agg(F.min("id").alias("id"))
    tree = stored(components(links(fps)), "classes")
    named = (least.join(tree, least.fp == tree.node, "left")
             .select("fp", "id", F.coalesce("component", "fp").alias("component")))
    named = stored(named, "named")
    roots = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return named.join(roots, "component").select("fp", "component", "component_id")


def classes(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `documents` as struct `row`, with `fp`, `id`, and `component_id`, the smallest
    id that links lead to."""
    fps = _stored_fingerprints(documents, id_column, text)
    return fps.join(_components(fps), "fp")


def keep_one(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id. Only the last join moves texts."""
    fps = _stored_fingerprints(documents, id_column, text)
    rows = fps.select("uid", "id", "fp").join(_components(fps), "fp")
    first = (rows.groupBy("component")
             .agg(F.min_by("uid", F.struct(F.col("id").isNull(), "id", "uid")).alias("uid")))
    return fps.join(first.select("uid"), "uid", "left_semi").select("row.*")
