"""Mixing sources to target weights, in blocks of fixed length.

1. Sources in code-point order (null last) take WEIGHTS in turn and share TOTAL times all words; a
   target stops at CAP times the source, and what is over is shared again by weight.
2. The documents of a source, in an order by hash, form one stream of words, cut into blocks of
   BLOCK words (the last may be shorter). The place of a document in its stream is a running total
   in two steps: over chunks of some thousand documents, then inside each chunk.
3. A source fills as many slots as its target needs: whole passes over its blocks, then a part of
   one, the last slot cut to the word. Output shards have SHARD_SLOTS slots. Each shard draws its
   source counts from a multinomial distribution with its own seed. Slots that a source draws beyond
   its target go, number by number, to sources that drew too few.
4. Slot k of a pass takes the block that a pseudorandom permutation of the source's full blocks (a
   Feistel network, keyed by source and pass) gives for k; a shorter last block is the last slot.
   Slots meet blocks in a join on the block's index.

Only the table of sources (a row each) is handled in one task. Sizes count words
`[^\x20\x09-\x0D]+`; null and empty texts have none and are never taken. Repeated rows are separate
documents; rows that agree in id and text may swap their shares, so reruns agree as a whole. A null
id is an id. An empty table gives an empty mix. `mixed_documents` keeps the columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored, work_folder
from meterline.llm import words as w
from meterline.llm.files import mapped, put
from meterline.llm.frames import small_batches

WEIGHTS, TOTAL, CAP = (3, 1, 2), 1.5, 2
BLOCK = 512
SHARD_SLOTS = 8192
CHUNK_ROWS = 4096
SEED = 20240607


@F.arrow_udf(T.LongType())
def word_count(column: pa.Array) -> pa.Array:
    sizes = [np.zeros(0, np.int64)]
    for lo, hi in w.blocks(column):
        data, offsets = w.text_bytes(column.slice(lo, hi - lo))
        sizes.append(np.diff(w.words_per_text(
            w.word_bounds(data, offsets, w.not_space())[0], offsets)))
    return pa.array(np.concatenate(sizes).astype(np.int64))


def targets(docs: DataFrame) -> DataFrame:
    """A row per source: rank, size, weight, target, and how its slots divide. Water filling: in the
    order of CAP * size / weight a source is capped if its share of what is left is not less."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = ", ".join(map(str, WEIGHTS))
    ranked = sizes.selectExpr("*", "row_number() over (order by source asc nulls last) - 1 as rank")
    ranked = ranked.selectExpr(
        "*", f"cast(element_at(array({weights}), cast(rank % {len(WEIGHTS)} as int) + 1) as double)"
        " as weight", f"cast({CAP} * source_size as double) as cap")
    order = "over (order by cap / weight, rank rows between unbounded preceding and 1 preceding)"
    filled = ranked.selectExpr(
        "*", f"{TOTAL} * sum(source_size) over () - coalesce(sum(cap) {order}, 0) as rest",
        f"sum(weight) over () - coalesce(sum(weight) {order}, 0) as rest_weight")
    filled = filled.selectExpr("*", "cap * rest_weight <= weight * rest as capped")
    filled = filled.selectExpr(
        "*", f"{TOTAL} * sum(source_size) over () - coalesce(sum(if(capped, cap, 0)) over (), 0)"
        " as free", "sum(if(capped, 0, weight)) over () as free_weight")
    filled = filled.selectExpr(
        "source", "rank", "source_size", "weight",
        "if(capped, cap, free * weight / free_weight) as target")
    return filled.selectExpr(
        "*", f"source_size div {BLOCK} as full", f"ceil(source_size / {BLOCK}) as blocks",
        "cast(round(target) as long) as words").selectExpr(
        "*", "if(source_size = 0, 0, words div source_size) as passes",
        "if(source_size = 0, 0, words % source_size) as part").selectExpr(
        "*", f"passes * blocks + cast(ceil(part / {BLOCK}) as long) as slots")


def placed(docs: DataFrame) -> DataFrame:
    """Adds `start`, the words before each document in its source's stream."""
    chunks = 1
    while chunks * CHUNK_ROWS < docs.count():
        chunks *= 2
    bits = chunks.bit_length() - 1
    chunk = f"shiftrightunsigned(hash, {64 - bits})" if bits else "0L"
    docs = docs.withColumn("chunk", F.expr(chunk))
    sums = docs.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    sums = sums.selectExpr(
        "source", "chunk", "coalesce(sum(words) over (partition by source order by chunk "
        "rows between unbounded preceding and 1 preceding), 0) as base")
    inside = docs.selectExpr(
        "*", "coalesce(sum(size) over (partition by source, chunk order by hash, doc_id, uid "
        "rows between unbounded preceding and 1 preceding), 0) as offset")
    return (inside.alias("d").join(sums.alias("s"), F.expr("d.source <=> s.source and d.chunk = s.chunk"))
            .selectExpr("d.*", "s.base + d.offset as start").drop("chunk", "offset", "hash"))


# --- draws and permutations ------------------------------------------------------------------

def _write_quotas(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    parts = [b.column("slots").to_numpy() for b in batches]
    slots = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    put(path, slots.astype("<i8").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array([int(slots.sum())])], ["total"])


def _draw(batches: Iterator[pa.RecordBatch], path: str, total: int, each: int
          ) -> Iterator[pa.RecordBatch]:
    """Multinomial source counts of each shard; sources without a slot are left out."""
    quotas = np.asarray(mapped(path, "<i8")).astype(float)
    for batch in batches:
        for shard in batch.column("shard").to_pylist():
            size = min(each, total - shard * each)
            counts = np.random.default_rng([SEED, shard]).multinomial(size, quotas / quotas.sum())
            rank = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rank), shard)), pa.array(rank), pa.array(counts[rank])],
                ["shard", "rank", "count"])


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each key: four Feistel rounds on the least
    even number of bits that holds `size`, walked on until the value is in range."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1)
    shift = half.astype(np.uint64)
    mask = (np.uint64(1) << shift) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    open_ = np.arange(len(out))
    while len(open_):
        s, m = shift[open_], mask[open_]
        a, b = out[open_] >> s, out[open_] & m
        for r in range(4):
            a, b = b, a ^ (w.mix(b + key[open_] * np.uint64(4) + np.uint64(r)) & m)
        out[open_] = (a << s) | b
        open_ = open_[out[open_] >= size[open_].astype(np.uint64)]
    return out.astype(np.int64)


@F.arrow_udf(T.LongType())
def block_of(rank: pa.Array, pass_: pa.Array, slot: pa.Array, full: pa.Array) -> pa.Array:
    """Block of a slot in a pass: permuted below `full`, itself above."""
    r, p, k, n = (c.to_numpy(zero_copy_only=False) for c in (rank, pass_, slot, full))
    inside = k < n
    out = k.copy()
    key = w.mix(r[inside].astype(np.uint64) * np.uint64(1 << 20) + p[inside].astype(np.uint64)
                + np.uint64(SEED))
    out[inside] = permute(k[inside], n[inside], key)
    return pa.array(out, pa.int64())


def slots(sources: DataFrame) -> DataFrame:
    """Every slot of the mix: shard, rank, pass, block, and the words it takes from the block's
    start."""
    spark = sources.sparkSession
    path = f"{work_folder(spark, 'quotas')}/slots"
    total = (sources.select("rank", "slots").coalesce(1).sortWithinPartitions("rank")
             .mapInArrow(lambda b: _write_quotas(b, path), "total long").agg(F.sum("total")).first()[0])
    total = total or 0
    shards = -(-total // SHARD_SLOTS)
    each = SHARD_SLOTS
    draws = spark.range(shards).withColumnRenamed("id", "shard").mapInArrow(
        lambda b: _draw(b, path, total, each), "shard long, rank long, count long")
    draws = stored(draws, "draws")
    drawn = draws.groupBy("rank").agg(F.sum("count").alias("drawn"))
    before = "over (order by rank rows between unbounded preceding and 1 preceding)"
    balance = stored(
        sources.join(drawn, "rank", "left")
        .selectExpr("rank", "slots", "coalesce(drawn, 0) as drawn")
        .selectExpr("*", f"coalesce(sum(greatest(drawn - slots, 0)) {before}, 0) as over_base",
                    f"coalesce(sum(greatest(slots - drawn, 0)) {before}, 0) as under_base"), "balance")
    numbered = draws.selectExpr(
        "*", "coalesce(sum(count) over (partition by rank order by shard rows between unbounded "
        "preceding and 1 preceding), 0) as first").where("count > 0").selectExpr(
        "shard", "rank", "explode(sequence(first, first + count - 1)) as slot")
    numbered = numbered.join(balance, "rank")
    over = numbered.where("slot >= slots").selectExpr("shard", "over_base + slot - slots as number")
    under = balance.where("slots > drawn").selectExpr(
        "rank", "under_base", "drawn", "explode(sequence(drawn, slots - 1)) as slot").selectExpr(
        "rank", "slot", "under_base + slot - drawn as number")
    filled = (numbered.where("slot < slots").select("shard", "rank", "slot")
              .union(over.join(under, "number").select("shard", "rank", "slot")))
    placed_ = filled.join(sources.select("rank", "source_size", "full", "blocks", "passes", "part"), "rank")
    placed_ = placed_.selectExpr("*", "slot div blocks as pass", "slot % blocks as k")
    placed_ = placed_.withColumn("block", block_of("rank", "pass", "k", "full"))
    return placed_.selectExpr(
        "shard", "rank", "pass", "block",
        f"least(least({BLOCK}, source_size - block * {BLOCK}), "
        f"if(pass < passes, {BLOCK}, part - k * {BLOCK})) as words")


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (uid, doc_id, source, size, hash): the sources, and a row (uid, pass, from, upto) for
    each stretch of words of a document that a slot takes."""
    sources = stored(targets(docs), "sources")
    pieces = (placed(docs).where("size > 0")
              .selectExpr("uid", "source", "start", "size", f"explode(sequence(start div {BLOCK}, "
                          f"(start + size - 1) div {BLOCK})) as block").alias("p")
              .join(sources.select("source", "rank").alias("s"), F.expr("p.source <=> s.source"))
              .select("p.uid", "p.start", "p.size", "p.block", "s.rank"))
    taken = pieces.join(slots(sources), ["rank", "block"]).selectExpr(
        "uid", "pass", f"greatest(block * {BLOCK} - start, 0) as from",
        f"least(block * {BLOCK} + words - start, size) as upto").where("from < upto")
    return sources, taken


def _narrow(docs: DataFrame, id_column: str, source: str, text: str, *more) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(
        *more, F.col(id_column).alias("doc_id"), F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"), F.xxhash64(id_column, text).alias("hash"),
        F.monotonically_increasing_id().alias("uid"))


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text"
        ) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row."""
    rows = stored(_narrow(docs, id_column, source, text), "mix")
    sources, taken = shares(rows)
    sums = taken.groupBy("uid").agg(F.sum(F.expr("upto - from")).alias("taken"))
    return (rows.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source"))
            .join(sums.alias("t"), F.expr("d.uid = t.uid"), "left")
            .selectExpr("d.doc_id", "d.source", "d.size", "s.source_size", "s.target",
                        "coalesce(t.taken, 0) as taken"))


@F.arrow_udf(T.StringType())
def _words_at(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The stretches of words of each text, as they stand there, one space between stretches."""
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends = w.word_bounds(raw, np.array([0, len(raw)]), w.not_space())
        merged: list[list[int]] = []
        for a, b in sorted((s["from"], s["upto"]) for s in found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        if merged == [[0, len(starts)]]:
            out.append(text)
        else:
            out.append(b" ".join(raw[starts[a]:ends[b - 1]].tobytes() for a, b in merged).decode())
    return pa.array(out, pa.string())


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", source: str = "source",
                    text: str = "text") -> DataFrame:
    """The mix as documents: a row of `docs` for each pass that takes words of it, its text cut to
    these words; what is taken whole stays as it is, what is not taken goes."""
    rows = stored(_narrow(docs, id_column, source, text, F.struct("*").alias("row")), "mix")
    _, taken = shares(rows.drop("row"))
    spans = taken.groupBy("uid", "pass").agg(F.collect_list(F.struct("from", "upto")).alias("spans"))
    names = [f"row.`{c}`" if c != text else _words_at(f"row.`{text}`", "spans").alias(text)
             for c in docs.columns]
    return rows.join(spans, "uid").select(*names)
