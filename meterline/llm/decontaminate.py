"""Benchmark decontamination with an FM-index per training shard.

Words are runs of letters and digits (all non-ASCII characters count), lower-cased. Test phrases are
the windows of 13 consecutive words of each benchmark item; a shorter item is one window.

Tasks write the benchmark as blocks of bounded size to the shared folder. Each task takes its texts
in shards of a few megabytes, writes them as symbols of a block's vocabulary (a word outside of it
cannot be part of a window, nor can a run that is shorter than the shortest window, so both become
separators), and builds an FM-index: suffix array, Burrows-Wheeler transform in a wavelet tree, and
sampled suffix positions. All windows of the block are searched backwards at once; occurrences are
located by walking to the next sampled position, and become spans of words, merged where they touch.

Null texts and items have no words. Items without an id are searched like others and count as hits, but
have no name in the list of items; items that share an id count as one. Repeated rows are judged alike. An empty benchmark hits nothing. Extra columns are left alone.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import work_folder
from meterline.llm import words as w
from meterline.llm.files import mapped, put
from meterline.llm.frames import small_batches

WINDOW = 13
BLOCK_WINDOWS = 200_000
SAMPLE = 16
SHARD_BYTES = 4 << 20


class Bits:
    """A bit vector with rank in constant time: a total before every 64 bits, then a count."""

    def __init__(self, flags: np.ndarray):
        n = len(flags) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[:len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        inside = self.words[block] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + np.bitwise_count(inside)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Levels of one bit of the symbols each, highest first, each level sorted by the bits above."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        now = symbols
        for bit in reversed(range(max(int(size - 1).bit_length(), 1))):
            flags = (now >> bit) & 1
            self.levels.append((bit, Bits(flags.astype(np.uint8)), int((flags == 0).sum())))
            now = np.concatenate([now[flags == 0], now[flags == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(i), i
        for bit, bits, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol, lo, place = np.zeros_like(i), np.zeros_like(i), i
        for bit, bits, zeros in self.levels:
            one = bits.get(place)
            a, b = bits.rank(lo), bits.rank(place)
            lo = np.where(one, zeros + a, lo - a)
            place = np.where(one, zeros + b, place - b)
            symbol = symbol | (one.astype(np.int64) << bit)
        return symbol, place - lo


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the end counts as smaller than any symbol."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(n - step, 0)] = rank[step:] + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Of symbols 1 to size - 1, with 0 as a separator that no phrase holds."""

    def __init__(self, symbols: np.ndarray, size: int):
        text = np.concatenate([symbols + 1, [0]]).astype(np.int64)  # 0 ends the text
        sa = suffix_array(text)
        self.tree = WaveletTree(text[sa - 1], size + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        self.n = len(text)
        sampled = sa % SAMPLE == 0
        self.marked, self.sampled = Bits(sampled.astype(np.uint8)), sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase; rows of `phrases` are flush right."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            go = np.flatnonzero((lengths >= back) & (hi > lo))
            if len(go) == 0:
                break
            symbol = phrases[go, -back].astype(np.int64) + 1
            lo[go] = self.first[symbol] + self.tree.rank(symbol, lo[go])
            hi[go] = self.first[symbol] + self.tree.rank(symbol, hi[go])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, at = np.zeros(len(rows), np.int64), rows.copy()
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            done = self.marked.get(at[open_])
            ready = open_[done]
            out[ready] = self.sampled[self.marked.rank(at[ready])] + steps
            open_ = open_[~done]
            symbol, rank = self.tree.symbol_and_rank(at[open_])
            at[open_] = self.first[symbol] + rank
            steps += 1
        return out


# --- benchmark blocks ------------------------------------------------------------------------

def _write_blocks(batches: Iterator[pa.RecordBatch], folder: str, window: int
                  ) -> Iterator[pa.RecordBatch]:
    """Windows of the items as blocks: sorted word hashes, distinct windows, and their items."""
    rows: list[np.ndarray] = []
    ids: list[str | None] = []

    def flush() -> pa.RecordBatch:
        vocabulary = np.unique(np.concatenate(rows))
        table = np.zeros((len(rows), window), np.int32)
        lengths = np.array([len(r) for r in rows])
        for i, r in enumerate(rows):
            table[i, window - len(r):] = np.searchsorted(vocabulary, r) + 1
        phrases, of = np.unique(np.column_stack([table, lengths]), axis=0, return_inverse=True)
        named = np.array([i is not None for i in ids])  # windows of items without an id have no name
        names, item = np.unique(np.array([i for i in ids if i is not None], dtype=str), return_inverse=True)
        pairs = np.unique(np.column_stack([of.reshape(-1)[named], item]), axis=0)
        out = io.BytesIO()
        np.savez(out, vocabulary=vocabulary, phrases=phrases[:, :-1], lengths=phrases[:, -1],
                 phrase=pairs[:, 0], item=pairs[:, 1], names=names)
        path = f"{folder}/block-{uuid.uuid4().hex}"
        put(path, out.getvalue())
        rows.clear()
        ids.clear()
        return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    for batch in batches:
        data, offsets = w.text_bytes(batch.column(1))
        lower = w.LOWER[data]
        starts, ends = w.word_bounds(lower, offsets, w.letters_digits())
        hashes, bounds = w.word_hashes(lower, starts, ends), w.words_per_text(starts, offsets)
        for k, name in enumerate(batch.column(0).to_pylist()):
            words = hashes[bounds[k]:bounds[k + 1]]
            for i in range(max(len(words) - window + 1, min(len(words), 1))):
                rows.append(words[i:i + window])
                ids.append(name)
                if len(rows) >= BLOCK_WINDOWS:
                    yield flush()
    if rows:
        yield flush()


def write_benchmark(items: DataFrame, id_column: str = "item_id", text: str = "text",
                    window: int = WINDOW) -> tuple[str, ...]:
    """Paths of the benchmark's blocks in the shared folder; the driver sees only these."""
    folder = work_folder(items.sparkSession, "benchmark")
    narrow = items.select(F.col(id_column).cast("string"), F.col(text))
    blocks = narrow.mapInArrow(lambda b: _write_blocks(b, folder, window), "path string")
    return tuple(sorted(r["path"] for r in blocks.collect()))


@lru_cache(maxsize=2)
def _block(path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(mapped(path, "u1").tobytes())) as f:
        return {k: f[k] for k in f.files}


# --- search ----------------------------------------------------------------------------------

def _occurrences(hashes: np.ndarray, bounds: np.ndarray, block: dict[str, np.ndarray]
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence of a block's windows in a shard of texts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    vocabulary, lengths = block["vocabulary"], block["lengths"]
    place = np.searchsorted(vocabulary, hashes)
    known = place < len(vocabulary)
    known[known] = vocabulary[place[known]] == hashes[known]
    inside = np.where(known, 1, 0).astype(np.int64)
    text = np.concatenate([inside, [0]])
    start = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1])]))
    cuts = np.union1d(start, bounds[:-1])
    cuts = cuts[cuts < len(hashes)]
    size = np.diff(np.append(cuts, len(hashes)))
    runs = known[cuts] & (size >= int(lengths.min())) if len(cuts) else np.zeros(0, bool)
    if not runs.any():
        return none
    cuts, size = cuts[runs], size[runs]
    upto = np.concatenate([[0], np.cumsum(size + 1)])  # a separator behind each run
    word = np.arange(upto[-1]) + np.repeat(cuts - upto[:-1], size + 1)
    symbols = place[np.minimum(word, len(hashes) - 1)] + 1
    symbols[upto[1:] - 1] = 0
    index = FMIndex(symbols, len(vocabulary) + 1)
    lo, hi = index.search(block["phrases"], lengths)
    count = hi - lo
    phrase = np.repeat(np.arange(len(lo)), count)
    if len(phrase) == 0:
        return none
    shift = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return word[index.locate(np.arange(len(phrase)) + shift)], phrase


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])
_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def _search(data: np.ndarray, offsets: np.ndarray, blocks: tuple[str, ...]) -> list[tuple]:
    """(n_words, spans, items) of each text of a shard."""
    lower = w.LOWER[data]
    starts, ends = w.word_bounds(lower, offsets, w.letters_digits())
    bounds = w.words_per_text(starts, offsets)
    n = len(offsets) - 1
    step = np.zeros(len(starts) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    hashes = w.word_hashes(lower, starts, ends)
    for path in blocks:
        block = _block(path)
        first, phrase = _occurrences(hashes, bounds, block)
        np.add.at(step, first, 1)
        np.add.at(step, first + block["lengths"][phrase], -1)
        seen = np.unique(np.column_stack(
            [np.searchsorted(bounds, first, "right") - 1, phrase]), axis=0)
        a = np.searchsorted(block["phrase"], seen[:, 1], "left").tolist()
        b = np.searchsorted(block["phrase"], seen[:, 1], "right").tolist()
        for doc, x, y in zip(seen[:, 0].tolist(), a, b):
            items[doc].update(block["names"][block["item"][x:y]].tolist())
    hit = np.cumsum(step) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit])))
    spans: list[list[dict]] = [[] for _ in range(n)]
    # a window never leaves its text, but the hits of two texts may touch
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        doc = int(np.searchsorted(bounds, a, "right")) - 1
        while a < b:
            stop = min(b, int(bounds[doc + 1]))
            if stop > a:
                spans[doc].append({"first": a - int(bounds[doc]), "end": stop - int(bounds[doc])})
            a, doc = stop, doc + 1
    return [(int(k), s, sorted(i)) for k, s, i in zip(np.diff(bounds), spans, items)]


def finder(blocks: tuple[str, ...]):
    """A column function: n_words, merged spans of hit words, and the items that hit."""
    def find(column: pa.Array) -> pa.Array:
        rows = [r for lo, hi in w.blocks(column, SHARD_BYTES)
                for r in _search(*w.text_bytes(column.slice(lo, hi - lo)), blocks)]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()),
             pa.array([r[1] for r in rows], pa.list_(_SPAN)),
             pa.array([r[2] for r in rows], pa.list_(pa.string()))], _FOUND.names)

    return F.arrow_udf(find, _FOUND)


def judge(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` as struct `row`, with n_words, spans, items, n_hit and `contaminated`: at
    least one word in 20 is hit."""
    small_batches(docs.sparkSession)
    found = finder(write_benchmark(benchmark))
    return (docs.select(F.struct("*").alias("row"), found(F.col(text)).alias("f"))
            .select("row", "f.*")
            .withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.first)"))
            .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")))


def keep(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that are not contaminated."""
    return judge(docs, benchmark, text).where("not contaminated").select("row.*")
