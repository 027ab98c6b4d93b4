"""Token ids as binary shards with Elias-Fano document boundaries.

A shard is three files in the shared folder:

- `ids`: the ids of its documents one after the other, little-endian, two bytes each where the
  vocabulary allows it, else four;
- `ends`: where each document ends, an Elias-Fano list;
- `docs`: the document ids, ascending, an Elias-Fano list over their distance to the first.

An Elias-Fano list of n values up to u keeps floor(log2(u / n)) low bits of each value in a packed
array and the rest in unary in a bit vector of at most 3n bits; the position of every 256th one is
stored, so `select` reads two words of samples and a short run of bits instead of a table of 64-bit
offsets. A manifest (one row per shard) names the files and, as a running total, the ids before
each shard.

Shards follow ascending document ids, null ids first, equal ids by text. Null texts are empty. Every
document, also an empty one, ends in `end_id`. An empty table gives no shard. Only id and text are
read, so other columns cannot clash. A task that runs twice writes other file names, and the manifest
names those of the attempt that counted.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored, work_folder
from meterline.llm import words as w
from meterline.llm.files import mapped, put
from meterline.llm.frames import shards_for, small_batches

MAGIC = 0x3146454D
SAMPLE = 256
HEADER = 5
KNOWN_WORDS = 1 << 19
INPUT_PER_SHARD = 16 << 20


# --- Elias-Fano ------------------------------------------------------------------------------

def encode_sorted(values: np.ndarray) -> bytes:
    """An Elias-Fano list of ascending unsigned values."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max((top // n).bit_length() - 1, 0) if n else 0
    upper = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(((int(upper[-1]) + 1 if n else 0) + 63) // 64 * 64, np.uint8)
    bits[upper] = 1
    rest = (v & np.uint64((1 << low) - 1))
    packed = np.zeros((n * low + 63) // 64 + 1, np.uint64)
    if low:
        at = np.arange(n, dtype=np.uint64) * np.uint64(low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(packed, word, rest << shift)
        over = shift + np.uint64(low) > 64
        np.bitwise_or.at(packed, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
    head = np.array([MAGIC, n, low, len(bits) // 64, len(packed)], np.uint64)
    return b"".join([head.tobytes(), upper[::SAMPLE].astype(np.uint64).tobytes(),
                     np.packbits(bits, bitorder="little").tobytes(), packed.tobytes()])


class SortedList:
    """Reads an Elias-Fano list from an array of unsigned 64-bit words, mapped or not."""

    def __init__(self, raw: np.ndarray):
        magic, self.n, self.low, ones, packed = (int(x) for x in raw[:HEADER])
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano list")
        at = HEADER + -(-self.n // SAMPLE)
        self.samples = raw[HEADER:at]
        self.bits = raw[at:at + ones]
        self.packed = raw[at + ones:at + ones + packed]

    def __len__(self) -> int:
        return self.n

    def select(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1."""
        if hi <= lo:
            return np.zeros(0, np.uint64)
        start = int(self.samples[lo // SAMPLE]) // 64
        stop = (int(self.samples[(hi - 1) // SAMPLE + 1]) // 64 + 1
                if (hi - 1) // SAMPLE + 1 < len(self.samples) else len(self.bits))
        ones = np.flatnonzero(np.unpackbits(
            np.ascontiguousarray(self.bits[start:stop]).view(np.uint8), bitorder="little"))
        ones = ones[ones + start * 64 >= int(self.samples[lo // SAMPLE])]
        skip = lo % SAMPLE
        rank = np.arange(lo, hi)
        upper = (ones[skip:skip + hi - lo] + start * 64 - rank).astype(np.uint64)
        if self.low == 0:
            return upper
        at = rank.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        rest = self.packed[word] >> shift
        over = shift > 0
        rest[over] |= self.packed[word[over] + 1] << (np.uint64(64) - shift[over])
        return (upper << np.uint64(self.low)) | (rest & np.uint64((1 << self.low) - 1))


# --- token ids -------------------------------------------------------------------------------

class WordEncoder:
    """Ids of texts for a tokenizer that drops white space and never joins across it.

    Such a tokenizer gives a text the ids of its pieces one after the other, so each distinct piece
    is encoded once: a piece is a run without ASCII white space, cut once more before a run of plain
    stops that follows an ASCII letter. Pieces are recognised by a 64-bit hash; those of a batch that
    are new go to the tokenizer together. At most KNOWN_WORDS pieces are kept."""

    _SPLIT = np.zeros(256, bool)
    _SPLIT[list(b",.;:!?")] = True

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if size <= 1 << 16 else "<u4"
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = w.word_bounds(data, offsets, w.not_space())
        if len(data) < 2:
            return starts, ends
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True
        cut = np.flatnonzero(letter[data[:-1]] & self._SPLIT[data[1:]]) + 1
        inner = cut[~np.isin(cut, starts, assume_unique=True)]
        # one cut per word at most: the first, as what follows it stays together
        of = np.searchsorted(starts, inner, "right") - 1
        inner = inner[np.concatenate([[True], of[1:] != of[:-1]])] if len(inner) else inner
        return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))

    def _learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        """Encode new pieces. Plain letter pieces go in bulk, as each ends with its one word-end
        token; others one by one."""
        plain = [i for i, p in enumerate(pieces) if p.isalpha() or p.isascii() and p.isalnum()
                 and not any(48 <= c < 58 for c in p)]
        found: list[list[int] | np.ndarray] = [[]] * len(pieces)
        for i in range(0, len(plain), 512):
            group = plain[i:i + 512]
            text = b" ".join(pieces[k] for k in group).decode()
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                for k, a, b in zip(group, [0, *cuts[:-1].tolist()], cuts.tolist()):
                    found[k] = ids[a:b]
            else:
                for k in group:
                    found[k] = self._one(pieces[k])
        done = set(plain)
        rest = [i for i in range(len(pieces)) if i not in done]
        texts = [pieces[i].decode("utf-8", "replace") for i in rest]
        for i, code in zip(rest, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            found[i] = code.ids
        size = np.array([len(f) for f in found], np.int64)
        at = np.concatenate([[0], np.cumsum(size)[:-1]]) + len(self.ids) if len(size) else size
        self.ids = np.concatenate([self.ids, *[np.asarray(f, self.dtype) for f in found]])
        order = np.argsort(np.concatenate([self.keys, keys]))
        self.keys = np.concatenate([self.keys, keys])[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]

    def _one(self, piece: bytes) -> list[int]:
        return self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and the number of ids of each."""
        if len(self.keys) > KNOWN_WORDS:
            self._reset()
        starts, ends = self.pieces(data, offsets)
        lower = w.LOWER[data]
        # "<|" may begin a special token, which only its exact spelling is
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else []
        for k in set((np.searchsorted(starts, special, "right") - 1).tolist()):
            lower[starts[k]:ends[k]] = data[starts[k]:ends[k]]
        hashes = w.word_hashes(lower, starts, ends)
        keys, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        ok = place < len(self.keys)
        new[ok] = self.keys[place[ok]] != keys[ok]
        if new.any():
            raw = memoryview(lower)
            self._learn([bytes(raw[starts[i]:ends[i]]) for i in first[new].tolist()], keys[new])
            place = np.searchsorted(self.keys, keys)
        begin, size = self.at[place][at], self.size[place][at]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)]
        return ids, np.diff(upto[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# --- writing and reading ---------------------------------------------------------------------

_MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), *[
    T.StructField(n, T.LongType()) for n in ("null_docs", "n_docs", "n_ids", "first_doc")],
    T.StructField("dtype", T.StringType()), T.StructField("path", T.StringType())])


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int
                 ) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder = _encoder(tokenizer)
    part = TaskContext.get().partitionId()
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    nulls = 0
    for batch in batches:
        for lo, hi in w.blocks(batch.column("text")):
            piece = batch.slice(lo, hi - lo)
            ids, n = encoder.encode(*w.text_bytes(piece.column("text")))
            parts.append(np.insert(ids, np.cumsum(n), end_id))
            sizes.append(n + 1)
            doc = piece.column("doc_id").drop_null()
            nulls += piece.num_rows - len(doc)
            docs.append(doc.to_numpy().astype(np.int64))
    if not parts:
        return
    ids, size, doc = np.concatenate(parts), np.concatenate(sizes), np.concatenate(docs)
    first = int(doc[0]) if len(doc) else 0
    path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex[:12]}"
    put(f"{path}.ids", ids.tobytes())
    put(f"{path}.ends", encode_sorted(np.cumsum(size)))
    put(f"{path}.docs", encode_sorted((doc - first).view(np.uint64)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), *[pa.array([x], pa.int64()) for x in
         (nulls, len(size), len(ids), first)], pa.array([encoder.dtype]), pa.array([path])],
        _MANIFEST.names)


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, id_column: str = "doc_id",
          text: str = "text", shard_bytes: int = INPUT_PER_SHARD) -> DataFrame:
    """Write the shards of `docs`, each for about `shard_bytes` of input; returns the manifest: a row
    per shard, with `start`, the ids before it."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_folder(spark, "token-ids")
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = (narrow.repartitionByRange(shards_for(narrow, "text", shard_bytes, 8), "doc_id")
             .sortWithinPartitions(F.asc_nulls_first("doc_id"), "text"))
    manifest = stored(dealt.mapInArrow(
        lambda b: _write_shard(b, folder, tokenizer, end_id), _MANIFEST), "manifest")
    # a row per shard, so the running total is over a small table
    return manifest.withColumn("start", F.expr(
        "coalesce(sum(n_ids) over (order by shard rows between unbounded preceding "
        "and 1 preceding), 0)"))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = mapped(f"{row['path']}.ids", row["dtype"])
            ends = SortedList(mapped(f"{row['path']}.ends", "u8"))
            docs = SortedList(mapped(f"{row['path']}.docs", "u8"))
            before, nulls = 0, row["null_docs"]
            for lo in range(0, len(ends), 8192):
                hi = min(lo + 8192, len(ends))
                stop = ends.select(lo, hi).astype(np.int64)
                start = np.concatenate([[before], stop[:-1]])
                before = int(stop[-1])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes())
                       for a, b in zip(start.tolist(), stop.tolist())]
                none = max(min(nulls, hi) - lo, 0)
                known = docs.select(max(lo - nulls, 0), max(hi - nulls, 0)).view(np.int64)
                doc = [None] * none + (known + row["first_doc"]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start + row["start"]),
                     pa.array(stop - start), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(
        _read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
