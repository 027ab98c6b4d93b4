"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and scored from mapped arrays.

Texts are lower-cased (A-Z) and cut at ASCII white space; every text ends in one end token, which
also stands for what is before its first word. The model is a set of files in the shared folder,
each a shard of a sorted array:

- words: sorted 64-bit hashes, counts and ids; frequent words have small ids, which compress well;
- a level per length k of n-grams: sorted hashes of their ids, and columns. The longest have their
  count; shorter ones have the number of distinct words before them, and of what follows them how
  much occurs once, twice, three times or more, and the sum.

Tasks count their part in numpy and send sorted blocks, so a frequent word is one entry per task.
n-grams are dealt by hash, so no frequent context meets in one task; the task that has merged a shard
of a level sends what it knows of the next shorter n-grams to their shards, one job for all levels.
Scoring maps the files into memory (pages that are not touched are not read) and looks the distinct
n-grams of a block of texts up at once.

Two of a billion different n-grams share a hash with a probability of 3 %; they would count as one.
Null texts are empty and have the end token only. A null id counts as training. Without any training
text every token has the uniform probability 1 / (V + 1) with V = 0. Repeated rows count each time.
Other columns are not read; those of the scored frame stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import work_folder
from meterline.llm import words as w
from meterline.llm.files import mapped, put
from meterline.llm.frames import shards_for, small_batches

ORDER = 3
END = np.uint64(0x5F3C9A1B7E24D680)
PENDING = 2 << 20
INPUT_PER_SHARD = 2 << 20
BUCKET = 8  # n-grams per bucket of a shard, about
CODEC = pa.Codec("zstd", 1)
_MAPS: dict[str, "_Shard"] = {}


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, end tokens included, and the number of tokens of each text."""
    lower = w.LOWER[data]
    starts, ends = w.word_bounds(lower, offsets, w.not_space())
    bounds = w.words_per_text(starts, offsets)
    return np.insert(w.word_hashes(lower, starts, ends), bounds[1:], END), np.diff(bounds) + 1


def _edges(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the shards that sorted keys lie in."""
    if len(keys) == 0:
        return []
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)]
    return [(int(shard[a]), a, b) for a, b in zip(at, at[1:])]


def _small(x: np.ndarray) -> np.ndarray:
    """In the least unsigned type that holds the values."""
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


def _planes(x: np.ndarray) -> bytes:
    """A matrix with bytes of equal place together, which compresses well; its item size stands first."""
    rows = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
    return bytes([x.itemsize]) + CODEC.compress(np.ascontiguousarray(rows.T), asbytes=True)


def _from_planes(data: bytes, rows: int, columns: int) -> np.ndarray:
    if rows == 0:
        return np.zeros((0, columns), "u1")
    raw = CODEC.decompress(data[1:], rows * columns * data[0], asbytes=True)
    each = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, rows).T)
    return each.view(f"u{data[0]}")


@dataclass
class _Grams:
    """Distinct n-grams in the order of their hashes, with columns of numbers that add up."""
    keys: np.ndarray
    ids: np.ndarray
    stats: np.ndarray

    @staticmethod
    def merged(keys: np.ndarray, ids: np.ndarray, stats: np.ndarray) -> "_Grams":
        if len(keys) == 0:
            return _Grams(keys, ids, stats.astype(np.uint64))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return _Grams(keys[first], ids[order[first]],
                      np.add.reduceat(stats[order], first, axis=0, dtype=np.uint64))

    @staticmethod
    def joined(parts: list["_Grams"]) -> "_Grams":
        return _Grams.merged(np.concatenate([p.keys for p in parts]),
                             np.concatenate([p.ids for p in parts]),
                             np.concatenate([p.stats for p in parts]))

    def rows(self, bits: int, id_type: str) -> pa.Table:
        """A row per shard, its n-grams in the order of their first ids."""
        out = []
        for shard, a, b in _edges(self.keys, bits):
            order = np.argsort(np.ascontiguousarray(self.ids[a:b, 0]))
            out.append((shard, b - a, _planes(self.ids[a:b][order].astype(id_type)),
                        _planes(_small(self.stats[a:b][order]))))
        return _rows(out)


_ROWS = "shard int, size int, ids binary, stats binary"
TOTALS = -1  # the shard of rows that carry the totals of a level (`size`) to the driver


def _rows(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], t)
                     for i, (n, t) in enumerate(zip(("shard", "size", "ids", "stats"), types))})


def gram_keys(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, given as rows of word ids."""
    keys = np.zeros(len(ids), np.uint64)
    for column in ids.T:
        keys = w.mix(keys * np.uint64(3) + column.astype(np.uint64) + np.uint64(1))
    return keys


def grams(ids: np.ndarray, sizes: np.ndarray, end: int, n: int) -> np.ndarray:
    """Rows of the n ids up to each token; before a text stand end tokens."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.empty((len(ids), n), ids.dtype)
    for back in range(n):
        shifted = np.roll(ids, back)
        out[:, n - 1 - back] = np.where(place >= back, shifted, end)
    return out


class _Shard:
    """A mapped file: a head of eight-byte numbers (number of columns, of keys, bits of the bucket or
    WHOLE, of distinct rows, of numbers in one, and for each column its width and the length of its
    list), the keys, the columns, and the distinct rows.

    Whole keys are sorted 64-bit numbers. The others leave out what their place says: a table has the
    start of each bucket of leading bits, and of a key the next 32 bits are kept. A key that is not
    there is so taken for another one with a probability of some 2^-32. A column has a byte per key,
    where 255 means that the value is in its list of (places, values), or more bytes and no list.
    With WHOLE keys the columns are the numbers; else one column says which of the distinct rows, the
    most frequent first, a key has."""

    WHOLE = 255

    def __init__(self, raw: np.ndarray, skip: int):
        raw = raw.view(np.ndarray)  # slices of a mapping that are mappings themselves are slow
        columns, self.size, self.bits, distinct, numbers = raw[:40].view("<u8").tolist()
        shapes = raw[40:40 + 16 * columns].view("<u8").reshape(-1, 2).tolist()
        self.skip, at = skip, 40 + 16 * columns

        def take(n: int, dtype: str) -> np.ndarray:
            nonlocal at
            at += n * np.dtype(dtype).itemsize
            return raw[at - n * np.dtype(dtype).itemsize:at].view(dtype)

        if self.bits == self.WHOLE:
            self.keys = take(self.size, "<u8")
        else:
            self.starts = take((1 << self.bits) + 1, "<u4")
            self.keys = take(self.size, "<u4")
        self.columns = [(take(self.size, f"<u{width}"), take(n, "<u4"), take(n, "<u8"))
                        for width, n in shapes]
        self.distinct = take(distinct * numbers, "<u8").reshape(distinct, numbers)

    @staticmethod
    def parts(keys: np.ndarray, skip: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and kept bits of keys, behind the bits that say the shard."""
        rest = keys << np.uint64(skip)
        bucket = rest >> np.uint64(64 - bits) if bits else np.zeros(len(rest), np.uint64)
        return bucket.astype(np.int64), ((rest << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def content(cls, keys: np.ndarray, stats: np.ndarray, skip: int, whole: bool) -> bytes:
        distinct = stats[:0]
        if not whole and len(keys):
            _, first, code, n = np.unique(gram_keys(stats), return_index=True, return_inverse=True,
                                          return_counts=True)
            order = np.argsort(-n, kind="stable")
            distinct, code_of = stats[first[order]], np.empty(len(n), np.int64)
            code_of[order] = np.arange(len(n))
            stats = code_of[code].reshape(-1, 1)
        shapes, columns = [], []
        for c in stats.T:
            small, large = _small(c), np.flatnonzero(c >= 255)
            if len(c) * (small.itemsize - 1) <= 12 * len(large):
                large = large[:0]
            else:
                small = np.minimum(c, 255).astype("u1")
            shapes += [small.itemsize, len(large)]
            columns += [small, large.astype("<u4"), c[large].astype("<u8")]
        if whole:
            bits, index = cls.WHOLE, [keys]
        else:
            bits = max(len(keys) // BUCKET, 1).bit_length() - 1
            bucket, low = cls.parts(keys, skip, bits)
            index = [np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype("<u4"), low]
        head = np.array([stats.shape[1], len(keys), bits, *distinct.shape, *shapes], "<u8")
        return b"".join(x.tobytes() for x in (head, *index, *columns, distinct.astype("<u8")))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys, and which of them are there."""
        if self.size == 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if self.bits == self.WHOLE:
            at = np.searchsorted(self.keys, keys)
            return at, self.keys[np.minimum(at, self.size - 1)] == keys
        bucket, low = self.parts(keys, self.skip, self.bits)
        at, last = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        end = last.copy()
        for _ in range(int((last - at).max()).bit_length()):
            middle = (at + last) >> 1
            less = (at < last) & (self.keys[np.minimum(middle, self.size - 1)] < low)
            at, last = np.where(less, middle + 1, at), np.where(less, last, middle)
        return at, (at < end) & (self.keys[np.minimum(at, self.size - 1)] == low)

    def values(self, column: int, places: np.ndarray) -> np.ndarray:
        small, where, large = self.columns[column]
        out = small[places].astype(np.int64)
        if len(where):
            out[out == 255] = large[np.searchsorted(where, places[out == 255])]
        return out


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int
    words: int  # distinct words
    tokens: int
    id_type: str = "u4"
    order: int = ORDER
    cuts: tuple[tuple[float, ...], ...] = ()  # by level: discounts of counts 1, 2, 3+
    mass: int = 0  # sum of the counts of level 1
    spread: float = 1.0  # mass of the uniform distribution

    def shard(self, kind: str, number: int) -> _Shard:
        path = f"{self.folder}/{kind}-{number:06d}"
        if path not in _MAPS:
            if len(_MAPS) > 1024:
                _MAPS.clear()
            _MAPS[path] = _Shard(mapped(path, "u1"), self.bits)
        return _MAPS[path]

    def write(self, kind: str, number: int, group: _Grams, whole: bool = False) -> None:
        put(f"{self.folder}/{kind}-{number:06d}",
            _Shard.content(group.keys, group.stats, self.bits, whole))

    def find(self, kind: str, keys: np.ndarray) -> Iterator[tuple[int, _Shard, np.ndarray, np.ndarray]]:
        """For each shard that sorted keys lie in: the shard, where in `keys` those are that it holds,
        and their places in it."""
        for number, a, b in _edges(keys, self.bits):
            shard = self.shard(kind, number)
            place, there = shard.places(keys[a:b])
            yield number, shard, a + np.flatnonzero(there), place[there]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids = np.full(len(hashes), -1, np.int64)
        counts = np.zeros(len(hashes), np.int64)
        for number, shard, here, place in self.find("word", hashes):
            ids[here] = (shard.values(1, place) << self.bits) + number
            counts[here] = shard.values(0, place)
        return ids, counts

    def level(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the distinct known n-grams of length k among rows of ids, zeros in a last one that
        stands for the others, and which of them each row is."""
        known = np.flatnonzero(np.logical_and.reduce([c >= 0 for c in rows.T]))
        some = len(known) < len(rows)
        keys, at = np.unique(gram_keys(rows[known] if some else rows), return_inverse=True)
        if some:
            of_known, at = at, np.full(len(rows), len(keys))
            at[known] = of_known
        found = np.zeros((len(keys) + 1, 1 if k == self.order else 5))
        for _, shard, here, place in self.find(f"level{k}", keys):
            if len(here):
                found[here] = shard.distinct[shard.values(0, place)]
        return found, at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        column = batch.column(0)
        for lo, hi in w.blocks(column):
            yield w.text_bytes(column.slice(lo, hi - lo))


def _counted(parts: Iterator[_Grams], bits: int, id_type: str) -> Iterator[pa.RecordBatch]:
    """Adds n-grams up in bounded memory."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part.keys)
        if size >= PENDING:
            held = [_Grams.joined(held)]
            size = len(held[0].keys)
            if size > PENDING // 2:
                yield from held[0].rows(bits, id_type).to_batches()
                held, size = [], 0
    if held:
        yield from _Grams.joined(held).rows(bits, id_type).to_batches()


def _count_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    def parts():
        for data, offsets in _blocks(batches):
            keys = tokens(data, offsets)[0]
            yield _Grams.merged(keys, keys.reshape(-1, 1), np.ones((len(keys), 1), np.uint8))
    return _counted(parts(), bits, "u8")


def _count_grams(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    def parts():
        for data, offsets in _blocks(batches):
            stream, sizes = tokens(data, offsets)
            found, at = np.unique(stream, return_inverse=True)
            ids = model.word_ids(found)[0]
            end = ids[np.searchsorted(found, END)]
            rows = grams(ids[at], sizes, end, model.order).astype(model.id_type)
            yield _Grams.merged(gram_keys(rows), rows, np.ones((len(rows), 1), np.uint8))
    return _counted(parts(), model.bits, model.id_type)


def _group(part: pa.Table, k: int, columns: int, keys_of) -> _Grams:
    held = []
    for size, ids, stats in zip(*(part[c].to_pylist() for c in ("size", "ids", "stats"))):
        rows = _from_planes(ids, size, k)
        held.append(_Grams(keys_of(rows), rows, _from_planes(stats, size, columns)))
    return _Grams.joined(held)


def _write_words(part: pa.Table, model: Model) -> pa.Table:
    shard = part["shard"][0].as_py()
    group = _group(part, 1, 1, lambda rows: rows[:, 0].astype(np.uint64))
    rank = np.empty_like(group.stats)
    rank[np.lexsort((group.keys, -group.stats[:, 0].astype(np.int64))), 0] = np.arange(len(rank))
    group.stats = np.concatenate([group.stats, rank], axis=1)
    model.write("word", shard, group, whole=True)
    return pa.table({"shard": pa.array([shard], pa.int32()), "size": [len(group.keys)],
                     "total": [int(group.stats[:, 0].sum())]})


def _write_level(part: pa.Table, model: Model, k: int) -> pa.Table:
    """Write a shard of a level; send what it knows of the next shorter n-grams to their shards."""
    shard = part["shard"][0].as_py()
    if shard == TOTALS:
        return _add_totals(part)
    group = _group(part, k, 1 if k == model.order else 5, gram_keys)
    model.write(f"level{k}", shard, group)
    seen = group.stats[:, 0] > 0  # a context may start a text only, so nothing is before it
    count = group.stats[seen, 0]
    totals = [int((count == c).sum()) for c in (1, 2, 3, 4)] + [int((count > 2).sum()), int(count.sum())]
    out = [_rows([(TOTALS, k, b"", np.array(totals, "<i8").tobytes())])]
    if k > 1:
        ids, n = group.ids[seen], len(count)
        before, after = np.zeros((2, n, 5), _small(count).dtype)
        for j in (1, 2, 3):
            before[:, j] = np.minimum(count, 3) == j
        before[:, 4] = count
        after[:, 0] = 1
        both = np.concatenate([ids[:, :-1], ids[:, 1:]])
        out += [_Grams.merged(gram_keys(both), both, np.concatenate([before, after]))
                .rows(model.bits, model.id_type), _rows([(shard, 0, b"", b"")])]
    return pa.concat_tables(out)


def _add_totals(part: pa.Table) -> pa.Table:
    """A row per level."""
    totals = {}
    for k, numbers in zip(part["size"].to_pylist(), part["stats"].to_pylist()):
        totals[k] = totals.get(k, 0) + np.frombuffer(numbers, "<i8")
    return _rows([(TOTALS, k, b"", t.tobytes()) for k, t in totals.items()])


def _level_writer(model: Model, k: int):
    return lambda part: _write_level(part, model, k)


def _discounts(n: list[int]) -> tuple[float, ...]:
    """Modified Kneser-Ney discounts from the numbers of counts 1 to 4. One that cannot be estimated,
    or is not positive, which would leave unseen words nothing, is half its count."""
    halves = (0.5, 1.0, 1.5)
    if n[0] == 0:
        return halves
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0 for k in (1, 2, 3)]
    return tuple(d if d > 0 else half for d, half in zip(raw, halves))


def fit(texts: DataFrame, order: int = ORDER) -> Model:
    """Count the first column of `texts` and write the model. The driver sees a row per level."""
    if order < 1:
        raise ValueError("the order of a model is 1 or more")
    spark = texts.sparkSession
    small_batches(spark)
    folder = work_folder(spark, "kneser-ney")
    shards = shards_for(texts, texts.columns[0], INPUT_PER_SHARD)
    bits = shards.bit_length() - 1
    every = spark.range(shards).selectExpr(
        "cast(id as int) as shard", "0 as size", "cast('' as binary) as ids",
        "cast('' as binary) as stats")  # so that shards without an n-gram have a file

    empty = Model(folder, bits, 0, 0, order=order)
    words, total, most = (
        texts.mapInArrow(lambda b: _count_words(b, bits), _ROWS).union(every)
        .groupBy("shard").applyInArrow(lambda t: _write_words(t, empty),
                                       "shard int, size long, total long")
        .agg(F.sum("size"), F.sum("total"), F.max("size")).first())
    if words == 0:
        return empty
    id_type = "u4" if most << bits < 1 << 32 else "u8"
    model = Model(folder, bits, words, total, id_type, order)

    rows = texts.mapInArrow(lambda b: _count_grams(b, model), _ROWS).union(every)
    for k in range(order, 0, -1):
        rows = rows.groupBy("shard").applyInArrow(_level_writer(model, k), _ROWS)
    rows = rows.groupBy("shard").applyInArrow(_add_totals, _ROWS)
    totals = {r["size"]: np.frombuffer(r["stats"], "<i8").tolist() for r in rows.collect()}
    cuts = tuple(_discounts(totals[k][:4]) for k in range(1, order + 1))
    ones, twos, _, _, more, mass = totals[1]
    spread = (cuts[0][0] * ones + cuts[0][1] * twos + cuts[0][2] * more) / mass
    return replace(model, cuts=cuts, mass=mass, spread=spread)


def token_scores(model: Model, stream: np.ndarray, sizes: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of texts of `sizes` tokens: its training count, the log10 of its smoothed unigram
    probability (one added to each count), and the log10 of its Kneser-Ney probability."""
    if model.words == 0:
        zero = np.zeros(len(stream))
        return zero.astype(np.int64), zero, zero
    found, at = np.unique(stream, return_inverse=True)
    ids, counts = model.word_ids(found)
    base = np.log10((counts + 1) / (model.tokens + model.words + 1))
    end = ids[np.searchsorted(found, END)]
    context = np.concatenate([[len(stream)], np.arange(len(stream) - 1)])
    context[np.cumsum(sizes) - sizes] = len(stream)
    p = np.full(len(stream), 1 / (model.words + 1))
    total, left = float(max(model.mass, 1)), model.spread
    for k in range(1, model.order + 1):
        # The context of a token is the n-gram that ends before it; the last row is that of a start.
        if k == 1:
            stats, which = model.level(1, np.append(ids, end).reshape(-1, 1))
            which = np.append(which[at], which[-1])
        else:
            stats, which = model.level(k, np.concatenate([grams(ids[at], sizes, end, k),
                                                          np.full((1, k), end)]))
        cut = np.array([0.0, *model.cuts[k - 1]])
        count = stats[:, 0]
        sure = np.maximum(count - cut[np.minimum(count, 3).astype(np.int64)], 0)
        p = sure[which[:-1]] / total + left * p
        if k < model.order:
            before, sums = which[context], np.maximum(stats[:, 4], 1)
            lost = sum(c * stats[:, j] for j, c in enumerate(model.cuts[k], 1))
            total = sums[before]
            left = np.where(stats[:, 4] > 0, lost / sums, 1.0)[before]
    return counts[at], base[at], np.log10(p)


_SCORES = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def scorer(model: Model):
    """A column function: n_tokens, n_known, base_score and score of each text."""
    def score(column: pa.Array) -> pa.Array:
        parts = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2]
        for lo, hi in w.blocks(column):
            stream, sizes = tokens(*w.text_bytes(column.slice(lo, hi - lo)))
            count, base, best = token_scores(model, stream, sizes)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            add = lambda x: np.add.reduceat(x, first)
            parts.append([sizes, add((count > 0).astype(np.int64)), add(base), add(best)])
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], _SCORES.names)

    return F.arrow_udf(score, _SCORES)


def perplexity(score, n_tokens):
    """Perplexity from a text's log10 probability."""
    return F.pow(F.lit(10.0), -score / n_tokens)
