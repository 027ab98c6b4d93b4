"""Removal of repeated strings, on a sparse suffix array sorted deep-shallow.

Every byte goes that a string of LENGTH bytes covers which also starts anywhere else. The work is on
sampled suffixes:

1. A window of LENGTH bytes holds LENGTH - GRAM + 1 grams; the one with the least hash (leftmost of
   equal ones) is its anchor. Equal windows have equal anchors at equal places, so only suffixes that
   start at anchors (about one in 170 bytes) need sorting. An anchor's context is what the windows
   around it can reach: LENGTH - GRAM bytes before it, LENGTH bytes from it on.
2. Anchors are counted by gram and by whole context. A gram that occurs once repeats nothing. A
   context that occurs again is repeated as a whole. Only the other contexts of repeated grams, with
   one representative of each repeated context, are compared byte by byte.
3. The contexts of a gram meet in one task, which sorts their suffixes, and their reversed prefixes,
   by multikey quicksort to a shallow depth and by blind tries below it. Along the tree of common
   prefixes it finds for each context how far a string shared with another reaches to both sides.
4. Grams with more than GROUP contexts are settled by counting: each window through an anchor of
   theirs is hashed (128 bits), and windows that start at two places are repeated. That is exact as
   well and needs no group.
5. The repeated stretches go back to the texts that hold them.

Passages of PASSAGE words that another row holds too may be shorter than LENGTH bytes. They stay, but
are told (`shares_passage`). Each window of PASSAGE words has its least SHINGLE-word hash as anchor;
rows that share a window share its anchor. Rows whose anchors have an equal window settle most texts,
and only for anchors that an unsettled text shares, all their windows are counted.

Texts are UTF-8 bytes, null is empty, and a match never crosses texts. A row is known by
128 bits of its id and text, so rows that repeat both share their stretches, and repeat each other. Texts shorter than LENGTH
lose nothing. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored
from meterline.llm import words as w
from meterline.llm.frames import lookup, small_batches

LENGTH, GRAM = 400, 64
BEFORE = LENGTH - GRAM
GROUP = 20_000
SHALLOW = 32
SEGMENT = 1 << 21
PASSAGE, SHINGLE = 50, 8
_PLACE = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=1)
def _codec() -> tuple:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(text) -> bytes:
    return _codec()[0].compress(text)


def unpack(packed: bytes) -> bytes:
    return _codec()[1].decompress(packed)


# --- anchors ---------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = w._TABLE[data]
    size, base = 1, w._BASE
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base & w._M64
        size *= 2
    return w.mix(h)


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window that starts at each place, and the gram hash of each place."""
    hashes = gram_hashes(data)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span, size = BEFORE + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[:size - span], least[span - size:])
    return (least & _PLACE).astype(np.int64), hashes


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def text_key(text, doc_id: int | None) -> tuple[int, int]:
    """128 bits that name a text of a document; rows that repeat both share it."""
    h = xxhash.xxh3_128_intdigest(text, 1 if doc_id is None else mix_int(doc_id))
    return h >> 64, h & w._M64


def mix_int(x: int) -> int:
    return int(w.mix(np.array([x & w._M64], np.uint64))[0])


_ANCHORS = "t1 long, t2 long, pos int, gram long, c1 long, c2 long"


def _anchors(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT
             ) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in w.blocks(batch.column("text"), 1 << 20):
            part = batch.slice(lo, hi - lo)
            data, offsets = w.text_bytes(part.column("text"))
            yield from _block_anchors(data, offsets, part.column("doc_id"), segment)


def _block_anchors(data: np.ndarray, offsets: np.ndarray, ids: pa.Array, segment: int = SEGMENT
                   ) -> Iterator[pa.RecordBatch]:
    """Each anchor once: windows of two segments may share one, so the last place is carried over."""
    view, names, last = memoryview(data), ids.to_pylist(), -1
    for at in range(0, max(len(data) - LENGTH + 1, 0), segment):
        anchor, hashes = window_anchors(data[at:at + segment + LENGTH - 1])
        start = np.arange(len(anchor)) + at
        doc = np.searchsorted(offsets, start, "right") - 1
        inside = start + LENGTH <= offsets[doc + 1]
        anchor, doc = anchor[inside], doc[inside]
        if len(anchor) == 0:
            continue
        place = anchor + at
        new = place != np.concatenate([[last], place[:-1]])  # no place is in two texts
        last = int(place[-1])
        anchor, doc, place = anchor[new], doc[new], place[new]
        if len(anchor) == 0:
            continue
        gram = hashes[anchor]
        lo, hi = offsets[doc], offsets[doc + 1]
        left, right = np.minimum(place - lo, BEFORE), np.minimum(hi - place, LENGTH)
        keys = {d: text_key(view[offsets[d]:offsets[d + 1]], names[d])
                for d in np.unique(doc).tolist()}
        context = [xxhash.xxh3_128_intdigest(view[p - a:p + b], a) for p, a, b in
                   zip(place.tolist(), left.tolist(), right.tolist())]
        docs = doc.tolist()
        yield pa.RecordBatch.from_arrays(
            [_signed([keys[d][0] for d in docs]), _signed([keys[d][1] for d in docs]),
             pa.array((place - lo).astype(np.int32)), pa.array(gram.view(np.int64)),
             _signed([c >> 64 for c in context]), _signed([c & w._M64 for c in context])],
            ["t1", "t2", "pos", "gram", "c1", "c2"])


# --- deep-shallow sorting --------------------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if x == 0 else (8 * n - x.bit_length()) // 8


class _Node:
    __slots__ = ("depth", "below")

    def __init__(self, depth: int):
        self.depth, self.below = depth, {}


def blind_trie_order(strings: list[bytes], ids: list[int]) -> list[int]:
    """The ids in the order of their strings. Nodes know where strings part, not what they share:
    a string walks down by the bytes at those places alone, is compared once with the leaf it comes
    to, and then put where it parts from it. A string that ends sorts first."""
    byte = lambda s, d: s[d] if d < len(s) else -1
    root: _Node | list[int] = [ids[0]]  # a leaf holds equal strings
    for i in ids[1:]:
        s, at = strings[i], root
        while isinstance(at, _Node):
            at = at.below.get(byte(s, at.depth)) or next(iter(at.below.values()))
        other = strings[at[0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            at.append(i)
            continue
        above, at = None, root
        while isinstance(at, _Node) and at.depth < depth:
            above, at = at, at.below[byte(s, at.depth)]
        if isinstance(at, _Node) and at.depth == depth:
            at.below[byte(s, depth)] = [i]
            continue
        node = _Node(depth)
        node.below = {byte(other, depth): at, byte(s, depth): [i]}
        if above is None:
            root = node
        else:
            above.below[byte(s, above.depth)] = node
    out: list[int] = []
    stack = [root]
    while stack:
        at = stack.pop()
        if isinstance(at, _Node):
            stack += [at.below[b] for b in sorted(at.below, reverse=True)]
        else:
            out += at
    return out


def deep_shallow_order(strings: list[bytes], depth: int = 0) -> list[int]:
    """Order of strings that share `depth` bytes: multikey quicksort on eight bytes at a time down
    to SHALLOW bytes more, then blind tries."""
    deep, out = depth + SHALLOW, []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        ids, d = stack.pop()
        if len(ids) <= 1:
            out += ids
        elif d >= deep:
            out += blind_trie_order(strings, ids)
        else:
            word = {i: strings[i][d:d + 8] for i in ids}
            pivot = word[ids[len(ids) // 2]]
            parts: tuple[list, list, list] = ([], [], [])
            for i in ids:
                parts[(word[i] > pivot) - (word[i] < pivot) + 1].append(i)
            ended = len(pivot) < 8
            stack += [(parts[2], d), (parts[1], deep if ended else d + 8), (parts[0], d)]
    return out


def shared_reach(lefts: list[bytes], rights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each context (left: reversed bytes before the anchor, right: bytes from it on) how far
    strings of LENGTH bytes or more that it shares with another context reach to the left and to
    the right; zero where there is none.

    Contexts of a node of the tree of left parts share `depth` bytes there. Among them the one next
    in the order of right parts shares most to the right. Taking all nodes above a context finds
    its every pair at the node where the two part, or a better pair."""
    n = len(lefts)
    to_left, to_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 2:
        a, b = common(*lefts), common(*rights)
        if a + b >= LENGTH:
            to_left[:], to_right[:] = a, b
        return to_left, to_right
    suffix = np.array(deep_shallow_order(rights, GRAM))
    right_lcp = np.array([0] + [common(rights[x], rights[y]) for x, y in zip(suffix, suffix[1:])])
    rank = np.empty(n, np.int64)
    rank[suffix] = np.arange(n)
    prefix = np.array(deep_shallow_order(lefts))
    left_lcp = np.array([0] + [common(lefts[x], lefts[y]) for x, y in zip(prefix, prefix[1:])])
    stack = [(0, n)]
    while stack:
        i, j = stack.pop()
        inner = left_lcp[i + 1:j]
        depth = int(inner.min())
        members = prefix[i:j]
        members = members[np.argsort(rank[members])]
        at = rank[members]
        between = _between(right_lcp, at)
        best = np.zeros(len(at), np.int64)
        best[1:] = between
        best[:-1] = np.maximum(best[:-1], between)
        ok = depth + best >= LENGTH
        hit = members[ok]
        to_left[hit] = np.maximum(to_left[hit], depth)
        to_right[hit] = np.maximum(to_right[hit], best[ok])
        cuts = [i, *(np.flatnonzero(inner == depth) + i + 1).tolist(), j]
        stack += [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
    return to_left, to_right


def _between(lcp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least common prefix over the places from each of `at` to the next."""
    edges = np.empty(2 * len(at) - 2, np.int64)
    edges[::2], edges[1::2] = at[:-1] + 1, at[1:] + 1
    if edges[-1] == len(lcp):
        return np.minimum.reduceat(lcp, edges[:-1])[::2]
    return np.minimum.reduceat(lcp, edges)[::2]


_CONTEXT = "gram long, t1 long, t2 long, pos int, again boolean, before binary, after binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted contexts out of their texts."""
    for batch in batches:
        names = ("gram", "t1", "t2", "pos", "again", "before", "after")
        out: dict[str, list] = {n: [] for n in names}
        rows = zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "wanted", "packed")))
        for t1, t2, wanted, packed in rows:
            text = unpack(packed)
            for x in wanted:
                p = x["pos"]
                row = (x["gram"], t1, t2, p, x["again"],
                       text[max(p - BEFORE, 0):p][::-1], text[p:p + LENGTH])
                for n, v in zip(names, row):
                    out[n].append(v)
            if len(out["gram"]) > 4096:
                yield _rows(out)
                out = {n: [] for n in names}
        if out["gram"]:
            yield _rows(out)


def _rows(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"pos": pa.int32(), "again": pa.bool_(), "before": pa.binary(), "after": pa.binary()}
    return pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64()))
                                       for n, v in out.items()})


_REACH = "t1 long, t2 long, pos int, to_left int, to_right int"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of contexts with one gram, in partitions sorted by gram."""
    held: list[dict] = []
    out: list[tuple] = []

    def close() -> None:
        unique = list({(r["before"], r["after"]): r for r in held}.values())
        held.clear()
        if len(unique) < 2:
            return
        reach = shared_reach([r["before"] for r in unique], [r["after"] for r in unique])
        for r, a, b in zip(unique, *(x.tolist() for x in reach)):
            if b and not r["again"]:
                out.append((r["t1"], r["t2"], r["pos"], a, b))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(columns)],
            ["t1", "t2", "pos", "to_left", "to_right"])

    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            for r in batch.slice(i, 1024).to_pylist():
                if held and held[0]["gram"] != r["gram"]:
                    close()
                held.append(r)
        if len(out) > 4096:
            yield flush()
    if held:
        close()
    yield flush()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of all windows through the wanted anchors of a text, each place once."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "wanted", "packed")))
        for t1, t2, wanted, packed in rows:
            text = memoryview(unpack(packed))
            most, done = len(text) - LENGTH + 1, 0
            for a in sorted(x["pos"] for x in wanted):
                places = range(max(a - BEFORE, done), min(a + 1, most))
                done = max(done, places.stop)
                hashes = [xxhash.xxh3_128_intdigest(text[p:p + LENGTH]) for p in places]
                if hashes:
                    yield pa.RecordBatch.from_arrays(
                        [_signed([h >> 64 for h in hashes]), _signed([h & w._M64 for h in hashes]),
                         pa.array([t1] * len(hashes), pa.int64()),
                         pa.array([t2] * len(hashes), pa.int64()),
                         pa.array(places, pa.int32())], ["h1", "h2", "t1", "t2", "pos"])


# --- passages --------------------------------------------------------------------------------

def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n values from each place on, for at least n values."""
    out, done, base = None, 0, w._BASE
    size, total = 1, len(h)
    while True:
        if n & size:
            room = total - done - size + 1
            out = h if out is None else out[:room] * np.uint64(base) + h[done:done + room]
            done += size
        if done == n:
            return w.mix(out)
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base & w._M64
        size *= 2


def passage_windows(data: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT
                    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, anchor and hash of the windows of PASSAGE words, `segment` windows at a time."""
    starts, ends = w.word_bounds(data, offsets, w.not_space())
    of, hashes = w.words_per_text(starts, offsets), w.word_hashes(data, starts, ends)
    for at in range(0, len(hashes) - PASSAGE + 1, segment):
        part = hashes[at:at + segment + PASSAGE - 1]
        least = run_hashes(part, SHINGLE)
        span, size = PASSAGE - SHINGLE + 1, 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if span > size:
            least = np.minimum(least[:size - span], least[span - size:])
        first = np.arange(len(least)) + at
        doc = np.searchsorted(of, first, "right") - 1
        inside = first + PASSAGE <= of[doc + 1]
        yield doc[inside], least[inside], run_hashes(part, PASSAGE)[inside]


_PASSAGES = "t1 long, t2 long, gram long, win long"


def _passage_rows(t1: pa.Array, t2: pa.Array, gram: np.ndarray, win: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [t1, t2, pa.array(gram.view(np.int64)), pa.array(win.view(np.int64))],
        ["t1", "t2", "gram", "win"])


def _passage_anchors(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT
                     ) -> Iterator[pa.RecordBatch]:
    """Each anchor of a text once, with one of its windows."""
    for batch in batches:
        for lo, hi in w.blocks(batch.column("text"), 1 << 18):
            part = batch.slice(lo, hi - lo)
            data, offsets = w.text_bytes(part.column("text"))
            found = []
            for doc, gram, win in passage_windows(data, offsets, segment):
                new = np.ones(len(doc), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
                found.append((doc[new], gram[new], win[new]))
            doc, gram, win = (np.concatenate(x) for x in zip(*found)) if found else [[]] * 3
            if len(doc) == 0:
                continue
            order = np.lexsort((gram, doc))
            doc, gram, win = doc[order], gram[order], win[order]
            new = np.ones(len(doc), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
            doc, gram, win = doc[new], gram[new], win[new]
            view, names = memoryview(data), part.column("doc_id").to_pylist()
            keys = {d: text_key(view[offsets[d]:offsets[d + 1]], names[d])
                    for d in np.unique(doc).tolist()}
            docs = doc.tolist()
            yield _passage_rows(_signed([keys[d][0] for d in docs]),
                                _signed([keys[d][1] for d in docs]), gram, win)


def _passage_windows(batches: Iterator[pa.RecordBatch], segment: int = SEGMENT
                     ) -> Iterator[pa.RecordBatch]:
    """Each different window at the wanted anchors of a text once."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "asked", "packed")))
        for t1, t2, asked, packed in rows:
            data = np.frombuffer(unpack(packed), np.uint8)
            wanted = np.array(asked, np.int64).view(np.uint64)
            found = [np.zeros((0, 2), np.uint64)]
            for _, gram, win in passage_windows(data, np.array([0, len(data)]), segment):
                hit = np.isin(gram, wanted)
                found.append(np.column_stack([gram[hit], win[hit]]))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield _passage_rows(pa.array([t1] * len(pairs), pa.int64()),
                                pa.array([t2] * len(pairs), pa.int64()),
                                pairs[:, 0].copy(), pairs[:, 1].copy())


def at_repeated_grams(rows: DataFrame) -> DataFrame:
    """The rows whose gram another row has too; those of a frequent gram go to several tasks."""
    often = rows.groupBy("gram").count().where("count > 1").select("gram", F.lit(True).alias("often"))
    return lookup(rows, often, "gram").where("often").drop("often")


def shared_passages(docs: DataFrame, keyed: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(t1, t2) of the texts that hold PASSAGE words in a row which another row holds too."""
    anchors = stored(docs.mapInArrow(lambda b: _passage_anchors(b, segment), _PASSAGES), "passages")
    rows = stored(at_repeated_grams(anchors), "passage-rows")
    equal = stored(rows.groupBy("gram", "win").count().where("count > 1").select("gram", "win"),
                   "equal")
    sure = stored(rows.join(equal, ["gram", "win"], "left_semi").select("t1", "t2").distinct(), "sure")
    unsure = stored(rows.join(sure, ["t1", "t2"], "left_anti").select("t1", "t2", "gram"), "unsure")
    asked = rows.join(unsure.select("gram").distinct(), "gram", "left_semi")

    def windows(of: DataFrame) -> DataFrame:
        wanted = of.groupBy("t1", "t2").agg(F.collect_list("gram").alias("asked"))
        return keyed.join(wanted, ["t1", "t2"]).mapInArrow(
            lambda b: _passage_windows(b, segment), _PASSAGES)

    again = windows(asked).groupBy("gram", "win").count().where("count > 1").select("gram", "win")
    found = windows(unsure).join(again, ["gram", "win"], "left_semi").select("t1", "t2")
    return sure.union(found.distinct())


# --- the whole -------------------------------------------------------------------------------

_PACKED = T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()),
                        T.StructField("packed", T.BinaryType())])


@F.arrow_udf(_PACKED)
def packed_text(column: pa.Array, ids: pa.Array) -> pa.Array:
    """Key and compressed bytes of each text: what the joins deal out."""
    data, offsets = w.text_bytes(column)
    raw = memoryview(data)
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    keys = [text_key(t, i) for t, i in zip(texts, ids.to_pylist())]
    return pa.StructArray.from_arrays(
        [_signed([k[0] for k in keys]), _signed([k[1] for k in keys]),
         pa.array([pack(t) for t in texts], pa.binary())], _PACKED.names)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, packed. All joins take these columns and no others, so that Spark deals the
    texts out once for all of them."""
    return docs.select("doc_id", packed_text("text", "doc_id").alias("k")).select(
        "doc_id", "k.*").where("t1 is not null and t2 is not null")


def repeated_stretches(docs: DataFrame, keyed: DataFrame, group: int = GROUP,
                       segment: int = SEGMENT) -> DataFrame:
    """(t1, t2, spans): by hash of the text, the repeated stretches around its anchors."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = stored(docs.mapInArrow(lambda b: _anchors(b, segment), _ANCHORS), "anchors")
    anchors = stored(at_repeated_grams(every), "often")
    contexts = anchors.groupBy("gram", "c1", "c2").agg(
        F.count("*").alias("n"), F.min(F.struct("t1", "t2", "pos")).alias("first"))
    grams = contexts.groupBy("gram").agg(F.count("*").alias("contexts"))
    contexts = stored(contexts.join(grams, "gram"), "contexts")
    whole = (anchors.join(contexts.where("n > 1").select("gram", "c1", "c2"),
                          ["gram", "c1", "c2"], "left_semi")
             .selectExpr("t1", "t2", "pos", f"{BEFORE} as to_left", f"{LENGTH} as to_right"))

    open_ = contexts.where("contexts > 1")
    wanted = open_.groupBy("first.t1", "first.t2").agg(F.collect_list(F.struct(
        "gram", "first.pos", F.expr("n > 1").alias("again"), "contexts")).alias("wanted"))
    joined = keyed.join(wanted, ["t1", "t2"])

    def of(condition: str) -> DataFrame:
        return joined.withColumn("wanted", F.expr(f"filter(wanted, x -> {condition})")).where(
            "size(wanted) > 0")

    sorted_ = (of(f"x.contexts <= {group}").mapInArrow(_contexts, _CONTEXT)
               .repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_compare, _REACH))
    found = whole.union(sorted_)
    if not open_.where(F.col("contexts") > group).isEmpty():
        windows = of(f"x.contexts > {group}").mapInArrow(
            _windows, "h1 long, h2 long, t1 long, t2 long, pos int")
        again = windows.groupBy("h1", "h2").count().where("count > 1").drop("count")
        found = found.union(windows.join(again, ["h1", "h2"], "left_semi").selectExpr(
            "t1", "t2", "pos", "0 as to_left", f"{LENGTH} as to_right"))
    spans = found.groupBy("t1", "t2", "pos").agg(F.max("to_left").alias("a"),
                                                 F.max("to_right").alias("b"))
    return spans.groupBy("t1", "t2").agg(
        F.collect_list(F.expr(
            "struct(greatest(pos - a, 0) as start, pos + b as end)")).alias("spans"))


_DIGEST = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept_text", T.BinaryType()),
    T.StructField("kept_sha256", T.StringType())])


def _cut(with_text: bool):
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for packed, found in zip(texts.to_pylist(), spans.to_pylist()):
            raw = memoryview(unpack(packed))
            size, kept, at, removed, count = len(raw), [], 0, 0, 0
            merged: list[list[int]] = []
            for s in sorted((x["start"], min(x["end"], size)) for x in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            for s, e in merged:
                kept.append(raw[at:s])
                at, removed, count = e, removed + e - s, count + 1
            text = b"".join([*kept, raw[at:]])
            rows.append((size, removed, count, text if with_text else None,
                         hashlib.sha256(text).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], _DIGEST.names)
    return F.arrow_udf(cut, _DIGEST)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                   with_text: bool = True, group: int = GROUP, segment: int = SEGMENT
                   ) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text (the remaining bytes; they may break inside a
    character), kept_sha256 and shares_passage (PASSAGE words in a row that another row holds too)
    of each row."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = keyed_texts(narrow)
    spans = repeated_stretches(narrow, keyed, group, segment)
    passages = shared_passages(narrow, keyed, segment).withColumn("shares_passage", F.lit(True))
    return (keyed.join(spans, ["t1", "t2"], "left").join(passages, ["t1", "t2"], "left")
            .select("doc_id", _cut(with_text)("packed", "spans").alias("x"),
                    F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"))
            .select("doc_id", "x.*", "shares_passage"))
