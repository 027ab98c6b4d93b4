"""Links between the tokens of two tokenizers over the same texts.

Both token lists of a text are incidence matrices over its bytes, in compressed sparse rows: a row
per token, an entry per byte. Gustavson's row products of the first and the transpose of the second
are the overlap links, pairs of tokens that share bytes. Where the two tokens of such a link end at
the same byte, the text is cut; between two cuts lies a group. Row products of the group incidence
matrices are the shared-group links: all pairs of tokens of one group.

Neither tokenizer has a token across certain cuts (see _SEGMENTS), so both end a token there and no
group or link crosses one. The work above is done once per distinct segment between two cuts, and
what a text holds is a row product again: how often it has each segment, by the links of the segment.

An id pair's count is the number of texts that hold it linked. Texts are encoded once and written as
blocks of bounded size: the distinct id pairs of a block, and per text which of them it holds and how
often. Pairs are counted over blocks, the counts join the pairs of each block, and come back to its
texts block by block. So no task holds more than a block, and a pair that stands in every text is one
row per block.

Only id and text are read, so other columns cannot clash; the id keeps its type, may be null, and may
repeat (each row counts as a text of its own). A text that is null, empty, or whose tokens do not
spell it has no tokens: zeros, and '' in place of a digest. Long texts are worked through in row
blocks of at most PRODUCTS products. Equal counts of an id all count as its best. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored
from meterline.llm import words as w
from meterline.llm.frames import small_batches

BLOCK = 8 << 20
PIECE = 1 << 20
PRODUCTS = 1 << 21
KNOWN = 1 << 18
LONG = 256  # characters of a segment that is not kept
FIGURES = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


# --- sparse rows -----------------------------------------------------------------------------

class Csr(NamedTuple):
    """A matrix in compressed sparse rows."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1


def from_sorted(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int,
                width: int) -> Csr:
    """A matrix of entries that ascend by row."""
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=height))])
    return Csr(starts, columns, values, width)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(m.height), np.diff(m.starts))
    columns, values = m.columns, m.values
    if not (columns[1:] >= columns[:-1]).all():
        order = np.argsort(columns, kind="stable")
        columns, rows, values = columns[order], rows[order], values[order]
    return from_sorted(columns, rows, values, m.width, m.height)


def row_products(a: Csr, b: Csr, limit: int = PRODUCTS
                 ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (row, column, value) of a·b in order, by Gustavson: row i of the product is the sum of
    the rows of b that the entries of row i of a name. Rows go in blocks of at most `limit`
    products; a row with more stands alone."""
    fan = np.diff(b.starts)[a.columns]
    upto = np.concatenate([[0], np.cumsum(fan)])[a.starts]
    i = 0
    while i < a.height:
        j = min(max(int(np.searchsorted(upto, upto[i] + limit, "right")) - 1, i + 1), a.height)
        lo, hi = a.starts[i], a.starts[j]
        n = fan[lo:hi]
        row = np.repeat(np.repeat(np.arange(i, j), np.diff(a.starts[i:j + 1])), n)
        at = np.arange(len(row)) + np.repeat(b.starts[a.columns[lo:hi]] - (np.cumsum(n) - n), n)
        value = np.repeat(a.values[lo:hi], n) * b.values[at]
        key = row * b.width + b.columns[at]
        if len(key) > 1 and not (key[1:] >= key[:-1]).all():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, value = key[first], np.add.reduceat(value, first)
            yield key // b.width, key % b.width, value
        i = j


def byte_incidence(sizes: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens of the given sizes that stand one after the other."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def id_counts(groups: np.ndarray, ids: np.ndarray, n_groups: int, n_ids: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, tokens) of the distinct ids of each group, ascending."""
    key = groups * n_ids + ids
    if len(key) > 1 and not (key[1:] >= key[:-1]).all():
        key = np.sort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    count = np.diff(np.concatenate([first, [len(key)]]))
    return key[first] // n_ids, key[first] % n_ids, count


# --- tokenizers ------------------------------------------------------------------------------

class Vocabulary(NamedTuple):
    pieces: list[bytes]
    sizes: np.ndarray

    def spelled(self, ids: list[list[int]]) -> Iterator[bytes]:
        """The bytes of each list of ids."""
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        whole = b"".join(map(self.pieces.__getitem__, flat.tolist()))
        upto = np.concatenate([[0], np.cumsum(self.sizes[flat])])
        at = upto[np.cumsum([0, *map(len, ids)])].tolist()
        return (whole[a:b] for a, b in zip(at, at[1:]))


def _vocabulary(pieces: list[bytes]) -> Vocabulary:
    return Vocabulary(pieces, np.array([len(p) for p in pieces], np.int64))


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Characters whose classes all Unicode versions agree on, and their segments. A segment
# ends where white space follows something else (a carriage return does not end one unless it follows a
# letter, as some vocabularies have it behind marks), or something else follows a letter. Byte-level BPE
# cuts there before it merges; so do the merges of another vocabulary if no piece of it holds a cut.
_SETTLED = re.compile(r"[\t\n\r\x20-\x7E\u00C0-\u017F]*")
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F"
_SEGMENTS = re.compile(
    rf"\s*+(?:[^\s{_LETTERS}]++\r\s*+)*+[^\s{_LETTERS}]*+[{_LETTERS}]*+").findall


def segments(text: str) -> list[str]:
    """The segments of a text of settled characters."""
    return _SEGMENTS(text)[:-1]  # the last match is empty, at the end


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; encodes a space and the text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        cuts = parts["pre_tokenizer"] or {}
        self.by_segment = (
            parts["normalizer"] is None and cuts.get("type") == "ByteLevel"
            and cuts.get("use_regex", True) and not cuts.get("add_prefix_space", True)
            and not parts["model"].get("dropout") and parts["truncation"] is None
            and all(t["special"] for t in parts["added_tokens"]))
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        pieces = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) \
                else token.encode()
        self.vocabulary = _vocabulary(pieces)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_segments(self, parts: list[str]) -> list[list[int]]:
        """Parts that begin with white space and end otherwise go as one text, which has a cut between
        them; the others go one by one."""
        joint = [p[0].isspace() and not p[-1].isspace() for p in parts]
        together = [p for p, j in zip(parts, joint) if j]
        ids = self._ids(["".join(together)])[0]
        ends = np.cumsum(self.vocabulary.sizes[np.array(ids, np.int64)])
        stops = np.cumsum([len(p.encode()) for p in together])
        at = [0, *(np.searchsorted(ends, stops) + 1).tolist()]
        of_joint = (ids[a:b] for a, b in zip(at, at[1:]))
        alone = iter(self._ids([p for p, j in zip(parts, joint) if not j]))
        return [next(of_joint if j else alone) for j in joint]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._ids([f" {t}" for t in texts])


class Pieces:
    """A model of the sentencepiece library, which puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece) if self.model.is_byte(i) else None
            pieces.append(bytes([int(byte[1], 16)]) if byte
                          else piece.replace("▁", " ").encode())
        self.vocabulary = _vocabulary(pieces)
        self.by_segment = self._merges_only(path) and not any(
            len(segments(p)) > 1 for p in map(self._text_of, range(len(pieces))) if _SETTLED.fullmatch(p))

    def _text_of(self, i: int) -> str:
        """What a piece spells in texts; '' if only its own kind of use brings it about."""
        special = self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)
        return "" if special else self.model.id_to_piece(i).replace("▁", " ")

    @staticmethod
    def _merges_only(path: str) -> bool:
        """Whether the model merges the characters of a space and the text as they are."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trained, normal, kind = model.trainer_spec, model.normalizer_spec, model.SentencePiece
        return (trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix
                and normal.add_dummy_prefix and normal.escape_whitespaces
                and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
                and not any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces))

    def encode_segments(self, parts: list[str]) -> list[list[int]]:
        """A letter goes before each part, where the model puts its space; a part does not begin with
        one, so there is a cut between them."""
        before = len(self.model.encode("a"))
        return [ids[before:] for ids in self.encode([f"a{p}" for p in parts])]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteLevel | Pieces:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


# --- texts -----------------------------------------------------------------------------------

class Aligned(NamedTuple):
    """Token ids of texts one after the other, the group of each token, and the overlap links of
    each text. Groups are numbered through the texts."""

    n_texts: int
    ids: tuple[np.ndarray, np.ndarray]
    texts: tuple[np.ndarray, np.ndarray]
    groups: tuple[np.ndarray, np.ndarray]
    group_text: np.ndarray
    n_overlaps: np.ndarray


def align_ids(ids: tuple[list[list[int]], list[list[int]]],
              sizes: tuple[np.ndarray, np.ndarray], limit: int = PRODUCTS) -> Aligned:
    """Groups of texts whose two token lists spell the same bytes. `sizes` are the byte sizes of the
    two vocabularies."""
    n = len(ids[0])
    flat = [np.fromiter(chain.from_iterable(side), np.int64, sum(map(len, side))) for side in ids]
    text = [np.repeat(np.arange(n), [len(t) for t in side]) for side in ids]
    size = [s[f] for s, f in zip(sizes, flat)]
    ends = [np.cumsum(s) for s in size]
    overlaps = np.zeros(n, np.int64)
    last = [np.zeros(len(f), np.int64) for f in flat]
    for a, b, _ in row_products(byte_incidence(size[0]), transposed(byte_incidence(size[1])),
                                limit):
        overlaps += np.bincount(text[0][a], minlength=n)
        cut = ends[0][a] == ends[1][b]
        last[0][a[cut]] = last[1][b[cut]] = 1
    groups = [np.cumsum(side) - side for side in last]
    return Aligned(n, tuple(flat), tuple(text), tuple(groups), text[0][last[0] == 1], overlaps)


def linked_pairs(found: Aligned, n_ids: tuple[int, int], limit: int = PRODUCTS
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id pair, links) of the distinct id pairs that each text holds linked. A pair is
    `a * n_ids[1] + b`."""
    n = len(found.group_text)
    (ga, ia, ca), (gb, ib, cb) = (
        id_counts(g, i, n, k) for g, i, k in zip(found.groups, found.ids, n_ids))
    by_a = Csr(np.arange(len(ga) + 1), ga, ca, n)
    by_b = from_sorted(gb, ib, cb, n, n_ids[1])
    text, pair, times = [], [], []
    for row, b, links in row_products(by_a, by_b, limit):
        text.append(found.group_text[ga[row]])
        pair.append(ia[row] * n_ids[1] + b)
        times.append(links)
    if not text:
        return (np.zeros(0, np.int64),) * 3
    text, pair, times = (np.concatenate(x) for x in (text, pair, times))
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate(
        [[True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])]))
    return text[first], pair[first], np.add.reduceat(times, first)


@lru_cache(maxsize=4)
def _digits_below(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below `limit`, padded in front, and which of them are shown."""
    places = 10 ** np.arange(len(str(limit - 1)) - 1, -1, -1)
    numbers = np.arange(limit)[:, None]
    shown = numbers >= places
    shown[:, -1] = True
    return (numbers // places % 10 + 48).astype(np.uint8), shown


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    return _digits_below(1 << max(most, 1).bit_length())


def spelled_groups(found: Aligned) -> list[bytes]:
    """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
    n = len(found.group_text)
    in_a, in_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n))])
                  for g in found.groups)
    at_a = np.arange(len(found.ids[0])) + in_b[found.groups[0]]
    at_b = np.arange(len(found.ids[1])) + in_a[found.groups[1] + 1]
    ids = np.empty(len(at_a) + len(at_b), np.int64)
    ids[at_a], ids[at_b] = found.ids
    stops = np.full(len(ids), ord(","), np.uint8)
    stops[(in_a[1:] + in_b[:-1] - 1)] = ord("|")
    stops[(in_a[1:] + in_b[1:] - 1)] = ord(";")
    digits, shown_digits = _digits(int(ids.max()) if len(ids) else 0)
    width = digits.shape[1]
    cells = np.empty((len(ids), width + 1), np.uint8)
    cells[:, :-1] = digits[ids]
    cells[:, -1] = stops
    shown = np.ones(cells.shape, bool)
    shown[:, :-1] = shown_digits[ids]
    raw = cells[shown].tobytes()
    per_text = np.bincount(found.texts[0], minlength=found.n_texts) \
        + np.bincount(found.texts[1], minlength=found.n_texts)
    chars = np.concatenate([[0], np.cumsum(shown_digits.sum(axis=1)[ids] + 1)])
    cuts = chars[np.concatenate([[0], np.cumsum(per_text)])].tolist()
    return [raw[a:max(b - 1, a)] for a, b in zip(cuts[:-1], cuts[1:])]


class Linked(NamedTuple):
    """Figures and spelled groups of texts, and (text, id pair, links) of the distinct id pairs that
    each text holds linked."""

    figures: np.ndarray
    groups: list[bytes]
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]


class Segments:
    """Distinct segments of texts, numbered: whether both token lists spell them, their figures, their
    groups spelled out, and their links, a row of `links` each. A text of other characters, or of
    tokenizers that may cross cuts, is a segment of its own, without the space. The first KNOWN short
    ones are kept for the next texts, then all are forgotten."""

    def __init__(self, byte_level: str, pieces: str):
        self.encoders = encoder(byte_level), encoder(pieces)
        self.vocabularies = [e.vocabulary for e in self.encoders]
        self.n_ids = tuple(len(v.pieces) for v in self.vocabularies)
        self.by_segment = all(e.by_segment for e in self.encoders)
        self.numbers: dict[str, int] = {}
        self.passing: list[str] = []
        self.same = np.zeros(0, bool)
        self.figures = np.zeros((0, len(FIGURES)), np.int64)
        self.groups: list[bytes] = []
        none = np.zeros(0, np.int64)
        self.links = Csr(np.zeros(1, np.int64), none, none, self.n_ids[0] * self.n_ids[1])

    def _settled(self, text: str) -> bool:
        return self.by_segment and _SETTLED.fullmatch(text) is not None

    def _cut(self, text: str) -> list[str]:
        return segments(f" {text}") if self._settled(text) else [text]

    def _forget(self) -> None:
        """Forget the long segments, and all if there are many."""
        for s in self.passing:
            del self.numbers[s]
        if len(self.numbers) > KNOWN:
            self.numbers.clear()
        n = len(self.numbers)
        self.passing, self.same, self.figures = [], self.same[:n], self.figures[:n]
        del self.groups[n:]
        upto = self.links.starts[n]
        self.links = self.links._replace(
            starts=self.links.starts[:n + 1], columns=self.links.columns[:upto],
            values=self.links.values[:upto])

    def _learn(self, new: list[str], limit: int) -> None:
        """Encode and link segments, the long ones last."""
        new.sort(key=lambda s: len(s) > LONG)
        self.passing = [s for s in new if len(s) > LONG]
        parts = [i for i, s in enumerate(new) if self._settled(s)]
        whole = sorted(set(range(len(new))).difference(parts))
        want = [s.encode() for s in new]
        for i in whole:
            want[i] = b" " + want[i]
        ids = []
        for e in self.encoders:
            side = [[]] * len(new)
            for at, found in ((parts, e.encode_segments([new[i] for i in parts])),
                              (whole, e.encode([new[i] for i in whole]))):
                for i, each in zip(at, found):
                    side[i] = each
            ids.append(side)
        same = np.ones(len(new), bool)
        for v, side in zip(self.vocabularies, ids):
            same &= np.array([s == t for s, t in zip(want, v.spelled(side))], bool)
        for i in np.flatnonzero(~same).tolist():
            ids[0][i] = ids[1][i] = []
        found = align_ids(tuple(ids), tuple(v.sizes for v in self.vocabularies), limit)
        n = len(new)
        of, pair, links = linked_pairs(found, self.n_ids, limit)
        figures = [np.bincount(x, minlength=n) for x in (*found.texts, found.group_text)]
        figures += [found.n_overlaps, _sums(of, links, n)]
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + n)))
        self.same = np.concatenate([self.same, same])
        self.figures = np.concatenate([self.figures, np.stack(figures, axis=1)])
        self.groups += spelled_groups(found)
        starts = self.links.starts[-1] + np.searchsorted(of, np.arange(1, n + 1))
        self.links = self.links._replace(
            starts=np.concatenate([self.links.starts, starts]),
            columns=np.concatenate([self.links.columns, pair]),
            values=np.concatenate([self.links.values, links]))

    def link(self, texts: list[str | None], limit: int = PRODUCTS) -> Linked:
        n = len(texts)
        cuts = [self._cut(t) if t else [] for t in texts]
        self._forget()
        self._learn(list(set().union(*cuts).difference(self.numbers)), limit)
        sizes = [len(c) for c in cuts]
        held = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cuts)), np.int64, sum(sizes))
        text = np.repeat(np.arange(n), sizes)
        bad = np.zeros(n, bool)
        bad[text[~self.same[held]]] = True
        text, held = text[~bad[text]], held[~bad[text]]
        figures = np.stack([_sums(text, column[held], n) for column in self.figures.T], axis=1)
        names, ends = held.tolist(), np.searchsorted(text, np.arange(n + 1)).tolist()
        groups = [b";".join(map(self.groups.__getitem__, names[a:b])) for a, b in zip(ends, ends[1:])]
        of, segment, times = id_counts(text, held, n, max(len(self.groups), 1))
        products = list(row_products(from_sorted(of, segment, times, n, len(self.groups)), self.links, limit))
        pairs = tuple(map(np.concatenate, zip(*products))) if products else (np.zeros(0, np.int64),) * 3
        return Linked(figures, groups, pairs)


@lru_cache(maxsize=1)
def known_segments(byte_level: str, pieces: str) -> Segments:
    return Segments(byte_level, pieces)


# --- blocks ----------------------------------------------------------------------------------

_FIGURE_FIELDS = [T.StructField(n, T.LongType()) for n in FIGURES]
_INDEX, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())


def _block_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("block", T.LongType()), T.StructField("id", id_type), *_FIGURE_FIELDS,
        T.StructField("groups", T.StringType()), T.StructField("groups_sha256", T.StringType()),
        T.StructField("held", _INDEX), T.StructField("times", _LONGS),
        T.StructField("pairs", _LONGS), T.StructField("n_texts", _LONGS)])


class _Block:
    """Texts until they fill a block, as Arrow columns."""

    def __init__(self):
        self.size = 0
        self.columns: dict[str, list] = {}
        self.pairs: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def add(self, size: int, pairs: np.ndarray, ends: np.ndarray, **columns) -> None:
        self.size += size
        before = sum(len(p) for p in self.pairs)
        self.pairs.append(pairs)
        self.ends.append(ends + before)
        for name, values in columns.items():
            self.columns.setdefault(name, []).append(values)

    def rows(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        """A row per text, and one with the pairs of the block and how many texts hold each."""
        ends = np.concatenate([np.zeros(1, np.int64), *self.ends])
        pairs, held = np.unique(np.concatenate(self.pairs), return_inverse=True)
        n = len(ends) - 1
        list_of = lambda values, kind: pa.ListArray.from_arrays(
            pa.array(np.concatenate([ends, ends[-1:]]), pa.int32()), pa.array(values, kind))
        of_block = lambda values: pa.array([None] * n + [values], pa.list_(pa.int64()))
        flat = {k: [x for part in v for x in part] for k, v in self.columns.items()
                if k not in ("id", "times")}
        columns = {
            "block": pa.array([number] * (n + 1), pa.int64()),
            "id": pa.concat_arrays([*self.columns["id"], pa.nulls(1, id_type)]),
            **{k: pa.array([*flat[k], 0], pa.int64()) for k in FIGURES},
            "groups": pa.array([*flat["groups"], None], pa.string()),
            "groups_sha256": pa.array([*flat["groups_sha256"], None], pa.string()),
            "held": list_of(held, pa.int32()),
            "times": list_of(np.concatenate(self.columns["times"]), pa.int64()),
            "pairs": of_block(pairs), "n_texts": of_block(np.bincount(held, minlength=len(pairs)))}
        return pa.RecordBatch.from_pydict(columns)


def _encode(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], with_groups: bool,
            bounds: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    known = known_segments(*paths)
    number = TaskContext.get().partitionId() << 32
    block_bytes, piece_bytes, limit = bounds
    block = _Block()
    for batch in batches:
        for lo, hi in w.blocks(batch.column("text"), piece_bytes):
            piece = batch.slice(lo, hi - lo)
            texts = piece.column("text").to_pylist()
            found = known.link(texts, limit)
            text, pairs, times = found.pairs
            block.add(
                sum(len(t or "") for t in texts), pairs,
                np.searchsorted(text, np.arange(1, len(texts) + 1)), id=piece.column("id"), times=times,
                **dict(zip(FIGURES, found.figures.T.tolist())),
                groups=[s.decode() if with_groups else None for s in found.groups],
                groups_sha256=[hashlib.sha256(s).hexdigest() if s else "" for s in found.groups])
            if block.size >= block_bytes:
                yield block.rows(number, piece.column("id").type)
                number, block = number + 1, _Block()
    if block.columns:
        yield block.rows(number, block.columns["id"][0].type)


def _sums(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integer values by key; the keys ascend."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return np.diff(upto[np.searchsorted(key, np.arange(n + 1))])


def _scored(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of one block with the counts of their pairs."""
    n_texts = np.zeros(counts.num_rows, np.int64)
    best = np.zeros(counts.num_rows, bool)
    at = counts.column("at").to_numpy()
    n_texts[at] = counts.column("n_texts").to_numpy()
    best[at] = counts.column("best").to_numpy()
    held, times = (texts.column(c).combine_chunks() for c in ("held", "times"))
    key = np.repeat(np.arange(texts.num_rows),
                    np.diff(held.offsets.to_numpy().astype(np.int64)))
    which, often = held.flatten().to_numpy(), times.flatten().to_numpy()
    return texts.drop_columns(["block", "held", "times"]).append_column(
        "n_best", pa.array(_sums(key, often * best[which], texts.num_rows))).append_column(
        "count_sum", pa.array(_sums(key, often * n_texts[which], texts.num_rows)))


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, n_texts, best): texts that hold each id pair linked, and whether no pair of the same
    first id has more."""
    total = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "n_texts"))
                                                     .alias("p")) \
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_texts").alias("n_texts"))
    total = stored(total.withColumn("a", F.expr(f"pair div {n_b}")), "pair-counts")
    most = total.groupBy("a").agg(F.max("n_texts").alias("most"))
    return total.join(most, "a").select("pair", "n_texts", (F.col("n_texts") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id",
          text: str = "text", with_groups: bool = True) -> DataFrame:
    """Per row of `docs`: its id, the numbers of tokens, groups, overlap links and shared-group links
    (`n_links`), the links whose id pair has the most texts of its first id (`n_best`), the texts of
    the pairs summed over the links (`count_sum`), and the groups spelled out with their digest.

    `byte_level` is a file of the tokenizers library, `pieces` a model of sentencepiece."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_column].dataType
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = _block_schema(id_type)
    bounds = BLOCK, PIECE, PRODUCTS
    blocks = stored(narrow.mapInArrow(
        lambda b: _encode(b, (byte_level, pieces), with_groups, bounds), schema), "aligned")
    n_b = len(encoder(pieces).vocabulary.pieces)
    counted = pair_counts(blocks, n_b)
    pairs = blocks.where("pairs is not null").select(
        F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    counts = pairs.join(counted, "pair").select("of", "at", "n_texts", "best")
    texts = blocks.where("pairs is null").drop("pairs", "n_texts")
    out = T.StructType([f for f in schema if f.name not in
                        ("block", "held", "times", "pairs", "n_texts")]
                       + [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")])
    scored = texts.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_scored, out)
    return scored.select(F.col("id").alias(id_column), *FIGURES, "n_best", "count_sum", "groups",
                         "groups_sha256")
