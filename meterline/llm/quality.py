"""Quality rules with adaptive thresholds.

Each text gets whole-number features. Per (lang, source) the values of each feature are kept as a
sketch: counts of log-linear buckets (exact below 64, 32 buckets per power of two above), which add
up across tasks and groups. Quartiles read from the sketches give fences, and the fences are joined
back to the rows. A group with too few rows takes the sketch of its language, and that of all rows
where the language has too few as well.

Nulls and empty texts have no words and fail the base rule (`n_words < min_words`). A null lang or
source is a group of its own. Repeated rows count as often as they occur. An empty table gives an
empty result. Columns of the input that bear the names added here are left out of `judge`'s output
and kept as they are by `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.lineage import stored
from meterline.llm import words as w
from meterline.llm.frames import small_batches

MIN_WORDS = 50
MIN_GROUP = 100
FENCE = 3
#: Feature, least spread that its quartiles are taken to have, and whether low values fail too.
FEATURES = {"word_length": (100, True), "symbol_ratio": (500, False),
            "dup_line_ratio": (1500, False), "repeat_ratio": (1000, False)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in texts: which ones repeat within their text, and which are the first of theirs."""
    key = w.mix(hashes + w.mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, first = np.zeros(len(key), bool), np.ones(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first[order[1:][same]] = False
    return again, first


def block_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    mask = w.not_space()
    starts, ends = w.word_bounds(data, offsets, mask)
    bounds = w.words_per_text(starts, offsets)
    n_words = np.diff(bounds)
    chars = _per_text(mask[data] & ((data & 0xC0) != 0x80), offsets)
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    symbols = _per_text(symbol[data], offsets)

    in_line = np.ones(256, bool)
    in_line[10] = False
    line_from, line_to = w.word_bounds(data, offsets, in_line)
    with_word = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_from, line_to = line_from[with_word], line_to[with_word]
    line_text = np.searchsorted(offsets, line_from, "right") - 1
    _, first = _repeats(w.word_hashes(data, line_from, line_to), line_text)
    lines = np.bincount(line_text, minlength=n)
    dups = np.bincount(line_text[~first], minlength=n)

    hit = np.zeros(len(starts) + 1, bool)
    word_text = np.repeat(np.arange(n), n_words)
    if len(starts) > 2:
        h = w.word_hashes(data, starts, ends)
        window = w.mix(w.mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
        at = np.flatnonzero(word_text[:-2] == word_text[2:])
        again, _ = _repeats(window[at], word_text[at])
        for k in range(3):
            hit[at[again] + k] = True
    repeated = np.bincount(word_text[hit[:-1]], minlength=n)
    return [n_words, chars, symbols, lines, dups, repeated]


@F.arrow_udf(_TYPE)
def text_counts(column: pa.Array) -> pa.Array:
    """The COUNTS of each text."""
    parts = [block_counts(*w.text_bytes(column.slice(lo, hi - lo)))
             for lo, hi in w.blocks(column)]
    merged = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
              for i in range(len(COUNTS))]
    return pa.StructArray.from_arrays(
        [pa.array(m.astype(np.int64), pa.int64()) for m in merged], list(COUNTS))


def with_features(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """The columns of `df` as struct `row`, group keys, counts, features, and the base verdict."""
    df = df.select(F.struct("*").alias("row"), F.col(lang).alias("lang"),
                   F.col(source).alias("source"), text_counts(F.col(text)).alias("c"))
    df = df.select("row", "lang", "source", *[F.col(f"c.{c}") for c in COUNTS])
    per = lambda a, times, b: F.expr(f"if({b} = 0, 0, {a} * {times} div {b})")
    return df.withColumns({
        "word_length": per("word_chars", 100, "n_words"),
        "symbol_ratio": per("n_symbols", 10000, "n_words"),
        "dup_line_ratio": per("n_dup_lines", 10000, "n_lines"),
        "repeat_ratio": per("n_repeat_words", 10000, "n_words"),
        "base_failed": F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"),
    })


def bucket(value: str) -> str:
    """Largest value of the sketch bucket that holds `value`."""
    low = f"length(bin({value})) - 6"
    return (f"if({value} < 64, {value}, ({value} | "
            f"(shiftleft(1L, cast({low} as int)) - 1)))")


def sketches(features: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n): the mergeable sketches of all rows that pass the base."""
    each = F.explode(F.map_from_arrays(
        F.array(*[F.lit(f) for f in FEATURES]), F.array(*[F.col(f) for f in FEATURES])))
    return (features.where("not base_failed").select("lang", "source", each.alias("feature", "value"))
            .groupBy("lang", "source", "feature", F.expr(bucket("value")).alias("bucket"))
            .agg(F.count("*").alias("n")))


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """rows, q1 and q3 of each sketch: the smallest bucket that reaches the rank. One group is at
    most some 2,000 buckets, whatever the rows."""
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    part = ", ".join([*keys, "feature"])
    ranked = merged.selectExpr(
        *keys, "feature", "bucket",
        f"sum(n) over (partition by {part} order by bucket) as upto",
        f"sum(n) over (partition by {part}) as rows")
    return ranked.groupBy(*keys, "feature").agg(
        F.max("rows").alias("rows"),
        F.expr("min(if(4 * upto >= rows, bucket, null))").alias("q1"),
        F.expr("min(if(4 * upto >= 3 * rows, bucket, null))").alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): `low` and `high` of each feature."""
    own = _quartiles(sketch, "lang", "source").alias("o")
    by_lang = _quartiles(sketch, "lang").alias("l")
    overall = _quartiles(sketch).alias("a")
    pick = lambda c: F.expr(
        f"if(o.rows >= {MIN_GROUP}, o.{c}, if(l.rows >= {MIN_GROUP}, l.{c}, a.{c}))").alias(c)
    both = (own.join(by_lang, F.expr("o.lang <=> l.lang and o.feature = l.feature"))
            .join(overall, F.expr("o.feature = a.feature"))
            .select("o.lang", "o.source", "o.feature", pick("q1"), pick("q3")))
    aggs = []
    for name, (spread, low) in FEATURES.items():
        width = f"{FENCE} * greatest(q3 - q1, {spread})"
        this = f"feature = '{name}'"
        aggs.append(F.expr(f"max(if({this}, q3 + {width}, null))").alias(f"{name}_high"))
        if low:
            aggs.append(F.expr(f"max(if({this}, q1 - {width}, null))").alias(f"{name}_low"))
    return both.groupBy("lang", "source").agg(*aggs)


def judge(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text"
          ) -> DataFrame:
    """Every row of `df` as struct `row`, with its counts, features, fences and `kept`.

    The features are written once, as sketches and verdicts both need them; select narrow columns
    before where the text itself is not wanted afterwards."""
    small_batches(df.sparkSession)
    features = stored(with_features(df, lang, source, text), "quality")
    fences = stored(thresholds(sketches(features)), "fences").alias("t")
    inside = [f"f.{n} <= t.{n}_high" for n in FEATURES]
    inside += [f"f.{n} >= t.{n}_low" for n, (_, low) in FEATURES.items() if low]
    return (features.alias("f")
            .join(fences, F.expr("f.lang <=> t.lang and f.source <=> t.source"), "left")
            .select("f.*", *[f"t.{n}_high" for n in FEATURES], "t.word_length_low",
                    F.expr(f"not f.base_failed and {' and '.join(inside)}").alias("kept")))


def keep(df: DataFrame, **columns: str) -> DataFrame:
    """The rows of `df` that pass, with their columns and no others."""
    return judge(df, **columns).where("kept").select("row.*")
