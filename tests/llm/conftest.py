import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null in every column, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(11)
    base = words(rng, 120, 400)
    rows = [(i, words(rng, rng.randrange(0, 200), 300), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(50, None, "en", "s1", None), (None, base, None, None, 3), (51, "", "de", "s1", 0),
             (52, " \n\t ", "de", None, 4), (53, base, "en", "s2", 5), (53, base, "en", "s2", 5),
             (54, base.replace("w1 ", "x ", 1), "en", "s2", 5), (55, "Größe ÄÖ ｆｕｌｌ " * 30, "de", "s0", 9),
             (56, words(rng, 60_000, 5000), "en", "s0", 9), (-3, "one\nline\nline\nline", "en", "s0", 2),
             (57, "a" * 5000, "en", "s0", 2), (None, None, None, None, None)]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def clashing(odd):
    """The same rows with further columns that bear names the operators use."""
    from pyspark.sql import functions as F
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(
        ("row", "kept", "n_words", "fp", "uid", "spans", "start", "component", "size", "rank",
         "target", "host", "path", "contaminated", "k", "hash", "id", "paragraph"))])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()),
                  key=lambda t: tuple((x is None, x) for x in t))
