"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Features: length of url, host and path, depth, digit ratio, entropy of the host's characters, number
of parameters, hyphens and labels of the host, and how often labelled URLs with its last label were
bad; that share is over all labelled rows. The trees learn from different labelled URLs, at most
MAX_LABELLED of them: of each class those with the least hash, at least half of the places if it has as
many. A URL weighs as many rows as it has, and the drawn URLs of a class as much as all of its rows.

A url that is null or has no `://` has empty host and path; no rule fits it, and its features judge
it like any other. Repeated rows are judged alike. Without any label of both classes, what no rule
blocks is allowed. Extra columns are left alone: the input stays together as struct `row`.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.lineage import stored

MAX_LABELLED = 20_000
TREES, DEPTH = 10, 4
#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow"))
#: Parts of hosts that are known to be bad: what the labelled URLs of the query are made from.
BAD_HOSTS = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "params",
            "hyphens", "labels", "bad_suffix")


def host_and_path(url):
    """Columns for the host (A-Z lower-cased) and the path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: tuple[tuple[str, str], ...]):
    """Struct (size, rule, verdict) of the longest rule that fits `host` and `path`, or null: each
    suffix of the host that starts at a label looks its rules up in a map."""
    by_host: dict[str, list] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append(F.struct(
            F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"),
            F.lit(slash + path).alias("path")))
    table = F.create_map(*[x for h, r in by_host.items() for x in (F.lit(h), F.array(*r))])
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)),
                              lambda r: r.isNotNull()))
    return F.array_max(F.filter(fits, lambda r: F.col("path").startswith(r["path"])))


def suffix():
    """Last label of `host`."""
    return F.substring_index("host", ".", -1)


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of `url`, `host` and `path` but for the suffix statistics, and `suffix`."""
    chars = F.split("host", "")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(
        F.filter(chars, lambda x: x == c)) / F.size(chars))
    url = F.coalesce("url", F.lit(""))
    return df.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.length(F.regexp_replace("path", "[^/]", "")),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "params": F.length(F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), "[^=]", "")),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
        "labels": F.size(F.split("host", r"\.", -1)),
        "suffix": suffix()})


def _vectors(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    """`df` with the share of bad labelled URLs of its suffix (0.5 if unknown), as vectors."""
    known = df.join(suffixes, "suffix", "left").fillna(0.5, ["bad_suffix"])
    numbers = known.withColumns({f: F.col(f).cast("double") for f in FEATURES})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(numbers)


def fit(labelled: DataFrame, most: int = MAX_LABELLED):
    """(trees, suffix statistics) from rows (url, label); None where only one class is there."""
    host, path = host_and_path(F.col("url"))
    different = stored(
        labelled.select("url", F.col("label").cast("double").alias("label")).where("label is not null")
        .groupBy("url", "label").agg(F.count("*").alias("rows"))
        .withColumns({"host": host, "path": path}), "labelled")
    totals = {r["label"]: r for r in different.groupBy("label").agg(
        F.count("*").alias("urls"), F.sum("rows").alias("rows")).collect()}  # a row per class
    if len(totals) < 2:
        return None
    suffixes = stored(different.groupBy(suffix().alias("suffix")).agg(
        ((F.sum(F.col("label") * F.col("rows")) + 0.5) / (F.sum("rows") + 1)).alias("bad_suffix")), "suffixes")
    every = sum(r["urls"] for r in totals.values())
    drawn = [different.where(F.col("label") == c).orderBy(F.xxhash64("url"), "url").limit(
        max(most // 2, most - (every - r["urls"]))) for c, r in sorted(totals.items())]
    sample = stored(lexical(reduce(DataFrame.union, drawn)), "labelled-sample")
    shares = {r["label"]: totals[r["label"]]["rows"] / r["rows"] for r in sample.groupBy("label").agg(
        F.sum("rows").alias("rows")).collect()}
    scale = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    sample = sample.withColumn("weight", F.col("rows") * scale[F.col("label")])
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES,
                          maxDepth=DEPTH, seed=7).fit(_vectors(sample, suffixes))
    return trees, suffixes


def score(df: DataFrame, model) -> DataFrame:
    """Adds `p_bad` to rows with url, host and path."""
    trees, suffixes = model
    scored = trees.transform(_vectors(lexical(df), suffixes))
    return scored.withColumn("p_bad", vector_to_array("probability")[1])


def known_bad(host):
    """Label from the list of bad hosts."""
    found = F.lit(False)
    for part in BAD_HOSTS:
        found = found | host.contains(part)
    return found.cast("int")


def judge(pages: DataFrame, labelled: DataFrame, url: str = "url",
          rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """The rows of `pages` as struct `row`, with host, path, rule, p_bad and verdict."""
    host, path = host_and_path(F.col("url"))
    rows = (pages.select(F.struct("*").alias("row"), F.col(url).alias("url"))
            .withColumns({"host": host, "path": path}).withColumn("fit", longest_rule(rules)))
    model = fit(labelled)
    rows = score(rows, model) if model else rows.withColumn("p_bad", F.lit(0.0))
    return rows.select(
        "row", "host", "path", F.col("fit.rule").alias("rule"), "p_bad",
        F.coalesce("fit.verdict", F.when(F.col("p_bad") >= 0.5, "block").otherwise("allow"))
        .alias("verdict"))
