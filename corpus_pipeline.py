"""Training-data pipeline over `documents`: filter, deduplicate, decontaminate, mix, write token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read back as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from meterline.lineage import folders, remove, stored
from meterline.llm import decontaminate, mixing, quality, simhash, tokenbin
from meterline.llm.files import give_back
from meterline.llm.frames import table
from meterline.llm.queries import word_tokenizer

#: Input of a token shard: small, as its tasks run beside what the earlier stages left in memory.
SHARD_BYTES = 4 << 20
_OLD: list[str] = []


def _stage(run):
    """A stage first lets Python workers give back what the stage before it left in them. If its docs
    have been written, it no longer needs what that stage put into work folders, so that goes when it
    starts; its own folders stay for its result to be read. Docs that are no written table, but a plan
    that may read from there, leave everything as it is."""
    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        n = spark.sparkContext.defaultParallelism
        spark.range(0, 4 * n, 1, 4 * n).mapInArrow(give_back, "id long").count()
        if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
            remove(spark, _OLD)
        before = set(folders())
        result = run(spark, docs, sf_dir)
        _OLD[:] = [f for f in folders() if f not in before]
        return result

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive fences reject go."""
    return quality.keep(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the smallest id."""
    return simhash.keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark's windows hit one word in 20 go."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: a row per pass over a document."""
    mixed = mixing.mixed_documents(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.selectExpr(*[
            "cast(length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`"
            for c in docs.columns])
    return mixed


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards with Elias-Fano boundaries; a row per document, read back from them."""
    return tokenbin.read_documents(tokenbin.write(docs, word_tokenizer(), shard_bytes=SHARD_BYTES))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

#: Fingerprints, permutations and a tokenizer cannot be said in SQL; tests/llm compares each stage
#: with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
