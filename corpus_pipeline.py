"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, mixing, shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import decontam, mixing, ngram_join, sharding, toxicity
from turnstone.llm._util import Staging, fresh, read, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the model learns from a bounded sample of this stage's labelled rows.

    Null and empty texts score as empty, whole texts of any length are scored, repeated rows
    share one fate, an empty table stays empty, and columns of any name stay as they are.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "score")
    scored = toxicity.score_documents(docs, model, column=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest id.

    Texts without a word, null ones too, are one group; of repeated rows one stays; null ids
    come last. An empty table stays empty; other columns are kept as they are.
    """
    return ngram_join.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts and items leak nothing; repeated rows share one fate; without
    benchmark rows everything stays. Columns of any name stay as they are.
    """
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until sources have their target weights.

    Null sources are a source, the last; null texts have no words; rows equal in id and text
    are taken together. An empty table stays empty. Columns of any name stay as they are.
    """
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document.

    Null ids share one shard, rows of one id too. A column named shard gives way to it; an
    empty table stays empty.
    """
    return sharding.assign_shards(docs, sharding.SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_each_class),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the first two stages; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written and read again before the next, and its scratch tables go."""
    scope = Staging(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch():
            done = scope.write(stage(spark, docs, sf_dir), name)
        if i:
            scope.drop(docs)
        docs = done
    return docs
