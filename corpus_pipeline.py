"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, encoding and decoding.

Each stage works on what the one before it kept. All but the last return the columns of documents:

1. ``language_id`` rejects texts that show no learned language: no n-gram of one, or fewer than a text would have of
   which a quarter is in that language. Where no language could be learned, only texts without any letter.
2. ``exact_dedup`` keeps one document of each group of equal texts.
3. ``near_dedup`` keeps one document of each group that five-word Jaccard links of 0.8 or more connect.
4. ``decontamination`` drops documents that contain a benchmark item.
5. ``byte_bpe`` encodes every text and decodes the ids; a document whose bytes don't come back is an error.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaflow.llm import byte_bpe, decontamination, exact_dedup, language_id, ngram_join
from seaflow.llm.storage import package_on_workers, release, short_plans, small_batches, table, written

# Smaller than that of the operator: the driver has held the results of four stages before it collects the dictionary.
DICTIONARY_SIZE = 200_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.recognised(docs, language_id.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens; a text that doesn't come back from its ids ends the job."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = byte_bpe.round_trip(docs, ranks, dictionary_size=DICTIONARY_SIZE)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    wrong = F.raise_error(F.lit("the decoded bytes differ from the text")).cast("array<int>")
    return found.select(
        "doc_id",
        "lang",
        "source",
        F.when(same, F.col("ids")).otherwise(wrong).alias("ids"),
        F.size("ids").cast("long").alias("n_tokens"),
    )


def _lean(stage: Stage) -> Stage:
    """The stages follow one another in one session, whose executors keep what an earlier one made them allocate."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        short_plans(spark)
        found = stage(spark, docs, sf_dir)
        release()  # what was learned or collected has been handed over
        return found

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _lean(identify)),
    ("exact_dedup", _lean(drop_copies)),
    ("near_dedup", _lean(drop_near_copies)),
    ("decontamination", _lean(drop_benchmark)),
    ("byte_bpe", _lean(encode)),
]

# SQL cannot express byte-level BPE or the learned language filters; the whole is tested against a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    package_on_workers(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
