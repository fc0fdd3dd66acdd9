"""A corpus from raw documents to token ids: five stages, each an operator of ``larder.llm`` over all that the one before kept.

Defined cases, all stages but the last giving rows of documents as they were, all columns with them, whatever their names: a null or empty
text fails the quality rules and goes at the first stage; where a later stage meets one (run by itself), near-dedup and decontamination keep
it, the mix may leave it out, as it has no words to count, and token ids give it the end id alone. A null doc_id stays null to the end, where
such rows come last. Rows equal in doc_id and text are one document to near-dedup, and one of them stays; of near duplicates the one with
the smallest doc_id stays. A null source is a source of its own. Nulls in other columns mean nothing. Very long texts are read whole. An
empty table of documents gives an empty result, and so does one whose documents all go; an empty benchmark or no labels take nothing away
beyond the base rules.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontam, mixing, near_dup, quality, token_output
from larder.llm.scratch import Scratch
from larder.session import ship

TOKENIZER, END = "word_bpe_49k.json", 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    ship(spark)
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship(spark)
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    ship(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in doc_id order; a row for each document, read back from the files."""
    ship(spark)
    path = Scratch(spark, "pipeline").path("ids")
    token_output.write_tokens(docs, public_tokenizers.path(TOKENIZER), END, path)
    return token_output.checksums(token_output.read_tokens(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: The classifier, the near duplicates and the hashes of the mix can't be said in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
