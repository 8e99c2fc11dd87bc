"""From raw documents to packed sequences: quality rules, quality classifier, near-duplicates, packing."""

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import compression, evidence, simhash
from trailmark.llm.common import table
from trailmark.llm.packing import pack
from trailmark.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands."""
    return compression.keep_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither toxic nor of low quality, by their text and their site."""
    return evidence.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five words, similarity of 0.8 or more."""
    return simhash.drop_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

# Compression, training and fingerprints are outside SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each on a written table of what the one before it kept."""

    def step(docs: DataFrame, stage) -> DataFrame:
        return written(stage[1](spark, docs, sf_dir), stage[0])

    docs = reduce(step, STAGES[:-1], table(spark, sf_dir, "documents"))
    return STAGES[-1][1](spark, docs, sf_dir)
