"""The queries of this package: thin uses of its operators on the given tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bestfit, ctw, descent, evidence, repair
from trailmark.llm.bpe import digests
from trailmark.llm.common import table
from trailmark.llm.compression import judge_documents
from trailmark.llm.packing import pack
from trailmark.llm.simhash import near_duplicates
from trailmark.llm.tokencount import count_tokens
from trailmark.llm.tokenfile import ids_crc32, read_tokens, write_tokens
from trailmark.llm.urls import filter_urls
from trailmark.llm.whiten import whiten
from trailmark.session import work_folder

TOKEN_LIMIT = 4096
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    # The test tables label documents; a page is taken to carry the label of the document with its number.
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return filter_urls(table(spark, folder, "pages"), labels, URL_RULES)


def op2_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ctw.score(table(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = digests(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "digests.*")


def op5_compression(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_documents(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "compression.*")


def op6_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return descent.near_duplicates(table(spark, folder, "embeddings"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_site_evidence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    judged = evidence.judge_documents(docs, table(spark, folder, "labels"))
    return judged.select("doc_id", "source", "lang", "judged.*")


def op10_token_file(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", ids_crc32(F.col("tokens")).alias("ids_crc32"))


def op11_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_digests(repair.damaged(table(spark, folder, "conversations")))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whiten(table(spark, folder, "embeddings"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "part")
    rows = white.select("vec_id", "n", "deviation", "identity_error", parts)
    component = (F.col("place") + 1).alias("component")
    return rows.select("vec_id", component, "n", "deviation", "part.whitened", "part.explained", "identity_error")


QUERIES = (
    op1_url_filter,
    op2_context_tree,
    op3_simhash,
    op4_bpe,
    op5_compression,
    op6_nn_descent,
    op7_token_counts,
    op8_packing,
    op9_site_evidence,
    op10_token_file,
    op11_best_fit,
    op12_repair,
    op13_whitening,
)
RUNS = {run.__name__: run for run in QUERIES}
SQL: dict[str, str] = {}
