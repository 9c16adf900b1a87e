"""Registered queries of the training-data operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_folder
from . import (mixing, order_minhash, periodic_runs, pieces, quality, sharding, simhash, spelling_variants, token_counts, token_files,
               urls, vectors, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary files are read where they are installed; a path of one's own works as well.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_merge_pieces")
def merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return pieces.digests(table(spark, sf_dir, "documents"), PIECES)


@query("op6_gray_simhash")
def gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_length_histogram")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded lengths of all documents with suffix sums: each row answers its own limit."""
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


@query("op5_order_minhash")
def order_minhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return order_minhash.with_edits(table(spark, sf_dir, "documents"))


@query("op10_int8_vectors")
def int8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict for the url of every page."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.labelled_table(spark))


@query("op3_kd_shards")
def kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op8_revisits", warc.SQL)
def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit in the crawl of all pages with the response it stands for."""
    out = warc.resolve(warc.crawl_records(table(spark, sf_dir, "pages")))
    return out.select("record_id", "url", "at", "status", "response_id", warc.header_lines(F.col("headers")).alias("header_lines"))


@query("op2_rule_quality")
def rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_soft_mixing")
def soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rate of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_token_files")
def token_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the written files."""
    folder = stage_folder(spark, "token-files")
    token_files.write_files(table(spark, sf_dir, "documents"), folder, WORDS, end=2)
    return token_files.read_files(spark, folder)


@query("op12_periodic_runs")
def runs_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of which are made periodic first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text")))
    return periodic_runs.digests(periodic_runs.collapse(docs))


@query("op13_spelling_variants")
def variants_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of all documents."""
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
