"""Queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from .bpe import count_tokens, encode_texts
from .common import table
from .convtrie import TRIE_SQL, prefix_trie
from .decontam import contaminated
from .embed import near_vectors
from .langid import predict_language
from .linededup import LINE_SQL, drop_boilerplate
from .merkle import MERKLE_SQL, document_manifest
from .pii import personal_data
from .quality import score_quality, train
from .simhash import near_duplicates
from .toxicity import learn_toxicity, score_toxicity
from .warc import archived_pages


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op4_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(spread(docs.select("doc_id", "text")), train(docs, table(spark, sf_dir, "labels")))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(spread(docs.select("doc_id", "text")), learn_toxicity(docs, table(spark, sf_dir, "labels")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_bpe_roundtrip, op3_language_id, op4_warc_roundtrip, op5_quality, op6_simhash_neardup, op7_token_counts, op8_embedding_neardup, op9_pii, op10_line_dedup, op11_merkle_manifest, op12_toxicity, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op10_line_dedup": LINE_SQL, "op11_merkle_manifest": MERKLE_SQL, "op13_prefix_trie": TRIE_SQL}
