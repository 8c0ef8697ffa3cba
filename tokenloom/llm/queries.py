"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import binary_output, hnsw, html_extract, jaccard_join, langid, mixing, packing, prefix_tree, quality, sentencepiece_codec, spelling, token_count, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("op3_mix_sources")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("shuffle_key")


ORACLES["op3_mix_sources"] = mixing.ORACLE.format(documents="documents", columns="doc_id, text, lang, source, n_chars, copy_no")


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


@query("op1_embedding_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op10_token_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


@query("op11_conversation_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.branched_tree(table(spark, sf_dir, "conversations"))


ORACLES["op11_conversation_prefix_trie"] = prefix_tree.ORACLE


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op12_spelling_variants"] = spelling.ORACLE


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    length, crc = (F.octet_length("ids") / 4).cast("long"), F.crc32("ids")
    return pieces.select("doc_id", "start", length.alias("length"), crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
