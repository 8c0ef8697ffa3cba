"""The corpus pipeline: quality rules, toxicity, near duplicates, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: what it keeps of docs, with the columns of `documents`;
the last one returns the ids of each text instead.

Defined cases: documents with a null or empty text fail the quality rules, so they go in the first stage; a null language or
source is a group of its own there, and a null source a source of its own in the mixture; of documents with similar
texts that with the smallest id stays, and the mixture repeats it by its source's rate; very long texts go through
all stages whole; extra columns stay up to the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import jaccard_join, mixing, quality, sentencepiece_codec, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs within the base rules and the limits of their language and source."""
    return quality.quality_filter(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that are not predicted toxic; the lexicon is learned from the labelled rows of `documents`."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.toxicity_filter(docs, documents, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs repeated so that each source's share of the characters is its size to the power 0.5."""
    return mixing.mix_sources(docs).drop("copy_no", "shuffle_key")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every copy."""
    return sentencepiece_codec.encode_column(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mixture),
    ("SentencePiece", piece_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
