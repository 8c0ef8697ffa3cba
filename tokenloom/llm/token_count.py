"""Token counts through a digest cache.

Each text is identified by the SHA-256 of its normalised content, each tokenizer by the SHA-256 of its file and options.
Stored counts are joined on both digests; only distinct contents without a stored count are encoded, and their counts
are appended to the cache. Normalisation maps null to the empty text and keeps every other byte: the tokenizers here
see white space and letter case, so anything stronger would change counts.

Defined cases: null and empty texts have 0 bytes and the count of an empty encoding; repeated rows are encoded once;
very long texts are encoded whole, a batch of their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, shared_dir, slices

OPTIONS = "plain:1"


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a list of texts to their numbers of tokens, by the library that the file is for."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + OPTIONS.encode()).hexdigest()


CACHE_SETTING = "tokenloom.token_counts.cache"
CACHE = "content string, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The counts that the cache has for this tokenizer; none if the cache does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer).dropDuplicates(["content"])


def fill_cache(docs: DataFrame, text: str, tokenizer_path: str, cache: str) -> None:
    """Encode the distinct contents without a stored count and append their counts to the cache."""
    tokenizer = tokenizer_digest(tokenizer_path)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.sha2("text", 256).alias("content"), "text")
    known = read_cache(docs.sparkSession, cache, tokenizer).select("content")
    misses = texts.join(known, "content", "left_anti").groupBy("content").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer_path)
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(count(batch.column("text").to_pylist()), pa.int64())], ["content", "n_tokens"])

    counted = misses.mapInArrow(encode, "content string, n_tokens long")
    counted.select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, id_column: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    cache: a folder that outlives the call, so that later calls encode only new contents; by default the folder that the
    session's setting CACHE_SETTING names or else a new one in the shared folder.
    """
    spark = docs.sparkSession
    cache = cache or spark.conf.get(CACHE_SETTING, None) or f"{shared_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    fill_cache(docs, text, tokenizer_path, cache)
    keyed = docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("text")).select(id_column, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("content"))
    counts = cut(read_cache(spark, cache, tokenizer_digest(tokenizer_path)).select("content", "n_tokens"))  # one row a content: a much repeated one can be split over tasks
    return keyed.join(counts, "content").select(id_column, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
