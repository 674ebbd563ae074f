"""Token counts through a digest cache.

A text is known by the SHA-256 digest of its normalised content, a tokenizer by that of
its file. Counts are stored under both; a run joins its digests to them, encodes each
distinct missing text once, appends the new counts and joins again. A later run over
the same or a grown corpus encodes only what is new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lactoscope.llm.tokens import encoder

CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest of a tokenizer's file."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def normalised(text: str = "text") -> Column:
    """A null text counts as the empty one; anything more would change counts."""
    return F.coalesce(F.col(text), F.lit(""))


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer; none if nothing has been stored yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    return spark.read.schema(CACHE).parquet(path).where(F.col("version") == version).select("digest", "n_tokens")


def encode_missing(docs: DataFrame, cache: str, tokenizer: str) -> None:
    """Append to the cache the counts of texts that it does not have."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer).count
        for batch in batches:
            counts = pa.array([count(t.as_py()) for t in batch.column("content")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    keyed = docs.select(digest().alias("digest"), normalised().alias("content"))
    known = read_cache(spark, cache, version).select("digest")
    # Copies meet in their own task before any shuffle.
    distinct = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    missing = distinct.join(known, "digest", "left_anti")
    counted = missing.mapInArrow(run, "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    ``cache`` is a folder in shared storage; it is made or grown. Texts are counted whole
    as the tokenizer's library does without added special tokens; null texts as empty.
    Repeated rows and null ``doc_id`` are counted like others.
    """
    encode_missing(docs, cache, tokenizer)
    # Two runs that write at once may both store a text; its counts are the same.
    known = read_cache(docs.sparkSession, cache, tokenizer_version(tokenizer)).distinct()
    keyed = docs.select("doc_id", F.octet_length(normalised()).cast("long").alias("n_bytes"), digest().alias("digest"))
    return keyed.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
