"""Token counts through a digest cache.

A text's digest is joined with the tokenizer's version digest to stored counts; only
distinct texts that miss are encoded, and their counts are appended to the cache, a
Parquet table in a folder of the caller's choice. Appends are idempotent: a digest
that is stored twice (two runs at once, a job that is run again) counts once.

Defined results: a null text counts as the empty text; repeated rows each get their
count; nothing is truncated; extra columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisfield.llm.common import checkpoint, row_groups, text_buffer
from axisfield.llm.tokens import piece_counts

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def cached(spark, cache_dir: str) -> DataFrame:
    """The stored counts; a folder that is not there yet holds none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_dir) if fs.exists(path) else spark.createDataFrame([], CACHE_SCHEMA)


def encoded(texts: DataFrame, model_path: str, version: str) -> DataFrame:
    """(digest, tokenizer, n_tokens) of rows (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(model_path)
        for batch in batches:
            column = batch.column("text")
            for a, b in row_groups(text_buffer(column)[1], 4 << 20):
                n = [counts.count(t.as_py()) for t in column[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column("digest")[a:b], pa.array([version] * (b - a), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def with_token_counts(df: DataFrame, model_path: str, cache_dir: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text; appends what was missing to the cache."""
    spark, version = df.sparkSession, tokenizer_version(model_path)
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(whole.cast("binary"), 256))
    stored = cached(spark, cache_dir).where(F.col("tokenizer") == version)
    distinct = df.select(digest.alias("digest"), whole.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored.select("digest"), "digest", "left_anti")
    encoded(misses, model_path, version).write.mode("append").parquet(cache_dir)
    counts = cached(spark, cache_dir).where(F.col("tokenizer") == version).groupBy(F.col("digest").alias("__digest")).agg(F.max("n_tokens").alias("__n"))
    # written first: below an aggregate the join would keep all rows of a text together, this way Spark splits a large group of copies
    counts = checkpoint(counts)
    keyed = df.withColumn("__digest", digest)
    kept = [F.col(f"`{c}`") for c in df.columns if c != into]
    return keyed.join(counts, "__digest", "left").select(*kept, F.col("__n").alias(into))
