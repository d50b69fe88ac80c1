"""A training corpus from documents: quality rules, near-duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.llm import decision_list, mixing, ngram_join, packing, suffix_dedup
from axisfield.llm.common import documents, shared_folder
from axisfield.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list, as they are.

    Defined results: null and empty texts fail the base rule; rows alike in id and text are judged alike, and so are null ids;
    without usable labels the base rule alone decides.
    """
    stats = decision_list.statistics_of(docs)
    rules = decision_list.learned(stats, documents(spark, sf_dir, "labels"))
    passed = stats.where(~F.col("base_failed") & decision_list.verdict(rules)).select(F.col("doc_id").alias("passed"), "version").distinct()
    # joined rather than filtered in place: a filter would be pushed below the statistics and compute them again for each test
    keyed = docs.withColumn("version", decision_list.version(F.col("text")))
    return keyed.join(passed, F.col("doc_id").eqNullSafe(F.col("passed")) & (keyed["version"] == passed["version"]), "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group.

    Defined results: rows alike in id and text count as one; an id with several texts stays if any of them is the least of its
    group; documents without words and null ids are each their own group.
    """
    linked = ngram_join.link(docs)
    stays = linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    one = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
    return one.withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "same"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that an earlier text has; a character that a cut divides goes with the cut.

    Defined results: a null text comes out empty, as does one of which nothing is left; rows alike in id and text are one.
    """
    out = suffix_dedup.remove_repeats(docs)
    text = F.when(F.size("spans") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Defined results: those without words (null, empty) add none; repeated rows are drawn one by one; a null source is a source.
    """
    out = mixing.mix(docs)
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).where("copy > 0").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of at most 2048 tokens.

    Defined results: a null text is an empty one, which is a piece of one token; repeated rows each have their pieces.
    """
    return packing.best_fit(packing.pieces(docs, tokenizer("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: The learned rules and the packing have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = posixpath.join(shared_folder(spark), f"corpus-{uuid.uuid4()}")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = posixpath.join(folder, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
