"""Tables that cut lineage: written once to the folder that the driver and all executors share, and read back."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where a local session names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of sides of any size, by sorting: a size guessed from a packed file, or from rows before they are multiplied, would have one broadcast."""
    return left.join(right.hint("merge"), on, how)


def dealt(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """The rows (counted) in even partitions of about that number: for few bytes that each make many rows or much work."""
    return df.repartition(max(1, -(-df.count() // rows)))


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder; executors may be lost afterwards."""
    path = posixpath.join(shared_folder(df.sparkSession), f"table-{uuid.uuid4()}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
