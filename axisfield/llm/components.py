"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisfield.llm.common import checkpoint


def components(edges: DataFrame, most_rows: int | None = None) -> DataFrame:
    """(node, component) of all nodes with a link; `edges` has long columns a and b, and at most `most_rows` rows if that is known.

    Each step is a few aggregations and joins on nodes, written to the shared folder;
    only its row count and a hash sum come to the driver, to see whether it changed anything.
    """
    stars = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), most_rows)
    state = None
    while True:
        found = stars.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if (now := tuple(found)) == state or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a step makes no more links than there were
        stars = checkpoint(small.union(own.select("u", F.col("m").alias("v"))).distinct(), now[0])
