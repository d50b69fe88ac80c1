"""Points that repeat for a seed, made row by row from an index."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisfield.sources.grids import halton_points


def unit(*columns: Column) -> Column:
    """A number in [0, 1) from an MD5 of the values as text, which any SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *(c.cast("string") for c in columns))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def uniform_at(index: Column, names: Sequence[str], low: Sequence[float], high: Sequence[float], seed: int = 0) -> list[Column]:
    """A point's columns from an index of any table."""
    return [(F.lit(a) + F.lit(b - a) * unit(index, F.lit(k), F.lit(seed))).alias(c) for k, (c, a, b) in enumerate(zip(names, low, high, strict=True))]


def uniform(spark: SparkSession, n: int, names: Sequence[str], low: Sequence[float], high: Sequence[float], seed: int = 0) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i").select("i", *uniform_at(F.col("i"), names, low, high, seed))


def permuted(index: Column, n: int, seed: int) -> Column:
    """A place of 0..n - 1 for each index, all different, for any n.

    In each round a key pairs every place with its mirror image, key - place modulo n, and a hash of the
    pair says whether the two change places; so each round is an exchange of pairs, and nothing is left over.
    """
    rounds = 2 * math.ceil(math.log2(max(2, n))) + 16

    def exchanged(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, F.lit(seed)), F.lit(n)) - x, F.lit(n))
        turned = F.xxhash64(F.greatest(x, mirror), r, F.lit(seed + 1)).bitwiseAND(F.lit(1)) == 1
        return F.when(turned, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), exchanged)


def latin_hypercube(spark: SparkSession, n: int, names: Sequence[str], low: Sequence[float], high: Sequence[float], seed: int = 0) -> DataFrame:
    """One point in each of n slices per axis; slices are dealt by a keyed permutation, without a sort."""
    spots = []
    for k, (c, a, b) in enumerate(zip(names, low, high, strict=True)):
        cell = permuted(F.col("i"), n, seed * 1009 + k)
        spots.append((F.lit(a) + F.lit((b - a) / n) * (cell + unit(F.col("i"), F.lit(k), F.lit(seed)))).alias(c))
    return spark.range(n).withColumnRenamed("id", "i").select("i", *spots)


#: Degree, coefficient bits and first odd numbers of primitive polynomials, one a dimension after the first (fixed values of the sequence).
SOBOL = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)))
_BITS = 52


def directions(dimension: int) -> list[int]:
    """Direction numbers of a dimension, as whole numbers of 52 bits."""
    if dimension == 0:
        return [1 << (_BITS - 1 - k) for k in range(_BITS)]
    if dimension > len(SOBOL):
        raise ValueError(f"Sobol points have at most {len(SOBOL) + 1} columns here; use Halton points")
    degree, bits, m = SOBOL[dimension - 1]
    v = [m[k] << (_BITS - 1 - k) for k in range(degree)]
    for k in range(degree, _BITS):
        x = v[k - degree] ^ (v[k - degree] >> degree)
        for j in range(1, degree):
            x ^= v[k - j] if bits >> (degree - 1 - j) & 1 else 0
        v.append(x)
    return v


def sobol_at(index: Column, names: Sequence[str], low: Sequence[float], high: Sequence[float], seed: int | None = None) -> list[Column]:
    """A point's columns from its index in natural order; a seed flips the same bits of all points of a column."""
    import random

    draw = random.Random(seed)

    def value(k: int) -> Column:
        v = F.array(*(F.lit(x) for x in directions(k)))
        start = F.lit(draw.getrandbits(_BITS) if seed is not None else 0).cast("long")
        bit = lambda j: F.call_function("shiftright", index.cast("long"), j).bitwiseAND(F.lit(1)) == 1
        return F.aggregate(F.sequence(F.lit(0), F.lit(_BITS - 1)), start, lambda x, j: F.when(bit(j), x.bitwiseXOR(F.get(v, j))).otherwise(x))

    return [(F.lit(a) + F.lit(b - a) * value(k) / F.lit(float(1 << _BITS))).alias(c) for k, (c, a, b) in enumerate(zip(names, low, high, strict=True))]


def sobol_points(spark: SparkSession, n: int, names: Sequence[str], low: Sequence[float], high: Sequence[float], seed: int | None = None) -> DataFrame:
    """Points 0..n - 1 of the sequence."""
    return spark.range(n).withColumnRenamed("id", "i").select("i", *sobol_at(F.col("i"), names, low, high, seed))


def _shifts(names: Sequence[str], seed: int) -> list[float]:
    import random

    draw = random.Random(seed)
    return [draw.random() for _ in names]


SAMPLERS = {
    "uniform": uniform, "latin_hypercube": latin_hypercube,
    "halton": lambda spark, n, names, low, high, seed=0: halton_points(spark, n, list(names), list(low), list(high)),
    "halton_scrambled": lambda spark, n, names, low, high, seed=0: halton_points(spark, n, list(names), list(low), list(high), _shifts(names, seed)),
    "sobol": lambda spark, n, names, low, high, seed=0: sobol_points(spark, n, names, low, high),
    "sobol_scrambled": sobol_points,
}


def sampled(spark: SparkSession, sampler: str, n: int, names: Sequence[str], low: Sequence[float], high: Sequence[float], where: Column, measure: float, seed: int = 0) -> DataFrame:
    """Points of a box that satisfy `where`, each with weight measure(box) / n: the weights estimate the part's measure."""
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler}")
    return SAMPLERS[sampler](spark, n, names, low, high, seed=seed).where(where).withColumn("w", F.lit(measure / n))


def rows_with_replacement(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n draws: each row is repeated by a Poisson count of mean n / rows, from a hash of the row and the seed.

    Reruns agree however the rows are dealt; rows alike in all columns are drawn as often as each other. Use `draws`
    for a number of draws that is exact.
    """
    rate = df.agg((F.lit(float(n)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("__rate"))
    # the quantile: how many partial sums of exp(-r) r^k / k! are at most u
    terms = F.sequence(F.lit(0), F.ceil(F.col("__rate") + 12 * F.sqrt("__rate") + 12).cast("int"))
    sums = F.aggregate(terms, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.exp(-F.col("__rate")).alias("p")), lambda a, k: F.struct((a.n + F.when(a.s + a.p <= F.col("__u"), 1).otherwise(0)).alias("n"), (a.s + a.p).alias("s"), (a.p * F.col("__rate") / (k + 1)).alias("p")))
    u = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = df.crossJoin(F.broadcast(rate)).withColumn("__u", u).withColumn("__n", sums["n"])  # one row
    return drawn.where("__n > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__rate", "__u", "__n")


def draws(df: DataFrame, n: int, order: str, seed: int = 0) -> DataFrame:
    """Exactly n draws with replacement, uniform over the rows; `order` is a column that tells rows apart.

    Rows are numbered within buckets of a hash; a draw picks a place of all rows, which is a bucket and a number in
    it by the running sum of the buckets' counts (one small row each). No task sorts the table.
    """
    buckets = 1024
    bucket = F.pmod(F.xxhash64(order, F.lit(seed)), F.lit(buckets)).cast("int")
    placed = df.withColumn("__bucket", bucket).withColumn("__at", F.row_number().over(Window.partitionBy("__bucket").orderBy(order)) - 1)
    counts = df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__c"))
    ahead = F.coalesce(F.sum("__c").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.withColumn("__from", ahead).withColumn("__all", F.sum("__c").over(Window.partitionBy()))  # at most 1024 rows
    asked = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(spans.select(F.max("__all").alias("__all"))))
    asked = asked.withColumn("__place", F.floor(unit(F.col("draw"), F.lit(seed)) * F.col("__all")))
    found = asked.join(F.broadcast(spans.drop("__all")), (F.col("__place") >= F.col("__from")) & (F.col("__place") < F.col("__from") + F.col("__c")))
    return found.select("draw", "__bucket", (F.col("__place") - F.col("__from")).alias("__at")).join(placed, ["__bucket", "__at"]).drop("__bucket", "__at")
