"""Axes, point sets and domains as DataFrames with quadrature weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def axis(spark: SparkSession, kind: str, n: int, a: float = 0.0, b: float = 1.0, label: str = "x", rule: str = "gauss") -> DataFrame:
    """(i, label, w): nodes and weights of an axis on [a, b]; kinds uniform, fourier, sine, cosine, legendre."""
    if n < 1:
        raise ValueError("an axis needs a node")
    h, i = b - a, F.col("i")
    if kind == "legendre":
        nodes, weights = legendre(n, rule)
        rows = [(k, a + h * (float(x) + 1) / 2, float(w) * h / 2) for k, (x, w) in enumerate(zip(nodes, weights, strict=True))]
        return spark.createDataFrame(rows, f"i long, {label} double, w double")
    rows = spark.range(n).withColumnRenamed("id", "i")
    if kind in ("fourier", "sine"):
        node, weight = F.lit(a) + F.lit(h) * (i + F.lit(0.5 if kind == "sine" else 0.0)) / F.lit(float(n)), F.lit(h / n)
    elif kind in ("uniform", "cosine"):
        step = h / (n - 1) if n > 1 else h
        node = F.lit(a) + F.lit(h) * i / F.lit(float(max(1, n - 1)))
        weight = F.lit(h) if n == 1 else F.when((i == 0) | (i == n - 1), F.lit(step / 2)).otherwise(F.lit(step))
    else:
        raise ValueError(f"unknown axis kind {kind}")
    return rows.select("i", node.alias(label), weight.alias("w"))


def axes_of(rows: DataFrame, kind: str, n: int, low: Column, high: Column, label: str = "x", rule: str = "gauss") -> DataFrame:
    """Each row with the nodes of its own axis from low to high: columns i, the label and w. The nodes are a declared number."""
    unit = axis(rows.sparkSession, kind, n, 0.0, 1.0, "__u", rule)
    named = rows.withColumns({"__low": low.cast("double"), "__high": high.cast("double")})
    wide = F.col("__high") - F.col("__low")
    return named.crossJoin(F.broadcast(unit)).withColumn(label, F.col("__low") + wide * F.col("__u")).withColumn("w", wide * F.col("w")).drop("__low", "__high", "__u")


def legendre(n: int, rule: str = "gauss") -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [-1, 1]: gauss, radau (with -1) or lobatto (with both ends)."""
    base = np.polynomial.legendre.Legendre.basis
    if rule == "gauss":
        return np.polynomial.legendre.leggauss(n)
    if rule == "radau":
        # the roots of P_n + P_(n-1), the least of which is the end -1
        x = np.concatenate(([-1.0], np.sort((base(n) + base(n - 1)).roots().real)[1:]))
    elif rule == "lobatto":
        x = np.concatenate(([-1.0], np.sort(base(n - 1).deriv().roots().real), [1.0]))
    else:
        raise ValueError(f"unknown rule {rule}")
    moments = np.array([(1 - (-1.0) ** (k + 1)) / (k + 1) for k in range(n)])
    return x, np.linalg.solve(np.vander(x, n, increasing=True).T, moments)


def product(*axes: DataFrame, names: list[str]) -> DataFrame:
    """The grid of declared axes with the product weight w. Axes are generated tables of a stated size, not data."""
    out = axes[0].withColumnRenamed("i", f"i_{names[0]}")
    for df, name in zip(axes[1:], names[1:], strict=True):
        other = F.broadcast(df.select(F.col("i").alias(f"i_{name}"), name, F.col("w").alias("w1")))
        out = out.withColumnRenamed("w", "w0").crossJoin(other).withColumn("w", F.col("w0") * F.col("w1")).drop("w0", "w1")
    return out


def halton(index: Column, base: int) -> Column:
    """The radical inverse of an index, with all its digits: as many as a 63-bit number has."""
    places = F.sequence(F.lit(1), F.lit(math.ceil(63 / math.log2(base))))
    # digits by whole-number division: quotients of doubles would lose the low ones
    start = F.struct(index.cast("long").alias("left"), F.lit(1.0).alias("unit"), F.lit(0.0).alias("sum"))
    def step(s: Column, _: Column) -> Column:
        unit, low = s["unit"] / F.lit(float(base)), F.pmod(s["left"], F.lit(base))
        return F.struct(F.call_function("div", s["left"], F.lit(base).cast("long")).alias("left"), unit.alias("unit"), (s["sum"] + unit * low).alias("sum"))

    return F.aggregate(places, start, step)["sum"]


def primes(n: int) -> list[int]:
    """The first n prime numbers."""
    found: list[int] = []
    p = 2
    while len(found) < n:
        if all(p % q for q in found if q * q <= p):
            found.append(p)
        p += 1
    return found


def halton_points(spark: SparkSession, n: int, names: list[str], low: list[float], high: list[float], shift: list[float] | None = None) -> DataFrame:
    """One base a column; with shifts (one of [0, 1) a column) the points are turned around the unit interval."""
    points = spark.range(1, n + 1).withColumnRenamed("id", "i")
    turn = [0.0] * len(names) if shift is None else shift
    unit = [halton(F.col("i"), p) if not t else F.pmod(halton(F.col("i"), p) + F.lit(t), F.lit(1.0)) for p, t in zip(primes(len(names)), turn, strict=True)]
    return points.select("i", *((F.lit(a) + F.lit(b - a) * u).alias(c) for c, u, a, b in zip(names, unit, low, high, strict=True)))


# signed distances, negative inside


def sdf_ball(center: list[float], radius: float, names: list[str]) -> Column:
    return F.sqrt(sum(((F.col(n) - c) * (F.col(n) - c) for n, c in zip(names, center, strict=True)), F.lit(0.0))) - radius


def sdf_box(center: list[float], size: list[float], names: list[str]) -> Column:
    q = [F.abs(F.col(n) - c) - s / 2 for n, c, s in zip(names, center, size, strict=True)]
    outside = F.sqrt(sum((F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)) for x in q), F.lit(0.0)))
    return outside + F.least(F.greatest(*q) if len(q) > 1 else q[0], F.lit(0.0))


def sdf_torus(center: list[float], ring: float, tube: float, names: list[str]) -> Column:
    x, y, z = (F.col(n) - c for n, c in zip(names, center, strict=True))
    around = F.sqrt(x * x + y * y) - ring
    return F.sqrt(around * around + z * z) - tube


def sdf_cylinder(center: list[float], radius: float, height: float, names: list[str]) -> Column:
    x, y, z = (F.col(n) - c for n, c in zip(names, center, strict=True))
    side, cap = F.sqrt(x * x + y * y) - radius, F.abs(z) - height / 2
    out = F.sqrt(F.greatest(side, F.lit(0.0)) * F.greatest(side, F.lit(0.0)) + F.greatest(cap, F.lit(0.0)) * F.greatest(cap, F.lit(0.0)))
    return out + F.least(F.greatest(side, cap), F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return F.least(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.greatest(a, -b)


# meshes and clouds


def edges(faces: DataFrame) -> DataFrame:
    """(a, b, faces) of a triangle table (fid, i, j, k): boundary edges have one face, interior edges more."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    each = F.explode(F.array(pair("i", "j"), pair("j", "k"), pair("k", "i")))
    return faces.select(each.alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("faces"))


def grid_faces(grid: DataFrame, columns: int) -> DataFrame:
    """Two triangles per cell of a grid (iy, ix), by joining each cell's corners on their indices."""
    at = F.col("iy") * columns + F.col("ix")
    corner = grid.select("iy", "ix")
    here = corner.join(corner.select((F.col("iy") - 1).alias("iy"), (F.col("ix") - 1).alias("ix")), ["iy", "ix"])
    both = F.explode(F.array(F.struct(at.alias("i"), (at + 1).alias("j"), (at + columns + 1).alias("k")), F.struct(at.alias("i"), (at + columns + 1).alias("j"), (at + columns).alias("k"))))
    return here.select(both.alias("f")).select("f.*").withColumn("fid", F.xxhash64("i", "j", "k"))


def voxel_first(cloud: DataFrame, size: float, names: list[str], order: str) -> DataFrame:
    """The point of least order in each voxel, by partial aggregation."""
    cells = [F.floor(F.col(n) / F.lit(size)).alias(f"cell_{n}") for n in names]
    return cloud.groupBy(*cells).agg(F.min_by(F.struct(*cloud.columns), F.col(order)).alias("p")).select("p.*")
