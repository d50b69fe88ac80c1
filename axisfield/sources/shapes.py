"""Shapes of the line, the plane and space: measures, signed distances, normals, interior and boundary points.

Each shape gives Spark columns for its signed distance (negative inside, zero on the boundary) and outward normal at a boundary point, its
measure and boundary measure in closed form, and point tables made row by row: interior and boundary points carry a
weight w, and the weights sum to the measure. Interior points come from a map of the unit cube where there is one,
else from a box, of which those inside are kept. `exact` says that the distance is Euclidean; else it is a level
function with the same sign and zero set.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.sources.samplers import SAMPLERS

TAU = 2 * math.pi


def _norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def _unit(parts: list[Column]) -> list[Column]:
    size = _norm(*parts)
    return [F.when(size > 0, p / size).otherwise(F.lit(0.0)) for p in parts]


def unit_points(spark: SparkSession, n: int, columns: int, sampler: str, seed: int) -> DataFrame:
    """(i, u0, u1, ...) in the unit cube."""
    names = [f"u{k}" for k in range(columns)]
    return SAMPLERS[sampler](spark, n, names, [0.0] * columns, [1.0] * columns, seed=seed)


class Shape:
    """names: the columns of the space; low and high: its box."""

    names: tuple[str, ...]
    exact = True

    @property
    def measure(self) -> float:
        raise NotImplementedError

    @property
    def boundary_measure(self) -> float:
        raise NotImplementedError

    @property
    def box(self) -> tuple[list[float], list[float]]:
        raise NotImplementedError

    def sdf(self) -> Column:
        raise NotImplementedError

    def normal(self) -> list[Column]:
        """Outward unit normal at a boundary point."""
        raise NotImplementedError

    def inside(self, tolerance: float = 0.0) -> Column:
        return self.sdf() <= F.lit(-tolerance)

    def interior(self, spark: SparkSession, n: int, sampler: str = "halton", seed: int = 0, where: Column | None = None) -> DataFrame:
        """About n points of the shape that satisfy `where`, with weights that estimate its measure."""
        low, high = self.box
        volume = math.prod(b - a for a, b in zip(low, high, strict=True))
        tries = max(n, math.ceil(n * volume / self.measure))
        points = SAMPLERS[sampler](spark, tries, list(self.names), low, high, seed=seed).withColumn("w", F.lit(volume / tries)).where(self.sdf() <= 0)
        return points if where is None else points.where(where)

    def boundary(self, spark: SparkSession, n: int, sampler: str = "halton", seed: int = 0, where: Column | None = None) -> DataFrame:
        """Points (i, names, w) of the boundary, uniform by its measure, with its normal as n_<name>."""
        points = self._boundary(spark, n, sampler, seed).withColumn("w", F.lit(self.boundary_measure / n))
        points = points.withColumns({f"n_{c}": v for c, v in zip(self.names, self.normal(), strict=True)}).select("i", *self.names, "w", *(f"n_{c}" for c in self.names))
        return points if where is None else points.where(where)

    def _boundary(self, spark: SparkSession, n: int, sampler: str, seed: int) -> DataFrame:
        raise NotImplementedError

    def boundary_subset_measure(self, spark: SparkSession, where: Column, n: int = 4096, seed: int = 0) -> DataFrame:
        """One row: the measure of the part of the boundary that satisfies `where`."""
        return self.boundary(spark, n, seed=seed).agg(F.sum(F.when(where, F.col("w")).otherwise(0.0)).alias("measure"))

    def grid(self, *axes: DataFrame) -> DataFrame:
        """The grid of one axis a column, with the mask of nodes inside."""
        from axisfield.sources.grids import product

        return product(*axes, names=list(self.names)).withColumn("mask", self.sdf() < F.lit(-1e-6))


@dataclass(frozen=True)
class Line(Shape):
    """A closed interval; its boundary is its two ends, each of measure one."""

    start: float
    end: float
    names: tuple[str, ...] = ("x",)

    @property
    def measure(self) -> float:
        return self.end - self.start

    @property
    def boundary_measure(self) -> float:
        return 2.0

    @property
    def box(self):
        return [self.start], [self.end]

    def sdf(self) -> Column:
        x = F.col(self.names[0])
        return F.greatest(F.lit(self.start) - x, x - F.lit(self.end))

    def smooth_sdf(self) -> Column:
        """The parabola (x - a)(x - b) / (b - a), of slope one at the ends."""
        x = F.col(self.names[0])
        return (x - self.start) * (x - self.end) / F.lit(self.measure)

    def normal(self) -> list[Column]:
        return [F.when(F.col(self.names[0]) < (self.start + self.end) / 2, F.lit(-1.0)).otherwise(F.lit(1.0))]

    def _boundary(self, spark, n, sampler, seed):
        return spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, F.lit(float(self.start))).otherwise(F.lit(float(self.end))).alias(self.names[0]))


@dataclass(frozen=True)
class Ellipsoid(Shape):
    """All points with sum ((x - c) / r)^2 <= 1, in the plane (ellipse, disk) or in space (ellipsoid, ball)."""

    center: Sequence[float]
    radii: Sequence[float]
    names: tuple[str, ...] = ("x", "y", "z")

    @property
    def exact(self) -> bool:
        return len(set(self.radii)) == 1

    @property
    def measure(self) -> float:
        return math.prod(self.radii) * (math.pi if len(self.radii) == 2 else 4 / 3 * math.pi)

    @property
    def boundary_measure(self) -> float:
        """By Gauss nodes on the angles, to about twelve places for mild ratios."""
        import numpy as np

        if len(self.radii) == 2:
            a, b = self.radii
            t = TAU * (np.arange(4096) + 0.5) / 4096
            return float(np.sqrt((a * np.sin(t)) ** 2 + (b * np.cos(t)) ** 2).mean() * TAU)
        a, b, c = self.radii
        if a == b == c:
            return 4 * math.pi * a * a
        u, w = np.polynomial.legendre.leggauss(400)
        t = TAU * (np.arange(800) + 0.5) / 800
        s = np.sqrt(1 - u[:, None] ** 2)
        area = np.sqrt((b * c * s * np.cos(t)) ** 2 + (a * c * s * np.sin(t)) ** 2 + (a * b * u[:, None]) ** 2)
        return float((area.mean(axis=1) * TAU) @ w)

    @property
    def box(self):
        return [c - r for c, r in zip(self.center, self.radii, strict=True)], [c + r for c, r in zip(self.center, self.radii, strict=True)]

    def _scaled(self) -> list[Column]:
        return [(F.col(n) - c) / r for n, c, r in zip(self.names, self.center, self.radii, strict=True)]

    def sdf(self) -> Column:
        if self.exact:
            return _norm(*(F.col(n) - c for n, c in zip(self.names, self.center, strict=True))) - self.radii[0]
        # the level function k (k - 1) / |grad|: the distance to first order at the boundary
        q = self._scaled()
        k, slope = _norm(*q), _norm(*(x / r for x, r in zip(q, self.radii, strict=True)))
        return F.when(slope > 0, k * (k - 1) / slope).otherwise(F.lit(-float(min(self.radii))))

    def normal(self) -> list[Column]:
        return _unit([x / r for x, r in zip(self._scaled(), self.radii, strict=True)])

    def interior(self, spark, n, sampler="halton", seed=0, where=None):
        """By a map of the unit cube, so that the weights are exact: all are measure / n."""
        d = len(self.radii)
        u = unit_points(spark, n, d, sampler, seed)
        r = F.pow("u0", F.lit(1 / d))
        around = F.lit(TAU) * F.col("u1")
        flat = F.sqrt(1 - (2 * F.col("u2") - 1) * (2 * F.col("u2") - 1)) if d == 3 else F.lit(1.0)
        unit = [r * flat * F.cos(around), r * flat * F.sin(around), *([r * (2 * F.col("u2") - 1)] if d == 3 else [])]
        out = u.select("i", *((F.lit(float(c)) + F.lit(float(s)) * x).alias(k) for k, c, s, x in zip(self.names, self.center, self.radii, unit, strict=True)), F.lit(self.measure / n).alias("w"))
        return out if where is None else out.where(where)

    def boundary(self, spark, n, sampler="halton", seed=0, where=None):
        """Points by equal steps of the parameters, each weighted by the stretch of the map there."""
        d = len(self.radii)
        if d == 2:
            t = F.lit(TAU) * (F.col("id") + 0.5) / n
            unit, (a, b) = [F.cos(t), F.sin(t)], self.radii
            w = _norm(F.lit(float(a)) * F.sin(t), F.lit(float(b)) * F.cos(t)) * F.lit(TAU / n)
        else:
            # a spiral of equal areas on the unit sphere
            h, t = 1 - (2 * F.col("id") + 1) / n, F.lit(math.pi * (3 - math.sqrt(5))) * F.col("id")
            s = F.sqrt(1 - h * h)
            unit, (a, b, c) = [s * F.cos(t), s * F.sin(t), h], self.radii
            w = _norm(F.lit(float(b * c)) * unit[0], F.lit(float(a * c)) * unit[1], F.lit(float(a * b)) * unit[2]) * F.lit(4 * math.pi / n)
        out = spark.range(n).select(F.col("id").alias("i"), *((F.lit(float(c)) + F.lit(float(s)) * x).alias(k) for k, c, s, x in zip(self.names, self.center, self.radii, unit, strict=True)), w.alias("w"))
        out = out.withColumns({f"n_{c}": v for c, v in zip(self.names, self.normal(), strict=True)})
        return out if where is None else out.where(where)


def circle(center: Sequence[float], radius: float, names: tuple[str, str] = ("x", "y")) -> Ellipsoid:
    return Ellipsoid(center, [radius] * 2, names)


def ellipse(center: Sequence[float], x_radius: float, y_radius: float, names: tuple[str, str] = ("x", "y")) -> Ellipsoid:
    return Ellipsoid(center, [x_radius, y_radius], names)


def sphere(center: Sequence[float], radius: float) -> Ellipsoid:
    return Ellipsoid(center, [radius] * 3)


@dataclass(frozen=True)
class Box(Shape):
    """An axis-parallel box of any number of columns (rectangle, square, cuboid, cube)."""

    center: Sequence[float]
    size: Sequence[float]
    names: tuple[str, ...] = ("x", "y", "z")

    @property
    def measure(self) -> float:
        return math.prod(self.size)

    @property
    def _faces(self) -> list[float]:
        return [self.measure / s for s in self.size for _ in range(2)]

    @property
    def boundary_measure(self) -> float:
        return sum(self._faces)

    @property
    def box(self):
        return [c - s / 2 for c, s in zip(self.center, self.size, strict=True)], [c + s / 2 for c, s in zip(self.center, self.size, strict=True)]

    def _over(self) -> list[Column]:
        return [F.abs(F.col(n) - c) - s / 2 for n, c, s in zip(self.names, self.center, self.size, strict=True)]

    def sdf(self) -> Column:
        q = self._over()
        return _norm(*(F.greatest(x, F.lit(0.0)) for x in q)) + F.least(F.greatest(*q) if len(q) > 1 else q[0], F.lit(0.0))

    def normal(self) -> list[Column]:
        q = self._over()
        top, out, found = F.greatest(*q) if len(q) > 1 else q[0], [], F.lit(False)
        for n, c, x in zip(self.names, self.center, q, strict=True):
            here = ~found & (x >= top)
            out.append(F.when(here, F.signum(F.col(n) - c)).otherwise(F.lit(0.0)))
            found = found | here
        return out

    def interior(self, spark, n, sampler="halton", seed=0, where=None):
        low, high = self.box
        out = SAMPLERS[sampler](spark, n, list(self.names), low, high, seed=seed).withColumn("w", F.lit(self.measure / n))
        return out if where is None else out.where(where)

    def _boundary(self, spark, n, sampler, seed):
        low, high = self.box
        u = unit_points(spark, n, len(self.names), sampler, seed)
        # the first number picks the face by its area, and what is left of it is a coordinate on it
        face, ends, at = F.lit(len(self._faces) - 1), [], 0.0
        for k, part in enumerate(self._faces):
            ends.append((at, at + part / self.boundary_measure))
            at = ends[-1][1]
        for k in range(len(ends) - 2, -1, -1):
            face = F.when(F.col("u0") < ends[k][1], F.lit(k)).otherwise(face)
        start = F.get(F.array(*(F.lit(a) for a, _ in ends)), F.col("face"))
        span = F.get(F.array(*(F.lit(b - a) for a, b in ends)), F.col("face"))
        u = u.withColumn("face", face).withColumn("rest", (F.col("u0") - start) / span)
        columns = []
        for k, (name, a, b) in enumerate(zip(self.names, low, high, strict=True)):
            free = F.lit(a) + F.lit(b - a) * (F.col("rest") if k == 0 else F.col(f"u{k}"))
            # on the first column's own faces its number moves to the next column
            free = F.when(F.col("face") < 2, F.lit(a) + F.lit(b - a) * F.col("rest")).otherwise(free) if k == 1 else free
            columns.append(F.when(F.col("face") == 2 * k, F.lit(a)).when(F.col("face") == 2 * k + 1, F.lit(b)).otherwise(free).alias(name))
        return u.select("i", *columns)


def rectangle(center: Sequence[float], width: float, height: float) -> Box:
    return Box(center, [width, height], ("x", "y"))


def square(center: Sequence[float], side: float) -> Box:
    return rectangle(center, side, side)


def cuboid(center: Sequence[float], dimensions: Sequence[float]) -> Box:
    return Box(center, dimensions)


def cube(center: Sequence[float], side: float) -> Box:
    return Box(center, [side] * 3)


@dataclass(frozen=True)
class Polygon(Shape):
    """A simple polygon by its corners in turn; a triangle is one of three. Its corners are parameters, not data."""

    vertices: Sequence[Sequence[float]]
    names: tuple[str, ...] = ("x", "y")
    _ring: tuple = field(init=False, default=())

    def __post_init__(self):
        v = [(float(x), float(y)) for x, y in self.vertices]
        area = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(v, v[1:] + v[:1], strict=True)) / 2
        if len(v) < 3 or area == 0:
            raise ValueError("a polygon needs three corners that are not on a line")
        object.__setattr__(self, "_ring", tuple(v if area > 0 else v[::-1]))

    @property
    def _edges(self) -> list[tuple[float, float, float, float]]:
        return [(*p, *q) for p, q in zip(self._ring, self._ring[1:] + self._ring[:1], strict=True)]

    @property
    def measure(self) -> float:
        return sum(a * d - c * b for a, b, c, d in self._edges) / 2

    @property
    def boundary_measure(self) -> float:
        return sum(math.hypot(c - a, d - b) for a, b, c, d in self._edges)

    @property
    def box(self):
        return [min(p[k] for p in self._ring) for k in range(2)], [max(p[k] for p in self._ring) for k in range(2)]

    def _table(self) -> Column:
        return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("a", "b", "c", "d"), e, strict=True))) for e in self._edges))

    def _nearest(self) -> Column:
        """The squared distance to the nearest edge and that edge's normal, by one pass over the edges."""
        x, y = (F.col(n) for n in self.names)

        def away(e: Column) -> Column:
            dx, dy = e["c"] - e["a"], e["d"] - e["b"]
            s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - e["a"]) * dx + (y - e["b"]) * dy) / (dx * dx + dy * dy)))
            ox, oy = x - e["a"] - s * dx, y - e["b"] - s * dy
            size = F.sqrt(dx * dx + dy * dy)
            return F.struct((ox * ox + oy * oy).alias("d2"), (dy / size).alias("nx"), (-dx / size).alias("ny"))

        return F.array_min(F.transform(self._table(), away))

    def sdf(self) -> Column:
        x, y = (F.col(n) for n in self.names)

        def crosses(e: Column) -> Column:
            over = (e["b"] > y) != (e["d"] > y)
            return F.when(over & (x < e["a"] + (y - e["b"]) * (e["c"] - e["a"]) / F.nullif(e["d"] - e["b"], F.lit(0.0))), F.lit(1)).otherwise(F.lit(0))

        odd = F.aggregate(self._table(), F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1
        distance = F.sqrt(self._nearest()["d2"])
        return F.when(odd, -distance).otherwise(distance)

    def normal(self) -> list[Column]:
        near = self._nearest()
        return [near["nx"], near["ny"]]

    def _boundary(self, spark, n, sampler, seed):
        total, at, rows = self.boundary_measure, 0.0, []
        for a, b, c, d in self._edges:
            part = math.hypot(c - a, d - b) / total
            rows.append((at, part, a, b, c, d))
            at += part
        table = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("s", "l", "a", "b", "c", "d"), r, strict=True))) for r in rows))
        u = unit_points(spark, n, 1, sampler, seed).withColumn("e", F.element_at(F.filter(table, lambda e: e["s"] <= F.col("u0")), -1))
        along = (F.col("u0") - F.col("e.s")) / F.col("e.l")
        x, y = self.names
        return u.select("i", (F.col("e.a") + along * (F.col("e.c") - F.col("e.a"))).alias(x), (F.col("e.b") + along * (F.col("e.d") - F.col("e.b"))).alias(y))


def triangle(vertices: Sequence[Sequence[float]]) -> Polygon:
    if len(vertices) != 3:
        raise ValueError("a triangle has three corners")
    return Polygon(vertices)


@dataclass(frozen=True)
class Cone(Shape):
    """A cone or frustum along z from the base's center: radius0 at the base, radius1 at the height. A cylinder has equal radii."""

    base: Sequence[float]
    height: float
    radius0: float
    radius1: float
    names: tuple[str, ...] = ("x", "y", "z")

    @property
    def measure(self) -> float:
        a, b = self.radius0, self.radius1
        return math.pi * self.height * (a * a + a * b + b * b) / 3

    @property
    def _parts(self) -> list[float]:
        a, b = self.radius0, self.radius1
        return [math.pi * (a + b) * math.hypot(self.height, a - b), math.pi * a * a, math.pi * b * b]

    @property
    def boundary_measure(self) -> float:
        return sum(self._parts)

    @property
    def box(self):
        r = max(self.radius0, self.radius1)
        x, y, z = self.base
        return [x - r, y - r, z], [x + r, y + r, z + self.height]

    def _profile(self) -> tuple[Column, Column, float, float]:
        x, y, z = (F.col(n) - c for n, c in zip(self.names, self.base, strict=True))
        slant = math.hypot(self.height, self.radius0 - self.radius1)
        return _norm(x, y), z, self.height / slant, (self.radius0 - self.radius1) / slant

    def sdf(self) -> Column:
        """Distances in the half-plane of radius and height: to the slanted side and both lids, as segments."""
        r, z, nr, nz = self._profile()

        def segment(r0: float, z0: float, r1: float, z1: float) -> Column:
            dr, dz = r1 - r0, z1 - z0
            if not (length := dr * dr + dz * dz):
                return _norm(r - r0, z - z0)
            s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((r - r0) * dr + (z - z0) * dz) / length))
            return _norm(r - r0 - s * dr, z - z0 - s * dz)

        h = self.height
        near = F.least(segment(self.radius0, 0.0, self.radius1, h), segment(0.0, 0.0, self.radius0, 0.0), segment(0.0, h, self.radius1, h))
        inside = (z >= 0) & (z <= h) & ((r - self.radius0) * nr + z * nz <= 0)
        return F.when(inside, -near).otherwise(near)

    def normal(self) -> list[Column]:
        r, z, nr, nz = self._profile()
        side, base, lid = F.abs((r - self.radius0) * nr + z * nz), F.abs(z), F.abs(z - self.height)
        x, y = (F.col(n) - c for n, c in zip(self.names[:2], self.base[:2], strict=True))
        ux, uy = _unit([x, y])
        flat = F.least(base, lid) < side
        return [F.when(flat, F.lit(0.0)).otherwise(ux * nr), F.when(flat, F.lit(0.0)).otherwise(uy * nr), F.when(flat & (base <= lid), F.lit(-1.0)).when(flat, F.lit(1.0)).otherwise(F.lit(nz))]

    def _boundary(self, spark, n, sampler, seed):
        side, base, lid = (p / self.boundary_measure for p in self._parts)
        u = unit_points(spark, n, 2, sampler, seed)
        v, a, b = F.col("u0"), float(self.radius0), float(self.radius1)
        # on the side, the area up to a height grows with the mean of the radii: the radius itself follows by a root
        s = v / F.lit(side)
        radius = F.sqrt(F.lit(a * a) + s * F.lit(b * b - a * a)) if a != b else F.lit(a)
        height = (radius - a) / F.lit(b - a) * F.lit(self.height) if a != b else s * F.lit(self.height)
        on_side, on_base = v < side, v < side + base
        r = F.when(on_side, radius).when(on_base, F.lit(a) * F.sqrt((v - side) / F.lit(base or 1.0))).otherwise(F.lit(b) * F.sqrt(F.greatest(F.lit(0.0), (v - side - base) / F.lit(lid or 1.0))))
        z = F.when(on_side, height).when(on_base, F.lit(0.0)).otherwise(F.lit(float(self.height)))
        t = F.lit(TAU) * F.col("u1")
        at = [F.lit(float(self.base[0])) + r * F.cos(t), F.lit(float(self.base[1])) + r * F.sin(t), F.lit(float(self.base[2])) + z]
        return u.select("i", *(x.alias(k) for k, x in zip(self.names, at, strict=True)))


def cylinder(base: Sequence[float], height: float, radius: float) -> Cone:
    return Cone(base, height, radius, radius)


@dataclass(frozen=True)
class Torus(Shape):
    """A ring around z: radius of the ring, radius of the tube."""

    center: Sequence[float]
    ring: float
    tube: float
    names: tuple[str, ...] = ("x", "y", "z")

    @property
    def measure(self) -> float:
        return 2 * math.pi**2 * self.ring * self.tube**2

    @property
    def boundary_measure(self) -> float:
        return 4 * math.pi**2 * self.ring * self.tube

    @property
    def box(self):
        r, (x, y, z) = self.ring + self.tube, self.center
        return [x - r, y - r, z - self.tube], [x + r, y + r, z + self.tube]

    def _at(self) -> tuple[list[Column], Column]:
        at = [F.col(n) - c for n, c in zip(self.names, self.center, strict=True)]
        return at, _norm(*at[:2])

    def sdf(self) -> Column:
        at, around = self._at()
        return _norm(around - self.ring, at[2]) - self.tube

    def normal(self) -> list[Column]:
        at, around = self._at()
        return _unit([at[0] * (1 - self.ring / around), at[1] * (1 - self.ring / around), at[2]])

    def boundary(self, spark, n, sampler="halton", seed=0, where=None):
        """By equal steps of both angles, weighted by the distance from the axis."""
        u = unit_points(spark, n, 2, sampler, seed)
        a, b = F.lit(TAU) * F.col("u0"), F.lit(TAU) * F.col("u1")
        r = F.lit(float(self.ring)) + F.lit(float(self.tube)) * F.cos(b)
        at = [r * F.cos(a), r * F.sin(a), F.lit(float(self.tube)) * F.sin(b)]
        out = u.select("i", *((F.lit(float(c)) + x).alias(k) for k, c, x in zip(self.names, self.center, at, strict=True)), (r * F.lit(self.tube * TAU * TAU / n)).alias("w"))
        out = out.withColumns({f"n_{c}": v for c, v in zip(self.names, self.normal(), strict=True)})
        return out if where is None else out.where(where)


def _beside(u: Column, v: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Distance to a convex polygon, whose corners run against the clock; 0 inside."""
    near, inside = [], F.lit(True)
    for (a, b), (c, d) in zip(corners, [*corners[1:], corners[0]], strict=True):
        du, dv = c - a, d - b
        if not (length := du * du + dv * dv):
            continue
        s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((u - a) * du + (v - b) * dv) / length))
        near.append(_norm(u - a - s * du, v - b - s * dv))
        inside = inside & ((v - b) * du - (u - a) * dv >= 0)
    # a product, so that what the distances share is computed once
    return F.least(*near) * F.when(inside, F.lit(0.0)).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class Sweep(Shape):
    """The part of a cone, cylinder or torus from the direction of x through an angle around z, closed by two flat ends.

    The nearest point of a solid of revolution lies at a point's own angle, and from outside of the angle at an
    end, so distances are Euclidean. Points come from the whole solid by shrinking their angle.
    """

    solid: Cone | Torus
    angle: float
    names: tuple[str, ...] = ("x", "y", "z")

    def __post_init__(self):
        if not 0 < self.angle < TAU:
            raise ValueError("a part of a turn: take the solid itself for all of it")
        if isinstance(self.solid, Torus) and self.solid.tube > self.solid.ring:
            raise ValueError("a tube wider than its ring meets itself")
        object.__setattr__(self, "solid", replace(self.solid, names=self.names))

    @property
    def _share(self) -> float:
        return self.angle / TAU

    @property
    def _end(self) -> float:
        """Area of one end."""
        s = self.solid
        return s.height * (s.radius0 + s.radius1) / 2 if isinstance(s, Cone) else math.pi * s.tube**2

    @property
    def measure(self) -> float:
        return self.solid.measure * self._share

    @property
    def boundary_measure(self) -> float:
        return self.solid.boundary_measure * self._share + 2 * self._end

    @property
    def box(self):
        return self.solid.box

    @property
    def _center(self) -> list[float]:
        return [float(c) for c in (self.solid.base if isinstance(self.solid, Cone) else self.solid.center)]

    def _at(self) -> list[Column]:
        return [F.col(n) - c for n, c in zip(self.names, self._center, strict=True)]

    def _nearer(self) -> tuple[Column, Column]:
        """Distance to the nearer end, and whether that is the first: both have the same form, so it is the one whose half-plane a point lies further along."""
        x, y, z = self._at()
        s, c, d = self.solid, math.cos(self.angle), math.sin(self.angle)
        last = x * c + y * d
        first, along = x >= last, F.greatest(x, last)
        if isinstance(s, Cone):
            gap = _beside(along, z, [(0.0, 0.0), (s.radius0, 0.0), (s.radius1, s.height), (0.0, s.height)])
        else:
            gap = F.greatest(F.lit(0.0), _norm(along - s.ring, z) - s.tube)
        return _norm(F.when(first, y).otherwise(y * c - x * d), gap), first

    def sdf(self) -> Column:
        x, y, _ = self._at()
        end, _ = self._nearer()
        return F.when(F.pmod(F.atan2(y, x), F.lit(TAU)) <= self.angle, F.greatest(self.solid.sdf(), -end)).otherwise(end)

    def normal(self) -> list[Column]:
        end, first = self._nearer()
        at_end = end < F.abs(self.solid.sdf())
        ends = zip([0.0, -1.0, 0.0], [-math.sin(self.angle), math.cos(self.angle), 0.0], self.solid.normal(), strict=True)
        return [F.when(at_end & first, F.lit(a)).when(at_end, F.lit(b)).otherwise(c) for a, b, c in ends]

    def _shrunk(self, points: DataFrame) -> DataFrame:
        """Points of the whole solid at their share of the angle, with their share of the weight."""
        x, y, _ = self._at()
        turn, r = F.pmod(F.atan2(y, x), F.lit(TAU)) * F.lit(self._share), _norm(x, y)
        return points.withColumns({self.names[0]: F.lit(self._center[0]) + r * F.cos(turn), self.names[1]: F.lit(self._center[1]) + r * F.sin(turn), "w": F.col("w") * F.lit(self._share)})

    def interior(self, spark, n, sampler="halton", seed=0, where=None):
        out = self._shrunk(self.solid.interior(spark, n, sampler, seed))
        return out if where is None else out.where(where)

    def boundary(self, spark, n, sampler="halton", seed=0, where=None):
        """The side and both ends, each with its share of the points by area, at least one."""
        s, (cx, cy, cz) = self.solid, self._center
        at_end = max(1, round(n * self._end / self.boundary_measure))
        on_side = max(1, n - 2 * at_end)
        out = self._shrunk(s.boundary(spark, on_side, sampler, seed).select("i", *self.names, "w"))
        for k, turn in enumerate((0.0, float(self.angle))):
            u, v = F.col("u0"), F.col("u1")
            if isinstance(s, Cone):
                # as many at a height as the end is wide there
                a, b = float(s.radius0), float(s.radius1)
                wide = F.sqrt(F.lit(a * a) + u * F.lit(b * b - a * a))
                r, z = v * wide, (wide - a) / F.lit(b - a) * F.lit(float(s.height)) if a != b else u * F.lit(float(s.height))
            else:
                r, z = F.lit(float(s.ring)) + F.lit(float(s.tube)) * F.sqrt(u) * F.cos(F.lit(TAU) * v), F.lit(float(s.tube)) * F.sqrt(u) * F.sin(F.lit(TAU) * v)
            places = [F.lit(cx) + r * F.lit(math.cos(turn)), F.lit(cy) + r * F.lit(math.sin(turn)), F.lit(cz) + z]
            end = unit_points(spark, at_end, 2, sampler, seed + k + 1).select((F.col("i") + F.lit(on_side + k * at_end)).alias("i"), *(p.alias(c) for c, p in zip(self.names, places, strict=True)), F.lit(self._end / at_end).alias("w"))
            out = out.union(end)
        out = out.withColumns({f"n_{c}": v for c, v in zip(self.names, self.normal(), strict=True)})
        return out if where is None else out.where(where)


@dataclass(frozen=True)
class Wedge(Shape):
    """A box cornered at x0 whose extent along x shrinks linearly from the bottom to `top` at its full height."""

    x0: Sequence[float]
    extends: Sequence[float]
    top: float
    names: tuple[str, ...] = ("x", "y", "z")
    exact = False

    @property
    def measure(self) -> float:
        dx, dy, dz = self.extends
        return (dx + self.top) / 2 * dy * dz

    @property
    def _slope(self) -> float:
        dx, _, dz = self.extends
        return math.hypot(dz, dx - self.top)

    @property
    def _areas(self) -> list[float]:
        dx, dy, dz = self.extends
        return [dy * dz, dy * self._slope, (dx + self.top) / 2 * dz, (dx + self.top) / 2 * dz, dx * dy, self.top * dy]

    @property
    def boundary_measure(self) -> float:
        return sum(self._areas)

    @property
    def box(self):
        return list(self.x0), [a + d for a, d in zip(self.x0, self.extends, strict=True)]

    def _planes(self) -> list[tuple[Column, list[float]]]:
        x, y, z = (F.col(n) - c for n, c in zip(self.names, self.x0, strict=True))
        dx, dy, dz = self.extends
        nx, nz = dz / self._slope, (dx - self.top) / self._slope
        return [(-x, [-1.0, 0.0, 0.0]), ((x - dx) * nx + z * nz, [nx, 0.0, nz]), (-y, [0.0, -1.0, 0.0]), (y - dy, [0.0, 1.0, 0.0]), (-z, [0.0, 0.0, -1.0]), (z - dz, [0.0, 0.0, 1.0])]

    def sdf(self) -> Column:
        return F.greatest(*(p for p, _ in self._planes()))

    def normal(self) -> list[Column]:
        top, out = self.sdf(), [F.lit(0.0)] * 3
        for p, n in reversed(self._planes()):
            out = [F.when(p >= top - 1e-12, F.lit(v)).otherwise(o) for v, o in zip(n, out, strict=True)]
        return out

    def _boundary(self, spark, n, sampler, seed):
        dx, dy, dz = map(float, self.extends)
        u = unit_points(spark, n, 3, sampler, seed)
        # the first number picks the face by area, the others place the point on it
        ends = [sum(self._areas[: k + 1]) / self.boundary_measure for k in range(6)]
        a, b = F.col("u1"), F.col("u2")
        # on the sides the density over the height follows the width there: the root of a quadratic
        lean = (self.top - dx) / 2
        mean = dx + lean
        up = 2 * a * mean / (F.lit(dx) + F.sqrt(F.lit(dx * dx) + 4 * F.lit(lean) * a * mean))
        wide = F.lit(dx) + up * F.lit(self.top - dx)
        places = [
            (F.lit(0.0), a * dy, b * dz), (F.lit(dx) + b * F.lit(self.top - dx), a * dy, b * dz), (wide * b, F.lit(0.0), up * dz), (wide * b, F.lit(dy), up * dz), (a * dx, b * dy, F.lit(0.0)), (a * F.lit(float(self.top)), b * dy, F.lit(dz)),
        ]
        pick = lambda k: reduce(lambda later, j: F.when(F.col("u0") < ends[j], places[j][k]).otherwise(later), range(4, -1, -1), places[5][k])
        return u.select("i", *((F.lit(float(c)) + pick(k)).alias(name) for k, (name, c) in enumerate(zip(self.names, self.x0, strict=True))))
