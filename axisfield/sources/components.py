"""Domains as products of factors, and their components: which part of each factor is meant, with masks and weights.

A factor is a shape, a scalar interval (such as time) or a table of rows. A component picks the interior, the
boundary or a fixed value of each factor; `points` makes its table, with the product weight w (whose sum is the
component's measure) and, for boundaries, normals. Factors are generated tables of stated sizes, so their
product is a broadcast join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.sources.samplers import draws
from axisfield.sources.shapes import Line, Shape


@dataclass(frozen=True)
class Interior:
    pass


@dataclass(frozen=True)
class Boundary:
    pass


@dataclass(frozen=True)
class Fixed:
    """A single value of a scalar factor, of measure one."""

    value: float


class FixedStart:
    pass


class FixedEnd:
    pass


Selector = Interior | Boundary | Fixed | FixedStart | FixedEnd


@dataclass(frozen=True)
class ScalarInterval:
    """A closed interval of one label, such as time."""

    start: float
    end: float
    label: str = "t"

    def __post_init__(self):
        if not self.start < self.end:
            raise ValueError("an interval ends after it starts")

    @property
    def labels(self) -> tuple[str, ...]:
        return (self.label,)

    def fixed(self, which: str) -> float:
        return {"start": self.start, "end": self.end}[which]

    def _line(self) -> Line:
        return Line(self.start, self.end, (self.label,))

    def measure(self, part: Selector) -> float:
        return self._line().measure if isinstance(part, Interior) else 2.0 if isinstance(part, Boundary) else 1.0

    def points(self, spark: SparkSession, part: Selector, n: int, sampler: str, seed: int) -> DataFrame:
        if isinstance(part, Interior):
            return self._line().interior(spark, n, sampler, seed).select(self.label, "w")
        ends = [self.start, self.end] if isinstance(part, Boundary) else [part.value if isinstance(part, Fixed) else self.fixed("start" if isinstance(part, FixedStart) else "end")]
        if any(not self.start <= x <= self.end for x in ends):
            raise ValueError("a fixed value lies in its interval")
        # the boundary is its two ends, each of measure one, with the normal to the outside
        normal = f", n_{self.label} double" if isinstance(part, Boundary) else ""
        return spark.createDataFrame([(float(x), 1.0, *([-1.0, 1.0][k : k + 1] if normal else [])) for k, x in enumerate(ends)], f"{self.label} double, w double{normal}")


TimeInterval = ScalarInterval


@dataclass(frozen=True)
class ShapeFactor:
    """A shape with its columns as labels."""

    shape: Shape

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(self.shape.names)

    def measure(self, part: Selector) -> float:
        if isinstance(part, Interior):
            return self.shape.measure
        if isinstance(part, Boundary):
            return self.shape.boundary_measure
        raise ValueError("only scalar factors have fixed values")

    def points(self, spark: SparkSession, part: Selector, n: int, sampler: str, seed: int) -> DataFrame:
        self.measure(part)
        out = self.shape.interior(spark, n, sampler, seed) if isinstance(part, Interior) else self.shape.boundary(spark, n, sampler, seed)
        return out.drop("i")


@dataclass(frozen=True)
class DatasetFactor:
    """Rows of a table, of measure one as a whole (probability) or one each (count); `order` tells rows apart for drawing."""

    rows: DataFrame
    order: str
    kind: str = "probability"

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(self.rows.columns)

    def measure(self, part: Selector) -> float:
        if not isinstance(part, Interior):
            raise ValueError("a dataset has no boundary and no fixed values")
        return 1.0 if self.kind == "probability" else float(self.rows.count())

    def points(self, spark: SparkSession, part: Selector, n: int, sampler: str, seed: int) -> DataFrame:
        """n draws with replacement, whatever the sampler; n = 0: all rows, each once."""
        total = self.measure(part)
        if n:
            return draws(self.rows, n, self.order, seed).drop("draw").withColumn("w", F.lit(total / n))
        one = self.rows.agg((F.lit(total) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("w"))  # one row
        return self.rows.crossJoin(F.broadcast(one))


Factor = ScalarInterval | ShapeFactor | DatasetFactor


@dataclass(frozen=True)
class Component:
    """`parts` by factor (by any of its labels), the rest interior; where and weight of single labels or of all."""

    domain: Domain
    parts: dict[str, Selector] = field(default_factory=dict)
    where: dict[str, Column] = field(default_factory=dict)
    where_all: Column | None = None
    weight_all: Column | None = None

    def part(self, factor: Factor) -> Selector:
        return next((self.parts[k] for k in factor.labels if k in self.parts), Interior())

    def measure(self) -> float:
        """The product of the factors' measures, without masks and weights."""
        return reduce(lambda m, f: m * f.measure(self.part(f)), self.domain.factors, 1.0)

    def points(self, spark: SparkSession, n: dict[str, int] | int, sampler: str = "halton", seed: int = 0) -> DataFrame:
        """The factors' points, each with each (n by label or for all); masks and weights are columns of the reduction, not filters."""
        out = None
        for k, f in enumerate(self.domain.factors):
            size = n if isinstance(n, int) else next((n[x] for x in f.labels if x in n), 1)
            one = f.points(spark, self.part(f), size, sampler, seed + k)
            out = one if out is None else out.withColumnRenamed("w", "__w").crossJoin(F.broadcast(one)).withColumn("w", F.col("__w") * F.col("w")).drop("__w")
        return out

    def mask(self) -> Column:
        conditions = [*self.where.values(), *([] if self.where_all is None else [self.where_all])]
        return reduce(lambda m, c: m * F.coalesce(c.cast("double"), F.lit(0.0)), conditions, F.lit(1.0))

    def weight(self) -> Column:
        return F.col("w") * self.mask() * (F.lit(1.0) if self.weight_all is None else self.weight_all)

    def integrals(self, points: DataFrame, fields: dict[str, Column]) -> DataFrame:
        """One row: integrals over the component, in one pass."""
        return points.agg(*(F.sum(self.weight() * f).alias(k) for k, f in fields.items()))

    def means(self, points: DataFrame, fields: dict[str, Column]) -> DataFrame:
        return points.agg(*((F.sum(self.weight() * f) / F.sum(self.weight())).alias(k) for k, f in fields.items()))

    def _shape(self, label: str) -> Shape:
        f = self.domain.factor(label)
        if not isinstance(f, ShapeFactor):
            raise ValueError(f"{label} is no label of a shape")
        return f.shape

    def normals(self, label: str) -> list[Column]:
        """The unit normal of a boundary part's factor, as columns over its labels."""
        if not isinstance(self.part(self.domain.factor(label)), Boundary):
            raise ValueError("normals are those of a boundary")
        return self._shape(label).normal()

    def sdf(self, label: str) -> Column:
        return self._shape(label).sdf()


@dataclass(frozen=True)
class Domain:
    factors: tuple[Factor, ...]

    def __post_init__(self):
        labels = [x for f in self.factors for x in f.labels]
        if len(labels) != len(set(labels)):
            raise ValueError("factors share a label")

    def factor(self, label: str) -> Factor:
        return next(f for f in self.factors if label in f.labels)

    def join(self, other: Domain) -> Domain:
        """The product; factors that both have are one."""
        return Domain((*self.factors, *(f for f in other.factors if f not in self.factors)))

    def relabel(self, label: str, to: str) -> Domain:
        def named(f: Factor) -> Factor:
            if label not in f.labels:
                return f
            if isinstance(f, ScalarInterval):
                return replace(f, label=to)
            if isinstance(f, ShapeFactor):
                return ShapeFactor(replace(f.shape, names=tuple(to if x == label else x for x in f.labels)))
            return replace(f, rows=f.rows.withColumnRenamed(label, to), order=to if f.order == label else f.order)

        return Domain(tuple(map(named, self.factors)))

    def restrict(self, labels: Sequence[str]) -> Domain:
        return Domain(tuple(f for f in self.factors if set(f.labels) & set(labels)))

    def drop(self, labels: Sequence[str]) -> Domain:
        return Domain(tuple(f for f in self.factors if not set(f.labels) & set(labels)))

    def component(self, parts: dict[str, Selector] | None = None, **options) -> Component:
        return Component(self, parts or {}, **options)

    def boundary(self) -> Union:
        """One term a factor that has a boundary: that factor's boundary and the others' interiors."""
        return Union(tuple(self.component({f.labels[0]: Boundary()}) for f in self.factors if not isinstance(f, DatasetFactor)))


@dataclass(frozen=True)
class Union:
    """Components that may overlap; integrals add up."""

    terms: tuple[Component, ...]

    def measure(self) -> float:
        return sum(t.measure() for t in self.terms)

    def integrals(self, spark: SparkSession, n: dict[str, int] | int, fields: Callable[[Component], dict[str, Column]] | dict[str, Column], sampler: str = "halton", seed: int = 0) -> DataFrame:
        """A row per term and one for all (term null)."""
        rows = None
        for k, t in enumerate(self.terms):
            one = t.integrals(t.points(spark, n, sampler, seed), fields(t) if callable(fields) else fields).withColumn("term", F.lit(k))
            rows = one if rows is None else rows.unionByName(one)
        names = [c for c in rows.columns if c != "term"]
        return rows.rollup("term").agg(*(F.sum(c).alias(c) for c in names))
