"""Constraints that draw their points anew in each step, from a seed and the step's number.

A constraint has a component (or a union), a residual of named fields, and how many points each label gets. Step k of a seed gives the same
points whenever it is asked, so a fit repeats. Points may also be drawn where the residual is large: more candidates are drawn than asked for, and
exactly so many of them are kept in proportion to the squared residual, with weights that keep every mean what it was.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.functions.expressions import Expr, lift
from axisfield.functions.networks import substitute
from axisfield.plans.fitting import moment_descent
from axisfield.plans.tables import written
from axisfield.sources.components import Component, Union
from axisfield.sources.planar import spread

Fields = Mapping[str, Expr]


def parse_counts(component: Component, n: int | Mapping[str, int] | tuple[int, Mapping[str, int]]) -> dict[str, int]:
    """Points by a label of each factor: a number for all, numbers by label, or a number and the labels that differ from it."""
    rest, own = (n[0], n[1]) if isinstance(n, tuple) else (None, n) if isinstance(n, Mapping) else (n, {})
    factors = component.domain.factors
    known = {x for f in factors for x in f.labels}
    if unknown := sorted(set(own) - known):
        raise ValueError(f"the component has no labels {unknown}")
    out = {}
    for f in factors:
        counts = {own[x] for x in f.labels if x in own}
        if len(counts) > 1:
            raise ValueError(f"the labels {sorted(f.labels)} are drawn together and have one number of points")
        size = counts.pop() if counts else rest
        if size is None:
            raise ValueError(f"no number of points for {sorted(f.labels)}")
        if size < 0 or int(size) != size:
            raise ValueError("a number of points is a whole number")
        out[f.labels[0]] = int(size)
    return out


@dataclass(frozen=True)
class SamplingConstraint:
    """`residual` takes the fields and gives expressions; `reduction` is "mean" or "integral", `mode` "resample" or "fixed" (always step 0)."""

    component: Component | Union
    residual: Callable[[Fields], Sequence[Expr]]
    points_by_label: int | Mapping[str, int] | tuple[int, Mapping[str, int]]
    sampler: str = "uniform"
    reduction: str = "mean"
    mode: str = "resample"
    weight: float = 1.0
    seed: int = 0

    def __post_init__(self):
        if self.reduction not in ("mean", "integral") or self.mode not in ("resample", "fixed"):
            raise ValueError("a reduction is mean or integral, a mode resample or fixed")
        for c in self.terms():
            parse_counts(c, self.points_by_label)

    @classmethod
    def from_operator(cls, component: Component | Union, operator: Callable[..., Expr | Sequence[Expr]], fields: str | Sequence[str], points_by_label, **options) -> SamplingConstraint:
        """The residual that an operator makes of these fields."""
        names = (fields,) if isinstance(fields, str) else tuple(fields)

        def residual(known: Fields) -> Sequence[Expr]:
            made = operator(*(known[n] for n in names))
            return made if isinstance(made, Sequence) else [made]

        return cls(component, residual, points_by_label, **options)

    def terms(self) -> tuple[Component, ...]:
        return self.component.terms if isinstance(self.component, Union) else (self.component,)

    def points(self, spark: SparkSession, step: int = 0) -> DataFrame:
        """The points of a step with the columns `term` and `q`: the weight of each in the component's integral."""
        out = None
        for k, c in enumerate(self.terms()):
            seed = zlib.crc32(f"{self.seed}/{0 if self.mode == 'fixed' else step}/{k}".encode()) >> 1
            one = c.points(spark, parse_counts(c, self.points_by_label), self.sampler, seed).withColumn("q", c.weight()).withColumn("term", F.lit(k))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def square(self, fields: Fields, values: Mapping[str, float]) -> Column:
        known = {n: lift(float(v)) for n, v in values.items()}
        return sum((u.column() * u.column() for u in (substitute(lift(r), known) for r in self.residual(fields))), F.lit(0.0))

    def focused(self, spark: SparkSession, fields: Fields, values: Mapping[str, float], step: int = 0, candidates: int = 4) -> DataFrame:
        """So many points as `points` gives in a step, of `candidates` times as many, in proportion to weight and squared residual (with its mean
        added, so that no point is out of reach); their weights q keep integrals what they were."""
        more = SamplingConstraint(self.component, self.residual, _times(self.points_by_label, candidates), self.sampler, self.reduction, self.mode, self.weight, self.seed)
        drawn = written(more.points(spark, step).withColumn("__r", self.square(fields, values)))
        mean = drawn.agg(F.sum(F.col("q") * F.col("__r")) / F.sum("q")).first()[0] or 1.0
        scored = drawn.withColumn("__s", F.col("q") * (F.col("__r") + F.lit(float(mean))))
        n = self.points(spark, step).count()
        kept = spread(scored, "__s", n, self.seed + step)
        # each draw stands for the mean share of the score
        return kept.withColumn("q", F.col("w") / (F.col("__r") + F.lit(float(mean)))).drop("__r", "__s", "draw", "w")

    def loss(self, points: DataFrame, fields: Fields, values: Mapping[str, float], names: Sequence[str] = ()) -> tuple[float, np.ndarray]:
        """The weighted mean (or integral) of the squared residual over points, and its slopes in the named parameters: one aggregation."""
        known = {n: lift(float(v)) for n, v in values.items()}
        residuals = [lift(r) for r in self.residual(fields)]
        slopes = [sum((2.0 * substitute(r, known).column() * substitute(r.diff(n), known).column() for r in residuals), F.lit(0.0)) for n in names]
        q = F.col("q")
        row = points.agg(F.sum(q), F.sum(q * self.square(fields, values)), *(F.sum(q * s) for s in slopes)).first()
        scale = self.weight / (row[0] if self.reduction == "mean" else 1.0)
        return scale * row[1], scale * np.array(row[2:], float)


def _times(n, factor: int):
    if isinstance(n, tuple):
        return n[0] * factor, n[1]
    if isinstance(n, Mapping):
        first = next(iter(n))
        return {**n, first: n[first] * factor}
    return n * factor


def fit(spark: SparkSession, fields: Fields, constraints: Sequence[SamplingConstraint], start: Mapping[str, float], steps: int = 50, rate: float = 0.1, focused: bool = False) -> dict[str, float]:
    """Parameters by moment descent, each step on its own points; equal seeds give equal results."""
    names, step = list(start), iter(range(steps + 1))

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        k, values = next(step), dict(zip(names, map(float, x), strict=True))
        found = [c.loss(c.focused(spark, fields, values, k) if focused else c.points(spark, k), fields, values, names) for c in constraints]
        return sum(v for v, _ in found), sum((g for _, g in found), np.zeros(len(names)))

    best, _ = moment_descent(at, np.array(list(start.values()), float), steps, rate)
    return dict(zip(names, map(float, best), strict=True))
