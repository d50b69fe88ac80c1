"""Separable samples of a component: a table an axis for some factors, rows for the others, joined only by what is reduced.

A factor that is laid out by axes takes all its labels as axes, over its box; a shape's grid has one mask of the
nodes inside. Fields that read one axis are evaluated on its table, and fields of one factor on its masked grid, so
their cost is that of the axis or grid. Axes have declared sizes; only they are broadcast, up to a stated number of
nodes. Rows of tables are never broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.sources.components import Component, DatasetFactor, Interior, ScalarInterval
from axisfield.sources.grids import axis
from axisfield.sources.samplers import SAMPLERS

#: Nodes of a grid that may be broadcast.
BROADCAST_NODES = 1 << 18

#: A number of drawn nodes of equal weight, or a rule's kind, nodes and variant.
Spec = int | tuple[str, int] | tuple[str, int, str]


def _nodes(spark: SparkSession, spec: Spec, label: str, low: float, high: float, sampler: str, seed: int) -> DataFrame:
    """(label, w): the rule's own weights, or the length over the number of nodes."""
    if isinstance(spec, int):
        if spec < 1:
            raise ValueError("an axis needs a node")
        return SAMPLERS[sampler](spark, spec, [label], [low], [high], seed=seed).select(label, F.lit((high - low) / spec).alias("w"))
    kind, n, *rule = spec
    return axis(spark, kind, n, low, high, label, *rule).select(label, "w")


def _joined(tables: Sequence[DataFrame], sizes: Sequence[int | None]) -> DataFrame:
    """All rows with all, weights multiplied; the first may have any size, the others are broadcast if they are small by declaration."""
    out = tables[0]
    for other, size in zip(tables[1:], sizes[1:], strict=True):
        small = size is not None and size <= BROADCAST_NODES
        out = out.withColumnRenamed("w", "__w").crossJoin(F.broadcast(other) if small else other).withColumn("w", F.col("__w") * F.col("w")).drop("__w")
    return out


@dataclass(frozen=True)
class Part:
    """A factor by axes (a table a label), or rows (no axes), with the condition that its nodes or rows fulfil."""

    labels: tuple[str, ...]
    tables: tuple[DataFrame, ...]
    sizes: tuple[int | None, ...]
    inside: Column | None

    @property
    def nodes(self) -> int | None:
        return None if None in self.sizes else math.prod(self.sizes)

    def grid(self) -> DataFrame:
        return _joined(self.tables, self.sizes)

    def kept(self) -> DataFrame:
        return self.grid() if self.inside is None else self.grid().where(self.inside)


@dataclass(frozen=True)
class Separable:
    component: Component
    parts: tuple[Part, ...]

    def on(self, label: str, fields: dict[str, Column]) -> Separable:
        """Fields that read one axis, or one factor's rows, evaluated on its own table."""
        if not any(label in p.labels for p in self.parts):
            raise ValueError(f"{label} is no label of the domain")
        at = lambda p: p.labels.index(label) if len(p.tables) > 1 else 0
        return replace(self, parts=tuple(
            replace(p, tables=tuple(t.withColumns(fields) if k == at(p) else t for k, t in enumerate(p.tables))) if label in p.labels else p for p in self.parts))

    def _ordered(self) -> list[Part]:
        # rows, whose number is not declared, first: all that is joined to them is small by declaration
        return sorted(self.parts, key=lambda p: (p.nodes is not None, -(p.nodes or 0)))

    def points(self) -> DataFrame:
        """Every node with every row: the weight w, and mask, whether it lies inside all shapes and fulfils all conditions. Null conditions are false."""
        parts = self._ordered()
        conditions = [*(p.inside for p in parts if p.inside is not None), *([] if self.component.where_all is None else [self.component.where_all])]
        return _joined([p.grid() for p in parts], [p.nodes for p in parts]).withColumn("mask", reduce(lambda a, b: a & b, (F.coalesce(c.cast("boolean"), F.lit(False)) for c in conditions), F.lit(True)))

    def _within(self) -> DataFrame:
        """The rows of the mask, each factor's nodes masked before they meet the others."""
        parts, c = self._ordered(), self.component
        out = _joined([p.kept() for p in parts], [p.nodes for p in parts])
        out = out if c.where_all is None else out.where(c.where_all)
        return out if c.weight_all is None else out.withColumn("w", F.col("w") * c.weight_all)

    def integrals(self, fields: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
        """Integrals over the component, one row or one for each value of some columns; 0 if no node is inside, when there is one row."""
        sums = [F.sum(F.col("w") * f).alias(k) for k, f in fields.items()]
        return self._within().groupBy(*by).agg(*sums) if by else self._within().agg(*(F.coalesce(F.sum(F.col("w") * f), F.lit(0.0)).alias(k) for k, f in fields.items()))

    def total_weight(self) -> DataFrame:
        """One row: the sum of all weights inside. Without conditions on several factors it is the product of the factors' sums, with no product of rows."""
        if self.component.where_all is not None or self.component.weight_all is not None:
            return self.integrals({"total": F.lit(1.0)})
        sums = [p.kept().agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")) for p in self.parts]
        return _joined(sums, [1] * len(sums)).select(F.col("w").alias("total"))


def separable(component: Component, spark: SparkSession, axes: dict[str, Spec], n: dict[str, int] | int = 0, sampler: str = "halton", seed: int = 0) -> Separable:
    """Factors of the labels in `axes` by axes, the others by n points (by label or for all; tables with 0: all their rows).

    Only interiors are laid out by axes. `where` of a label of a factor holds for that factor's nodes.
    """
    known = {x for f in component.domain.factors for x in f.labels}
    if unknown := set(axes) - known:
        raise ValueError(f"no labels of the domain: {sorted(unknown)}")
    parts = []
    for k, f in enumerate(component.domain.factors):
        conditions = [c for x, c in component.where.items() if x in f.labels]
        asked, part = [x for x in f.labels if x in axes], component.part(f)
        if asked:
            if isinstance(f, DatasetFactor) or not isinstance(part, Interior):
                raise ValueError("only interiors of shapes and intervals are laid out by axes")
            if len(asked) < len(f.labels):
                raise ValueError(f"a factor has all its labels as axes or none: {f.labels}")
            low, high = ([f.start], [f.end]) if isinstance(f, ScalarInterval) else f.shape.box
            tables = tuple(_nodes(spark, axes[x], x, float(a), float(b), sampler, seed + 64 * k + j) for j, (x, a, b) in enumerate(zip(f.labels, low, high, strict=True)))
            sizes: tuple[int | None, ...] = tuple(s if isinstance(s, int) else s[1] for s in (axes[x] for x in f.labels))
            if not isinstance(f, ScalarInterval):
                conditions.insert(0, f.shape.sdf() < F.lit(-1e-6))
        else:
            size = n if isinstance(n, int) else next((n[x] for x in f.labels if x in n), 0)
            if not size and not isinstance(f, DatasetFactor) and isinstance(part, Interior):
                raise ValueError(f"how many points of {f.labels}?")
            tables, sizes = (f.points(spark, part, size, sampler, seed + k),), (None if isinstance(f, DatasetFactor) else max(size, 2),)
        parts.append(Part(tuple(f.labels), tables, sizes, reduce(lambda a, b: a & b, conditions) if conditions else None))
    return Separable(component, tuple(parts))
