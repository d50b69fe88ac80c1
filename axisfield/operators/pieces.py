"""Weights of the pieces of a boundary, and fields that keep a different target on each.

A piece is a table of points with outward normals. A row's distance to a piece is a local mean, over the k nearest of its points, of how far the
row lies from their tangents: weights fall with the distance and favour points that face the row. The piece's weight
is the inverse square of a softened distance, so it outweighs all others on the piece itself. The points are found by tiles (`nearby`); the means are
sums of symbolic terms of a row and a point, so their derivatives are sums as well, and a blend is differentiated by the quotient rule
like any field. Which points are nearest, and the nearest one's distance, count as fixed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisfield.functions.expressions import ONE, ZERO, Const, Expr, Label, add, call, exp, lift, ln, maximum, sqrt, where
from axisfield.operators import nearby
from axisfield.operators.enforced import blend
from axisfield.plans.tables import written

# fixed values: how far normals count, how much at least, softening of lengths
FACING, LEAST, SOFT = 0.25, 0.5, 1e-12


@dataclass(frozen=True)
class Known(Expr):
    """A column whose derivatives are columns too, up to an order."""

    stem: str
    by: tuple[str, ...]
    order: int
    so_far: tuple[str, ...] = ()

    def column(self) -> Column:
        return F.col(derivative_name(self.stem, self.so_far))

    def diff(self, name: str) -> Expr:
        if name not in self.by:
            return ZERO
        if len(self.so_far) == self.order:
            raise ValueError(f"derivatives of {self.stem} are known up to order {self.order}")
        return Known(self.stem, self.by, self.order, tuple(sorted((*self.so_far, name))))

    def labels(self) -> frozenset[str]:
        return frozenset((derivative_name(self.stem, self.so_far),))


def derivative_name(stem: str, by: Sequence[str]) -> str:
    return "_".join((stem, *by))


def _terms(names: Sequence[str], width: float) -> tuple[Expr, Expr]:
    """Weighted distance to a point's tangent, and the weight: of the row's labels and the point's, which end in _p and _n."""
    away = [Label(n) - Label(f"{n}_p") for n in names]
    size2 = add(*(a**2 for a in away))
    near = exp((Label("__least") - size2) * (1.0 / (width * width + SOFT)))
    along = add(*(a * Label(f"{n}_n") for a, n in zip(away, names, strict=True)))
    facing = along / sqrt(size2 + SOFT)
    facing = where(facing, ">", 1.0, ONE, where(facing, "<", -1.0, Const(-1.0), facing))
    w = near * (LEAST + (1.0 - LEAST) / (1.0 + FACING * (1.0 - facing) ** 2))
    return w * along, w


def weight(distance: Expr, width: float) -> Expr:
    """The inverse square of a softened distance: about the distance itself outside, flat deep inside."""
    u = distance * (1.0 / width)
    # ln(1 + e^u) for any u
    soft = maximum(u, 0.0) + ln(1.0 + exp(where(u, ">", 0.0, -u, u)))
    return (call("abs", (soft - math.log(2.0)) * (2.0 * width)) + 1e-16) ** -2


def with_distances(rows: DataFrame, pieces: Sequence[DataFrame], names: Sequence[str], width: float, k: int = 64, order: int = 1) -> tuple[DataFrame, list[Expr]]:
    """The rows with hidden columns, and each piece's distance as an expression over them, differentiable up to `order`.

    Pieces have the columns `names` and n_<name>; one without points has the distance of nothing: null (its weight counts as zero in `blended`).
    `width` is the length over which points count, such as two hundredths of the region's diameter.
    """
    out = nearby.numbered(rows)
    stems, top, low_ = [], *_terms(names, width)
    wanted = [c for r in range(order + 1) for c in combinations_with_replacement(sorted(names), r)]
    for piece in pieces:
        stem = f"__piece{len(stems)}"
        stems.append(stem)
        points = written(piece.select(*(F.col(n).cast("double") for n in names), *(F.col(f"n_{n}").cast("double").alias(f"n_{n}") for n in names)).orderBy(*names, *(f"n_{n}" for n in names)).withColumn("item", F.monotonically_increasing_id()))
        tiles = nearby.tiled(points, "item", nearby.Kind((tuple(names),)))
        asked = out.select(F.col("__row").alias("row"), *(F.col(n).cast("double").alias(n) for n in names))
        found = nearby.nearest(asked, names, tiles, k)
        least = found.groupBy("row").agg(F.min("d2").alias("__least"))
        length = F.sqrt(sum((F.col(f"n_{n}") * F.col(f"n_{n}") for n in names), F.lit(0.0)))
        ends = points.select("item", *(F.col(n).alias(f"{n}_p") for n in names), *((F.col(f"n_{n}") / length).alias(f"{n}_n") for n in names))
        pairs = found.select("row", "item").join(ends, "item").join(asked.join(least, "row"), "row")
        sums = []
        for by in wanted:
            for kind, term in (("top", top), ("low", low_)):
                for n in by:
                    term = term.diff(n)
                sums.append(F.sum(term.column()).alias(derivative_name(f"{stem}_{kind}", by)))
        out = out.join(pairs.groupBy(F.col("row").alias("__row")).agg(*sums), "__row", "left")
    by = tuple(sorted(names))
    return out.drop("__row"), [Known(f"{s}_top", by, order) / Known(f"{s}_low", by, order) for s in stems]


def piece_weights(rows: DataFrame, pieces: Sequence[DataFrame], names: Sequence[str], width: float, k: int = 64, order: int = 1) -> tuple[DataFrame, list[Expr]]:
    """The rows with hidden columns, and the weight of each piece as an expression."""
    out, distances = with_distances(rows, pieces, names, width, k, order)
    return out, [weight(d, width) for d in distances]


@dataclass(frozen=True)
class Known0(Expr):
    """An expression that counts as zero where it is null."""

    of: Expr

    def column(self) -> Column:
        return F.coalesce(self.of.column(), F.lit(0.0))

    def diff(self, name: str) -> Expr:
        d = self.of.diff(name)
        return d if isinstance(d, Const) else Known0(d)

    def labels(self) -> frozenset[str]:
        return self.of.labels()


def blended(rows: DataFrame, fields: Sequence[Expr], pieces: Sequence[DataFrame], names: Sequence[str], width: float, rest: tuple[Expr, DataFrame] | None = None, k: int = 64, order: int = 1) -> tuple[DataFrame, Expr]:
    """The rows with hidden columns, and the field that takes each piece's field near it: u such as `dirichlet(u, phi, target)` for each.

    `rest` is the field that is left as it is, with the points of the rest of the boundary. Its derivatives, and those of the
    weights, follow from the quotient rule.
    """
    fields = [*map(lift, fields), *([lift(rest[0])] if rest else [])]
    out, weights = piece_weights(rows, [*pieces, *([rest[1]] if rest else [])], names, width, k, order)
    return out, blend(fields, [Known0(w) for w in weights])
