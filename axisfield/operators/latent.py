"""Fields over product domains as contractions of latent factors: each factor is evaluated on its own axis.

u_o = sum over l of the product over factors of g_l,o. A grid's axes are tables; a factor's latent numbers are computed once for each row of its axis, below
the product, so that the cost of evaluation is the sum of the axes and the product only multiplies short arrays. A point table is
treated alike: a factor is evaluated once for each distinct place of its own labels. A derivative by a label differentiates only the
factors that have it. An integral over the whole grid needs no grid: sums over each axis are contracted.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisfield.functions.expressions import Expr, add, lift, mul
from axisfield.functions.networks import Network

#: Rows of an axis that may be broadcast in a product, counted; the others stay where they are.
BROADCAST_ROWS = 200_000
#: Numbers of all factors up to which a product is written out.
UNROLLED = 256


@dataclass(frozen=True)
class Policy:
    """How points are evaluated: "axes" (each factor on its distinct places), "points" (row by row), or "auto": axes, where factors share no label.

    `fallback` says what happens where axes were asked for and can't be had: "warn", "error" or "silent".
    """

    layout: str = "auto"
    fallback: str = "warn"

    def __post_init__(self):
        if self.layout not in ("auto", "axes", "points") or self.fallback not in ("warn", "error", "silent"):
            raise ValueError("a layout is auto, axes or points; a fallback is warn, error or silent")


@dataclass(frozen=True)
class Contraction:
    """Factors by name: latent * out expressions (latent first), or latent ones, which count for every output."""

    factors: dict[str, tuple[Expr, ...]]
    latent: int
    out: int = 1
    policy: Policy = Policy()

    def __post_init__(self):
        for name, g in self.factors.items():
            if len(g) not in (self.latent, self.latent * self.out):
                raise ValueError(f"factor {name} has {len(g)} numbers, not {self.latent} or {self.latent * self.out}")

    @classmethod
    def of(cls, factors: dict[str, Network | Sequence[Expr]], latent: int, out: int = 1, policy: Policy | None = None) -> Contraction:
        written = {k: tuple(map(lift, f.expression() if isinstance(f, Network) else f)) for k, f in factors.items()}
        return cls(written, latent, out, policy or Policy())

    def labels(self, factor: str) -> frozenset[str]:
        return frozenset().union(*(g.labels() for g in self.factors[factor]))

    def _number(self, factor: str, l: int, o: int) -> Expr:  # noqa: E741
        g = self.factors[factor]
        return g[l * self.out + o] if len(g) == self.latent * self.out else g[l]

    def pointwise(self) -> list[Expr]:
        """The outputs written out over all labels."""
        return [add(*(mul(*(self._number(f, l, o) for f in self.factors)) for l in range(self.latent))) for o in range(self.out)]  # noqa: E741

    def diff(self, label: str) -> Contraction:
        """The derivative by a label that one factor has: a contraction of the same latent size."""
        having = [f for f in self.factors if label in self.labels(f)]
        if len(having) > 1:
            raise ValueError(f"the factors {having} share the label {label}: differentiate the pointwise form")
        if not having:
            return replace(self, factors={k: tuple(mul(lift(0.0), x) for x in g) for k, g in self.factors.items()})
        return replace(self, factors={k: tuple(x.diff(label) for x in g) if k in having else g for k, g in self.factors.items()})

    def _evaluated(self, rows: DataFrame, factor: str) -> DataFrame:
        """An axis with its latent numbers as one array, by output and then latent place."""
        numbers = [self._number(factor, l, o).column().cast("double") for o in range(self.out) for l in range(self.latent)]  # noqa: E741
        return rows.withColumn(f"__g_{factor}", F.array(*numbers))

    def _contracted(self, into: Sequence[str]) -> list[Column]:
        arrays = [F.col(f"__g_{f}") for f in self.factors]
        if self.latent * self.out * len(arrays) <= UNROLLED:
            # written out, in the same order: compiled with the join, without functions over arrays
            term = lambda k: functools.reduce(lambda x, y: x * y, (a[k] for a in arrays))
            return [functools.reduce(lambda s, x: s + x, (term(o * self.latent + l) for l in range(self.latent)), F.lit(0.0)).alias(n) for o, n in zip(range(self.out), into, strict=True)]  # noqa: E741
        products = arrays[0]
        for a in arrays[1:]:
            products = F.zip_with(products, a, lambda x, y: x * y)
        one = lambda o: F.aggregate(F.slice(products, o * self.latent + 1, self.latent), F.lit(0.0), lambda s, x: s + x)
        return [one(o).alias(n) for o, n in zip(range(self.out), into, strict=True)]

    def on_grid(self, axes: dict[str, DataFrame], into: Sequence[str]) -> DataFrame:
        """The product of the axes (one a factor, columns of different names) with the outputs.

        The first axis may be of any size; the others are broadcast, and counted beforehand.
        """
        if set(axes) != set(self.factors):
            raise ValueError("each factor needs its axis")
        out = None
        for name in self.factors:
            axis = self._evaluated(axes[name], name)
            if out is None:
                out = axis
                continue
            if (n := axes[name].count()) > BROADCAST_ROWS:
                raise ValueError(f"the axis of {name} has {n} rows; put the largest first, a grid of two such axes is too large to be made")
            out = out.crossJoin(F.broadcast(axis))
        kept = [c for name in self.factors for c in axes[name].columns]
        return out.select(*(F.col(f"`{c}`") for c in kept), *self._contracted(into))

    def on_points(self, rows: DataFrame, into: Sequence[str]) -> DataFrame:
        """The rows with the outputs: each factor is evaluated for the distinct places of its labels, then joined, or row by row."""
        shared = [a for f in self.factors for a in self.labels(f) if sum(a in self.labels(g) for g in self.factors) > 1]
        if self.policy.layout == "axes" and shared:
            message = f"factors share the labels {sorted(set(shared))}: evaluated row by row"
            if self.policy.fallback == "error":
                raise ValueError(message)
            if self.policy.fallback == "warn":
                warnings.warn(message, stacklevel=2)
        if self.policy.layout == "points" or shared:
            return rows.select(*(F.col(f"`{c}`") for c in rows.columns), *(u.column().alias(n) for u, n in zip(self.pointwise(), into, strict=True)))
        out = rows
        for name in self.factors:
            own = sorted(self.labels(name))
            if not own:
                out = self._evaluated(out, name)
                continue
            places = self._evaluated(rows.select(*own).distinct(), name).select(*(F.col(c).alias(f"__at_{c}") for c in own), f"__g_{name}")
            same = None
            for c in own:
                one = F.col(c).eqNullSafe(F.col(f"__at_{c}"))
                same = one if same is None else same & one
            out = out.join(places, same, "left").drop(*(f"__at_{c}" for c in own))
        return out.select(*(F.col(f"`{c}`") for c in rows.columns), *self._contracted(into))

    def integrals(self, axes: dict[str, DataFrame], into: Sequence[str], weight: str = "w", masks: dict[str, Column] | None = None) -> DataFrame:
        """One row: the outputs' integrals over the grid of weighted axes, and its total weight; a mask of a factor holds on its own axis.

        Each axis is summed by itself; the grid is never made.
        """
        out, total = None, F.lit(1.0)
        for name in self.factors:
            axis = axes[name].where(masks[name]) if masks and name in masks else axes[name]
            size = self.latent * self.out
            g = self._evaluated(axis, name)
            sums = g.agg(F.array(*(F.coalesce(F.sum(F.col(f"__g_{name}")[k] * F.col(weight)), F.lit(0.0)) for k in range(size))).alias(f"__g_{name}"), F.coalesce(F.sum(weight), F.lit(0.0)).alias(f"__w_{name}"))
            total = total * F.col(f"__w_{name}")
            out = sums if out is None else out.crossJoin(sums)  # one row each
        return out.select(*self._contracted(into), total.alias("total_weight"))
