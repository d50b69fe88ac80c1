"""Residuals of pointwise constraints: lists of expressions whose squares an objective sums.

A target is a number, an expression, or the label of a column with values per point, so that
continuous and discrete constraints are the same projection. Normals are expressions or columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisfield.functions.expressions import Expr, lift
from axisfield.operators import calculus as C
from axisfield.operators import reductions as R

Vector = list[Expr]


def loss(points: DataFrame, residual: Sequence[Expr], **options) -> DataFrame:
    """One row: mean, sum or integral of the squared residual over the points."""
    return R.objective(points, [lift(r).column() for r in residual], **options)


def losses(points: DataFrame, residuals: dict[str, Sequence[Expr]], weight: Column | None = None) -> DataFrame:
    """One row: the (weighted) mean square of each residual, in one pass; a weight is a column per point."""
    w = F.lit(1.0) if weight is None else weight
    square = lambda rs: sum((lift(r).column() * lift(r).column() for r in rs), F.lit(0.0))
    return points.agg(*(F.avg(w * square(rs)).alias(k) for k, rs in residuals.items()))


def total_loss(terms: dict[str, DataFrame]) -> DataFrame:
    """The sum of one-row objectives, with a row per term and one for all."""
    rows = None
    for name, df in terms.items():
        one = df.select(F.lit(name).alias("term"), F.col("loss"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.rollup("term").agg(F.sum("loss").alias("loss")).select(F.coalesce("term", F.lit("total")).alias("term"), "loss")


def integral_equality(points: DataFrame, values: Sequence[Column], targets: Sequence[float], weight: Column, into: str = "loss") -> DataFrame:
    """One row: the squared distance between the integrals of the values and their targets."""
    parts = [F.sum(v * weight).alias(f"__{k}") for k, v in enumerate(values)]
    gaps = [(F.col(f"__{k}") - F.lit(float(c))) for k, c in enumerate(targets)]
    return points.agg(*parts).select(sum((g * g for g in gaps), F.lit(0.0)).alias(into))


def integral_equalities(points: DataFrame, terms: dict[str, tuple[Expr, float]], weight: Column | None = None) -> DataFrame:
    """The squared gaps of several integrals in one pass; without a weight the points are of total measure one."""
    total = lambda v: F.avg(v) if weight is None else F.sum(v * weight)
    gap = lambda f, c: total(f.column()) - F.lit(float(c))
    return points.agg(*((gap(f, c) * gap(f, c)).alias(k) for k, (f, c) in terms.items()))


# scalar fields


def flux(u: Expr, n: Vector, names: Sequence[str]) -> Expr:
    """The normal derivative."""
    return C.dot(C.grad(u, names), n)


def dirichlet(u: Expr, target=0.0) -> Vector:
    return [u - target]


def neumann(u: Expr, n: Vector, names: Sequence[str], target=0.0) -> Vector:
    return [flux(u, n, names) - target]


def robin(u: Expr, n: Vector, names: Sequence[str], a, b, target=0.0) -> Vector:
    return [lift(a) * u + lift(b) * flux(u, n, names) - target]


def absorbing(u: Expr, n: Vector, names: Sequence[str], speed, target=0.0, time: str = "t") -> Vector:
    return [flux(u, n, names) + u.diff(time) / lift(speed) - target]


def initial(u: Expr, target=0.0, order: int = 0, time: str = "t") -> Vector:
    """For points whose time is fixed at the start."""
    return [C.partial(u, time, order) - target]


def heat_flux(u: Expr, n: Vector, names: Sequence[str], conductivity, target=0.0) -> Vector:
    return [lift(conductivity) * flux(u, n, names) - target]


def convection(u: Expr, n: Vector, names: Sequence[str], conductivity, transfer, ambient) -> Vector:
    return [lift(conductivity) * flux(u, n, names) - lift(transfer) * (u - ambient)]


# velocities and displacements


def normal_component(v: Vector, n: Vector, target=0.0) -> Vector:
    """No penetration, symmetry, and prescribed normal displacement."""
    return [C.dot(v, n) - target]


def slip_wall(v: Vector, pressure: Expr, viscosity: float, n: Vector, names: Sequence[str]) -> Vector:
    """The tangential part of the traction -p n + mu (grad v + grad v^T) n."""
    e = C.strain(v, names)
    pull = [a * (2.0 * viscosity) - pressure * b for a, b in zip(C.matvec(e, n), n, strict=True)]
    return C.tangential(pull, n)


def zero_normal_gradient(v: Vector, n: Vector, names: Sequence[str]) -> Vector:
    return [flux(c, n, names) for c in v]


def traction(stress: list[Vector], n: Vector, target: Sequence) -> Vector:
    return [a - b for a, b in zip(C.matvec(stress, n), target, strict=True)]


def displacement(u: Vector, target: Sequence) -> Vector:
    return [a - b for a, b in zip(u, target, strict=True)]


def elastic_foundation(stress: list[Vector], u: Vector, n: Vector, stiffness, rest: Sequence) -> Vector:
    return [a + lift(stiffness) * (b - c) for a, b, c in zip(C.matvec(stress, n), u, rest, strict=True)]


def elastic_symmetry(stress: list[Vector], u: Vector, n: Vector) -> Vector:
    """No normal displacement and no tangential traction."""
    along = C.dot(u, n)
    return [along * a + b for a, b in zip(n, C.tangential(C.matvec(stress, n), n), strict=True)]


# electromagnetic fields


def tangential_field(e: Vector, n: Vector, target: Sequence | None = None) -> Vector:
    """Perfect electric or magnetic conductors, and continuity when given a difference of fields."""
    out = C.tangential(e, n)
    return out if target is None else displacement(out, target)


def impedance(e: Vector, h: Vector, n: Vector, admittance) -> Vector:
    return [a - lift(admittance) * b for a, b in zip(C.cross(n, h), C.tangential(e, n), strict=True)]


def surface_charge(e: Vector, n: Vector, permittivity, density=0.0) -> Vector:
    return [lift(permittivity) * C.dot(e, n) - density]


def surface_current(h: Vector, n: Vector, current: Sequence) -> Vector:
    return [a - b for a, b in zip(C.cross(n, h), current, strict=True)]


def normal_jump(second: Vector, first: Vector, n: Vector, k2, k1, target=0.0) -> Vector:
    """k2 a2.n - k1 a1.n of two media: the displacement (with a charge) or the magnetic flux (without)."""
    return [lift(k2) * C.dot(second, n) - lift(k1) * C.dot(first, n) - target]


def tangential_jump(second: Vector, first: Vector, n: Vector, current: Sequence) -> Vector:
    return surface_current([a - b for a, b in zip(second, first, strict=True)], n, current)


# integrands over boundaries, for integral_equality


def kinetic_energy_flux(v: Vector, n: Vector, density) -> Expr:
    return lift(density) * 0.5 * C.dot(v, v) * C.dot(v, n)


def power_flux(e: Vector, h: Vector, n: Vector) -> Expr:
    """The flux of E x H."""
    return C.dot(C.cross(e, h), n)
