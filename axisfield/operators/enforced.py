"""Fields rewritten so that a constraint holds by construction; phi is zero on the boundary."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisfield.functions.expressions import ONE, Expr, add, lift
from axisfield.operators import calculus as C
from axisfield.operators.histories import track
from axisfield.operators.nearby import numbered
from axisfield.operators.nonlocal_ops import inverse_distance, nearest
from axisfield.operators.residuals import flux

Vector = list[Expr]


def dirichlet(u: Expr, phi: Expr, target) -> Expr:
    return lift(target) + phi * (u - target)


def neumann(u: Expr, phi: Expr, n: Vector, names: Sequence[str], target=0.0) -> Expr:
    return u + phi / flux(phi, n, names) * (lift(target) - flux(u, n, names))


def robin(u: Expr, phi: Expr, n: Vector, names: Sequence[str], a, b, target=0.0) -> Expr:
    return u + phi / (lift(b) * flux(phi, n, names)) * (lift(target) - lift(a) * u - lift(b) * flux(u, n, names))


def absorbing(u: Expr, phi: Expr, n: Vector, names: Sequence[str], speed, target=0.0, time: str = "t") -> Expr:
    return u + phi / flux(phi, n, names) * (lift(target) - flux(u, n, names) - u.diff(time) / lift(speed))


def traction(u: Vector, phi: Expr, n: Vector, names: Sequence[str], lame: float, mu: float, target: Sequence) -> Vector:
    """u + phi (r_t / mu + r_n / (lambda + 2 mu)) with r the traction that is missing."""
    missing = [lift(t) - s for t, s in zip(target, C.matvec(C.elastic_stress(u, lame, mu, names), n), strict=True)]
    normal = C.dot(missing, n)
    return [a + phi * (t * (1 / mu) + normal * k * (1 / (lame + 2 * mu))) for a, t, k in zip(u, C.tangential(missing, n), n, strict=True)]


def initial(u: Expr, targets: dict[int, Expr | float], length: float, start: float = 0.0, gate: str = "rational", gate_eps: float = 1e-2, time: str = "t") -> Expr:
    """Targets of all orders 0..m at the start; a gate of order m + 1 leads over to u."""
    orders = range(len(targets))
    if set(orders) != set(targets):
        raise ValueError("targets of all orders from 0 are needed")
    from axisfield.functions.expressions import Label

    since, q = Label(time) - start, len(targets)
    taylor = add(*(lift(targets[k]) * since**k * (1 / math.factorial(k)) for k in orders))
    if gate == "poly":
        g = since**q
    elif gate == "rational" and gate_eps > 0:
        tau = (since * (1 / (length * gate_eps ** (1 / q)))) ** q
        g = tau / (ONE + tau)
    else:
        raise ValueError("the gate is rational, with a positive eps, or poly")
    return taylor + g * (u - taylor)


def blend(fields: Sequence[Expr], weights: Sequence[Expr]) -> Expr:
    """The weighted mean of fields, such as one per piece of a boundary."""
    return add(*(w * f for w, f in zip(weights, fields, strict=True))) / add(*weights)


def interior_data(rows: DataFrame, anchors: DataFrame, u: Expr, gate: Expr, names: Sequence[str], value: str, exponent: float = 2.0, snap: float = 1e-12, into: str = "u") -> DataFrame:
    """Adds the field u + gate * (inverse-distance mean of the anchors' gaps over their gates): it has the anchors' values there
    and keeps what u meets where the gate is zero. Anchors have the columns `names` and `value`; a gate of zero at one is an error.
    """
    size = gate.column()
    gap = F.when(size == 0, F.raise_error(F.lit("the gate is zero at an anchor")).cast("double")).otherwise((F.col(value) - u.column()) / size)
    gaps = anchors.select(*(F.col(n).alias(f"__{n}") for n in names), gap.alias("__gap"))
    out = inverse_distance(rows, gaps, [(n, f"__{n}") for n in names], "__gap", exponent, snap, into="__mean")
    return out.withColumn(into, u.column() + size * F.col("__mean")).drop("__mean")


def pipelines(fields: dict[str, Expr], stages: dict[str, Callable[[dict[str, Expr]], Expr]], needs: dict[str, Sequence[str]]) -> dict[str, Expr]:
    """Each field's rewrite after those of the fields that it needs; a cycle is an error."""
    done = dict(fields)
    for name in TopologicalSorter({k: needs.get(k, ()) for k in fields}).static_order():
        if name in stages:
            done[name] = stages[name](done)
    return done


def sensor_tracks(rows: DataFrame, sensors: DataFrame, observed: DataFrame, u: Expr, gate: Expr, names: Sequence[str], time: str = "t", k: int = 8, exponent: float = 2.0, snap: float = 1e-12, envelope: float | None = None, into: str = "u") -> DataFrame:
    """Adds the field u + gate * (inverse-distance mean over the k nearest sensors of their gaps at the row's time, over their gates).

    `sensors` has sensor and the columns `names`; `observed` has sensor, `time` and value, one row per sensor and time. A sensor's value between
    its times is the cubic through them (`track`), so the field has the sensors' values at their places and times, and keeps what u meets
    where the gate is zero. With an `envelope` weights are also damped by exp(-d^2 / envelope^2), and a row without near sensors keeps u.

    Defined results: sensors without a place or an observation have no say; a row without a place, time or sensor has u itself; a gate of zero at
    a sensor that is used is an error.
    """
    kept = [c for c in rows.columns if c != into]
    asked = numbered(rows.select(*(F.col(f"`{c}`") for c in kept)))
    seen = sensors.join(observed.select("sensor").distinct(), "sensor", "left_semi").select(*(F.col(n).cast("double").alias(n) for n in names), "sensor")
    found = nearest(asked.where(F.col(time).isNotNull()), seen, "__row", names, k)
    pairs = found.select("__row", F.col("distance2").alias("__d2"), "anchor.sensor", *(F.col(f"anchor.{n}").alias(n) for n in names)).join(asked.select("__row", time), "__row")
    tracked = track(observed.select("sensor", F.col(time).cast("double").alias(time), F.col("value").cast("double").alias("value")), pairs.withColumn(time, F.col(time).cast("double")), ["sensor"], time, "value", into="__y")
    size = gate.column()
    gap = F.when(size == 0, F.raise_error(F.lit("the gate is zero at a sensor")).cast("double")).otherwise((F.col("__y") - u.column()) / size)
    weight = F.pow(F.greatest("__d2", F.lit(1e-300)), F.lit(-exponent / 2))
    damped = F.exp(-F.col("__d2") / F.lit(envelope * envelope)) if envelope else F.lit(1.0)
    sums = tracked.withColumns({"__g": gap, "__w": weight}).groupBy("__row").agg(F.sum(F.col("__w") * F.col("__g") * damped).alias("__a"), F.sum("__w").alias("__b"), F.min(F.struct("__d2", "__g")).alias("__near"))
    mean = F.when(F.col("__near.__d2") < snap, F.col("__near.__g")).otherwise(F.col("__a") / F.col("__b"))
    return asked.join(sums, "__row", "left").select(*(F.col(f"`{c}`") for c in kept), (u.column() + F.coalesce(size * mean, F.lit(0.0))).alias(into))
