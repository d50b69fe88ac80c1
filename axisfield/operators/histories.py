"""Operators on the past of a field or series: convolutions, fractional derivatives, tracks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisfield.operators.rules import rule_sum
from axisfield.operators.series import BLOCK, adjacent, blocked, nearest_known


def time_convolution(rows: DataFrame, time: str, kernel, value, nodes: int = 16, start: float = 0.0, into: str = "convolution") -> DataFrame:
    """Adds the integral of kernel(t - s) value(s) from start to t, by Gauss nodes; zero before the start.

    `kernel` and `value` take a column and return one. Each row is its own integral, so repeated rows stay apart.
    """
    x, w = np.polynomial.legendre.leggauss(nodes)
    rule = [{"x": (a + 1) / 2, "w": b / 2} for a, b in zip(x, w, strict=True)]
    span = F.greatest(F.col(time) - F.lit(start), F.lit(0.0))
    at = lambda e: F.lit(start) + span * e["x"]
    return rows.withColumn(into, rule_sum(rule, lambda e: kernel(F.col(time) - at(e)) * value(at(e)) * span * e["w"]))


def causal_filter(rows: DataFrame, series: list[str], step: str, value: str, weights: list[float], into: str = "filtered") -> DataFrame:
    """Adds the sum of weights[k] times the value k whole steps before within a series (rows alike in step all count).

    A step with no row adds nothing. A series is cut into spans of as many steps as there are weights; each span
    is one list, met by its own rows and those of the next span, so no task holds a series and no row is exploded.
    """
    span = F.lit(max(1, len(weights)))
    cut = F.floor(F.col(step) / span)
    pairs = F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).alias("v")))
    spans = rows.groupBy(*series, cut.alias("__span")).agg(pairs.alias("__here"))
    before = spans.select(*series, (F.col("__span") + 1).alias("__span"), F.col("__here").alias("__before"))
    both = rows.withColumn("__span", cut).join(spans, [*series, "__span"]).join(before, [*series, "__span"], "left")
    taps = F.array(*(F.lit(float(w)) for w in weights))
    age = lambda e: (F.col(step) - e["s"]).cast("int")
    total = lambda column: F.aggregate(F.coalesce(column, F.array().cast(both.schema["__here"].dataType)), F.lit(0.0), lambda t, e: t + F.when(age(e).between(0, len(weights) - 1), F.get(taps, age(e)) * e["v"]).otherwise(F.lit(0.0)))
    return both.withColumn(into, total(F.col("__here")) + total(F.col("__before"))).drop("__span", "__here", "__before")


def difference_weights(order: float, n: int) -> list[float]:
    """Weights of the n-term difference of a real order: (-1)^k binomial(order, k)."""
    out = [1.0]
    for k in range(1, n):
        out.append(out[-1] * (k - 1 - order) / k)
    return out


def fractional_derivative(rows: DataFrame, name: str, value, order: float, step: float, terms: int, sign: int = 1, into: str = "derivative") -> DataFrame:
    """Adds the one-sided difference of a real order on `terms` declared steps: to the left (1) or the right (-1)."""
    if step <= 0:
        return rows.withColumn(into, F.lit(0.0))
    rule = [{"d": k * step * sign, "c": w / step**order} for k, w in enumerate(difference_weights(order, terms))]
    return rows.withColumn(into, rule_sum(rule, lambda e: value(F.col(name) - e["d"]) * e["c"]))


def riesz_derivative(rows: DataFrame, names: list[str], value, order: float, step: float, terms: int, into: str = "derivative") -> DataFrame:
    """Adds -(left + right) / (2 cos(pi order / 2)) summed over the axes; `value` takes a dict of columns."""
    scale = -1 / (2 * math.cos(math.pi * order / 2) * step**order)
    rule = [{"d": k * step * s, "c": w * scale} for s in (1, -1) for k, w in enumerate(difference_weights(order, terms))]
    moved = lambda axis, e: {n: F.col(n) - e["d"] if n == axis else F.col(n) for n in names}
    return rows.withColumn(into, sum((rule_sum(rule, lambda e, axis=axis: value(moved(axis, e)) * e["c"]) for axis in names), F.lit(0.0)))


def sampled_indices(order: float, draws: int, table: int = 4096, seed: int = 0) -> list[dict[str, float]]:
    """Draws of a difference's term k >= 1 by the size of its weight, merged: what the sampled operators sum over.

    Terms up to `table` are drawn by their weights; those behind have the sign and the sum of the closed form
    prod (1 - order / i), which falls like (k + (1 - order) / 2)^-order, so a draw among them is an inversion. No term is left out:
    the mean of c value(k) is the whole difference's sum behind its first term. Whole orders have no terms behind.
    """
    weights = np.array(difference_weights(order, table)[1:])
    # the sum of all weights is zero: what is behind a term is the other sign of what is before
    behind = -float(np.prod(1 - order / np.arange(1, len(weights) + 1)))
    total = np.abs(weights).sum() + abs(behind)
    draw = np.random.default_rng(seed)
    drawn = draw.choice(len(weights) + 1, size=draws, p=np.append(np.abs(weights), abs(behind)) / total)
    places, counts = np.unique(drawn[drawn < len(weights)], return_counts=True)
    near = [{"k": float(k + 1), "c": float(np.sign(weights[k]) * total * n / draws)} for k, n in zip(places, counts, strict=True)]
    far, shift = int((drawn == len(weights)).sum()), (1 - order) / 2
    last = np.ceil((len(weights) + shift) * (1 - draw.random(far)) ** (-1 / order) - shift)
    return [*near, *({"k": float(max(k, len(weights) + 1)), "c": float(np.sign(behind) * total / draws)} for k in last)]


def sampled_fractional_derivative(rows: DataFrame, name: str, value, order: float, step: float, draws: int, sign: int = 1, seed: int = 0, into: str = "derivative") -> DataFrame:
    """The difference of a real order with its first term exact and the others drawn by their weights (a declared number)."""
    rule = [{"k": 0.0, "c": 1.0}, *sampled_indices(order, draws, seed=seed)]
    return rows.withColumn(into, rule_sum(rule, lambda e: value(F.col(name) - e["k"] * F.lit(step * sign)) * e["c"]) / F.lit(step**order))


def sampled_riesz_derivative(rows: DataFrame, names: list[str], value, order: float, step: float, draws: int, seed: int = 0, into: str = "derivative") -> DataFrame:
    """The symmetric form of the same, each axis and side with the same draws."""
    scale = -1 / (2 * math.cos(math.pi * order / 2) * step**order)
    rule = [{"k": s * e["k"], "c": e["c"] * scale} for s in (1, -1) for e in [{"k": 0.0, "c": 1.0}, *sampled_indices(order, draws, seed=seed)]]
    moved = lambda axis, e: {n: F.col(n) - e["k"] * F.lit(step) if n == axis else F.col(n) for n in names}
    return rows.withColumn(into, sum((rule_sum(rule, lambda e, axis=axis: value(moved(axis, e)) * e["c"]) for axis in names), F.lit(0.0)))


def caputo(rows: DataFrame, time: str, derivative, order: float, nodes: int = 16, start: float = 0.0, into: str = "caputo") -> DataFrame:
    """Adds the Caputo derivative of an order between whole numbers; `derivative` is the next whole one, as a function of a column.

    With s = t - (t - start) r^(1 / (m - order)) the weak singularity goes into the measure, so Gauss nodes converge.
    """
    m = math.ceil(order)
    if order <= 0 or order >= 2 or order == m:
        raise ValueError("an order in (0, 1) or (1, 2) is needed")
    p = m - order
    x, w = np.polynomial.legendre.leggauss(nodes)
    rule = [{"r": ((a + 1) / 2) ** (1 / p), "w": b / 2} for a, b in zip(x, w, strict=True)]
    span = F.greatest(F.col(time) - F.lit(start), F.lit(0.0))
    total = rule_sum(rule, lambda e: derivative(F.col(time) - span * e["r"]) * e["w"])
    return rows.withColumn(into, total * F.pow(span, F.lit(p)) / F.lit(math.gamma(p + 1)))


def caputo_of_values(rows: DataFrame, time: str, value, order: float, nodes: int = 32, start: float = 0.0, slope=None, into: str = "caputo") -> DataFrame:
    """The same from the values alone, by parts: (u(t) - u(start)) / span^order and the integral of differences over (t - s)^(1 + order).

    For orders above one `slope` is the first derivative, whose differences take the values' place.
    """
    m = math.ceil(order)
    if order <= 0 or order >= 2 or order == m or (m == 2 and slope is None):
        raise ValueError("an order in (0, 1), or in (1, 2) with a slope, is needed")
    f, part = (value, order) if m == 1 else (slope, order - 1)
    q = 1 - part
    x, w = np.polynomial.legendre.leggauss(nodes)
    # r = z^(1 / q) takes the singularity (u(t) - u(s)) / (t - s)^(1 + part) ~ r^-part into the measure
    rule = [{"r": ((a + 1) / 2) ** (1 / q), "w": b / 2 / q} for a, b in zip(x, w, strict=True)]
    span = F.greatest(F.col(time) - F.lit(start), F.lit(0.0))
    here = f(F.col(time))
    inner = rule_sum(rule, lambda e: (here - f(F.col(time) - span * e["r"])) / e["r"] * e["w"])
    out = (here - f(F.lit(start)) + F.lit(part) * inner) / (F.pow(span, F.lit(part)) * F.lit(math.gamma(q)))
    return rows.withColumn(into, F.when(span > 0, out).otherwise(F.lit(0.0)))


def fractional_laplacian(rows: DataFrame, offsets: list[dict[str, float]], difference, radius, order: float, dim: int, into: str = "laplacian") -> DataFrame:
    """Adds the integral over a ball of (u(x) - u(x + offset)) / |offset|^(dim + order), without a constant.

    `offsets` is a rule with weights w; `difference` and `radius` take its entries. Offsets in opposite pairs cancel the
    gradient, which orders above one need.
    """
    if not 0 < order < 2:
        raise ValueError("an order in (0, 2) is needed")
    return rows.withColumn(into, rule_sum(offsets, lambda e: difference(e) / F.pow(radius(e), F.lit(dim + order)) * e["w"]))


def slopes(observed: DataFrame, series: list[str], time: str, value: str, into: str = "slope") -> DataFrame:
    """Adds the mean of the secants to the rows before and after, one-sided at the ends; `observed` has one row per series and time."""
    near = adjacent(blocked(observed, series, [time]), series, [time], F.struct(F.col(time).alias("t"), F.col(value).alias("y")))
    secant = lambda p: (F.col(value) - F.col(f"{p}.y")) / (F.col(time) - F.col(f"{p}.t"))
    before, after = secant("__back"), secant("__ahead")
    return near.withColumn(into, F.coalesce((before + after) / F.lit(2.0), before, after, F.lit(0.0))).drop("__back", "__ahead", BLOCK)


def track(observed: DataFrame, asked: DataFrame, series: list[str], time: str, value: str, into: str = "tracked") -> DataFrame:
    """Cubic Hermite values of each series at the asked times, by one sorted pass over both kinds of rows, in blocks of time.

    `observed` has one row per series and time. Outside the observed times the end value holds, and an unobserved series is null.
    """
    found = slopes(observed.select(*series, F.col(time).alias("__time"), F.col(value).alias("__value")), series, "__time", "__value")
    known = found.select(*series, F.col("__time").alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col("__time").alias("t"), F.col("__value").alias("y"), F.col("slope").alias("d")).alias("__o"))
    places = asked.select(*series, F.col(time).alias("__at"), F.lit(1).alias("__kind"), F.struct(*(F.col(f"`{c}`") for c in asked.columns)).alias("__q"))
    both = blocked(known.unionByName(places, allowMissingColumns=True), series, ["__at", "__kind"])
    # a row of the same time comes before the asked one, whose value is then the left end's
    ends = nearest_known(both, series, ["__at", "__kind"], "__o", last="__l", first="__r").where("__kind = 1")
    a, b = F.col("__l"), F.col("__r")
    h = b.t - a.t
    s = (F.col("__at") - a.t) / h
    cubic = a.y * (1 + 2 * s) * (1 - s) * (1 - s) + h * a.d * s * (1 - s) * (1 - s) + b.y * s * s * (3 - 2 * s) - h * b.d * s * s * (1 - s)
    out = F.when(a.isNull(), b.y).when(b.isNull() | (h == 0), a.y).otherwise(cubic)
    return ends.select("__q.*", out.alias(into))
