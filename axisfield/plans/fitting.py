"""Fits of field parameters: each step is one aggregation over all points, with exact derivatives."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axisfield.functions.expressions import Expr, lift
from axisfield.functions.networks import Network, substitute
from axisfield.operators.enforced import pipelines


def _with(points: DataFrame, names: Sequence[str], values: np.ndarray) -> DataFrame:
    return points.withColumns({n: F.lit(float(v)) for n, v in zip(names, values, strict=True)})


def gradient_step(points: DataFrame, residuals: Sequence[Expr], names: Sequence[str], values: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean squared residual and its gradient in the parameters."""
    slopes = [sum((2.0 * r.column() * r.diff(n).column() for r in residuals), F.lit(0.0)) for n in names]
    square = sum((r.column() * r.column() for r in residuals), F.lit(0.0))
    row = _with(points, names, values).agg(F.avg(square), *(F.avg(s) for s in slopes)).first()
    return row[0], np.array(row[1:], float)


def descend(points: DataFrame, residuals: Sequence[Expr], start: dict[str, float], steps: int = 20, rate: float = 0.1) -> dict[str, float]:
    """Gradient descent that keeps the parameters of the least loss seen."""
    names, now = list(start), np.array(list(start.values()), float)
    best = (np.inf, now)
    for _ in range(steps):
        loss, slope = gradient_step(points, residuals, names, now)
        best = min(best, (loss, now), key=lambda b: b[0])
        now = now - rate * slope
    loss, _ = gradient_step(points, residuals, names, now)
    best = min(best, (loss, now), key=lambda b: b[0])
    return dict(zip(names, map(float, best[1]), strict=True))


def gauss_newton(points: DataFrame, residuals: Sequence[Expr], start: dict[str, float], steps: int = 10, damping: float = 1e-9) -> dict[str, float]:
    """Damped Gauss-Newton: J^T J and J^T r are sums, so only k(k + 3) / 2 numbers come to the driver a step."""
    names, now = list(start), np.array(list(start.values()), float)
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(steps):
        j = [[r.diff(n).column() for n in names] for r in residuals]
        sums = [F.avg(sum((row[a] * row[b] for row in j), F.lit(0.0))) for a, b in pairs]
        sums += [F.avg(sum((row[a] * r.column() for row, r in zip(j, residuals, strict=True)), F.lit(0.0))) for a in range(k)]
        found = np.array(_with(points, names, now).agg(*sums).first(), float)
        normal = np.zeros((k, k))
        for (a, b), v in zip(pairs, found, strict=False):
            normal[a, b] = normal[b, a] = v
        move = np.linalg.solve(normal + damping * np.eye(k), found[len(pairs) :])
        now = now - move
        if np.abs(move).max() < 1e-12:
            break
    return dict(zip(names, map(float, now), strict=True))


# minimisers of a loss that is one aggregation over all rows: the driver holds the parameters alone

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def network_objective(rows: DataFrame, network: Network, loss: Expr, weight: Column | None = None) -> tuple[Objective, np.ndarray]:
    """The loss and slope of a network as a function of its parameters, and their start."""
    names = list(network.start)

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = network.bound(dict(zip(names, map(float, x), strict=True))).value_and_slope(rows, loss, weight)
        return value, np.array([slope[n] for n in names])

    return at, np.array([network.start[n] for n in names], float)


def residual_objective(rows: DataFrame, residuals: Sequence[Expr], start: dict[str, float]) -> tuple[Objective, np.ndarray]:
    names = list(start)
    return lambda x: gradient_step(rows, residuals, names, x), np.array(list(start.values()), float)


def strong_wolfe(f: Objective, x: np.ndarray, value: float, slope: np.ndarray, move: np.ndarray, c1: float = 1e-4, c2: float = 0.9, most: int = 20, first: float = 1.0) -> tuple[float, float, np.ndarray]:
    """A step along `move` that lowers the value enough and flattens the slope enough: bracketing, then bisection by a cubic.

    Returns the step, value and slope there; the best point seen if the conditions are not met in `most` looks.
    """
    d0 = float(slope @ move)
    low, high, step = 0.0, np.inf, first
    best = (0.0, value, slope)
    for _ in range(most):
        v, g = f(x + step * move)
        d = float(g @ move)
        if np.isfinite(v) and v < best[1]:
            best = (step, v, g)
        if not np.isfinite(v) or v > value + c1 * step * d0:
            high = step
        elif abs(d) <= c2 * abs(d0):
            return step, v, g
        elif d < 0:
            low = step
        else:
            high = step
        step = 2 * low if high == np.inf else (low + high) / 2
        step = step if step else high / 2
    return best


def quasi_newton(f: Objective, x: np.ndarray, steps: int = 50, method: str = "lbfgs", memory: int = 10, tolerance: float = 1e-9) -> tuple[np.ndarray, list[float]]:
    """bfgs, lbfgs (pairs of the last `memory` steps) or ssbroyden (the self-scaled update between bfgs and dfp). Returns the best point and all values."""
    if method not in ("bfgs", "lbfgs", "ssbroyden"):
        raise ValueError(f"unknown method {method}")
    value, slope = f(x)
    values, pairs, h = [value], [], np.eye(len(x))
    for k in range(steps):
        if np.abs(slope).max() < tolerance:
            break
        move = -_two_loops(slope, pairs) if method == "lbfgs" else -h @ slope
        if move @ slope >= 0:
            move, pairs, h = -slope, [], np.eye(len(x))
        first = min(1.0, 1 / np.abs(slope).sum()) if k == 0 else 1.0
        step, new, new_slope = strong_wolfe(f, x, value, slope, move, first=first)
        if not step:
            break
        s, y = step * move, new_slope - slope
        x, value, slope = x + s, new, new_slope
        values.append(value)
        if (sy := float(s @ y)) <= 1e-12 * float(y @ y):
            continue
        if method == "lbfgs":
            pairs = [*pairs[-memory + 1 :], (s, y)]
            continue
        hy = h @ y
        if k == 0:
            h = h * (sy / float(y @ hy))
            hy = h @ y
        if method == "ssbroyden":
            # scaled so that old curvature does not outweigh the new, then mixed with the dfp form by the same ratio
            tau = min(1.0, sy / float(y @ hy))
            v = s / sy - hy / float(y @ hy)
            mix = max(0.0, min(1.0, tau))
            h = (h - np.outer(hy, hy) / float(y @ hy) + mix * float(y @ hy) * np.outer(v, v)) * max(tau, 1e-8) + np.outer(s, s) / sy
        else:
            r = np.eye(len(x)) - np.outer(s, y) / sy
            h = r @ h @ r.T + np.outer(s, s) / sy
    return x, values


def _two_loops(slope: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    q, kept = slope.copy(), []
    for s, y in reversed(pairs):
        a = float(s @ q) / float(s @ y)
        kept.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(pairs, reversed(kept), strict=True):
        q += (a - float(y @ q) / float(s @ y)) * s
    return q


def sign_descent(f: Objective, x: np.ndarray, steps: int = 100, rate: float = 1e-2) -> tuple[np.ndarray, list[float]]:
    """Steps by the slope's signs, each with a rate that grows while its sign stays and halves when it turns; keeps the best point."""
    rates, before, values = np.full(len(x), rate), np.zeros(len(x)), []
    best = (np.inf, x)
    for _ in range(steps):
        value, slope = f(x)
        values.append(value)
        best = min(best, (value, x), key=lambda b: b[0])
        same = np.sign(slope) * np.sign(before)
        rates = np.clip(np.where(same > 0, rates * 1.2, np.where(same < 0, rates * 0.5, rates)), 1e-6, 1.0)
        before = np.where(same < 0, 0.0, slope)
        x = x - rates * np.sign(before)
    return best[1], values


def moment_descent(f: Objective, x: np.ndarray, steps: int = 100, rate: float = 1e-2, decay: tuple[float, float] = (0.9, 0.999)) -> tuple[np.ndarray, list[float]]:
    """Steps by the running mean of the slope over the root of that of its square; keeps the best point."""
    m, v, values, best = np.zeros(len(x)), np.zeros(len(x)), [], (np.inf, x)
    for k in range(1, steps + 1):
        value, slope = f(x)
        values.append(value)
        best = min(best, (value, x), key=lambda b: b[0])
        m, v = decay[0] * m + (1 - decay[0]) * slope, decay[1] * v + (1 - decay[1]) * slope**2
        x = x - rate * (m / (1 - decay[0] ** k)) / (np.sqrt(v / (1 - decay[1] ** k)) + 1e-8)
    return best[1], values


def evolve(rows: DataFrame, residuals: Sequence[Expr], start: dict[str, float], generations: int = 20, population: int = 24, spread: float = 0.5, seed: int = 0) -> dict[str, float]:
    """Evolution with a normal cloud of parameters: the better half, by rank, moves its middle and its width.

    All members of a generation are judged on the same rows in one pass: their losses are columns of one aggregation.
    """
    draw, names = np.random.default_rng(seed), list(start)
    middle, width = np.array(list(start.values()), float), np.full(len(start), spread)
    weights = np.log(population / 2 + 0.5) - np.log(np.arange(1, population // 2 + 1))
    weights /= weights.sum()
    best = (np.inf, middle)
    for _ in range(generations):
        members = middle + width * draw.standard_normal((population, len(names)))
        members[0] = middle
        square = lambda m: sum((e * e for e in (substitute(r, dict(zip(names, map(lift, map(float, m)), strict=True))).column() for r in residuals)), F.lit(0.0))
        losses = np.array(rows.agg(*(F.avg(square(m)) for m in members)).first(), float)
        order = np.argsort(losses)
        best = min(best, (float(losses[order[0]]), members[order[0]]), key=lambda b: b[0])
        elite = members[order[: population // 2]]
        width = 0.7 * width + 0.3 * np.sqrt(weights @ (elite - middle) ** 2)
        middle = weights @ elite
    return dict(zip(names, map(float, best[1]), strict=True))


@dataclass(frozen=True)
class Solver:
    """Fields with parameters, named terms (rows, residuals, weight) and rewrites that hold constraints by construction.

    `ansatz` gives the fields after the rewrites, `loss` the weighted sum of the terms' means, `solve` fits the parameters.
    """

    fields: dict[str, Expr]
    terms: dict[str, tuple[DataFrame, Callable[[dict[str, Expr]], Sequence[Expr]], float]]
    start: dict[str, float]
    rewrites: dict[str, Callable[[dict[str, Expr]], Expr]] = field(default_factory=dict)
    needs: dict[str, Sequence[str]] = field(default_factory=dict)

    def ansatz(self) -> dict[str, Expr]:
        return pipelines(self.fields, self.rewrites, self.needs)

    def objective(self) -> tuple[Objective, np.ndarray]:
        fields, names = self.ansatz(), list(self.start)
        parts = [(rows, [lift(r) for r in residual(fields)], weight) for rows, residual, weight in self.terms.values()]

        def at(x: np.ndarray) -> tuple[float, np.ndarray]:
            found = [(weight, *gradient_step(rows, residuals, names, x)) for rows, residuals, weight in parts]
            return sum(w * v for w, v, _ in found), sum((w * g for w, _, g in found), np.zeros(len(names)))

        return at, np.array(list(self.start.values()), float)

    def loss(self, values: dict[str, float] | None = None) -> float:
        at, x = self.objective()
        return at(x if values is None else np.array([values[n] for n in self.start], float))[0]

    def solve(self, steps: int = 50, method: str = "lbfgs") -> dict[str, float]:
        """lbfgs, bfgs, ssbroyden, signs or moments."""
        at, x = self.objective()
        run = {"signs": sign_descent, "moments": moment_descent}.get(method)
        found, _ = run(at, x, steps) if run else quasi_newton(at, x, steps, method)
        return dict(zip(self.start, map(float, found), strict=True))
