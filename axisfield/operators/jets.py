"""Taylor terms along a direction, and n-th derivatives of products and quotients, as expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from axisfield.functions.expressions import Expr, add, lift, power
from axisfield.operators.calculus import partial

Derive = Callable[[Expr, str, int], Expr]


def jet_terms(u: Expr, direction: Mapping[str, Expr | float], order: int) -> list[Expr]:
    """The derivatives 1..order of u(x + e v) at e = 0; several labels move at once, and v does not depend on them."""
    moving = set(direction)
    if any(lift(v).labels() & moving for v in direction.values()):
        raise ValueError("a direction must not depend on the labels that it moves")
    out = []
    for _ in range(order):
        u = add(*(lift(v) * u.diff(n) for n, v in direction.items()))
        out.append(u)
    return out


def jet(u: Expr, direction: Mapping[str, Expr | float], n: int) -> Expr:
    return jet_terms(u, direction, n)[-1] if n else u


def jet_first_two(u: Expr, direction: Mapping[str, Expr | float]) -> tuple[Expr, Expr]:
    one, two = jet_terms(u, direction, 2)
    return one, two


def taylor(u: Expr, direction: Mapping[str, Expr | float], order: int, step: Expr | float) -> Expr:
    """u(x + step v) to the order."""
    return add(u, *(t * lift(step) ** (k + 1) * (1 / math.factorial(k + 1)) for k, t in enumerate(jet_terms(u, direction, order))))


def product_derivative(a: Expr, b: Expr, name: str, n: int, derive: Derive = partial) -> Expr:
    """The n-th derivative of a b by the binomial sum; `derive` makes the factors' own."""
    return add(*(derive(a, name, k) * derive(b, name, n - k) * float(math.comb(n, k)) for k in range(n + 1)))


def quotient_derivative(a: Expr, b: Expr, name: str, n: int, derive: Derive = partial) -> Expr:
    """The n-th derivative of a / b, each from those below it: a^(n) = sum of binomials of b^(k) q^(n - k)."""
    q: list[Expr] = []
    for m in range(n + 1):
        rest = add(*(derive(b, name, k) * q[m - k] * float(math.comb(m, k)) for k in range(1, m + 1)), 0.0 * a) if m else None
        q.append((derive(a, name, m) - rest if rest is not None else a) * power(b, -1.0))
    return q[n]


def gated(base: Expr, overlay: Expr, gate: Expr) -> Expr:
    """base + gate (overlay - base)."""
    return base + gate * (overlay - base)
