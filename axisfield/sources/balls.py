"""Offsets of equal weight in a ball, as declared rules: directions times radii, or points that fill it one by one."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

#: The turn by which a spiral's neighbours never line up.
GOLDEN = math.pi * (3 - math.sqrt(5))


def volume(radius: float, dim: int) -> float:
    return math.pi ** (dim / 2) / math.gamma(dim / 2 + 1) * radius**dim


def halves(n: int, dim: int) -> np.ndarray:
    """Ranks 0..n - 1 as the middles of n equal volumes, turned into radii."""
    return ((np.arange(n) + 0.5) / n) ** (1 / dim)


def on_circle(turns: np.ndarray) -> np.ndarray:
    return np.stack((np.cos(turns), np.sin(turns)), axis=1)


def on_sphere(turns: np.ndarray, heights: np.ndarray) -> np.ndarray:
    return np.column_stack((on_circle(turns) * np.sqrt(1 - heights**2)[:, None], heights))


def _axes(dim: int) -> np.ndarray:
    return np.kron([[1.0], [-1.0]], np.eye(dim))


def _icosahedron() -> np.ndarray:
    """Twelve corners: turns by fifths on two rings, and the poles."""
    height = 1 / math.sqrt(5)
    fifths = 2 * math.pi / 5 * np.arange(5)
    return np.concatenate((on_sphere(fifths, np.full(5, height)), on_sphere(fifths + math.pi / 5, np.full(5, -height)), [[0, 0, 1], [0, 0, -1]]))


#: Fixed sets of directions, by name: their dimension and the directions.
FIXED: dict[str, tuple[int, Callable[[], np.ndarray]]] = {"axis4": (2, lambda: _axes(2)), "octa6": (3, lambda: _axes(3)), "ico12": (3, _icosahedron)}


def _spread(dim: int, n: int, seed: int) -> np.ndarray:
    """n directions by van der Corput numbers (binary turns, ternary heights), moved by the seed."""
    move = np.random.default_rng(seed).random(2)

    def mirrored(base: int) -> np.ndarray:
        left, unit, out = np.arange(1, n + 1), 1.0, np.zeros(n)
        while left.any():
            unit /= base
            out += left % base * unit
            left //= base
        return out

    turns = 2 * math.pi * ((mirrored(2) + move[0]) % 1)
    return on_circle(turns) if dim == 2 else on_sphere(turns, 2 * ((mirrored(3) + move[1]) % 1) - 1)


def _spiral(dim: int, n: int) -> np.ndarray:
    """One point for each of n equal volumes: radii and turns along a spiral, heights (in space) along another."""
    if dim == 1:
        return np.linspace(-1, 1, 2 * n + 1)[1::2, None]
    turns = GOLDEN * np.arange(n)
    if dim == 2:
        return on_circle(turns) * halves(n, 2)[:, None]
    # heights run down once while radii follow a turn of their own, so that no shell lacks a height
    shells = ((np.arange(n) * (GOLDEN / math.pi) + 0.5) % 1) ** (1 / 3)
    return on_sphere(turns, np.linspace(1, -1, 2 * n + 1)[1::2]) * shells[:, None]


def _cells(dim: int, n: int) -> np.ndarray:
    """Middles of a cube's cells that lie inside, with cells of about the n-th part of the ball."""
    across = max(1, round((n / volume(0.5, dim)) ** (1 / dim)))
    line = np.linspace(-1, 1, 2 * across + 1)[1::2]
    at = np.array(np.meshgrid(*[line] * dim)).reshape(dim, -1).T
    return at[np.linalg.norm(at, axis=1) <= 1]


def ball_rule(radius: float, dim: int, n: int = 2048, design: str = "fibonacci", shells: int | Sequence[float] | None = None, seed: int = 0) -> list[dict[str, float]]:
    """Entries with the offsets xi0, xi1, ... and the weight w; all weights are the volume over their number.

    fibonacci: a spiral; grid: the cells of a cube; axis4, octa6, ico12: fixed directions, and random_qmc: directions that fill the sphere,
    each at the middle radii of `shells` shells of equal volume (or at given volume shares). Without a number of shells, fixed directions take as many as come
    nearest to n points, and random_qmc the dim-th root of n.
    """
    if dim not in (1, 2, 3) or radius <= 0 or n < 1:
        raise ValueError("a ball has a radius, one to three dimensions and a point")
    if design in ("fibonacci", "grid"):
        at = (_spiral if design == "fibonacci" else _cells)(dim, n)
    else:
        fixed = FIXED.get(design, (0, None))
        if fixed[0] != dim and not (design == "random_qmc" and dim > 1):
            raise ValueError(f"no design {design} in {dim} dimensions")
        directions = fixed[1]() if fixed[1] else None
        if isinstance(shells, Sequence):
            radii = np.array(shells, float) ** (1 / dim)
        else:
            radii = halves(shells or max(1, round(n / len(directions) if directions is not None else n ** (1 / dim))), dim)
        directions = directions if directions is not None else _spread(dim, max(1, round(n / len(radii))), seed)
        at = np.concatenate([directions * r for r in radii])
    weight = volume(radius, dim) / len(at)
    return [{**{f"xi{j}": float(radius * x) for j, x in enumerate(spot)}, "w": weight} for spot in at]
