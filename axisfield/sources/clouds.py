"""Regions from points: the triangles of a planar cloud whose circles hold no other point and are no wider than a bound.

A triangle with a circle of radius `alpha` or less has all that can refute it within twice that of each of its corners. So the cloud is
dealt to tiles (`nearby`), each with a margin of 2 alpha, and the tile that owns a triangle's first corner decides on it: no task holds the
cloud, and every triangle is made once. Points on one circle would have several triangulations; each point is lifted by a hash of
its place, far below the cloud's own distances, which picks the same one everywhere; what rounding leaves open is decided in fractions.

Defined results: points without a place, and copies of a place, count once or not at all; a cloud on a line, or of points
farther apart than 2 alpha, has no triangles. Points within 2 alpha of one point (the cloud's density times alpha^2) are looked at
together, so alpha bounds a task's work: it should be a few times the cloud's spacing.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisfield.operators import nearby
from axisfield.plans.tables import written

#: How far a lift may reach, as a share of alpha squared.
LIFT = 1e-7


def _lift(places: np.ndarray, alpha: float) -> np.ndarray:
    """A number in [0, LIFT alpha^2) for each place, by mixing the bits of its coordinates."""
    bits = np.ascontiguousarray(places + 0.0).view(np.uint64)
    mixed = (bits[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ ((bits[:, 1] ^ (bits[:, 1] >> np.uint64(31))) * np.uint64(0xD1B54A32D192ED03))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed / 2.0**64 * LIFT * alpha * alpha


def _exact_side(here: np.ndarray, lift: float, corners: list[tuple[np.ndarray, float]], spot: tuple[np.ndarray, float]) -> int:
    """Whether a spot is outside (1) or inside (-1) of the circle of three points, in whole fractions: the same from whichever point it is asked."""

    def from_here(p: np.ndarray, w: float) -> tuple[Fraction, Fraction, Fraction]:
        x, y = Fraction(float(p[0])) - Fraction(float(here[0])), Fraction(float(p[1])) - Fraction(float(here[1]))
        return x, y, x * x + y * y + Fraction(float(w)) - Fraction(float(lift))

    (xj, yj, zj), (xk, yk, zk), (xs, ys, zs) = (from_here(*c) for c in (*corners, spot))
    cross = xj * yk - xk * yj
    above = (zs * cross - (zj * yk - zk * yj) * xs - (xj * zk - xk * zj) * ys) * (1 if cross > 0 else -1)
    return 1 if above > 0 else -1


def _neighbours(at: np.ndarray, strip: np.ndarray, mine: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of some points and the others within reach, by point; points are sorted by strips as wide as the reach, and within them."""
    who, other = [], []
    names, starts = np.unique(strip, return_index=True)
    stops = np.append(starts[1:], len(strip))
    for p_strip in np.unique(strip[mine]):
        own = mine[strip[mine] == p_strip]
        for s in np.flatnonzero(np.abs(names - p_strip) <= 1):
            y = at[starts[s] : stops[s], 1]
            low, high = np.searchsorted(y, at[own, 1] - reach), np.searchsorted(y, at[own, 1] + reach, "right")
            n = high - low
            who.append(np.repeat(own, n))
            other.append(starts[s] + np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
    who, other = np.concatenate(who), np.concatenate(other)
    around = at[other] - at[who]
    close = (np.hypot(around[:, 0], around[:, 1]) <= reach) & (who != other)
    who, other = who[close], other[close]
    order = np.lexsort((other, who))
    return who[order], other[order]


def _stars(here: np.ndarray, lift: np.ndarray, places: np.ndarray, lifts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, j, k): the neighbours j, k of points (all with as many of them) that make a triangle with it whose circle is empty."""
    x, y = np.moveaxis(places - here[:, None], 2, 0)
    z = x * x + y * y + (lifts - lift[:, None])
    j, k = np.triu_indices(places.shape[1], 1)
    cross, away = x[:, j] * y[:, k] - x[:, k] * y[:, j], np.hypot(x, y)
    r, pair = np.nonzero(np.abs(cross) > 1e-12 * (away[:, j] * away[:, k]))
    j, k, cross = j[pair], k[pair], cross[r, pair]
    # the circle's middle, from the point
    cx, cy = (z[r, j] * y[r, k] - z[r, k] * y[r, j]) / (2 * cross), (x[r, j] * z[r, k] - x[r, k] * z[r, j]) / (2 * cross)
    near = cx * cx + cy * cy <= alpha * alpha
    r, j, k, cx, cy = r[near], j[near], k[near], cx[near], cy[near]
    good = np.zeros(len(r), bool)
    step = max(1, 500_000 // max(1, places.shape[1]))
    for a in range(0, len(r), step):
        own = slice(a, a + step)
        above = z[r[own]] - 2 * (cx[own, None] * x[r[own]] + cy[own, None] * y[r[own]])
        rows = np.arange(len(above))
        above[rows, j[own]] = above[rows, k[own]] = np.inf
        # what rounding can't tell is decided exactly, if nothing else is inside
        unsure = np.abs(above) <= 1e-11 * alpha * alpha
        sure = np.where(unsure, np.inf, above)
        for q in np.flatnonzero(unsure.any(axis=1) & (sure.min(axis=1) > 0)):
            p = r[a + q]
            for s in np.flatnonzero(unsure[q]):
                corners = [(places[p, n], lifts[p, n]) for n in (j[a + q], k[a + q])]
                above[q, s] = _exact_side(here[p], lift[p], corners, (places[p, s], lifts[p, s]))
        good[own] = above.min(axis=1) > 0
    return r[good], j[good], k[good]


def _star(here: np.ndarray, lift: float, places: np.ndarray, lifts: np.ndarray, alpha: float) -> np.ndarray:
    """Pairs (j, k) of one point's neighbours that make a triangle with it."""
    return np.stack(_stars(here[None], np.array([lift]), places[None], lifts[None], alpha)[1:], axis=1)


def triangulated(cloud: DataFrame, alpha: float, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(x0, y0, x1, y1, x2, y2): the triangles of a cloud with circles of radius `alpha` at most."""
    if alpha <= 0:
        raise ValueError("alpha is a radius")
    places = cloud.select(*((F.col(n).cast("double") + F.lit(0.0)).alias(c) for n, c in zip(names, "xy", strict=True))).distinct()
    points = written(places.orderBy("x", "y").withColumn("item", F.monotonically_increasing_id()))
    tiles = nearby.tiled(points, "item", nearby.Kind((("x", "y"),)), tile=2048)
    schema = ", ".join(f"{c}{k} double" for k in range(3) for c in "xy")
    if not len(tiles.counts):
        return cloud.sparkSession.createDataFrame([], schema)
    owned = tiles.items.select("tile", "item", "x", "y", F.lit(True).alias("own"))
    shared = cloud.sparkSession.sparkContext.broadcast((tiles.low, tiles.high))
    margin = 4 * alpha * alpha * (1 + 1e-9)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = shared.value
        for batch in batches:
            at, tile = nearby._matrix(batch, "xy"), batch.column("tile").to_numpy()
            for group in nearby.halved(at, nearby.GROUP):
                # only boxes within reach of some point of the group
                boxes = np.flatnonzero(nearby._apart(at[group].min(axis=0), at[group].max(axis=0), low, high)[0] <= margin)
                who, other = np.nonzero(nearby.box_distance(at[group], low[boxes], high[boxes]) <= margin)
                who, other = group[who], boxes[other]
                away = tile[who] != other
                some = batch.take(pa.array(who[away]))
                yield pa.RecordBatch.from_arrays([pa.array(other[away].astype(np.int32)), some.column("item"), some.column("x"), some.column("y"), pa.array(np.zeros(some.num_rows, bool))], names=["tile", "item", "x", "y", "own"])

    halo = owned.mapInArrow(reach, "tile int, item long, x double, y double, own boolean")

    def work(table: pa.Table) -> pa.Table:
        at, item, own = nearby._matrix(table, "xy"), table.column("item").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        order = np.lexsort((at[:, 1], np.floor(at[:, 0] / (2 * alpha))))
        at, item, own = at[order], item[order], own[order]
        lifts = _lift(at, alpha)
        # strips of 2 alpha, sorted within: a point's neighbours lie in three stretches
        strip = np.floor(at[:, 0] / (2 * alpha))
        found = [np.zeros((0, 3), int)]
        mine = np.flatnonzero(own)
        for a in range(0, len(mine), 2048):
            who, other = _neighbours(at, strip, mine[a : a + 2048], 2 * alpha)
            ends = np.searchsorted(who, mine[a : a + 2048], "right")
            sizes = np.diff(ends, prepend=0)
            for m in np.unique(sizes[sizes > 1]):
                these = np.flatnonzero(sizes == m)
                near = other[(ends[these] - m)[:, None] + np.arange(m)]
                step = max(1, 500_000 // (m * (m - 1) // 2))
                for c in range(0, len(these), step):
                    points, close = mine[a : a + 2048][these[c : c + step]], near[c : c + step]
                    rows, j, k = _stars(at[points], lifts[points], at[close], lifts[close], alpha)
                    three = np.stack((points[rows], close[rows, j], close[rows, k]), axis=1)
                    # the first corner's tile has the triangle
                    found.append(three[(item[three[:, 1:]] > item[three[:, :1]]).all(axis=1)])
        found = np.concatenate(found)
        return pa.table({f"{c}{k}": at[found[:, k], i] for k in range(3) for i, c in enumerate("xy")})

    # a task a tile: the rows are few for the work they make, and would be put together by their bytes
    return owned.unionByName(halo).repartition(len(tiles.counts), "tile").groupBy("tile").applyInArrow(work, schema)
