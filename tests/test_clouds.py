"""Triangulated clouds against the definition: circles without points, no gaps, no overlaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisfield.operators import nearby
from axisfield.sources import clouds
from axisfield.sources import planar as P


def frame(spark, points):
    return spark.createDataFrame([tuple(None if c is None else float(c) for c in p) for p in points], "x double, y double")


def circles(tri):
    t = np.array(tri).reshape(-1, 3, 2)
    b, c = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
    m = np.stack(((c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d), axis=1)
    return t[:, 0] + m, np.linalg.norm(m, axis=1)


def test_random_cloud_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(nearby, "TILE", 60)
    monkeypatch.setattr(nearby, "SAMPLE", 150)
    points = np.random.default_rng(3).random((400, 2))
    rows = frame(spark, [*points, *points[:20], (None, 1.0), (float("nan"), 0.0)])
    alpha = 0.12
    got = [tuple(r) for r in clouds.triangulated(rows, alpha).collect()]
    assert len({frozenset([t[:2], t[2:4], t[4:]]) for t in got}) == len(got)
    middles, radii = circles(got)
    assert radii.max() <= alpha * 1.001
    away = np.linalg.norm(points[None] - middles[:, None], axis=2)
    assert (away.min(axis=1) >= radii - 1e-6).all()
    # the inner part of the square is covered once
    area = sum(abs((t[2] - t[0]) * (t[5] - t[1]) - (t[4] - t[0]) * (t[3] - t[1])) / 2 for t in got)
    draw = np.random.default_rng(4).uniform(0.2, 0.8, (300, 2))
    t = np.array(got).reshape(-1, 3, 2)
    side = lambda a, b, p: (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
    for p in draw:
        s = np.stack([side(t[:, k], t[:, (k + 1) % 3], p) for k in range(3)], axis=1)
        assert ((s > 0).all(axis=1) | (s < 0).all(axis=1)).sum() == 1
    assert 0.9 < area < 1.0


def test_points_on_one_circle(spark, monkeypatch):
    monkeypatch.setattr(nearby, "TILE", 30)
    rows = frame(spark, [(i, j) for i in range(12) for j in range(9)])
    faces = clouds.triangulated(rows, 0.8)
    assert faces.count() == 2 * 11 * 8 and P.oriented(faces).agg(F.sum("area")).first()[0] == 88.0
    assert P.boundary_edges(faces).agg(F.sum("length")).first()[0] == 38.0
    # two blocks farther apart than alpha allows, and a hole
    gap = frame(spark, [(i + 20 * (i > 5), j) for i in range(12) for j in range(9) if not 2 <= i <= 3 or not 3 <= j <= 5])
    loops = P.loops(P.boundary_edges(clouds.triangulated(gap, 0.8)))
    assert loops.select("loop").distinct().count() == 3


def test_clouds_without_triangles(spark):
    assert clouds.triangulated(frame(spark, [(k, 2 * k) for k in range(9)]), 5.0).count() == 0
    assert clouds.triangulated(frame(spark, [(0, 0), (9, 0), (0, 9)]), 1.0).count() == 0
    assert clouds.triangulated(frame(spark, []), 1.0).count() == 0
    with pytest.raises(ValueError, match="radius"):
        clouds.triangulated(frame(spark, []), 0.0)


def test_ties_of_lifts_are_decided_alike(monkeypatch, spark):
    """Lifts too small for rounding to tell: the exact sides still agree between neighbours."""
    monkeypatch.setattr(clouds, "LIFT", 1e-15)
    at = np.array([(i * 0.1, 60 + j * 0.1) for i in range(6) for j in range(6)])
    lifts = clouds._lift(at, 0.08)
    found = set()
    for p in range(len(at)):
        near = np.array([q for q in range(len(at)) if q != p and np.hypot(*(at[q] - at[p])) <= 0.16])
        for j, k in near[clouds._star(at[p], lifts[p], at[near], lifts[near], 0.08)]:
            found.add((frozenset((p, int(j), int(k))), p))
    triangles = {t for t, _ in found}
    # every corner of a triangle sees it, and they fill the square
    assert len(found) == 3 * len(triangles) and len(triangles) == 50
