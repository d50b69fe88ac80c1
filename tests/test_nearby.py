"""Nearest items by tiles against all of them; meshes against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisfield.operators import nearby
from axisfield.sources import meshes as M


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(nearby, "TILE", 40)
    monkeypatch.setattr(nearby, "BLOCK", 30)
    monkeypatch.setattr(nearby, "SAMPLE", 200)


def frame(spark, places, names, key="row"):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], f"{key} long, " + ", ".join(f"{n} double" for n in names))


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.row, {})[r.place] = (r.item, r.d2)
    return {q: [v[k] for k in sorted(v)] for q, v in out.items()}


def test_points_and_segments(spark, small):
    draw = np.random.default_rng(1)
    # a dense spot, a far one, and many at one place, which no split divides
    points = np.concatenate((draw.random((150, 2)), draw.normal(0, 1e-3, (100, 2)), np.full((130, 2), 0.25), [[1e4, -1e4]]))
    asked = np.concatenate((draw.random((60, 2)) * 3 - 1, np.full((70, 2), 0.25), [[-1e5, 3.0]]))
    items = frame(spark, points, "xy", "item")
    tiles = nearby.tiled(items, "item", nearby.Kind((("x", "y"),)))
    assert len(tiles.counts) > 5 and tiles.counts.sum() == len(points) and tiles.counts.max() <= 130
    for k in (1, 7):
        got = found(nearby.nearest(frame(spark, asked, "xy"), "xy", tiles, k))
        for q, p in enumerate(asked):
            d2 = ((points - p) ** 2).sum(axis=1)
            want = np.lexsort((np.arange(len(points)), d2))[:k]
            assert [i for i, _ in got[q]] == want.tolist() and [d for _, d in got[q]] == pytest.approx(d2[want])
    more = found(nearby.nearest(frame(spark, asked[:3], "xy"), "xy", tiles, 1000))
    assert all(len(v) == len(points) for v in more.values())
    ends = np.concatenate((points[:200], points[:200] + draw.normal(0, 0.1, (200, 2))), axis=1)
    lines = nearby.tiled(frame(spark, ends, ("a0", "b0", "a1", "b1"), "item"), "item", nearby.Kind((("a0", "b0"), ("a1", "b1"))))
    got = found(nearby.nearest(frame(spark, asked, "xy"), "xy", lines))
    for q, p in enumerate(asked):
        a, e = ends[:, :2], ends[:, 2:] - ends[:, :2]
        s = np.clip(((p - a) * e).sum(axis=1) / (e * e).sum(axis=1), 0, 1)
        assert got[q][0][1] == pytest.approx(((a + s[:, None] * e - p) ** 2).sum(axis=1).min(), abs=1e-12)


def test_places_that_are_missing(spark, small):
    rows = spark.createDataFrame([(0, 0.0, None), (1, float("nan"), 0.0), (2, 0.0, 0.0)], "row long, x double, y double")
    items = spark.createDataFrame([(7, None, 1.0), (8, 1.0, float("nan")), (9, 3.0, 4.0)], "item long, x double, y double")
    assert found(nearby.nearest(rows, "xy", nearby.tiled(items, "item", nearby.Kind((("x", "y"),))), 5)) == {2: [(9, 25.0)]}
    none = nearby.tiled(items.where("item < 9"), "item", nearby.Kind((("x", "y"),)))
    assert nearby.nearest(rows, "xy", none).count() == 0


def _ball(n):
    """A closed mesh of a sphere, turned outwards, with faces of no area at the poles."""
    ring = [np.sin(np.pi * i / n) if 0 < i < n else 0.0 for i in range(n + 1)]
    at = lambda i, j: (ring[i] * np.cos(np.pi * (j % (2 * n)) / n), ring[i] * np.sin(np.pi * (j % (2 * n)) / n), np.cos(np.pi * i / n))
    return [(*at(i, j), *at(i + 1, j), *at(i + 1, j + 1)) for i in range(n) for j in range(2 * n)] + [(*at(i, j), *at(i + 1, j + 1), *at(i, j + 1)) for i in range(n) for j in range(2 * n)]


def _plain(p, faces):
    t = np.array(faces).reshape(-1, 3, 3)
    t = t[np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) > 1e-12]
    foot, _ = nearby.feet(np.repeat(p[None], len(t), axis=0), t)
    return np.linalg.norm(foot - p, axis=1), t


def test_mesh_in_tiles(spark, small):
    faces = _ball(8)
    columns = ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz")
    mesh = spark.createDataFrame([tuple(map(float, f)) for f in faces], columns)
    draw = np.random.default_rng(4)
    asked = np.concatenate((draw.uniform(-1.6, 1.6, (80, 3)), [f[:3] * np.float64(1.5) for f in np.array(faces)[:10]]))
    rows = frame(spark, asked, "xyz", "id").withColumn("distance", F.lit("replaced")).withColumn("a.b", F.lit(1))
    got = {r.id: r for r in M.with_mesh_distance(rows, mesh).collect()}
    assert len(got) == len(asked)
    for k, p in enumerate(asked):
        d, t = _plain(p, faces)
        n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
        # a convex body: inside are the points behind all faces
        inside = (((p - t[:, 0]) * n).sum(axis=1) < 0).all()
        assert got[k].distance == pytest.approx(-d.min() if inside else d.min(), abs=1e-9)
    beta = 30.0
    smooth = {r.id: r.distance for r in M.with_mesh_distance(rows, mesh, smooth=beta).collect()}
    for k, p in enumerate(asked):
        d, _ = _plain(p, faces)
        w = np.exp(-beta * (d**2 - d.min() ** 2))
        assert abs(smooth[k]) == pytest.approx((w * d).sum() / w.sum(), abs=1e-9) and (smooth[k] < 0) == (got[k].distance < 0)
    with pytest.raises(ValueError, match="no faces"):
        M.with_mesh_distance(rows, mesh.where("false"))
    gone = M.with_mesh_distance(spark.createDataFrame([(None, 1.0, 1.0)], "x double, y double, z double"), mesh).collect()
    assert len(gone) == 1 and gone[0].distance is None


def test_sides_at_a_sharp_edge(spark):
    """Near an edge of a flat wedge one face's normal alone would take the wrong side."""
    a, b, c, d = (0, 0, 0), (4, 0, 0), (4, 0.5, 0), (2, 0.25, 6)
    faces = [(*a, *c, *b), (*a, *b, *d), (*b, *c, *d), (*c, *a, *d)]
    mesh = spark.createDataFrame([tuple(map(float, f)) for f in faces], ", ".join(f"{n}{k} double" for k in range(3) for n in "xyz"))
    asked = [(-0.5, 0.1, 0.05), (-0.5, -0.2, -0.1), (4.2, 0.6, -0.1), (2.0, 0.2, 6.3), (2.0, 0.2, 1.0), (-1.0, 0.0, 0.0)]
    got = [r.distance for r in M.with_mesh_distance(spark.createDataFrame(asked, "x double, y double, z double"), mesh).orderBy("x", "y", "z").collect()]
    assert [x < 0 for x in got] == [p == (2.0, 0.2, 1.0) for p in sorted(asked)]
