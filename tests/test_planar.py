"""Planar meshes: borders that touch, evenness of draws, hostile rows."""

import math

import pytest
from pyspark.sql import functions as F

from axisfield.operators import nearby
from axisfield.sources import planar as P

SCHEMA = ", ".join(f"{c}{k} double" for k in range(3) for c in "xy")


def square(x, y, size=1.0, turn=False):
    a, b, c, d = (x, y), (x + size, y), (x + size, y + size), (x, y + size)
    out = [(*a, *b, *c), (*a, *c, *d)]
    return [(*t[:2], *t[4:], *t[2:4]) for t in out] if turn else out


def mesh(spark, *squares):
    return spark.createDataFrame([tuple(c if c is None else float(c) for c in t) for s in squares for t in s], SCHEMA)


def test_squares_that_touch_in_a_point_stay_apart(spark):
    edges = P.boundary_edges(mesh(spark, square(0, 0), square(1, 1, turn=True), square(-1, 1), square(5, 5)))
    assert edges.count() == 16
    rows = P.loops(edges).collect()
    rings = {}
    for r in rows:
        rings.setdefault(r.loop, []).append(r)
    assert sorted(map(len, rings.values())) == [4, 4, 4, 4]
    for ring in rings.values():
        ring.sort(key=lambda r: r.place)
        assert [r.place for r in ring] == [0, 1, 2, 3] and [r.before for r in ring] == [0.0, 1.0, 2.0, 3.0]
        assert all((a.x1, a.y1) == (b.x0, b.y0) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
        assert sum(r.x0 * r.y1 - r.x1 * r.y0 for r in ring) / 2 == 1.0


def test_long_border_and_inner_edges(spark):
    strip = mesh(spark, *(square(k, 0) for k in range(300)))
    assert P.interior_edges(strip).count() == 300 + 299
    rows = P.loops(P.boundary_edges(strip)).orderBy("place").collect()
    assert len(rows) == 602 and {r.loop for r in rows} == {rows[0].loop} and [r.place for r in rows] == list(range(602))
    assert [r.before for r in rows] == [float(k) for k in range(602)]


def test_rows_that_are_no_triangles(spark):
    odd = mesh(spark, square(0, 0), [(0.0, 0.0, 1.0, 1.0, 2.0, 2.0), (None, 0.0, 1.0, 0.0, 1.0, 1.0)]).withColumn("other", F.lit("x"))
    assert P.oriented(odd).agg(F.sum("area")).first()[0] == 1.0 and P.boundary_edges(odd).count() == 4
    open_ = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0, 1.0)], "x0 double, y0 double, x1 double, y1 double, length double")
    with pytest.raises(Exception, match="no closed border"):
        P.loops(open_)
    with pytest.raises(ValueError, match="add up to nothing"):
        P.interior_points(odd.where("false"), 5)


def test_draws_are_even_and_repeat(spark):
    rows = spark.createDataFrame([(k, float(k % 7) if k % 11 else None) for k in range(500)], "id long, v double")
    weights = {r.id: r.v or 0.0 for r in rows.collect()}
    whole = sum(weights.values())
    for n in (3, 500, 20_000):
        a, b = (sorted((r.id, r.draw) for r in P.spread(rows.repartition(k), "v", n, seed=2).collect()) for k in (2, 5))
        assert a == b and len(a) == n and sorted(d for _, d in a) == list(range(n))
        counts = {}
        for i, _ in a:
            counts[i] = counts.get(i, 0) + 1
        assert all(abs(counts.get(i, 0) - n * w / whole) < 1 + 1e-6 for i, w in weights.items())


def test_points_by_area_and_length(spark):
    faces = mesh(spark, square(0, 0), square(2, 0, 3.0, turn=True))
    inner = P.interior_points(faces, 4000, seed=3)
    row = inner.agg(F.count("w"), F.sum("w"), F.sum(F.col("w") * F.col("x"))).first()
    assert row[0] == 4000 and row[1] == pytest.approx(10.0) and row[2] == pytest.approx(0.5 + 9 * 3.5, rel=0.01)
    assert inner.where("not (x between 0 and 1 and y between 0 and 1 or x between 2 and 5 and y between 0 and 3)").count() == 0
    ring = P.boundary_points(P.boundary_edges(faces), 1600)
    flux = F.sum(F.col("w") * (F.col("x") * F.col("n_x") + F.col("y") * F.col("n_y")))
    row = ring.agg(F.count("w"), F.sum("w"), flux).first()
    assert row[0] == 1600 and row[1] == pytest.approx(16.0) and row[2] == pytest.approx(20.0, rel=0.01)


def test_distance_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(nearby, "TILE", 8)
    monkeypatch.setattr(nearby, "BLOCK", 20)
    edges = P.boundary_edges(mesh(spark, *(square(2 * k, 0) for k in range(12))))
    asked = spark.range(300).select(F.col("id"), (F.col("id") * 0.0871 - 1).alias("x"), (F.col("id") % 17 * 0.173 - 0.9).alias("y")).union(spark.sql("select -1L, cast(null as double), 1d"))
    for r in P.with_planar_distance(asked, edges).collect():
        if r.id < 0:
            assert r.distance is None
            continue
        d = []
        for k in range(12):
            dx, dy = abs(r.x - 2 * k - 0.5) - 0.5, abs(r.y - 0.5) - 0.5
            d.append(math.hypot(max(dx, 0), max(dy, 0)) + min(max(dx, dy), 0))
        assert r.distance == pytest.approx(min(d), abs=1e-9)
