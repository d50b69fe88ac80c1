"""Mesh readers, surface points, samplers, fits and enforced fields against closed forms."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from axisfield.functions.expressions import Label, exp
from axisfield.operators import enforced as E
from axisfield.operators import histories as H
from axisfield.operators import residuals as S
from axisfield.plans import fitting
from axisfield.sources import meshes as M
from axisfield.sources import samplers

CUBE = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
#: Faces of the unit cube as quads, turned outwards.
QUADS = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]


def test_obj_cube(spark, tmp_path):
    lines = [f"v {x} {y} {z}" for x, y, z in CUBE] + ["f " + " ".join(f"{i + 1}/1/1" for i in q) for q in QUADS]
    (tmp_path / "cube.obj").write_text("# a cube\n" + "\n".join(lines) + "\n")
    v, f = M.read_obj(spark, str(tmp_path / "cube.obj"))
    assert v.count() == 8 and f.count() == 12
    row = M.corners(f, v, ("mesh",)).agg(F.sum(M.area()), F.sum(M.volume_part())).first()
    assert row[0] == pytest.approx(6) and row[1] == pytest.approx(1)
    points = M.surface_points(M.corners(f, v, ("mesh",)), 600)
    assert points.agg(F.sum("w")).first()[0] == pytest.approx(6) and abs(points.count() - 600) < 30
    assert points.where("least(abs(x), abs(y), abs(z), abs(x - 1), abs(y - 1), abs(z - 1)) > 1e-12").count() == 0


def test_binary_stl(spark, tmp_path):
    faces = [(CUBE[q[0]], CUBE[q[i]], CUBE[q[i + 1]]) for q in QUADS for i in (1, 2)]
    body = b"".join(struct.pack("<12fH", 0, 0, 0, *(c for p in f for c in p), 0) for f in faces)
    (tmp_path / "cube.stl").write_bytes(bytes(80) + struct.pack("<I", len(faces)) + body)
    row = M.read_stl(spark, str(tmp_path / "cube.stl")).agg(F.count("fid"), F.sum(M.area()), F.sum(M.volume_part())).first()
    assert row[0] == 12 and row[1] == pytest.approx(6) and row[2] == pytest.approx(1)


def test_samplers(spark):
    for name in samplers.SAMPLERS:
        area = samplers.sampled(spark, name, 4000, ["x", "y"], [-1.0, -1.0], [1.0, 1.0], F.expr("x * x + y * y <= 1"), 4.0).agg(F.sum("w")).first()[0]
        assert area == pytest.approx(math.pi, abs=0.1)
    latin = samplers.latin_hypercube(spark, 100, ["x", "y"], [0.0, 0.0], [1.0, 1.0], seed=5)
    assert [latin.select(F.floor(F.col(c) * 100)).distinct().count() for c in "xy"] == [100, 100]
    drawn = samplers.rows_with_replacement(spark.range(1000), 3000, seed=1)
    assert abs(drawn.count() - 3000) < 300 and drawn.where("draw > 1").count() > 0


def test_fits(spark):
    rows = spark.range(50).select((F.col("id") / 25.0 - 1).alias("x")).withColumn("y", 2.0 * F.exp(-0.5 * F.col("x")))
    a, b, x, y = (Label(n) for n in "abxy")
    found = fitting.gauss_newton(rows, [a * exp(b * x) - y], {"a": 1.0, "b": 0.0})
    assert found["a"] == pytest.approx(2, abs=1e-6) and found["b"] == pytest.approx(-0.5, abs=1e-6)
    slow = fitting.descend(rows, [a * exp(b * x) - y], {"a": 1.0, "b": 0.0}, steps=5)
    loss = lambda p: fitting.gradient_step(rows, [a * exp(b * x) - y], list(p), list(p.values()))[0]
    assert loss(slow) < loss({"a": 1.0, "b": 0.0})


def test_enforced_targets_hold(spark):
    x, y, t = (Label(n) for n in "xyt")
    angle = F.col("id") / 7.0
    ring = spark.range(20).select(F.cos(angle).alias("x"), F.sin(angle).alias("y"), F.lit(0.0).alias("t"))
    u, phi, n = exp(x) * y + t, 1.0 - x**2 - y**2, [x, y]
    assert S.loss(ring, S.dirichlet(E.dirichlet(u, phi, x * y), x * y)).first()[0] < 1e-20
    assert S.loss(ring, S.neumann(E.neumann(u, phi, n, "xy", 2.0), n, "xy", 2.0)).first()[0] < 1e-18
    assert S.loss(ring, S.robin(E.robin(u, phi, n, "xy", 1.0, 2.0, 3.0), n, "xy", 1.0, 2.0, 3.0)).first()[0] < 1e-18
    started = E.initial(u, {0: x, 1: y}, 1.0, gate="poly")
    assert S.loss(ring, S.initial(started, x)).first()[0] < 1e-20 and S.loss(ring, S.initial(started, y, order=1)).first()[0] < 1e-20
    with pytest.raises(ValueError, match="all orders"):
        E.initial(u, {1: y}, 1.0)


def test_track_ends_and_unknown_series(spark):
    seen = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0), ("b", 1.0, 3.0)], "s string, t double, y double")
    asked = spark.createDataFrame([("a", -1.0), ("a", 1.0), ("a", 2.0), ("a", 5.0), ("b", 0.0), ("c", 1.0)], "s string, t double")
    got = {(r.s, r.t): r.tracked for r in H.track(seen, asked, ["s"], "t", "y").collect()}
    assert got == {("a", -1.0): 0.0, ("a", 1.0): 2.0, ("a", 2.0): 4.0, ("a", 5.0): 4.0, ("b", 0.0): 3.0, ("c", 1.0): None}


def test_sequences_have_all_digits_and_columns(spark):
    from axisfield.sources import grids as G

    far = spark.range(2**24 + 5, 2**24 + 6).select(G.halton(F.col("id"), 2).alias("h")).first().h
    assert far == 0.625 + 2**-25
    assert len(G.halton_points(spark, 5, [f"c{k}" for k in range(20)], [0.0] * 20, [1.0] * 20).columns) == 21
    # the first 2^k points of the sequence fill each column's 2^k cells
    for seed in (None, 3):
        points = samplers.sobol_points(spark, 64, [f"c{k}" for k in range(10)], [0.0] * 10, [1.0] * 10, seed)
        assert all(points.select(F.floor(F.col(f"c{k}") * 64)).distinct().count() == 64 for k in range(10))


def test_draws_are_exact_and_repeat(spark):
    rows = spark.range(777).withColumn("v", F.col("id") * 2)
    a, b = (sorted(tuple(r) for r in samplers.draws(rows.repartition(n), 500, "id", seed=4).collect()) for n in (3, 7))
    assert a == b and len(a) == 500 and all(v == 2 * i for _, i, v in a)
    a, b = (sorted(tuple(r) for r in samplers.rows_with_replacement(rows.repartition(n), 500, seed=4).collect()) for n in (3, 7))
    assert a == b


def test_repeated_rows_stay_apart(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 1.0)], "id long, t double")
    out = H.time_convolution(rows, "t", lambda d: F.lit(1.0), lambda s: F.lit(1.0))
    assert [r.convolution for r in out.collect()] == [pytest.approx(1.0)] * 2
    filtered = H.causal_filter(spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("a", 3, 5.0)], "s string, k long, v double"), ["s"], "k", "v", [1.0, 0.5, 0.25, 0.125])
    assert sorted((r.k, r.filtered) for r in filtered.collect()) == [(0, 3.0), (0, 3.0), (3, 5.0 + 3 * 0.125)]


def test_sampled_differences_come_near_the_sum(spark):
    rows = spark.createDataFrame([(0.3,)], "x double")
    value = lambda x: F.exp(-x * x)
    exact = H.fractional_derivative(rows, "x", value, 0.6, 0.1, 512).first().derivative
    drawn = H.sampled_fractional_derivative(rows, "x", value, 0.6, 0.1, 20_000, seed=1).first().derivative
    assert drawn == pytest.approx(exact, abs=0.05)
    both = H.riesz_derivative(rows, ["x"], lambda c: value(c["x"]), 1.4, 0.1, 512).first().derivative
    assert H.sampled_riesz_derivative(rows, ["x"], lambda c: value(c["x"]), 1.4, 0.1, 20_000, seed=1).first().derivative == pytest.approx(both, abs=0.5)


def test_nearest_anchors(spark):
    import random

    from axisfield.operators import nonlocal_ops as N

    draw = random.Random(5)
    anchors = [(draw.random(), draw.random(), float(k)) for k in range(60)] + [(0.5, 0.5, 100.0), (0.5, 0.5, 101.0)]
    asked = [(k, draw.random() * 3 - 1, draw.random()) for k in range(20)] + [(20, 0.5, 0.5), (21, 50.0, -40.0)]
    a = spark.createDataFrame(anchors, "x double, y double, v double")
    q = spark.createDataFrame(asked, "id long, x double, y double")
    got = {}
    for r in N.nearest(q, a, "id", ["x", "y"], 3).collect():
        got.setdefault(r.id, {})[r.place] = tuple(r.anchor)
    for i, x, y in asked:
        want = sorted(anchors, key=lambda p: ((x - p[0]) ** 2 + (y - p[1]) ** 2, p))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == want
    named = a.select(F.col("x").alias("ax"), F.col("y").alias("ay"), "v")
    pairs = [("x", "ax"), ("y", "ay")]
    few = {r.id: r.idw for r in N.inverse_distance(q, named, pairs, "v").collect()}
    for i, x, y in asked[:20]:
        w = [((x - p[0]) ** 2 + (y - p[1]) ** 2) ** -1 for p in anchors]
        assert few[i] == pytest.approx(sum(k * p[2] for k, p in zip(w, anchors, strict=True)) / sum(w))
    assert few[20] == 100.0


def test_inverse_distances_are_the_same_in_blocks(spark, monkeypatch):
    from axisfield.operators import nonlocal_ops as N

    q = spark.createDataFrame([(0, 0.5, "a"), (1, 0.0, "b"), (1, 0.0, "b"), (2, None, "c"), (3, 7.0, None)], "id long, x double, `a.b` string")
    rows = [(0.0, 1.0), (1.0, None), (2.0, 3.0), (None, 9.0), (0.0, 0.5), (5.0, float("nan")), (9.0, -1.0)]
    for anchors in (rows, rows[3:4], []):
        a = spark.createDataFrame(anchors, "at double, v double")
        seen = []
        for size in (50_000, 2):
            monkeypatch.setattr(N, "PACKED", size)
            out = N.inverse_distance(q, a, [("x", "at")], "v")
            assert out.columns == ["id", "x", "a.b", "idw"]
            seen.append(sorted((tuple(r) for r in out.collect()), key=str))
        assert seen[0] == [(*r[:3], None if r[3] is None else pytest.approx(r[3])) for r in seen[1]]
        known = {r[0]: r[3] for r in seen[0]}
        good = [(x, v) for x, v in anchors if x is not None and v is not None and v == v]
        assert known[2] is None
        if good:
            w = [(0.5 - x) ** -2 for x, _ in good]
            assert known[1] == 0.5 and known[0] == pytest.approx(sum(k * v for k, (_, v) in zip(w, good, strict=True)) / sum(w))
        else:
            assert set(known.values()) == {None}


def test_permutations_are_exact(spark):
    for n in (1, 2, 3, 7, 1000, 65_537):
        got = spark.range(n).select("id", samplers.permuted(F.col("id"), n, 5).alias("p")).agg(F.countDistinct("p"), F.min("p"), F.max("p"), F.corr("id", "p")).first()
        assert tuple(got[:3]) == (n, 0, n - 1) and (n < 1000 or abs(got[3]) < 0.15)


def test_draws_of_terms_reach_all_of_them():
    for order in (0.2, 0.6, 1.4, 1.0):
        drawn = H.sampled_indices(order, 200_000, table=64, seed=2)
        assert sum(abs(e["c"]) for e in drawn) == pytest.approx(1.0 if order <= 1 else 2 * order - 1)
        # what lies behind a term far beyond the table, against the exact weights
        weights = H.difference_weights(order, 3001)
        for k in (20, 200, 3000):
            assert sum(e["c"] for e in drawn if e["k"] > k) == pytest.approx(-sum(weights[: k + 1]), abs=0.004)


def test_negative_obj_indices(spark, tmp_path):
    (tmp_path / "n.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf -3 -2 -1\nv 1 1 0\nf -3 -1 -2\n")
    v, f = M.read_obj(spark, str(tmp_path / "n.obj"))
    assert [(r.i, r.j, r.k) for r in f.orderBy("fid").collect()] == [(1, 2, 3), (2, 4, 3)]
    assert M.corners(f, v, ("mesh",)).agg(F.sum(M.area())).first()[0] == pytest.approx(1.0)
