"""Weights and blends of boundary pieces: values, derivatives, and missing pieces; latent contractions against the pointwise form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisfield.functions import networks as L
from axisfield.functions.expressions import Label, cos, exp, sin
from axisfield.operators import enforced as E
from axisfield.operators import latent, pieces
from axisfield.sources import meshes as M

X, Y = Label("x"), Label("y")


def ring(spark, n=40, low=0.0, high=2 * math.pi):
    a = low + (high - low) * F.col("id") / n
    return spark.range(n).select(F.cos(a).alias("x"), F.sin(a).alias("y"), (3.0 * F.cos(a)).alias("n_x"), (3.0 * F.sin(a)).alias("n_y"))


def plain_weight(p, points, normals, width, k):
    away = p - points
    d2 = (away**2).sum(axis=1)
    near = np.argsort(d2, kind="stable")[:k]
    away, d2, n = away[near], d2[near], normals[near]
    along = (away * n).sum(axis=1)
    w = np.exp(-(d2 - d2.min()) / (width**2 + 1e-12)) * (0.5 + 0.5 / (1 + 0.25 * (1 - np.clip(along / np.sqrt(d2 + 1e-12), -1, 1)) ** 2))
    f = (w * along).sum() / w.sum()
    return (abs(2 * width * (np.logaddexp(0, f / width) - math.log(2))) + 1e-16) ** -2


def test_mesh_normals_weigh_a_side(spark):
    """Points of a box mesh's right half, as in a weight of a part of its surface."""
    cube = [(x, y, z) for x in (-0.5, 0.5) for y in (-0.5, 0.5) for z in (-0.5, 0.5)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    rows = [tuple(c for corner in (q[0], q[i], q[i + 1]) for c in cube[corner]) for q in quads for i in (1, 2)]
    faces = spark.createDataFrame(rows, ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz")).withColumn("fid", F.monotonically_increasing_id())
    n = M.normal()
    sides = faces.select("fid", *(c.alias(f"n_{a}") for c, a in zip(n, "xyz", strict=True)))
    spots = M.surface_points(faces, 2000).join(sides, "fid").where("x > 0").select("x", "y", "z", "n_x", "n_y", "n_z")
    asked = spark.createDataFrame([(0.6, 0.0, 0.0), (-0.6, 0.0, 0.0), (0.0, 0.6, 0.0), (0.0, 0.0, -0.6), (0.2, 0.3, 0.4)], "x double, y double, z double")
    width = 0.02 * math.sqrt(3)
    out, (w,) = pieces.piece_weights(asked, [spots], ["x", "y", "z"], width, k=32)
    p = np.array([tuple(r) for r in spots.select("x", "y", "z", "n_x", "n_y", "n_z").collect()])
    unit = p[:, 3:] / np.linalg.norm(p[:, 3:], axis=1, keepdims=True)
    for r in out.withColumn("w", w.column()).collect():
        assert math.isfinite(r.w) and r.w == pytest.approx(plain_weight(np.array([r.x, r.y, r.z]), p[:, :3], unit, width, 32), rel=1e-6)


def test_derivatives_of_a_blend(spark):
    """The quotient rule against differences, first and second order."""
    u, width, h = sin(X) + Y**2, 0.4, 1e-4
    fields = [E.dirichlet(u, X**2 + Y**2 - 1.0, X), E.dirichlet(u, X**2 + Y**2 - 1.0, Y)]
    parts = [ring(spark, 25, 0.0, 2.0), ring(spark, 25, 3.0, 5.0)]
    spots = [(0.7, 0.2), (-0.3, 0.9), (1.4, -0.8), (-1.1, -0.2)]
    around = [(k, i, j, x + i * h, y + j * h) for k, (x, y) in enumerate(spots) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    rows = spark.createDataFrame(around, "k long, i long, j long, x double, y double")
    out, f = pieces.blended(rows, fields, parts, ["x", "y"], width, rest=(u, ring(spark, 9, 5.2, 6.1)), k=100, order=2)
    got = {(r.k, r.i, r.j): r for r in out.select("k", "i", "j", f.column().alias("f"), f.diff("x").column().alias("fx"), f.diff("y").diff("x").column().alias("fxy"), f.diff("y").diff("y").column().alias("fyy")).collect()}
    for k in range(len(spots)):
        at = lambda i, j: got[k, i, j].f  # noqa: B023, E731
        assert got[k, 0, 0].fx == pytest.approx((at(1, 0) - at(-1, 0)) / (2 * h), rel=1e-4, abs=1e-5)
        assert got[k, 0, 0].fxy == pytest.approx((at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * h * h), rel=1e-3, abs=1e-3)
        assert got[k, 0, 0].fyy == pytest.approx((at(0, 1) - 2 * at(0, 0) + at(0, -1)) / (h * h), rel=1e-3, abs=1e-3)
    with pytest.raises(ValueError, match="known up to order 2"):
        f.diff("x").diff("x").diff("x")


def test_pieces_keep_their_targets(spark):
    u = X + Y
    fields = [E.dirichlet(u, X**2 + Y**2 - 1.0, 5.0), E.dirichlet(u, X**2 + Y**2 - 1.0, -7.0)]
    parts = [ring(spark, 30, 0.0, 1.5), ring(spark, 30, 3.0, 4.5)]
    rows = parts[0].select("x", "y", F.lit(5.0).alias("want")).union(parts[1].select("x", "y", F.lit(-7.0)))
    out, f = pieces.blended(rows.union(spark.sql("select null, 1d, null")), fields, parts, ["x", "y"], 0.005)
    for r in out.withColumn("f", f.column()).collect():
        assert (r.x is None and r.f is None) or r.f == pytest.approx(r.want, abs=1e-9)
    # a piece without points has no say, and fields alone are left where there are none at all
    out, f = pieces.blended(rows, fields, [parts[0], parts[1].where("false")], ["x", "y"], 0.005)
    assert all(r.f == pytest.approx(5.0) for r in out.withColumn("f", f.column()).collect())


def _axes(spark):
    return {"a": spark.range(50).select((F.col("id") / 50.0).alias("x"), F.col("id").alias("i"), F.lit(0.02).alias("w")), "b": spark.range(30).select((F.col("id") / 30.0).alias("y"), F.lit(1 / 30).alias("w")).withColumnRenamed("w", "wb")}


def test_contractions_are_the_pointwise_form(spark):
    net = L.dense("g", ["y"], out=6, hidden=(4,), seed=2)
    model = latent.Contraction.of({"a": [sin(X), X**2, exp(X)], "b": net}, 3, 2)
    axes = _axes(spark)
    for m, n in ((model, "u"), (model.diff("x"), "ux"), (model.diff("y"), "uy"), (model.diff("z"), "uz")):
        u, v = m.pointwise()
        out = m.on_grid(axes, ["p", "q"])
        assert out.count() == 1500
        assert out.agg(F.max(F.abs(F.col("p") - u.column()) + F.abs(F.col("q") - v.column()))).first()[0] < 1e-12, n
    rows = spark.range(200).select((F.col("id") % 7 / 7.0).alias("x"), (F.col("id") % 5 / 5.0).alias("y"), F.lit(1).alias("a.b")).union(spark.sql("select null, 0.5d, 2"))
    out = model.on_points(rows, ["p", "q"])
    u, v = model.pointwise()
    assert out.columns == ["x", "y", "a.b", "p", "q"] and out.count() == 201 and out.where("p is null").count() == 1
    assert out.agg(F.max(F.abs(F.col("p") - u.column()))).first()[0] < 1e-12
    plan = model.on_grid(axes, ["p", "q"])._jdf.queryExecution().optimizedPlan().toString()
    # the functions of each factor are below the join that makes the grid
    above, below = plan[: plan.index("Join")], plan[plan.index("Join") :]
    assert "sin(" in below.lower() and "tanh(" in below.lower() and "sin(" not in above.lower() and "tanh(" not in above.lower()


def test_policies(spark):
    shared = {"a": [sin(X)], "b": [cos(X) * Y]}
    rows = spark.createDataFrame([(0.3, 0.5)], "x double, y double")
    want = math.sin(0.3) * math.cos(0.3) * 0.5
    for layout, fallback in (("auto", "warn"), ("points", "error"), ("axes", "silent")):
        assert latent.Contraction.of(shared, 1, policy=latent.Policy(layout, fallback)).on_points(rows, ["u"]).first().u == pytest.approx(want)
    with pytest.warns(UserWarning, match="share the labels"):
        latent.Contraction.of(shared, 1, policy=latent.Policy("axes", "warn")).on_points(rows, ["u"])
    with pytest.raises(ValueError, match="share the labels"):
        latent.Contraction.of(shared, 1, policy=latent.Policy("axes", "error")).on_points(rows, ["u"])
    with pytest.raises(ValueError, match="has 2 numbers"):
        latent.Contraction.of({"a": [X, Y]}, 3)
    with pytest.raises(ValueError, match="layout"):
        latent.Policy("dense")
    with pytest.raises(ValueError, match="share the label"):
        latent.Contraction.of(shared, 1).diff("x")


def test_integrals_without_a_grid(spark):
    model, axes = latent.Contraction.of({"a": [X, X**2], "b": [Y, exp(Y)]}, 2), _axes(spark)
    axes["b"] = axes["b"].withColumnRenamed("wb", "w")
    got = model.integrals(axes, ["u"], masks={"a": F.col("x") >= 0.5}).first()
    x, y = np.arange(50) / 50, np.arange(30) / 30
    grid = (x[:, None] * y[None] + x[:, None] ** 2 * np.exp(y[None]))[x >= 0.5]
    assert got.u == pytest.approx(grid.sum() * 0.02 / 30) and got.total_weight == pytest.approx(0.5)
    assert model.integrals({k: v.where("false") for k, v in axes.items()}, ["u"]).first().u == 0.0


def test_sensor_tracks_are_met(spark):
    """Linear and constant tracks, values at sensors and times, rows and sensors that are missing."""
    sensors = spark.createDataFrame([("a", 0.2), ("b", 0.7), ("gone", None), ("mute", 0.5)], "sensor string, x double")
    seen = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 2.0), ("b", 0.5, 3.0), ("gone", 0.0, 9.0)], "sensor string, t double, value double")
    u, gate = X * 0.0 + 1.0, X * (1.0 - X)
    rows = spark.createDataFrame([(0.2, 0.25, "s"), (0.2, 1.0, "s"), (0.7, 9.0, "s"), (0.0, 0.3, "edge"), (1.0, 0.3, "edge"), (0.4, None, "no"), (None, 0.1, "no"), (0.4, 0.5, "in")], "x double, t double, `k.k` string")
    got = {(r.x, r.t): r.u for r in E.sensor_tracks(rows, sensors, seen, u, gate, ["x"]).collect()}
    assert got[0.2, 0.25] == pytest.approx(0.5) and got[0.2, 1.0] == pytest.approx(2.0) and got[0.7, 9.0] == pytest.approx(3.0)
    assert got[0.0, 0.3] == got[1.0, 0.3] == got[0.4, None] == got[None, 0.1] == 1.0
    w = (0.2**-2, 0.3**-2)
    assert got[0.4, 0.5] == pytest.approx(1 + 0.24 * (w[0] * 0.0 / 0.16 + w[1] * 2.0 / 0.21) / sum(w))
    near = {(r.x, r.t): r.u for r in E.sensor_tracks(rows, sensors, seen, u, gate, ["x"], envelope=0.01).collect()}
    assert near[0.7, 9.0] == pytest.approx(3.0) and near[0.4, 0.5] == pytest.approx(1.0, abs=1e-6)
