"""Parts of a turn against drawn points, and separable samples against the full product."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisfield.sources import components as D
from axisfield.sources import shapes as S
from axisfield.sources.separable import separable

SWEEPS = [
    S.Sweep(S.cylinder([1.0, 2.0, 3.0], 2.0, 1.0), math.pi / 3), S.Sweep(S.Cone([0.0, 0.0, 0.0], 2.0, 1.5, 0.0), 1.6 * math.pi), S.Sweep(S.Cone([0.0, 1.0, 0.0], 2.0, 0.5, 1.0), math.pi),
    S.Sweep(S.Torus([0.0, 0.0, 1.0], 2.0, 0.5), 1.75 * math.pi), S.Sweep(S.Torus([0.0, 0.0, 0.0], 1.0, 1.0), 0.5),
]


@pytest.mark.parametrize("shape", SWEEPS)
def test_sweeps(spark, shape):
    edge = shape.boundary(spark, 6000, seed=3).withColumn("sdf", shape.sdf()).toPandas()
    assert edge.i.is_unique and edge.sdf.abs().max() < 1e-9
    assert edge.w.sum() == pytest.approx(shape.boundary_measure, rel=1e-9 if isinstance(shape.solid, S.Cone) else 0.01)
    normals = edge[["n_x", "n_y", "n_z"]].to_numpy()
    assert np.allclose(np.linalg.norm(normals, axis=1), 1)
    # the flux of the position is the volume three times, that of a constant none
    at = edge[["x", "y", "z"]].to_numpy()
    assert (edge.w.to_numpy() * (at * normals).sum(1)).sum() / 3 == pytest.approx(shape.measure, rel=0.02)
    assert np.abs((edge.w.to_numpy()[:, None] * normals).sum(0)).max() < 0.02 * shape.boundary_measure
    inner = shape.interior(spark, 3000).withColumn("sdf", shape.sdf()).toPandas()
    assert inner.sdf.max() < 1e-9 and inner.w.sum() == pytest.approx(shape.measure, rel=0.02)
    # distances to the nearest of many boundary points, and the sign by the definition
    rng = np.random.default_rng(5)
    low, high = (np.array(b, float) for b in shape.box)
    some = rng.uniform(low - 0.5, high + 0.5, (300, 3))
    rows = spark.createDataFrame([tuple(map(float, p)) for p in some], "x double, y double, z double").select("x", "y", "z", shape.sdf().alias("d"), shape.solid.sdf().alias("full")).toPandas()
    near = np.sqrt(((rows[["x", "y", "z"]].to_numpy()[:, None] - at[None]) ** 2).sum(-1)).min(1)
    assert (near >= rows.d.abs() - 1e-9).all() and (near - rows.d.abs()).max() < 0.2
    center = shape._center
    inside = (rows.full <= 0) & (np.mod(np.arctan2(rows.y - center[1], rows.x - center[0]), 2 * np.pi) <= shape.angle)
    assert ((rows.d <= 0) == inside).all()


def test_parts_of_a_turn_are_checked():
    for solid, angle in ((S.cylinder([0, 0, 0], 1, 1), 0.0), (S.cylinder([0, 0, 0], 1, 1), 7.0), (S.Torus([0, 0, 0], 1.0, 1.5), 1.0)):
        with pytest.raises(ValueError):
            S.Sweep(solid, angle)


def test_swept_factor_is_relabelled(spark):
    domain = D.Domain((D.ShapeFactor(SWEEPS[0]),)).relabel("x", "a")
    assert domain.factors[0].labels == ("a", "y", "z")
    assert domain.component().points(spark, 100).agg(F.sum("w")).first()[0] == pytest.approx(SWEEPS[0].measure, rel=0.1)


def _disk(rows=None):
    factors = (D.ShapeFactor(S.circle([0.0, 0.0], 1.0)), D.TimeInterval(0.0, 2.0))
    return D.Domain(factors if rows is None else (*factors, D.DatasetFactor(rows, "k", "count")))


def test_axes_weights_and_mask(spark):
    laid = separable(_disk().component(), spark, {"x": ("legendre", 12), "y": 16, "t": ("legendre", 4)})
    points = laid.points()
    assert points.count() == 12 * 16 * 4 and points.where("mask != (sqrt(x * x + y * y) - 1 < -1e-6)").count() == 0
    # drawn nodes share the box's length evenly, a rule has its own weights; all weights make up the box
    assert points.agg(F.sum("w")).first()[0] == pytest.approx(2 * 2 * 2)
    assert points.select("y").distinct().count() == 16
    total = laid.total_weight().first()[0]
    assert total == pytest.approx(points.where("mask").agg(F.sum("w")).first()[0]) and total == pytest.approx(2 * math.pi, rel=0.15)
    # an integral along a rule's axis is exact
    line = separable(D.Domain((D.TimeInterval(-1.0, 2.0),)).component(), spark, {"t": ("legendre", 6)})
    assert line.integrals({"v": F.col("t") * F.col("t")}).first()[0] == pytest.approx(3.0, abs=1e-9)


def test_rows_beside_axes(spark):
    rows = spark.createDataFrame([(k, float(k % 3), None if k == 4 else 1.0) for k in range(9)], "k long, a double, b double")
    component = _disk(rows).component(where={"x": F.col("x") > 0, "k": F.col("b") > 0}, where_all=F.col("t") > F.col("a"), weight_all=1 + F.col("a"))
    axes = {"x": ("sine", 8), "y": ("sine", 8), "t": ("sine", 4)}
    laid = separable(component, spark, axes).on("x", {"sx": F.sin("x")}).on("a", {"twice": 2 * F.col("a")})
    f = {"v": F.col("sx") * F.col("t") + F.col("twice")}
    got = {r.a: (r.v, r.one) for r in laid.integrals({**f, "one": F.lit(1.0)}, ["a"]).collect()}
    want = {}
    grid = -1 + (np.arange(8) + 0.5) / 4
    for k in range(9):
        if k == 4:
            continue
        a = float(k % 3)
        for x in grid:
            for y in grid:
                for t in (np.arange(4) + 0.5) / 2:
                    if x > 0 and math.hypot(x, y) < 1 and t > a:
                        v, one = want.get(a, (0.0, 0.0))
                        w = 0.25 * 0.25 * 0.5 * (1 + a)
                        want[a] = (v + w * (math.sin(x) * t + 2 * a), one + w)
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a]) for a in want)
    assert laid.total_weight().first()[0] == pytest.approx(sum(one for _, one in want.values()))
    # the same rows by the mask
    assert laid.points().where("mask").count() == laid._within().count()
    # no rows, and none inside
    none = separable(_disk(rows.limit(0)).component(), spark, axes)
    assert none.integrals({"v": F.lit(1.0)}).first()[0] == 0.0 and none.total_weight().first()[0] == 0.0


def test_fields_of_an_axis_are_evaluated_below_the_product(spark):
    laid = separable(_disk().component(), spark, {"x": ("sine", 8), "y": ("sine", 8), "t": ("sine", 4)}).on("t", {"fading": F.exp(-F.col("t"))})
    plan = laid.integrals({"v": F.col("fading")})._jdf.queryExecution().optimizedPlan().toString()
    at = {k: next(line for line in plan.splitlines() if k in line) for k in ("EXP(", "Join")}
    deep = lambda line: len(line) - len(line.lstrip(" :+-|"))
    assert deep(at["EXP("]) > deep(at["Join"])


def test_what_cannot_be_laid_out(spark):
    rows = spark.createDataFrame([(1, 2.0)], "k long, a double")
    domain = _disk(rows)
    for parts, axes, n in (({}, {"x": 4}, 4), ({}, {"a": 4}, 4), ({"t": D.Boundary()}, {"t": 4}, 4), ({}, {"q": 4}, 4), ({}, {"t": 4}, 0), ({}, {"t": 0}, 4)):
        with pytest.raises(ValueError):
            separable(domain.component(parts), spark, axes, n)
    # fixed and boundary parts stand beside axes
    ends = separable(domain.component({"t": D.FixedEnd()}), spark, {"x": ("sine", 8), "y": ("sine", 8)})
    assert ends.points().select("t").distinct().collect() == [(2.0,)]
    both = separable(domain.component({"t": D.Boundary()}), spark, {"x": ("sine", 8), "y": ("sine", 8)})
    assert both.total_weight().first()[0] == pytest.approx(2 * ends.total_weight().first()[0])
