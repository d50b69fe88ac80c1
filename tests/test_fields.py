"""Learned fields, minimisers, components and contractions beyond what the queries hold against SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisfield.functions import networks as L
from axisfield.functions.expressions import Label, cos, lift, sin
from axisfield.operators import calculus as C
from axisfield.plans import fitting
from axisfield.sources import balls
from axisfield.sources import components as D
from axisfield.sources import shapes as S

X, Y = Label("x"), Label("y")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(40).select((F.col("id") / 20.0 - 1).alias("x"), F.sin(F.col("id") / 7.0).alias("y")).cache()


@pytest.mark.parametrize("make", [
    lambda: L.dense("n", ["x", "y"], hidden=(3, 3), skip=True), lambda: L.edge_network("n", ["x", "y"], hidden=(2,), degree=[2, 3], family="legendre"), lambda: L.path_network("n", ["x", "y"], width=2, count=2),
    lambda: L.separable("n", ["x", "y"], rank=2), lambda: L.branch_and_trunk("n", ["y"], ["x"], latent=2, hidden=(2,))])
def test_slopes_are_those_of_differences(rows, make):
    net = make()
    loss = (Label(net.outputs[0]) - Y * 2.0) ** 2
    value, slope = net.value_and_slope(rows, loss)
    assert len(slope) == len(net.start)
    for name in list(net.start)[:: max(1, len(net.start) // 4)]:
        up, down = (net.bound({name: net.start[name] + h}).value_and_slope(rows, loss)[0] for h in (1e-5, -1e-5))
        assert slope[name] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    # the network written out as one expression is the same field
    written = rows.select(F.avg(((net.expression()[0] - Y * 2.0) ** 2).column())).first()[0]
    assert written == pytest.approx(value)


def test_a_network_learns(rows):
    net = L.dense("n", ["x"], hidden=(4,), seed=1)
    f, start = fitting.network_objective(rows, net, (Label(net.outputs[0]) - sin(2.0 * X)) ** 2)
    _, values = fitting.quasi_newton(f, start, 25)
    assert values[-1] < 0.05 * values[0]


@pytest.mark.parametrize("method", ["bfgs", "lbfgs", "ssbroyden"])
def test_minimisers_on_a_curved_valley(method):
    def valley(v):
        a, b = v
        return 100 * (b - a * a) ** 2 + (1 - a) ** 2, np.array([-400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)])

    found, values = fitting.quasi_newton(valley, np.array([-1.2, 1.0]), 120, method)
    assert found == pytest.approx([1, 1], abs=1e-3) and values == sorted(values, reverse=True)


def test_descents_keep_the_best(rows):
    bowl = lambda v: (float(v @ v), 2 * v)
    for run in (fitting.sign_descent, fitting.moment_descent):
        found, _ = run(bowl, np.array([1.0, -2.0]), 300, 0.05)
        assert np.abs(found).max() < 0.05
    a = Label("a")
    solver = fitting.Solver({"u": a * X}, {"data": (rows, lambda f: [f["u"] - 3.0 * X], 1.0)}, {"a": 0.0}, rewrites={"u": lambda f: f["u"] + X})
    assert solver.solve(5)["a"] == pytest.approx(2.0, abs=1e-5) and solver.loss({"a": 2.0}) < 1e-18


def test_schedules_and_penalties():
    assert L.degree_schedule(3, 2, 6) == [2, 4, 6] and L.degree_schedule(3, 2, 8, "geometric") == [2, 4, 8] and L.degree_schedule(1, 3, 9) == [3]
    assert L.high_order_penalty([[9.0, 9.0, 1.0, 2.0]], alpha=1.0) == 4 * 1 + 9 * 4
    with pytest.raises(ValueError, match="family"):
        L.polynomials(X, 3, "none")


def test_contractions(rows):
    m = [[X, lift(2.0)], [lift(3.0), Y]]
    row = rows.limit(1).select(C.einsum("ij,ij->", m, m).column().alias("a"), C.einsum("...i,i->...", m, [Y, X])[1].column().alias("b"), "x", "y").first()
    assert row.a == pytest.approx(row.x**2 + 13 + row.y**2) and row.b == pytest.approx(3 * row.y + row.y * row.x)
    with pytest.raises(ValueError, match="size"):
        C.einsum("i,i", [X, Y], [X, Y, X])


@pytest.mark.parametrize(("dim", "design"), [(1, "fibonacci"), (2, "fibonacci"), (3, "fibonacci"), (2, "grid"), (3, "grid"), (3, "octa6"), (3, "ico12"), (2, "axis4"), (2, "random_qmc"), (3, "random_qmc")])
def test_ball_rules(dim, design):
    rule = balls.ball_rule(0.5, dim, 2000, design)
    volume = {1: 1.0, 2: math.pi / 4, 3: math.pi / 6}[dim]
    assert sum(e["w"] for e in rule) == pytest.approx(volume) and len({e["w"] for e in rule}) == 1
    assert all(sum(e[f"xi{k}"] ** 2 for k in range(dim)) <= 0.25 + 1e-12 for e in rule)
    mean = sum(e["w"] * sum(e[f"xi{k}"] ** 2 for k in range(dim)) for e in rule) / volume
    assert mean == pytest.approx(dim / (dim + 2) * 0.25, rel=0.05)


def test_components_refuse_what_has_no_meaning(spark):
    disk = D.Domain((D.ShapeFactor(S.circle([0.0, 0.0], 1.0)), D.TimeInterval(0.0, 1.0)))
    with pytest.raises(ValueError, match="fixed"):
        disk.component({"x": D.Fixed(0.0)}).measure()
    with pytest.raises(ValueError, match="normals"):
        disk.component().normals("x")
    with pytest.raises(ValueError, match="fixed value"):
        disk.component({"t": D.Fixed(2.0)}).points(spark, 4)
    with pytest.raises(ValueError, match="share"):
        D.Domain((D.TimeInterval(0.0, 1.0), D.TimeInterval(0.0, 2.0)))
    moved = disk.relabel("x", "u").relabel("t", "s")
    assert moved.component().points(spark, {"u": 4, "s": 2}).columns == ["u", "y", "s", "w"] and moved.drop(["s"]).restrict(["u"]).factors[0].labels == ("u", "y")
    half = S.circle([0.0, 0.0], 2.0).boundary_subset_measure(spark, F.col("x") > 0).first().measure
    assert half == pytest.approx(2 * math.pi, rel=0.01)


def test_mesh_points_are_inside(spark):
    from axisfield.sources import meshes as M

    cube = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    faces = spark.createDataFrame([tuple(2.0 * c for k in (q[0], q[i], q[i + 1]) for c in cube[k]) for q in quads for i in (1, 2)], ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    points = M.interior_points(spark, faces, 200)
    assert points.agg(F.sum("w")).first()[0] == pytest.approx(8.0, rel=0.15)
    near = M.with_mesh_distance(spark.createDataFrame([(3.0, 1.0, 1.0), (1.0, 1.0, 1.9)], "x double, y double, z double"), faces, smooth=50.0).collect()
    assert near[0].distance == pytest.approx(1.0, abs=0.05) and near[1].distance < 0 and near[0].n_x == pytest.approx(1.0, abs=0.01)


def test_fourier_operators(spark):
    from axisfield.operators import fourier_layers as O

    draw = np.random.default_rng(0)
    x = draw.standard_normal((3, 16, 2))
    # all modes with the identity leave a line as it is
    whole = np.zeros((2, 2, 9), complex)
    whole[0, 0] = whole[1, 1] = 1
    assert O.spectral_mix(x, whole) == pytest.approx(x)
    for grid in ((16,), (8, 6)):
        op = O.FourierOperator.random(grid, 2, 1, modes=2)
        samples = draw.standard_normal((5, *grid, 2))
        rows = spark.createDataFrame([(k, s.ravel().tolist()) for k, s in enumerate(samples)] + [(9, None)], "id long, v array<double>")
        got = {r.id: r.output for r in O.apply(rows, op, "v").collect()}
        assert got[9] is None and all(np.array(got[k]) == pytest.approx(op(samples[k : k + 1]).ravel()) for k in range(5))
        # a turned grid gives a turned output: the operator knows no place
        turned = op(np.roll(samples, 3, axis=1))
        assert turned == pytest.approx(np.roll(op(samples), 3, axis=1))
