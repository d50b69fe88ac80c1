"""Named queries: constraint objectives, enforced fields, histories, meshes and fits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.functions.expressions import Label, sin
from axisfield.operators import calculus as C
from axisfield.operators import enforced as E
from axisfield.operators import histories as H
from axisfield.operators import residuals as S
from axisfield.plans import fitting
from axisfield.queries import _ELEVATION, POINTS, T, W2, X, Y, Z, elevation, points, query, rounded, sql_of, table
from axisfield.sources import grids as G
from axisfield.sources import meshes as M
from axisfield.sources import samplers

XY, XYZ = [X, Y], [X, Y, Z]


def _losses(df: DataFrame, residuals: dict[str, list]) -> DataFrame:
    """One row with every residual's mean square, in one pass."""
    square = lambda rs: sum((r.column() * r.column() for r in rs), F.lit(0.0))
    return rounded(df.agg(*(F.avg(square(rs)).alias(k) for k, rs in residuals.items())), [], **{k: k for k in residuals})


def _means(parts: dict[str, str], more: str = "p") -> str:
    return " SELECT " + ", ".join(f"round(avg({v}), 6) + 0.0 AS {k}" for k, v in parts.items()) + f" FROM {more}"


@query(POINTS + _means({"heat": "pow(3*(2*x*x - 2*y*y) - 1, 2)", "convection": "pow(3*(2*x*x - 2*y*y) - 2*(x*x - y*y - 1), 2)", "absorbing": "pow((2*x + t)*x - 2*y*y + x/2, 2)", "initial": "pow(x - y, 2)"}))
def thermal_and_wave_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat flux, convection, absorbing and initial residuals."""
    u, v = X**2 - Y**2, X**2 - Y**2 + T * X
    return _losses(points(spark, sf_dir), {"heat": S.heat_flux(u, XY, "xy", 3.0, 1.0), "convection": S.convection(u, XY, "xy", 3.0, 2.0, 1.0), "absorbing": S.absorbing(v, XY, "xy", 2.0), "initial": S.initial(v, Y, order=1)})


@query(POINTS + ", s AS (SELECT *, 2*x*x*y + (x*x+y*y)*y/2 - x*x AS s1, (x*x+y*y)*x/2 + 2*x*y*y - x*y AS s2, 6.4*x*x*y + 0.4*(x*x+y*y)*y AS t1, 0.4*(x*x+y*y)*x + 6.4*x*y*y AS t2, x*x*x*y + x*y*y*y AS un FROM p)" + _means({
    "normal": "un*un", "slip": "pow(s1 - (s1*x+s2*y)*x, 2) + pow(s2 - (s1*x+s2*y)*y, 2)", "gradient": "pow(3*x*x*y, 2) + pow(3*x*y*y, 2)", "traction": "pow(t1 - 1, 2) + t2*t2", "foundation": "pow(t1 + 2*x*x*y, 2) + pow(t2 + 2*x*y*y, 2)",
    "symmetry": "pow(un*x + t1 - (t1*x+t2*y)*x, 2) + pow(un*y + t2 - (t1*x+t2*y)*y, 2)", "displacement": "pow(x*x*y - x, 2) + pow(x*y*y, 2)"}, "s"))
def mechanical_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall, traction, foundation, symmetry and displacement residuals of a plane field."""
    stress = C.elastic_stress(W2, 1.2, 0.4, "xy")
    return _losses(points(spark, sf_dir), {
        "normal": S.normal_component(W2, XY), "slip": S.slip_wall(W2, X, 0.5, XY, "xy"), "gradient": S.zero_normal_gradient(W2, XY, "xy"), "traction": S.traction(stress, XY, [1.0, 0.0]), "foundation": S.elastic_foundation(stress, W2, XY, 2.0, [0.0, 0.0]),
        "symmetry": S.elastic_symmetry(stress, W2, XY), "displacement": S.displacement(W2, [X, 0.0])})


@query(POINTS + ", q AS (SELECT *, x*y + y*z + z*x AS q, x*x + y*y + z*z AS s, y*y - z*x AS c1, z*z - x*y AS c2, x*x - y*z AS c3 FROM p)" + _means({
    "conductor": "s - 2*q*q + q*q*s", "impedance": "pow(c1 - 0.5*(y - q*x), 2) + pow(c2 - 0.5*(z - q*y), 2) + pow(c3 - 0.5*(x - q*z), 2)", "charge": "pow(2*q - 1, 2)", "current": "pow(c1 - x, 2) + c2*c2 + c3*c3", "jump": "pow(3*q - 2*q - 0.5, 2)"}, "q"))
def electromagnetic_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conductor, impedance, charge, current and interface residuals."""
    e, h = [Y, Z, X], [Z, X, Y]
    return _losses(points(spark, sf_dir), {"conductor": S.tangential_field(e, XYZ), "impedance": S.impedance(e, h, XYZ, 0.5), "charge": S.surface_charge(e, XYZ, 2.0, 1.0), "current": S.tangential_jump([2.0 * a for a in h], h, XYZ, [X, 0.0, 0.0]), "jump": S.normal_jump(h, e, XYZ, 3.0, 2.0, 0.5)})


@query(POINTS + " SELECT round(pow(avg(x*x + y*y + z*z) - 1, 2), 6) AS flow, round(pow(avg(3*x*y*z - x*x*x - y*y*y - z*z*z) - 2, 2), 6) AS power, round(pow(avg(0.75*pow(x*x + y*y + z*z, 2)), 2), 6) AS kinetic FROM p")
def integral_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared gaps between integrals over all points, of total measure one, and their targets."""
    p = points(spark, sf_dir)
    # of total measure one, so integrals are means: one pass for all
    return rounded(S.integral_equalities(p, {"flow": (C.dot(XYZ, XYZ), 1.0), "power": (S.power_flux([Y, Z, X], [Z, X, Y], XYZ), 2.0), "kinetic": (S.kinetic_energy_flux(XYZ, XYZ, 1.5), 0.0)}), [], flow="flow", power="power", kinetic="kinetic")


@query(POINTS + ", l AS (SELECT 'a' AS term, avg(pow(x - y, 2)) AS loss FROM p UNION ALL SELECT 'b', avg(pow(x*y - 1, 2)) FROM p) SELECT coalesce(term, 'total') AS term, round(sum(loss), 6) AS loss FROM l GROUP BY ROLLUP (term)")
def total_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rounded(S.total_loss({"a": S.loss(p, [X - Y]), "b": S.loss(p, [X * Y - 1.0])}), ["term"], loss="loss")


@query(POINTS + ", f AS (SELECT *, 1 - x*x - y*y AS phi, -2*x*x - 2*y*y AS pn, x*x + y AS u, 2*x*x + y AS un FROM p) " + sql_of({
    "dirichlet": "x*y + phi*(u - x*y)", "neumann": "u + phi/pn*(1 - un)", "robin": "u + phi/(2*pn)*(3 - u - 2*un)", "absorbing": "u + x*t + phi/pn*(-(2*x*x + y + x*t) - x/4)", "started": "sin(x) + t*y + pow(t/(2*0.1), 2)/(1 + pow(t/(2*0.1), 2))*(u - sin(x) - t*y)", "blended": "(x*u + y*2)/(x + y)"}, source="", origin="f"))
def enforced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that meet boundary and initial targets by construction."""
    u, phi = X**2 + Y, 1.0 - X**2 - Y**2
    fields = E.pipelines({"dirichlet": u, "neumann": u, "robin": u}, {"dirichlet": lambda f: E.dirichlet(f["dirichlet"], phi, X * Y), "neumann": lambda f: E.neumann(f["neumann"], phi, XY, "xy", 1.0), "robin": lambda f: E.robin(f["robin"], phi, XY, "xy", 1.0, 2.0, 3.0)}, {"robin": ["neumann"]})
    return rounded(points(spark, sf_dir), ["id"], **fields, absorbing=E.absorbing(u + X * T, phi, XY, "xy", 4.0), started=E.initial(u, {0: sin(X), 1: Y}, 2.0), blended=E.blend([u, C.lift(2.0)], [X, Y]))


@query(POINTS + " SELECT id, round((t - sin(t)) , 6) + 0.0 AS convolved, round(t*t/2.0 * 2, 6) + 0.0 AS square FROM p")
def convolved_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal convolutions of t - s with sin, and of 2 with s."""
    p = points(spark, sf_dir)
    out = H.time_convolution(p, "t", lambda d: d, F.sin, nodes=16, into="convolved")
    out = H.time_convolution(out, "t", lambda d: F.lit(2.0), lambda s: s, nodes=4, into="square")
    return rounded(out, ["id"], convolved="convolved", square="square")


@query(POINTS + f" SELECT id, round(2*pow(t, 1.5)/{math.gamma(2.5)!r}, 6) + 0.0 AS half, round(2*pow(t, 1.5)/{math.gamma(2.5)!r}, 6) + 0.0 AS half_of_values, round(6*pow(t, 1.5)/{math.gamma(2.5)!r}, 6) + 0.0 AS three_halves FROM p")
def caputo_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 1/2 of t^2 and 3/2 of t^3, against their closed forms."""
    p = points(spark, sf_dir)
    out = H.caputo(p, "t", lambda s: F.lit(2.0) * s, 0.5, into="half")
    out = H.caputo(out, "t", lambda s: F.lit(6.0) * s, 1.5, into="three_halves")
    out = H.caputo_of_values(out, "t", lambda s: s * s, 0.5, into="half_of_values")
    return rounded(out, ["id"], half="half", three_halves="three_halves", half_of_values="half_of_values")


_GL = "WITH RECURSIVE c AS (SELECT 0 AS k, 1.0::DOUBLE AS c UNION ALL SELECT k + 1, c * (k - 1.5) / (k + 1) FROM c WHERE k < 63), " + POINTS.removeprefix("WITH ")


@query(_GL + " SELECT id, round(sum(c / pow(0.25, 1.5) * exp(-pow(x - k*0.25, 2))), 6) + 0.0 AS fore, round(sum(c / pow(0.25, 1.5) / sqrt(2.0) * (exp(-pow(x - k*0.25, 2)) + exp(-pow(x + k*0.25, 2)))), 6) + 0.0 AS riesz FROM p, c GROUP BY id")
def fractional_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided and symmetric differences of order 3/2 of a bell."""
    p, bell = points(spark, sf_dir), lambda v: F.exp(-v * v)
    out = H.fractional_derivative(p, "x", bell, 1.5, 0.25, 64, into="fore")
    out = H.riesz_derivative(out, ["x"], lambda c: bell(c["x"]), 1.5, 0.25, 64, into="riesz")
    return rounded(out, ["id"], fore="fore", riesz="riesz")


@query(POINTS + ", o AS (SELECT 0.2::DOUBLE * (i - 15.5) / 16 AS xi FROM range(32) s(i)) SELECT id, round(sum((sin(x) - sin(x + xi)) / pow(abs(xi), 2.0) * 0.4 / 32), 6) + 0.0 AS laplacian FROM p, o GROUP BY id")
def fractional_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = [{"xi": 0.2 * (k - 15.5) / 16, "w": 0.4 / 32} for k in range(32)]
    out = H.fractional_laplacian(points(spark, sf_dir), o, lambda e: F.sin("x") - F.sin(F.col("x") + e["xi"]), lambda e: F.abs(e["xi"]), 1.0, 1)
    return rounded(out, ["id"], laplacian="laplacian")


@query("""
WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, sum(value) AS v FROM events GROUP BY ALL), k AS (SELECT i AS k, exp(-i / 4.0::DOUBLE) AS w FROM range(24) t(i))
SELECT a.event_type, a.hour, round(sum(b.v * w), 4) + 0.0 AS filtered FROM h a, h b, k WHERE a.event_type = b.event_type AND b.hour = a.hour - k GROUP BY ALL""")
def causal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's exponential memory of hourly sums."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000.0)).alias("hour")
    h = table(spark, sf_dir, "events").groupBy("event_type", hour).agg(F.sum("value").alias("v"))
    out = H.causal_filter(h, ["event_type"], "hour", "v", [math.exp(-k / 4) for k in range(24)])
    return out.select("event_type", "hour", (F.round("filtered", 4) + F.lit(0.0)).alias("filtered"))


@query("""
WITH o AS (SELECT user_id, (epoch_us(ts) // 1000000)::DOUBLE AS t, max(value) AS y FROM events GROUP BY ALL),
s AS (SELECT *, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS b, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS a FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t)),
d AS (SELECT user_id, t, y, coalesce((a + b) / 2, b, a, 0) AS d FROM s), n AS (SELECT *, lead(t) OVER w AS t1, lead(y) OVER w AS y1, lead(d) OVER w AS d1 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)),
m AS (SELECT user_id, y, d, y1, d1, t1 - t AS h, ((t + t1) / 2 - t) / (t1 - t) AS s, t FROM n WHERE t1 IS NOT NULL)
SELECT user_id, t + h / 2 AS at, round(y*(1+2*s)*(1-s)*(1-s) + h*d*s*(1-s)*(1-s) + y1*s*s*(3-2*s) - h*d1*s*s*(1-s), 4) + 0.0 AS tracked FROM m""")
def hermite_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values between observations by cubic Hermite pieces, at the middles; times in whole seconds, so that these are exact."""
    from pyspark.sql import Window

    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)).cast("double")
    o = table(spark, sf_dir, "events").groupBy("user_id", t.alias("t")).agg(F.max("value").alias("y"))
    after = F.lead("t").over(Window.partitionBy("user_id").orderBy("t"))
    asked = o.select("user_id", ((F.col("t") + after) / 2).alias("t")).where("t is not null")
    out = H.track(o, asked, ["user_id"], "t", "y")
    return out.select("user_id", F.col("t").alias("at"), (F.round("tracked", 4) + F.lit(0.0)).alias("tracked"))


@query(_ELEVATION + """, c AS (SELECT a.z AS z00, b.z AS z10, d.z AS z11, e.z AS z01 FROM g a JOIN g b ON b.q = a.q + 1 JOIN g d ON d.q = a.q + 37 JOIN g e ON e.q = a.q + 36 WHERE a.ix < 35)
SELECT (SELECT count(*) FROM g) AS vertices, 2 * count(*) AS faces, round(sum(sqrt(1 + pow(z10 - z00, 2) + pow(z11 - z10, 2)) + sqrt(1 + pow(z11 - z01, 2) + pow(z01 - z00, 2))) / 2, 4) AS area FROM c""")
def mesh_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of the triangles of the customers' elevation grid."""
    grid = elevation(spark, sf_dir)
    v = grid.select("vid", F.col("ix").cast("double").alias("x"), F.col("iy").cast("double").alias("y"), "z")
    f = M.corners(G.grid_faces(grid, 36), v).agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum(M.area()), 4).alias("area"))
    return v.agg(F.count(F.lit(1)).alias("vertices")).crossJoin(f)  # one row each


_U = "('0x' || substr(md5(concat_ws('/', i, {k}, 0)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query("WITH p AS (SELECT -1 + 2.0 * (" + _U.format(k=0) + ") AS x, -1 + 2.0 * (" + _U.format(k=1) + ") AS y FROM (SELECT o_orderkey AS i FROM orders)) SELECT round(4.0 * avg(CASE WHEN x*x + y*y <= 1 THEN 1.0 ELSE 0.0 END), 6) AS area FROM p")
def sampled_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure of a disk by a uniform point for each order; about pi."""
    p = table(spark, sf_dir, "orders").select(*samplers.uniform_at(F.col("o_orderkey"), ["x", "y"], [-1.0, -1.0], [1.0, 1.0]))
    inside = F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1
    return rounded(p.agg((F.avg(inside.cast("double")) * 4.0).alias("area")), [], area="area")


@query("SELECT round(regr_slope(l_extendedprice / 10000, l_quantity / 10), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice / 10000, l_quantity / 10), 4) + 0.0 AS intercept FROM lineitem")
def fitted_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least-squares fit by Gauss-Newton sums over all rows."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).cast("double").alias("x"), (F.col("l_extendedprice") / 10000).alias("y"))
    found = fitting.gauss_newton(rows, [Label("a") * X + Label("b") - Y], {"a": 0.0, "b": 0.0}, steps=3)
    return spark.range(1).select(F.round(F.lit(found["a"]), 4).alias("slope"), F.round(F.lit(found["b"]), 4).alias("intercept"))
