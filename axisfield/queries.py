"""Named queries over the tables, and the same in plain SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.functions.expressions import Label, cos, exp, sin
from axisfield.operators import calculus as C
from axisfield.operators import nonlocal_ops as N
from axisfield.operators import reductions as R
from axisfield.operators import spectral
from axisfield.sources import grids as G

X, Y, Z, T = (Label(n) for n in "xyzt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, keep: list[str], **fields) -> DataFrame:
    """Keys and fields (columns or expressions) to six places."""
    column = lambda f: f if isinstance(f, Column) else f.column() if hasattr(f, "column") else F.col(f)
    return df.select(*keep, *((F.round(column(f), 6) + F.lit(0.0)).alias(k) for k, f in fields.items()))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points of space and time, scaled to about one."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 2000.0).alias("y"), ((F.col("p_partkey") % 97) / 97.0).alias("z"), ((F.col("p_partkey") % 13) / 13.0).alias("t"))


POINTS = "WITH p AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS x, p_retailprice / 2000.0 AS y, (p_partkey % 97) / 97.0::DOUBLE AS z, (p_partkey % 13) / 13.0::DOUBLE AS t FROM part)"


def sql_of(select: dict[str, str], source: str = POINTS, keep: str = "id", origin: str = "p") -> str:
    return f"{source} SELECT {keep}, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in select.items()) + f" FROM {origin}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) AS mean_price,
       round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity * l_tax ELSE 0 END) / sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END), 6) AS masked_tax
FROM lineitem GROUP BY ALL""")
def masked_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over a component with a weight and a mask, keeping two axes."""
    df = table(spark, sf_dir, "lineitem")
    keep = ["l_returnflag", "l_linestatus"]
    price = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return R.means(df, {"mean_price": (price, None), "masked_tax": (F.col("l_tax"), F.col("l_discount") > 0.05)}, "l_quantity", keep).select(*keep, F.round("mean_price", 4).alias("mean_price"), F.round("masked_tax", 6).alias("masked_tax"))


#: Each nation's range of customer balances, as the interval of an axis.
_RANGES = "WITH b AS (SELECT c_nationkey AS nation, min(c_acctbal) / 9973.0 AS lo, max(c_acctbal) / 9973.0 AS hi FROM customer GROUP BY ALL)"
_AXES = "SELECT '{k}' AS kind, nation, i, round(lo + (hi - lo) * {x}, 6) + 0.0 AS x, round((hi - lo) * {w}, 6) + 0.0 AS w FROM b, range(12) t(i)"


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg((F.min("c_acctbal") / 9973.0).alias("lo"), (F.max("c_acctbal") / 9973.0).alias("hi"))


@query(_RANGES + " UNION ALL ".join(_AXES.format(k=k, x=x, w=w) for k, x, w in (
    ("uniform", "i / 11.0::DOUBLE", "CASE WHEN i IN (0, 11) THEN 0.5::DOUBLE / 11 ELSE 1.0::DOUBLE / 11 END"), ("fourier", "i / 12.0::DOUBLE", "1.0::DOUBLE / 12"), ("sine", "(i + 0.5::DOUBLE) / 12", "1.0::DOUBLE / 12"), ("cosine", "i / 11.0::DOUBLE", "CASE WHEN i IN (0, 11) THEN 0.5::DOUBLE / 11 ELSE 1.0::DOUBLE / 11 END"))))
def axis_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform, periodic, cell-centred and endpoint axes over each nation's range of balances, with their weights."""
    out, b = None, ranges(spark, sf_dir)
    for kind in ("uniform", "fourier", "sine", "cosine"):
        one = rounded(G.axes_of(b, kind, 12, F.col("lo"), F.col("hi")).withColumn("kind", F.lit(kind)), ["kind", "nation", "i"], x="x", w="w")
        out = one if out is None else out.union(one)
    return out


@query(_RANGES + " SELECT rule, nation, round((pow(hi, 3) - pow(lo, 3)) / 3, 6) + 0.0 AS x2, round(exp(hi) - exp(lo), 6) + 0.0 AS expo FROM b, (VALUES ('gauss'), ('radau'), ('lobatto')) r(rule)")
def legendre_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrals over each nation's range of balances by Gauss, Radau and Lobatto nodes."""
    out, b = None, ranges(spark, sf_dir)
    for rule in ("gauss", "radau", "lobatto"):
        df = G.axes_of(b, "legendre", 10, F.col("lo"), F.col("hi"), rule=rule).withColumn("rule", F.lit(rule))
        one = rounded(R.integrals(df, {"x2": F.col("x") * F.col("x"), "expo": F.exp("x")}, keep=["rule", "nation"]), ["rule", "nation"], x2="x2", expo="expo")
        out = one if out is None else out.union(one)
    return out


@query("WITH g AS (SELECT i, i / 32.0::DOUBLE AS x FROM range(32) t(i)), m AS (SELECT hour(ts) AS j, sum(value) / 7.3 / count(*) AS t FROM events GROUP BY ALL) SELECT j, round(sum(sin(2 * pi() * x) * sin(2 * pi() * x) * t / 32), 6) + 0.0 AS integral FROM g, m GROUP BY j")
def product_grid_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of a periodic axis with the hours of the events, integrated over the first and kept on the other."""
    x = G.axis(spark, "fourier", 32)
    t = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("i")).agg((F.sum("value") / 7.3 / F.count(F.lit(1))).alias("t")).withColumn("w", F.lit(1.0))
    grid = G.product(x, t, names=["x", "t"])
    wave = F.sin(F.lit(2 * math.pi) * F.col("x"))
    return R.integral(grid, wave * wave * F.col("t"), keep=["i_t"]).select(F.col("i_t").alias("j"), (F.round("integral", 6) + F.lit(0.0)).alias("integral"))


U = sin(X * 3.0) * exp(Y * 0.5) + X * Y * Z + cos(T) * X**2
V = [sin(X) * Y, Y * Z + T, exp(X * 0.3) * Z]


@query(sql_of({
    "u": "sin(3*x)*exp(0.5*y) + x*y*z + cos(t)*x*x", "ux": "3*cos(3*x)*exp(0.5*y) + y*z + 2*x*cos(t)", "uy": "0.5*sin(3*x)*exp(0.5*y) + x*z", "uz": "x*y", "ut": "-sin(t)*x*x",
    "uxx": "-9*sin(3*x)*exp(0.5*y) + 2*cos(t)", "uxy": "1.5*cos(3*x)*exp(0.5*y) + z", "lap": "-8.75*sin(3*x)*exp(0.5*y) + 2*cos(t)", "bilap": "76.5625*sin(3*x)*exp(0.5*y)", "uxxx": "-27*cos(3*x)*exp(0.5*y)"}))
def scalar_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient, mixed and higher partials, Laplacian and its square of a field."""
    g, h = C.grad(U, "xyz"), C.hessian(U, "xyz")
    return rounded(points(spark, sf_dir), ["id"], u=U, ux=g[0], uy=g[1], uz=g[2], ut=U.diff("t"), uxx=h[0][0], uxy=h[0][1], lap=C.laplacian(U, "xyz"), bilap=C.bilaplacian(U, "xyz"), uxxx=C.partial(U, "x", 3))


@query(sql_of({
    "div": "cos(x)*y + z + exp(0.3*x)", "cx": "-y", "cy": "-0.3*exp(0.3*x)*z", "cz": "-sin(x)",
    "along": "(3*cos(3*x)*exp(0.5*y) + y*z + 2*x*cos(t))*sin(x)*y + (0.5*sin(3*x)*exp(0.5*y) + x*z)*(y*z+t) + x*y*exp(0.3*x)*z",
    "material": "-sin(t)*x*x + (3*cos(3*x)*exp(0.5*y) + y*z + 2*x*cos(t))*sin(x)*y + (0.5*sin(3*x)*exp(0.5*y) + x*z)*(y*z+t) + x*y*exp(0.3*x)*z",
    "diffusion": "(1+x*x)*(-8.75*sin(3*x)*exp(0.5*y) + 2*cos(t)) + 2*x*(3*cos(3*x)*exp(0.5*y) + y*z + 2*x*cos(t))",
    "diagonal": "(3*cos(3*x)*exp(0.5*y) + y*z + 2*x*cos(t)) + x*(-9*sin(3*x)*exp(0.5*y) + 2*cos(t)) + y*(0.25*sin(3*x)*exp(0.5*y)) + (0.5*sin(3*x)*exp(0.5*y) + x*z) + x*y"}))
def vector_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence, curl, directional and material derivatives, diffusion operators."""
    c = C.curl(V, "xyz")
    return rounded(points(spark, sf_dir), ["id"], div=C.div(V, "xyz"), cx=c[0], cy=c[1], cz=c[2], along=C.directional_derivative(U, V, "xyz"), material=C.material_derivative(U, V, "xyz"), diffusion=C.div_k_grad(U, 1.0 + X**2, "xyz"), diagonal=C.div_diag_k_grad(U, [X, Y, Z], "xyz"))


W2 = [X**2 * Y, X * Y**2]


@query(sql_of({
    "e11": "2*x*y", "e12": "(x*x + y*y)/6", "s11": "1.6*x*y + 1.2*4*x*y", "s12": "0.8*(x*x + y*y)/2*1.0", "rate": "sqrt(2*(8*x*x*y*y + (x*x+y*y)*(x*x+y*y)/2))",
    "hydro": "-(1.6*x*y + 4.8*x*y)", "mises": "sqrt(abs((6.4*x*y)*(6.4*x*y) + 3*(0.4*(x*x+y*y))*(0.4*(x*x+y*y))))", "div1": "1.6*y + 4.8*y + 0.8*y", "e11_finite": "2*x*y + (4*x*x*y*y + y*y*y*y)/2", "j": "(1 + 2*x*y)*(1 + 2*x*y) - x*x*y*y"}))
def elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strain, stress, equivalent stress and finite strain of a displacement (mu 0.4, lambda 1.2)."""
    e, s = C.strain(W2, "xy"), C.elastic_stress(W2, 1.2, 0.4, "xy")
    return rounded(points(spark, sf_dir), ["id"], e11=e[0][0], e12=e[0][1] / 3.0, s11=s[0][0], s12=s[0][1], rate=C.strain_rate_magnitude(W2, "xy"), hydro=C.pressure(s), mises=C.von_mises(s), div1=C.div_tensor(s, "xy")[0], e11_finite=C.finite_strain(W2, "xy")[0][0], j=C.det(C.deformation_gradient(W2, "xy")))


@query(sql_of({
    "p11": "0.4*(1+2*x*y) + (0.9*ln((1+2*x*y)*(1+2*x*y) - x*x*y*y) - 0.4)*(1+2*x*y)/((1+2*x*y)*(1+2*x*y) - x*x*y*y)", "m11": "0.5*2*(x*x - y*y - z*z) + 0.5*3*(y*y - x*x - z*z)", "m12": "2*x*y + 3*y*x"}))
def hyperelastic_and_maxwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.maxwell_stress([X, Y, Z], [Y, X, Z], 2.0, 3.0)
    return rounded(points(spark, sf_dir), ["id"], p11=C.neo_hookean_first(W2, 0.4, 0.9, "xy")[0][0], m11=m[0][0], m12=m[0][1])


@query(sql_of({"tx": "y*z - (y*z*x + x*z*y + x*y*z)*x", "sdiv": "x + y + z - 2*(x*x*y + y*y*z + z*z*x)", "lb": "2*(1-x*x)*(1-x*x) + 2*x*x*y*y + 2*x*x*z*z"}))
def surface_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tangential gradient, surface divergence and Laplace-Beltrami with the position as normal."""
    n = [X, Y, Z]
    return rounded(points(spark, sf_dir), ["id"], tx=C.surface_grad(X * Y * Z, n, "xyz")[0], sdiv=C.surface_div([X * Y, Y * Z, Z * X], n, "xyz"), lb=C.laplace_beltrami(X**2, n, "xyz"))


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS s, value FROM events),
w AS (SELECT *, lag(value) OVER o AS b, lead(value) OVER o AS a FROM e WINDOW o AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT event_id, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN b IS NULL THEN a - value WHEN a IS NULL THEN value - b ELSE (a - b) / 2 END, 6) + 0.0 AS derivative FROM w""")
def stencil_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite differences per event along each user's line of events."""
    e = table(spark, sf_dir, "events").withColumn("o", F.struct(F.unix_micros(F.col("ts").cast("timestamp")), "event_id"))
    return rounded(N.stencil(e, ["user_id"], "o", "value", F.lit(1.0)), ["event_id"], derivative="derivative")


_LINES = "WITH l AS (SELECT p_partkey AS line, p_size / 10.0::DOUBLE AS a FROM part)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line"), (F.col("p_size") / 10.0).alias("a"))


@query(_LINES + " SELECT line, i::BIGINT AS i, round(a * 2 * pi() * cos(2 * pi() * i / 32), 5) + 0.0 AS derivative FROM l, range(32) t(i)")
def fourier_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A periodic line a part, by its Fourier sum."""
    df = lines(spark, sf_dir).crossJoin(F.broadcast(G.axis(spark, "fourier", 32))).withColumn("u", F.col("a") * F.sin(F.lit(2 * math.pi) * F.col("x")))
    out = spectral.line_derivative(df, "fourier", ["line"], "i", "u", 1 / 32)
    return out.select("line", F.col("i").cast("long").alias("i"), (F.round("derivative", 5) + F.lit(0.0)).alias("derivative"))


_GAUSS = [float(x) for x in (np.polynomial.legendre.leggauss(12)[0] + 1) / 2]


@query(_LINES + ", g(i, x) AS (VALUES " + ", ".join(f"({k}::BIGINT, {x!r}::DOUBLE)" for k, x in enumerate(_GAUSS)) + ") SELECT line, i, round(30 * a * pow(x, 4), 4) + 0.0 AS derivative FROM l, g")
def polynomial_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second derivatives of a sixth power a part, on Gauss nodes."""
    df = G.axes_of(lines(spark, sf_dir), "legendre", 12, F.lit(0.0), F.lit(1.0)).withColumn("u", F.col("a") * F.pow("x", F.lit(6.0)))
    out = spectral.line_derivative(df, "nodes", ["line"], "i", "u", order=2, nodes=np.array(_GAUSS))
    return out.select("line", F.col("i").cast("long").alias("i"), (F.round("derivative", 4) + F.lit(0.0)).alias("derivative"))


@query("""
WITH c AS (SELECT c_custkey, c_acctbal / 10000.0 AS x, (c_custkey % 101) / 101.0::DOUBLE AS y FROM customer), s AS (SELECT s_suppkey, s_acctbal / 10000.0 AS sx, (s_suppkey % 101) / 101.0::DOUBLE AS sy, s_nationkey::DOUBLE AS v FROM supplier),
d AS (SELECT c_custkey, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2, v FROM c, s)
SELECT c_custkey, round(CASE WHEN min(d2) < 1e-12 THEN arg_min(v, d2) ELSE sum(v / d2) / sum(1 / d2) END, 6) + 0.0 AS idw FROM d GROUP BY c_custkey""")
def inverse_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers take values from all suppliers by inverse squared distance."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10000.0).alias("x"), ((F.col("c_custkey") % 101) / 101.0).alias("y"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 10000.0).alias("sx"), ((F.col("s_suppkey") % 101) / 101.0).alias("sy"), F.col("s_nationkey").cast("double").alias("v"))
    return rounded(N.inverse_distance(c, s, [("x", "sx"), ("y", "sy")], "v"), ["c_custkey"], idw="idw")


@query("""
WITH c AS (SELECT c_custkey, c_acctbal / 10000.0 AS x FROM customer), q AS (SELECT (i + 0.5::DOUBLE) / 64 AS y FROM range(64) t(i))
SELECT c_custkey, round(sum(exp(-(x - y) * (x - y)) * sin(y) * sin(y) / 64), 6) + 0.0 AS integral FROM c, q GROUP BY c_custkey""")
def kernel_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian kernel over a quadrature table, at every customer."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10000.0).alias("x"))
    rule = [{"y": (k + 0.5) / 64, "w": 1 / 64} for k in range(64)]
    d = lambda e: F.col("x") - e["y"]
    return rounded(N.kernel_integral(c, rule, lambda e: F.exp(-d(e) * d(e)) * F.sin(e["y"]) * F.sin(e["y"]) * e["w"]), ["c_custkey"], integral="integral")


@query(POINTS + ", o AS (SELECT 0.1::DOUBLE * (i - 8) / 8 AS xi FROM range(17) t(i)) SELECT id, round(sum((sin(x + xi) - sin(x)) * abs(xi) / 17), 6) + 0.0 AS integral FROM p, o GROUP BY id")
def local_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bond differences over a ball of offsets around each point."""
    ball = [{"xi": 0.1 * (k - 8) / 8, "w": 1 / 17} for k in range(17)]
    bond = lambda e: (F.sin(F.col("x") + e["xi"]) - F.sin("x")) * F.abs(e["xi"]) * e["w"]
    return rounded(N.local_integral(points(spark, sf_dir), ball, bond), ["id"], integral="integral")


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, value FROM events)
SELECT e.event_id, round(max(p.value), 6) + 0.0 AS delayed FROM e LEFT JOIN (SELECT user_id, s, max(value) AS value FROM e GROUP BY ALL) p
ON p.user_id = e.user_id AND p.s = (SELECT max(s) FROM e x WHERE x.user_id = e.user_id AND x.s <= e.s - 3600) GROUP BY e.event_id""")
def delayed_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user value an hour before, as of that time (the largest of a second)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"), "value")
    return rounded(N.delay(e, "user_id", "s", "value", 3600), ["event_id"], delayed="delayed")


@query(POINTS + " SELECT round(sum(0.01 * x * y), 4) + 0.0 AS inner_product, round(sqrt(sum(0.01 * (x*x + y*y))), 4) + 0.0 AS l2, round(pow(sum(0.01 * pow(sqrt(x*x + y*y), 3)), 1/3.0), 4) + 0.0 AS l3 FROM p")
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner product and norms over a weighted point set."""
    p, x, y = points(spark, sf_dir).withColumn("w", F.lit(0.01)), F.col("x"), F.col("y")
    size = F.sqrt(x * x + y * y)
    out = R.integrals(p, {"inner_product": x * y, "l2": size * size, "l3": F.pow(size, F.lit(3.0))})
    return out.select(F.round("inner_product", 4).alias("inner_product"), F.round(F.sqrt("l2"), 4).alias("l2"), F.round(F.pow("l3", F.lit(1 / 3)), 4).alias("l3"))


@query("""
WITH b AS (SELECT 0.5 + p_size / 50.0::DOUBLE AS r, 2 * pi() * i / 64 AS a FROM part, range(64) t(i)), p AS (SELECT r, r * cos(a) AS x, r * sin(a) AS y, 2 * pi() * r / 64 AS w FROM b)
SELECT round(avg(pow(x*x - y*y - 1, 2)), 6) AS dirichlet, round(avg(pow((2*x*x - 2*y*y) / r, 2)), 6) AS neumann, round(avg(pow(2*(x*x - y*y) + 0.5*(2*x*x - 2*y*y) / r, 2)), 6) AS robin,
       round(sum(w * pow(x*x - y*y - 1, 2)), 3) AS dirichlet_integral, round(sum(w * (x * x * x - y * y * y) / r), 3) + 0.0 AS flux FROM p""")
def boundary_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirichlet, Neumann and Robin residuals and a flux on a ring around each part, as wide as the part's size."""
    angle = F.lit(2 * math.pi) * F.col("k") / F.lit(64.0)
    ring = table(spark, sf_dir, "part").select((0.5 + F.col("p_size") / 50.0).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    ring = ring.withColumns({"nx": F.cos(angle), "ny": F.sin(angle)}).withColumns({"x": F.col("r") * F.col("nx"), "y": F.col("r") * F.col("ny"), "w": F.col("r") * F.lit(2 * math.pi / 64)})
    u, n = X**2 - Y**2, [Label("nx"), Label("ny")]
    un = C.dot(C.grad(u, "xy"), n)
    square, w = lambda e: e.column() * e.column(), F.col("w")
    flux = C.dot([X**2, -(Y**2)], n).column()
    out = ring.agg(F.avg(square(u - 1.0)).alias("dirichlet"), F.avg(square(un)).alias("neumann"), F.avg(square(2.0 * u + 0.5 * un)).alias("robin"), F.sum(w * square(u - 1.0)).alias("di"), F.sum(w * flux).alias("fl"))
    return out.select(*(F.round(c, 6).alias(c) for c in ("dirichlet", "neumann", "robin")), F.round("di", 3).alias("dirichlet_integral"), (F.round("fl", 3) + F.lit(0.0)).alias("flux"))


@query("WITH g AS (SELECT (epoch_us(ts) % 86400000000) / 86400000000.0::DOUBLE AS t FROM events) SELECT round(avg(pow(2*t - 3*t*t, 2)), 6) AS ode, round(avg(pow(t*t - sin(t), 2)), 6) AS data FROM g")
def time_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ODE residual and a data residual at the events' times of day."""
    t, u = table(spark, sf_dir, "events").select((F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86400000000)) / 86400000000.0).alias("t")), T**2
    ode, data = (u.diff("t") - 3.0 * T**2).column(), (u - sin(T)).column()
    return rounded(t.agg(F.avg(ode * ode).alias("ode"), F.avg(data * data).alias("data")), [], ode="ode", data="data")


@query(sql_of({
    "ball": "sqrt((x-0.5)*(x-0.5) + (y-0.5)*(y-0.5) + (z-0.5)*(z-0.5)) - 0.4", "torus": "sqrt(pow(sqrt(x*x + y*y) - 0.6, 2) + z*z) - 0.2",
    "box": "sqrt(pow(greatest(abs(x-0.5)-0.25,0),2) + pow(greatest(abs(y-0.5)-0.25,0),2) + pow(greatest(abs(z-0.5)-0.25,0),2)) + least(greatest(abs(x-0.5)-0.25, abs(y-0.5)-0.25, abs(z-0.5)-0.25), 0)",
    "cut": "greatest(sqrt((x-0.5)*(x-0.5) + (y-0.5)*(y-0.5) + (z-0.5)*(z-0.5)) - 0.4, -(sqrt(pow(sqrt(x*x + y*y) - 0.6, 2) + z*z) - 0.2))"}))
def signed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitives and their set algebra."""
    c = [0.5] * 3
    ball, torus, box = G.sdf_ball(c, 0.4, "xyz"), G.sdf_torus([0.0] * 3, 0.6, 0.2, "xyz"), G.sdf_box(c, [0.5] * 3, "xyz")
    return rounded(points(spark, sf_dir), ["id"], ball=ball, torus=torus, box=box, cut=G.difference(ball, torus))


@query(POINTS + ", r AS (SELECT * FROM p WHERE x BETWEEN 0.1 AND 0.9 AND y BETWEEN 0.1 AND 0.9), k AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.05), floor(y / 0.05), floor(z / 0.05) ORDER BY id) AS n FROM r) SELECT id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM k WHERE n = 1")
def voxel_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cropped cloud with the first point of each voxel."""
    roi = points(spark, sf_dir).where("x between 0.1 and 0.9 and y between 0.1 and 0.9")
    return rounded(G.voxel_first(roi, 0.05, ["x", "y", "z"], "id"), ["id"], x="x", y="y", z="z")


#: Customers as an elevation grid of 36 columns, row by row; the last row may be short.
_ELEVATION = "WITH g AS (SELECT c_custkey AS q, c_custkey % 36 AS ix, c_acctbal / 1000.0 AS z FROM customer)"


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("vid"), (k % 36).alias("ix"), F.floor(k / 36).alias("iy"), (F.col("c_acctbal") / 1000.0).alias("z"))


@query(_ELEVATION + """, c AS (SELECT a.q FROM g a JOIN g d ON d.q = a.q + 37 WHERE a.ix < 35), f AS (SELECT q AS i, q + 1 AS j, q + 37 AS k FROM c UNION ALL SELECT q, q + 37, q + 36 FROM c),
e AS (SELECT least(i, j) AS a, greatest(i, j) AS b FROM f UNION ALL SELECT least(j, k), greatest(j, k) FROM f UNION ALL SELECT least(k, i), greatest(k, i) FROM f)
SELECT faces, count(*) AS edges FROM (SELECT a, b, count(*) AS faces FROM e GROUP BY ALL) GROUP BY faces""")
def elevation_mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the customers' elevation grid; boundary edges have one face, interior edges two."""
    return G.edges(G.grid_faces(elevation(spark, sf_dir), 36)).groupBy("faces").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v))), 4) AS l2, round(list_sum(list_transform(embedding, lambda v: abs(v::DOUBLE))), 4) AS l1 FROM embeddings")
def array_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    total = lambda f: F.aggregate("embedding", F.lit(0.0), lambda s, v: s + f(v.cast("double")))
    return e.select("vec_id", F.round(F.sqrt(total(lambda v: v * v)), 4).alias("l2"), F.round(total(F.abs), 4).alias("l1"))


@query("""
WITH t AS (SELECT 'start' AS term, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'end', count(*), sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F')
SELECT term, n, round(s, 2) AS s FROM t UNION ALL SELECT 'union', sum(n)::BIGINT, round(sum(s), 2) FROM t""")
def component_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integral over a union is the sum over its terms, which may overlap."""
    o = table(spark, sf_dir, "orders")
    terms = o.where("o_orderpriority = '1-URGENT'").withColumn("term", F.lit("start")).unionByName(o.where("o_orderstatus = 'F'").withColumn("term", F.lit("end")))
    out = terms.rollup("term").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return out.select(F.coalesce("term", F.lit("union")).alias("term"), "n", F.round("s", 2).alias("s"))


#: Digits of the parts' keys in a base, turned around behind the point.
_MIRRORED = "WITH RECURSIVE h AS (SELECT p_partkey AS i, p_partkey AS r, 1.0::DOUBLE / {b} AS f, 0.0::DOUBLE AS v FROM part UNION ALL SELECT i, r // {b}, f / {b}, v + f * (r % {b}) FROM h WHERE r > 0) SELECT i, max(v) AS v FROM h GROUP BY i"


@query(f"SELECT a.i, round(a.v, 6) + 0.0 AS x, round(-1 + 3 * b.v, 6) + 0.0 AS y FROM ({_MIRRORED.format(b=2)}) a JOIN ({_MIRRORED.format(b=3)}) b ON a.i = b.i")
def halton_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each part, by the digits of its key in bases two and three."""
    k = F.col("p_partkey")
    return rounded(table(spark, sf_dir, "part"), [k.alias("i")], x=G.halton(k, 2), y=-1.0 + 3.0 * G.halton(k, 3))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_weighted_mean(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
