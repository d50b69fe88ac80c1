"""Named queries over learned fields: evaluation against SQL, fits against closed forms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.functions import networks as L
from axisfield.functions.expressions import Label, sin
from axisfield.operators import calculus as C
from axisfield.plans import fitting
from axisfield.queries import POINTS, X, Y, points, query, rounded, sql_of, table


def _fixed(network: L.Network) -> L.Network:
    """Parameters by their number, so that SQL can state them."""
    return network.bound({p: round(math.sin(1.0 + k), 3) for k, p in enumerate(network.start)})


def _p(k: int) -> str:
    return f"({round(math.sin(1.0 + k), 3)!r}::DOUBLE)"


@query(sql_of({
    "u": f"{_p(6)}*tanh({_p(0)}*x + {_p(1)}*y + {_p(2)}) + {_p(7)}*tanh({_p(3)}*x + {_p(4)}*y + {_p(5)}) + {_p(8)}"}))
def dense_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hidden units of two inputs, as two projections."""
    return rounded(_fixed(L.dense("net", ["x", "y"], hidden=(2,))).evaluate(points(spark, sf_dir), ["u"]), ["id"], u="u")


@query(sql_of({"u": f"{_p(0)} + {_p(1)}*x + {_p(2)}*(2*x*x - 1) + {_p(3)}*(4*x*x*x - 3*x) + {_p(4)} + {_p(5)}*y + {_p(6)}*(2*y*y - 1) + {_p(7)}*(4*y*y*y - 3*y)", "ux": f"{_p(1)} + {_p(2)}*4*x + {_p(3)}*(12*x*x - 3)"}))
def polynomial_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer of edge polynomials, and its slope by the written-out expression."""
    b = L.Builder("edge", ["x", "y"])
    net = _fixed(b.network(b.polynomial([X, Y], 1, 3, "chebyshev", squash=False)))
    u = net.expression()[0]
    return rounded(points(spark, sf_dir), ["id"], u=u, ux=u.diff("x"))


_FAMILIES = {"second": "4*x*x - 1", "legendre": "(3*x*x - 1)/2", "hermite": "x*x - 1", "laguerre": "(x*x - 4*x + 2)/2"}


@query(sql_of(_FAMILIES))
def polynomial_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(points(spark, sf_dir), ["id"], **{f: L.polynomials(X, 2, f)[2] for f in _FAMILIES})


@query(sql_of({
    "cos_part": "cos(2*x + y)", "sin_part": "sin(2*x + y)", "adaptive": f"tanh({_p(0)}*x)", "stan": f"tanh(x)*(1 + {_p(0)}*x)", "product": f"({_p(0)}*x + {_p(1)})*({_p(4)}*y + {_p(5)}) + ({_p(2)}*x + {_p(3)})*({_p(6)}*y + {_p(7)})",
    "inner": f"({_p(0)}*z + {_p(1)})*({_p(4)}*x + {_p(5)}) + ({_p(2)}*z + {_p(3)})*({_p(6)}*x + {_p(7)})", "unit": "5*x / sqrt(x*x + y*y)", "both": "x + 2*y"}))
def network_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourier features, activations with parameters, separable and branch-and-trunk models, directions, side by side."""
    p = points(spark, sf_dir)
    b = L.Builder("wave", ["x", "y"])
    waves = b.network(b.fourier([X, Y], 1, trainable=True))
    waves = waves.bound(dict(zip(waves.start, (2.0, 1.0), strict=True)))
    line = lambda own, x, n: own.linear([x], n)
    a = L.Builder("adaptive", ["x"])
    adaptive = _fixed(a.network(a.adaptive([X])))
    s = L.Builder("stan", ["x"])
    stan = _fixed(s.network(s.stan([X])))
    product = _fixed(L.separable("sep", ["x", "y"], rank=2, factor=line))
    inner = _fixed(L.branch_and_trunk("deep", ["z"], ["x"], latent=2, hidden=()))
    size, direction = L.Builder("size", []), L.Builder("dir", ["x", "y"])
    unit = L.magnitude_direction(size.network(size.stage([L.lift(5.0)])), direction.network(direction.stage([X, Y])))
    one, two = L.Builder("one", ["x"]), L.Builder("two", ["y"])
    both = L.concatenated(one.network(one.stage([X])), two.network(two.stage([2.0 * Y])))
    out = p
    for net, names in ((waves, ["cos_part", "sin_part"]), (adaptive, ["adaptive"]), (stan, ["stan"]), (product, ["product"]), (inner, ["inner"]), (unit, ["unit", "unit_y"]), (both, ["left", "right"])):
        out = net.evaluate(out, names)
    return rounded(out, ["id"], **{k: k for k in ("cos_part", "sin_part", "adaptive", "stan", "product", "inner", "unit")}, both=F.col("left") + F.col("right"))


@query("SELECT vec_id, i::BIGINT AS i, round(2 * avg(v) OVER (PARTITION BY vec_id), 5) + 0.0 AS low FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def spectral_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as lines, of which a spectral layer with one mode leaves twice the mean."""
    import numpy as np

    from axisfield.operators import fourier_layers as O

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    out = O.mixed(rows, np.full((1, 1, 1), 2.0 + 0j), (64,), "v", "low")
    return out.select("vec_id", F.posexplode("low").alias("i", "low")).select("vec_id", F.col("i").cast("long").alias("i"), (F.round("low", 5) + F.lit(0.0)).alias("low"))


@query("SELECT round(regr_slope(l_extendedprice / 10000, l_quantity / 10), 3) + 0.0 AS slope, round(regr_intercept(l_extendedprice / 10000, l_quantity / 10), 3) + 0.0 AS intercept FROM lineitem")
def fitted_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear network fitted by sums over all rows, one pass a look, with limited memory."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).cast("double").alias("x"), (F.col("l_extendedprice") / 10000).alias("y")).cache()
    b = L.Builder("line", ["x"])
    net = b.network(b.linear([X], 1))
    f, start = fitting.network_objective(rows, net, (Label(net.outputs[0]) - Y) ** 2)
    found, _ = fitting.quasi_newton(f, start, 20)
    return spark.range(1).select(F.round(F.lit(float(found[0])), 3).alias("slope"), F.round(F.lit(float(found[1])), 3).alias("intercept"))


@query(POINTS + """, s AS (SELECT sum(sin(x) * sin(x)) AS aa, sum(sin(x) * t * t) AS ab, sum(pow(t, 4)) AS bb, sum(sin(x) * g) AS ag, sum(t * t * g) AS bg FROM (SELECT *, 2 * sin(x) - t * t + 0.1 * x * t AS g FROM p)),
f AS (SELECT (ag * bb - bg * ab) / (aa * bb - ab * ab) AS a, (aa * bg - ab * ag) / (aa * bb - ab * ab) AS b FROM s)
SELECT method, round(a, places) AS a, round(b, places) AS b FROM f, (VALUES ('bfgs', 4), ('lbfgs', 4), ('ssbroyden', 4), ('evolution', 1)) m(method, places)""")
def fitted_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of a field nearest to data in least squares, by each minimiser: the normal equations' solution, to the digits each reaches."""
    p = points(spark, sf_dir).select("x", "t").cache()
    a, b, t = Label("a"), Label("b"), Label("t")
    u, data = a * sin(X) + b * t**2, 2.0 * sin(X) - t**2 + 0.1 * X * t
    solver = fitting.Solver({"u": u}, {"data": (p, lambda f: [f["u"] - data], 1.0)}, {"a": 0.0, "b": 0.0})
    rows = [(method, *(round(v, 4) for v in solver.solve(10, method).values())) for method in ("bfgs", "lbfgs", "ssbroyden")]
    rows.append(("evolution", *(round(v, 1) for v in fitting.evolve(p, [u - data], {"a": 0.0, "b": 0.0}, generations=18, spread=1.0).values())))
    return spark.createDataFrame(rows, "method string, a double, b double")
