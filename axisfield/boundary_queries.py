"""Named queries over pieces of boundaries and over product domains with latent factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.functions.expressions import Label, cos, exp, sin
from axisfield.operators import enforced as E
from axisfield.operators import latent, pieces
from axisfield.plans.tables import dealt
from axisfield.queries import POINTS, X, Y, points, query, rounded, table

T = Label("t")

#: Suppliers as points of a ring with outward normals, and customers around it.
_RING = "WITH s AS (SELECT 2.0 * cos(s_suppkey * 0.7) AS px, 2.0 * sin(s_suppkey * 0.7) AS py, cos(s_suppkey * 0.7) AS nx, sin(s_suppkey * 0.7) AS ny FROM supplier), c AS (SELECT c_custkey, c_acctbal / 4000.0 AS x, (c_custkey % 101) / 25.0 - 2.0 AS y FROM customer)"
_WIDTH = 0.08
_SOFTENED = "pow(abs(2.0 * {w} * (greatest({f} / {w}, 0) + ln(1 + exp(-abs({f} / {w}))) - ln(2.0))) + 1e-16, -2)"


@query(f"""{_RING},
d AS (SELECT c_custkey, (x - px) * (x - px) + (y - py) * (y - py) AS d2, (x - px) * nx + (y - py) * ny AS along FROM c, s),
k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2) AS n, min(d2) OVER (PARTITION BY c_custkey) AS least FROM d),
w AS (SELECT c_custkey, along, exp((least - d2) / ({_WIDTH} * {_WIDTH} + 1e-12)) * (0.5 + 0.5 / (1 + 0.25 * pow(1 - greatest(-1, least(1, along / sqrt(d2 + 1e-12))), 2))) AS w FROM k WHERE n <= 8),
f AS (SELECT c_custkey, sum(w * along) / sum(w) AS f FROM w GROUP BY c_custkey)
SELECT c_custkey, round(f, 5) + 0.0 AS distance, round(1 / sqrt({_SOFTENED.format(f='f', w=_WIDTH)}), 5) + 0.0 AS softened FROM f""")
def piece_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' local distances to a ring of the suppliers, and what the weights are made of."""
    a = F.col("s_suppkey") * 0.7
    ring = table(spark, sf_dir, "supplier").select((2.0 * F.cos(a)).alias("x"), (2.0 * F.sin(a)).alias("y"), F.cos(a).alias("n_x"), F.sin(a).alias("n_y"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 4000.0).alias("x"), ((F.col("c_custkey") % 101) / 25.0 - 2.0).alias("y"))
    out, (distance,) = pieces.with_distances(c, [ring], ["x", "y"], _WIDTH, k=8)
    softened = pieces.weight(distance, _WIDTH) ** -0.5
    return out.select("c_custkey", (F.round(distance.column(), 5) + F.lit(0.0)).alias("distance"), (F.round(softened.column(), 5) + F.lit(0.0)).alias("softened"))


_EDGES = POINTS + ", e AS (SELECT id, CASE id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.1 + 0.8 * x END AS x, y FROM p)"


@query(_EDGES + f""", w AS (SELECT *, {_SOFTENED.format(f='(-x)', w=_WIDTH)} AS w0, {_SOFTENED.format(f='(x - 1)', w=_WIDTH)} AS w1 FROM e),
u AS (SELECT *, sin(y) + x * (x + y - sin(y)) AS u0, y * y + (1 - x) * (x + y - y * y) AS u1 FROM w)
SELECT id, round((w0 * u0 + w1 * u1) / (w0 + w1), 5) + 0.0 AS u, CASE id % 3 WHEN 0 THEN round(sin(y), 5) WHEN 1 THEN round(y * y, 5) END + 0.0 AS target FROM u""")
def boundary_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that meets one target on the left edge of a square and another on the right one; the edges' points come from the customers."""
    e = points(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 3 == 1, 1.0).otherwise(0.1 + 0.8 * F.col("x")).alias("x"), "y")
    spots = table(spark, sf_dir, "customer").select((F.col("c_custkey") / F.lit(50.0)).alias("y"))
    left, right = (spots.select(F.lit(at).alias("x"), "y", F.lit(n).alias("n_x"), F.lit(0.0).alias("n_y")) for at, n in ((0.0, -1.0), (1.0, 1.0)))
    u = X + Y
    fields = [E.dirichlet(u, X, sin(Y)), E.dirichlet(u, 1.0 - X, Y**2)]
    out, field = pieces.blended(e, fields, [left, right], ["x", "y"], _WIDTH, k=4)
    target = F.when(F.col("id") % 3 == 0, F.round(F.sin("y"), 5)).when(F.col("id") % 3 == 1, F.round(F.col("y") * F.col("y"), 5)) + F.lit(0.0)
    return out.select("id", (F.round(field.column(), 5) + F.lit(0.0)).alias("u"), target.alias("target"))


def _model() -> latent.Contraction:
    """Two outputs of three latent numbers over parts, nations and time."""
    part = [sin(X), sin(2.0 * X) * Y, exp(X * 0.3), cos(X), X * Y, Y**2]
    return latent.Contraction.of({"part": part, "nation": [Label("n"), Label("n") ** 2 + 1.0, cos(Label("n"))], "time": [exp(-T), T, 1.0 + T**2]}, 3, 2)


def _axes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 25.0).alias("n"), (1.0 + F.col("n_regionkey")).alias("w"))
    region = table(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") / 5.0).alias("t"), F.lit(0.2).alias("w"))
    return {"part": points(spark, sf_dir).drop("t", "z").withColumn("w", F.col("y") + 1.0), "nation": nation, "time": region}


_GRID = POINTS + ", n AS (SELECT n_nationkey, n_nationkey / 25.0::DOUBLE AS n, 1.0 + n_regionkey AS wn FROM nation), r AS (SELECT r_regionkey, r_regionkey / 5.0::DOUBLE AS s, 0.2::DOUBLE AS wr FROM region)"
_U = ("sin(x) * n * exp(-s) + exp(0.3 * x) * (n * n + 1) * s + x * y * cos(n) * (1 + s * s)", "sin(2 * x) * y * n * exp(-s) + cos(x) * (n * n + 1) * s + y * y * cos(n) * (1 + s * s)")
_UX = "cos(x) * n * exp(-s) + 0.3 * exp(0.3 * x) * (n * n + 1) * s + y * cos(n) * (1 + s * s)"


@query(f"{_GRID} SELECT id, n_nationkey, r_regionkey, round({_U[0]}, 6) + 0.0 AS u, round({_U[1]}, 6) + 0.0 AS v FROM p, n, r")
def latent_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field over the product of parts, nations and regions, each factor evaluated on its own table."""
    axes = {k: v.drop("w") for k, v in _axes(spark, sf_dir).items()}
    axes["part"] = dealt(axes["part"])  # a part makes 125 rows
    return rounded(_model().on_grid(axes, ["u", "v"]), ["id", "n_nationkey", "r_regionkey"], u="u", v="v")


@query(f"{_GRID} SELECT round(sum((y + 1) * wn * wr * ({_U[0]})), 3) AS u, round(sum((y + 1) * wn * wr * ({_U[1]})), 3) AS v, round(sum((y + 1) * wn * wr), 4) AS total_weight, round(sum(CASE WHEN x > 0.5 THEN (y + 1) * wn * wr * ({_UX}) ELSE 0 END), 3) AS slope FROM p, n, r")
def latent_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrals over that product from sums over its axes, also of a derivative over a part of it."""
    model, axes = _model(), _axes(spark, sf_dir)
    whole = model.integrals(axes, ["u", "v"])
    part = model.diff("x").integrals(axes, ["slope", "other"], masks={"part": F.col("x") > 0.5}).select("slope")
    return whole.crossJoin(part).select(*(F.round(c, k).alias(c) for c, k in (("u", 3), ("v", 3), ("total_weight", 4), ("slope", 3))))  # one row each


@query("""
WITH e AS (SELECT event_id, (user_id % 50) / 50.0 AS x, hour(ts) / 24.0 AS t FROM events)
SELECT event_id, round(sin(3 * x) * exp(-t) + x * x * (1 + t), 6) + 0.0 AS u, round(-sin(3 * x) * exp(-t) + x * x, 6) + 0.0 AS ut FROM e""")
def latent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field and its time derivative at events, each factor evaluated once a user and once an hour."""
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 50) / 50.0).alias("x"), (F.hour("ts") / 24.0).alias("t"))
    model = latent.Contraction.of({"x": [sin(3.0 * X), X**2], "t": [exp(-T), 1.0 + T]}, 2)
    return rounded(model.diff("t").on_points(model.on_points(e, ["u"]), ["ut"]), ["event_id"], u="u", ut="ut")


_TRACKED = """
WITH o AS (SELECT user_id % 6 AS sensor, hour(ts)::DOUBLE AS t, avg(value) AS y FROM events GROUP BY ALL),
b AS (SELECT *, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS s1, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS s2 FROM o WINDOW w AS (PARTITION BY sensor ORDER BY t)),
h AS (SELECT sensor, t, y, coalesce((s1 + s2) / 2, s1, s2, 0.0) AS d FROM b),
p AS (SELECT p_partkey AS id, p_size / 50.0 AS x, (p_partkey % 97) / 4.0 AS t FROM part),
q AS (SELECT id, p.x, p.t, s AS sensor, 0.053 + s * 0.17 AS sx, row_number() OVER (PARTITION BY id ORDER BY abs(p.x - 0.053 - s * 0.17)) AS n FROM p, range(6) r(s)),
l AS (SELECT q.id, q.sensor, max(h.t) AS tl FROM q JOIN h ON h.sensor = q.sensor AND h.t <= q.t WHERE n <= 3 GROUP BY ALL), r AS (SELECT q.id, q.sensor, min(h.t) AS tr FROM q JOIN h ON h.sensor = q.sensor AND h.t >= q.t WHERE n <= 3 GROUP BY ALL),
v AS (SELECT q.id, q.x, q.t, sx, CASE WHEN tr IS NULL OR tl = tr THEN a.y ELSE (SELECT a.y * (1 + 2 * z) * (1 - z) * (1 - z) + (tr - tl) * a.d * z * (1 - z) * (1 - z) + c.y * z * z * (3 - 2 * z) - (tr - tl) * c.d * z * z * (1 - z) FROM (SELECT (q.t - tl) / (tr - tl) AS z)) END AS y
  FROM q JOIN l USING (id, sensor) LEFT JOIN r USING (id, sensor) JOIN h a ON a.sensor = q.sensor AND a.t = tl LEFT JOIN h c ON c.sensor = q.sensor AND c.t = tr WHERE n <= 3)
SELECT id, round(any_value(x + 0.1 * t) + any_value(x * (2 - x)) * sum((y - sx - 0.1 * t) / (sx * (2 - sx)) / ((x - sx) * (x - sx))) / sum(1 / ((x - sx) * (x - sx))), 5) + 0.0 AS u FROM v GROUP BY id"""


@query(_TRACKED)
def sensor_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that takes what groups of users did in each hour, as sensors on a line, and keeps its values where the gate is zero."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 6).alias("sensor"), F.hour("ts").cast("double").alias("t")).agg(F.avg("value").alias("value"))
    sensors = e.select("sensor", (0.053 + F.col("sensor") * 0.17).alias("x")).distinct()
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), ((F.col("p_partkey") % 97) / 4.0).alias("t"))
    out = E.sensor_tracks(rows, sensors, e, X + 0.1 * T, X * (2.0 - X), ["x"], k=3)
    return out.select("id", (F.round("u", 5) + F.lit(0.0)).alias("u"))


@query(POINTS + """, r AS (SELECT 0 AS term, y - x AS r FROM p UNION ALL SELECT 1, 4 * x + y - x FROM p)
SELECT term, count(*) AS n, round(avg(r * r), 6) AS loss FROM r GROUP BY term UNION ALL SELECT NULL, count(*), round(avg(r * r), 6) FROM r""")
def sampled_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint on the parts at the start and at the end of a time: its points and loss by piece, and over all."""
    from axisfield.plans.sampling import SamplingConstraint
    from axisfield.sources import components as D

    domain = D.Domain((D.DatasetFactor(points(spark, sf_dir).select("id", "x", "y"), "id"), D.TimeInterval(0.0, 2.0)))
    ends = D.Union((domain.component({"t": D.FixedStart()}), domain.component({"t": D.FixedEnd()})))
    fields = {"u": X * T**2 + Y * T}
    made = SamplingConstraint.from_operator(ends, lambda u: u.diff("t") - X, "u", {"id": 0, "t": 1})
    drawn = made.points(spark).withColumn("r", made.square(fields, {}))
    out = drawn.rollup("term").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("q") * F.col("r")) / F.sum("q")).alias("loss"))
    return out.select("term", "n", F.round("loss", 6).alias("loss"))
