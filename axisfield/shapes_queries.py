"""Named queries over shapes and components: measures and boundary integrals against closed forms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.queries import POINTS, points, query, rounded, sql_of, table
from axisfield.sources import components as D
from axisfield.sources import shapes as S
from axisfield.sources.separable import separable

#: Name, shape, and its measures in closed form; the ellipsoid's surface is the spheroid's formula.
_E = math.sqrt(1 - 0.25 / 1.0)
SHAPES = {
    "line": (S.Line(-1.0, 2.0), 3.0, 2.0),
    "circle": (S.circle([0.5, -0.5], 2.0), 4 * math.pi, 4 * math.pi),
    "ellipse": (S.ellipse([0.0, 1.0], 1.0, 1.0), math.pi, 2 * math.pi),
    "rectangle": (S.rectangle([1.0, 2.0], 3.0, 0.5), 1.5, 7.0),
    "square": (S.square([0.0, 0.0], 2.0), 4.0, 8.0),
    "polygon": (S.Polygon([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]), 5.0, 12.0),
    "triangle": (S.triangle([(0, 0), (0, 3), (4, 0)]), 6.0, 12.0),
    "sphere": (S.sphere([1.0, 2.0, 3.0], 1.5), 4 / 3 * math.pi * 1.5**3, 4 * math.pi * 2.25),
    "ellipsoid": (S.Ellipsoid([0.0, 0.0, 0.0], [1.0, 1.0, 0.5]), 4 / 3 * math.pi * 0.5, 2 * math.pi * (1 + (1 - _E**2) / _E * math.atanh(_E))),
    "cuboid": (S.cuboid([0.0, 0.0, 0.0], [1.0, 2.0, 3.0]), 6.0, 22.0),
    "cube": (S.cube([0.5, 0.5, 0.5], 1.0), 1.0, 6.0),
    "cylinder": (S.cylinder([0.0, 0.0, 0.0], 2.0, 1.0), 2 * math.pi, 6 * math.pi),
    "cone": (S.Cone([0.0, 0.0, 0.0], 4.0, 3.0, 0.0), 12 * math.pi, 24 * math.pi),
    "frustum": (S.Cone([0.0, 0.0, 1.0], 4.0, 4.0, 1.0), 28 * math.pi, 42 * math.pi),
    "torus": (S.Torus([0.0, 0.0, 0.0], 2.0, 0.5), math.pi**2, 4 * math.pi**2),
    "wedge": (S.Wedge([0.0, 0.0, 0.0], [4.0, 2.0, 3.0], 0.0), 12.0, 6.0 + 10.0 + 12.0 + 8.0),
    "quarter cylinder": (S.Sweep(S.cylinder([0.0, 0.0, 0.0], 2.0, 1.0), math.pi / 2), math.pi / 2, 1.5 * math.pi + 4.0),
    "half torus": (S.Sweep(S.Torus([0.0, 0.0, 0.0], 2.0, 0.5), math.pi), math.pi**2 / 2, 2 * math.pi**2 + math.pi / 2),
    "frustum of three quarters": (S.Sweep(S.Cone([0.0, 0.0, 1.0], 4.0, 4.0, 1.0), 1.5 * math.pi), 21 * math.pi, 31.5 * math.pi + 20.0),
}

def _rounded_sql(x: str, digits: int) -> str:
    return f"round({x}, ({digits - 1} - floor(log10({x})))::INT)"


_VALUES = ", ".join(f"('{k}', {m!r}::DOUBLE, {b!r}::DOUBLE, {len(s.names)})" for k, (s, m, b) in SHAPES.items())


@query(f"""WITH s AS (SELECT shape, sum(m * pow(1 + 0.4::DOUBLE * r_regionkey, d)) AS m, sum(b * pow(1 + 0.4::DOUBLE * r_regionkey, d - 1)) AS b FROM region, (VALUES {_VALUES}) t(shape, m, b, d) GROUP BY shape)
SELECT shape, {_rounded_sql('m', 2)} AS measure, {_rounded_sql('b', 3)} AS boundary, {_rounded_sql('m', 2)} AS flux, 0::BIGINT AS off, 0::BIGINT AS outside FROM s""")
def shape_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shape's measures, summed over copies at every region's scale, from 2048 points each: inner weights, boundary weights, and the flux of the position over d.

    They are rounded to the digits that so many points have. Points off the zero set, and interior points outside, are counted.
    """
    out = None
    scales = F.broadcast(table(spark, sf_dir, "region").select((F.lit(1.0) + F.lit(0.4) * F.col("r_regionkey")).alias("s")))  # a row a region

    def digits(c, n):
        return F.round(c / F.pow(F.lit(10.0), F.floor(F.log10(c))), n - 1) * F.pow(F.lit(10.0), F.floor(F.log10(c)))

    for name, (shape, _, _) in SHAPES.items():
        n, d = 2048, len(shape.names)
        part = F.pow("s", F.lit(float(d - 1))) * F.col("w")
        ring = shape.boundary(spark, n).crossJoin(scales)
        flux = sum((F.col("s") * F.col(c) * F.col(f"n_{c}") for c in shape.names), F.lit(0.0)) * part
        edge = ring.agg(digits(F.sum(part), 3).alias("boundary"), digits(F.sum(flux) / d, 2).alias("flux"), F.sum((F.abs(shape.sdf()) > 1e-9).cast("long")).alias("off"))
        inner = shape.interior(spark, n).crossJoin(scales).agg(digits(F.sum(F.col("s") * part), 2).alias("measure"), F.sum((shape.sdf() > 1e-9).cast("long")).alias("outside"))
        one = edge.crossJoin(inner).select(F.lit(name).alias("shape"), *(F.round(c, 6).alias(c) for c in ("measure", "boundary", "flux")), "off", "outside")  # one row each
        out = one if out is None else out.union(one)
    return out


@query(sql_of({
    "ellipse": "(sqrt(x*x/4.0 + y*y/0.25) * (sqrt(x*x/4.0 + y*y/0.25) - 1)) / sqrt(x*x/16.0 + y*y/0.0625)",
    "line": "(x - 0.2) * (x - 0.7) / 0.5", "wedge": "greatest(-x, ((x - 1) * 2.0 + z) / sqrt(5.0), -y, y - 1, -z, z - 2)",
    "triangle": "CASE WHEN x + y < 1 AND x > 0 AND y > 0 THEN -least(x, y, (1 - x - y) / sqrt(2.0)) WHEN x + y >= 1 AND abs(x - y) <= 1 THEN (x + y - 1) / sqrt(2.0) WHEN y > x THEN sqrt(x*x + (y-1)*(y-1)) ELSE sqrt((x-1)*(x-1) + y*y) END"}))
def shape_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and distance functions of shapes that the signed distances leave out."""
    ellipse, line, wedge, corner = S.ellipse([0.0, 0.0], 2.0, 0.5), S.Line(0.2, 0.7), S.Wedge([0.0, 0.0, 0.0], [1.0, 1.0, 2.0], 0.0), S.triangle([(0, 0), (1, 0), (0, 1)])
    return rounded(points(spark, sf_dir), ["id"], ellipse=ellipse.sdf(), line=line.smooth_sdf(), wedge=wedge.sdf(), triangle=corner.sdf())


_CYLINDER = "sqrt(pow(greatest(a - 0.4, 0), 2) + pow(greatest(-c, c - 0.5, 0), 2)) + least(greatest(a - 0.4, -c, c - 0.5), 0)"
_END = "sqrt(b * b + pow(greatest(-{u}, {u} - 0.4, 0), 2) + pow(greatest(-c, c - 0.5, 0), 2))"


@query(f"""{POINTS}, q AS (SELECT id, x - 0.5::DOUBLE AS x, y - 0.8::DOUBLE AS y, z - 0.25::DOUBLE AS c, z - 0.5::DOUBLE AS m, sqrt(pow(x - 0.5, 2) + pow(y - 0.8::DOUBLE, 2)) AS a FROM p),
r AS (SELECT *, {_CYLINDER} AS cylinder, least({_END.replace("b * b", "y * y").format(u="x")}, {_END.replace("b * b", "x * x").format(u="y")}) AS ends,
  sqrt(pow(a - 0.35, 2) + m * m) - 0.15 AS torus, sqrt(y * y + pow(greatest(0, sqrt(pow(abs(x) - 0.35, 2) + m * m) - 0.15), 2)) AS ring_ends FROM q)
SELECT id, round(CASE WHEN x >= 0 AND y >= 0 THEN CASE WHEN cylinder <= 0 THEN -least(-cylinder, ends) ELSE cylinder END ELSE ends END, 6) + 0.0 AS quarter,
  round(CASE WHEN y >= 0 THEN CASE WHEN torus <= 0 THEN -least(-torus, ring_ends) ELSE torus END ELSE ring_ends END, 6) + 0.0 AS half FROM r""")
def swept_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distances to a quarter of a cylinder and half a torus."""
    quarter = S.Sweep(S.cylinder([0.5, 0.8, 0.25], 0.5, 0.4), math.pi / 2)
    half = S.Sweep(S.Torus([0.5, 0.8, 0.5], 0.35, 0.15), math.pi)
    return rounded(points(spark, sf_dir), ["id"], quarter=quarter.sdf(), half=half.sdf())


@query("""
WITH x AS (SELECT -1 + (i + 0.5::DOUBLE) / 12 AS x, 1 / 12::DOUBLE AS w FROM generate_series(0, 23) g(i)), y AS (SELECT x AS y, w AS v FROM x),
t AS (SELECT 3 * i / 8::DOUBLE AS t, 3 / 8::DOUBLE AS u FROM generate_series(0, 7) g(i)),
d AS (SELECT x, y, w * v AS w FROM x, y WHERE sqrt(x * x + y * y) - 1 < -1e-6 AND x > 0)
SELECT n_regionkey, round(sum(w * u * sin(x) * y * y * exp(-t) * (1 + n_nationkey)), 6) AS value, round(sum(w * u), 6) AS weight FROM d, t, nation GROUP BY n_regionkey""")
def separable_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a disk by axes with one mask, time by an axis, and nations as rows: integrals by region, with fields evaluated on their own axes."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    domain = D.Domain((D.ShapeFactor(S.circle([0.0, 0.0], 1.0)), D.TimeInterval(0.0, 3.0), D.DatasetFactor(nations, "n_nationkey", "count")))
    laid = separable(domain.component(where={"x": F.col("x") > 0}), spark, {"x": ("sine", 24), "y": ("sine", 24), "t": ("fourier", 8)})
    laid = laid.on("x", {"wave": F.sin("x")}).on("t", {"fading": F.exp(-F.col("t"))})
    out = laid.integrals({"value": F.col("wave") * F.col("y") * F.col("y") * F.col("fading") * (1 + F.col("n_nationkey")), "weight": F.lit(1.0)}, ["n_regionkey"])
    return out.select("n_regionkey", F.round("value", 6).alias("value"), F.round("weight", 6).alias("weight"))


#: A disk over three units of time: measure of each component, and the integral of its query's integrand.
_COMPONENTS = {"interior": (3 * math.pi, 6 * math.pi), "boundary": (6 * math.pi, math.pi * 4.5), "start": (math.pi, math.pi / 2), "end": (math.pi, 3.5 * math.pi), "at": (math.pi, 2.5 * math.pi), "ends": (2 * math.pi, 1.5 * math.pi), "masked": (math.pi, math.pi)}


@query("SELECT component, round(sum(m * (1 + r_regionkey)), 0) AS total, round(sum(v * (1 + r_regionkey)) / 10, 0) AS v FROM region, (VALUES " + ", ".join(f"('{k}', {m!r}::DOUBLE, {v!r}::DOUBLE)" for k, (m, v) in _COMPONENTS.items()) + ") t(component, m, v) GROUP BY component")
def component_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disk over time: interior, boundary, fixed times, both ends, and a masked and weighted part: sums over their points and all regions' shares, to the digits these have."""
    shares = F.broadcast(table(spark, sf_dir, "region").select((F.lit(1.0) + F.col("r_regionkey")).alias("s")))  # a row a region
    disk = D.Domain((D.ShapeFactor(S.circle([0.0, 0.0], 1.0)), D.TimeInterval(0.0, 3.0)))
    r2, t = F.col("x") * F.col("x") + F.col("y") * F.col("y"), F.col("t")
    cases = {
        "interior": (disk.component(), r2 + t), "boundary": (disk.component({"x": D.Boundary()}), F.col("n_x") * F.col("x") * t),
        "start": (disk.component({"t": D.FixedStart()}), r2 + t), "end": (disk.component({"t": D.FixedEnd()}), r2 + t), "at": (disk.component({"t": D.Fixed(2.0)}), r2 + t),
        "ends": (disk.component({"t": D.Boundary()}), r2 * F.col("n_t") * t), "masked": (disk.component(where={"x": F.col("x") > 0}, where_all=t < 1, weight_all=F.lit(2.0)), F.lit(1.0)),
    }
    out = None
    for name, (component, f) in cases.items():
        p = component.points(spark, {"x": 512, "t": 512})
        found = component.integrals(p.crossJoin(shares), {"v": f * F.col("s"), "total": F.col("s")})
        one = found.select(F.lit(name).alias("component"), F.round("total", 0).alias("total"), F.round(F.col("v") / 10, 0).alias("v"))
        out = one if out is None else out.union(one)
    return out


@query("""
SELECT round(sum(c_acctbal) / count(*), 4) AS mean, round(sum(c_acctbal), 2) AS total, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END), 4) AS masked FROM customer""")
def dataset_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as a factor, by probability and by count, with a mask."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    share, each = (D.Domain((D.DatasetFactor(rows, "c_custkey", kind),)) for kind in ("probability", "count"))
    mean = share.component().integrals(share.component().points(spark, 0), {"mean": F.col("c_acctbal")})
    total = each.component().integrals(each.component().points(spark, 0), {"total": F.col("c_acctbal")})
    part = share.component(where_all=F.col("c_mktsegment") == "BUILDING")
    masked = part.means(part.points(spark, 0), {"masked": F.col("c_acctbal")})
    return mean.crossJoin(total).crossJoin(masked).select(F.round("mean", 4).alias("mean"), F.round("total", 2).alias("total"), F.round("masked", 4).alias("masked"))  # one row each


@query("WITH s AS (SELECT sum(1 + n_regionkey) AS s FROM nation) SELECT term, s * m AS measure FROM s, (VALUES (NULL::INT, 14.0::DOUBLE), (0, 8.0), (1, 6.0)) t(term, m)")
def product_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary of a rectangle over time, its edges at all times and all of it at both ends, weighed by the nations' shares."""
    domain = D.Domain((D.ShapeFactor(S.rectangle([0.0, 0.0], 1.0, 3.0)), D.TimeInterval(0.0, 1.0), D.DatasetFactor(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "count")))
    out = domain.boundary().integrals(spark, {"x": 300, "t": 10, "n_nationkey": 0}, {"measure": F.lit(1.0) + F.col("n_regionkey")})
    return out.select("term", F.round("measure", 6).alias("measure"))
