"""Named queries over planar regions: borders, points, distances and blurs of a region made from the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisfield.plans.tables import dealt, written
from axisfield.queries import query, rounded, table
from axisfield.sources import clouds
from axisfield.sources import planar as P

#: One frame a part: a square with a square hole, in a lattice; sizes are the parts'.
_FRAMES = "WITH f AS (SELECT p_partkey AS id, 4.0 * (p_partkey % 31) AS cx, 4.0 * (p_partkey // 31) AS cy, 0.6 + p_size / 50.0 AS h, 0.2 + (p_partkey % 7) / 20.0 AS k FROM part)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight triangles a part, every second one turned to the right."""
    key = F.col("p_partkey")
    at = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select((4.0 * (key % 31)).alias("cx"), (4.0 * F.floor(key / 31)).alias("cy"), (0.6 + F.col("p_size") / 50.0).alias("h"), (0.2 + (key % 7) / 20.0).alias("k"))
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    corner = lambda which, s: [F.col("cx") + F.col(which) * s[0], F.col("cy") + F.col(which) * s[1]]
    out = []
    for j in range(4):
        a, b = signs[j], signs[(j + 1) % 4]
        for trio in ((corner("h", a), corner("h", b), corner("k", b)), (corner("h", a), corner("k", a), corner("k", b))):
            out.append(F.struct(*(v.alias(f"{c}{i}") for i, spot in enumerate(trio) for c, v in zip("xy", spot, strict=True))))
    return at.select(F.explode(F.array(*out)).alias("t")).select("t.*")


@query(_FRAMES + """
SELECT cx, cy, true AS outer_loop, 4::BIGINT AS edges, round(8 * h, 6) AS length, round(4 * h * h, 6) AS area FROM f
UNION ALL SELECT cx, cy, false, 4, round(8 * k, 6), round(-4 * k * k, 6) FROM f""")
def planar_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders as loops: outer ones turn to the left, holes to the right."""
    rings = P.loops(P.boundary_edges(frames(spark, sf_dir)))
    part = (F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    # the place numbers must be those of a chain: the end of one edge is the start of the next
    out = rings.groupBy("loop").agg(F.avg("x0").alias("cx"), F.avg("y0").alias("cy"), F.max("place").alias("last"), F.sum("length").alias("length"), F.sum(part).alias("area"))
    return out.select(F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), (F.col("area") > 0).alias("outer_loop"), (F.col("last") + 1).alias("edges"), F.round("length", 6).alias("length"), F.round("area", 6).alias("area"))


@query(_FRAMES + " SELECT 5 * count(*) AS n, round(sum(4 * h * h - 4 * k * k), 4) AS area, 5 * count(*) AS inside FROM f")
def planar_interior_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points a part by area: their weights' sum, and how many lie in a part's frame."""
    n = 5 * table(spark, sf_dir, "part").count()
    dx, dy = F.abs(F.pmod(F.col("x") + 2, F.lit(4.0)) - 2), F.abs(F.pmod(F.col("y") + 2, F.lit(4.0)) - 2)
    points = P.interior_points(frames(spark, sf_dir), n)
    # frames are joined by their place in the lattice
    key = F.floor((F.col("y") + 2) / 4) * 31 + F.floor((F.col("x") + 2) / 4)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (0.6 + F.col("p_size") / 50.0).alias("h"), (0.2 + (F.col("p_partkey") % 7) / 20.0).alias("k"))
    met = points.withColumn("key", key).join(parts, "key", "left")
    inside = (F.greatest(dx, dy) <= F.col("h") + 1e-9) & (F.greatest(dx, dy) >= F.col("k") - 1e-9)
    return met.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("area"), F.sum(inside.cast("long")).alias("inside"))


@query(_FRAMES + " SELECT 6 * count(*) AS n, round(sum(8 * h + 8 * k), 4) AS length, 0.0::DOUBLE AS off, 0::BIGINT AS inward FROM f")
def planar_boundary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six points a part on the border: their weights' sum, their distance from it, and normals that lead inside after a tiny step."""
    edges = written(P.boundary_edges(frames(spark, sf_dir)))
    points = P.boundary_points(edges, 6 * table(spark, sf_dir, "part").count())
    stepped = points.withColumns({"x": F.col("x") + 1e-7 * F.col("n_x"), "y": F.col("y") + 1e-7 * F.col("n_y")}).drop("n_x", "n_y")
    out = P.with_planar_distance(stepped, edges)
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("length"), F.round(F.max(F.abs("distance")), 6).alias("off"), F.sum((F.col("distance") <= 0).cast("long")).alias("inward"))


_PLACES = "SELECT c_custkey, 0.37 + c_custkey * 7 % 1217 / 10.0 AS x, (c_acctbal + 1000) / 100.0 AS y FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (0.37 + F.col("c_custkey") * 7 % 1217 / 10.0).alias("x"), ((F.col("c_acctbal") + 1000) / 100.0).alias("y"))


def _distance_sql(x: str, y: str) -> str:
    """To a frame: outside of its square, inside of its hole, or between."""
    dx, dy = f"abs({x} - cx)", f"abs({y} - cy)"
    out = f"sqrt(pow(greatest({dx} - h, 0), 2) + pow(greatest({dy} - h, 0), 2))"
    return f"min(CASE WHEN greatest({dx}, {dy}) >= h THEN {out} WHEN greatest({dx}, {dy}) <= k THEN k - greatest({dx}, {dy}) ELSE -least(h - greatest({dx}, {dy}), sqrt(pow(greatest({dx} - k, 0), 2) + pow(greatest({dy} - k, 0), 2))) END)"


@query(f"{_FRAMES}, q AS ({_PLACES}) SELECT c_custkey, round({_distance_sql('x', 'y')}, 6) + 0.0 AS distance FROM q, f GROUP BY c_custkey")
def planar_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' signed distances to a region with holes."""
    return rounded(P.with_planar_distance(_customers(spark, sf_dir), P.boundary_edges(frames(spark, sf_dir))), ["c_custkey"], distance="distance")


_RULE = P.disk_offsets()
_WHOLE = sum(e["w"] for e in _RULE)
_OFFSETS = "o(u, v, w) AS (VALUES " + ", ".join(f"({e['u']!r}::DOUBLE, {e['v']!r}::DOUBLE, {e['w'] / _WHOLE!r}::DOUBLE)" for e in _RULE) + ")"


@query(f"""
WITH {_OFFSETS}, q AS (SELECT p_partkey AS id, p_size / 50.0 AS x, p_retailprice / 2000.0 AS y FROM part), r AS (SELECT *, greatest(sqrt(pow(x - 0.3, 2) + 1e-12) - 1e-6, 1e-3) AS r FROM q)
SELECT id, round(sum(w * (x + r * u - 0.3)), 6) + 0.0 AS half_plane, round(sum(w * sin(3 * (x + r * u)) * (y + r * v)), 6) + 0.0 AS wave FROM r, o GROUP BY id""")
def blurred_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields blurred over disks whose radius is each point's distance from a line: that distance itself, and a wave."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 2000.0).alias("y"))
    radius = P.blur_radius(F.col("x") - 0.3)
    return rounded(p, ["id"], half_plane=P.blurred(radius, lambda x, y: x - 0.3), wave=P.blurred(radius, lambda x, y: F.sin(3.0 * x) * y))


@query(f"""
{_FRAMES}, {_OFFSETS}, q AS ({_PLACES}), d AS (SELECT c_custkey, x, y, {_distance_sql('x', 'y')} AS d FROM q, f GROUP BY ALL),
m AS (SELECT c_custkey, w, x + greatest(sqrt(d * d + 1e-12) - 1e-6, 1e-3) * u AS x, y + greatest(sqrt(d * d + 1e-12) - 1e-6, 1e-3) * v AS y FROM d, o),
e AS (SELECT c_custkey, w, x, y, {_distance_sql('x', 'y')} AS d FROM m, f GROUP BY ALL)
SELECT c_custkey, round(sum(w * d), 6) + 0.0 AS distance FROM e GROUP BY c_custkey""")
def planar_blurred_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance to the region blurred over each customer's own disk."""
    return rounded(P.with_blurred_distance(_customers(spark, sf_dir), P.boundary_edges(frames(spark, sf_dir))), ["c_custkey"], distance="distance")


@query("WITH f AS (SELECT 0.3 + p_size / 250.0 AS s FROM part) SELECT 18 * count(*) AS triangles, round(sum(9 * s * s), 4) AS area, round(sum(12 * s), 4) AS length, count(*) AS loops FROM f")
def planar_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen points a part, on a grid as wide as the part's size: the region they fill, its border and its loops."""
    key = F.col("p_partkey")
    at = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select((4.0 * (key % 31)).alias("cx"), (4.0 * F.floor(key / 31)).alias("cy"), (0.3 + F.col("p_size") / 250.0).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    cloud = at.select((F.col("cx") + F.col("s") * (F.col("k") % 4)).alias("x"), (F.col("cy") + F.col("s") * F.floor(F.col("k") / 4)).alias("y"))
    faces = written(clouds.triangulated(cloud, 0.45))
    inner = faces.agg(F.count(F.lit(1)).alias("triangles"), F.round(F.sum(F.abs(P.signed_area())), 4).alias("area"))
    rings = P.loops(P.boundary_edges(faces)).agg(F.round(F.sum("length"), 4).alias("length"), F.countDistinct("loop").alias("loops"))
    return inner.crossJoin(rings)  # one row each
