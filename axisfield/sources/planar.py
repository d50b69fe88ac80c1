"""Planar regions as tables of triangles (x0, y0, x1, y1, x2, y2): borders, loops, points, distances, blurs.

Corners are the same where their numbers are. Triangles of no area, or with a null corner, count as absent. All steps are joins and aggregations
on triangles or edges; a border of any length is chained by doubling, so no task walks along it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisfield.operators import nearby
from axisfield.operators.rules import rule_sum
from axisfield.plans.tables import met, written
from axisfield.sources.samplers import unit

CORNERS = tuple(f"{c}{k}" for k in range(3) for c in "xy")
ENDS = ("x0", "y0", "x1", "y1")


def signed_area() -> Column:
    return ((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / F.lit(2.0)


def oriented(faces: DataFrame) -> DataFrame:
    """(the corners, area) of each triangle, turned to the left."""
    turned = {c: F.col(c) for c in CORNERS} | {f"{c}{k}": F.when(F.col("__a") < 0, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")) for k in (1, 2) for c in "xy"}
    plain = faces.select(*((F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in CORNERS))
    return plain.withColumn("__a", signed_area()).where("__a != 0").select(*(v.alias(c) for c, v in turned.items()), F.abs("__a").alias("area"))


def _sides(faces: DataFrame) -> DataFrame:
    """(ends, faces) of each edge: how many triangles have it, and its ends as the first of them has them.

    The lesser end and the greater are the key and the direction one number, so that edges are counted by hash in rows of a fixed width.
    """
    pairs = [F.struct(*(F.col(f"{c}{j}").alias(e) for e, (j, c) in zip(ENDS, ((j, c) for j in (k, (k + 1) % 3) for c in "xy"), strict=True))) for k in range(3)]
    each = oriented(faces).select(F.explode(F.array(*pairs)).alias("e")).select("e.*")
    along = (F.col("x0") < F.col("x1")) | ((F.col("x0") == F.col("x1")) & (F.col("y0") <= F.col("y1")))
    key = [F.when(along, F.col(a)).otherwise(F.col(b)).alias(f"__{a}") for a, b in zip(ENDS, (*ENDS[2:], *ENDS[:2]), strict=True)]
    sums = each.select(*key, along.cast("int").alias("__along")).groupBy(*(f"__{a}" for a in ENDS)).agg(F.count(F.lit(1)).alias("faces"), F.max("__along").alias("__along"))
    return sums.select("faces", *(F.when(F.col("__along") == 1, F.col(f"__{a}")).otherwise(F.col(f"__{b}")).alias(a) for a, b in zip(ENDS, (*ENDS[2:], *ENDS[:2]), strict=True)))


def _ends(sides: DataFrame) -> DataFrame:
    return sides.select(*ENDS).withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def boundary_edges(faces: DataFrame) -> DataFrame:
    """(x0, y0, x1, y1, length) of the edges that one triangle has; the region is on their left."""
    return _ends(_sides(faces).where("faces = 1"))


def interior_edges(faces: DataFrame) -> DataFrame:
    return _ends(_sides(faces).where("faces > 1"))


def outward() -> list[Column]:
    """The unit normal of an edge that has the region on its left."""
    return [(F.col("y1") - F.col("y0")) / F.col("length"), (F.col("x0") - F.col("x1")) / F.col("length")]


def loops(edges: DataFrame) -> DataFrame:
    """The edges with their loop (the least edge's number), the place in it from 0 on, and the length of the loop before them.

    An edge is followed by the one that leaves its end; where several do, by the next clockwise from its own back, which keeps regions
    that touch in a point apart. Loops and places come from doubling the step: the number of rounds is the logarithm of the longest loop's edges.
    Edges that end nowhere are an error.
    """
    own = written(edges.select(*ENDS, "length").orderBy(*ENDS).withColumn("edge", F.monotonically_increasing_id()))
    leaves = own.select(F.col("edge").alias("next"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("__to"))
    back = F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1"))
    turn = F.pmod(back - F.col("__to"), F.lit(2 * math.pi))
    followed = met(own, leaves, ["x1", "y1"], "left").groupBy("edge").agg(F.min_by("next", F.when(turn <= 1e-12, 2 * math.pi).otherwise(turn)).alias("next"))
    gap = F.when(F.col("next").isNull(), F.raise_error(F.lit("an edge is followed by none: the mesh has no closed border")).cast("long")).otherwise(F.col("next"))
    steps = written(followed.select("edge", gap.alias("next"), F.col("edge").alias("least")))
    first, before = steps, None
    while True:
        seen = steps.agg(F.sum(F.col("least").cast("decimal(38,0)"))).first()[0]
        if seen == before:
            break
        before = seen
        ahead = steps.select(F.col("edge").alias("next"), F.col("next").alias("__next"), F.col("least").alias("__least"))
        steps = written(met(steps, ahead, "next").select("edge", F.col("__next").alias("next"), F.least("least", "__least").alias("least")))
    named = met(met(first.select("edge", "next"), steps.select("edge", F.col("least").alias("loop")), "edge"), own.select("edge", "length"), "edge")
    # how far it is to the loop's least edge: the steps stop there
    ranks = written(named.select("edge", "loop", F.when(F.col("next") == F.col("loop"), F.lit(None)).otherwise(F.col("next")).alias("next"), F.lit(1).cast("long").alias("steps"), F.col("length").alias("far")))
    while ranks.where("next is not null").limit(1).count():
        ahead = ranks.select(F.col("edge").alias("next"), F.col("next").alias("__next"), F.col("steps").alias("__steps"), F.col("far").alias("__far"))
        ranks = written(met(ranks, ahead, "next", "left").select("edge", "loop", F.col("__next").alias("next"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), (F.col("far") + F.coalesce("__far", F.lit(0.0))).alias("far")))
    whole = ranks.groupBy("loop").agg(F.max("steps").alias("edges"), F.max("far").alias("__whole"))
    placed = met(ranks, whole, "loop").select("edge", "loop", (F.col("edges") - F.col("steps")).alias("place"), (F.col("__whole") - F.col("far")).alias("before"))
    return met(own, placed, "edge").select("loop", "place", *ENDS, "length", "before")


def spread(rows: DataFrame, weight: str, n: int, seed: int = 0) -> DataFrame:
    """Rows repeated to exactly n draws in proportion to a weight, as evenly as can be: each within one draw of its share.

    Weights become whole numbers and are summed in buckets of rows, whose sums are few; each row then knows which of n even steps
    along the whole sum fall to it. So there is no join of draws with rows, and no task sees all rows. Adds draw and w, the weight's sum over n.
    Rows alike in all columns have their shares one after the other; rows of no weight, or null, are never drawn; columns named like a result are replaced.
    """
    kept = [c for c in rows.columns if c not in ("draw", "w")]
    total = rows.agg(F.sum(weight), F.count(F.lit(1))).first()
    whole, count = total[0] or 0.0, total[1]
    if whole <= 0:
        raise ValueError("the weights add up to nothing")
    buckets = max(1, count // 100_000)
    units = F.floor(F.coalesce(F.col(weight), F.lit(0.0)) / F.lit(float(whole)) * F.lit(float(1 << 50))).cast("long")
    dealt = rows.withColumns({"__units": units, "__bucket": F.pmod(F.xxhash64(*kept), F.lit(buckets)).cast("int")})
    sums = dealt.groupBy("__bucket").agg(F.sum("__units").alias("__sum"))
    # one small row for every 100,000
    until = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__bucket", F.coalesce(F.sum("__sum").over(until), F.lit(0)).alias("__start"), F.sum("__sum").over(Window.partitionBy()).alias("__all"))
    inner = Window.partitionBy("__bucket").orderBy(*kept)
    placed = dealt.join(F.broadcast(starts), "__bucket").withColumns({
        "__from": F.col("__start") + F.coalesce(F.sum("__units").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__to": F.col("__start") + F.sum("__units").over(inner.rowsBetween(Window.unboundedPreceding, 0)),
    })
    start = unit(F.lit("start"), F.lit(seed))
    # the same number at a border that two rows share
    step = lambda at: F.ceil(F.col(at) * F.lit(float(n)) / F.col("__all") - start).cast("long")
    each = placed.withColumns({"__a": step("__from"), "__b": step("__to")}).where("__a < __b")
    return each.withColumn("draw", F.explode(F.sequence(F.col("__a"), F.col("__b") - 1))).select(*kept, "draw", F.lit(float(whole) / n).alias("w"))


def interior_points(faces: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(draw, x, y, w): exactly n points inside, by area; the weights sum to the area."""
    u, v = unit(F.col("draw"), F.lit(1), F.lit(seed)), unit(F.col("draw"), F.lit(2), F.lit(seed))
    a, b = F.when(u + v > 1, 1 - u).otherwise(u), F.when(u + v > 1, 1 - v).otherwise(v)
    at = [(F.col(f"{c}0") + a * (F.col(f"{c}1") - F.col(f"{c}0")) + b * (F.col(f"{c}2") - F.col(f"{c}0"))).alias(c) for c in "xy"]
    return spread(oriented(faces), "area", n, seed).select("draw", *at, "w")


def boundary_points(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(draw, x, y, n_x, n_y, w): exactly n points on the border, by length, with outward normals; the weights sum to the length."""
    u = unit(F.col("draw"), F.lit(3), F.lit(seed))
    at = [(F.col(f"{c}0") + u * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in "xy"]
    return spread(edges.select(*ENDS, "length"), "length", n, seed).select("draw", *at, *(c.alias(k) for c, k in zip(outward(), ("n_x", "n_y"), strict=True)), "w")


@dataclass
class Border:
    """Edges with their number and the outward directions at their ends and along them, written, and their tiles: made once for several looks."""

    edges: DataFrame
    tiles: nearby.Tiles

    columns = (*ENDS, "ca0", "cb0", "ca1", "cb1", "a", "b")

    @classmethod
    def of(cls, edges: DataFrame) -> Border:
        own = written(edges.select(*ENDS, "length").orderBy(*ENDS).withColumn("__edge", F.monotonically_increasing_id()))
        tiles = nearby.tiled(own, "__edge", nearby.Kind((("x0", "y0"), ("x1", "y1"))))
        if not len(tiles.counts):
            raise ValueError("the region has no border")
        n = outward()
        ends = F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), F.col(f"x{k}").alias("cx"), F.col(f"y{k}").alias("cy")) for k in (0, 1))))
        each = own.select("__edge", n[0].alias("a"), n[1].alias("b"), ends.alias("s")).select("__edge", "a", "b", "s.*")
        corner = each.groupBy("cx", "cy").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        at = lambda k, c: F.max(F.when(F.col("slot") == k, F.col(c)))
        sides = met(each, corner, ["cx", "cy"]).groupBy("__edge").agg(*(at(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("ca", "cb")), F.first("a").alias("a"), F.first("b").alias("b"))
        return cls(written(met(own.drop("length"), sides, "__edge")), tiles)


def with_planar_distance(rows: DataFrame, edges: DataFrame | Border, names: tuple[str, str] = ("x", "y"), into: str = "distance") -> DataFrame:
    """Adds the signed distance to a region's border (edges with the region on their left), negative inside, and the outward direction (n_x, n_y).

    Edges are found by tiles (`nearby`). At a corner the directions of both edges are added. Points without a place have nulls.
    """
    made = [into, "n_x", "n_y"]
    kept = [c for c in rows.columns if c not in made]
    asked = nearby.numbered(rows.select(*(F.col(f"`{c}`") for c in kept)))
    border = edges if isinstance(edges, Border) else Border.of(edges)
    places = asked.select(F.col("__row").alias("row"), *(F.col(a).cast("double").alias(b) for a, b in zip(names, "xy", strict=True)))
    columns = list(border.columns)
    full = met(met(nearby.nearest(places, "xy", border.tiles).select("row", F.col("item").alias("__edge")), border.edges, "__edge"), places, "row")

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, e = nearby._matrix(batch, "xy"), nearby._matrix(batch, columns)
            foot, feature = nearby.feet(p, e[:, :4].reshape(-1, 2, 2))
            normal = e[:, 4:].reshape(-1, 3, 2)[np.arange(len(p)), np.minimum(feature, 2)]
            normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)
            away = p - foot
            d = np.linalg.norm(away, axis=1) * np.where((away * normal).sum(axis=1) < 0, -1.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(d), pa.array(normal[:, 0]), pa.array(normal[:, 1])], names=["__row", *made])

    signed = full.select("row", "x", "y", *columns).mapInArrow(side, "__row long, " + ", ".join(f"{c} double" for c in made))
    return met(asked, signed, "__row", "left").select(*(F.col(f"`{c}`") for c in kept), *made)


def disk_offsets(n: int = 6, spread_by: float = 0.69420) -> list[dict[str, float]]:
    """Offsets (u, v) on the unit disk along a spiral of even areas, with Gaussian weights of deviation `spread_by` and the middle itself."""
    turn = math.pi * (3 - math.sqrt(5))
    spots = [(math.sqrt((k + 0.5) / n), turn * k) for k in range(n)]
    return [{"u": 0.0, "v": 0.0, "w": 1.0}, *({"u": r * math.cos(a), "v": r * math.sin(a), "w": math.exp(-r * r / (2 * spread_by**2))} for r, a in spots)]


def blur_radius(distance: Column, soft: float = 1e-6, least: float = 1e-3) -> Column:
    """A radius that grows with the distance from the border."""
    return F.greatest(F.sqrt(distance * distance + F.lit(soft * soft)) - F.lit(soft), F.lit(least))


def blurred(radius: Column, field: Callable[[Column, Column], Column], names: Sequence[str] = ("x", "y"), offsets: Sequence[dict[str, float]] | None = None) -> Column:
    """The weighted mean of a field over a row's own disk: one sum in the row, no join."""
    rule = list(offsets or disk_offsets())
    whole = sum(e["w"] for e in rule)
    return rule_sum([{**e, "w": e["w"] / whole} for e in rule], lambda e: e["w"] * field(F.col(names[0]) + radius * e["u"], F.col(names[1]) + radius * e["v"]))


def with_blurred_distance(rows: DataFrame, edges: DataFrame, names: tuple[str, str] = ("x", "y"), into: str = "distance", offsets: Sequence[dict[str, float]] | None = None) -> DataFrame:
    """Adds the distance to a border, blurred over a disk of each point's own distance: each point of the disk is looked up by tiles."""
    rule = list(offsets or disk_offsets())
    whole = sum(e["w"] for e in rule)
    border = Border.of(edges)
    near = nearby.numbered(with_planar_distance(rows, border, names, into="__d").drop("n_x", "n_y"))
    spots = F.array(*(F.struct(*(F.lit(float(e[k])).alias(k) for k in ("u", "v")), F.lit(e["w"] / whole).alias("w")) for e in rule))
    radius = blur_radius(F.col("__d"))
    moved = near.select(F.col("__row").alias("__of"), *(F.col(c).cast("double").alias(c) for c in names), radius.alias("__r"), F.explode(spots).alias("__e")).select("__of", *((F.col(c) + F.col("__r") * F.col(f"__e.{k}")).alias(c) for c, k in zip(names, "uv", strict=True)), F.col("__e.w").alias("w"))
    means = with_planar_distance(moved, border, names, into="__s").groupBy("__of").agg(F.sum(F.col("w") * F.col("__s")).alias(into)).withColumnRenamed("__of", "__row")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != into]
    return met(near.drop(into), means, "__row", "left").select(*kept, into)
