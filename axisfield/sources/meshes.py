"""Triangle meshes as tables of vertices (vid, x, y, z) and faces (fid, i, j, k), and points on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisfield.operators import nearby
from axisfield.plans.tables import met, written

XYZ = ("x", "y", "z")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces (polygons as fans) of Wavefront files, each with its file's path as `mesh`."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("mesh"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    parts = lines.withColumn("p", F.split(F.trim("value"), r"\s+"))
    at = Window.partitionBy("mesh").orderBy("line")
    v = parts.where(F.col("p")[0] == "v").select("mesh", F.row_number().over(at).cast("long").alias("vid"), *(F.col("p")[k + 1].cast("double").alias(c) for k, c in enumerate(XYZ)))
    # a negative number counts back from the vertices above the face
    above = F.count(F.when(F.col("p")[0] == "v", 1)).over(at.rowsBetween(Window.unboundedPreceding, 0))
    number = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda s: F.split(s, "/")[0].cast("long"))
    corners = F.transform("n", lambda k: F.when(k < 0, F.col("above") + k + 1).otherwise(k))
    faces = parts.withColumn("above", above).where(F.col("p")[0] == "f").withColumn("n", number).select("mesh", "line", corners.alias("c"))
    fans = faces.select("mesh", "line", "c", F.explode(F.sequence(F.lit(2), F.size("c") - 1)).alias("n"))
    return v, fans.select("mesh", F.row_number().over(Window.partitionBy("mesh").orderBy("line", "n")).cast("long").alias("fid"), F.col("c")[0].alias("i"), F.element_at("c", F.col("n")).alias("j"), F.element_at("c", F.col("n") + 1).alias("k"))


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """(mesh, fid, x0..z2): the corners of each face of binary STL files."""
    names = [f"{c}{k}" for k in range(3) for c in XYZ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("normal", "<f4", 3), ("corner", "<f4", 9), ("more", "<u2")])
        for batch in batches:
            for mesh, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                n = int.from_bytes(data[80:84], "little")
                if len(data) < 84 + n * kind.itemsize:
                    raise ValueError(f"{mesh} is not a binary STL file")
                corner = np.frombuffer(data, kind, n, 84)["corner"].astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([mesh] * n), pa.array(np.arange(n)), *(pa.array(corner[:, k]) for k in range(9))], names=["mesh", "fid", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "mesh string, fid long, " + ", ".join(f"{c} double" for c in names))


def corners(faces: DataFrame, vertices: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Faces with the coordinates x0..z2 of their corners."""
    out = faces
    for k, c in enumerate("ijk"):
        out = out.join(vertices.select(*keys, F.col("vid").alias(c), *(F.col(n).alias(f"{n}{k}") for n in XYZ)), [*keys, c])
    return out


def moved(vertices: DataFrame, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), factor: float = 1.0) -> DataFrame:
    return vertices.withColumns({c: F.col(c) * F.lit(factor) + F.lit(o) for c, o in zip(XYZ, offset, strict=True)})


def normal() -> list[Column]:
    """The area vector of a face with corners: its length is twice the area."""
    a, b = ([F.col(f"{c}{k}") - F.col(f"{c}0") for c in XYZ] for k in (1, 2))
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def area() -> Column:
    return F.sqrt(sum((c * c for c in normal()), F.lit(0.0))) / F.lit(2.0)


def volume_part() -> Column:
    """A face's part of the enclosed volume; faces turn outwards."""
    return sum((F.col(f"{c}0") * n for c, n in zip(XYZ, normal(), strict=True)), F.lit(0.0)) / F.lit(6.0)


def surface_points(faces: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n points by area on faces with corners, with weights that sum to the area exactly.

    Each face gets the whole part of its share and, by a hash of its id, one more with the rest as odds
    (always at least one, so that no face is lost); its points share its area. No draw needs the whole table.
    """
    total = faces.agg(F.sum(area()).alias("__t"))
    shared = faces.withColumn("__area", area()).crossJoin(F.broadcast(total))  # one row
    share = F.col("__area") * F.lit(float(n)) / F.col("__t")
    unit = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    count = F.greatest(F.lit(1), F.floor(share + unit(F.col("fid"))).cast("int"))
    each = shared.where("__area > 0").withColumn("__n", count).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    u, v = unit(F.col("fid"), F.col("draw"), F.lit(1)), unit(F.col("fid"), F.col("draw"), F.lit(2))
    a, b = F.when(u + v > 1, 1 - u).otherwise(u), F.when(u + v > 1, 1 - v).otherwise(v)
    at = [(F.col(f"{c}0") + a * (F.col(f"{c}1") - F.col(f"{c}0")) + b * (F.col(f"{c}2") - F.col(f"{c}0"))).alias(c) for c in XYZ]
    return each.select("fid", "draw", *at, (F.col("__area") / F.col("__n")).alias("w"))


def _keyed(faces: DataFrame) -> DataFrame:
    """Faces of some area with a unique `__face`."""
    return written(faces.where(area() > 0).select(*(F.col(f"{c}{k}").cast("double").alias(f"{c}{k}") for k in range(3) for c in XYZ)).orderBy(*(f"{c}{k}" for k in range(3) for c in XYZ)).withColumn("__face", F.monotonically_increasing_id()))


def feature_normals(faces: DataFrame) -> DataFrame:
    """(__face, normals): outward directions at a face's features: its three corners, the three edges after them, its inside.

    At a corner the normals of the faces that meet there are weighted by their angles, at an edge they are added; so the side of a point is
    right whichever of several equally near faces is taken. Corners are the same where their numbers are.
    """
    length = F.sqrt(sum((c * c for c in normal()), F.lit(0.0)))
    unit = F.array(*(c / length for c in normal()))
    corner = [F.array(*(F.col(f"{c}{k}") for c in XYZ)) for k in range(3)]

    def angle(k: int) -> Column:
        a, b = ([F.col(f"{c}{(k + j) % 3}") - F.col(f"{c}{k}") for c in XYZ] for j in (1, 2))
        dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
        sizes = F.sqrt(sum((x * x for x in a), F.lit(0.0)) * sum((x * x for x in b), F.lit(0.0)))
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / sizes)))

    # -0.0 and 0.0 are one place
    plain = lambda c: F.transform(c, lambda x: x + F.lit(0.0))
    spots = [F.struct(F.lit(k).alias("slot"), plain(corner[k]).alias("at"), angle(k).alias("w")) for k in range(3)]
    edges = [F.struct(F.lit(3 + k).alias("slot"), plain(F.flatten(F.array_sort(F.array(corner[k], corner[(k + 1) % 3])))).alias("at"), F.lit(1.0).alias("w")) for k in range(3)]
    each = faces.select("__face", unit.alias("n"), F.explode(F.array(*spots, *edges)).alias("s")).select("__face", "n", "s.*")
    sums = each.groupBy("at").agg(*(F.sum(F.col("w") * F.col("n")[k]).alias(f"m{k}") for k in range(3)))
    found = met(each, sums, "at").groupBy("__face").agg(F.array_sort(F.collect_list(F.struct("slot", F.array("m0", "m1", "m2").alias("m")))).alias("found"), F.first("n").alias("n"))
    return found.select("__face", F.concat(F.transform("found", lambda s: s["m"]), F.array("n")).alias("normals"))


#: Smoothing leaves out faces whose weight is below exp(-FAINT) of the nearest one's.
FAINT = 40.0
_TRIANGLE = nearby.Kind(tuple(tuple(f"{c}{k}" for c in XYZ) for k in range(3)))


def with_mesh_distance(rows: DataFrame, faces: DataFrame, names: tuple[str, str, str] = XYZ, smooth: float = 0.0, into: str = "distance") -> DataFrame:
    """Adds the signed distance of each point to a closed mesh (faces with corners, turned outwards), negative inside.

    Faces are found by tiles (`nearby`), so neither side is held whole anywhere. The sign is that of the nearest feature's normal (of
    a face, an edge or a corner). With `smooth` > 0 the distance is the mean of the faces' distances weighted by exp(-smooth d^2) relative to the
    nearest, and the normal (n_x, n_y, n_z) the same mean of their normals; else it is exact and the normal that of the nearest feature.

    Defined results: points without a place have null results; faces without an area, or with a null corner, count as absent; a mesh without faces is an error.
    """
    made = [into, "n_x", "n_y", "n_z"]
    kept = [c for c in rows.columns if c not in made]
    asked = nearby.numbered(rows.select(*(F.col(f"`{c}`") for c in kept)))
    usable = _keyed(faces)
    tiles = nearby.tiled(usable, "__face", _TRIANGLE)
    if not len(tiles.counts):
        raise ValueError("the mesh has no faces")
    places = asked.select(F.col("__row").alias("row"), *(F.col(a).cast("double").alias(b) for a, b in zip(names, XYZ, strict=True)))
    found = nearby.nearest(places, XYZ, tiles).select("row", "item")
    sided = met(feature_normals(usable), usable, "__face")
    full = met(met(found, sided.withColumnRenamed("__face", "item"), "item"), places, "row")
    columns = [f"{c}{k}" for k in range(3) for c in XYZ]

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = nearby._matrix(batch, XYZ)
            foot, feature = nearby.feet(p, nearby._matrix(batch, columns).reshape(-1, 3, 3))
            normals = np.array(batch.column("normals").to_pylist(), float).reshape(-1, 7, 3)[np.arange(len(p)), feature]
            normals /= np.maximum(np.linalg.norm(normals, axis=1, keepdims=True), 1e-300)
            out = p - foot
            d = np.linalg.norm(out, axis=1) * np.where((out * normals).sum(axis=1) < 0, -1.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(d), *(pa.array(normals[:, k]) for k in range(3))], names=["row", *made])

    signed = full.select("row", *XYZ, *columns, "normals").mapInArrow(side, "row long, " + ", ".join(f"{c} double" for c in made))
    if smooth:
        signed = _smoothed(signed, places, tiles, smooth, made)
    out = met(asked, signed.withColumnRenamed("row", "__row"), "__row", "left")
    return out.select(*(F.col(f"`{c}`") for c in kept), *made)


def _smoothed(signed: DataFrame, places: DataFrame, tiles: nearby.Tiles, smooth: float, made: list[str]) -> DataFrame:
    """Weighted means over all faces near enough to count, by the exact distance and sign."""
    exact = written(signed)
    asked = met(places, exact.select("row", (F.col(made[0]) * F.col(made[0])).alias("bound")), "row")
    reach, sums = FAINT / smooth, ["w", "d", "a", "b", "c"]

    def work(items: pa.Table, some: pa.Table) -> pa.Table:
        p, bound, t = nearby._matrix(some, XYZ), some.column("bound").to_numpy(), nearby._matrix(items, _TRIANGLE.columns).reshape(-1, 3, 3)
        out = np.zeros((len(p), 5))
        if len(p) and len(t):
            boxes = nearby.Boxes(t)
            n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
            n /= np.linalg.norm(n, axis=1, keepdims=True)
            for part in nearby._blocks(len(p), len(boxes.parts)):
                who, box = np.nonzero(nearby.box_distance(p[part], boxes.low, boxes.high) <= bound[part, None] + reach)
                for a in range(0, len(who), 20_000):
                    item = boxes.items[box[a : a + 20_000]]
                    row = np.repeat(who[a : a + 20_000] + part.start, item.shape[1])[item.ravel() >= 0]
                    item = item.ravel()[item.ravel() >= 0]
                    foot, _ = nearby.feet(p[row], t[item])
                    d2 = ((p[row] - foot) ** 2).sum(axis=1)
                    w = np.where(d2 <= bound[row] + reach, np.exp(-smooth * np.maximum(d2 - bound[row], 0)), 0.0)
                    for k, v in enumerate((w, w * np.sqrt(d2), *(w * n[item, j] for j in range(3)))):
                        out[:, k] += np.bincount(row, v, len(p))
        return pa.table({"row": some.column("row"), **{c: out[:, k] for k, c in enumerate(sums)}})

    routed = nearby._routed(asked, XYZ, tiles, 1, True, slack=reach)
    total = nearby.meet(routed, tiles.items, XYZ, _TRIANGLE.columns, work, "row long, " + ", ".join(f"{c} double" for c in sums)).groupBy("row").agg(*(F.sum(c).alias(c) for c in sums))
    size = F.greatest(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c")), F.lit(1e-300))
    mean = F.col("d") / F.col("w")
    return exact.select("row", F.col(made[0]).alias("__exact")).join(total, "row").select("row", F.when(F.col("__exact") < 0, -mean).otherwise(mean).alias(made[0]), *((F.col(c) / size).alias(n) for c, n in zip("abc", made[1:], strict=True)))


def inside_mesh(rows: DataFrame, faces: DataFrame, tolerance: float = 0.0, names: tuple[str, str, str] = XYZ) -> DataFrame:
    """The points inside a closed mesh, by more than the tolerance."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return with_mesh_distance(rows.select(F.struct(*kept).alias("__all"), *(F.col(a).alias(f"__{b}") for a, b in zip(names, XYZ, strict=True))), faces, ("__x", "__y", "__z"), into="__d").where(F.col("__d") < -tolerance).select("__all.*")


def bounds(faces: DataFrame) -> tuple[list[float], list[float], float]:
    """Least and greatest place per axis, and the enclosed volume, in one pass."""
    ends = [f(*(F.col(f"{c}{k}") for k in range(3))) for f in (F.least, F.greatest) for c in XYZ]
    row = faces.agg(*(F.min(e).alias(f"low{k}") if k < 3 else F.max(e).alias(f"high{k - 3}") for k, e in enumerate(ends)), F.sum(volume_part()).alias("v")).first()
    return [*row[:3]], [*row[3:6]], row[6]


def interior_points(spark: SparkSession, faces: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About n points inside a closed mesh, each with the weight of its share of the box."""
    from axisfield.sources.samplers import uniform

    low, high, volume = bounds(faces)
    box = float(np.prod(np.subtract(high, low)))
    tries = int(np.ceil(n * box / abs(volume)))
    points = uniform(spark, tries, XYZ, low, high, seed)
    return inside_mesh(points, faces).withColumn("w", F.lit(box / tries))
