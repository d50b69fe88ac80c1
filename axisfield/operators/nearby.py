"""Nearest items by tiles: each row meets the items of its own tile, and of the other tiles that may hold nearer ones.

Items (points or triangles) are dealt to tiles of about TILE items by a k-d tree over the centres of a sample of at most SAMPLE
of them; only the splits depend on the sample. A tile's box encloses its items, so the distance of a row to it is a lower bound,
and the distance to its farthest corner an upper one. Rows are sent to the tile whose box is nearest, which gives a distance
with which the boxes of all others are refuted; what is left is sent once more. So a row is shuffled twice, whatever the items'
density, and no radius has to be guessed. The boxes are broadcast: tiles grow with the square root of the items beyond
TILES x TILE, so that there are at most a few times TILES + sqrt of them.

A tile with more rows than BLOCK is dealt in blocks, each with a copy of the tile's items; a tile of items at one place, which no
split divides, is dealt in parts of TILE items with the same box. Within a task items are in boxes of LEAF, looked
through by numpy from the nearest box on.

Defined results: rows with a null or NaN place have no nearest item (k rows of nulls are not made: they are absent); items with one are left out;
without items no row has a result; ties go to the least item id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisfield.plans.tables import met, written

TILE, TILES, SAMPLE, BLOCK, LEAF = 16_384, 4096, 100_000, 65_536, 24
#: Rows of a task that are near each other and rule out boxes together.
GROUP = 256


@dataclass(frozen=True)
class Kind:
    """What items are: the columns of their corners (one corner: points), in the dimensions of the rows' places."""

    corners: tuple[tuple[str, ...], ...]

    @property
    def columns(self) -> list[str]:
        return [c for corner in self.corners for c in corner]


class Boxes:
    """Items in boxes of LEAF by repeated halving along the longest side."""

    def __init__(self, corners: np.ndarray):
        """`corners` is (items, corners, dimensions)."""
        self.corners = corners
        low, high = corners.min(axis=1), corners.max(axis=1)
        parts, todo = [], [np.arange(len(corners))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                parts.append(own)
                continue
            middle = (low[own] + high[own]) / 2
            order = np.argsort(middle[:, np.argmax(np.ptp(middle, axis=0))], kind="stable")
            todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        self.parts = parts
        self.low, self.high = (np.stack([f(x[p], axis=0) for p in parts]) for f, x in ((np.min, low), (np.max, high)))
        # padded, so that a row's look at a box is one look at a table
        width = max(map(len, parts))
        self.items = np.stack([np.pad(p, (0, width - len(p)), constant_values=-1) for p in parts])



def halved(places: np.ndarray, most: int) -> list[np.ndarray]:
    """The numbers of places in groups of at most `most`, by repeated halving along the longest side."""
    parts, todo = [], [np.arange(len(places))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            parts.append(own)
            continue
        axis = np.argmax(np.ptp(places[own], axis=0))
        order = np.argpartition(places[own, axis], len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return [p for p in parts if len(p)]


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest squared distance between a place in one box and a place in each of others."""
    least = (np.maximum(np.maximum(lows - high, low - highs), 0) ** 2).sum(axis=1)
    return least, (np.maximum(np.abs(highs - low), np.abs(high - lows)) ** 2).sum(axis=1)


def _candidates(places: np.ndarray, lows: np.ndarray, highs: np.ndarray, counts: np.ndarray, k: int, bound: float = np.inf) -> np.ndarray:
    """The boxes that may hold one of the k nearest items of any of the places, or lie within a bound (squared); ascending."""
    least, most = _apart(places.min(axis=0), places.max(axis=0), lows, highs)
    order = np.argsort(most)
    enough = np.searchsorted(np.cumsum(counts[order]), k)
    if enough < len(order):
        bound = min(bound, most[order[enough]])
    return np.flatnonzero(least <= bound * (1 + 1e-9))


def box_distance(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), len(low)))
    for k in range(places.shape[1]):
        x = places[:, k, None]
        out += np.maximum(np.maximum(low[None, :, k] - x, x - high[None, :, k]), 0) ** 2
    return out


def farthest(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), len(low)))
    for k in range(places.shape[1]):
        x = places[:, k, None]
        out += np.maximum(np.abs(x - low[None, :, k]), np.abs(high[None, :, k] - x)) ** 2
    return out


def feet(places: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points of pairs of a place and an item, and which feature they lie on.

    Features: 0 to 2 a corner, 3 to 5 the edge after it, 6 the inside; corners are (pairs, corners, dimensions) of points, segments or triangles.
    """
    if corners.shape[1] == 1:
        return corners[:, 0], np.zeros(len(places), np.int8)
    n = corners.shape[1]
    best, foot, feature = np.full(len(places), np.inf), np.zeros_like(places), np.zeros(len(places), np.int8)
    for k in range(n if n > 2 else 1):
        a, b = corners[:, k], corners[:, (k + 1) % n]
        e = b - a
        s = ((places - a) * e).sum(axis=1) / np.maximum((e * e).sum(axis=1), 1e-300)
        at = a + np.clip(s, 0, 1)[:, None] * e
        d2 = ((places - at) ** 2).sum(axis=1)
        nearer = d2 < best
        best[nearer], foot[nearer] = d2[nearer], at[nearer]
        feature[nearer] = np.where(s <= 0, k, np.where(s >= 1, (k + 1) % n, 3 + k))[nearer]
    if n == 3:
        ab, ac, d = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0], places - corners[:, 0]
        aa, bb, cc = (ab * ab).sum(axis=1), (ab * ac).sum(axis=1), (ac * ac).sum(axis=1)
        p, q = (d * ab).sum(axis=1), (d * ac).sum(axis=1)
        whole = aa * cc - bb * bb
        flat = whole <= 1e-14 * aa * cc
        whole = np.where(flat, 1.0, whole)
        v, w = (cc * p - bb * q) / whole, (aa * q - bb * p) / whole
        inside = (v > 0) & (w > 0) & (v + w < 1) & ~flat
        foot[inside] = (corners[:, 0] + v[:, None] * ab + w[:, None] * ac)[inside]
        feature[inside] = 6
    return foot, feature


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, 400_000 // max(1, width))
    for a in range(0, n, step):
        yield slice(a, a + step)


def nearest_in(boxes: Boxes, ids: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, k) squared distances and item numbers, from the nearest on; -1 where there are fewer items. Ties by id.

    Rows are looked at in groups that lie together; a group looks only at boxes that may hold nearest items of any of its rows.
    """
    best = np.full((len(places), k), np.inf)
    found = np.full((len(places), k), -1)
    sizes = np.array([len(p) for p in boxes.parts])
    for group in halved(places, GROUP):
        near = _candidates(places[group], boxes.low, boxes.high, sizes, k)
        for part in _blocks(len(group), len(near)):
            _look(boxes, ids, places, k, group[part], near, best, found)
    found[np.isinf(best)] = -1
    return best, found


def _look(boxes: Boxes, ids: np.ndarray, places: np.ndarray, k: int, rows: np.ndarray, near: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
    """Fills in the k nearest items of some rows, box by box from each row's nearest on."""
    some, own, who_ = places[rows], best[rows], found[rows]
    d2 = box_distance(some, boxes.low[near], boxes.high[near])
    order = np.argsort(d2, axis=1, kind="stable")
    alive = np.arange(len(some))
    for turn in range(order.shape[1]):
        box = order[alive, turn]
        # a box as near as the worst kept may hold a tie of a smaller id
        going = d2[alive, box] <= own[alive, k - 1]
        alive, box = alive[going], box[going]
        if not len(alive):
            break
        items = boxes.items[near[box]]
        pairs, width = items.ravel(), items.shape[1]
        spots = np.repeat(some[alive], width, axis=0)
        at, _ = feet(spots, boxes.corners[pairs])
        away = ((spots - at) ** 2).sum(axis=1)
        away[pairs < 0] = np.inf
        away = away.reshape(-1, width)
        named = np.where(items < 0, np.iinfo(np.int64).max, ids[items])
        if k == 1:
            least = away.min(axis=1, keepdims=True)
            pick = np.where(away == least, named, np.iinfo(np.int64).max).argmin(axis=1)[:, None]
            least, item, name = least[:, 0], np.take_along_axis(items, pick, axis=1)[:, 0], np.take_along_axis(named, pick, axis=1)[:, 0]
            old = who_[alive, 0]
            better = (least < own[alive, 0]) | ((least == own[alive, 0]) & (name < np.where(old < 0, np.iinfo(np.int64).max, ids[old])))
            own[alive[better], 0], who_[alive[better], 0] = least[better], item[better]
            continue
        both = np.concatenate((own[alive], away), axis=1)
        who = np.concatenate((who_[alive], items), axis=1)
        named = np.concatenate((np.where(who_[alive] < 0, np.iinfo(np.int64).max, ids[who_[alive]]), named), axis=1)
        first = np.lexsort((named, both), axis=1)[:, :k]
        own[alive] = np.take_along_axis(both, first, axis=1)
        who_[alive] = np.take_along_axis(who, first, axis=1)
    best[rows], found[rows] = own, who_


def _splits(sample: np.ndarray, most: int) -> list[tuple]:
    """A k-d tree as (axis, border, below, above) with leaves as (-1, number, 0, 0)."""
    nodes: list = [None]
    todo, leaves = [(0, sample)], 0
    while todo:
        node, own = todo.pop()
        spread = np.ptp(own, axis=0) if len(own) else np.zeros(sample.shape[1])
        axis = int(np.argmax(spread))
        if len(own) <= most or spread[axis] == 0:
            nodes[node], leaves = (-1, leaves, 0, 0), leaves + 1
            continue
        border = float(np.median(own[:, axis]))
        side = own[:, axis] < border
        if not side.any():
            border = float(own[own[:, axis] > border, axis].min())
            side = own[:, axis] < border
        nodes[node] = (axis, border, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(nodes[node][2], own[side]), (nodes[node][3], own[~side])]
    return nodes


def _leaf(nodes: list[tuple], places: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(places), np.int64), [(0, np.arange(len(places)))]
    while todo:
        node, own = todo.pop()
        axis, border, below, above = nodes[node]
        if axis < 0:
            out[own] = border
        elif len(own):
            side = places[own, axis] < border
            todo += [(to, some) for to, some in ((below, own[side]), (above, own[~side])) if len(some)]
    return out


def _matrix(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    column = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return np.stack([column(batch.column(c)).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)


@dataclass
class Tiles:
    items: DataFrame  # tile, item, the corners
    kind: Kind
    low: np.ndarray
    high: np.ndarray
    counts: np.ndarray


def tiled(items: DataFrame, key: str, kind: Kind, tile: int | None = None) -> Tiles:
    """Items (a key and their corners' columns) with their tiles of about `tile` items (TILE), written, and the tiles' boxes."""
    size = min(tile or TILE, TILE)
    usable = None
    for c in kind.columns:
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        usable = ok if usable is None else usable & ok
    good = items.where(usable).select(F.col(key).cast("long").alias("item"), *(F.col(c).cast("double").alias(c) for c in kind.columns))
    n = good.count()
    centres = [sum((F.col(corner[k]) for corner in kind.corners), F.lit(0.0)) / len(kind.corners) for k in range(len(kind.corners[0]))]
    per = max(size, int(math.sqrt(n / TILES * size))) if n > TILES * size else size
    if n > per:
        unit = F.pmod(F.xxhash64("item"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        share = min(1.0, SAMPLE / n)
        names = [f"c{k}" for k in range(len(centres))]
        rows = good.where(unit < share).select(*(c.alias(a) for c, a in zip(centres, names, strict=True))).orderBy(*names).collect()
        nodes = _splits(np.array(rows, float).reshape(-1, len(names)), max(1, per * len(rows) // n))
    else:
        nodes = [(-1, 0, 0, 0)]
    shape = (-1, len(kind.corners), len(kind.corners[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            middle = _matrix(batch, kind.columns).reshape(shape).mean(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(_leaf(nodes, middle)), *batch.columns], names=["leaf", *batch.schema.names])

    dealt = written(good.mapInArrow(run, "leaf long, item long, " + ", ".join(f"{c} double" for c in kind.columns)))
    # a leaf that no split could divide, in parts
    parts = F.broadcast(dealt.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / (2 * per)).cast("int").alias("parts")))
    tile = F.struct("leaf", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part"))
    placed = dealt.join(parts, "leaf").select(F.concat_ws("/", tile["leaf"], tile["part"]).alias("tile"), "item", *kind.columns)
    ends = lambda f, one, k: one(*(F.col(c[k]) for c in kind.corners)) if len(kind.corners) > 1 else F.col(kind.corners[0][k])
    dims = range(len(kind.corners[0]))
    boxes = placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), *(F.min(ends(F.min, F.least, k)).alias(f"low{k}") for k in dims), *(F.max(ends(F.max, F.greatest, k)).alias(f"high{k}") for k in dims)).orderBy("tile").collect()
    number = {b["tile"]: k for k, b in enumerate(boxes)}
    named = items.sparkSession.createDataFrame(list(number.items()), "tile string, number int")
    out = placed.join(F.broadcast(named), "tile").select(F.col("number").alias("tile"), "item", *kind.columns)
    box = lambda side: np.array([[b[f"{side}{k}"] for k in dims] for b in boxes], float).reshape(-1, len(dims))
    return Tiles(out, kind, box("low"), box("high"), np.array([b["n"] for b in boxes], np.int64))


def _routed(rows: DataFrame, names: Sequence[str], tiles: Tiles, k: int, again: bool, slack: float = 0.0) -> DataFrame:
    """(tile, row, places, bound): rows sent to the nearest tile, or once more to all others within their bound."""
    shared = rows.sparkSession.sparkContext.broadcast((tiles.low, tiles.high, tiles.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, counts = shared.value
        for batch in batches:
            places, row = _matrix(batch, names), batch.column("row").to_numpy()
            bounds = batch.column("bound").to_numpy(zero_copy_only=False) if again else None
            for group in halved(places, GROUP):
                # only tiles that can be nearest, or within reach, of some row of the group
                tile = _candidates(places[group], low, high, counts, k) if not again else _candidates(places[group], low, high, counts, int(counts.sum()) + 1, float(bounds[group].max()) + slack)
                for part in _blocks(len(group), len(tile)):
                    own = group[part]
                    some = places[own]
                    d2 = box_distance(some, low[tile], high[tile])
                    home = np.argmin(d2, axis=1)
                    if again:
                        bound = bounds[own]
                        near = d2 <= bound[:, None] * (1 + 1e-12) + slack
                        if not slack:
                            near[np.arange(len(some)), home] = False
                        who, to = np.nonzero(near)
                    else:
                        # at least k items lie within the farthest corners of the tiles nearest by those
                        far = farthest(some, low[tile], high[tile])
                        order = np.argsort(far, axis=1)
                        enough = (np.cumsum(counts[tile][order], axis=1) < k).sum(axis=1)
                        bound = np.where(enough < len(tile), np.take_along_axis(far, np.take_along_axis(order, np.minimum(enough, len(tile) - 1)[:, None], axis=1), axis=1)[:, 0], np.inf)
                        who, to = np.arange(len(some)), home
                    yield pa.RecordBatch.from_arrays([pa.array(tile[to].astype(np.int32)), pa.array(row[own][who]), *(pa.array(some[who, j]) for j in range(len(names))), pa.array(bound[who])], names=["tile", "row", *names, "bound"])

    columns = ["row", *names, *(["bound"] if again else [])]
    return rows.select(*columns).mapInArrow(run, "tile int, row long, " + ", ".join(f"{c} double" for c in names) + ", bound double")


def meet(routed: DataFrame, items: DataFrame, names: Sequence[str], columns: Sequence[str], work, schema: str) -> DataFrame:
    """work(items of a tile, rows sent to it) by blocks of rows."""
    counts = routed.groupBy("tile").count().select("tile", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    # one row a tile
    counts = F.broadcast(written(counts))
    left = items.join(counts, "tile").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tile", "block", "item", *columns)
    right = routed.join(counts, "tile").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).select("tile", "block", "row", *names, "bound")
    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(work, schema)


def nearest(rows: DataFrame, names: Sequence[str], tiles: Tiles, k: int = 1) -> DataFrame:
    """(row, place, item, d2): the k nearest items of each row, from the first place on; `rows` has a unique long `row` and the places."""
    shape = (-1, len(tiles.kind.corners), len(names))
    schema = "row long, item long, d2 double, bound double"
    if not len(tiles.counts):
        return rows.sparkSession.createDataFrame([], "row long, place int, item long, d2 double")
    usable = None
    for c in names:
        ok = F.col(c).isNotNull() & ~F.isnan(c)
        usable = ok if usable is None else usable & ok
    asked = rows.where(usable).select("row", *(F.col(c).cast("double").alias(c) for c in names))
    columns = tiles.kind.columns

    def work(items: pa.Table, some: pa.Table) -> pa.Table:
        bound = some.column("bound").to_numpy()
        if not len(bound) or not items.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("row", pa.int64()), ("item", pa.int64()), ("d2", pa.float64()), ("bound", pa.float64()))})
        ids = items.column("item").to_numpy()
        best, found = nearest_in(Boxes(_matrix(items, columns).reshape(shape)), ids, _matrix(some, names), k)
        who, place = np.nonzero(found >= 0)
        # all k within the tile bound the distance, else what was known before
        tight = np.minimum(bound, best[:, k - 1])
        return pa.table({"row": some.column("row").to_numpy()[who], "item": ids[found[who, place]], "d2": best[who, place], "bound": tight[who]})

    if len(tiles.counts) == 1:
        # one tile's items are at most 2 x TILE: rows meet them where they are, without a shuffle
        held = tiles.items.select("item", *columns).orderBy("item").collect()
        shared = rows.sparkSession.sparkContext.broadcast(([r[0] for r in held], [tuple(r[1:]) for r in held]))

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, boxes = np.array(shared.value[0], np.int64), Boxes(np.array(shared.value[1], float).reshape(shape))
            for batch in batches:
                best, found = nearest_in(boxes, ids, _matrix(batch, names), k)
                who, place = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("row").to_numpy()[who]), pa.array((place + 1).astype(np.int32)), pa.array(ids[found[who, place]]), pa.array(best[who, place])], names=["row", "place", "item", "d2"])

        return asked.mapInArrow(here, "row long, place int, item long, d2 double")
    first = written(meet(_routed(asked, names, tiles, k, False), tiles.items, names, columns, work, schema))
    bounds = first.groupBy("row").agg(F.min("bound").alias("bound"))
    more = _routed(met(asked, bounds, "row"), names, tiles, k, True)
    both = first.union(meet(more, tiles.items, names, columns, work, schema))
    # at most k of each tile a row was sent to
    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "item"))), 1, k)
    return both.groupBy("row").agg(best.alias("best")).select("row", F.posexplode("best").alias("place", "b")).select("row", (F.col("place") + 1).alias("place"), "b.item", "b.d2")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a unique `__row`, written, so that it is the same whenever they are read."""
    return written(rows.withColumn("__row", F.monotonically_increasing_id()))
