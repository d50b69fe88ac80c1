"""Non-local operators: kernels over quadrature tables, inverse-distance weights, histories."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisfield.operators import nearby
from axisfield.operators.rules import rule_sum
from axisfield.operators.series import BLOCK, adjacent, blocked, nearest_known
from axisfield.plans.tables import dealt, met, written

#: Rows up to which a side of an all-pairs operator is broadcast; a larger one is shuffled in blocks. Anchors of a packed block.
BROADCAST_ROWS, BLOCKS, PACKED = 200_000, 64, 50_000


def all_pairs(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Each row with each row of the other side, whose size is checked before it is broadcast.

    Beyond that size the other side is dealt to blocks and each row is sent once to every block.
    """
    if other.count() <= BROADCAST_ROWS:
        return rows.crossJoin(F.broadcast(other))
    dealt = other.withColumn("__block", F.pmod(F.xxhash64(*other.columns), F.lit(BLOCKS)).cast("int"))
    return rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).join(dealt, "__block").drop("__block")


def kernel_integral(rows: DataFrame, rule: Sequence[dict[str, float]], term: Callable[[Column], Column], into: str = "integral", reads: Sequence[str] | None = None) -> DataFrame:
    """Adds the sum over a declared quadrature rule of term(entry), such as kernel(x, y) value(y) weight.

    `reads` names the columns that the term reads: then there is one sum for each distinct place of theirs, joined to its rows (nulls alike). That is
    for long rules over columns with few places; with none, the sum is one number.
    """
    if reads is not None:
        if not reads:
            return rows.crossJoin(F.broadcast(rows.sparkSession.range(1).select(rule_sum(rule, term).alias(into))))  # one row
        # places are few beside the work of their sums: a task has some of them
        places = dealt(rows.select(*reads).distinct(), 16).withColumn(into, rule_sum(rule, term))
        sums = written(places.select(*(F.col(c).alias(f"__at_{c}") for c in reads), into))
        same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__at_{c}")) for c in reads))
        # counted: small sums meet rows where they are
        side = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums.hint("merge")
        return rows.drop(into).join(side, same, "left").drop(*(f"__at_{c}" for c in reads))
    return rows.withColumn(into, rule_sum(rule, term))


#: The sum over the offsets of a ball rule around each row: the same projection.
local_integral = kernel_integral


def kernel_sum(rows: DataFrame, sources: DataFrame, key: list[str], term: Column, into: str = "integral") -> DataFrame:
    """(key, sum over a table of sources): for sources that are data; rows alike in the key are one."""
    return all_pairs(rows.dropDuplicates(key), sources).groupBy(*key).agg(F.sum(term).alias(into))


def _weighted(d2: Column, value: Column, exponent: float, snap: float) -> tuple[Column, Column, Column]:
    # without snapping the weights are plain: infinite at distance zero
    w = F.pow(F.greatest(d2, F.lit(1e-300)) if snap > 0 else d2, F.lit(-exponent / 2))
    return w * value, w, F.struct(d2.alias("d2"), value.alias("v"))


def _means(places: np.ndarray, spots: np.ndarray, values: np.ndarray, exponent: float) -> tuple[np.ndarray, ...]:
    """Weighted sum of values, sum of weights, and the nearest anchor's squared distance and value (the least, if several are as near)."""
    top, low, least, near = (np.full(len(places), x) for x in (0.0, 0.0, np.inf, np.inf))
    # few pairs at a time, in the same memory, which the processor's caches hold
    width = max(1, min(len(spots), 4096))
    step = max(1, 32_768 // width)
    both = np.stack((values, np.ones(len(values))), axis=1)
    d2_, gap_ = np.empty((2, step * width))
    for a in range(0, len(places), step):
        some = places[a : a + step]
        for b in range(0, len(spots), width):
            own = spots[b : b + width]
            shape = (len(some), len(own))
            d2, gap = (x[: shape[0] * shape[1]].reshape(shape) for x in (d2_, gap_))
            for k in range(spots.shape[1]):
                to = gap if k else d2
                np.subtract(some[:, k, None], own[None, :, k], out=to)
                np.multiply(to, to, out=to)
                if k:
                    d2 += gap
            nearest_ = d2.min(axis=1)
            for r in np.flatnonzero(nearest_ <= least[a : a + step]):
                value = values[b : b + width][d2[r] == nearest_[r]].min() if not np.isnan(nearest_[r]) else np.inf
                near[a + r] = min(near[a + r], value) if nearest_[r] == least[a + r] else value
                least[a + r] = nearest_[r]
            np.maximum(d2, 1e-300, out=d2)
            w = np.power(d2, -exponent / 2, out=d2) if exponent != 2 else np.reciprocal(d2, out=d2)
            sums = w @ both[b : b + width]
            top[a : a + step] += sums[:, 0]
            low[a : a + step] += sums[:, 1]
    return top, low, least, near


def inverse_distance(rows: DataFrame, anchors: DataFrame, names: Sequence[tuple[str, str]], value: str, exponent: float = 2.0, snap: float = 1e-12, into: str = "idw") -> DataFrame:
    """Adds the inverse-distance mean over all anchors; a row on an anchor takes its value (the least, if several are there).

    `names` pairs the rows' places with the anchors'. Anchors up to PACKED (counted) are one block, which all rows meet where they are; more of them
    are dealt to blocks of about that size, whose sums are added: no pair of a row and an anchor is ever a row. Both ways sum the same.

    Defined results: anchors of null (or NaN) value or place count as absent; without anchors, or for a row without a place, the mean is null.
    """
    usable = anchors.select(*(F.col(f"`{a}`").cast("double").alias(f"a{k}") for k, (_, a) in enumerate(names)), F.col(f"`{value}`").cast("double").alias("v"))
    for c in usable.columns:
        usable = usable.where(F.col(c).isNotNull() & ~F.isnan(c))
    spots, places = [f"a{k}" for k in range(len(names))], [f"__p{k}" for k in range(len(names))]
    kept = [f for f in rows.schema if f.name != into]
    # columns of any names as one, which Arrow takes whole
    packed = F.struct(*(F.col(f"`{f.name}`") for f in kept)).alias("__all")
    asked = rows.select(packed, *(F.col(f"`{r}`").cast("double").alias(p) for p, (r, _) in zip(places, names, strict=True)))
    held = usable.limit(PACKED + 1).collect()
    if len(held) <= PACKED:
        table = np.array(sorted(held), float).reshape(-1, len(names) + 1)
        shared = rows.sparkSession.sparkContext.broadcast(table)

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                at = nearby._matrix(batch, places)
                top, low, least, near = _means(at, known[:, :-1], known[:, -1], exponent)
                mean = np.divide(top, low, out=np.full(len(top), np.nan), where=low > 0)
                mean = np.where(least < snap, near, mean)
                yield pa.RecordBatch.from_arrays([batch.column("__all"), pa.array(mean, mask=np.isnan(mean))], names=["__all", into])

        return asked.mapInArrow(here, T.StructType([asked.schema["__all"], T.StructField(into, T.DoubleType())])).select("__all.*", into)
    blocks = -(-usable.count() // PACKED)
    counted = nearby.numbered(asked)
    deal = lambda n, of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    slices = max(BLOCKS, -(-counted.count() // PACKED))
    left = usable.withColumn("block", deal(blocks, usable.columns)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = counted.select("__row", *places).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("slice", deal(slices, ["__row"]))

    def work(some: pa.Table, ours: pa.Table) -> pa.Table:
        found = _means(nearby._matrix(ours, places), nearby._matrix(some, spots), some.column("v").to_numpy(), exponent)
        return pa.table({"__row": ours.column("__row"), **{c: x for c, x in zip(("top", "low", "least", "near"), found, strict=True)}})

    sums = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(work, "__row long, top double, low double, least double, near double")
    total = sums.groupBy("__row").agg(F.sum("top").alias("top"), F.sum("low").alias("low"), F.min(F.struct("least", "near")).alias("n"))
    mean = F.when(F.col("n.least") < snap, F.col("n.near")).when(F.col("low") > 0, F.col("top") / F.col("low"))
    return counted.join(total, "__row", "left").select("__all.*", F.when(~F.isnan(mean), mean).alias(into))


def nearest(rows: DataFrame, anchors: DataFrame, key: str, names: Sequence[str], k: int) -> DataFrame:
    """(key, place, squared distance, the anchor's columns): the k nearest anchors of each row, ties by their order.

    By tiles of anchors (`nearby`): a row is sent to one tile, and to those that may hold nearer anchors. Rows or anchors without a
    place are left out. Anchors have the columns `names` and others.
    """
    sorted_ = written(anchors.orderBy(*anchors.columns).withColumn("__item", F.monotonically_increasing_id()))
    asked = nearby.numbered(rows.select(F.col(key).alias("__key"), *names))
    found = nearby.nearest(asked.withColumnRenamed("__row", "row"), names, nearby.tiled(sorted_, "__item", nearby.Kind((tuple(names),))), k)
    named = met(found, sorted_.select(F.col("__item").alias("item"), F.struct(*anchors.columns).alias("anchor")), "item")
    return met(named, asked.select(F.col("__row").alias("row"), F.col("__key").alias(key)), "row").select(key, "place", F.col("d2").alias("distance2"), "anchor")


def inverse_distance_nearest(rows: DataFrame, anchors: DataFrame, key: str, names: Sequence[str], value: str, k: int, exponent: float = 2.0, snap: float = 1e-12, into: str = "idw") -> DataFrame:
    """(key, mean): inverse distances over the k nearest anchors alone; a row nearer to one than `snap` (squared) takes its value.

    With a `snap` of 0 the quotient of the sums is taken as it is: a row on an anchor has NaN.
    """
    a, b, near = _weighted(F.col("distance2"), F.col(f"anchor.{value}").cast("double"), exponent, snap)
    out = nearest(rows, anchors, key, names, k).groupBy(key).agg(F.sum(a).alias("a"), F.sum(b).alias("b"), F.min(near).alias("near"))
    return out.select(key, F.when(F.col("near.d2") < snap, F.col("near.v")).otherwise(F.col("a") / F.col("b")).alias(into))


def delay(rows: DataFrame, series: str, time: str, value: str, tau: float, into: str = "delayed") -> DataFrame:
    """The last value at or before time - tau within a series, by one sorted pass over both kinds of rows, in blocks of time.

    Each observation is also an event at time + tau; the last known event is the as-of value. A null value is no observation.
    """
    asked = rows.select(*rows.columns, F.lit(1).alias("__kind"), F.col(time).alias("__at"), F.lit(None).cast(rows.schema[value].dataType).alias("__v"))
    came = rows.select(*rows.columns, F.lit(0).alias("__kind"), (F.col(time) + F.lit(tau)).alias("__at"), F.col(value).alias("__v"))
    order = ["__at", "__kind", value]
    both = blocked(came.union(asked), [series], order)
    return nearest_known(both, [series], order, "__v", last=into).where("__kind = 1").drop("__kind", "__at", "__v", BLOCK)


def stencil(rows: DataFrame, partition: list[str], order: str, value: str, step: Column, into: str = "derivative", periodic: bool = False) -> DataFrame:
    """Centred differences inside, one-sided at the ends (or across them, if periodic), within each line of a grid, in blocks of it."""
    near = adjacent(blocked(rows, partition, [order]), partition, [order], F.col(value), periodic)
    back, ahead, here = F.col("__back"), F.col("__ahead"), F.col(value)
    d = F.when(back.isNull() & ahead.isNull(), F.lit(0.0)).when(back.isNull(), (ahead - here) / step).when(ahead.isNull(), (here - back) / step).otherwise((ahead - back) / (step * F.lit(2.0)))
    return near.withColumn(into, d).drop("__back", "__ahead", BLOCK)


def differences(rows: DataFrame, partition: list[str], order: str, value: str, step: Column, n: int, into: str = "derivative") -> DataFrame:
    """The n-th derivative on an even grid by repeated centred differences, one-sided at the ends."""
    out = rows.withColumn(into, F.col(value))
    for k in range(n):
        out = stencil(out.withColumnRenamed(into, f"__d{k}"), partition, order, f"__d{k}", step, into).drop(f"__d{k}")
    return out
