"""Derivatives on grids with tensor structure, one line along an axis at a time.

A line is gathered to one row (its length is that of the axis, a parameter), differentiated in
an Arrow function and spread again; lines are dealt by their keys, so a grid of any number of lines is spread over all
tasks. Fourier, sine and cosine lines use a fast transform of the line or its even or odd continuation,
others a matrix over the nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def barycentric_matrix(x: np.ndarray, order: int = 1) -> np.ndarray:
    d = x[:, None] - x[None, :] + np.eye(len(x))
    w = 1 / d.prod(axis=1)
    m = w[None, :] / w[:, None] / d
    np.fill_diagonal(m, 0)
    np.fill_diagonal(m, -m.sum(axis=1))
    return np.linalg.matrix_power(m, order)


def _line_derivative(values: np.ndarray, kind: str, step: float, order: int, matrix: np.ndarray | None) -> np.ndarray:
    """Derivatives of lines (rows of a matrix)."""
    n = values.shape[1]
    if matrix is not None:
        return values @ matrix.T
    if n < 2:
        return np.zeros_like(values)
    if kind == "cosine":
        whole = np.concatenate((values, values[:, -2:0:-1]), axis=1)
    elif kind == "sine":
        whole = np.concatenate((values, -values[:, ::-1]), axis=1)
    else:
        whole = values
    k = 2j * np.pi * np.fft.fftfreq(whole.shape[1], d=step)
    if order % 2 and whole.shape[1] % 2 == 0:
        k[whole.shape[1] // 2] = 0
    return np.real(np.fft.ifft(k**order * np.fft.fft(whole, axis=1), axis=1))[:, :n]


def line_derivatives(lines: DataFrame, kind: str, partition: list[str], index: str, value: str, orders: dict[str, int], step: float = 1.0, nodes: np.ndarray | None = None) -> DataFrame:
    """(partition, index, one column an order by its name) of each line; kinds fourier, sine, cosine (even steps) and nodes (any, by their matrix).

    A line is gathered once for all orders, so that no derivatives have to be joined.
    """
    if kind not in ("fourier", "sine", "cosine", "nodes"):
        raise ValueError(f"unknown kind {kind}")
    first = None if kind != "nodes" else barycentric_matrix(np.asarray(nodes, float))
    matrices = {n: None if first is None else np.linalg.matrix_power(first, n) for n in orders.values()}
    pair = F.array_sort(F.collect_list(F.struct(F.col(index).cast("long").alias("k"), F.col(value).cast("double").alias("v"))))
    keys = partition or ["__one"]
    gathered = (lines if partition else lines.withColumn("__one", F.lit(0))).groupBy(*keys).agg(pair.alias("__line"))
    gathered = gathered.select(*keys, F.col("__line.k").alias("__k"), F.col("__line.v").alias("__v"))
    kept = [f for f in gathered.schema if f.name not in ("__v",)]
    made = [f"__d{j}" for j in range(len(orders))]

    def run(batches):
        for batch in batches:
            rows = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0) for x in batch.column("__v")]
            out = [[_line_derivative(r[None, :], kind, step, n, matrices[n])[0] for r in rows] for n in orders.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(o, pa.list_(pa.float64())) for o in out)], names=[*(f.name for f in kept), *made])

    done = gathered.mapInArrow(run, T.StructType([*kept, *(T.StructField(m, T.ArrayType(T.DoubleType())) for m in made)]))
    spread = done.select(*keys, F.explode(F.arrays_zip("__k", *made)).alias("__x"))
    return spread.select(*partition, F.col("__x.__k").alias(index), *(F.col(f"__x.{m}").alias(c) for m, c in zip(made, orders, strict=True)))


def line_derivative(lines: DataFrame, kind: str, partition: list[str], index: str, value: str, step: float = 1.0, order: int = 1, nodes: np.ndarray | None = None, into: str = "derivative") -> DataFrame:
    """(partition, index, derivative) of each line: one order of `line_derivatives`."""
    return line_derivatives(lines, kind, partition, index, value, {into: order}, step, nodes)
