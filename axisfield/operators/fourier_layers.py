"""Fourier operator layers on grids: one sample (a line or a plane of channels) a row, dealt over all tasks.

A sample is an array of values, channels last, in the order of its grid; its length is that of a declared grid. Each task transforms its
own samples with numpy; weights are declared arrays, broadcast once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spectral_mix(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The lowest modes of each sample (samples, *grid, channels) mixed across channels by complex weights (in, out, *modes), the rest left out."""
    grid = x.shape[1:-1]
    axes = tuple(range(1, 1 + len(grid)))
    spectrum = np.fft.rfftn(x, axes=axes)
    out = np.zeros((*spectrum.shape[:-1], weights.shape[1]), complex)
    last = min(weights.shape[-1], spectrum.shape[-2])
    if len(grid) == 1:
        out[:, :last] = np.einsum("nkc,cok->nko", spectrum[:, :last], weights[:, :, :last])
    else:
        # both the positive and the negative modes of the first axis; the second holds half of the spectrum
        first = min(weights.shape[2], grid[0] // 2)
        out[:, :first, :last] = np.einsum("nklc,cokl->nklo", spectrum[:, :first, :last], weights[:, :, :first, :last])
        out[:, grid[0] - first :, :last] = np.einsum("nklc,cokl->nklo", spectrum[:, grid[0] - first :, :last], np.conj(weights[:, :, :first, :last])[:, :, ::-1])
    return np.fft.irfftn(out, s=grid, axes=axes)


@dataclass(frozen=True)
class FourierOperator:
    """Lift, then tanh(spectral mix + pointwise map) a layer, then a linear projection; of lines or planes."""

    grid: tuple[int, ...]
    lift: np.ndarray  # (in, width)
    layers: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]  # modes' weights, pointwise (width, width), bias (width)
    project: np.ndarray  # (width, out)

    @classmethod
    def random(cls, grid: tuple[int, ...], channels: int, out: int, width: int = 4, depth: int = 2, modes: int = 4, seed: int = 0) -> FourierOperator:
        draw = np.random.default_rng(seed)
        shape = (width, width, *(modes for _ in grid))
        complex_normal = lambda s: (draw.standard_normal(s) + 1j * draw.standard_normal(s)) / width
        layers = tuple((complex_normal(shape), draw.standard_normal((width, width)) / width, np.zeros(width)) for _ in range(depth))
        return cls(grid, draw.standard_normal((channels, width)), layers, draw.standard_normal((width, out)) / width)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(x @ self.lift)
        for weights, point, bias in self.layers:
            h = np.tanh(spectral_mix(h, weights) + h @ point + bias)
        return h @ self.project


def apply(rows: DataFrame, operator: FourierOperator, value: str, into: str = "output") -> DataFrame:
    """Adds the operator's output for the samples of an array column (grid times channels numbers a row); null samples stay null.

    A sample of another length is an error.
    """
    shared = rows.sparkSession.sparkContext.broadcast(operator)
    kept = [f for f in rows.schema if f.name != into]
    size = int(np.prod(operator.grid)) * operator.lift.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                samples = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in some.column(value)]
                there = [x for x in samples if x is not None]
                if any(len(x) != size for x in there):
                    raise ValueError(f"a sample has {size} numbers")
                made = iter(own(np.array(there, float).reshape(len(there), *own.grid, -1)).reshape(len(there), -1) if there else ())
                out = [None if x is None else next(made) for x in samples]
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in kept), pa.array(out, pa.list_(pa.float64()))], names=[*(f.name for f in kept), into])

    return rows.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField(into, T.ArrayType(T.DoubleType()))]))


class _Mix(FourierOperator):
    def __call__(self, x: np.ndarray) -> np.ndarray:
        return spectral_mix(x, self.layers[0][0])


def mixed(rows: DataFrame, weights: np.ndarray, grid: tuple[int, ...], value: str, into: str = "mixed") -> DataFrame:
    """The spectral mix alone: an operator without maps around it."""
    channels, out = weights.shape[0], weights.shape[1]

    return apply(rows, _Mix(grid, np.eye(channels), ((weights, np.zeros((channels, out)), np.zeros(out)),), np.eye(out)), value, into)
