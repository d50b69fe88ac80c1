"""Integrals, means, norms and constraint objectives as weighted aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _group(df: DataFrame, keep: list[str]):
    return df.groupBy(*keep) if keep else df.groupBy()


def integral(df: DataFrame, f: Column, weight: Column | str = "w", where: Column | None = None, keep: list[str] = (), into: str = "integral") -> DataFrame:
    """The sum of weight * mask * f over the axes that are not kept."""
    w = F.col(weight) if isinstance(weight, str) else weight
    w = w * where.cast("double") if where is not None else w
    return _group(df, list(keep)).agg(F.sum(w * f).alias(into))


def mean(df: DataFrame, f: Column, weight: Column | str = "w", where: Column | None = None, keep: list[str] = (), into: str = "mean") -> DataFrame:
    """integral(f) / integral(1); an empty measure is an error."""
    w = F.col(weight) if isinstance(weight, str) else weight
    w = w * where.cast("double") if where is not None else w
    both = _group(df, list(keep)).agg(F.sum(w * f).alias("__a"), F.sum(w).alias("__b"))
    ratio = F.when(F.col("__b") == 0, F.raise_error(F.lit("the measure is zero")).cast("double")).otherwise(F.col("__a") / F.col("__b"))
    return both.select(*keep, ratio.alias(into))


def integrals(df: DataFrame, fields: dict[str, Column], weight: str = "w", keep: list[str] = ()) -> DataFrame:
    """Several integrals in one pass."""
    return _group(df, list(keep)).agg(*(F.sum(F.col(weight) * f).alias(k) for k, f in fields.items()))


def means(df: DataFrame, fields: dict[str, tuple[Column, Column | None]], weight: str = "w", keep: list[str] = ()) -> DataFrame:
    """Several means, each with its own mask or none, in one pass; an empty measure is an error."""
    sums = []
    for k, (f, where) in fields.items():
        w = F.col(weight) if where is None else F.col(weight) * where.cast("double")
        sums += [F.sum(w * f).alias(f"__a_{k}"), F.sum(w).alias(f"__b_{k}")]
    ratio = lambda k: F.when(F.col(f"__b_{k}") == 0, F.raise_error(F.lit("the measure is zero")).cast("double")).otherwise(F.col(f"__a_{k}") / F.col(f"__b_{k}"))
    return _group(df, list(keep)).agg(*sums).select(*keep, *(ratio(k).alias(k) for k in fields))


def inner_product(df: DataFrame, u: list[Column], v: list[Column], weight: str = "w", keep: list[str] = ()) -> DataFrame:
    return integral(df, sum((a * b for a, b in zip(u, v, strict=True)), F.lit(0.0)), weight, keep=keep, into="inner_product")


def lp_norm(df: DataFrame, u: list[Column], p: float = 2.0, weight: str = "w", keep: list[str] = ()) -> DataFrame:
    if p <= 0:
        raise ValueError("p must be positive")
    size = F.sqrt(sum((a * a for a in u), F.lit(0.0)))
    out = integral(df, F.pow(size, F.lit(p)), weight, keep=keep, into="__s")
    return out.select(*keep, F.pow("__s", F.lit(1.0 / p)).alias("norm"))


def objective(df: DataFrame, residual: list[Column], weight: Column | None = None, reduction: str = "mean", measure: float = 1.0, into: str = "loss") -> DataFrame:
    """One row: the mean, sum or integral (measure times mean) of the squared residual."""
    square = sum((r * r for r in residual), F.lit(0.0)) * (weight if weight is not None else F.lit(1.0))
    total = {"mean": F.avg(square), "sum": F.sum(square), "integral": F.avg(square) * F.lit(measure)}[reduction]
    return df.agg(total.alias(into))
