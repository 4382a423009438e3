"""Vector distances as columns; all arithmetic is in doubles, and lower is nearer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _zero(), lambda s, z: s + z)


def l2_squared(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, _zero(), lambda s, z: s + z * z)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / sqrt(|a|^2 |b|^2); a zero vector is an error."""
    norms = squared_norm(a) * squared_norm(b)
    return F.when(norms > 0, 1 - dot_product(a, b) / F.sqrt(norms)).otherwise(F.raise_error(F.lit("cosine distance needs non-zero vectors")).cast("double"))


def normalised(v: Column) -> Column:
    """The unit vector as floats, its norm taken in doubles."""
    norm = F.sqrt(squared_norm(v))
    return F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine distance of unit vectors."""
    return 1 - dot_product(a, b)


def distance(a: Column, b: Column, metric: str) -> Column:
    """By a collection's metric; the dot product is negated so that lower is nearer."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    same = F.size(a) == F.size(b)
    value = {"cosine": cosine_distance, "l2": l2_squared, "dot": lambda x, y: -dot_product(x, y)}[metric](a, b)
    return F.when(same, value).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def shown(value: Column, digits: int = 6) -> Column:
    """Rounded for results; adding zero turns a negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)
