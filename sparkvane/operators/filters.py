"""Payload filters: trees of conditions over a VARIANT column, compiled to a column."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPES = {bool: ("BOOLEAN",), int: ("BIGINT", "INT", "SMALLINT", "TINYINT"), float: ("DOUBLE", "FLOAT", "DECIMAL"), str: ("STRING",)}


def _path(name: str) -> str:
    if not name or '"' in name or "'" in name:
        raise ValueError("a field's name can't be empty or have quotes")
    return f'$["{name}"]'


def _kind(payload: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(payload, _path(name), "variant"))


@dataclass(frozen=True)
class Equals:
    """A value of the same type: 1 and "1" differ."""

    field: str
    value: str | int | float | bool

    def column(self, payload: Column) -> Column:
        kind = type(self.value)
        to = {bool: "boolean", int: "bigint", float: "double", str: "string"}[kind]
        found = _kind(payload, self.field)
        typed = reduce(lambda a, b: a | b, [found.startswith(t) for t in _TYPES[kind]])
        return F.coalesce(typed & (F.try_variant_get(payload, _path(self.field), to) == F.lit(self.value)), F.lit(False))


@dataclass(frozen=True)
class Range:
    """Bounds on a number; each may be left out. What isn't a number doesn't match."""

    field: str
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None

    def column(self, payload: Column) -> Column:
        found = _kind(payload, self.field)
        number = reduce(lambda a, b: a | b, [found.startswith(t) for t in (*_TYPES[int], *_TYPES[float])])
        value = F.try_variant_get(payload, _path(self.field), "double")
        tests = [test(value, F.lit(float(bound))) for bound, test in ((self.gt, Column.__gt__), (self.gte, Column.__ge__), (self.lt, Column.__lt__), (self.lte, Column.__le__)) if bound is not None]
        return F.coalesce(reduce(lambda a, b: a & b, tests, number), F.lit(False))


@dataclass(frozen=True)
class Exists:
    field: str

    def column(self, payload: Column) -> Column:
        return F.coalesce(F.try_variant_get(payload, _path(self.field), "variant").isNotNull(), F.lit(False))


@dataclass(frozen=True)
class Filter:
    """All of must, some of should (if any is given) and none of must_not; an empty one accepts all."""

    must: tuple[Equals | Range | Exists, ...] = ()
    should: tuple[Filter | Equals | Range | Exists, ...] = ()
    must_not: tuple[Filter | Equals | Range | Exists, ...] = field(default=())

    def column(self, payload: Column) -> Column:
        out = reduce(lambda a, b: a & b, [c.column(payload) for c in self.must], F.lit(True))
        if self.should:
            out = out & reduce(lambda a, b: a | b, [c.column(payload) for c in self.should])
        if self.must_not:
            out = out & ~reduce(lambda a, b: a | b, [c.column(payload) for c in self.must_not])
        return out
