"""Aggregate functions as Columns: what a group keeps, how two such parts merge, and the result.

``kind`` tells what a part is: one number (distributive), a fixed set of numbers (algebraic) or all values (holistic).
It decides how a query goes: no query keeps parts of holistic functions, in batch, in sessions or in a stream. They
count different values instead, and aggregate the counts of a group in the order of its values. Values are longs. A result
over no values is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOf = Callable[[Column], Column]
#: From a group's different values to an aggregation of them: the value, how often it occurs, how many values there are
#: up to it (itself included), and how many in all. A group without values has one row with a null value and zeros.
OverCounts = Callable[[Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class Part:
    """One number that a group keeps."""

    suffix: str
    lift: ColumnOf
    merge: ColumnOf


@dataclass(frozen=True)
class Aggregate:
    name: str
    kind: Literal["distributive", "algebraic", "holistic"]
    parts: tuple[Part, ...] = ()
    #: From the parts, in their order, to the result; a holistic function has ``over_counts`` in their place.
    lower: Callable[..., Column] | None = None
    over_counts: OverCounts | None = None

    def __post_init__(self) -> None:
        holistic = self.kind == "holistic"
        if holistic != (self.over_counts is not None) or holistic == bool(self.parts) or holistic != (self.lower is None):
            raise ValueError("a holistic function aggregates counts of ranked values, all others have parts and lower them")

    def lifted(self, value: Column, prefix: str) -> list[Column]:
        return [p.lift(value).alias(prefix + p.suffix) for p in self.parts]

    def merged(self, prefix: str) -> list[Column]:
        return [p.merge(F.col(prefix + p.suffix)).alias(prefix + p.suffix) for p in self.parts]

    def lowered(self, prefix: str) -> Column:
        return self.lower(*[F.col(prefix + p.suffix) for p in self.parts])


def at_place(place: ColumnOf) -> OverCounts:
    """The value at a place (from 0) of the sorted values, which depends on how many there are."""
    return lambda value, n, upto, total: F.max(F.when((upto > place(total)) & (upto - n <= place(total)), value))


def most_frequent(value: Column, n: Column, upto: Column, total: Column) -> Column:
    """The most frequent value; of several the least."""
    return F.max_by(value, F.struct(n, F.bitwise_not(value)))  # -x - 1: no value is too small for it


def mean_between(low: ColumnOf, high: ColumnOf) -> OverCounts:
    """The truncated mean of the sorted values from place ``low`` up to, but not at, place ``high``."""

    def mean(value: Column, n: Column, upto: Column, total: Column) -> Column:
        inside = F.greatest(F.least(upto, high(total)) - F.greatest(upto - n, low(total)), F.lit(0))
        return _quotient(F.sum(value * inside), F.sum(inside))

    return mean


def _one(name: str, function: ColumnOf) -> Aggregate:
    return Aggregate(name, "distributive", (Part("", function, function),), lambda x: x)


def _quotient(total: Column, count: Column) -> Column:
    """The quotient without its fraction (toward zero)."""
    return F.when(count > 0, F.call_function("div", total, count))


_REGISTRY: dict[str, Aggregate] = {}


def register_aggregate(function: Aggregate) -> Aggregate:
    """Make a function known by its name; a name can be taken once."""
    if function.name in _REGISTRY:
        raise ValueError(f"there is an aggregate function of this name: {function.name}")
    _REGISTRY[function.name] = function
    return function


def aggregate(name: str) -> Aggregate:
    try:
        return _REGISTRY[name.strip()]
    except KeyError:
        raise ValueError(f"unknown aggregate function: {name}") from None


def aggregate_names() -> list[str]:
    return sorted(_REGISTRY)


register_aggregate(_one("SUM", F.sum))
register_aggregate(_one("MIN", F.min))
register_aggregate(_one("MAX", F.max))
register_aggregate(Aggregate("AVG", "algebraic", (Part("_sum", F.sum, F.sum), Part("_count", F.count, F.sum)), _quotient))
register_aggregate(Aggregate("MEDIAN", "holistic", over_counts=at_place(lambda total: F.floor(total / 2))))
# The latest of values that are times; none of them has to hold more than one number.
register_aggregate(_one("M_SUM", F.max))
register_aggregate(Aggregate("M_AVG", "algebraic", (Part("_max", F.max, F.max), Part("_count", F.count, F.sum)), lambda most, count: F.when(count > 0, most)))
register_aggregate(_one("M_MEDIAN", F.max))
register_aggregate(Aggregate("M_MIN", "distributive", (Part("", lambda v: F.min(-v), F.min),), F.abs))
