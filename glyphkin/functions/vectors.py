"""Distances between array columns, in double precision inside whole-stage code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; inside a lambda over an array it would be computed for each entry."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cos; 1 where a vector is zero. Norms may be passed in where they are at hand."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def centred(a: Column) -> Column:
    return let(mean_of(a), lambda m: F.transform(a, lambda x: x.cast("double") - m))


def stretched(a: Column, floor: float = 1e-8) -> Column:
    """Entries moved and scaled to the range from 0 to 1; NaN stays, and is left out of the range."""
    numbers = F.filter(a, lambda x: ~F.isnan(x))
    span = F.struct(F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high"))
    return let(span, lambda s: F.transform(a, lambda x: (x - s["low"]) / (s["high"] - s["low"] + floor)))


def correlation_distance(a: Column, b: Column) -> Column:
    pair = F.struct(centred(a).alias("a"), centred(b).alias("b"))
    return let(pair, lambda p: cosine_distance(p["a"], p["b"]))


METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance, "correlation": correlation_distance}


def argmax(a: Column) -> Column:
    """Zero-based place of the first largest entry; null for an empty array."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def std_of(a: Column) -> Column:
    """Population standard deviation of an array's entries."""
    return let(mean_of(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / F.size(a)))
