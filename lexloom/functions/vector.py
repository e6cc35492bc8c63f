"""Distances of float arrays as Columns, computed in double. All sort ascending: nearer is smaller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN for a vector of length zero, null for a null one."""
    d = dot(a, b)
    return F.when(d.isNotNull(), F.coalesce(1 - F.try_divide(d, norm(a) * norm(b)), F.lit(float("nan"))))


def euclidean_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS = {
    "cosine_distance": cosine_distance,
    "euclidean_distance": euclidean_distance,
    "negative_inner_product": negative_inner_product,
}


def metric(name: str):
    """The distance of that name; any other name is a ValueError."""
    if name not in METRICS:
        raise ValueError(f"Unknown method: {name!r}; known are {', '.join(METRICS)}")
    return METRICS[name]


def literal(vector) -> Column:
    """A query vector, narrowed to float as the stored ones are."""
    return F.array(*[F.lit(float(x)).cast("float") for x in vector])
