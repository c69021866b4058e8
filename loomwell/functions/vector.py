"""Vector functions on array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def once(c: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(c), use)[0]


def normalised(v: Column) -> Column:
    """Length 1; a vector of zeros stays."""
    return once(v, lambda w: once(F.greatest(norm(w), F.lit(1e-12)), lambda n: F.transform(w, lambda x: x.cast("double") / n)))


def similarity_score(distance: Column) -> Column:
    return 1 / (1 + F.coalesce(distance, F.lit(1.0)))
