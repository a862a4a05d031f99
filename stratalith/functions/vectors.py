"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a null, empty or all-zero vector. Vectors of unequal length are an error."""
    usable = (F.size(a) > 0) & (F.size(b) > 0)
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double"))
    return F.when(usable, F.coalesce(same, 1 - F.try_divide(dot(a, b), norm(a) * norm(b))))


def similarity_score(distance: Column) -> Column:
    """Score of a cosine distance on the scale of search engines: (2 - d) / 2."""
    return (2 - distance) / 2


def distance_of(score: Column) -> Column:
    return 2 - 2 * score
