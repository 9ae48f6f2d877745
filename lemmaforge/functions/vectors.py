"""Vector arithmetic over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    """Inner product; null when the lengths differ (zip_with pads with null)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays zero. The vector and its length are elements of arrays, so that each is computed once."""
    scaled = lambda v: F.transform(F.array(F.greatest(norm(v), F.lit(EPS))), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]
    return F.transform(F.array(a), scaled)[0]


def first_vector(states: Column) -> Column:
    """Pooling by the first position."""
    return states[0]


def last_vector(states: Column, mask: Column) -> Column:
    """Pooling by the last position that the mask keeps."""
    return F.element_at(states, F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")))
