"""Vector expressions over array columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 if a norm is 0; an error if the lengths differ."""
    n = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    value = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def usable(v: Column, dimension: int | None = None) -> Column:
    """Not null, not empty, of the dimension if one is given, and every number finite."""
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return ok & (F.size(v) == dimension) if dimension else ok
