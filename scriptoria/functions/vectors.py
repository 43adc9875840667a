"""Frame signatures as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptoria.functions.text import bound


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)


def magnitude(v: Column) -> Column:
    return mean(F.transform(v, F.abs))


def signature(vector: Column, device: bool = False) -> Column:
    """Zero mean and unit mean magnitude, in double precision; the device twin floors the scale at 1e-6 instead of adding it.

    Mean and scale are bound to lambda arguments, so that they are computed once a row, not once a component.
    """
    scale = (lambda v: F.greatest(magnitude(v), F.lit(1e-6))) if device else (lambda v: magnitude(v) + F.lit(1e-6))
    centred = bound(vector.cast("array<double>"), lambda v: bound(mean(v), lambda m: F.transform(v, lambda x: x - m)))
    return bound(centred, lambda v: bound(scale(v), lambda k: F.transform(v, lambda x: x / k)))


def mean_abs_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
