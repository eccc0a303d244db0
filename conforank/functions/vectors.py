"""Vector arithmetic on array<double> columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor of a vector norm, and the addition to a standard deviation.
NORM_FLOOR = 1e-12
DEVIATION_EPS = 1e-6


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x * factor)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(v, lambda x: x / length)


def vector_mean(v: Column | str, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean as an aggregate with map-side combine."""
    vec = array_to_vector(doubles(v))
    agg = Summarizer.mean(vec) if weight is None else Summarizer.mean(vec, weight)
    return vector_to_array(agg)


def vector_sum(v: Column | str) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(v))))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """``(x - mean) / (std + eps)``; the deviation of a single value is NaN."""
    return (x - mean) / (F.coalesce(std, F.lit(float("nan"))) + F.lit(DEVIATION_EPS))
