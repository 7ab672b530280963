"""Vector arithmetic on ``array<float|double>`` columns; everything is computed in double."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranking and threshold tests use similarities rounded to this many decimals, so that equal
# vectors tie exactly no matter which code path multiplied them.
SIM_DECIMALS = 9


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def unit(vec: Column) -> Column:
    """L2-normalise; a zero vector stays zero.

    The norm goes in through ``array_repeat`` so that it is evaluated once per row; inside the
    lambda it would be evaluated once per element.
    """
    v = doubles(vec)
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 where either is the zero vector."""
    da, db = doubles(a), doubles(b)
    return dot(da, db) / (F.greatest(norm(da), F.lit(1e-12)) * F.greatest(norm(db), F.lit(1e-12)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def unit_euclid_from_cosine(cos: Column) -> Column:
    """Distance of two unit vectors from their cosine, clipped against rounding."""
    return F.sqrt(F.least(F.greatest(2.0 - 2.0 * cos, F.lit(0.0)), F.lit(4.0)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)),
            F.lit(0.0), lambda s, x: s + x,
        )
    )


def mean_vector(vec: Column) -> Column:
    """Aggregate: element-wise mean. One buffer per group and map task is shuffled, not the rows."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(vec))))


def sum_vector(vec: Column) -> Column:
    """Aggregate: element-wise sum."""
    return vector_to_array(Summarizer.sum(array_to_vector(doubles(vec))))


def has_dim(vec: Column, dim: int) -> Column:
    return vec.isNotNull() & (F.size(vec) == dim)


def check_dim(vec: Column, dim: int) -> Column:
    """P16 strict form: the vector itself, or an error that names both lengths."""
    message = F.concat(
        F.lit("embedding has dimension "), F.coalesce(F.size(vec).cast("string"), F.lit("NULL")),
        F.lit(f", expected {dim}"),
    )
    return F.when(has_dim(vec, dim), vec).otherwise(F.raise_error(message))
