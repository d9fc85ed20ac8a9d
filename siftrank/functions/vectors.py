"""Vector columns (arrays of floating point numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftrank.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(vector, lambda own: let(F.sqrt(dot(own, own)), lambda norm: F.transform(
        own, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))
    )))


def blend(a: Column, b: Column) -> Column:
    """Mean of two vectors, not brought back to unit length."""
    return F.zip_with(a, b, lambda x, y: 0.5 * x.cast("double") + 0.5 * y.cast("double"))


def checked_dimension(vector: Column, dimension: int) -> Column:
    """The vector, or an error naming the wrong length."""
    return F.when(F.size(vector) == dimension, vector).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {dimension} numbers, got "), F.size(vector).cast("string")))
    )
