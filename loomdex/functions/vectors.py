"""Vector expressions over ARRAY<FLOAT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: digits kept when a vector is stored.
STORED_DECIMALS = 6


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision; equals the cosine for unit vectors."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector comes back unchanged."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(
        F.transform(vector, lambda x: x.cast("double") / norm)
    )


def stored_precision(vector: Column) -> Column:
    """Vector as the store keeps it: six decimals, single precision."""
    return F.transform(vector, lambda x: F.round(x.cast("double"), STORED_DECIMALS).cast("float"))
