"""Integer vectors of an embedding table, exact in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.llm.common import ship

#: Doubles from here on have no fraction.
_WHOLE = float(1 << 52)


def scaled(vector: Column, scale: int) -> Column:
    """``floor(scale * c)`` of every component, as doubles without a fraction."""

    def whole(c: Column) -> Column:
        product = c.cast("double") * F.lit(float(scale))
        return F.when(F.abs(product) < F.lit(_WHOLE), F.floor(product).cast("double")).otherwise(product)

    return F.transform(vector, whole)


def integer_vectors(rows: DataFrame, scale: int, limit: float = float("inf")) -> DataFrame:
    """``vec_id, vector`` of the rows whose vector is there and whole: no null, no component that isn't finite.

    A component whose scaled value reaches ``limit`` counts as not finite. Other columns, whatever their names, stay
    behind; repeated rows, null ids and empty vectors stay.
    """
    ship(rows.sparkSession)
    own = rows.select(F.col("vec_id").cast("long"), scaled(F.col("embedding"), scale).alias("vector"))
    fits = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(limit)))
    return own.where(F.col("vector").isNotNull() & fits)


def longest(rows: DataFrame) -> int:
    """The number of dimensions; shorter vectors are read as ending in zeros."""
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors as the rows of a matrix, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    filled = np.zeros((len(sizes), dim), values.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    filled[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return filled
