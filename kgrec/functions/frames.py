"""Small DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate (counts, means) to every row of ``df``.

    The one-row side is broadcast on a constant key; its size is one row by construction.
    """
    left = df.withColumn("_one", F.lit(1))
    right = one_row.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(right), "_one").drop("_one")
