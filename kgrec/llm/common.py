"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from kgrec.sources.files import scratch_path

WORD = r"[^\x20\x09-\x0D]+"     # a word: a run without ASCII white space
LETTERS = "#*$%&|<>"            # symbols counted by the quality statistics
RANK_SLICES = 512               # a cell of ``ranked`` holds at most 1 / RANK_SLICES of all rows ...
RANK_ROWS = 50_000              # ... and at most about this many


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends at the files."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(schema: T.StructType, **types: T.DataType) -> T.StructType:
    """A copy of ``schema`` with more fields."""
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in types.items())])


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64-bit hash of all columns of a row; wholly equal rows share it."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])


def keyed_rows(df: DataFrame) -> DataFrame:
    """``(key, row)``: two hashes of the whole row, and the row as it is, so that no column's name can clash."""
    return df.select(F.struct(row_hash(df).alias("h0"), row_hash(df, 1).alias("h1")).alias("key"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def ranked(df: DataFrame, keys: list[str], counts: DataFrame, salt: Column, order: list, name: str = "rank",
           carry: list[str] = ()) -> DataFrame:
    """Adds ``name``: a gapless number from 0 within ``keys``, without one task per key; and ``carry`` from ``counts``.

    ``counts`` has the keys and their row count ``n``.  Each key is cut by ``salt`` into cells of a bounded
    share of all rows; rows are numbered inside their cell and a cell starts where the cells before it end.
    Keys must not be null.  The order within a key is that of (cell, ``order``).
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    per = max(1.0, min(total / RANK_SLICES, RANK_ROWS))
    cells = counts.select(*keys, *carry, F.ceil(F.col("n") / F.lit(per)).alias("n_cells"))
    dealt = df.join(cells, keys).withColumn("rank_cell", F.pmod(salt, F.col("n_cells"))).drop("n_cells")
    sizes = dealt.groupBy(*keys, "rank_cell").agg(F.count("*").alias("cell_rows"))
    before = W.partitionBy(*keys).orderBy("rank_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "rank_cell", F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("cell_start"))
    here = F.row_number().over(W.partitionBy(*keys, "rank_cell").orderBy(*order))
    return (dealt.withColumn("rank_here", here).join(starts, [*keys, "rank_cell"])
            .withColumn(name, F.col("cell_start") + F.col("rank_here") - 1)
            .drop("rank_cell", "rank_here", "cell_start"))
