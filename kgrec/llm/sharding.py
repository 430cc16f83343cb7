"""Sharding by a two-pass external shuffle, DataFrame functions only (operator 3).

Pass 1 scatters whole records uniformly, by a seeded hash, into buckets of about ``bucket_bytes``.  Pass 2 reads each
bucket as one bounded array, applies a seeded Fisher-Yates shuffle (``shuffle``) and writes it with each record's place.
The buckets one after the other are a random permutation of the table; shards are its consecutive slices, so their row
counts differ by one at most (law ``rows``).

The hash is of the record's place in the input files, so a group of equal rows spreads like any other rows; the
same files in the same splits give the same permutation.

Defined results: a null text has size 8; nulls, repeated rows and other columns are carried unchanged; an empty table
gives an empty result; fewer rows than shards leave the last shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgrec.llm.common import written

N_SHARDS = 24
SEED = 20_240_229
BUCKET_BYTES = 8 << 20   # text bytes of a bucket: a task holds a few copies of one


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``(record, bucket, place)``: the written buckets; ``record`` holds the columns of ``docs``."""
    total = docs.agg(F.sum(text_bytes(F.col("text")) + 8)).first()[0] or 0
    n_buckets = max(1, -(-int(total) // bucket_bytes))
    draw = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    records = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), draw.alias("draw"))
    scattered = (records.withColumn("bucket", F.pmod("draw", F.lit(n_buckets)).cast("int"))
                 .repartition(n_buckets, "bucket"))
    # The array is put in the order of the draws first, so that a task that is run again shuffles the same array.
    held = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("draw", "record"))).alias("rows"))
    mixed = held.select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    placed = mixed.select("bucket", F.posexplode("rows").alias("place", "row"))
    return written(placed.select("row.record", "bucket", "place"), "shard-buckets")


def cut(rows: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows of ``bucket`` and ``place``."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))  # a row for each bucket
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(W.partitionBy())
    starts = sizes.select("bucket", before.alias("bucket_start"), total.alias("n_rows"))
    at, n = F.col("bucket_start") + F.col("place"), F.col("n_rows")
    least, longer = F.expr(f"n_rows div {n_shards}"), F.col("n_rows") % n_shards  # the first ``longer`` shards have one more
    there = rows.join(starts, "bucket").withColumns({"at": at, "least": least, "longer": longer})
    edge = F.expr("longer * (least + 1)")
    shard = F.when(F.col("at") < edge, F.expr("at div (least + 1)")).otherwise(
        F.expr("longer + (at - longer * (least + 1)) div greatest(least, 1)"))
    first = F.col("shard") * F.col("least") + F.least("shard", "longer")
    return (there.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("at") - first)
            .drop("bucket_start", "n_rows", "at", "least", "longer"))


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, seed: int = SEED) -> None:
    """``(record, slot)`` in folders ``shard=K`` under ``path``; files hold their rows in slot order.

    A bucket's rows go to one file of each shard that its slice reaches.
    """
    placed = cut(shuffled(docs, seed), n_shards)
    n = placed.agg(F.max("bucket")).first()[0] or 0
    (placed.repartition(n + 1, "bucket").sortWithinPartitions("shard", "slot").select("record", "slot", "shard")
     .write.partitionBy("shard").parquet(path))
