"""File sources and sinks: S1-S14, K1-K11.

Every reader fixes its schema up front (no inference pass over 100 TB).  Sinks write partitioned
parquet or delimited text through the DataFrame writer; nothing goes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgrec.functions.text import entity_from_path
from kgrec.session import ensure_checkpoint_dir

RATINGS_SCHEMA = "user_id bigint, item_id bigint, rating int"
MAPPING_SCHEMA = "item_id bigint, name string"
RELATION_SCHEMA = "rel_id int, relation string"
TRIPLE_SCHEMA = "head string, relation string, tail string"
PREDICTION_SCHEMA = "user_id bigint, item_id bigint, score double"
ATOMIC_TYPES = {"token": T.StringType(), "float": T.DoubleType(), "int": T.LongType(),
                "token_seq": T.StringType(), "float_seq": T.StringType()}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory (``session.ensure_checkpoint_dir``)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/kgrec-{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _tsv(spark: SparkSession, schema, header: bool = False):
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("mode", "FAILFAST")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``user \\t item \\t rating``."""
    return _tsv(spark, RATINGS_SCHEMA).csv(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``id \\t title;uri`` (S3)."""
    return _tsv(spark, MAPPING_SCHEMA).csv(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relation vocabulary with CRLF line ends (S4): the trailing carriage return is removed."""
    df = _tsv(spark, RELATION_SCHEMA).csv(path)
    return df.select("rel_id", F.regexp_replace("relation", "\r$", "").alias("relation"))


def read_interactions_headered(spark: SparkSession, path: str) -> DataFrame:
    """Headered ``user_row_index, edge, artist`` (S2), schema fixed, header skipped."""
    return _tsv(spark, "user_row_index bigint, edge string, artist string", header=True).csv(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Headerless triples."""
    return _tsv(spark, TRIPLE_SCHEMA).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, PREDICTION_SCHEMA).csv(path)


def atomic_schema(header_line: str) -> T.StructType:
    """``user_id:token\\titem_id:token\\tlabel:float`` -> StructType."""
    fields = []
    for cell in header_line.rstrip("\r\n").split("\t"):
        name, _, typ = cell.partition(":")
        fields.append(T.StructField(name, ATOMIC_TYPES.get(typ, T.StringType()), True))
    return T.StructType(fields)


def read_atomic(spark: SparkSession, path: str) -> DataFrame:
    """Typed-header file: only the first line of one file is read to build the schema.

    A header-only file gives 0 rows with the right schema.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path}: no header line")
    schema = atomic_schema(first[0][0])
    return _tsv(spark, schema, header=True).csv(path)


def write_atomic(df: DataFrame, path: str, types: dict[str, str], mode: str = "overwrite") -> None:
    """Inverse of ``read_atomic`` (K8): header cells ``name:type``."""
    renamed = df.select(*[F.col(c).alias(f"{c}:{types.get(c, 'token')}") for c in df.columns])
    renamed.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = False) -> None:
    """Headerless TSV sink (K2, K6, K7)."""
    df.write.mode(mode).option("sep", "\t").option("header", header).csv(path)


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    """Folder of one-JSON-object-per-file documents, entity id taken from the file name.

    Output ``(entity, key, values array<string>)``: array values are their elements, any other value
    is one element.  The JSON token decides (a string may well start with ``[``).
    """
    raw = spark.read.option("wholetext", True).text(path).select(
        entity_from_path(F.col("_metadata.file_path")).alias("entity"),
        F.from_json("value", "map<string,variant>").alias("doc"))
    return _doc_values(raw)


def json_values(lines: DataFrame) -> DataFrame:
    """``(entity, key, values)`` of JSON objects in ``(entity, value)``, one object a row (K1 read back)."""
    return _doc_values(lines.select("entity", F.from_json("value", "map<string,variant>").alias("doc")))


def _doc_values(docs: DataFrame) -> DataFrame:
    kv = docs.select("entity", F.explode("doc").alias("key", "raw"))
    is_array = F.schema_of_variant("raw").startswith("ARRAY")
    return kv.select("entity", "key", F.when(is_array, F.try_variant_get("raw", "$", "array<string>"))
                     .otherwise(F.array(F.try_variant_get("raw", "$", "string"))).alias("values"))


def write_json_docs(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    """Property records (K1): JSON lines, partitioned by run instead of one file per entity."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_store(df: DataFrame, path: str, partition_by: list[str], mode: str = "overwrite") -> None:
    """Partitioned parquet store (K3-K6): dynamic overwrite replaces only the written partitions."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Partitioned parquet store with partition discovery (S10): filters on partition columns prune."""
    return spark.read.parquet(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Existing table or an empty frame with ``schema``."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_id_map(df: DataFrame, path: str) -> None:
    """Entity id map ``entity \t id`` without header (K3)."""
    write_tsv(df.select("entity", "id"), path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """``(entity, id)`` of an id map file."""
    return _tsv(spark, "entity string, id bigint").csv(path)


def write_dictionary(df: DataFrame, path: str) -> None:
    """A dictionary from names to ids as a two-column table (what a pickled dictionary holds; S11)."""
    df.select(F.col("name").cast("string").alias("name"), F.col("id").cast("bigint").alias("id")).write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(name, id)``, the schema fixed; joined, never collected."""
    return spark.read.schema("name string, id bigint").parquet(path)


def write_matrix(df: DataFrame, path: str, dim: int) -> None:
    """Embedding matrix as TSV with the id in the first column (K4): position never matters."""
    cells = [F.col("id").cast("string")] + [F.col("vec")[d].cast("string") for d in range(dim)]
    df.select(F.concat_ws("\t", *cells).alias("line")).write.mode("overwrite").text(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``id \\t v0 ... v{d-1}`` -> ``(id, vec array<double>)``."""
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).select(
        parts.getItem(0).cast("bigint").alias("id"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"))


def read_positional_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Legacy matrix without ids: row i of the file is id i (S8 import path).

    File order is only recoverable from the input splits, so this uses ``zipWithIndex`` on the text
    RDD (splits are kept in file order there); everything after is DataFrame work.
    """
    rdd = spark.sparkContext.textFile(path).zipWithIndex().map(lambda t: (t[1], t[0]))
    df = spark.createDataFrame(rdd, "id bigint, line string")
    parts = F.split(F.col("line"), "\t")
    return df.select("id", F.transform(parts, lambda x: x.cast("double")).alias("vec"))


def append_log(spark: SparkSession, path: str, rows: list[tuple[str, str, str]]) -> None:
    """Run log rows ``(run, status, message)`` appended as parquet."""
    spark.createDataFrame(rows, "run string, status string, message string").write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in the file system that Spark resolves it to (never the driver's own disk)."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the file system that Spark resolves it to."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in hpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hpath)]


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a marker."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(hpath, True).close()


def write_topk_lists(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Top-k lists of every setting and cut-off in one write, partitioned by (setting, k) (K6)."""
    write_store(df, path, ["setting", "k"], mode)


def read_topk_lists(spark: SparkSession, path: str, k: int) -> DataFrame:
    """Lists of one cut-off (S12): equality on the partition column ``k`` (so 5 never matches 50);
    the filter prunes partitions at planning time."""
    return read_store(spark, path).filter(F.col("k") == k)
