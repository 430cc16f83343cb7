"""Token ids in files: frequency-ranked, byte-aligned variable length, control bytes apart (operator 4).

``write``  tokenizes whole texts, ranks ids by their corpus frequency and writes block files in ascending
           ``doc_id`` order; ``read`` decodes them with numpy table lookups.

A block is one binary value (layout below), carried by Parquet so that any store Spark can write to
holds it and commits are atomic:

    u32 magic, u32 documents, u64 ids | i64 doc_id x documents | u8 has_id x documents | u32 ids x documents
    | control bytes: 2 bits for each id, its number of data bytes less one, four ids to a byte
    | data bytes: each id's frequency rank, little-endian

The most frequent 256 ids take one data byte, the next 65,280 two.  ``ranks`` beside the blocks lists the ids by rank.

Defined results: a null text is an empty one, and its document holds the end id alone; documents without an id come
first; rows of equal id lie next to each other in the order of their ids; an empty table gives no block; other
columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgrec.llm.common import written
from kgrec.llm.tokens import encoder, forget, in_slices

END_ID = 2
MAGIC = 0x6B74696C
HEAD = struct.Struct("<IIQ")
BLOCK_IDS = 1 << 18            # a block is closed at this many ids; a longer document stays whole
BLOCK_SCHEMA = "part int, inside bigint, n_tokens bigint, payload binary"  # inside: ids of the part's blocks before it
MOST_PARTS = 1_000_000         # files up to which the table of their starts is broadcast
ROWS_A_FILE = 20_000           # documents of an output file, about
# How many data bytes each of a control byte's four ids has, and their sum.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def _narrow(ids: bytes) -> bytes:
    """Ids as 16-bit integers where all fit, else unchanged; the first byte tells which."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids


def _wide(kept: bytes) -> np.ndarray:
    return np.frombuffer(kept, f"<u{kept[0]}", offset=1).astype("<u4")


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, kept)`` with all ids of each whole text and the end id."""
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        rows = ((doc, _narrow(enc.encode(text.as_py()) + end)) for b in batches
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for part in in_slices(rows, lambda r: len(r[1])):
            doc, kept = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, kept binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """``(id, n)`` over the whole corpus; a task sends one row for each id it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in in_slices((_wide(kept.as_buffer()) for kept in batch.column(0)), len, BLOCK_IDS):  # not a whole vocabulary for each document
                n = np.bincount(np.concatenate(part), minlength=len(total))
                n[:len(total)] += total
                total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return tokens.select("kept").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int, ids_by_rank: np.ndarray) -> np.ndarray:
    """The ids back: lengths by table from the control bytes, ids by table from the ranks."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    ranks = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            ranks[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ids_by_rank[ranks]


def block_bytes(docs: list[tuple[int | None, np.ndarray]], rank_of: np.ndarray) -> tuple[int, bytes]:
    """Number of ids and bytes of a block."""
    ids = [r[1] for r in docs]
    flat = np.concatenate(ids)
    control, data = encode(rank_of[flat])
    names = np.array([r[0] or 0 for r in docs], "<i8").tobytes()
    named = np.array([r[0] is not None for r in docs], np.uint8).tobytes()
    sizes = np.array([len(x) for x in ids], "<u4").tobytes()
    return len(flat), HEAD.pack(MAGIC, len(docs), len(flat)) + names + named + sizes + control + data


def block_docs(raw: np.ndarray, ids_by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Document ids, which of them are given, numbers of ids, and all ids of a block."""
    magic, n_docs, n = HEAD.unpack(raw[:HEAD.size].tobytes())
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEAD.size
    names, at = raw[at:at + 8 * n_docs].view("<i8"), at + 8 * n_docs
    named, at = raw[at:at + n_docs].astype(bool), at + n_docs
    sizes, at = np.frombuffer(raw[at:at + 4 * n_docs].tobytes(), "<u4").astype(np.int64), at + 4 * n_docs
    control, data = raw[at:at + -(-n // 4)], raw[at + -(-n // 4):]
    return names, named, sizes, decode(control, data, n, ids_by_rank).astype("<u4").tobytes()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Block files under ``path/blocks`` and the rank table under ``path/ranks``."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, tokenizer_path, end_id), "tokens", compression="zstd")
    by_rank = id_counts(tokens).orderBy(F.desc("n"), "id").select("id")
    by_rank.coalesce(1).write.parquet(f"{path}/ranks")  # one row for each id of the vocabulary at most
    ids_by_rank = ids_in_order(spark, path)
    rank_of = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
    table = spark.sparkContext.broadcast(rank_of)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the tables of the tokenizing stage
        part, at = TaskContext.get().partitionId(), 0
        rows = ((doc, _wide(kept.as_buffer())) for b in batches for doc, kept in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for docs_in in in_slices(rows, lambda r: len(r[1]), block_ids):
            n, payload = block_bytes(docs_in, table.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "inside", "n_tokens", "payload"])
            at += n

    n_files = max(1, -(-tokens.count() // ROWS_A_FILE), spark.sparkContext.defaultParallelism)
    ordered = tokens.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "kept")
    (ordered.mapInArrow(blocks, BLOCK_SCHEMA)
     .write.option("compression", "zstd").parquet(f"{path}/blocks"))


def ids_in_order(spark: SparkSession, path: str) -> np.ndarray:
    """Ids by frequency rank (at most the vocabulary)."""
    ranks = spark.read.schema("id bigint").parquet(f"{path}/ranks")
    counted = [r[0] for r in ranks.withColumn("at", F.monotonically_increasing_id()).orderBy("at").select("id").collect()]
    return np.array(counted, np.uint32)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in file order; ids are little-endian 32-bit integers."""
    table = spark.sparkContext.broadcast(ids_in_order(spark, path))
    files = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    starts = part_starts(files)
    if starts.count() <= MOST_PARTS:  # a row of two numbers for each file
        starts = F.broadcast(starts)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(value.as_buffer(), np.uint8)
                names, named, sizes, ids = block_docs(raw, table.value)
                ends = np.cumsum(sizes)
                values = [ids[4 * (e - s):4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, mask=~named), pa.array(start + ends - sizes), pa.array(sizes), pa.array(values, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    placed = files.select("part", "inside", "payload").join(starts, "part")
    return placed.select(F.col("part_start") + F.col("inside"), "payload").mapInArrow(
        unpack, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def part_starts(files: DataFrame) -> DataFrame:
    """``(part, part_start)``: ids in all files before."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
