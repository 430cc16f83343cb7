"""Best-fit packing of token sequences by exact-complement hashing (operator 2).

``pieces``   documents to token pieces of at most ``max_len`` ids.
``place``    gives every row of a table with a ``length`` its ``sequence_id`` and ``offset``.
``pack``     both, with the ids; ``sequences`` joins placed pieces into the packed sequences.

Only the number of pieces of each length matters for a packing, and there are at most ``max_len`` lengths.  So the
driver plans on that histogram (at most 4096 counts, whatever the corpus): it indexes which lengths are in stock
and which sums two and three of them make, opens a sequence with the longest piece, closes the gap with the one, two or
three pieces that fill it exactly, adds the best-fitting piece where none do, and uses the pattern as often as the
stock allows.  Spark numbers the pieces of each length (in salted cells) and each looks up its place by binary search.

Defined results: a null text is an empty one; an empty document is the end id alone; repeated rows are packed as
often as they occur; null ids are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgrec.llm.common import ranked, with_fields, written
from kgrec.llm.tokens import encoder, in_slices

MAX_LEN = 4096
END_ID = 1
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: ids are little-endian unsigned 32-bit integers."""
    end = np.uint32(end_id).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = enc.encode(text.as_py()) + end
                    for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                        yield doc, k, at // 4, (part := ids[at:at + 4 * max_len]), len(part) // 4

        for part in in_slices(rows(), lambda r: len(r[3])):
            doc, k, at, ids, n = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)


class Stock:
    """How many pieces of each length are left, and an index of the sums that one, two or three of them make."""

    def __init__(self, counts: dict[int, int], max_len: int):
        self.left = np.zeros(max_len + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.index()

    def index(self) -> None:
        """Hash the sums of singles and pairs (a triple is a single whose rest is a pair)."""
        self.lengths = np.flatnonzero(self.left)[::-1]
        single = 0
        for length in self.lengths.tolist():
            single |= 1 << length
        pair = 0
        for length in self.lengths.tolist():
            pair |= single << length
        size = len(self.left)
        raw = (pair & ((1 << size) - 1)).to_bytes(size // 8 + 1, "little")
        self.pair_sums = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:size].astype(bool)
        self.misses = 0

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n

    def largest(self, most: int) -> int:
        """Best fit: the longest piece of at most ``most``."""
        lengths = self.lengths[np.searchsorted(-self.lengths, -most):]
        here = np.flatnonzero(self.left[lengths] > 0)
        return int(lengths[here[0]]) if len(here) else 0

    def pair(self, total: int) -> tuple[int, ...]:
        longer = self.lengths[(self.lengths < total) & (2 * self.lengths >= total)]
        rest = total - longer
        ok = np.flatnonzero((self.left[longer] > 0) & (self.left[rest] > (rest == longer)))
        return (int(longer[ok[0]]), int(rest[ok[0]])) if len(ok) else ()

    def exact(self, gap: int, most: int = 3) -> tuple[int, ...]:
        """One, two or three (``most``) pieces in stock that fill the gap exactly, longest first; else nothing."""
        if self.left[gap] > 0:
            return (gap,)
        if most < 2:
            return ()
        if self.pair_sums[gap] and (two := self.pair(gap)):
            return two
        if most < 3:
            return ()
        firsts = self.lengths[(self.lengths <= gap - 2) & (3 * self.lengths >= gap)]
        firsts = firsts[(self.left[firsts] > 0) & self.pair_sums[gap - firsts]]
        for first in firsts.tolist():
            self.left[first] -= 1
            two = self.pair(gap - first)
            self.left[first] += 1
            if two:
                return (first, *two)
            self.misses += 1  # the index names sums whose pieces have run out since
        return ()


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> np.ndarray:
    """Rows ``(length, first rank, last rank + 1, first sequence, copies a sequence, first offset)``.

    Pieces of ``length`` with these ranks go ``copies`` to a sequence, one after the other from the offset on.  Unless that
    needs no more sequences than all tokens fill, gaps are also closed by two pieces, and by one, at most: where
    long pieces prevail that can spare short ones; the fewest sequences win.
    """
    least = -(-sum(length * n for length, n in counts.items()) // max_len)
    best, fewest = None, None
    for most in (3, 2, 1):
        n, rows = _plan(counts, max_len, most)
        if fewest is None or n < fewest:
            best, fewest = rows, n
        if fewest == least:
            break
    return best


def _plan(counts: dict[int, int], max_len: int, most: int) -> tuple[int, np.ndarray]:
    stock = Stock(counts, max_len)
    used: Counter[int] = Counter()
    rows, sequence, left = [], 0, sum(counts.values())
    while left:
        if stock.misses > 32:
            stock.index()
        pattern, gap = [], max_len
        while gap:
            parts = stock.exact(gap, most) if pattern else ()
            if not parts and (best := stock.largest(gap)):
                parts = (best,)
            if not parts:
                break
            for length in parts:
                stock.take(length)
                pattern.append(length)
            gap -= sum(parts)
        copies = Counter(pattern)
        times = 1 + min(int(stock.left[length]) // n for length, n in copies.items())
        offset = 0
        for length, n in copies.items():
            stock.take(length, n * (times - 1))
            rows.append((length, used[length], used[length] + n * times, sequence, n, offset))
            used[length] += n * times
            offset += length * n
        sequence += times
        left -= times * len(pattern)
        if not stock.left[pattern].all():
            stock.lengths = stock.lengths[stock.left[stock.lengths] > 0]
    return sequence, np.array(sorted(rows), np.int64).reshape(-1, 6)


def place(rows: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``max_len``.

    The rows are written once with a random number that spreads equal rows over tasks; the plan that each task searches
    has at most a few rows for each of ``max_len`` lengths and pattern, so its size does not grow with the corpus.
    """
    spark = rows.sparkSession
    kept = written(rows.withColumn("pack_salt", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    counts = kept.groupBy("length").agg(F.count("*").alias("n"))
    by_length = {int(r["length"]): int(r["n"]) for r in counts.collect()}  # at most max_len rows
    if by_length and not 1 <= min(by_length) <= max(by_length) <= max_len:
        raise ValueError(f"lengths must lie in 1..{max_len}")
    table = spark.sparkContext.broadcast(plan(by_length, max_len))
    numbered = ranked(kept, ["length"], counts, F.col("pack_salt"), ["pack_salt"], "pack_rank").drop("pack_salt")

    names = rows.columns

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = table.value
        starts = steps[:, 0] << 44 | steps[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("pack_rank").to_numpy(zero_copy_only=False)
            step = steps[np.searchsorted(starts, length << 44 | rank, side="right") - 1]
            here = rank - step[:, 1]
            cols = {c: batch.column(c) for c in names}
            cols["sequence_id"] = pa.array(step[:, 3] + here // step[:, 4], pa.int64())
            cols["offset"] = pa.array(step[:, 5] + here % step[:, 4] * length, pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = with_fields(rows.schema, sequence_id=T.LongType(), offset=T.LongType())
    return numbered.select(*names, "pack_rank").mapInArrow(look_up, schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """Placed pieces with their ids: the pieces are written once, only their lengths are ranked, and the ids meet their places by a number."""
    numbered = pieces(docs, tokenizer_path, end_id, max_len).withColumn("piece_number", F.monotonically_increasing_id())
    cut = written(numbered, "token-pieces")
    spots = place(cut.select("piece_number", "length"), max_len).select("piece_number", "sequence_id", "offset")
    return cut.join(spots, "piece_number").drop("piece_number")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the packed sequences; a group holds at most ``max_len`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
