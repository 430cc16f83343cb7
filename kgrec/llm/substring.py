"""Exact removal of passages that stand earlier in the corpus, behind a count-min prefilter (operator 12).

A window is ``WINDOW`` consecutive words of one document.  A word goes if a window that covers it stands, word for word,
also at an earlier place of the input; windows are judged on the input, not on what is left.

1. ``Sketch``: each task counts its windows' hashes in ``DEPTH`` rows of cells; partial sketches are merged.  Only "none", "one"
   and "two or more" matter, so a cell is two bits and merging never loses a count: an estimate is never too low.
2. Windows estimated to repeat are grouped exactly, by 64 bits of their least ``GRAM``-word gram and 32 independent bits of all their words,
   and every place but the first is found.  Neighbouring windows mostly share that gram, so they travel as one row, in some seven
   bytes a window even where nothing is filtered; a task sends a window once.  All other windows never leave their task.
3. Places that are not first go back to their documents as runs, and their words are removed.

The sketch is sized by the text, up to ``SKETCH_BYTES`` (a parameter): that is all that is broadcast.  Where the corpus has more windows
than that separates, more single windows pass the filter and meet in step 2, which is exact in any case and cheap enough for all windows:
the result never depends on the sketch.  Step 1 runs in as many tasks as there are cores, so merging moves one sketch a core.

Places are ordered by (doc_id, start), a null id first.  Rows that share an id but not the text are documents of their own, ordered by a
hash of the text; rows equal in both are one document and have the same result.  Defined results: a null or
empty text has no words, and keeps the empty text; a text of fewer than ``WINDOW`` words stays whole; a very long text is one
document like any other (a task holds some 60 bytes a word of it); an empty table gives an empty result; other columns
are not read by ``deduplicated``, which returns one row a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
DEPTH = 2                       # rows of a sketch
SKETCH_BYTES = 64 << 20         # a whole sketch at most
CHARS_A_CELL = 6.0              # sketch sizing: a row gets about a cell a word, rounded up to a power of two
SEGMENT = 1 << 20               # bytes of a partial sketch that travel in one row
SLICE = 2 << 20                 # bytes of text hashed at once
GRAM = 8                        # words of the grams whose least one windows are dealt by
HELD = 1 << 20                  # windows that a task gathers before it sends or reduces them
LONGEST = 64                    # bytes of words that are hashed together; longer ones go one by one
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
BASES = (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
MASK = (1 << 64) - 1


# --- words and windows --------------------------------------------------------------------------------------

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(ODD[k])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(ODD[k + 2])
    return x ^ (x >> np.uint64(32))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of a buffer and two 64-bit hashes (rows) of each: eight bytes of all words at a time."""
    raw = np.frombuffer(data + bytes(9), np.uint8)
    space = np.concatenate([[True], IS_SPACE[raw[:len(data)]], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    lanes = np.ndarray((len(data) + 1,), "<u8", raw.data, strides=(1,))  # the eight bytes from every place on
    h = np.empty((2, len(starts)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(2):
            h[k] = _mixed(sizes.astype(np.uint64) + np.uint64(ODD[3 - k]), k)
        live = np.flatnonzero(sizes <= LONGEST)
        for at in range(0, LONGEST, 8):
            live = live[sizes[live] > at]
            if not len(live):
                break
            lane, bits = lanes[starts[live] + at], 8 * np.minimum(sizes[live] - at, 8).astype(np.uint64)
            lane &= np.uint64(MASK) >> (np.uint64(64) - bits)
            for k in range(2):
                h[k, live] = _mixed(h[k, live] * np.uint64(BASES[k]) ^ _mixed(lane, k), 1 - k)
    for at in np.flatnonzero(sizes > LONGEST).tolist():
        both = xxhash.xxh3_128_intdigest(data[starts[at]:starts[at] + sizes[at]])
        h[:, at] = both & MASK, both >> 64
    return starts, h


def _rolled(h: np.ndarray, base: int, window: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``window``, from runs of powers of two."""
    with np.errstate(over="ignore"):
        power, run, have, out, length = np.uint64(base), h, 1, None, 0
        while True:
            if window & have:
                if out is None:
                    out, length = run, have
                else:  # the run before what is gathered so far
                    n = len(h) - length - have + 1
                    out = run[:n] * np.uint64(pow(base, length, 1 << 64)) + out[have:have + n]
                    length += have
            if have * 2 > window:
                return out
            run = run[:-have] * power + run[have:]
            power = power * power
            have *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width``."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:])


def windows_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
    """Of all windows of the texts, in order: a 64-bit hash of the words, the text's number, the first word's number; and
    ``more()``: the hash of the least gram and 32 further bits, for each window."""
    starts, h = hashed_words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(starts, ends), prepend=0)
    n = np.maximum(words - window + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(doc):
        none = np.zeros(0, np.uint64)
        return none, doc, start, lambda: (none, none.astype(np.uint32))
    at = start + np.repeat(np.cumsum(words) - words, n)

    def hashes(row: int) -> np.ndarray:
        x = _rolled(h[row], BASES[row], window)[at]
        return x ^ (x >> np.uint64(29))

    def more() -> tuple[np.ndarray, np.ndarray]:
        gram = min(GRAM, (window + 1) // 2)
        with np.errstate(over="ignore"):
            grams = _mixed(_rolled(h[0], BASES[1], gram), 0)
        return _least(grams, window - gram + 1)[at], (hashes(1) >> np.uint64(32)).astype(np.uint32)

    return hashes(0), doc, start, more


def _slices(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lists of consecutive texts of about ``SLICE`` bytes; a longer text is a list of its own."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > SLICE:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield (text.as_py() or "").encode()


# --- sketch -------------------------------------------------------------------------------------------------

class Sketch:
    """Count-min rows of two-bit cells: ``seen[0]`` has cells met, ``seen[1]`` cells met twice or more."""

    def __init__(self, log_cells: int, seen: np.ndarray | None = None):
        self.log_cells = log_cells
        self.seen = np.zeros((2, DEPTH, max(1, (1 << log_cells) // 8)), np.uint8) if seen is None else seen

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(ODD[row])) >> np.uint64(64 - self.log_cells)

    def add(self, h: np.ndarray) -> None:
        if not len(h):
            return
        for row in range(DEPTH):
            cells = np.sort(self.cells(h, row))
            again = cells[1:] == cells[:-1]
            once, more = self.seen[0, row], self.seen[1, row]
            _put(more, cells[1:][again])
            _put(once, cells[np.concatenate([[True], ~again])], also=more)

    def merge(self, other: np.ndarray) -> None:
        """``other``: the ``seen`` of another sketch of the same size."""
        self.seen[1] |= other[1] | (self.seen[0] & other[0])
        self.seen[0] |= other[0]

    def repeats(self, h: np.ndarray) -> np.ndarray:
        """Whether the estimated count is two or more."""
        out = np.ones(len(h), bool)
        for row in range(DEPTH):
            at = np.flatnonzero(out)
            cells = self.cells(h[at], row)
            out[at] = (self.seen[1, row][cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1
        return out


def _put(bits: np.ndarray, cells: np.ndarray, also: np.ndarray | None = None) -> None:
    """Sets sorted cells; those of ``bits`` that were set before are set in ``also``."""
    if not len(cells):
        return
    byte = cells >> np.uint64(3)
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    new = np.bitwise_or.reduceat(np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8), first)
    at = byte[first]
    if also is not None:
        also[at] |= bits[at] & new
    bits[at] |= new


def log_cells(chars: int, sketch_bytes: int = SKETCH_BYTES) -> int:
    """Cells of a row, as a power of two: by the text's size, within the bound of a whole sketch (2 bits a cell)."""
    most = max(3, int(np.log2(sketch_bytes * 4 // DEPTH)))
    return min(most, max(13, int(np.ceil(np.log2(max(1.0, chars / CHARS_A_CELL))))))


def sketched(texts: DataFrame, size: int, window: int = WINDOW) -> Sketch:
    """The merged sketch of all windows of a ``text`` column."""
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(size)
        for batch in batches:
            for part in _slices(_texts(batch.column(0))):
                sketch.add(windows_of(part, window)[0])
        raw = sketch.seen.reshape(2, -1)
        for k, at in enumerate(range(0, raw.shape[1], SEGMENT)):
            part = raw[:, at:at + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["segment", "seen"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment: one segment is held at a time."""
        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["segment", "seen"])

        at, total = None, None
        for batch in batches:
            for segment, seen in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(seen.as_py(), np.uint8).reshape(2, -1)
                if segment != at:
                    if at is not None:
                        yield done()
                    at, total = segment, part.copy()
                else:
                    total[1] |= part[1] | (total[0] & part[0])
                    total[0] |= part[0]
        if at is not None:
            yield done()

    tasks = max(1, spark.sparkContext.defaultParallelism)
    parts = texts.select(F.col("text").cast("string")).coalesce(tasks).mapInArrow(count, "segment int, seen binary")
    segments = max(1, DEPTH * (1 << size) // 8 // SEGMENT)
    merged = (parts.repartition(min(segments, tasks), "segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, seen binary"))
    sketch = Sketch(size)
    raw = sketch.seen.reshape(2, -1)
    for row in merged.toLocalIterator():  # one whole sketch, bounded by its size
        part = np.frombuffer(row["seen"], np.uint8).reshape(2, -1)
        raw[:, row["segment"] * SEGMENT:row["segment"] * SEGMENT + part.shape[1]] = part
    return sketch


# --- exact pass ---------------------------------------------------------------------------------------------

def _with_key(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, key)``: the key tells documents that share an id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.hash(text).alias("key"))


RUN = "gram bigint, doc_id bigint, key int, start int, n int, bits array<int>"


class _Windows:
    """Windows with their places; ``doc`` is a place in ``docs``, whose rows are (known, doc_id, key) in the order of documents."""

    def __init__(self, gram, bits, doc, start, docs):
        self.gram, self.bits, self.doc, self.start, self.docs = gram, bits, doc, start, docs

    def told_apart(self) -> tuple[np.ndarray, np.ndarray]:
        """Which windows stand first among these, and which stand later; a place that is given again (by an equal row) is neither."""
        place = self.doc.astype(np.int64) << 32 | self.start
        order = np.lexsort((place, self.bits, self.gram))
        gram, bits, place = self.gram[order], self.bits[order], place[order]
        same = (gram[1:] == gram[:-1]) & (bits[1:] == bits[:-1])
        first, later = np.empty(len(order), bool), np.empty(len(order), bool)
        first[order] = np.concatenate([[True], ~same])[:len(order)]
        begin = np.maximum.accumulate(np.where(first[order], np.arange(len(order)), 0))
        moved = np.concatenate([[True], place[1:] != place[:-1]])[:len(order)]
        later[order] = moved & (place != place[begin]) if len(order) else False
        return first, later

    def pick(self, which: np.ndarray) -> "_Windows":
        return _Windows(self.gram[which], self.bits[which], self.doc[which], self.start[which], self.docs)

    def runs(self, with_bits: bool) -> Iterator[pa.RecordBatch]:
        """Rows of ``RUN``: consecutive windows of a document (and, ``with_bits``, of one gram)."""
        order = np.lexsort((self.start, self.doc))
        doc, start, gram = self.doc[order], self.start[order], self.gram[order]
        cut = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        if with_bits:
            cut |= gram[1:] != gram[:-1]
        first = np.flatnonzero(np.concatenate([[True], cut])) if len(order) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(order))
        bits = self.bits[order].view(np.int32)
        known, ids, keys = self.docs
        for lo in range(0, len(first), 1 << 16):
            a, b = first[lo:lo + (1 << 16)], ends[lo:lo + (1 << 16)]
            d = doc[a]
            lists = (pa.ListArray.from_arrays(pa.array(np.append(a, b[-1]) - a[0], pa.int32()), pa.array(bits[a[0]:b[-1]])) if with_bits
                     else pa.nulls(len(a), pa.list_(pa.int32())))
            with np.errstate(over="ignore"):  # runs without bits go anywhere: by their place
                key = gram[a] if with_bits else _mixed(ids[d].astype(np.uint64) ^ start[a].astype(np.uint64) << np.uint64(40), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids[d], pa.int64(), mask=~known[d]), pa.array(keys[d]), pa.array(start[a].astype(np.int32)),
                 pa.array((b - a).astype(np.int32)), lists], ["gram", "doc_id", "key", "start", "n", "bits"])


def _ordered(known: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The number of each document in the order of places (a null id first; equal ones share it), and the documents by number."""
    order = np.lexsort((keys, ids, known))
    k, i, x = known[order], ids[order], keys[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (x[1:] != x[:-1])])[:len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, (k[new], i[new], x[new])


def later_places(docs: DataFrame, shared, size: int, window: int = WINDOW) -> DataFrame:
    """``(doc_id, key, runs)``: the windows that stand earlier, as runs (start, n).  ``shared`` is the broadcast sketch."""
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, many = Sketch(size, shared.value), [], 0

        def flush():
            gram, bits, known, ids, keys, start = (np.concatenate(c) for c in zip(*held, strict=True))
            doc, table = _ordered(known, ids, keys)
            windows = _Windows(gram, bits, doc, start, table)
            first, later = windows.told_apart()
            yield from windows.pick(first).runs(True)
            yield from windows.pick(later).runs(False)  # settled here

        for batch in batches:
            ids, keys = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            done = 0
            for part in _slices(_texts(batch.column(1))):
                h, doc, start, more = windows_of(part, window)
                at = np.flatnonzero(sketch.repeats(h))
                if len(at):
                    gram, bits = more()
                    doc = done + doc[at]
                    held.append((gram[at], bits[at], known[doc], ids[doc], keys[doc], start[at]))
                    many += len(at)
                done += len(part)
                if many >= HELD:
                    yield from flush()
                    held, many = [], 0
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram; the windows of the last one wait for the next batch, reduced to first places when they are many."""
        held, room = [], HELD

        def reduced(parts, keep_last: bool):
            gram, known, ids, keys, start, n, bits = (np.concatenate(c) for c in zip(*parts, strict=True))
            doc, table = _ordered(known, ids, keys)
            row = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            windows = _Windows(gram[row], bits.view(np.uint32), doc[row], start[row] + inside, table)
            last = windows.gram == gram[-1] if keep_last else np.zeros(len(row), bool)
            first, later = windows.told_apart()
            out = list(windows.pick(later).runs(False))
            wait = windows.pick(last & first)
            if not len(wait.gram):
                return out, []
            d = wait.doc
            return out, [(wait.gram, table[0][d], table[1][d], table[2][d], wait.start, np.ones(len(d), np.int64), wait.bits.view(np.int32))]

        for batch in batches:
            settled = batch.column("bits").is_null()
            if settled.true_count:
                yield batch.filter(settled)
                batch = batch.filter(settled.to_numpy(zero_copy_only=False) == 0) if settled.true_count < batch.num_rows else batch.slice(0, 0)
            if not batch.num_rows:
                continue
            gram, ids, keys, start, n, bits = (batch.column(k) for k in range(6))
            held.append((gram.to_numpy(zero_copy_only=False).view(np.uint64), ids.is_valid().to_numpy(zero_copy_only=False),
                         ids.fill_null(0).to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False),
                         start.to_numpy(zero_copy_only=False).astype(np.int64), n.to_numpy(zero_copy_only=False).astype(np.int64), bits.flatten().to_numpy(zero_copy_only=False)))
            if sum(len(p[6]) for p in held) >= room:
                out, held = reduced(held, True)
                yield from out
                room = HELD + 2 * sum(len(p[6]) for p in held)
        if held:
            yield from reduced(held, False)[0]

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = _with_key(docs).mapInArrow(candidates, RUN).repartition(n, "gram").sortWithinPartitions("gram")
    return sent.mapInArrow(settle, RUN).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))  # a document's, whatever its copies


def _removed(words: list[bytes], starts: np.ndarray, sizes: np.ndarray) -> tuple[int, int, bytes]:
    """Word count, how many the runs of words cover, and the rest joined."""
    if not len(starts):
        return len(words), 0, b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + sizes, -1)
    kept = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return len(words), len(words) - len(kept), b" ".join(kept)


def deduplicated(docs: DataFrame, window: int = WINDOW, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every row: ``kept`` has the words left, joined by one space."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    size = log_cells(int(chars), sketch_bytes)
    shared = spark.sparkContext.broadcast(sketched(docs.select("text"), size, window).seen)
    rows, at = _with_key(docs).alias("d"), later_places(docs, shared, size, window).alias("f")
    joined = rows.join(at, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc, text, runs in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2), strict=True):
                pairs = runs.values if runs.is_valid else None
                start, n = ((pairs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n")) if pairs is not None
                            else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                out.append((doc, *_removed(text.split(), start, n + window - 1)))
                size += len(text)
                if size >= SLICE:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    def _rows(out):
        doc, n, gone, kept = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("d.doc_id", "d.text", "f.runs").mapInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
