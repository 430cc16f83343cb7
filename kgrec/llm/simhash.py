"""SimHash near-duplicates by tiled exact comparison (operator 8).

1. ``fingerprints``: a 64-bit majority fingerprint for every document, no shuffle.
2. Equal fingerprints meet in one row (partial aggregation), so a group of copies is one row from here on.
3. Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit quarters.  Two
   fingerprints within ``radius`` bits have quarter counts that differ by ``radius`` in sum at most, so all other pairs
   of tiles are skipped.  The remaining pairs of tiles are compared completely with numpy: exclusive or, then bit counts.
   A large tile is cut, so a task compares bounded arrays.  Of the links found in a pair of tiles a spanning
   forest is returned: dense groups give as many rows as they have members, and no component is torn.
4. Components: every fingerprint takes the smallest label among its links and jumps along labels until none changes;
   each round is written to the shared folder.

Defined results: a null text is an empty one and has the zero fingerprint, which links like any other; rows with a null
id count as documents but never name a component unless it has no other; repeated rows share their component;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgrec.llm.common import keyed_rows, with_fields, written

SEED = 42
SHINGLE = 3
RADIUS = 3
TILE_ROWS = 2048       # most fingerprints of a tile, on average
QUARTER = 16
COMMON = 1024          # a fingerprint of more than 1 / COMMON of all rows is common
BLOCK = 1 << 16        # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64; no shingle: zero."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    total = np.zeros(64, np.int64)
    for at in range(0, len(grams), BLOCK):
        part = grams[at:at + BLOCK]
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in part], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (the 64 bits as a signed long) of every row."""
    schema = with_fields(docs.select(*keep).schema, fp=T.LongType())
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(n)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps.view(np.int64))], schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("simhash_text")).mapInArrow(run, schema)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _quarter(k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned("fp", QUARTER * k).bitwiseAND((1 << QUARTER) - 1))


def _cell(counts: list[Column]) -> Column:
    code = F.lit(0)
    for c in counts:
        code = code * (QUARTER + 1) + c
    return code


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links between two arrays of fingerprints, a bounded block at a time reduced to a forest."""
    x, y = np.empty(0, a.dtype), np.empty(0, a.dtype)
    for at in range(0, len(a), 512):
        i, j = np.nonzero(np.bitwise_count(a[at:at + 512, None] ^ b[None, :]) <= radius)
        u, v = a[i + at], b[j]
        differs = u != v
        x, y = _forest(np.concatenate([x, u[differs]]), np.concatenate([y, v[differs]]))
    return x, y


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links: every node but the least of its component, and that least node."""
    if not len(x):
        return x, y
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = at[:len(x)], at[len(x):]
    label = np.arange(len(nodes))
    while True:  # smallest label among links, then jump along labels
        new = label.copy()
        for to, by in ((u, v), (v, u), (label[u], v), (label[v], u)):
            np.minimum.at(new, to, label[by])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(a, b)``: links that connect every pair of distinct ``fp`` of at most ``radius`` differing bits."""
    quarters = [_quarter(k) for k in range(4)]
    placed = distinct.select("fp", *[q.cast("int").alias(f"q{k}") for k, q in enumerate(quarters)])
    cells = placed.groupBy("q0", "q1", "q2", "q3").agg(F.ceil(F.count("*") / F.lit(tile_rows)).alias("n_tiles"))
    keys = ["q0", "q1", "q2", "q3"]
    tiles = (placed.join(F.broadcast(cells), keys)  # one row for each of at most 17 ** 4 count vectors
             .groupBy(*keys, F.pmod(F.xxhash64("fp"), F.col("n_tiles")).alias("tile"))
             .agg(F.collect_list("fp").alias("fps")))
    tiles = written(tiles, "simhash-tiles")
    # Each unordered pair of count vectors once: the difference's first non-zero part is positive.
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in steps])
    want = (tiles.withColumn("d", F.explode(offsets))
            .select(F.col("fps").alias("a_fps"), F.col("tile").alias("a_tile"),
                    *[(F.col(f"q{k}") + F.col(f"d.d{k}")).alias(f"w{k}") for k in range(4)],
                    F.expr("d.d0 = 0 and d.d1 = 0 and d.d2 = 0 and d.d3 = 0").alias("same")))
    there = tiles.withColumnsRenamed({f"q{k}": f"w{k}" for k in range(4)})
    pairs = (want.filter(" and ".join(f"w{k} between 0 and {QUARTER}" for k in range(4)))
             .join(there, [f"w{k}" for k in range(4)])
             .filter(~F.col("same") | (F.col("a_tile") <= F.col("tile")))
             .select("a_fps", F.col("fps").alias("b_fps")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (np.empty(0, np.uint64),) * 2  # the forest of all that this task has compared
        for batch in batches:
            found = [_forest(*_near(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), radius))
                     for x, y in zip(batch.column(0), batch.column(1), strict=True)]
            own = _forest(*(np.concatenate([own[k], *(f[k] for f in found)]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in own], ["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``: nodes of one component share their root.

    In each round the larger root of an open edge hooks to the smaller, then every node jumps along roots; edges
    whose ends share a root are settled for good and leave.
    """
    open_edges = written(edges.distinct(), "simhash-edges")
    ends = open_edges.select(F.col("a").alias("node")).unionByName(open_edges.select(F.col("b").alias("node")))
    roots = written(ends.distinct().withColumn("root", F.col("node")), "simhash-roots")
    while True:
        of_a, of_b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
        open_edges = written(open_edges.select("a", "b").join(of_a, "a").join(of_b, "b").filter("root_a <> root_b"), "simhash-edges")
        hooks = open_edges.groupBy(F.greatest("root_a", "root_b").alias("root")).agg(F.min(F.least("root_a", "root_b")).alias("low"))
        if hooks.isEmpty():
            return roots
        hooked = roots.join(hooks, "root", "left").select("node", F.coalesce("low", "root").alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = written(hooked.join(up, "root").select("node", F.least("root", "up").alias("root")), "simhash-roots")


def component_ids(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds ``root`` (a fingerprint of the component) and ``component_id``, its smallest ``doc_id``, to rows with ``fp``."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-distinct")
    linked = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    least = linked.join(distinct, "fp").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = linked.join(least, "root").select("fp", "root", "least_id")
    by_fp = written(distinct.join(named, "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("least_id", "first_id").alias("component_id")), "simhash-named")
    # Fingerprints of so many copies that there are at most COMMON of them are looked up, the others joined.
    total = distinct.agg(F.sum("n")).first()[0] or 0
    many = F.broadcast(by_fp.filter(F.col("n") * COMMON > total).drop("n"))
    few = prints.join(many.select("fp"), "fp", "left_anti").join(by_fp.drop("n"), "fp")
    return few.unionByName(prints.join(many, "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    prints = written(fingerprints(named, shingle), "simhash-prints")
    return component_ids(prints, radius).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id (ties: the smallest row hash)."""
    keyed = keyed_rows(docs)
    named = keyed.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "key", F.col("row.text").alias("text"))
    prints = written(fingerprints(named, shingle, ("doc_id", "key")), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    keys = component_ids(prints, radius).groupBy("root").agg(first).select("first.key")
    return keyed.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
