"""Training of vector models over dense ids: triple models, BPR, LightGCN and the relation-aware convolution.

The state of a model is a table ``(id, vec, m, s)`` (vectors and their Adam moments) and small named arrays (relation
vectors, convolution weights) whose size the vocabulary of relations and the dimension bound.  One step is:

1. forward: each propagation layer is a sum over edges of (composed) source vectors;
2. loss: the batch's samples give score gradients, summed by id;
3. backward: gradients of the last layer go back through transposed edges, layer by layer; composition gradients
   (relations) and weight gradients are partial sums of the same passes;
4. Adam moves the rows that have a gradient (others keep vector and moments) and the small arrays.

Where a model is kept depends on its counted size alone.  Models whose score is a sum over dimensions are trained on slices of them
(``sliced``) where they don't fit; for the others:  Up to ``spark.kgrec.vectorBroadcastBytes`` its matrix is broadcast for every
pass and gathered by id, and the summed rows of a pass come back as one matrix; above that vectors stay tables, edges and
samples are joined with them, and every step writes the next state.  The same numpy code runs in the tasks of either.  Sums are
pre-added in the task (a hub leaves each task once) and finished by one aggregate.  Rows are dealt to the batches of an
epoch by a hash of the row and the epoch, so a run does not depend on the partitioning.

``EpochLog`` keeps the state of finished epochs; an interrupted run goes on from the last one committed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgrec.operators.rank import dense_index, global_row_number
from kgrec.sources.files import exists, list_folder, remove, scratch_path, touch

VECTOR_BYTES = 16 << 20     # of a model that the driver may hold and broadcast
RELATION_BYTES = 256 << 20   # of the relation vectors, a parameter of the model
BATCH_ROWS = 1 << 20          # samples of one synchronous step
ENTITY, RELATION, LOSS, WEIGHT = 0, 1, 2, 3   # kinds of summed rows; weights follow from WEIGHT on
SUMS = "kind int, id bigint, g array<double>"
PACKED = "kind int, block int, ids binary, g binary"   # rows of up to BLOCK ids as two buffers: what models that fit are added in
BLOCK = 1 << 12
B1, B2, EPS = 0.9, 0.999, 1e-8


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"train-{name}")
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    back._kgrec_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_kgrec_path", None):
            remove(df.sparkSession, path)


def list_array(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def matrix_rows(spark, **columns: np.ndarray) -> DataFrame:
    """Matrices of a size that fits as rows ``(id, ...)``."""
    n = len(next(iter(columns.values())))
    table = pa.table({"id": pa.array(np.arange(n)), **{c: list_array(m) for c, m in columns.items()}})
    return spark.createDataFrame(table, "id bigint, " + ", ".join(f"{c} array<double>" for c in columns))


class Vectors:
    """Rows ``(id, vec)`` with ids below ``n``; an id without a row is a zero vector.  A matrix that may be broadcast can stand for the rows."""

    def __init__(self, rows: DataFrame | None, n: int, dim: int, spark=None, held: np.ndarray | None = None):
        self._rows, self.n, self.dim, self._matrix, self._shared = rows, n, dim, held, None
        self.spark = spark or rows.sparkSession

    @property
    def fits(self) -> bool:
        limit = int(self.spark.conf.get("spark.kgrec.vectorBroadcastBytes", str(VECTOR_BYTES)))
        return self.n * self.dim * 8 <= limit

    @property
    def rows(self) -> DataFrame:
        if self._rows is None:
            self._rows = matrix_rows(self.spark, vec=self._matrix)
        return self._rows

    def matrix(self) -> np.ndarray:
        """All rows, for a size that fits."""
        if self._matrix is None:
            t = self.rows.select("id", "vec").toArrow()
            self._matrix = np.zeros((self.n, self.dim))
            if t.num_rows:
                self._matrix[t.column("id").to_numpy()] = matrix(t.column("vec").combine_chunks(), self.dim)
        return self._matrix

    def held(self):
        """The broadcast matrix, where its size fits."""
        if self._shared is None and self.fits:
            self._shared = self.spark.sparkContext.broadcast(self.matrix())
        return self._shared

    def free(self) -> None:
        if self._shared is not None:
            self._shared.unpersist()


def gathering(df: DataFrame, vectors: dict[str, Vectors]) -> tuple[DataFrame, Callable]:
    """``df`` with what a task needs to look up the vectors of its id columns, and the look-up ``get(batch, column)``."""
    held = {c: v.held() for c, v in vectors.items()}
    for c, v in vectors.items():
        if held[c] is None:
            mine = v.rows.select(F.col("id").alias(c), F.col("vec").alias(f"{c}_vec"))
            df = df.join(mine, c, "left").withColumn(f"{c}_vec", F.coalesce(f"{c}_vec", F.array_repeat(F.lit(0.0), v.dim)))
    dims = {c: v.dim for c, v in vectors.items()}

    def get(batch: pa.RecordBatch, c: str) -> np.ndarray:
        if held[c] is not None:
            return held[c].value[batch.column(c).to_numpy(zero_copy_only=False)]
        return matrix(batch.column(f"{c}_vec"), dims[c])

    return df, get


class Sums:
    """Rows of a task added by (kind, id): dense where the number of ids is given, else added within each call.

    ``packed`` sums (all kinds dense) leave the task as blocks of ``PACKED``, others as rows of ``SUMS``.
    """

    def __init__(self, dim: int, sizes: dict[int, int | None], packed: bool = False):
        self.dim, self.sizes, self.dense, self.packed = dim, sizes, {}, packed

    def add(self, kind: int, ids: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        at = ids[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        total = np.add.reduceat(g[order], first, axis=0)
        if self.sizes[kind] is None:
            yield _row_batch(kind, at[first], total)
            return
        if kind not in self.dense:
            self.dense[kind] = np.zeros((self.sizes[kind], self.dim)), np.zeros(self.sizes[kind], bool)
        sums, seen = self.dense[kind]
        sums[at[first]] += total
        seen[at[first]] = True

    def add_all(self, kind: int, g: np.ndarray) -> None:
        """A whole small matrix."""
        sums, seen = self.dense.setdefault(kind, (np.zeros_like(g), np.ones(len(g), bool)))
        sums += g

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind, (sums, seen) in self.dense.items():
            ids = np.flatnonzero(seen)
            if not self.packed:
                for at in range(0, len(ids), 8192):
                    yield _row_batch(kind, ids[at:at + 8192], sums[ids[at:at + 8192]])
                continue
            for part in np.split(ids, np.flatnonzero(np.diff(ids // BLOCK)) + 1):
                if len(part):
                    yield _block_batch(kind, part, sums[part])


def _row_batch(kind: int, ids: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind), pa.int32()), pa.array(ids, pa.int64()), list_array(g)], ["kind", "id", "g"])


def _block_batch(kind: int, ids: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([ids[0] // BLOCK], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
         pa.array([np.ascontiguousarray(g).tobytes()], pa.binary())], ["kind", "block", "ids", "g"])


def _blocks(batch: pa.RecordBatch | pa.Table, dim: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        kind, block, ids, g = (batch.column(c)[k] for c in ("kind", "block", "ids", "g"))
        yield kind.as_py(), block.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(g.as_buffer()).reshape(-1, dim)


def summed(df: DataFrame, run: Callable, dim: int, packed: bool) -> DataFrame:
    """The sums that ``run`` makes of ``df`` in each task, added over all tasks."""
    if not packed:
        return rows_summed(df.mapInArrow(run, SUMS), dim)

    def merge(batches):
        """Blocks come sorted: one is held at a time."""
        at, sums, seen = None, None, None
        for batch in batches:
            for kind, block, ids, g in _blocks(batch, dim):
                if (kind, block) != at:
                    if at is not None:
                        yield _block_batch(at[0], np.flatnonzero(seen) + at[1] * BLOCK, sums[seen])
                    at, sums, seen = (kind, block), np.zeros((BLOCK, dim)), np.zeros(BLOCK, bool)
                here = ids - block * BLOCK
                sums[here] += g
                seen[here] = True
        if at is not None:
            yield _block_batch(at[0], np.flatnonzero(seen) + at[1] * BLOCK, sums[seen])

    return df.mapInArrow(run, PACKED).repartition("kind", "block").sortWithinPartitions("kind", "block").mapInArrow(merge, PACKED)


MERGED = 1 << 17   # rows that a task of ``rows_summed`` gathers before it adds them


def rows_summed(rows: DataFrame, dim: int) -> DataFrame:
    """Rows of ``SUMS`` added over all tasks: each (kind, id) meets in one task, which keeps one row of it."""
    def merge(batches):
        held, many, room = [], 0, MERGED

        def added():
            key, g = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return key[first], np.add.reduceat(g[order], first, axis=0)

        for batch in batches:
            if batch.num_rows:
                kind, ids = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "id"))
                held.append((kind + 2 << 48 | ids, matrix(batch.column("g"), dim)))
                many += batch.num_rows
                if many >= room:
                    held = [added()]
                    many = len(held[0][0])
                    room = MERGED + 2 * many
        if held:
            key, g = added()
            for at in range(0, len(key), 8192):
                part = key[at:at + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part >> 48) - 2, pa.int32()), pa.array(part & (1 << 48) - 1), list_array(g[at:at + 8192])], ["kind", "id", "g"])

    return rows.repartition("kind", "id").mapInArrow(merge, SUMS)


def collected(sums: DataFrame, x: Vectors, sizes: dict[int, int], width: int | None = None, n: int | None = None) -> tuple[Vectors, dict[int, np.ndarray]]:
    """Sums run once: those of entities as vectors (of ``n`` ids, else as many as ``x`` has), those of small kinds as matrices."""
    width, n = width or x.dim, n or x.n
    out = {k: np.zeros((size, width)) for k, size in sizes.items()}
    if x.fits:
        m = np.zeros((n, width))
        for kind, _, ids, g in _blocks(sums.toArrow(), width):
            (m if kind == ENTITY else out[kind])[ids] = g
        return Vectors(None, n, width, x.spark, m), out
    rest = written(sums, "sums")
    t = rest.filter(F.col("kind") != ENTITY).toArrow()
    if t.num_rows:
        kinds, ids, g = t.column("kind").to_numpy(), t.column("id").to_numpy(), matrix(t.column("g").combine_chunks(), width)
        for k in out:
            out[k][ids[kinds == k]] = g[kinds == k]
    rows = rest.filter(F.col("kind") == ENTITY).select("id", F.col("g").alias("vec"))
    rows._kgrec_path = rest._kgrec_path
    return Vectors(rows, n, width), out


ROWS_A_TASK = 1 << 16   # samples or edges of a task: few bytes, but a vector or more each


def spread(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df`` over as many tasks as its number of rows asks for; by its bytes alone it would be merged into very few."""
    return df.repartition(max(1, -(-rows // ROWS_A_TASK), min(rows // 512, df.sparkSession.sparkContext.defaultParallelism)), *columns)


# --- samples ------------------------------------------------------------------------------------------------

def next_free(known: DataFrame, keys: list[str], n: int) -> DataFrame:
    """For every known ``slot`` of a key the next slot (cyclic in 0 .. n - 1) that is not known: ``(keys, slot, free)``; null where none is.

    Runs of consecutive known slots are found by a distributed row number: within a run it rises with the slot.
    """
    rows = global_row_number(known.select(*keys, "slot").distinct(), [F.col(c) for c in [*keys, "slot"]], "nr")
    runs = written(rows.select(*keys, "slot", (F.col("slot") - F.col("nr")).alias("run")), "runs")
    ends = runs.groupBy(*keys, "run").agg((F.max("slot") + 1).alias("free"))
    after = written(runs.join(ends, [*keys, "run"]).select(*keys, "slot", "free"), "free")
    at_zero = after.filter("slot = 0").select(*keys, F.when(F.col("free") < n, F.col("free")).alias("wrapped"), F.lit(1).alias("zero"))
    wrap = after.filter(F.col("free") >= n).join(at_zero, keys, "left").select(
        *keys, "slot", F.when(F.col("zero").isNull(), F.lit(0)).otherwise(F.col("wrapped")).cast("bigint").alias("free"))
    return after.filter(F.col("free") < n).unionByName(wrap)


def corrupted(rows: DataFrame, blocked: DataFrame, keys: list[str], base: str, n: int, epoch: int | range, name: str) -> DataFrame:
    """``rows`` with ``name``: slot (base + 7919 epoch) mod n, or the next one that is not known for the key; rows without any go.

    Of several epochs each has the rows, with its number in ``epoch``: one join for all.
    """
    if isinstance(epoch, range):
        rows = rows.withColumn("epoch", F.explode(F.array(*map(F.lit, epoch))))
    turn = F.col("epoch").cast("bigint") * 7919 if isinstance(epoch, range) else F.lit(7919 * epoch)
    at = rows.withColumn("slot", F.pmod(F.expr(base) + turn, F.lit(n)))
    hit = at.join(blocked.withColumn("known", F.lit(True)), [*keys, "slot"], "left")
    return hit.withColumn(name, F.when(F.col("known"), F.col("free")).otherwise(F.col("slot"))).filter(
        F.col(name).isNotNull()).drop("slot", "known", "free")


def dealt(rows: DataFrame, columns: list[str], epoch: int, batches: int) -> list[DataFrame]:
    """The epoch's batches: a hash of the row and the epoch deals."""
    if batches == 1:
        return [rows]
    which = F.pmod(F.xxhash64(F.lit(epoch), *columns), F.lit(batches))
    return [rows.filter(which == k) for k in range(batches)]


# --- losses -------------------------------------------------------------------------------------------------

def pair_gradients(u, p, n):
    """BPR: gradients of log(1 + exp(-u (p - n))) and the losses."""
    x = (u * (p - n)).sum(axis=1)
    g = (-1.0 / (1.0 + np.exp(np.clip(x, -700, 700))))[:, None]
    return g * (p - n), g * u, -g * u, np.logaddexp(0.0, -x)


def pair_loss(samples: DataFrame, x: Vectors, reg_on: Vectors | None = None, reg: float = 0.0) -> DataFrame:
    """Summed BPR gradients by id for ``samples(u, p, n)``; with ``reg``, that of reg / 2 |row|^2 of the rows of ``reg_on`` a sample names."""
    cols = {c: x for c in ("u", "p", "n")}
    df, get = gathering(samples.select("u", "p", "n"), cols)
    dim, size = x.dim, x.n if x.fits else None
    if reg:
        for c in ("u", "p", "n"):
            df = df.withColumn(f"{c}0", F.col(c))
        df, get0 = gathering(df, {f"{c}0": reg_on for c in ("u", "p", "n")})

    def run(batches):
        sums = Sums(2 * dim if reg else dim, {ENTITY: size, LOSS: 1}, size is not None)
        for batch in batches:
            if batch.num_rows:
                *g, loss = pair_gradients(*(get(batch, c) for c in ("u", "p", "n")))
                if reg:  # the second half carries the regulariser's gradient, which skips the propagation
                    g = [np.hstack([gc, reg * get0(batch, f"{c}0")]) for gc, c in zip(g, ("u", "p", "n"), strict=True)]
                for c, gc in zip(("u", "p", "n"), g, strict=True):
                    yield from sums.add(ENTITY, batch.column(c).to_numpy(zero_copy_only=False), gc)
                row = np.zeros((1, sums.dim))
                row[0, :2] = loss.sum(), batch.num_rows
                yield from sums.add(LOSS, np.zeros(1, np.int64), row)
        yield from sums.rest()

    return summed(df, run, 2 * dim if reg else dim, x.fits)


def triple_gradients(kind: str, loss: str, margin: float, h, r, t, tn):
    from kgrec.operators.kernel import _triple_grads_np
    return _triple_grads_np(kind, loss, margin, h, r, t, tn)


def triple_loss(samples: DataFrame, x: Vectors, rels: np.ndarray, kind: str, loss: str, margin: float) -> DataFrame:
    """Summed gradients by entity and relation id for ``samples(h, r, t, tn)``."""
    df, get = gathering(samples.select("h", "r", "t", "tn"), {c: x for c in ("h", "t", "tn")})
    dim, size, shared = x.dim, x.n if x.fits else None, samples.sparkSession.sparkContext.broadcast(rels)

    def run(batches):
        sums = Sums(dim, {ENTITY: size, RELATION: len(shared.value), LOSS: 1}, size is not None)
        for batch in batches:
            if batch.num_rows:
                rel = batch.column("r").to_numpy(zero_copy_only=False)
                gh, gr, gt, gn, value = triple_gradients(kind, loss, margin, get(batch, "h"), shared.value[rel], get(batch, "t"), get(batch, "tn"))
                for c, g in (("h", gh), ("t", gt), ("tn", gn)):
                    yield from sums.add(ENTITY, batch.column(c).to_numpy(zero_copy_only=False), g)
                yield from sums.add(RELATION, rel, gr)
                row = np.zeros((1, dim))
                row[0, :2] = value.sum(), batch.num_rows
                yield from sums.add(LOSS, np.zeros(1, np.int64), row)
        yield from sums.rest()

    return summed(df, run, dim, x.fits)


# --- propagation --------------------------------------------------------------------------------------------

def propagated(edges: DataFrame, x: Vectors) -> Vectors:
    """Sum over ``edges(src, dst, w)`` of w x(src), by dst."""
    df, get = gathering(edges.select("src", "dst", "w"), {"src": x})
    dim, size = x.dim, x.n if x.fits else None

    def run(batches):
        sums = Sums(dim, {ENTITY: size}, size is not None)
        for batch in batches:
            if batch.num_rows:
                w = batch.column("w").to_numpy(zero_copy_only=False)
                yield from sums.add(ENTITY, batch.column("dst").to_numpy(zero_copy_only=False), get(batch, "src") * w[:, None])
        yield from sums.rest()

    out = summed(df, run, dim, x.fits)
    if x.fits:
        return collected(out, x, {})[0]
    return Vectors(written(out.select("id", F.col("g").alias("vec")), "layer"), x.n, dim)


def layer_mean(edges: DataFrame, x: Vectors, layers: int) -> Vectors:
    """Mean of x and its 1 .. ``layers``-fold propagations; for symmetric weights it is its own adjoint."""
    parts, cur = [x], x
    for _ in range(layers):
        cur = propagated(edges, cur)
        parts.append(cur)
    if x.fits:
        out = Vectors(None, x.n, x.dim, x.spark, sum(p.matrix() for p in parts) / (layers + 1))
    else:
        rows = parts[0].rows.select("id", "vec")
        for p in parts[1:]:
            rows = rows.unionByName(p.rows.select("id", "vec"))
        sums = rows.groupBy("id").agg(*[F.sum(F.col("vec")[d]).alias(f"g{d}") for d in range(x.dim)])
        mean = sums.select("id", F.array(*[F.col(f"g{d}") / F.lit(float(layers + 1)) for d in range(x.dim)]).alias("vec"))
        out = Vectors(written(mean, "mean"), x.n, x.dim)
        dropped(*(p.rows for p in parts[1:]))
    for p in parts[1:]:
        p.free()
    return out


COMPOSE = {"sub": lambda h, r: h - r, "add": lambda h, r: h + r, "mult": lambda h, r: h * r}
# Gradients of a composition to its two sides, from the gradient of the message.
DECOMPOSE = {"sub": lambda g, h, r: (g, -g), "add": lambda g, h, r: (g, g), "mult": lambda g, h, r: (g * r, g * h)}


def mean_edges(triples: DataFrame) -> DataFrame:
    """Both directions of ``triples(h, r, t)``: ``(src, rel, dst, way, w)`` with w one over the messages that dst gets that way (0: along the
    triples, 1: against)."""
    both = triples.select(F.col("h").alias("src"), F.col("r").alias("rel"), F.col("t").alias("dst"), F.lit(0).alias("way")).unionByName(
        triples.select(F.col("t").alias("src"), F.col("r").alias("rel"), F.col("h").alias("dst"), F.lit(1).alias("way")))
    n = both.groupBy("dst", "way").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    return both.join(n, ["dst", "way"]).select("src", "rel", "dst", "way", "w")


@dataclass
class Layer:
    """What the backward pass needs: the layer's input, its two mean messages and its output, as rows or as matrices."""
    rows: DataFrame | None                     # (id, h, a, b, out)
    mats: tuple[np.ndarray, ...] | None        # h, a, b, out
    out: Vectors
    rels: np.ndarray                           # relation vectors that the layer composed with


def convolved(edges: DataFrame, x: Vectors, rels: np.ndarray, w: dict[str, np.ndarray], comp: str, activation: bool) -> Layer:
    """One layer: act(a W_in + b W_out + h W_loop), a and b the mean composed messages of either direction."""
    df, get = gathering(edges, {"src": x})
    dim, size = x.dim, 2 * x.n if x.fits else None
    shared = edges.sparkSession.sparkContext.broadcast((rels, w))

    def messages(batches):
        sums, f = Sums(dim, {ENTITY: size}, size is not None), COMPOSE[comp]
        for batch in batches:
            if batch.num_rows:
                m = f(get(batch, "src"), shared.value[0][batch.column("rel").to_numpy(zero_copy_only=False)])
                ids = 2 * batch.column("dst").to_numpy(zero_copy_only=False) + batch.column("way").to_numpy(zero_copy_only=False)
                yield from sums.add(ENTITY, ids, m * batch.column("w").to_numpy(zero_copy_only=False)[:, None])
        yield from sums.rest()

    sums = summed(df, messages, dim, x.fits)
    if x.fits:
        both = collected(sums, x, {}, n=2 * x.n)[0].matrix()
        h, a, b = x.matrix(), both[0::2], both[1::2]
        out = a @ w["in"] + b @ w["out"] + h @ w["loop"]
        out = np.tanh(out) if activation else out
        return Layer(None, (h, a, b, out), Vectors(None, x.n, dim, x.spark, out), rels)
    zero = F.array_repeat(F.lit(0.0), dim)
    means = sums.select(F.floor(F.col("id") / 2).alias("id"), (F.col("id") % 2).alias("way"), "g")
    means = means.groupBy("id").agg(F.max(F.when(F.col("way") == 0, F.col("g"))).alias("a"), F.max(F.when(F.col("way") == 1, F.col("g"))).alias("b"))
    rows = x.rows.select("id", F.col("vec").alias("h")).join(means, "id", "full").select(
        "id", *[F.coalesce(c, zero).alias(c) for c in ("h", "a", "b")])

    def act(batches):
        weights = shared.value[1]
        for batch in batches:
            if batch.num_rows:
                h, a, b = (matrix(batch.column(c), dim) for c in ("h", "a", "b"))
                z = a @ weights["in"] + b @ weights["out"] + h @ weights["loop"]
                yield pa.RecordBatch.from_arrays([*batch.columns, list_array(np.tanh(z) if activation else z)], [*batch.schema.names, "out"])

    rows = written(rows.mapInArrow(act, "id bigint, h array<double>, a array<double>, b array<double>, out array<double>"), "conv")
    return Layer(rows, None, Vectors(rows.select("id", F.col("out").alias("vec")), x.n, dim), rels)


def convolved_back(edges: DataFrame, layer: Layer, x: Vectors, w: dict[str, np.ndarray], comp: str, activation: bool,
                   delta: Vectors) -> tuple[Vectors, np.ndarray, dict[str, np.ndarray]]:
    """From ``delta``, the gradient of the layer's output: that of its input, of the relations it composed with, and of its weights."""
    dim, sc = x.dim, edges.sparkSession.sparkContext
    shared = sc.broadcast((layer.rels, w))

    def through(h, a, b, out, g, weights):
        """The gradients of a, b and h, and of the three weights."""
        dz = g * (1 - out * out) if activation else g
        return [dz @ weights[c].T for c in ("in", "out", "loop")], [m.T @ dz for m in (a, b, h)]

    def inner(batches):
        sums = Sums(dim, {})
        for batch in batches:
            if batch.num_rows:
                parts, weights = through(*(matrix(batch.column(c), dim) for c in ("h", "a", "b", "out", "g")), shared.value[1])
                for k, m in enumerate(weights):
                    sums.add_all(WEIGHT + k, m)
                for kind, m in zip((ENTITY, -1, -2), parts, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), kind), pa.int32()), batch.column("id"), list_array(m)], ["kind", "id", "g"])
        yield from sums.rest()

    if x.fits:
        (ga, gb, loop), weights = through(*layer.mats, delta.matrix(), w)
        back, parts = Vectors(None, 2 * x.n, dim, x.spark, np.stack([ga, gb], axis=1).reshape(-1, dim)), None
    else:
        delta_rows = delta.rows.select("id", F.col("vec").alias("g"))
        parts = written(layer.rows.join(delta_rows, "id").select("id", "h", "a", "b", "out", "g").mapInArrow(inner, SUMS), "inner")
        back = Vectors(parts.filter(F.col("kind").isin(ENTITY, -1)).select(
            (2 * F.col("id") + F.when(F.col("kind") == ENTITY, 0).otherwise(1)).alias("id"), F.col("g").alias("vec")), 2 * x.n, dim)
    df, get = gathering(edges.withColumn("to", 2 * F.col("dst") + F.col("way")), {"to": back, "src": x})
    size = x.n if x.fits else None

    def outer(batches):
        """Against the edges: each message's gradient goes to its source and its relation."""
        rels = shared.value[0]
        sums, f = Sums(dim, {ENTITY: size, RELATION: len(rels)}, size is not None), DECOMPOSE[comp]
        for batch in batches:
            if batch.num_rows:
                g = get(batch, "to") * batch.column("w").to_numpy(zero_copy_only=False)[:, None]
                rel = batch.column("rel").to_numpy(zero_copy_only=False)
                gh, gr = f(g, get(batch, "src"), rels[rel])
                yield from sums.add(ENTITY, batch.column("src").to_numpy(zero_copy_only=False), gh)
                yield from sums.add(RELATION, rel, gr)
        yield from sums.rest()

    sizes = {RELATION: len(layer.rels)}
    if x.fits:
        gradient, got = collected(summed(df, outer, dim, True), x, sizes)
        gradient = Vectors(None, x.n, dim, x.spark, gradient.matrix() + loop)
    else:
        loops = parts.filter(F.col("kind") == -2).select(F.lit(ENTITY).alias("kind"), "id", "g")
        rest = parts.filter(F.col("kind") >= WEIGHT).select("kind", "id", "g")
        gradient, got = collected(rows_summed(df.mapInArrow(outer, SUMS).unionByName(loops).unionByName(rest), dim), x, sizes | {WEIGHT + k: dim for k in range(3)})
        weights = [got[WEIGHT + k] for k in range(3)]
        dropped(parts)
    back.free()
    return gradient, got[RELATION], dict(zip(("in", "out", "loop"), weights, strict=True))


# --- optimiser, state, epochs -------------------------------------------------------------------------------

class State:
    """A model in training: vectors with their Adam moments as rows ``(id, vec, m, s)`` or three matrices, small arrays with theirs,
    steps done, losses of the epochs."""

    def __init__(self, rows: DataFrame | None, n: int, dim: int, arrays: dict[str, np.ndarray], moments: dict | None = None, step: int = 0,
                 losses: list[float] | None = None, mats: tuple[np.ndarray, ...] | None = None, spark=None):
        self.table, self.n, self.dim, self.arrays, self.moments = rows, n, dim, arrays, moments or {}
        self.step, self.losses, self.mats, self.spark = step, losses or [], mats, spark or rows.sparkSession
        self.tops: DataFrame | None = None   # propagated vectors, where a run gives them
        if mats is None and Vectors(rows, n, dim).fits:
            t = rows.select("id", "vec", "m", "s").toArrow()
            self.mats = tuple(np.zeros((n, dim)) for _ in range(3))
            for c, m in zip(("vec", "m", "s"), self.mats, strict=True):
                m[t.column("id").to_numpy()] = matrix(t.column(c).combine_chunks(), dim)

    @property
    def rows(self) -> DataFrame:
        return self.table if self.mats is None else matrix_rows(self.spark, **dict(zip(("vec", "m", "s"), self.mats, strict=True)))

    def vectors(self) -> Vectors:
        return Vectors(self.table.select("id", "vec"), self.n, self.dim) if self.mats is None else Vectors(None, self.n, self.dim, self.spark, self.mats[0])

    def drop(self) -> None:
        if self.table is not None:
            dropped(self.table)


def adam(state: State, gradient: Vectors, arrays: dict[str, np.ndarray], lr: float) -> State:
    """One Adam step: rows whose gradient is not zero and the arrays move; all moments count the same steps."""
    t, dim = state.step + 1, state.dim
    c1, c2 = 1 - B1 ** t, 1 - B2 ** t

    def moved(vec, m, s, g):
        m, s = B1 * m + (1 - B1) * g, B2 * s + (1 - B2) * g * g
        return vec - lr * (m / c1) / (np.sqrt(s / c2) + EPS), m, s

    def rows_moved(all_, g):
        has = (g != 0).any(axis=1)
        out = tuple(v.copy() for v in all_)
        for v, new in zip(out, moved(*(v[has] for v in all_), g[has]), strict=True):
            v[has] = new
        return out

    def move(batches):
        for batch in batches:
            if batch.num_rows:
                out = rows_moved(tuple(matrix(batch.column(c), dim) for c in ("vec", "m", "s")), matrix(batch.column("g"), dim))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(list_array, out)], ["id", "vec", "m", "s"])

    new, moments = dict(state.arrays), dict(state.moments)
    for name, g in arrays.items():
        new[name], *both = moved(new[name], *moments.get(name, (np.zeros_like(g), np.zeros_like(g))), g)
        moments[name] = tuple(both)
    if state.mats is not None:
        return State(None, state.n, dim, new, moments, t, state.losses, rows_moved(state.mats, gradient.matrix()), state.spark)
    g = gradient.rows.select("id", F.col("vec").alias("g"))
    joined = state.table.join(g, "id", "left").select("id", "vec", "m", "s", F.coalesce("g", F.array_repeat(F.lit(0.0), dim)).alias("g"))
    rows = written(joined.mapInArrow(move, "id bigint, vec array<double>, m array<double>, s array<double>"), "state")
    return State(rows, state.n, dim, new, moments, t, state.losses)


class EpochLog:
    """States of finished epochs under a folder: tables first, the commit marker last; the last two stay."""

    def __init__(self, spark, path: str, settings: dict):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), json.dumps(settings, sort_keys=True)

    def committed(self) -> list[int]:
        if not exists(self.spark, self.path):
            return []
        return sorted(int(name[6:]) for name in list_folder(self.spark, self.path) if name.startswith("epoch-")
                      and exists(self.spark, f"{self.path}/{name}/committed"))

    def save(self, epoch: int, state: State) -> State:
        at = f"{self.path}/epoch-{epoch}"
        remove(self.spark, at)  # what an interrupted attempt left
        state.rows.write.parquet(f"{at}/rows")
        arrays = {**state.arrays, **{f"{k} {x}": v for k, both in state.moments.items() for x, v in zip("ms", both, strict=True)}}
        values = [(k, list(map(int, v.shape)), v.ravel().tolist()) for k, v in arrays.items()]
        values.append(("losses", [len(state.losses)], [float(x) for x in state.losses]))
        note = [(self.settings, state.n, state.dim, state.step, values)]
        kind = "settings string, n bigint, dim int, step bigint, arrays array<struct<name:string,shape:array<int>,value:array<double>>>"
        self.spark.createDataFrame(note, kind).write.parquet(f"{at}/arrays")
        touch(self.spark, f"{at}/committed")
        for old in self.committed()[:-2]:
            remove(self.spark, f"{self.path}/epoch-{old}")
        if state.mats is not None:
            return state
        return State(self.spark.read.parquet(f"{at}/rows"), state.n, state.dim, state.arrays, state.moments, state.step, state.losses)

    def last(self) -> tuple[int, State] | None:
        done = self.committed()
        if not done:
            return None
        at = f"{self.path}/epoch-{done[-1]}"
        note = self.spark.read.parquet(f"{at}/arrays").first()
        if note["settings"] != self.settings:
            raise ValueError(f"{self.path} has epochs of other settings: {note['settings']}")
        arrays = {a["name"]: np.array(a["value"], float).reshape(a["shape"]) for a in note["arrays"]}
        losses = arrays.pop("losses").tolist()
        moments = {k[:-2]: (v, arrays[f"{k[:-2]} s"]) for k, v in arrays.items() if k.endswith(" m")}
        plain = {k: v for k, v in arrays.items() if not k.endswith((" m", " s"))}
        return done[-1], State(self.spark.read.parquet(f"{at}/rows"), note["n"], note["dim"], plain, moments, note["step"], losses)


def run_epochs(state: State, step: Callable, samples: Callable, rows: int, columns: list[str], epochs: int, lr: float, batch_rows: int,
               log: EpochLog | None = None, separable=None) -> State:
    """``step(state, batch)`` gives (gradient, array gradients, loss row) of a batch of ``samples(epoch)``, about ``rows`` samples; epochs
    that ``log`` has are not run again.  A ``separable`` model that the driver may not hold is trained by ``sliced``."""
    first, batches = 0, max(1, -(-rows // batch_rows))
    if log is not None and (last := log.last()):
        first, state = last
    if separable is not None and state.mats is None:
        from kgrec.operators.sliced import run_sliced
        return run_sliced(state, separable, samples, batches, columns, first, epochs, lr, log)
    for epoch in range(first, epochs):
        drawn = samples(epoch) if batches == 1 else written(samples(epoch), "samples")  # each batch reads them
        total = np.zeros(2)
        for batch in dealt(drawn, columns, epoch, batches):
            gradient, arrays, loss = step(state, batch)
            before, state = state, adam(state, gradient, arrays, lr)
            before.drop()
            if not gradient.fits:
                dropped(gradient.rows)
            total += loss[0, :2]
        state.losses = [*state.losses, float(total[0] / max(total[1], 1))]
        dropped(drawn)
        if log is not None:
            before, state = state, log.save(epoch + 1, state)
            before.drop()
    return state


def started(entities: DataFrame, dim: int, seed: int, scale: float) -> tuple[DataFrame, DataFrame, int]:
    """``(entity, id)`` in sorted order, the first state's rows, and how many."""
    from kgrec.operators.kernel import init_vectors
    index = written(dense_index(entities.select("entity"), "entity", "id"), "index")
    rows = init_vectors(index, seed=seed, dim=dim, scale=scale).join(index, "entity")
    zero = F.array_repeat(F.lit(0.0), dim)
    return index, written(rows.select("id", "vec", zero.alias("m"), zero.alias("s")), "state"), index.count()


def normal(shape: tuple[int, ...], seed: int, scale: float) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(shape) * scale
