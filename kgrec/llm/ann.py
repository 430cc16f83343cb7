"""Approximate nearest neighbours by a forest of random-projection trees (operator 10).

``fit``     trees on a bounded sample (the ``SAMPLE`` vectors of smallest hash): a node cuts at the median of a random
            projection.  For the inner product, vectors get one more component that makes their norms equal, so the
            largest product is the smallest angle.
``search``  every row is put into its leaf of each tree.  A query walks all trees through one priority queue, nearest cut
            first, until the visited leaves hold ``SHARE`` of the sample's distinct vectors.  Leaves and their queries meet
            in bounded blocks, which are scored exactly in double precision; each query's best are merged.  Only rows of
            visited leaves are candidates; a block returns none below the last of the best that the sample has in them.

A leaf of any size is cut into blocks of about ``BLOCK_ROWS``, so a vector that a third of all rows repeat is split too.
Recall is measured against brute force in the tests (0.9 and more of the 20 nearest), also on a table of four samples.

Defined results: vectors that are null, zero, hold null or non-finite components, or lack an id take no part, nor do those
of another length than most; repeated ids of equal vectors count once, those of different vectors by their best; a query
never finds its own id; equal scores go by the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kgrec.llm.common import written

NEAREST = 20
TREES = 12
SAMPLE = 8192
LEAVES = 64            # leaves of a tree, about; a leaf holds at least LEAST of the sample
LEAST = 32
SHARE = 0.78
BLOCK_ROWS = 1024
BLOCK_QUERIES = 256
SEED = 10
TIE = 1e-12            # scores this near the last of the visited sample's best count as equal to it
MAX_ID = (1 << 63) - 1


class Forest:
    def __init__(self, sample: np.ndarray, norm: float, trees: int = TREES, leaves: int = LEAVES, seed: int = SEED,
                 ids: np.ndarray | None = None):
        self.norm, self.ids, self.rows = norm, np.arange(len(sample)) if ids is None else ids, sample
        own, which = np.unique(sample, axis=0, return_inverse=True)  # a repeated vector neither moves cuts nor counts as more visited
        self.which = which.ravel()
        x = self.lifted(own)
        rng = np.random.default_rng(seed)
        self.repeats = len(self.ids) - len(np.unique(self.ids))
        self.trees = [self._grow(x, max(LEAST, -(-len(x) // leaves)), rng) for _ in range(trees)]
        for tree, at in zip(self.trees, self.leaves_of(own).T, strict=True):  # as ``search`` places them, to the last bit
            tree["members"] = [np.flatnonzero(at == k) for k in range(len(tree["members"]))]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm ** 2 - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, rest[:, None]])

    @staticmethod
    def _grow(x: np.ndarray, least: int, rng: np.random.Generator) -> dict:
        """Arrays of the inner nodes (direction, cut, two children; a child below 0 is leaf -1 - child) and each leaf's rows."""
        ways, cuts, children, members = [], [], [], []

        def node(rows: np.ndarray) -> int:
            if len(rows) > least:
                way = rng.standard_normal(x.shape[1])
                p = x[rows] @ (way / np.linalg.norm(way))
                cut = float(np.median(p))
                left = p < cut
                if left.any() and not left.all():
                    k = len(ways)
                    ways.append(way / np.linalg.norm(way))
                    cuts.append(cut)
                    children.append([0, 0])
                    children[k] = [node(rows[left]), node(rows[~left])]
                    return k
            members.append(rows)
            return -len(members)

        root = node(np.arange(len(x)))
        return {"root": root, "ways": np.array(ways).reshape(-1, x.shape[1]), "cuts": np.array(cuts),
                "children": np.array(children, np.int64).reshape(-1, 2), "members": members}

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x = self.lifted(x)
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, tree in enumerate(self.trees):
            at = np.full(len(x), tree["root"])
            while (inner := np.flatnonzero(at >= 0)).size:
                n = at[inner]
                right = np.einsum("ij,ij->i", x[inner], tree["ways"][n]) >= tree["cuts"][n]
                at[inner] = tree["children"][n, right.astype(int)]
            out[:, t] = -1 - at
        return out

    def end_of_visited(self, query_id: int, query: np.ndarray, seen: np.ndarray, nearest: int) -> tuple[float, int]:
        """Score and id of the last of the ``nearest`` best sample rows in visited leaves but the query's own, each id once."""
        rows = np.flatnonzero(seen[self.which])
        ids, scores = self.ids[rows], _products(query[None], self.rows[rows])[0]
        order = np.lexsort((ids, -scores))[:nearest + np.count_nonzero(ids == query_id) + self.repeats]
        order = order[ids[order] != query_id]
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)][:nearest]
        return (float(scores[order[-1]]), int(ids[order[-1]])) if len(order) == nearest else (-np.inf, MAX_ID)

    def visits(self, query: np.ndarray, share: float, least: int) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Leaves in the order of one priority queue over all trees, until they hold ``share`` of the sample's distinct
        vectors, and which of these they hold."""
        q = np.append(query / np.linalg.norm(query) * self.norm, 0.0)
        margins = [tree["ways"] @ q - tree["cuts"] for tree in self.trees]
        heap = [(-np.inf, t, tree["root"]) for t, tree in enumerate(self.trees)]
        n = sum(map(len, self.trees[0]["members"]))
        want, seen, out = min(n, max(least + self.repeats, int(np.ceil(share * n)))), np.zeros(n, bool), []
        while heap and np.count_nonzero(seen) < want:
            worst, t, k = heapq.heappop(heap)
            tree = self.trees[t]
            if k < 0:
                out.append((t, -1 - k))
                seen[tree["members"][-1 - k]] = True
                continue
            m = margins[t][k]
            heapq.heappush(heap, (max(worst, m), t, int(tree["children"][k, 0])))
            heapq.heappush(heap, (max(worst, -m), t, int(tree["children"][k, 1])))
        return out, seen


def vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, vec)``: the rows that take part."""
    v = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(~bad & F.exists("vec", lambda x: x != 0))
    return v.withColumn("dim", F.size("vec"))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision; a pair's sum does not depend on the block that it is in."""
    return np.einsum("ij,kj->ik", queries, rows)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(valid: DataFrame, dim: int, norm: float, trees: int = TREES, leaves: int = LEAVES, sample: int = SAMPLE) -> Forest:
    first = valid.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(sample).select("vec_id", "vec").toArrow()  # ``sample`` rows at most
    rows = np.array(first.column("vec").to_pylist(), float).reshape(-1, dim)
    return Forest(rows, norm, trees, leaves, ids=first.column("vec_id").to_numpy())


def search(rows: DataFrame, queries: DataFrame, nearest: int = NEAREST, trees: int = TREES, leaves: int = LEAVES,
           sample: int = SAMPLE, share: float = SHARE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's nearest rows found, from 1."""
    spark = rows.sparkSession
    valid = vectors(rows)
    dims = valid.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("m"))
    top = dims.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, norm = int(top["dim"]), float(np.sqrt(top["m"]))
    valid = valid.filter(F.col("dim") == dim).select("vec_id", "vec")
    forest = spark.sparkContext.broadcast(fit(valid, dim, norm, trees, leaves, sample))  # sample and nodes are bounded

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = forest.value.leaves_of(_matrix(b.column("vec"), dim))
            for t in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(np.full(len(at), t, np.int32)),
                                                  pa.array(at[:, t].astype(np.int32))], ["vec_id", "vec", "tree", "leaf"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                x = _matrix(part.column("vec"), dim)
                visited = [forest.value.visits(q, share, 2 * nearest + 2) for q in x]
                i, t, leaf = (np.array(c) for c in zip(*((i, *v) for i, (leaves, _) in enumerate(visited) for v in leaves), strict=True))
                last, last_id = (np.array(c) for c in zip(*(forest.value.end_of_visited(k, q, seen, nearest) for k, q, (_, seen) in zip(
                    part.column("vec_id").to_pylist(), x, visited, strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(i)), part.column("vec").take(pa.array(i)),
                                                  pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(last[i]),
                                                  pa.array(last_id[i])], ["vec_id", "vec", "tree", "leaf", "last", "last_id"])

    schema = "vec_id bigint, vec array<double>, tree int, leaf int"
    keys = ["tree", "leaf"]

    def blocks(df: DataFrame, size: int, prefix: str, more: tuple[str, ...] = ()) -> DataFrame:
        placed = written(df, f"ann-{prefix}")
        cells = placed.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(size)).alias("n"))  # a row for each leaf of the forest
        dealt = placed.join(F.broadcast(cells), keys).groupBy(*keys, F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.col("n")).alias("block"))
        return dealt.agg(F.collect_list(F.struct("vec_id", "vec", *more)).alias("b")).select(
            *keys, F.col("b.vec_id").alias(f"{prefix}_ids"), F.col("b.vec").alias(f"{prefix}_vecs"), *[F.col(f"b.{c}").alias(c) for c in more])

    asked = vectors(queries).filter(F.col("dim") == dim).select("vec_id", "vec").dropDuplicates()
    met = blocks(valid.dropDuplicates().mapInArrow(place, schema), BLOCK_ROWS, "row").join(
        blocks(asked.mapInArrow(walk, f"{schema}, last double, last_id bigint"), BLOCK_QUERIES, "query", ("last", "last_id")), keys)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, v, s = [], [], []
            for ids, vecs, asked_ids, asked_vecs, last, last_id in zip(*b.columns, strict=True):
                ids = ids.values.to_numpy()
                x, y = _matrix(vecs.values, dim), _matrix(asked_vecs.values, dim)
                order = np.argsort(ids, kind="stable")  # equal scores go by the smaller id
                ids, x = ids[order], x[order]
                for query, scores, end, end_id in zip(asked_ids.values.to_numpy(), _products(y, x), last.values.to_numpy(),
                                                      last_id.values.to_numpy(), strict=True):
                    other = (ids != query) & ((scores > end) | ((scores >= end - TIE) & (ids <= end_id)))
                    keep = np.argsort(-scores[other], kind="stable")[:nearest]
                    q.append(np.full(len(keep), query))
                    v.append(ids[other][keep])
                    s.append(scores[other][keep])
            q, v, s = (np.concatenate(c) if c else np.empty(0, t) for c, t in ((q, np.int64), (v, np.int64), (s, float)))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            new = np.ones(len(q), bool)  # the same row from several trees has the same score and stands next to itself
            new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
            q, v, s = q[new], v[new], s[new]
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
            place_in = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
            keep = place_in < nearest
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(v[keep]), pa.array(s[keep])], ["query_id", "vec_id", "score"])

    result = "query_id bigint, vec_id bigint, score double"
    found = met.select("row_ids", "row_vecs", "query_ids", "query_vecs", "last", "last_id").mapInArrow(best, result)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
