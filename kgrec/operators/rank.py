"""Ranking operators: per-user top-k (W1/T1), dense index (W2), whole-catalogue top-k.

Scale notes
-----------
* ``topk_per_user`` is ``row_number() <= k`` over (group, user); Spark turns this into a partial
  ``WindowGroupLimit`` before the shuffle, so a user holding a third of all rows ships only k rows
  per map partition.
* ``global_row_number`` never sends all rows to one task: it range-sorts, counts rows per sorted
  partition (a table with one row per partition, a proven small bound), and adds offsets.
* ``topk_scored_items`` ranks the whole catalogue with a model: a task takes user blocks through many item blocks, each pair of
  blocks is one matrix of scores, and only each user's best k rows leave the task.  Neither side is copied by a shuffle.
* ``topk_all_items`` never forms users x items.  A user can only reach the first ``k + |train_u|``
  catalogue positions, so it joins each user to exactly those positions (equi-join on the position).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_user(preds: DataFrame, k: int, user_col: str = "user_id", item_col: str = "item_id",
                  score_col: str = "score", group_cols: Sequence[str] = (),
                  rank_col: str = "rank") -> DataFrame:
    """Top-k rows per user by score desc, item asc (ties broken by the smaller item id)."""
    w = Window.partitionBy(*group_cols, user_col).orderBy(F.col(score_col).desc(), F.col(item_col).asc())
    return preds.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def global_row_number(df: DataFrame, order: Sequence[Column], index_col: str = "idx",
                      start: int = 0) -> DataFrame:
    """Exact dense 0-based (or ``start``-based) position of each row in ``order``, distributed.

    The sorted frame is checkpointed to the shared checkpoint folder first, so both passes see the
    same partitioning even after an executor loss.
    """
    spark = df.sparkSession
    from kgrec.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    tagged = (df.orderBy(*order)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    part = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid") - F.shiftleft(part, 33)
    counts = tagged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    # one row per sorted partition: bounded by the partition count, safe to broadcast
    out = tagged.join(F.broadcast(offsets), part == F.col("_p"))
    return out.withColumn(index_col, (F.coalesce(F.col("_off"), F.lit(0)) + local + start).cast("bigint")) \
              .drop("_mid", "_p", "_off")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys that come before in ``order`` (equal ones in any order).

    Keys and order are range-sorted together, so a key of any size is cut over many tasks: each sums its part, and the sums of
    the parts before (a row for each key and part) are added.  Keys must not be null.
    """
    from kgrec.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    salted = df.withColumn("_salt", F.monotonically_increasing_id())  # equal rows can be cut apart
    tagged = (salted.orderBy(*[F.col(k) for k in keys], *order, "_salt").drop("_salt")
              .withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", 33)).checkpoint(eager=True))
    here = Window.partitionBy(*keys, "_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    parts = tagged.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    return (tagged.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0))).join(starts, [*keys, "_part"])
            .withColumn(name, F.col("_start") + F.col("_here")).drop("_mid", "_part", "_here", "_start"))


def dense_index(keys: DataFrame, key_col: str, index_col: str = "idx") -> DataFrame:
    """0-based index of the sorted distinct keys."""
    distinct = keys.select(key_col).distinct()
    return global_row_number(distinct, [F.col(key_col).asc()], index_col)


POS_CHUNK = 4096


def topk_all_items(users: DataFrame, item_scores: DataFrame, seen: DataFrame, k: int,
                   mask_score: float | None = None) -> DataFrame:
    """Top-k over the whole catalogue per user with the user's seen items removed (or masked).

    ``users(user_id)``, ``item_scores(item_id, score)`` (user-independent score such as popularity),
    ``seen(user_id, item_id)``.  With ``mask_score`` set, seen items keep that score instead of being
    removed and may still fill a list when the catalogue runs out.
    Output ``(user_id, item_id, score, rank)``.
    """
    ranked = global_row_number(item_scores, [F.col("score").desc(), F.col("item_id").asc()], "pos", start=1)
    n_seen = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seen"))
    reach = (users.select("user_id").distinct()
             .join(n_seen, "user_id", "left")
             .select("user_id", (F.lit(k) + F.coalesce(F.col("n_seen"), F.lit(0))).alias("reach")))
    # positions 1..reach in chunks of POS_CHUNK, spread over tasks before they are expanded, so a
    # user with a third of all seen items does not generate its whole range in one task
    chunks = reach.select("user_id", "reach", F.explode(
        F.sequence(F.lit(0).cast("bigint"), ((F.col("reach") - 1) / POS_CHUNK).cast("bigint"))).alias("chunk"))
    chunks = chunks.repartition("user_id", "chunk")
    lo = F.col("chunk") * POS_CHUNK + 1
    hi = F.least(F.col("reach").cast("bigint"), (F.col("chunk") + 1) * POS_CHUNK)
    slots = chunks.select("user_id", "chunk", F.explode(F.sequence(lo, hi)).alias("pos"))
    places = ranked.select("pos", "item_id", "score")
    # nearly all slots are in the first chunk: its POS_CHUNK places are broadcast, so no place of the head is a hot key
    head = slots.filter("chunk = 0").join(F.broadcast(places.filter(F.col("pos") <= POS_CHUNK)), "pos")
    tail = slots.filter("chunk > 0").join(places.filter(F.col("pos") > POS_CHUNK).hint("merge"), "pos")
    cand = head.unionByName(tail).drop("chunk")
    # files of many narrow columns look small enough to broadcast and are not
    if mask_score is None:
        cand = cand.join(seen.select("user_id", "item_id").hint("merge"), ["user_id", "item_id"], "left_anti")
    else:
        flagged = seen.select("user_id", "item_id", F.lit(True).alias("_seen")).hint("merge")
        cand = (cand.join(flagged, ["user_id", "item_id"], "left")
                .withColumn("score", F.when(F.col("_seen"), F.lit(float(mask_score))).otherwise(F.col("score")))
                .drop("_seen"))
    return topk_per_user(cand.select("user_id", "item_id", "score"), k)


USER_BLOCK, ITEM_BLOCK = 512, 4096
MOST_USERS = 2048  # of a block: an item block is read once a user block
ITEM_BLOCKS = 64   # item blocks that a task takes its users through, at most
ROUGH_USERS = 128  # users of a block that are scored roughly at once


class DotScores:
    """Scores u . v, to 9 digits (so that ties do not hang on the order of summation).

    Called with two blocks of vectors it gives the matrix of their scores.  ``rough`` gives it in single precision with the most that
    each row may be off, by which ``topk_scored_items`` leaves out pairs that cannot be in a list: with d dimensions,
    |error| <= (d + 3) 2^-24 sum |u_i v_i|, and that sum is at most |u| |v|.
    """

    def __call__(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.round(u @ v.T, 9)

    def prepared(self, v: np.ndarray):
        return np.ascontiguousarray(v.T, np.float32), float(np.sqrt((v * v).sum(axis=1)).max(initial=0.0))

    def rough(self, u: np.ndarray, prepared) -> tuple[np.ndarray, np.ndarray]:
        v, most = prepared
        off = (u.shape[1] + 4) * 2.0 ** -23 * np.sqrt((u * u).sum(axis=1)) * most + 1e-30
        return u.astype(np.float32) @ v, np.where(off < 1e30, off, np.inf)  # beyond it single precision may overflow

    def of(self, value: np.ndarray) -> np.ndarray:
        """The score of a value."""
        return value

    def level(self, score: np.ndarray) -> np.ndarray:
        """What the value of a pair is at least, whose score is ``score`` or more."""
        return score - 1e-9 - 1e-15 * np.abs(score)

    def pairs(self, u: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The scores of some pairs of the blocks."""
        return np.round(np.einsum("ij,ij->i", u[rows], v[cols]), 9)


dot_scores = DotScores()


def _best(user: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each user's k best: by score (not-a-number first, as Spark orders it), equal ones by the smaller item."""
    order = np.lexsort((item, -np.where(np.isnan(score), np.inf, score), ~np.isnan(score), user))
    user = user[order]
    begins = np.flatnonzero(np.r_[True, user[1:] != user[:-1]]) if len(user) else np.zeros(0, np.int64)
    near = np.arange(len(user)) - np.repeat(begins, np.diff(np.r_[begins, len(user)])) < k
    return user[near], item[order[near]], score[order[near]]


def _block_best(scores: np.ndarray, item: np.ndarray, who: np.ndarray, seen: np.ndarray, k: int, mask_score: float | None) -> tuple[np.ndarray, ...]:
    """``(user, item, score)`` of each user's k best of a block by sorted ``item``; ``who`` (places) have ``seen`` items."""
    low, high = np.searchsorted(item, seen), np.searchsorted(item, seen, "right")
    many = high - low  # none for items of other blocks
    rows, cols = np.repeat(who, many), np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    if mask_score is not None:
        scores = scores.copy()
        scores[rows, cols] = mask_score
    key = np.where(np.isnan(scores), np.inf, scores)
    if mask_score is None:
        key[rows, cols] = -np.inf
    if k < key.shape[1]:
        least = np.partition(key, key.shape[1] - k, axis=1)[:, key.shape[1] - k]
        near = key >= least[:, None]  # equal ones as well
    else:
        near = np.ones(key.shape, bool)
    if mask_score is None:
        near[rows, cols] = False
    user, at = np.nonzero(near)
    return _best(user, item[at], scores[user, at], k)


def _near(score, u: np.ndarray, v: np.ndarray, prepared, least: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of the pairs that may be among the k best with a score of ``least`` or more a user, but for the pairs (rows, cols), sorted by row;
    None where they are so many that all scores may as well be worked out."""
    out, many, begins = [], 0, np.searchsorted(rows, np.arange(0, len(u) + ROUGH_USERS, ROUGH_USERS))
    for part, at in enumerate(range(0, len(u), ROUGH_USERS)):
        rough, off = score.rough(u[at:at + ROUGH_USERS], prepared)
        mine = slice(begins[part], begins[part + 1])
        rough[rows[mine] - at, cols[mine]] = -np.inf
        with np.errstate(invalid="ignore"):
            bound = least[at:at + ROUGH_USERS]
            if k < rough.shape[1] and not np.isfinite(bound).all():  # no list of k yet: the k-th roughly best of this block bounds it
                bound = np.maximum(bound, score.of(np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k] - off))
            low = score.level(bound) - off
            low = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
            # not-a-number has to be worked out
            which = np.flatnonzero(~(rough < low[:, None]))
        user, item = np.divmod(which, rough.shape[1])
        taken = rough[user, item] == -np.inf
        out.append((user[~taken] + at, item[~taken]))
        many += len(which)
        if many > len(u) * len(v) // 8 + 4 * k * len(u):
            return None
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _taken_through(score, u: np.ndarray, v: np.ndarray, item: np.ndarray, who: np.ndarray, seen: np.ndarray, k: int, mask_score: float | None,
                   held: tuple[np.ndarray, ...], rough: bool) -> tuple[np.ndarray, ...]:
    """``held``, each user's k best so far as ``(user, item, score)``, after the block by sorted ``item``; ``who`` (places) have ``seen`` items."""
    if not rough:
        return _best(*(np.concatenate(c) for c in zip(held, _block_best(score(u, v), item, who, seen, k, mask_score), strict=True)), k)
    low, high = np.searchsorted(item, seen), np.searchsorted(item, seen, "right")
    many = high - low  # none for items of other blocks
    rows, cols = np.repeat(who, many), np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    least = np.full(len(u), -np.inf)
    full = np.bincount(held[0], minlength=len(u)) >= k
    ends = np.searchsorted(held[0], np.arange(len(u)), "right") - 1
    least[full] = held[2][ends[full]]  # not-a-number leads a list; where a list ends with it all are worked out
    found = _near(score, u, v, score.prepared(v), np.where(np.isnan(least), -np.inf, least), rows, cols, k)
    if found is None:
        return _taken_through(score, u, v, item, who, seen, k, mask_score, held, False)
    new = found[0], item[found[1]], score.pairs(u, v, *found)
    masked = () if mask_score is None else ((rows, item[cols], np.full(len(rows), float(mask_score))),)
    return _best(*(np.concatenate(c) for c in zip(held, new, *masked, strict=True)), k)


def topk_scored_items(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, mask_score: float | None = None,
                      score: Callable[[np.ndarray, np.ndarray], np.ndarray] = dot_scores, user_block: int | None = None,
                      item_block: int = ITEM_BLOCK) -> DataFrame:
    """Top-k of the whole catalogue per user by a model's score of ``users(user_id, vec)`` and ``items(item_id, vec)``.

    ``score`` maps two blocks of vectors to their matrix of scores (a dot product, a distance, a network); one that has ``rough`` scores
    with a bound of their error (``DotScores``) is worked out exactly only where a pair may come into a list.  Users travel with
    their seen items, which go, or with ``mask_score`` keep that score, before the best k are taken.  A task takes its user
    blocks through up to ``ITEM_BLOCKS`` item blocks and gives k rows a user.  Output ``(user_id, item_id, score, rank)``.
    """
    spark = users.sparkSession
    had = seen.filter("item_id IS NOT NULL").groupBy("user_id").agg(F.collect_set(F.col("item_id").cast("bigint")).alias("seen"))
    known = users.join(had, "user_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
    many, cores = users.count(), spark.sparkContext.defaultParallelism
    user_block = user_block or min(max(many // (4 * cores), USER_BLOCK), MOST_USERS)
    n_users, n_items = (max(1, -(-n // size)) for n, size in ((many, user_block), (items.count(), item_block)))
    ub = known.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(n_users)).alias("ub")).agg(F.collect_list(F.struct("user_id", "vec", "seen")).alias("u"))
    ib = items.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n_items)).alias("ib")).agg(F.sort_array(F.collect_list(F.struct("item_id", "vec"))).alias("i"))
    ub, ib = ub.select("ub", "u.user_id", F.col("u.vec").alias("vec"), "u.seen"), ib.select("i.item_id", F.col("i.vec").alias("vec"))

    def packed(batches):
        """Vectors of a block as one buffer: it is copied whole for each block that it meets."""
        for b in batches:
            at = b.schema.get_field_index("vec")
            buffers = [v.values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).tobytes() for v in b.column(at)]
            yield b.set_column(at, "vec", pa.array(buffers, pa.binary()))

    ub, ib = (df.mapInArrow(packed, ", ".join(f"{c} {'binary' if c == 'vec' else t}" for c, t in df.dtypes)) for df in (ub, ib))
    # Few bytes but much work: tasks by blocks and cores, not by bytes.  Each task reads its blocks of either side itself.
    left = ub.repartition(min(n_users, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)))
    right = ib.repartition(-(-n_items // ITEM_BLOCKS)).hint("shuffle_replicate_nl")
    right = right.select("item_id", F.col("vec").alias("i_vec"))
    pairs = left.withColumnRenamed("vec", "u_vec").crossJoin(right).select("ub", "user_id", "u_vec", "seen", "item_id", "i_vec")
    rough = hasattr(score, "rough")

    def best(batches):
        block, ids, u, who, had, held = None, None, None, None, None, None

        def out():
            return pa.RecordBatch.from_arrays([ids.take(pa.array(held[0])), pa.array(held[1]), pa.array(held[2])], ["user_id", "item_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                if block != b.column(0)[r].as_py():  # a user block meets its item blocks one after the other
                    if held:
                        yield out()
                    block, ids, seen = b.column(0)[r].as_py(), b.column(1)[r].values, b.column(3)[r].values
                    u = np.frombuffer(b.column(2)[r].as_buffer()).reshape(len(ids), -1)
                    who, had = np.repeat(np.arange(len(ids)), seen.value_lengths().to_numpy()), seen.flatten().to_numpy()
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                item = b.column(4)[r].values.to_numpy()
                v = np.frombuffer(b.column(5)[r].as_buffer()).reshape(len(item), -1)
                held = _taken_through(score, u, v, item, who, had, k, mask_score, held, rough)
        if held:
            yield out()

    return topk_per_user(pairs.mapInArrow(best, "user_id bigint, item_id bigint, score double"), k)
