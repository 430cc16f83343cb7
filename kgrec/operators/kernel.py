"""Embedding training on DataFrames: BPR (R10), CFKG with TransE / inner product (R12), KGE.

One epoch is one synchronous full-batch gradient step:

1. samples (positive + corrupted slot) join the current entity / relation vectors;
2. per-sample gradients are numpy maths on Arrow batches (``mapInPandas``), pre-summed by key
   inside each batch; scores used elsewhere stay Catalyst expressions;
3. gradients are emitted per slot and summed per (kind, key) with one partial ``sum`` per dimension
   (map-side combine, so an entity in a third of all samples is fine); entity gradients, relation
   gradients and the loss come out of this one aggregate; the sampled ids of an epoch are checkpointed, the
   per-sample vectors and gradients never are;
4. vectors are updated and the new table is checkpointed to the shared checkpoint folder, so the
   lineage of every epoch is one step deep and a lost executor recomputes one epoch at most.

Negative slots come from a modular hash of dense ids and the epoch (reproducible, partition-free); a slot
that hits a known positive moves on, so every positive keeps one negative.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgrec.operators.rank import dense_index, running_sum
from kgrec.operators.vectors import DIM, dot, for_draws, hashed_normal

INIT_SCALE = 0.1


# ---- array arithmetic ---------------------------------------------------------------------------

def vadd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vsub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vmul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def vscale(a: Column, s: Column) -> Column:
    """a * s.  The scalar is repeated into an array first, so it is evaluated once per row: inside a
    lambda the optimizer may inline an expensive scalar and re-evaluate it for every element."""
    return F.zip_with(a, F.array_repeat(s, F.size(a)), lambda x, y: x * y)


def sqnorm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def init_vectors(keys: DataFrame, key_col: str = "entity", seed: int = 42, dim: int = DIM,
                 scale: float = INIT_SCALE) -> DataFrame:
    """N(0, scale^2) vectors keyed by a hash of (key, dim, seed): same under any partitioning."""
    draw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda d: F.lit(scale) * hashed_normal(F.col(key_col).cast("string"), d, seed))
    return for_draws(keys.select(key_col).distinct(), key_col).select(F.col(key_col).alias("entity"), draw.alias("vec"))


def _sum_by_key(grads: DataFrame, dim: int) -> DataFrame:
    """One partial aggregate for every gradient kind (entities, relations, loss) of an epoch."""
    aggs = [F.sum(F.col("g")[d]).alias(f"_g{d}") for d in range(dim)]
    s = grads.groupBy("kind", "entity").agg(*aggs)
    return s.select("kind", "entity", F.array(*[F.col(f"_g{d}") for d in range(dim)]).alias("g"))


def _apply(vecs: DataFrame, gsum: DataFrame, lr: float, n: Column | float) -> DataFrame:
    j = vecs.join(gsum, "entity", "left")
    step = F.lit(lr) / (n if isinstance(n, Column) else F.lit(float(n)))
    new = F.when(F.col("g").isNull(), F.col("vec")).otherwise(vsub(F.col("vec"), vscale(F.col("g"), step)))
    return j.select("entity", new.alias("vec"))


def _checkpoint(df: DataFrame) -> DataFrame:
    from kgrec.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)



# ---- per-sample gradients in Arrow batches --------------------------------------------------------
# Catalyst's array lambdas (zip_with / transform) are interpreted element by element, so the
# per-sample gradient maths runs in numpy on Arrow batches; Spark still does the joins, the shuffle
# and the per-entity sums.  Each batch is pre-summed by key before it leaves the task.

GRAD_SCHEMA = "kind string, entity string, g array<double>"


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 0))


def _presum(kinds: list[str], keys: list[np.ndarray], grads: list[np.ndarray], loss_sum: float,
            dim: int) -> pd.DataFrame:
    """Sum the batch's gradient rows per (kind, key): factorize keys, sort, ``add.reduceat``."""
    kind_out, ent_out, g_out = [], [], []
    for kd in dict.fromkeys(kinds):
        sel = [i for i, x in enumerate(kinds) if x == kd]
        ks = np.concatenate([np.asarray(keys[i], dtype=object) for i in sel])
        gs = np.concatenate([grads[i] for i in sel], axis=0)
        codes, uniq = pd.factorize(ks)
        order = np.argsort(codes, kind="stable")
        sc = codes[order]
        starts = np.flatnonzero(np.r_[True, sc[1:] != sc[:-1]])
        sums = np.add.reduceat(gs[order], starts, axis=0)
        kind_out.extend([kd] * len(starts))
        ent_out.extend(uniq[sc[starts]].tolist())
        g_out.extend(list(sums))
    loss_vec = np.zeros(dim)
    loss_vec[0] = loss_sum
    return pd.DataFrame({"kind": kind_out + ["l"], "entity": [str(e) for e in ent_out] + [""],
                         "g": g_out + [loss_vec]})


def _triple_grads_np(kind: str, loss: str, margin: float, h, r, t, tn):
    if kind == "transe":
        ep, en = h + r - t, h + r - tn
        sp, sn = -(ep * ep).sum(1), -(en * en).sum(1)
    elif kind == "distmult":
        sp, sn = (h * r * t).sum(1), (h * r * tn).sum(1)
    elif kind == "inner":
        hr = h + r
        sp, sn = (hr * t).sum(1), (hr * tn).sum(1)
    else:
        raise ValueError(kind)
    if loss == "margin":
        z = margin - sp + sn
        w, lv = (z > 0).astype(np.float64), np.maximum(z, 0.0)
    elif loss == "logistic":
        w, lv = 1.0 / (1.0 + np.exp(np.clip(sp - sn, -700, 700))), np.logaddexp(0.0, sn - sp)
    else:
        raise ValueError(loss)
    w = w[:, None]
    if kind == "transe":
        gh = 2.0 * (ep - en) * w
        return gh, gh, -2.0 * ep * w, 2.0 * en * w, lv
    if kind == "distmult":
        return (r * tn - r * t) * w, (h * tn - h * t) * w, -(h * r) * w, (h * r) * w, lv
    d, hr = tn - t, h + r
    return d * w, d * w, -hr * w, hr * w, lv

# ---- BPR ----------------------------------------------------------------------------------------

def bpr_samples(train: DataFrame, items: DataFrame, epoch: int) -> DataFrame:
    """One (user, pos, neg) for every positive interaction; neg is the catalogue item at position
    (31*u + 17*pos_idx + 7919*epoch) mod n_items of the sorted catalogue, or the next one that the user never
    interacted with.  Output ``(user_id, pos_item, neg_item)``."""
    from kgrec.operators.graph import redraw_slots
    idx = _checkpoint(dense_index(items.select("item_id"), "item_id", "idx"))
    n = idx.agg(F.count(F.lit(1)).alias("n"))
    pos = train.filter(F.col("rating") == 1).select("user_id", F.col("item_id").alias("pos_item"))
    pos = pos.join(idx.select(F.col("item_id").alias("pos_item"), F.col("idx").alias("pidx")), "pos_item")
    base = 31 * F.col("user_id") + 17 * F.col("pidx") + F.lit(7919 * epoch)
    rows = _checkpoint(pos.select("user_id", "pos_item", base.alias("base"), F.monotonically_increasing_id().alias("row")))
    slots = idx.select(F.col("idx").alias("slot"), F.col("item_id").alias("neg"))
    seen = train.select("user_id", F.col("item_id").alias("neg"))
    return redraw_slots(rows, slots, seen, ["user_id"], n).select("user_id", "pos_item", F.col("neg").alias("neg_item"))


@dataclass
class TrainResult:
    vectors: DataFrame
    relations: DataFrame | None = None
    losses: list[float] = field(default_factory=list)


VECTOR_BROADCAST_BYTES = 256 << 20


def sized_for_broadcast(vecs: DataFrame, dim: int = DIM) -> DataFrame:
    """``vecs`` wrapped in a broadcast hint when its measured size fits the limit, else unchanged.

    The size is checked, not assumed: rows are counted (the table is a checkpoint, so this is cheap)
    and multiplied by the row width.  Above ``spark.kgrec.vectorBroadcastBytes`` the joins stay
    shuffle joins.
    """
    limit = int(vecs.sparkSession.conf.get("spark.kgrec.vectorBroadcastBytes", str(VECTOR_BROADCAST_BYTES)))
    est = vecs.count() * (dim * 8 + 96)
    return F.broadcast(vecs) if est <= limit else vecs


def _with_vecs(samples: DataFrame, vecs: DataFrame, slots: dict[str, str]) -> DataFrame:
    vecs = sized_for_broadcast(vecs)
    out = samples
    for slot, col in slots.items():
        out = out.join(vecs.select(F.col("entity").alias(col), F.col("vec").alias(slot)), col)
    return out


def bpr_epoch(vecs: DataFrame, samples: DataFrame, lr: float, reg: float, dim: int = DIM):
    """One full-batch BPR step on ``samples(user_id, pos_item, neg_item)``; returns (new vectors, loss frame)."""
    named = samples.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("uk"),
                           F.concat(F.lit("item"), F.col("pos_item").cast("string")).alias("pk"),
                           F.concat(F.lit("item"), F.col("neg_item").cast("string")).alias("nk"))
    return bpr_step(vecs, named, lr, reg, dim)


def bpr_step(vecs: DataFrame, samples: DataFrame, lr: float, reg: float, dim: int = DIM):
    """One full-batch BPR step on entity names ``samples(uk, pk, nk)``; returns (new vectors, loss frame)."""
    s = _with_vecs(samples, vecs, {"u": "uk", "p": "pk", "n": "nk"})

    def grads(it):
        for pdf in it:
            if pdf.empty:
                continue
            u, p, n = _stack(pdf["u"]), _stack(pdf["p"]), _stack(pdf["n"])
            x = (u * (p - n)).sum(1)
            gf = (-1.0 / (1.0 + np.exp(np.clip(x, -700, 700))))[:, None]
            gu, gp, gn = gf * (p - n) + reg * u, gf * u + reg * p, -gf * u + reg * n
            yield _presum(["e", "e", "e"], [pdf["uk"].to_numpy(), pdf["pk"].to_numpy(), pdf["nk"].to_numpy()],
                          [gu, gp, gn], float(np.logaddexp(0.0, -x).sum()), dim)

    g = s.select("uk", "pk", "nk", "u", "p", "n").mapInPandas(grads, GRAD_SCHEMA)
    gsum = _checkpoint(_sum_by_key(g, dim))
    n = max(samples.count(), 1)
    new = _apply(vecs, gsum.filter(F.col("kind") == "e").drop("kind"), lr, n)
    loss = gsum.filter(F.col("kind") == "l").select((F.col("g")[0] / F.lit(float(n))).alias("loss"))
    return new, loss


def bpr_train(train: DataFrame, items: DataFrame, epochs: int = 3, lr: float = 0.5, reg: float = 1e-4,
              seed: int = 42, dim: int = DIM) -> TrainResult:
    keys = (train.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("entity"))
            .unionByName(items.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("entity"))))
    vecs = _checkpoint(init_vectors(keys, seed=seed, dim=dim))
    losses = []
    for epoch in range(epochs):
        samples = _checkpoint(bpr_samples(train, items, epoch))
        vecs_new, loss = bpr_epoch(vecs, samples, lr, reg, dim)
        losses.append(float(loss.collect()[0]["loss"] or 0.0))
        vecs = _checkpoint(vecs_new)
    return TrainResult(vecs, None, losses)


# ---- triple models: TransE / DistMult / inner product --------------------------------------------

def triple_score(h: Column, r: Column, t: Column, kind: str) -> Column:
    if kind == "transe":
        return -sqnorm(vsub(vadd(h, r), t))
    if kind == "distmult":
        return F.aggregate(vmul(vmul(h, r), t), F.lit(0.0), lambda acc, x: acc + x)
    if kind == "inner":
        return dot(vadd(h, r), t)
    raise ValueError(kind)


def triple_epoch(ents: DataFrame, rels: DataFrame, samples: DataFrame, kind: str, loss: str, lr: float,
                 margin: float = 1.0, dim: int = DIM):
    """One full-batch step on ``samples(head, relation, tail, neg_tail)``; returns (ents, rels, loss frame)."""
    s = _with_vecs(samples, ents, {"h": "head", "t": "tail", "tn": "neg_tail"})
    s = s.join(sized_for_broadcast(rels).select(F.col("entity").alias("relation"), F.col("vec").alias("r")),
               "relation")

    def grads(it):
        for pdf in it:
            if pdf.empty:
                continue
            h, r, t, tn = _stack(pdf["h"]), _stack(pdf["r"]), _stack(pdf["t"]), _stack(pdf["tn"])
            gh, gr, gt, gtn, lv = _triple_grads_np(kind, loss, margin, h, r, t, tn)
            yield _presum(["e", "e", "e", "r"],
                          [pdf["head"].to_numpy(), pdf["tail"].to_numpy(), pdf["neg_tail"].to_numpy(),
                           pdf["relation"].to_numpy()], [gh, gt, gtn, gr], float(lv.sum()), dim)

    g = s.select("head", "relation", "tail", "neg_tail", "h", "r", "t", "tn").mapInPandas(grads, GRAD_SCHEMA)
    # entity-sized result: entity and relation updates and the loss all read this one table
    gsum = _checkpoint(_sum_by_key(g, dim))
    n = max(samples.count(), 1)
    return (_apply(ents, gsum.filter(F.col("kind") == "e").drop("kind"), lr, n),
            _apply(rels, gsum.filter(F.col("kind") == "r").drop("kind"), lr, n),
            gsum.filter(F.col("kind") == "l").select((F.col("g")[0] / F.lit(float(n))).alias("loss")))


def corrupt_tails(triples: DataFrame, vocab: DataFrame, epoch: int) -> DataFrame:
    from kgrec.operators.graph import negative_samples
    return negative_samples(triples, vocab, epoch)


def triple_train(triples: DataFrame, kind: str = "transe", loss: str = "margin", epochs: int = 3,
                 lr: float = 0.1, margin: float = 1.0, seed: int = 42, dim: int = DIM) -> TrainResult:
    """Train entity and relation vectors on ``triples(head, relation, tail)`` (CFKG, KGE)."""
    from kgrec.operators.graph import kg_vocab
    vocab = _checkpoint(kg_vocab(triples))
    ents = _checkpoint(init_vectors(vocab.filter(F.col("kind") == "entity").select(F.col("name").alias("entity")),
                                    seed=seed, dim=dim))
    rels = _checkpoint(init_vectors(vocab.filter(F.col("kind") == "relation").select(F.col("name").alias("entity")),
                                    seed=seed + 1, dim=dim))
    losses = []
    for epoch in range(epochs):
        samples = _checkpoint(corrupt_tails(triples, vocab, epoch))
        e2, r2, lf = triple_epoch(ents, rels, samples, kind, loss, lr, margin, dim)
        losses.append(float(lf.collect()[0]["loss"] or 0.0))
        ents, rels = _checkpoint(e2), _checkpoint(r2)
    return TrainResult(ents, rels, losses)


# ---- link-prediction evaluation -----------------------------------------------------------------

ENTITY_BLOCK = 4096   # entities of a packed block
TEST_CHUNK = 4096      # test triples of a packed chunk: a task scores TEST_CHUNK x ENTITY_BLOCK cells at a time
TIE = 1e-9            # scores nearer than TIE * (1 + |score|) count as equal, among candidates and known tails alike


def _query_vector(h: Column, r: Column, kind: str) -> Column:
    """The vector q that ranks entities e: by q . e (distmult, inner) or by -||q - e||^2 (transe)."""
    return vmul(h, r) if kind == "distmult" else vadd(h, r)


def rank_eval(test: DataFrame, known: DataFrame, ents: DataFrame, rels: DataFrame, kind: str,
              block: int = ENTITY_BLOCK, chunk: int = TEST_CHUNK) -> DataFrame:
    """Filtered tail ranking of held-out triples against every entity (E8); pass inverse triples to rank heads.

    rank = 1 + #{e : score(h, r, e) > score(h, r, t)} - #{known tails t' of (h, r) scoring higher}; ``known`` holds all
    true triples (train and test), and the row's own tail never scores higher than itself.  Entities are packed into
    blocks and test rows into chunks; every (chunk, block) pair is one row that a task scores with one matrix product, so
    nothing entity-sized meets the driver.  Output: one row with MR, MRR, Hits@1/3/10 and the count.
    """
    q = (test.select("head", "relation", "tail").distinct()
         .join(ents.select(F.col("entity").alias("head"), F.col("vec").alias("h")), "head")
         .join(ents.select(F.col("entity").alias("tail"), F.col("vec").alias("t")), "tail")
         .join(rels.select(F.col("entity").alias("relation"), F.col("vec").alias("r")), "relation"))
    s_true = triple_score(F.col("h"), F.col("r"), F.col("t"), kind)
    q = _checkpoint(q.select("head", "relation", "h", "r", s_true.alias("s_true"),
                             _query_vector(F.col("h"), F.col("r"), kind).alias("q"), F.monotonically_increasing_id().alias("row")))
    n_blocks, n_chunks = (max(1, -(-df.count() // size)) for df, size in ((ents, block), (q, chunk)))
    blocks = (ents.groupBy(F.pmod(F.xxhash64("entity"), F.lit(n_blocks)).alias("block"))
              .agg(F.collect_list("vec").alias("e")))
    chunks = (q.groupBy(F.pmod(F.xxhash64("row"), F.lit(n_chunks)).alias("chunk"))
              .agg(F.collect_list(F.struct("row", "q", "s_true")).alias("c")))
    # every chunk meets every block in a task that reads both where they are written: neither is copied for the other
    chunks, blocks = _checkpoint(chunks.select("c")), _checkpoint(blocks.select("e"))
    pairs = (chunks.crossJoin(blocks.hint("shuffle_replicate_nl"))
             .select(F.col("c.row").alias("row"), F.col("c.q").alias("q"), F.col("c.s_true").alias("s_true"), "e"))
    tie = TIE

    def count_higher(it):
        for batch in it:
            rows, higher = [], []
            for k in range(batch.num_rows):
                row, qs, st, e = (batch.column(c)[k].values for c in range(4))
                st = st.to_numpy()
                a = qs.flatten().to_numpy().reshape(len(st), -1)
                m = e.flatten().to_numpy().reshape(len(e), -1)
                sc = a @ m.T
                if kind == "transe":   # -||a - e||^2 = -(|a|^2 - 2 a.e + |e|^2)
                    sc = 2.0 * sc - (a * a).sum(axis=1)[:, None] - (m * m).sum(axis=1)[None, :]
                rows.append(row.to_numpy())
                higher.append((sc > (st + tie * (1.0 + np.abs(st)))[:, None]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(higher).astype(np.int64))],
                                             ["row", "n_higher"])

    raw = pairs.mapInArrow(count_higher, "row bigint, n_higher bigint").groupBy("row").agg(F.sum("n_higher").alias("n_higher"))
    # Known tails that outscore a test row: known scores and the rows' limits of one (h, r) in one order; for each row the running
    # count of known scores strictly above its limit, over as many tasks as a hot (h, r) needs.  No pairs are formed.
    kt = (known.select("head", "relation", F.col("tail").alias("other")).distinct()
          .join(ents.select(F.col("entity").alias("other"), F.col("vec").alias("o")), "other")
          .join(q.select("head", "relation", "h", "r").dropDuplicates(["head", "relation"]), ["head", "relation"]))
    known_scores = kt.select("head", "relation", F.lit(None).cast("bigint").alias("row"),
                             triple_score(F.col("h"), F.col("r"), F.col("o"), kind).alias("sc"), F.lit(1).alias("is_known"))
    limit = F.col("s_true") + F.lit(tie) * (F.lit(1.0) + F.abs("s_true"))
    limits = q.select("head", "relation", "row", limit.alias("sc"), F.lit(0).alias("is_known"))
    merged = running_sum(known_scores.unionByName(limits), ["head", "relation"], [F.col("sc").desc(), F.col("is_known").asc()], "is_known", "n_known")
    ranks = (raw.join(merged.filter(F.col("is_known") == 0).select("row", "n_known"), "row")
             .select((F.lit(1) + F.greatest(F.col("n_higher") - F.col("n_known"), F.lit(0))).alias("rank")))
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("mr"), F.avg(1.0 / F.col("rank")).alias("mrr"),
                     *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in (1, 3, 10)])
