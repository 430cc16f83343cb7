"""Trained vector models on names: triple models (G4, R12), BPR (R10), LightGCN (R11) and the relation-aware convolution.

Each ``*_model`` turns names into dense ids once, trains with ``operators.training`` and gives names back.  Defaults are the
published ones: 15 epochs for graph embeddings, 50 for the pair models' baselines (a parameter), Adam.  With ``log_path`` an
interrupted run is taken up after its last committed epoch (``training.EpochLog``).

Each ``*_step`` is one plain gradient step from given vectors, with the same gradients.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgrec.operators import sliced as SL
from kgrec.operators import training as TR
from kgrec.operators.kernel import INIT_SCALE, TrainResult
from kgrec.operators.rank import dense_index
from kgrec.operators.vectors import DIM

KGE_EPOCHS = 15
PAIR_EPOCHS = 50
KGE_LR, PAIR_LR = 0.02, 0.02   # the batch of one step is a large part of the epoch, so steps are longer than the published 0.001


# --- ids ----------------------------------------------------------------------------------------------------

def _names(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, k) for k, n in enumerate(names)], "relation string, r bigint")


def with_ids(triples: DataFrame, index: DataFrame, relations: list[str]) -> DataFrame:
    """``(h, r, t)`` of ``(head, relation, tail)``; relation ids are places in the sorted vocabulary."""
    return (triples.select("head", "relation", "tail").join(F.broadcast(_names(triples.sparkSession, relations)), "relation")
            .join(index.select(F.col("entity").alias("head"), F.col("id").alias("h")), "head")
            .join(index.select(F.col("entity").alias("tail"), F.col("id").alias("t")), "tail").select("h", "r", "t"))


def relation_names(triples: DataFrame, dim: int = DIM) -> list[str]:
    """The sorted vocabulary of relations: a parameter of the model, checked against the size of what may be broadcast."""
    names = sorted(r[0] for r in triples.select("relation").distinct().limit(TR.RELATION_BYTES // (dim * 8) + 1).collect())
    if len(names) * dim * 8 > TR.RELATION_BYTES:
        raise ValueError("more relations than their vectors may take")
    return names


def _relation_rows(spark, names: list[str], vectors: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vectors, strict=True)], "entity string, vec array<double>")


def _named(index: DataFrame, rows: DataFrame) -> DataFrame:
    return index.join(rows.select("id", "vec"), "id").select("entity", "vec")


def _entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("head").alias("entity")).unionByName(triples.select(F.col("tail").alias("entity"))).distinct()


def _log(spark, path: str | None, **settings) -> TR.EpochLog | None:
    return TR.EpochLog(spark, path, settings) if path else None


# --- triple models ------------------------------------------------------------------------------------------

class TripleSamples:
    """Training triples by id and, for each epoch, one corrupted tail a triple that makes no known triple."""

    def __init__(self, triples: DataFrame, index: DataFrame, relations: list[str], n: int):
        self.ids, self.n = TR.written(with_ids(triples, index, relations).distinct(), "triples"), n
        self.rows = self.ids.count()
        self.blocked = TR.written(TR.next_free(self.ids.withColumnRenamed("t", "slot"), ["h", "r"], n), "blocked")

    def of(self, epoch: int | range) -> DataFrame:
        """An epoch's samples, or those of several with their ``epoch``."""
        return TR.corrupted(self.ids, self.blocked, ["h", "r"], "31 * h + 17 * r + 13 * t", self.n, epoch, "tn")

    def __call__(self, epoch: int) -> DataFrame:
        return TR.spread(self.of(epoch), self.rows, "h", "r", "t")


def triple_model(triples: DataFrame, kind: str = "distmult", loss: str = "logistic", epochs: int = KGE_EPOCHS, lr: float = KGE_LR,
                 margin: float = 1.0, seed: int = 42, dim: int = DIM, batch_rows: int = TR.BATCH_ROWS, log_path: str | None = None) -> TrainResult:
    """Entity and relation vectors of ``triples(head, relation, tail)``: TransE, DistMult or inner product."""
    spark, names = triples.sparkSession, relation_names(triples, dim)
    index, rows, n = TR.started(_entities(triples), dim, seed, INIT_SCALE)
    samples = TripleSamples(triples, index, names, n)

    def step(state: TR.State, batch: DataFrame):
        x = state.vectors()
        gradient, got = TR.collected(TR.triple_loss(batch, x, state.arrays["rel"], kind, loss, margin), x, {TR.RELATION: len(names), TR.LOSS: 1})
        x.free()
        return gradient, {"rel": got[TR.RELATION]}, got[TR.LOSS]

    state = TR.State(rows, n, dim, {"rel": TR.normal((len(names), dim), seed + 1, INIT_SCALE)})
    log = _log(spark, log_path, model=kind, loss=loss, lr=lr, margin=margin, seed=seed, dim=dim, batch_rows=batch_rows)
    separable = SL.Separable(kind, ("h", "r", "t", "tn"), ("r",), loss, margin)
    state = TR.run_epochs(state, step, samples, samples.rows, ["h", "r", "t"], epochs, lr, batch_rows, log, separable)
    return TrainResult(_named(index, state.rows), _relation_rows(spark, names, state.arrays["rel"]), state.losses)


# --- pair models --------------------------------------------------------------------------------------------

class PairSamples:
    """Positive pairs by id (items first, then users) and, for each epoch, one item a pair that its user never met."""

    def __init__(self, train: DataFrame, items: DataFrame):
        items = dense_index(items.select("item_id"), "item_id", "i")
        self.items = TR.written(items, "items")
        self.n_items = self.items.count()
        users = dense_index(train.select("user_id"), "user_id", "k").select("user_id", (F.col("k") + self.n_items).alias("u"))
        self.users = TR.written(users, "users")
        self.n = self.n_items + self.users.count()
        met = TR.written(train.join(self.items, "item_id").join(self.users, "user_id").select("u", "user_id", F.col("i").alias("slot"), "rating").distinct(), "met")
        self.pairs = met.filter("rating = 1").select("u", "user_id", F.col("slot").alias("p")).distinct()
        self.rows = self.pairs.count()
        self.blocked = TR.written(TR.next_free(met, ["u"], self.n_items), "blocked")

    def of(self, epoch: int | range) -> DataFrame:
        """An epoch's samples, or those of several with their ``epoch``."""
        return TR.corrupted(self.pairs, self.blocked, ["u"], "31 * user_id + 17 * p", self.n_items, epoch, "n")

    def __call__(self, epoch: int) -> DataFrame:
        return TR.spread(self.of(epoch), self.rows, "u", "p")

    def index(self) -> DataFrame:
        """``(entity, id)``: ``item<id>`` and ``user<id>``."""
        return (self.items.select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("entity"), F.col("i").alias("id"))
                .unionByName(self.users.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("entity"), F.col("u").alias("id"))))


def _pair_state(samples: PairSamples, seed: int, dim: int) -> tuple[DataFrame, TR.State]:
    from kgrec.operators.kernel import init_vectors
    index = TR.written(samples.index(), "index")
    zero = F.array_repeat(F.lit(0.0), dim)
    rows = init_vectors(index, seed=seed, dim=dim).join(index, "entity").select("id", "vec", zero.alias("m"), zero.alias("s"))
    return index, TR.State(TR.written(rows, "state"), samples.n, dim, {})


def symmetric_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of ``pairs(a, b)`` with weight 1 / sqrt(deg a * deg b): ``(src, dst, w)``."""
    from kgrec.operators.vectors import symmetric_norm_edges
    return symmetric_norm_edges(pairs, "a", "b")


def pair_gradient(edges: DataFrame | None, x: TR.Vectors, batch: DataFrame, layers: int, reg: float) -> tuple[TR.Vectors, np.ndarray]:
    """Gradient and loss row of BPR on the mean of x and its ``layers`` propagations (0: on x itself).

    The propagation is linear and its weights symmetric, so the gradient of x is the propagated mean of the gradient.
    """
    dim = x.dim
    top = TR.layer_mean(edges, x, layers) if layers else x
    width = 2 * dim if reg else dim
    sums, got = TR.collected(TR.pair_loss(batch, top, x, reg), x, {TR.LOSS: 1}, width)
    if layers:
        top.free()
    if x.fits:
        both = sums.matrix()
        main = TR.Vectors(None, x.n, dim, x.spark, both[:, :dim])
        out = TR.layer_mean(edges, main, layers).matrix() if layers else main.matrix()
        return TR.Vectors(None, x.n, dim, x.spark, out + both[:, dim:] if reg else out), got[TR.LOSS]
    main = TR.Vectors(sums.rows.select("id", F.slice("vec", 1, dim).alias("vec")), x.n, dim)
    back = TR.layer_mean(edges, main, layers) if layers else main
    out = back.rows
    if reg:
        own = sums.rows.select("id", F.slice("vec", dim + 1, dim).alias("own"))
        out = out.join(own, "id", "left").select(
            "id", F.when(F.col("own").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "own", lambda a, b: a + b)).alias("vec"))
    out = TR.written(out, "gradient")
    TR.dropped(sums.rows, *([top.rows, back.rows] if layers else []))
    return TR.Vectors(out, x.n, dim), got[TR.LOSS]


def _pair_model(train: DataFrame, items: DataFrame, layers: int, epochs: int, lr: float, reg: float, seed: int, dim: int, batch_rows: int,
                log_path: str | None) -> TrainResult:
    samples = PairSamples(train, items)
    index, state = _pair_state(samples, seed, dim)
    pairs = samples.pairs.select(F.col("u").alias("a"), F.col("p").alias("b"))
    sliced = state.mats is None and (not layers or 8 * samples.rows <= SL.PAIR_BYTES)
    separable = SL.Separable("pairs", ("u", "p", "n"), reg=reg, layers=layers, pairs=pairs) if sliced else None
    edges = TR.written(TR.spread(symmetric_edges(pairs), 2 * samples.rows, "src", "dst"), "edges") if layers and not sliced else None

    def step(state: TR.State, batch: DataFrame):
        x = state.vectors()
        gradient, loss = pair_gradient(edges, x, batch, layers, reg)
        x.free()
        return gradient, {}, loss

    log = _log(train.sparkSession, log_path, model="pairs", layers=layers, lr=lr, reg=reg, seed=seed, dim=dim, batch_rows=batch_rows)
    state = TR.run_epochs(state, step, samples, samples.rows, ["u", "p"], epochs, lr, batch_rows, log, separable)
    if state.tops is not None:
        return TrainResult(_named(index, state.tops), None, state.losses)
    x = state.vectors()
    final = TR.layer_mean(edges, x, layers) if layers else x
    return TrainResult(_named(index, final.rows), None, state.losses)


def bpr_model(train: DataFrame, items: DataFrame, epochs: int = PAIR_EPOCHS, lr: float = PAIR_LR, reg: float = 1e-4, seed: int = 42, dim: int = DIM,
              batch_rows: int = TR.BATCH_ROWS, log_path: str | None = None) -> TrainResult:
    """Matrix factorisation on pairs: ``(entity, vec)`` of ``item<id>`` and ``user<id>``."""
    return _pair_model(train, items, 0, epochs, lr, reg, seed, dim, batch_rows, log_path)


def lightgcn_model(train: DataFrame, items: DataFrame, layers: int = 2, epochs: int = PAIR_EPOCHS, lr: float = PAIR_LR, reg: float = 1e-4, seed: int = 42,
                   dim: int = DIM, batch_rows: int = TR.BATCH_ROWS, log_path: str | None = None) -> TrainResult:
    """The same loss on vectors propagated over the graph of positive pairs; the vectors given are the propagated ones."""
    return _pair_model(train, items, layers, epochs, lr, reg, seed, dim, batch_rows, log_path)


def lightgcn_step(pairs: DataFrame, vecs: DataFrame, samples: DataFrame, layers: int, lr: float, reg: float = 0.0, dim: int = DIM) -> DataFrame:
    """One gradient step on names: edges ``pairs(a, b)``, ``vecs(entity, vec)``, ``samples(u, p, n)``; mean gradient times ``lr`` is taken off."""
    names = vecs.select("entity").unionByName(pairs.select(F.col("a").alias("entity"))).unionByName(pairs.select(F.col("b").alias("entity")))
    index = TR.written(dense_index(names, "entity", "id"), "index")
    x = TR.Vectors(TR.written(vecs.join(index, "entity").select("id", "vec"), "given"), index.count(), dim)

    def ids(df: DataFrame, cols: list[str]) -> DataFrame:
        for c in cols:
            df = df.join(index.select(F.col("entity").alias(c), F.col("id").alias(f"{c}_id")), c).drop(c).withColumnRenamed(f"{c}_id", c)
        return df

    edges = TR.written(symmetric_edges(ids(pairs.select("a", "b").distinct(), ["a", "b"])), "edges")
    batch = TR.written(ids(samples.select("u", "p", "n"), ["u", "p", "n"]), "samples")
    gradient, _ = pair_gradient(edges, x, batch, layers, reg)
    return _stepped(index, x, gradient, lr / max(batch.count(), 1))


def _stepped(index: DataFrame, x: TR.Vectors, gradient: TR.Vectors, times: float) -> DataFrame:
    """x - times * gradient for every id of the index: ``(entity, vec)``."""
    zero = F.array_repeat(F.lit(0.0), x.dim)
    if gradient.fits:
        return _named(index, TR.Vectors(None, x.n, x.dim, x.spark, x.matrix() - times * gradient.matrix()).rows)
    g = gradient.rows.select("id", F.col("vec").alias("g"))
    both = index.select("id").join(x.rows.select("id", "vec"), "id", "left").join(g, "id", "left").select(
        "id", F.zip_with(F.coalesce("vec", zero), F.coalesce("g", zero), lambda v, g: v - times * g).alias("vec"))
    return _named(index, both)


# --- relation-aware convolution -----------------------------------------------------------------------------

def start_weights(layers: int, n_relations: int, dim: int, seed: int) -> dict[str, np.ndarray]:
    """Relation vectors; for each layer the three weights, near the identity for the loop, and the turn of the relations."""
    out = {"rel": TR.normal((n_relations, dim), seed + 1, INIT_SCALE)}
    scale = np.sqrt(1.0 / dim)
    for k in range(layers):
        for j, name in enumerate(("in", "out", "loop", "turn")):
            w = TR.normal((dim, dim), seed + 100 * (k + 1) + j, scale if name in ("in", "out") else 0.1 * scale)
            out[f"{name}{k}"] = w + (np.eye(dim) if name in ("loop", "turn") else 0.0)
    return out


def _layer_weights(arrays: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    return {name: arrays[f"{name}{k}"] for name in ("in", "out", "loop")}


def conv_forward(edges: DataFrame, x: TR.Vectors, arrays: dict[str, np.ndarray], layers: int, comp: str) -> tuple[list[TR.Layer], np.ndarray]:
    """All layers and the relation vectors after the last; the last layer has no activation."""
    done, rels = [], arrays["rel"]
    for k in range(layers):
        done.append(TR.convolved(edges, x, rels, _layer_weights(arrays, k), comp, k + 1 < layers))
        x, rels = done[-1].out, rels @ arrays[f"turn{k}"]
    return done, rels


def conv_gradient(edges: DataFrame, x: TR.Vectors, arrays: dict[str, np.ndarray], batch: DataFrame, layers: int, comp: str, kind: str, loss: str,
                  margin: float) -> tuple[TR.Vectors, dict[str, np.ndarray], np.ndarray]:
    """Gradients of the summed triple loss of ``batch(h, r, t, tn)`` after ``layers`` layers: of x, of the arrays; the loss row."""
    done, rels = conv_forward(edges, x, arrays, layers, comp)
    gradient, got = TR.collected(TR.triple_loss(batch, done[-1].out, rels, kind, loss, margin), x, {TR.RELATION: len(rels), TR.LOSS: 1})
    g_rel, out = got[TR.RELATION], {}
    for k in reversed(range(layers)):
        out[f"turn{k}"] = done[k].rels.T @ g_rel
        g_rel = g_rel @ arrays[f"turn{k}"].T
        below, before = done[k - 1].out if k else x, gradient
        gradient, composed, weights = TR.convolved_back(edges, done[k], below, _layer_weights(arrays, k), comp, k + 1 < layers, gradient)
        if not x.fits:
            TR.dropped(before.rows)
        g_rel = g_rel + composed
        out |= {f"{name}{k}": g for name, g in weights.items()}
    out["rel"] = g_rel
    for layer in done:
        layer.out.free()
        if layer.rows is not None:
            TR.dropped(layer.rows)
    return gradient, out, got[TR.LOSS]


def compgcn_model(triples: DataFrame, layers: int = 2, comp: str = "sub", kind: str = "distmult", loss: str = "logistic", epochs: int = KGE_EPOCHS,
                  lr: float = KGE_LR, margin: float = 1.0, seed: int = 42, dim: int = DIM, batch_rows: int = TR.BATCH_ROWS,
                  log_path: str | None = None) -> TrainResult:
    """Entity and relation vectors after ``layers`` trained convolution layers over ``triples`` (their reverse is a second message way)."""
    spark, names = triples.sparkSession, relation_names(triples, dim)
    index, rows, n = TR.started(_entities(triples), dim, seed, INIT_SCALE)
    samples = TripleSamples(triples, index, names, n)
    edges = TR.written(TR.spread(TR.mean_edges(samples.ids), 2 * samples.rows, "src", "dst"), "edges")

    def step(state: TR.State, batch: DataFrame):
        x = state.vectors()
        gradient, arrays, loss_row = conv_gradient(edges, x, state.arrays, batch, layers, comp, kind, loss, margin)
        x.free()
        return gradient, arrays, loss_row

    state = TR.State(rows, n, dim, start_weights(layers, len(names), dim, seed))
    log = _log(spark, log_path, model="compgcn", layers=layers, comp=comp, kind=kind, loss=loss, lr=lr, margin=margin, seed=seed, dim=dim, batch_rows=batch_rows)
    state = TR.run_epochs(state, step, samples, samples.rows, ["h", "r", "t"], epochs, lr, batch_rows, log)
    done, rels = conv_forward(edges, state.vectors(), state.arrays, layers, comp)
    return TrainResult(_named(index, done[-1].out.rows), _relation_rows(spark, names, rels), state.losses)


def compgcn_step(triples: DataFrame, vecs: DataFrame, relations: dict[str, np.ndarray], arrays: dict[str, np.ndarray], samples: DataFrame, layers: int, lr: float,
                 comp: str = "sub", kind: str = "inner", loss: str = "logistic", margin: float = 1.0, dim: int = DIM):
    """One gradient step on names from given vectors, relation vectors and weights; ``samples(head, relation, tail, neg_tail)``.

    Gives ``(entity, vec)`` and the moved arrays (``rel`` in the order of the sorted names); gradients are means over the samples.
    """
    index = TR.written(dense_index(vecs.select("entity").unionByName(_entities(triples)), "entity", "id"), "index")
    names = sorted(relations)
    arrays = arrays | {"rel": np.array([relations[r] for r in names], float)}
    x = TR.Vectors(TR.written(vecs.join(index, "entity").select("id", "vec"), "given"), index.count(), dim)
    edges = TR.written(TR.mean_edges(with_ids(triples, index, names)), "edges")
    neg = index.select(F.col("entity").alias("neg_tail"), F.col("id").alias("tn"))
    batch = (samples.join(F.broadcast(_names(triples.sparkSession, names)), "relation").join(index.select(F.col("entity").alias("head"), F.col("id").alias("h")), "head")
             .join(index.select(F.col("entity").alias("tail"), F.col("id").alias("t")), "tail").join(neg, "neg_tail").select("h", "r", "t", "tn"))
    batch = TR.written(batch, "samples")
    gradient, moved, _ = conv_gradient(edges, x, arrays, batch, layers, comp, kind, loss, margin)
    times = lr / max(batch.count(), 1)
    return _stepped(index, x, gradient, times), {name: w - times * moved[name] for name, w in arrays.items()}
