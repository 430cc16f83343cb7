"""Relation-aware graph convolution (G3): messages compose a neighbour's vector with its relation's vector.

One layer: ``out(e) = act(mean_in(e) W_in + mean_out(e) W_out + h(e) W_loop)``, where ``mean_in`` is the mean over triples
``(s, r, e)`` of ``comp(h(s), r)`` and ``mean_out`` the mean over triples ``(e, r, t)`` of ``comp(h(t), r)``.  The means are partial
aggregates over a join (a hub's edges are summed map-side); the weights act on the entity-sized sums, in numpy on Arrow
batches.  Layers are checkpointed, so lineage stays one layer deep.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgrec.operators.kernel import _checkpoint, sized_for_broadcast

COMPOSITIONS = {"sub": lambda h, r: h - r, "mult": lambda h, r: h * r, "add": lambda h, r: h + r}


def mean_messages(triples: DataFrame, vecs: DataFrame, rels: DataFrame, src: str, dst: str, comp: str, dim: int) -> DataFrame:
    """``(entity, m)``: mean over the triples into ``dst`` of the composed vector of ``src``; sources without a vector send none."""
    j = (triples.select(F.col(src).alias("src"), "relation", F.col(dst).alias("dst"))
         .join(vecs.select(F.col("entity").alias("src"), F.col("vec").alias("h")), "src")
         .join(sized_for_broadcast(rels, dim).select(F.col("entity").alias("relation"), F.col("vec").alias("r")), "relation"))
    f = COMPOSITIONS[comp]
    means = j.groupBy("dst").agg(*[F.avg(f(F.col("h")[d], F.col("r")[d])).alias(f"_m{d}") for d in range(dim)])
    return means.select(F.col("dst").alias("entity"), F.array(*[F.col(f"_m{d}") for d in range(dim)]).alias("m"))


def _or_zero(c: str, dim: int) -> Column:
    return F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), dim))


def compgcn_layer(triples: DataFrame, vecs: DataFrame, rels: DataFrame, w_in: np.ndarray, w_out: np.ndarray, w_loop: np.ndarray,
                  comp: str = "sub", activation: bool = True) -> DataFrame:
    """One layer's ``(entity, vec)`` for every entity with a vector or a message."""
    dim = len(w_loop)
    come = mean_messages(triples, vecs, rels, "head", "tail", comp, dim).withColumnRenamed("m", "a")
    go = mean_messages(triples, vecs, rels, "tail", "head", comp, dim).withColumnRenamed("m", "b")
    j = vecs.select("entity", "vec").join(come, "entity", "full").join(go, "entity", "full").select(
        "entity", *[_or_zero(c, dim).alias(c) for c in ("a", "b", "vec")])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            a, b, h = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("a", "b", "vec"))
            out = a @ w_in + b @ w_out + h @ w_loop
            out = np.tanh(out) if activation else out
            yield pa.RecordBatch.from_arrays([batch.column("entity"), pa.array(list(out), pa.list_(pa.float64()))], ["entity", "vec"])

    return j.mapInArrow(run, "entity string, vec array<double>")


def compgcn(triples: DataFrame, vecs: DataFrame, rels: DataFrame, weights: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
            rel_weights: list[np.ndarray] | None = None, comp: str = "sub") -> DataFrame:
    """One to three (or more) layers; ``weights`` has (in, out, loop) of each, ``rel_weights`` turns the relation vectors between layers."""
    for k, (w_in, w_out, w_loop) in enumerate(weights):
        vecs = _checkpoint(compgcn_layer(triples, vecs, rels, w_in, w_out, w_loop, comp))
        if rel_weights is not None and k + 1 < len(weights):
            w = rel_weights[k]
            cells = [sum((F.col("vec")[i] * float(w[i, o]) for i in range(len(w))), F.lit(0.0)) for o in range(w.shape[1])]
            rels = _checkpoint(rels.select("entity", F.array(*cells).alias("vec")))
    return vecs
