"""Vector operators: stats (A6), coverage (A7), join with imputation (J4/G6/G7), missing entities (J5),
dot score (R6), pair features (J8), TransE score (R12), graph propagation (G3, R11).

Vectors are ``array<double>`` columns.  Per-vector math stays in Catalyst higher-order functions
(``zip_with`` / ``aggregate``), evaluated in the JVM element by element; no Python.  Neighbour sums use one
``sum(w * vec[d])`` aggregate per dimension, so propagation is a join plus a partial aggregate with no
row explosion and no array collection per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgrec.functions.frames import attach_scalars

DIM = 64


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def vsumsq(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def l2(v: Column) -> Column:
    return F.sqrt(vsumsq(v))


def embedding_stats(vecs: DataFrame) -> DataFrame:
    """Mean and population std over every cell of every vector (A6), without exploding cells."""
    per_row = vecs.select(F.size("vec").alias("n"), vsum(F.col("vec")).alias("s"), vsumsq(F.col("vec")).alias("q"))
    tot = per_row.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return tot.select(F.col("n").cast("bigint").alias("n_cells"), mean.alias("mean"),
                      F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def _unit_hash(entity: Column, d: Column, seed: int, salt: int) -> Column:
    """Deterministic uniform in (0, 1) from (entity, dim, seed): independent of partitioning."""
    h = F.md5(F.concat_ws("|", entity, d.cast("string"), F.lit(str(seed)), F.lit(str(salt))).cast("binary"))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 48))


def hashed_normal(entity: Column, d: Column, seed: int) -> Column:
    """Box-Muller standard normal keyed by (entity, d, seed)."""
    u1 = _unit_hash(entity, d, seed, 1)
    u2 = _unit_hash(entity, d, seed, 2)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def for_draws(keys: DataFrame, key_col: str) -> DataFrame:
    """``keys`` over as many tasks as cores allow: a draw of a vector is much work for few bytes, by which few tasks would make all."""
    spark = keys.sparkSession
    return keys.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key_col)


def impute_vectors(entities: DataFrame, vecs: DataFrame, seed: int = 42, dim: int = DIM) -> DataFrame:
    """Left join entities to vectors; unknown entities get N(mean, std) per cell.

    mean/std come from ``embedding_stats`` (one row, broadcast).  The draw depends only on
    (entity, dim, seed), so it is the same under any partitioning or retry.
    Output ``(entity, vec, imputed)``.
    """
    stats = embedding_stats(vecs).select("mean", "std")
    joined = attach_scalars(for_draws(entities.select("entity").distinct(), "entity").join(vecs, "entity", "left"), stats)
    draw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda d: F.col("mean") + F.col("std") * hashed_normal(F.col("entity"), d, seed))
    return joined.select("entity", F.coalesce(F.col("vec"), draw).alias("vec"),
                         F.col("vec").isNull().alias("imputed"))


def coverage(entities: DataFrame, vecs: DataFrame) -> DataFrame:
    """Covered / missing counts per entity kind (A7).  ``entities(kind, entity)``."""
    has = vecs.select("entity", F.lit(1).alias("has"))
    j = entities.select("kind", "entity").distinct().join(has, "entity", "left")
    return j.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.count("has").alias("n_covered"),
        F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).cast("bigint").alias("n_missing"))


def missing_entities(entities: DataFrame, vecs: DataFrame) -> DataFrame:
    """Distinct entities with no vector."""
    return entities.select("entity").distinct().join(vecs.select("entity"), "entity", "left_anti")


def pair_vectors(pairs: DataFrame, uvec: DataFrame, ivec: DataFrame) -> DataFrame:
    """pairs(user_entity, item_entity, ...) joined with both vectors."""
    return (pairs.join(uvec.select(F.col("entity").alias("user_entity"), F.col("vec").alias("u")), "user_entity")
            .join(ivec.select(F.col("entity").alias("item_entity"), F.col("vec").alias("v")), "item_entity"))


def pair_norms(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """``pair_vectors`` with the norms ``u_norm`` and ``v_norm``, which are worked out once an entity: a pair travels with two numbers, not with its vectors."""
    norms = vecs.select("entity", F.array(l2(F.col("vec"))).alias("vec"))
    return pair_vectors(pairs, norms, norms).withColumns({"u_norm": F.col("u")[0], "v_norm": F.col("v")[0]}).drop("u", "v")


def relation_translation(edges: DataFrame, vecs: DataFrame, dim: int = DIM) -> DataFrame:
    """TransE-style translation per relation: mean(tail vec) - mean(head vec) over its edges.

    edges(head, relation, tail).  One aggregate per dimension; output ``(relation, r)``.
    """
    j = (edges.join(vecs.select(F.col("entity").alias("head"), F.col("vec").alias("hv")), "head")
         .join(vecs.select(F.col("entity").alias("tail"), F.col("vec").alias("tv")), "tail"))
    aggs = [F.avg(F.col("tv")[d] - F.col("hv")[d]).alias(f"_d{d}") for d in range(dim)]
    a = j.groupBy("relation").agg(*aggs)
    return a.select("relation", F.array(*[F.col(f"_d{d}") for d in range(dim)]).alias("r"))


def transe_distance(h: Column, r: Column, t: Column) -> Column:
    """-||h + r - t||_2."""
    diff = F.zip_with(F.zip_with(h, r, lambda a, b: a + b), t, lambda a, b: a - b)
    return -F.sqrt(vsumsq(diff))


def propagate(edges: DataFrame, vecs: DataFrame, dim: int = DIM) -> DataFrame:
    """One propagation step: out(dst) = sum over edges (src -> dst) of w * vec(src).

    edges(src, dst, w), vecs(entity, vec).  The per-dimension sums are partial aggregates, so a hub
    destination holding a third of all edges is combined map-side.
    """
    j = edges.join(vecs.select(F.col("entity").alias("src"), "vec"), "src")
    aggs = [F.sum(F.col("w") * F.col("vec")[d]).alias(f"_d{d}") for d in range(dim)]
    a = j.groupBy("dst").agg(*aggs)
    return a.select(F.col("dst").alias("entity"), F.array(*[F.col(f"_d{d}") for d in range(dim)]).alias("vec"))


def symmetric_norm_edges(pairs: DataFrame, a: str, b: str, sources: DataFrame | None = None) -> DataFrame:
    """Undirected bipartite edges both ways with weight 1/sqrt(deg(a) deg(b)) (LightGCN, R11).

    All edges are shuffled twice: by ``dst``, where they become distinct, are counted and get the degree of ``dst``, then by
    ``src``, where the degrees, already there by name, are joined and where ``propagate`` needs them.  The set is symmetric,
    so edges into a node are as many as edges out of it.  ``sources(entity)`` keeps the edges out of these only, degrees
    still counting all; few sources are broadcast and spare the second shuffle.
    """
    e = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = e.select(F.col("x").alias("src"), F.col("y").alias("dst")).unionByName(
        e.select(F.col("y").alias("src"), F.col("x").alias("dst"))).filter("dst is not null").repartition("dst").distinct()
    deg = both.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("deg"))
    # a window and not a join: filters on src would sink below a join, and the degrees could not reuse the first shuffle
    edges = both.withColumn("deg_dst", F.count(F.lit(1)).over(Window.partitionBy("dst")))
    if sources is not None:
        edges = edges.join(sources.select(F.col("entity").alias("src")), "src", "left_semi")
    return edges.join(deg, "src").select("src", "dst", (F.lit(1.0) / F.sqrt(F.col("deg") * F.col("deg_dst"))).alias("w"))


def layer_mean(edges: DataFrame, vecs: DataFrame, layers: int, dim: int = DIM,
               checkpoint_each: bool = True) -> DataFrame:
    """Mean of the layer-0..L propagated vectors (missing layers count as zero).

    Each layer is checkpointed to the shared checkpoint folder, so lineage stays one layer deep.
    """
    acc = vecs.select("entity", "vec")
    cur = acc
    outs = [acc]
    for _ in range(layers):
        cur = propagate(edges, cur, dim)
        if checkpoint_each:
            cur = cur.checkpoint(eager=True)
        outs.append(cur)
    stacked = outs[0]
    for o in outs[1:]:
        stacked = stacked.unionByName(o)
    aggs = [F.sum(F.col("vec")[d]).alias(f"_d{d}") for d in range(dim)]
    s = stacked.groupBy("entity").agg(*aggs)
    return s.select("entity", F.array(*[F.col(f"_d{d}") / F.lit(float(layers + 1)) for d in range(dim)]).alias("vec"))
