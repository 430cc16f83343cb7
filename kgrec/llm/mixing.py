"""Mixing sources to target weights by entropy balancing (operator 5).

``targets``  words each source shall give: weighted shares, capped at a multiple of the source's words.
``rates``    the document rates of largest entropy whose words meet each source's target.  With the token constraint
             ``sum(rate * size) = target`` and the bound ``rate <= cap`` they are ``min(cap, exp(lam * x))`` with one
             dual variable ``lam`` a source and ``x`` the size over the source's typical size.  The dual is convex; all
             sources take a bracketed Newton step in each round, and a round is one aggregation of the histogram of
             (source, size), which is all that the rates depend on.
``mix``      rates rounded into copies.  A document is taken ``floor(rate)`` times or once more.  From a source's longest
             size to its shortest, so many documents of a size get the copy more as bring the words taken nearest to the
             words that the rates give; what is left over passes on to the next size.  The words taken then
             miss the target by about half a short document, and no document is taken more than ``cap`` times.

Defined results: a null text has size 0; null is a source of its own, after all others; documents of size 0 have rate 1
and cost nothing; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from kgrec.llm.common import WORD, keyed_rows, ranked, row_hash, with_fields, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5          # words of the mix over words of the corpus
CAP = 2.0            # most copies of a document, and most words of a source over its size
TOLERANCE = 1e-7     # largest miss of a target, relative, at which Newton stops
ROUNDS = 60          # it raises beyond; bracketed steps halve the bracket at worst
SEED = 77
KEY = ["no_source", "source_name"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to the table of sources (``KEY``, ``source_size``).

    Sharing what exceeds a cap again by weight ends at one level: target = min(cap * size, weight * level).
    """
    order = W.orderBy(*KEY)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    named = totals.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), *KEY)
    before, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    budget = F.sum("source_size").over(everything) * share
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    levels = named.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    flat = levels.withColumn("flat", F.max(fits).over(everything))
    return flat.select(*KEY, "source_size", F.least("most", F.coalesce(F.col("weight") * F.col("flat"), F.col("most"))).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """Narrow rows of the corpus: id, source key, size and two hashes of the whole row."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").isNull().alias("no_source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_name"), word_count(F.col("text")).alias("size"),
        row_hash(docs).alias("h0"), row_hash(docs, 1).alias("h1"))


def _rate(cap: float) -> Column:
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))


def rates(sizes: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``(KEY, source_size, target, size, n, rate)`` for the histogram ``(KEY, size, n)``."""
    typical = sizes.groupBy(*KEY).agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.greatest(F.sum(F.col("n") * F.col("size")), F.lit(1))).alias("scale"))
    inf = F.lit(math.inf)
    state = written(goals.join(typical, KEY).select(
        *KEY, "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"),
        (F.col("target") >= cap * F.col("source_size")).alias("full"),
        F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)).alias("lam"),
        (-inf).alias("low"), inf.alias("high"), inf.alias("miss")), "mix-dual")
    for _ in range(rounds):
        rate, size, n = _rate(cap), F.col("size"), F.col("n")
        bend = F.when(rate < cap, rate * size * size / F.col("scale")).otherwise(0.0)
        here = sizes.join(state.select(*KEY, "scale", "full", "lam"), KEY).groupBy(*KEY).agg(
            F.sum(n * size * rate).alias("words"), F.sum(n * bend).alias("slope"))
        over = F.col("words") - F.col("target")
        step = F.when(F.col("slope") > 0, over / F.col("slope")).otherwise(F.signum(over))
        reach = F.greatest(F.lit(1.0), F.abs("lam"))
        low, high = F.when(over < 0, F.col("lam")).otherwise(F.col("low")), F.when(over > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.greatest(-reach, F.least(reach, step))
        inside = (newton > F.col("lower")) & (newton < F.col("upper"))
        miss = F.abs(over) / F.greatest(F.col("target"), F.lit(1.0))
        done = F.col("full") | (F.col("gap") <= tolerance)
        state = written(
            state.drop("miss").join(here, KEY).withColumns({"lower": low, "upper": high, "gap": miss})
            .select(*KEY, "source_size", "target", "scale", "full",
                    F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("lower") + F.col("upper")) / 2).alias("lam"),
                    F.col("lower").alias("low"), F.col("upper").alias("high"), F.when(F.col("full"), 0.0).otherwise(F.col("gap")).alias("miss")),
            "mix-dual")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= tolerance:
            return sizes.join(state, KEY).select(*KEY, "source_size", "target", "size", "n", _rate(cap).alias("rate"))
    raise RuntimeError(f"entropy balancing did not reach {tolerance} in {rounds} rounds")


def _round_source(sizes: pd.DataFrame) -> pd.DataFrame:
    """How many of the ``n`` documents of each size of a source get a copy more (a row for each size)."""
    sizes = sizes.sort_values("size", ascending=False)
    more, left = [], 0.0
    for size, n, rate in zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["rate"].tolist(), strict=True):
        spare = n * (rate - math.floor(rate))
        k = min(n, max(0, round(spare + left / size))) if size and spare else 0
        left += (spare - k) * size
        more.append(k)
    return sizes.assign(more=more)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``(doc_id, h0, h1, size, source_size, target, rate, copies)`` for every row."""
    rows = written(sized(docs), "mix-rows")
    sizes = written(rows.groupBy(*KEY, "size").agg(F.count("*").alias("n")), "mix-sizes")
    totals = sizes.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rated = rates(sizes, targets(totals, weights, share, cap), cap)
    schema = with_fields(rated.schema, more=T.LongType())
    counts = written(rated.groupBy(*KEY).applyInPandas(_round_source, schema), "mix-rates")
    # Which documents of a size get the copy more is a seeded draw by the whole row.
    numbered = ranked(rows, [*KEY, "size"], counts, F.xxhash64(F.lit(seed), "h0", "h1"),
                      [F.xxhash64(F.lit(seed + 1), "h0", "h1"), "doc_id"], "mix_rank", carry=["source_size", "target", "rate", "more"])
    copies = F.floor("rate").cast("bigint") + (F.col("mix_rank") < F.col("more")).cast("bigint")
    return numbered.select("doc_id", "h0", "h1", "size", "source_size", "target", "rate", copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix: rows of ``docs``, with all their columns, as often as they are taken."""
    taken = mix(docs, weights, share, cap, seed).groupBy("h0", "h1").agg(F.sum("copies").alias("mix_copies"))
    wanted = taken.filter("mix_copies > 0").select(F.struct("h0", "h1").alias("key"), "mix_copies")
    once = keyed_rows(docs).join(wanted, "key").dropDuplicates(["key"])  # equal rows are one row here, with all their copies
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy")).select("row.*")
