"""Knowledge-graph operators: source graphs, settings (U2/U3), vocabularies (G1), inverse edges (G2),
test-triple filter (J14), leak check (U6), negative sampling (G5).

A setting is a set of source graphs.  Instead of materialising each setting's union separately,
``kg_settings`` de-duplicates every triple once with a bitmask of the sources it came from (one
shuffle, partial ``bit_or``), then fans out to the settings whose mask intersects it.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgrec.functions.frames import attach_scalars
from kgrec.operators.rank import dense_index

SOURCE_BITS = {"cf": 1, "dbpedia": 2, "llm_user": 4, "llm_item": 8}
LIKE, DISLIKE = "like", "dislike"
INVERSE_SUFFIX = "_inverse"


def setting_name(dbpedia: bool, llm_user: bool, llm_item: bool) -> str:
    """'cf' plus flags, e.g. ``cf_dbpedia_llm_ui`` for every source."""
    name = "cf"
    if dbpedia:
        name += "_dbpedia"
    if llm_user or llm_item:
        name += "_llm_" + ("u" if llm_user else "") + ("i" if llm_item else "")
    return name


def all_settings() -> list[tuple[str, int]]:
    """The eight settings: CF always, every on/off choice of the other three sources."""
    out = []
    for d, u, i in product([False, True], repeat=3):
        mask = SOURCE_BITS["cf"] | (SOURCE_BITS["dbpedia"] if d else 0) \
            | (SOURCE_BITS["llm_user"] if u else 0) | (SOURCE_BITS["llm_item"] if i else 0)
        out.append((setting_name(d, u, i), mask))
    return out


def cf_triples(ratings: DataFrame, user_head, item_tail) -> DataFrame:
    """Like / dislike edges from ratings: (user entity, like|dislike, item entity)."""
    return ratings.select(user_head.alias("head"),
                          F.when(F.col("rating") >= 1, F.lit(LIKE)).otherwise(F.lit(DISLIKE)).alias("relation"),
                          item_tail.alias("tail"))


def source_bits(names: list[str]) -> dict[str, int]:
    """Bit of each source: the standard ones, then one bit each for the others."""
    if len(set(names) - set(SOURCE_BITS)) > 31 - len(SOURCE_BITS):
        raise ValueError("more sources than an integer mask has bits")
    bits = {n: SOURCE_BITS[n] for n in names if n in SOURCE_BITS}
    for n in names:
        if n not in bits:
            bits[n] = 1 << (len(SOURCE_BITS) + sum(x not in SOURCE_BITS for x in bits))
    return bits


def tag_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Distinct triples with the bitmask of their sources: ``(head, relation, tail, mask)``.

    The four standard sources keep their bits; any other name (friends, genre, ...) takes the next free bit in the
    order given (``source_bits``).
    """
    bits = source_bits(list(sources))
    parts = [df.select("head", "relation", "tail", F.lit(bits[name]).alias("bit")) for name, df in sources.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("head", "relation", "tail").agg(F.bit_or("bit").alias("mask"))


def kg_settings(sources: dict[str, DataFrame], settings: list[tuple[str, int]] | None = None) -> DataFrame:
    """``(setting, head, relation, tail)``: for each setting, the union of its sources, de-duplicated."""
    return settings_from_tagged(tag_sources(sources), settings)


def settings_from_tagged(tagged: DataFrame, settings: list[tuple[str, int]] | None = None) -> DataFrame:
    """Fan tagged triples ``(head, relation, tail, mask)`` out to the settings whose mask they hit."""
    settings = settings or all_settings()
    arr = F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(m).alias("smask")) for n, m in settings])
    x = tagged.select("head", "relation", "tail", "mask", F.explode(arr).alias("s"))
    return x.filter((F.col("mask").bitwiseAND(F.col("s.smask"))) != 0).select(
        F.col("s.setting").alias("setting"), "head", "relation", "tail")


def kg_vocab(triples: DataFrame, kinds: tuple[str, ...] = ("entity", "relation")) -> DataFrame:
    """``(kind, name, id)``: dense 0-based ids of sorted entities (heads and tails) and relations.

    Indexing sorts and writes the names at once, so only the ``kinds`` asked for are indexed; a filter afterwards would come too late.
    """
    names = {"entity": triples.select(F.col("head").alias("name")).unionByName(triples.select(F.col("tail").alias("name"))),
             "relation": triples.select(F.col("relation").alias("name"))}
    parts = [dense_index(names[k], "name", "id").select(F.lit(k).alias("kind"), "name", "id") for k in kinds]
    return reduce(DataFrame.unionByName, parts)


def inverse_triples(triples: DataFrame) -> DataFrame:
    """Each edge plus its reverse with relation ``<rel>_inverse``."""
    inv = triples.select(F.col("tail").alias("head"), F.concat("relation", F.lit(INVERSE_SUFFIX)).alias("relation"),
                         F.col("head").alias("tail"))
    return triples.select("head", "relation", "tail").unionByName(inv)


def restrict_to_vocab(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test triples whose head, tail and relation all occur in the train graph."""
    ents = train.select(F.col("head").alias("e")).unionByName(train.select(F.col("tail").alias("e"))).distinct()
    rels = train.select("relation").distinct()
    return (test.join(ents.withColumnRenamed("e", "head"), "head", "left_semi")
            .join(ents.withColumnRenamed("e", "tail"), "tail", "left_semi")
            .join(rels, "relation", "left_semi")
            .select("head", "relation", "tail"))


def leak_pairs(kg_pairs: DataFrame, held_out: DataFrame) -> DataFrame:
    """(user, item) pairs present both in the KG's interaction edges and in valid/test."""
    return kg_pairs.select("user_id", "item_id").intersect(held_out.select("user_id", "item_id"))


PROBES = 64   # slots tried at once for the few positives whose first slot is a known triple


def redraw_slots(positives: DataFrame, slots: DataFrame, known: DataFrame, keys: list[str], n: DataFrame) -> DataFrame:
    """``positives`` with ``neg``: the first of slots base, base + 1, ... (mod n) that is no known positive.

    ``positives`` has ``row`` (unique), ``base`` and ``keys``; ``slots(slot, neg)`` names the ``n`` (one-row frame) slots;
    ``known(keys, neg)``.  Every positive keeps its row; only one for which all slots are known has no negative and goes.
    First slots are tried for all rows at once, further ones only for rows that still need one.
    """
    from kgrec.operators.training import written
    known = known.select(*keys, "neg").distinct()
    total = int(n.collect()[0][0])
    if not total:
        return positives.withColumn("neg", F.lit(None).cast(slots.schema["neg"].dataType)).limit(0)
    # the first slot of every row: one pass marks which rows are settled and is written once
    at = attach_scalars(positives, n.toDF("n_slots")).withColumn("at", F.pmod(F.col("base"), F.col("n_slots")))
    tried_once = written(
        at.join(slots.select(F.col("slot").alias("at"), "neg", F.lit(True).alias("is_slot")), "at", "left")
        .join(known.withColumn("is_known", F.lit(True)), [*keys, "neg"], "left")
        .select(*positives.columns, "neg", "at", "n_slots", (F.col("is_slot").isNotNull() & F.col("is_known").isNull()).alias("free")), "first-slots")
    done = tried_once.filter("free").select(*positives.columns, "neg")
    todo = tried_once.filter("not free").select(*positives.columns, "at", "n_slots")
    tried = 1
    while tried < total and not todo.isEmpty():
        width = min(PROBES, total - tried)
        steps = todo.withColumn("step", F.explode(F.sequence(F.lit(tried), F.lit(tried + width - 1))))
        cand = steps.withColumn("slot", F.pmod(F.col("at") + F.col("step"), F.col("n_slots"))).join(slots, "slot").join(
            known, [*keys, "neg"], "left_anti")
        hit = cand.groupBy("row").agg(F.min_by("neg", "step").alias("neg"))
        found = todo.join(hit, "row").select(*positives.columns, "neg").checkpoint(eager=True)
        done = done.unionByName(found)
        todo = todo.join(found.select("row"), "row", "left_anti").checkpoint(eager=True)
        tried += width
    return done


def negative_samples(triples: DataFrame, vocab: DataFrame, epoch: int) -> DataFrame:
    """Tail-corrupted negatives, exactly one per positive and epoch.

    neg_id = (31*h + 17*r + 13*t + 7919*epoch) mod n_entities, a modular hash of the dense ids, so the sample is the
    same on any partitioning and reproducible in SQL; a slot that makes a known triple moves on to the next id.
    Output ``(head, relation, tail, neg_tail)``.
    """
    from kgrec.operators.training import written
    ents = vocab.filter(F.col("kind") == "entity").select("name", "id")
    rels = vocab.filter(F.col("kind") == "relation").select("name", "id")
    n = ents.agg(F.count(F.lit(1)).alias("n"))
    t = (triples.join(ents.select(F.col("name").alias("head"), F.col("id").alias("h")), "head")
         .join(rels.select(F.col("name").alias("relation"), F.col("id").alias("r")), "relation")
         .join(ents.select(F.col("name").alias("tail"), F.col("id").alias("t")), "tail"))
    base = 31 * F.col("h") + 17 * F.col("r") + 13 * F.col("t") + F.lit(7919 * epoch)
    rows = written(t.select("head", "relation", "tail", base.alias("base"), F.monotonically_increasing_id().alias("row")), "positives")
    known = triples.select("head", "relation", F.col("tail").alias("neg"))
    slots = ents.select(F.col("id").alias("slot"), F.col("name").alias("neg"))
    return redraw_slots(rows, slots, known, ["head", "relation"], n).select("head", "relation", "tail", F.col("neg").alias("neg_tail"))
