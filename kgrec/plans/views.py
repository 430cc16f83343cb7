"""Shared Spark-side building blocks for the registered queries (mirrors ``plans.sqlviews``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgrec.functions.keymaps import BOOK_ITEM_KEYS, BOOK_USER_KEYS
from kgrec.operators import graph, triples
from kgrec.operators.metrics import item_popularity, item_stats as _item_stats
from kgrec.operators.vectors import dot
from kgrec.sources import tables as T

SCORE_DIGITS = 9


def train(spark: SparkSession, d: str) -> DataFrame:
    return T.fold(spark, d, "train")


def test(spark: SparkSession, d: str) -> DataFrame:
    return T.fold(spark, d, "test")


def item_stats(spark: SparkSession, d: str) -> DataFrame:
    """Train statistics per item (popularity, popular-head flag), a stage output."""
    return T.materialized(spark, d, "item_stats", lambda s, dd: _item_stats(train(s, dd)))


def item_uris(spark: SparkSession, d: str) -> DataFrame:
    return T.items(spark, d).select("item_id", T.item_entity(F.col("name")).alias("uri"))


def pop_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Model 'pop': score of a test pair = distinct train users of the item."""
    pop = item_popularity(train(spark, d)).select("item_id", "n_users")
    return test(spark, d).join(pop, "item_id", "left").select(
        F.lit("pop").alias("model"), "user_id", "item_id",
        F.coalesce(F.col("n_users"), F.lit(0)).cast("double").alias("score"))


def dot_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Model 'dot': score of a test pair = user vector . item vector (0 when either is missing)."""
    vec = T.vectors(spark, d)
    t = (test(spark, d).join(item_uris(spark, d), "item_id", "left")
         .select("user_id", "item_id", T.user_entity(F.col("user_id")).alias("ue"), F.col("uri").alias("ie")))
    j = (t.join(vec.select(F.col("entity").alias("ue"), F.col("vec").alias("u")), "ue", "left")
         .join(vec.select(F.col("entity").alias("ie"), F.col("vec").alias("v")), "ie", "left"))
    return j.select(F.lit("dot").alias("model"), "user_id", "item_id",
                    F.round(F.coalesce(dot(F.col("u"), F.col("v")), F.lit(0.0)), SCORE_DIGITS).alias("score"))


def build_predictions(spark: SparkSession, d: str) -> DataFrame:
    return pop_predictions(spark, d).unionByName(dot_predictions(spark, d))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Test-pair predictions of every model (R5): ``(model, user_id, item_id, score)``, a stage output."""
    return T.materialized(spark, d, "predictions", build_predictions, ["model"]).select(
        "model", "user_id", "item_id", "score")


# ---- knowledge graph sources -------------------------------------------------------------------

def cf_graph(spark: SparkSession, d: str) -> DataFrame:
    tr = train(spark, d).join(item_uris(spark, d), "item_id")
    return graph.cf_triples(tr, T.user_entity(F.col("user_id")), F.col("uri"))


def catalog_graph(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue facts standing in for the linked-open-data graph."""
    part = T.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    part = part.join(item_uris(spark, d), part.p_partkey == F.col("item_id"))
    cust = T.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nat = T.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    u = T.user_entity(F.col("c_custkey"))
    parts = [
        part.select(F.col("uri").alias("head"), F.lit("brand").alias("relation"),
                    F.concat(F.lit("brand/"), "p_brand").alias("tail")),
        part.select(F.col("uri").alias("head"), F.lit("type").alias("relation"),
                    F.concat(F.lit("type/"), "p_type").alias("tail")),
        cust.select(u.alias("head"), F.lit("nation").alias("relation"),
                    F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("tail")),
        cust.select(u.alias("head"), F.lit("segment").alias("relation"),
                    F.concat(F.lit("segment/"), "c_mktsegment").alias("tail")),
        nat.select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("head"),
                   F.lit("region").alias("relation"),
                   F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("tail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def llm_item_graph(spark: SparkSession, d: str) -> DataFrame:
    props = triples.parse_properties(T.item_completions(spark, d))
    norm = triples.normalize_features(props, triples.key_map_frame(spark, BOOK_ITEM_KEYS))
    heads = item_uris(spark, d).select(F.col("item_id").alias("entity_id"), F.col("uri").alias("head"))
    return triples.build_triples(norm, heads, drop_blank=False)


def llm_user_graph(spark: SparkSession, d: str) -> DataFrame:
    props = triples.parse_properties(T.user_completions(spark, d))
    norm = triples.normalize_features(props, triples.key_map_frame(spark, BOOK_USER_KEYS))
    heads = T.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"),
                                                 T.user_entity(F.col("c_custkey")).alias("head"))
    return triples.build_triples(norm, heads, drop_blank=True)


def kg_sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"cf": cf_graph(spark, d), "dbpedia": catalog_graph(spark, d),
            "llm_user": llm_user_graph(spark, d), "llm_item": llm_item_graph(spark, d)}


def kg_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Distinct triples of every source with their source bitmask, a stage output."""
    return T.materialized(spark, d, "kg_tagged", lambda s, dd: graph.tag_sources(kg_sources(s, dd)))


def full_kg(spark: SparkSession, d: str) -> DataFrame:
    """The all-sources setting ``cf_dbpedia_llm_ui``, de-duplicated."""
    return kg_tagged(spark, d).select("head", "relation", "tail")
