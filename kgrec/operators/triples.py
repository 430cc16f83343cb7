"""Completion parsing and triple building: B10-B16, J2-J3, A5.

parse_properties   completion text -> (entity_id, feature, values) with "last wins" per feature
normalize_features feature whitelist / synonyms through a key map (broadcast, it is a parameter of
                   a few dozen rows), values of synonymous keys unioned
build_triples      (head, llama_generated/<key>, llama_generated/<value with _>) de-duplicated by a
                   hash aggregate (the original is a quadratic list search)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgrec.functions.keymaps import GENERATED_PREFIX
from kgrec.functions.text import completion_lines, line_feature, line_parts, line_values, strip


def parse_properties(completions: DataFrame, id_col: str = "entity_id", text_col: str = "plain") -> DataFrame:
    """``(entity_id, feature, values array<string>)``; a repeated feature keeps its last line."""
    lines = completions.select(id_col, F.posexplode(completion_lines(F.col(text_col))).alias("pos", "line"))
    kept = lines.filter(F.size(line_parts(F.col("line"))) >= 2).select(
        id_col, "pos", line_feature(F.col("line")).alias("feature"), line_values(F.col("line")).alias("values"))
    return kept.groupBy(id_col, "feature").agg(F.max_by("values", "pos").alias("values"))


def key_map_frame(spark: SparkSession, key_map: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(key_map.items()), "feature string, key string")


def normalize_features(props: DataFrame, key_map: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Keep whitelisted features, rename to the unified key, one row per value.

    ``key_map`` is a parameter table of a few dozen rows, so it is broadcast.
    Output ``(entity_id, key, value_pos, value)``; synonyms stay separate rows until ``build_triples``
    de-duplicates them.
    """
    j = props.join(F.broadcast(key_map), "feature")
    return j.select(id_col, "key", "feature", F.posexplode("values").alias("value_pos", "value"))


def build_triples(normalized: DataFrame, heads: DataFrame, id_col: str = "entity_id",
                  drop_blank: bool = False) -> DataFrame:
    """``(head, relation, tail)`` de-duplicated.

    ``heads(entity_id, head)`` names the entity (item URI or ``user<id>``).  ``drop_blank`` removes
    values that are empty after stripping (the user side does this, the item side does not).
    """
    rows = normalized
    if drop_blank:
        rows = rows.filter(strip(F.col("value")) != "")
    j = rows.join(heads, id_col)
    t = j.select("head",
                 F.concat(F.lit(GENERATED_PREFIX), F.col("key")).alias("relation"),
                 F.concat(F.lit(GENERATED_PREFIX), F.replace(F.col("value"), F.lit(" "), F.lit("_"))).alias("tail"))
    return t.dropDuplicates(["head", "relation", "tail"])
