"""Prompt operators: cleaned titles (B6), item prompts (B7), user prompts (B8, J1, A4, W3),
chat messages (B9).

User prompts keep the likes in file order (``seq``, then ``item_id`` when a line repeats).  The per-user string is built in two levels so a
user holding a third of all likes never sorts them in one task: level 1 joins the likes of one
``seq`` range (bounded width) per user, level 2 joins those ordered pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgrec.functions.keymaps import ITEM_PROMPT_PREFIX, USER_PROMPT_PREFIX
from kgrec.functions.text import clean_title

SEQ_CHUNK = 1 << 20   # width of a level-1 seq range

DEFAULT_SYSTEM_PROMPT = (
    "List properties of the given entity as '<Feature: value, value. Feature: value.>' using one value "
    "per comma-separated slot; leave out anything you are unsure about.")


def first_name_per_id(names: DataFrame, id_col: str = "item_id") -> DataFrame:
    """First mapping row per id (W3): the one with the smallest ``seq`` if present, else any min."""
    if "seq" in names.columns:
        return names.groupBy(id_col).agg(F.min_by("name", "seq").alias("name"))
    return names.groupBy(id_col).agg(F.min("name").alias("name"))


def clean_titles(names: DataFrame, variants=("book_item", "book_user", "movie_item", "movie_user")) -> DataFrame:
    return names.select("item_id", *[clean_title(F.col("name"), v).alias(v) for v in variants])


def item_prompts(names: DataFrame, domain: str = "book") -> DataFrame:
    variant = "book_item" if domain == "book" else "movie_item"
    title = clean_title(F.col("name"), variant)
    return names.select("item_id", F.concat(F.lit(ITEM_PROMPT_PREFIX[domain]), title, F.lit(".")).alias("prompt"))


def user_prompts(ratings: DataFrame, names: DataFrame, domain: str = "book") -> DataFrame:
    """One prompt per user of ``ratings`` (users without likes included).

    ``ratings(user_id, item_id, rating, seq)``, ``names(item_id, name)``.  Likes whose item has no
    name are dropped by the inner join (strict callers count them with ``missing_names``).
    """
    variant = "book_user" if domain == "book" else "movie_user"
    prefix = USER_PROMPT_PREFIX[domain]
    names1 = first_name_per_id(names)
    label = clean_title(F.col("name"), variant)
    likes = (ratings.filter(F.col("rating") == 1).select("user_id", "item_id", "seq")
             .join(names1, "item_id")
             .select("user_id", "seq", "item_id", label.alias("label")))
    lvl1 = likes.groupBy("user_id", F.floor(F.col("seq") / SEQ_CHUNK).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "item_id", "label"))).alias("xs"))
    lvl1 = lvl1.select("user_id", "chunk", F.array_join(F.transform("xs", lambda x: x["label"]), "; ").alias("piece"))
    lvl2 = lvl1.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("ps"))
    joined = lvl2.select("user_id", F.array_join(F.transform("ps", lambda x: x["piece"]), "; ").alias("liked"))
    # prefix + "a; b; " with the last two characters cut, then "." (no likes: "...are" + ".")
    body = F.when(F.col("liked").isNull(), F.lit(prefix)).otherwise(
        F.concat(F.lit(prefix), F.col("liked"), F.lit("; ")))
    cut = F.expr("substring(_b, 1, length(_b) - 2)")
    users = ratings.select("user_id").distinct()
    return (users.join(joined, "user_id", "left").select("user_id", body.alias("_b"))
            .select("user_id", F.concat(cut, F.lit(".")).alias("prompt")))


def missing_names(ratings: DataFrame, names: DataFrame) -> DataFrame:
    """Liked items without a catalogue name (strict mode of J1)."""
    return ratings.filter(F.col("rating") == 1).join(names.select("item_id"), "item_id", "left_anti")


def chat_messages(prompts: DataFrame, id_col: str, system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Message list [user, system] in that order (B9); the chat template is applied by the model."""
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
                   F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
    return prompts.select(id_col, msgs.alias("messages"))
