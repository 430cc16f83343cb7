"""Prompt, parser and triple operators on hand-made rows (FIXTURES.md)."""

from pyspark.sql import functions as F

from kgrec.functions.keymaps import BOOK_ITEM_KEYS, BOOK_USER_KEYS
from kgrec.functions.text import clean_title, entity_from_path, parse_run_name, run_name
from kgrec.operators import prompts as P
from kgrec.operators import triples as TR


def _parse(spark, text):
    df = spark.createDataFrame([(1, text)], "entity_id long, plain string")
    return {r["feature"]: list(r["values"]) for r in TR.parse_properties(df).collect()}


def test_user_prompt_book(spark):
    ratings = spark.createDataFrame([(1, 10, 1, 1), (1, 11, 1, 2), (2, 10, 0, 3)],
                                    "user_id long, item_id long, rating long, seq long")
    names = spark.createDataFrame([(10, "Old_Tale (1990);u/a"), (11, "Plain;u/b")], "item_id long, name string")
    got = {r["user_id"]: r["prompt"] for r in P.user_prompts(ratings, names, "book").collect()}
    assert got == {1: "My favourite books are: Old Tale; Plain.", 2: "My favourite books are."}


def test_user_prompt_keeps_file_order(spark):
    ratings = spark.createDataFrame([(1, 11, 1, 5), (1, 10, 1, 2), (1, 12, 1, 9)],
                                    "user_id long, item_id long, rating long, seq long")
    names = spark.createDataFrame([(10, "A;x"), (11, "B;y"), (12, "C;z")], "item_id long, name string")
    got = P.user_prompts(ratings, names, "book").collect()[0]["prompt"]
    assert got == "My favourite books are: A; B; C."


def test_clean_title_variants(spark):
    df = spark.createDataFrame([("Old_Tale (1990) [x];http://r/The_Old_Tale_(film)",)], "name string")
    r = df.select(*[clean_title(F.col("name"), v).alias(v)
                    for v in ("book_item", "book_user", "movie_item", "movie_user")]).collect()[0]
    assert r["book_item"] == "Old_Tale"
    assert r["book_user"] == "Old Tale"
    assert r["movie_item"] == "The Old Tale"
    assert r["movie_user"] == "Old Tale  ;http://r/The Old Tale"


def test_item_prompt(spark):
    names = spark.createDataFrame([(10, "Old_Tale (1990);u/a")], "item_id long, name string")
    assert P.item_prompts(names, "book").collect()[0]["prompt"] == \
        "The book you have to infer information is: Old_Tale."


def test_parser_basic(spark):
    got = _parse(spark, "<Genres: Dark, Epic. Favourite kind of plot: Heist.>")
    assert got == {"genres": ["dark", "epic"], "kind of plot": ["heist"]}


def test_parser_last_wins(spark):
    assert _parse(spark, "Genre: a. Genre: b") == {"genre": ["b"]}


def test_parser_dot_split_kept(spark):
    assert _parse(spark, "Author: J.R. Doe") == {"author": ["j"]}


def test_parser_only_second_part(spark):
    assert _parse(spark, "x: y: z") == {"x": ["y"]}


def test_parser_no_colon_and_non_ascii(spark):
    assert _parse(spark, "nothing here. Country: ÜMLAND") == {"country": ["ümland"]}


def test_triples_union_synonyms(spark):
    props = spark.createDataFrame([(1, "genre", ["a b"]), (1, "genres", ["a b"])],
                                  "entity_id long, feature string, values array<string>")
    norm = TR.normalize_features(props, TR.key_map_frame(spark, BOOK_ITEM_KEYS))
    heads = spark.createDataFrame([(1, "uri1")], "entity_id long, head string")
    rows = TR.build_triples(norm, heads).collect()
    assert [(r["head"], r["relation"], r["tail"]) for r in rows] == \
        [("uri1", "llama_generated/genre", "llama_generated/a_b")]


def test_blank_value_item_kept_user_dropped(spark):
    props = spark.createDataFrame([(1, "genre", [""])], "entity_id long, feature string, values array<string>")
    heads = spark.createDataFrame([(1, "h")], "entity_id long, head string")
    item = TR.build_triples(TR.normalize_features(props, TR.key_map_frame(spark, BOOK_ITEM_KEYS)), heads)
    user = TR.build_triples(TR.normalize_features(props, TR.key_map_frame(spark, BOOK_USER_KEYS)), heads,
                            drop_blank=True)
    assert [r["tail"] for r in item.collect()] == ["llama_generated/"]
    assert user.count() == 0


def test_entity_from_path(spark):
    df = spark.createDataFrame([("a/items/item12.json",), ("u/user7_sysprompt1.json",), ("u/user9.json",)], "p string")
    assert [r[0] for r in df.select(entity_from_path(F.col("p"))).collect()] == ["12", "user7", "user9"]


def test_run_name_roundtrip(spark):
    df = spark.createDataFrame([(0.2, "Basic", "books", 7, 64, 3)],
                               "p double, c string, ds string, s long, k long, l long")
    name = df.select(run_name(F.col("p"), F.col("c"), F.col("ds"), F.col("s"), F.col("k"), F.col("l")).alias("n"))
    assert name.collect()[0]["n"] == "drop0.2_uni_Basic_books_s=7_CompGCN_k=64_l=3"
    back = name.select(*parse_run_name(F.col("n"))).collect()[0]
    assert (back["dropout"], back["dataset"], back["setting"], back["layers"]) == (0.2, "books", 7, 3)


def test_chat_messages_order(spark):
    prompts = spark.createDataFrame([(1, "p")], "item_id long, prompt string")
    msgs = P.chat_messages(prompts, "item_id", "sys").collect()[0]["messages"]
    assert [(m["role"], m["content"]) for m in msgs] == [("user", "p"), ("system", "sys")]
