"""Twenty-two public datasets, each joined into one wide table.

A recipe is ``(spark, root) -> DataFrame``: lazy, with the files below ``root`` laid out
as the dataset publishers ship them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.relational import (
    collect_lists,
    explode_records,
    flatten_struct,
    join_role_pair,
    merge,
    undirected_adjacency,
    union_by_name,
)
from tablewright.sources.binary import read_fixed_binary
from tablewright.sources.files import (
    read_csv,
    read_csv_named,
    read_csv_skip_bad,
    read_delimited,
    read_json_pairs,
    read_json_records,
    read_jsonl,
    read_parquet,
    read_pyliteral_lines,
)
from tablewright.session import small_table

Recipe = Callable[[SparkSession, str], DataFrame]

# Column names of files without a header, fields of nested records, output order.
TWITCH = ["User_ID", "Stream_ID", "Streamer_username", "Time_start", "Time_stop"]
TRANSCRIPT = "episode string, act string, utterance_start double, utterance_end double, duration double, speaker string, utterance string"
QUESTIONS = (
    "asin string, questions array<struct<questionType: string, askerID: string, questionTime: string, questionText: string, "
    "answers: array<struct<answerText: string, answererID: string, answerTime: string, helpful: array<bigint>>>>>"
)
ANSWER_COLUMNS = [
    "asin", "questionType", "askerID", "questionTime", "questionText", "answerType", "answererID", "answerTime",
    "answerUnixTime", "answerText", "helpful",
]
STEAM_REVIEWS = (
    "user_id string, user_url string, reviews array<struct<item_id: string, review: string, recommend: boolean, "
    "posted: string, last_edited: string, funny: string, helpful: string>>"
)
STEAM_ITEMS = (
    "user_id string, items_count bigint, steam_id string, user_url string, items array<struct<item_id: string, "
    "item_name: string, playtime_forever: bigint, playtime_2weeks: bigint>>"
)
STEAM_BUNDLES = (
    "bundle_id string, bundle_name string, bundle_url string, bundle_price string, bundle_discount string, "
    "bundle_final_price string, items array<struct<item_id: string, discounted_price: string>>"
)
READING_KEYS = ["user_id", "book_id", "review_id", "rating", "date_added", "date_updated", "read_at", "started_at"]
TRADESY = "uid string, lists struct<selling: array<string>, sold: array<string>, want: array<string>, bought: array<string>>"
LIBRARY_COLUMNS = ["user", "work", "comment", "time", "unixtime", "flags", "stars", "nhelpful"]


def twitch(spark: SparkSession, root: str) -> DataFrame:
    return read_csv_named(spark, f"{root}/Twitch/100k_a.csv", TWITCH)


def npr(spark: SparkSession, root: str) -> DataFrame:
    episodes = read_csv(spark, f"{root}/NPR/episodes.csv", multiline=True).withColumnsRenamed({"id": "episode", "episode_date": "date"})
    return merge(episodes, read_csv(spark, f"{root}/NPR/utterances.csv", multiline=True), "episode")


def this_american_life(spark: SparkSession, root: str) -> DataFrame:
    parts = [f"{root}/This American Life/{part}-transcripts-aligned.json" for part in ("train", "valid", "test")]
    return read_json_records(spark, parts, TRANSCRIPT)


def food_reviews(spark: SparkSession, root: str) -> DataFrame:
    recipes = read_csv(spark, f"{root}/Recipes/RAW_recipes.csv", multiline=True).withColumnRenamed("id", "recipe_id")
    return merge(read_csv(spark, f"{root}/Recipes/RAW_interactions.csv", multiline=True), recipes, "recipe_id")


def paired_recipes(spark: SparkSession, root: str) -> DataFrame:
    pairs = read_parquet(spark, f"{root}/Paired Recipes/pairs.parquet")
    return join_role_pair(pairs, read_parquet(spark, f"{root}/Paired Recipes/recipes.parquet"), "id", "base", "target")


def endomondo(spark: SparkSession, root: str) -> DataFrame:
    spread = spark.sparkContext.defaultParallelism
    return read_pyliteral_lines(spark, f"{root}/EndoMondo/endomondoHR.json.gz", partitions=spread)


def product_reviews(spark: SparkSession, root: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/Amazon Product Reviews/Video_Games_5.json")


def product_answers(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root}/Amazon Question and Answer"
    flat = read_pyliteral_lines(spark, f"{folder}/qa_Video_Games.json").withColumnsRenamed(
        {"question": "questionText", "answer": "answerText", "unixTime": "answerUnixTime"}
    )
    nested = read_pyliteral_lines(spark, f"{folder}/QA_Video_Games copy.json", QUESTIONS)
    empty = F.lit("")
    asked = ["questionType", "askerID", "questionTime", "questionText"]
    questions = explode_records(
        nested, "questions", {c: c for c in [*asked, "answers"]}, ["asin"], dict.fromkeys(asked[1:], empty)
    )
    given = ["answerText", "answererID", "answerTime"]
    answers = explode_records(
        questions, "answers", {c: c for c in [*given, "helpful"]}, ["asin", *asked],
        dict.fromkeys(given, empty) | {"helpful": F.array().cast("array<bigint>")},
    )
    return union_by_name(flat, answers).select(*ANSWER_COLUMNS)


def electronics_bias(spark: SparkSession, root: str) -> DataFrame:
    return read_csv(spark, f"{root}/Amazon Marketing Bias/df_electronics.csv")


def modcloth_bias(spark: SparkSession, root: str) -> DataFrame:
    return read_csv(spark, f"{root}/ModCloth Marketing Bias/df_modcloth.csv")


def local_reviews(spark: SparkSession, root: str) -> DataFrame:
    reviews = read_jsonl(spark, f"{root}/Google Local/review-Hawaii_10.json").withColumnRenamed("name", "user_name")
    places = read_jsonl(spark, f"{root}/Google Local/meta-Hawaii.json").withColumnRenamed("name", "business_name")
    return merge(reviews, places, "gmap_id")


def steam(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root}/Steam"
    reviews = read_pyliteral_lines(spark, f"{folder}/australian_user_reviews.json", STEAM_REVIEWS)
    review_fields = ["item_id", "review", "recommend", "posted", "last_edited", "funny", "helpful"]
    reviews = explode_records(reviews, "reviews", {c: c for c in review_fields}, ["user_id", "user_url"])
    items = read_pyliteral_lines(spark, f"{folder}/australian_users_items.json", STEAM_ITEMS)
    item_fields = ["item_id", "item_name", "playtime_forever", "playtime_2weeks"]
    items = explode_records(items, "items", {c: c for c in item_fields}, ["user_id", "user_url", "steam_id", "items_count"])
    games = read_pyliteral_lines(spark, f"{folder}/steam_games.json").withColumnRenamed("id", "item_id")
    bundles = read_pyliteral_lines(spark, f"{folder}/bundle_data.json", STEAM_BUNDLES)
    parent = ["bundle_id", "bundle_name", "bundle_url", "bundle_price", "bundle_discount", "bundle_final_price"]
    bundles = explode_records(bundles, "items", {"item_id": "item_id", "item_discounted_price": "discounted_price"}, parent)
    out = merge(items, reviews, ["user_id", "user_url", "item_id"], "left")
    return merge(merge(out, games, "item_id", "left"), bundles, "item_id", "left")


def goodreads(spark: SparkSession, root: str) -> DataFrame:
    books, interactions, reviews = (
        read_jsonl(spark, f"{root}/Goodreads Book Reviews/goodreads_{part}_poetry.json") for part in ("books", "interactions", "reviews")
    )
    return merge(merge(interactions, reviews, READING_KEYS, "left"), books, "book_id", "left")


def goodreads_spoilers(spark: SparkSession, root: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/Goodreads Spoilers/goodreads_reviews_spoiler.json")


def pinterest(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root}/Pinterest"
    looks = union_by_name(*[read_jsonl(spark, f"{folder}/{part}.json") for part in ("fashion", "home")])
    categories = read_json_pairs(spark, [f"{folder}/{part}-cat.json" for part in ("fashion", "home")], "product", "category")
    return merge(looks, categories, "product", "left")


def modcloth_fit(spark: SparkSession, root: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/ModCloth Clothing Fit/modcloth_final_data.json")


def runway_fit(spark: SparkSession, root: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/RentTheRunway Clothing Fit/renttherunway_final_data.json")


def tradesy(spark: SparkSession, root: str) -> DataFrame:
    return flatten_struct(read_pyliteral_lines(spark, f"{root}/Tradesy/tradesy.json", TRADESY), "lists", ["uid"])


def behance(spark: SparkSession, root: str, dim: int = 4096) -> DataFrame:
    folder = f"{root}/Behance"
    likes = read_delimited(spark, f"{folder}/Behance_appreciate_1M", "user_id bigint, item_id bigint, unix_timestamp bigint")
    owners = read_delimited(spark, f"{folder}/Behance_Item_to_Owners", "item_id bigint, owner_id bigint")
    images = read_fixed_binary(spark, f"{folder}/Behance_Image_Features.b", dim)
    return merge(merge(likes, collect_lists(owners, "item_id", "owner_id"), "item_id", "left"), images, "item_id", "left")


def librarything(spark: SparkSession, root: str) -> DataFrame:
    reviews = read_jsonl(spark, f"{root}/Librarything/reviews.json").select(*LIBRARY_COLUMNS)
    edges = read_delimited(spark, f"{root}/Librarything/edges.txt", "user1 string, user2 string")
    return merge(reviews, undirected_adjacency(edges, "user1", "user2"), "user", "left")


def beer_reviews(spark: SparkSession, root: str) -> DataFrame:
    return union_by_name(
        read_pyliteral_lines(spark, f"{root}/RateBeer Multi-aspect Reviews/ratebeer.json"),
        read_pyliteral_lines(spark, f"{root}/BeerAdvocate Multi-aspect Reviews/beeradvocate.json"),
    )


def reddit(spark: SparkSession, root: str) -> DataFrame:
    return read_csv_skip_bad(spark, f"{root}/Reddit Submissions/submissions.csv", multiline=True)


# Numbered from 1 in this order.
RECIPES: dict[str, Recipe] = {
    recipe.__name__: recipe
    for recipe in (
        twitch, npr, this_american_life, food_reviews, paired_recipes, endomondo, product_reviews, product_answers,
        electronics_bias, modcloth_bias, local_reviews, steam, goodreads, goodreads_spoilers, pinterest, modcloth_fit,
        runway_fit, tradesy, behance, librarything, beer_reviews, reddit,
    )
}


def integrate(spark: SparkSession, dataset: str | int, root: str) -> DataFrame:
    """The wide table of a dataset, by name or by number."""
    names = list(RECIPES)
    name = names[dataset - 1] if isinstance(dataset, int) and 1 <= dataset <= len(names) else dataset
    if name not in RECIPES:
        raise ValueError(f"no dataset {dataset!r}; known: {', '.join(names)}")
    return RECIPES[name](spark, root)


def dataset_catalog(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(enumerate(RECIPES, 1)), "number int, dataset string")
