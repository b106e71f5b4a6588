"""Readers: each format is written from a given table and read back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.recipes import integrate
from tablewright.registry import Tables, query
from tablewright.session import scratch_path
from tablewright.sources import binary, files


def _written(t: Tables, df: DataFrame, form: str, name: str, **options) -> str:
    path = scratch_path(t.spark, name)
    df.write.options(**options).format(form).save(path)
    return path


def _lines(t: Tables, df: DataFrame, header: str, name: str, **options) -> str:
    """One text column as raw lines under a header line (quoting off, an unused separator)."""
    return _written(t, df.toDF(header), "csv", name, header=True, quote="", sep="\u0001", **options)


@query("load_table", "SELECT r_regionkey, r_name FROM region")
def load_table(t):
    return files.load_table(t.spark, t.path("region"))


@query(
    "read_csv_header",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part",
)
def read_csv_header(t):
    return files.read_csv(t.spark, _written(t, t.part, "csv", "part.csv", header=True))


@query("read_csv_named", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_csv_named(t):
    path = _written(t, t.customer, "csv", "customer.csv")
    return files.read_csv_named(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("read_delimited", "SELECT l_partkey AS user_id, l_suppkey AS item_id, l_orderkey AS unix_timestamp FROM lineitem")
def read_delimited(t):
    path = _written(t, t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey"), "csv", "likes", sep=" ")
    return files.read_delimited(t.spark, path, "user_id bigint, item_id bigint, unix_timestamp bigint")


@query(
    "read_csv_skip_bad",
    """SELECT o_orderkey AS a, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS b,
              CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS c
       FROM orders WHERE o_orderkey % 5 <> 0""",
)
def read_csv_skip_bad(t):
    # Every third line is short, every third lacks its last field, every fifth is too long.
    third = F.col("o_orderkey") % 3
    line = F.concat(
        F.col("o_orderkey").cast("string"),
        F.when(third != 0, F.concat(F.lit(","), F.col("o_custkey").cast("string"))).otherwise(F.lit("")),
        F.when(third == 1, F.concat(F.lit(","), F.col("o_orderpriority"))).otherwise(F.lit("")),
    )
    long = F.concat(F.col("o_orderkey").cast("string"), F.lit(",1,x,"), F.when(third == 0, F.lit("extra,")).otherwise(F.lit("")))
    lines = t.orders.select(F.when(F.col("o_orderkey") % 5 == 0, long).otherwise(line).alias("line"))
    return files.read_csv_skip_bad(t.spark, _lines(t, lines, "a,b,c", "posts.csv"))


@query("read_jsonl", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_jsonl(t):
    df = files.read_jsonl(t.spark, _written(t, t.customer, "json", "customer.json"))
    return df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _nation_files(t: Tables, value, name: str) -> str:
    """One JSON object per file, one file per nation; the nation is the folder."""
    packed = t.customer.groupBy("c_nationkey").agg(value.alias("value"))
    path = scratch_path(t.spark, name)
    packed.write.partitionBy("c_nationkey").text(path)
    return path


@query(
    "read_json_map",
    """SELECT c_nationkey::VARCHAR AS episode, c_custkey AS id, c_name AS speaker, NULL::DOUBLE AS duration FROM customer""",
)
def read_json_map(t):
    record = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("speaker"), F.lit(1).alias("unused"))
    packed = F.to_json(F.create_map(F.first("c_nationkey").cast("string"), F.collect_list(record)))
    path = _nation_files(t, packed, "transcripts")
    return files.read_json_records(t.spark, f"{path}/c_nationkey=*", "id bigint, speaker string, duration double", key="episode")


@query("read_json_pairs", "SELECT c_name AS product, c_mktsegment AS category FROM customer")
def read_json_pairs(t):
    packed = F.to_json(F.map_from_entries(F.collect_list(F.struct("c_name", "c_mktsegment"))))
    return files.read_json_pairs(t.spark, f"{_nation_files(t, packed, 'pairs')}/c_nationkey=*", "product", "category")


def _literals(t: Tables) -> DataFrame:
    return t.events.select(
        F.format_string(
            "{'event_id': %d, 'kind': u'%s', 'value': %s, 'big': %s, 'note': None, 'tags': ['a', '%s']}",
            "event_id", "event_type", F.col("value").cast("string"),
            F.when(F.col("value") > 100, "True").otherwise("False"), "user_id",
        ).alias("value")
    )


LITERALS = """SELECT event_id, event_type AS kind, value, value > 100 AS big, NULL::VARCHAR AS note,
                     'a,' || user_id AS tags FROM events"""


@query("read_pyliteral_lines", LITERALS)
def read_pyliteral_lines(t):
    path = _written(t, _literals(t), "text", "events.json")
    schema = "event_id bigint, kind string, value double, big boolean, note string, tags array<string>"
    return files.read_pyliteral_lines(t.spark, path, schema).withColumn("tags", F.array_join("tags", ","))


@query("read_gzip", "SELECT event_id, event_type, value FROM events")
def read_gzip(t):
    path = _written(t, t.events.select("event_id", "event_type", "value"), "json", "events.json.gz", compression="gzip")
    return files.read_gzip(t.spark, path, "event_id bigint, event_type string, value double", partitions=8)


@query("read_parquet", "SELECT l_orderkey, l_quantity FROM lineitem")
def read_parquet(t):
    return files.read_parquet(t.spark, t.path("lineitem")).select("l_orderkey", "l_quantity")


def _write_records(df: DataFrame, folder: str) -> int:
    """Each task writes its rows of (id, vector) as one file of fixed-size records."""
    folder = folder.removeprefix("file:")

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        rows = 0
        blocks = []
        for batch in batches:
            for number, vector in batch.itertuples(index=False):
                blocks.append(f"{number:08d}".encode() + np.asarray(vector, dtype="<f4").tobytes())
                rows += 1
        if blocks:
            with system.open_output_stream(f"{base}/part-{uuid.uuid4().hex}.b") as out:
                out.write(b"".join(blocks) + b"00000099trunc")
        yield pd.DataFrame({"n": [rows]})

    return df.mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0]


@query(
    "read_fixed_binary",
    """SELECT vec_id AS item_id, len(embedding)::BIGINT AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total,
              embedding[1]::DOUBLE AS first_value FROM embeddings""",
)
def read_fixed_binary(t):
    folder = scratch_path(t.spark, "features")
    _write_records(t.embeddings.select("vec_id", "embedding"), folder)
    df = binary.read_fixed_binary(t.spark, folder, dim=64)
    total = F.aggregate("image_features", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return df.select(
        "item_id", F.size("image_features").cast("bigint").alias("dim"), F.round(total, 6).alias("total"),
        F.col("image_features")[0].cast("double").alias("first_value"),
    )


# --- whole recipes on files of the same layout, filled from the given tables ----------


@query(
    "recipe_npr",
    """SELECT o_orderkey AS episode, o_orderpriority AS title, l_linenumber::BIGINT AS utterance_order, l_quantity AS seconds
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def recipe_npr(t):
    root = scratch_path(t.spark, "data")
    episodes = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    spoken = t.lineitem.select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("utterance_order"), F.col("l_quantity").alias("seconds"))
    episodes.write.csv(f"{root}/NPR/episodes.csv", header=True)
    spoken.write.csv(f"{root}/NPR/utterances.csv", header=True)
    return integrate(t.spark, "npr", root)


@query(
    "recipe_paired_recipes",
    """SELECT a.l_partkey AS base, a.l_suppkey AS target, b.p_name AS name_base, c.p_name AS name_target
       FROM lineitem a JOIN part b ON a.l_partkey = b.p_partkey JOIN part c ON a.l_suppkey = c.p_partkey""",
)
def recipe_paired_recipes(t):
    root = scratch_path(t.spark, "data")
    t.lineitem.select(F.col("l_partkey").alias("base"), F.col("l_suppkey").alias("target")).write.parquet(f"{root}/Paired Recipes/pairs.parquet")
    t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).write.parquet(f"{root}/Paired Recipes/recipes.parquet")
    return integrate(t.spark, "paired_recipes", root).select("base", "target", "name_base", "name_target")


@query(
    "recipe_local_reviews",
    """SELECT o_custkey AS gmap_id, o_orderpriority AS user_name, c_name AS business_name, o_totalprice AS rating
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def recipe_local_reviews(t):
    root = scratch_path(t.spark, "data")
    reviews = t.orders.select(F.col("o_custkey").alias("gmap_id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("rating"))
    places = t.customer.select(F.col("c_custkey").alias("gmap_id"), F.col("c_name").alias("name"))
    reviews.write.json(f"{root}/Google Local/review-Hawaii_10.json")
    places.write.json(f"{root}/Google Local/meta-Hawaii.json")
    return integrate(t.spark, "local_reviews", root).select("gmap_id", "user_name", "business_name", "rating")


@query(
    "recipe_librarything",
    """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem),
            n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
            l AS (SELECT u, string_agg(v, ',' ORDER BY v) AS connections FROM n GROUP BY u)
       SELECT 'p' || p_partkey AS "user", p_name AS work, p_retailprice AS stars, l.connections
       FROM part LEFT JOIN l ON l.u = 'p' || p_partkey""",
)
def recipe_librarything(t):
    root = scratch_path(t.spark, "data")
    none = F.lit("-")
    reviews = t.part.select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("user"), F.col("p_name").alias("work"), none.alias("comment"), none.alias("time"),
        F.lit(0).alias("unixtime"), F.array(none).alias("flags"), F.col("p_retailprice").alias("stars"), F.lit(0).alias("nhelpful"),
    )
    edges = t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey")))
    reviews.write.json(f"{root}/Librarything/reviews.json")
    edges.write.csv(f"{root}/Librarything/edges.txt", sep=" ")
    df = integrate(t.spark, "librarything", root)
    return df.select("user", "work", "stars", F.array_join("connections", ",").alias("connections"))


@query(
    "recipe_steam",
    """WITH g AS (SELECT (p_partkey + 50)::VARCHAR AS item_id, p_name AS title FROM part),
            i AS (SELECT o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS item_id, l_quantity::BIGINT AS playtime_forever,
                         o_orderkey::VARCHAR AS user_url FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
            r AS (SELECT o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS item_id, l_returnflag AS review,
                         CASE WHEN o_orderpriority = '1-URGENT' THEN 'none' ELSE o_orderkey::VARCHAR END AS user_url FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
       SELECT i.user_id, i.user_url, i.item_id, i.playtime_forever, r.review, g.title
       FROM i LEFT JOIN r ON r.user_id = i.user_id AND r.user_url = i.user_url AND r.item_id = i.item_id
              LEFT JOIN g ON g.item_id = i.item_id""",
)
def recipe_steam(t):
    root = f"{scratch_path(t.spark, 'data')}"
    text = lambda c: F.col(c).cast("string")
    sold = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    owner = [text("o_custkey").alias("user_id"), text("o_orderkey").alias("user_url")]

    def save(df: DataFrame, name: str) -> None:
        # JSON text without true, false and null is a Python literal as well.
        df.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}/Steam/{name}.json")

    item = F.struct(text("l_partkey").alias("item_id"), F.lit("x").alias("item_name"), F.col("l_quantity").cast("bigint").alias("playtime_forever"))
    save(sold.groupBy(*owner).agg(F.collect_list(item).alias("items")), "australian_users_items")
    review = F.struct(text("l_partkey").alias("item_id"), F.col("l_returnflag").alias("review"))
    # All rows are written; shifted keys leave some without a partner on either side.
    elsewhere = [owner[0], F.when(F.col("o_orderpriority") == "1-URGENT", "none").otherwise(text("o_orderkey")).alias("user_url")]
    save(sold.groupBy(*elsewhere).agg(F.collect_list(review).alias("reviews")), "australian_user_reviews")
    save(t.part.select((F.col("p_partkey") + 50).cast("string").alias("id"), F.col("p_name").alias("title")), "steam_games")
    bundles = t.supplier.select(text("s_suppkey").alias("bundle_id"), F.array(F.struct(F.concat(F.lit("none"), text("s_suppkey")).alias("item_id"))).alias("items"))
    save(bundles, "bundle_data")
    return integrate(t.spark, "steam", root).select("user_id", "user_url", "item_id", "playtime_forever", "review", "title")


@query(
    "recipe_behance",
    """WITH o AS (SELECT l_partkey AS item_id, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS owners FROM lineitem GROUP BY 1)
       SELECT l_orderkey AS user_id, l_partkey AS item_id, o.owners, round(list_sum(embedding::DOUBLE[]), 6) AS total
       FROM lineitem LEFT JOIN o ON o.item_id = l_partkey LEFT JOIN embeddings ON vec_id = l_partkey""",
)
def recipe_behance(t):
    from tablewright.plans.recipes import behance

    root = scratch_path(t.spark, "data")
    t.lineitem.select("l_orderkey", "l_partkey", F.lit(0)).write.csv(f"{root}/Behance/Behance_appreciate_1M", sep=" ")
    t.lineitem.select("l_partkey", "l_suppkey").write.csv(f"{root}/Behance/Behance_Item_to_Owners", sep=" ")
    _write_records(t.embeddings.select("vec_id", "embedding"), f"{root}/Behance/Behance_Image_Features.b")
    df = behance(t.spark, root, dim=64)
    total = F.aggregate("image_features", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return df.select("user_id", "item_id", F.array_join(F.col("owner_id").cast("array<string>"), ",").alias("owners"), F.round(total, 6).alias("total"))
