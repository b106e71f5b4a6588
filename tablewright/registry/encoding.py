"""Encoders of categories, dates, numbers and vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import dates, vectors
from tablewright.operators import encode
from tablewright.operators.model import train_test_split
from tablewright.registry import query
from tablewright.registry.reshaping import CUSTOMER_NULLS, customer_nulls
from tablewright.registry.sql import u

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "one_hot",
    "SELECT l_orderkey, " + ", ".join(f"""l_returnflag = '{v}' AS "l_returnflag_{v}" """ for v in "ANR") + " FROM lineitem",
)
def one_hot(t):
    return encode.one_hot(t.lineitem.select("l_orderkey", "l_returnflag"), ["l_returnflag"]).drop("l_returnflag")


@query(
    "one_hot_nulls",
    "SELECT c_custkey, " + ", ".join(f"""coalesce(c_mktsegment = '{v}', false) AS "c_mktsegment_{v}" """ for v in SEGMENTS) + f" FROM ({CUSTOMER_NULLS})",
)
def one_hot_nulls(t):
    return encode.one_hot(customer_nulls(t).select("c_custkey", "c_mktsegment"), ["c_mktsegment"]).drop("c_mktsegment")


@query("one_hot_vector", """SELECT p_partkey, (SELECT count(DISTINCT p_name) FROM part) AS width, 1::BIGINT AS ones, dense_rank() OVER (ORDER BY p_name) - 1 AS hot FROM part""")
def one_hot_vector(t):
    df = t.part.select("p_partkey", "p_name")
    return encode.IndicatorVector("p_name").fit(df).transform(df).select("p_partkey", _vector_parts("p_name_vector").alias("v")).select("p_partkey", "v.*")


@F.udf(T.StructType([T.StructField(name, T.LongType()) for name in ("width", "ones", "hot")]))
def _vector_parts(vector):
    return int(vector.size), int(vector.values.sum()), int(vector.indices[0])


@query("label_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_label, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name_label FROM part")
def label_encode(t):
    return encode.label_encode(t.part.select("p_partkey", "p_brand", "p_name"), ["p_brand", "p_name"]).drop("p_brand", "p_name")


@query("label_encode_large", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_totalprice) - 1 AS o_totalprice_label FROM orders")
def label_encode_large(t):
    # A dictionary treated as too large for the driver: coded by a distributed sort.
    df = t.orders.select("o_orderkey", "o_totalprice")
    return encode.CategoricalEncoder(["o_totalprice"], one_hot_limit=0, limit=100).fit(df).transform(df).drop("o_totalprice")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "encode_categorical",
    f"""SELECT p_partkey, {", ".join(f'p_type = {v!r} AS "p_type_{v}"' for v in TYPES)}, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_label,
               dense_rank() OVER (ORDER BY p_size) - 1 AS p_size_label FROM part""",
)
def encode_categorical(t):
    df = t.part.select("p_partkey", "p_type", "p_brand", "p_size")
    return encode.encode_categorical(df, ["p_type", "p_brand", "p_size"]).drop("p_type", "p_brand", "p_size")


def _frequency(column: str) -> str:
    return f"(SELECT {column}, (row_number() OVER (ORDER BY count(*) DESC, {column}) - 1)::DOUBLE AS {column}_index FROM part GROUP BY 1)"


@query(
    "encode_categorical_ml",
    f"""SELECT p_partkey, p_type_index, p_brand_index, p_type_index AS hot, 6::BIGINT AS width, 'p_type_ohe,p_brand_index' AS features
        FROM part JOIN {_frequency('p_type')} USING (p_type) JOIN {_frequency('p_brand')} USING (p_brand)""",
)
def encode_categorical_ml(t):
    df, features = encode.encode_categorical_ml(t.part.select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"])
    hot = vector_to_array("p_type_ohe")
    return df.select(
        "p_partkey", "p_type_index", "p_brand_index", (F.array_position(hot, 1.0) - 1).cast("double").alias("hot"),
        F.size(hot).cast("bigint").alias("width"), F.lit(",".join(features)).alias("features"),
    )


TRAIN = u("p_partkey", "split", 3)


@query(
    "ordinal_encode",
    f"""WITH codes AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) - 1 AS code
                       FROM (SELECT DISTINCT p_retailprice FROM part WHERE {TRAIN} >= 0.3)),
             brands AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE {TRAIN} >= 0.3))
        SELECT p_partkey, coalesce(codes.code, -1) AS p_retailprice_ordinal, coalesce(brands.code, -1) AS p_brand_ordinal
        FROM part LEFT JOIN codes USING (p_retailprice) LEFT JOIN brands USING (p_brand) WHERE {TRAIN} < 0.3""",
)
def ordinal_encode(t):
    train, test = train_test_split(t.part.select("p_partkey", "p_retailprice", "p_brand"), "p_partkey", 0.3, 3)
    return encode.OrdinalEncoder(["p_retailprice", "p_brand"]).fit(train).transform(test).drop("p_retailprice", "p_brand")


@query("label_index", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS label FROM customer")
def label_index(t):
    return encode.label_index(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "label")[0].select("c_custkey", "label")


@query("label_inverse", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def label_inverse(t):
    df, labels = encode.label_index(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "label")
    return encode.label_inverse(df.drop("c_mktsegment"), "label", "segment", labels).select("c_custkey", "segment")


def _parts_sql(moment: str, name: str) -> str:
    day = f"(isodow({moment}) - 1)"
    return (
        f"year({moment})::BIGINT AS {name}_year, month({moment})::BIGINT AS {name}_month, day({moment})::BIGINT AS {name}_day, {day}::BIGINT AS {name}_weekday, "
        f"round(sin(2*pi()*{day}/7), 9) AS {name}_weekday_sin, round(cos(2*pi()*{day}/7), 9) AS {name}_weekday_cos"
    )


def _tidy(df, name: str):
    whole = {f"{name}_{p}": F.col(f"{name}_{p}").cast("bigint") for p in ("year", "month", "day", "weekday")}
    return df.withColumns(whole | {f"{name}_{p}": F.round(f"{name}_{p}", 9) for p in ("weekday_sin", "weekday_cos")})


@query(
    "datetime_parts",
    """SELECT event_id, year(ts)::BIGINT AS ts_year, month(ts)::BIGINT AS ts_month, day(ts)::BIGINT AS ts_day, (isodow(ts) - 1)::BIGINT AS ts_weekday FROM events""",
)
def datetime_parts(t):
    parts = dates.parts(F.col("ts"))
    return t.events.select("event_id", *[parts[p].cast("bigint").alias(f"ts_{p}") for p in ("year", "month", "day", "weekday")])


@query(
    "weekday_cyclic",
    """SELECT l_orderkey, round(sin(2*pi()*(isodow(l_shipdate)-1)/7), 9) AS sine, round(cos(2*pi()*(isodow(l_shipdate)-1)/7), 9) AS cosine FROM lineitem""",
)
def weekday_cyclic(t):
    sine, cosine = dates.weekday_cyclic(F.weekday("l_shipdate"))
    return t.lineitem.select("l_orderkey", F.round(sine, 9).alias("sine"), F.round(cosine, 9).alias("cosine"))


@query("datetime_from_unix", f"SELECT event_id, {_parts_sql('ts', 'unixtime')} FROM events")
def datetime_from_unix(t):
    df = t.events.select("event_id", F.unix_timestamp("ts").alias("unixtime"))
    return _tidy(encode.convert_datetime(df, ["unixtime"]).drop("unixtime"), "unixtime")


@query("drop_zero_datetime", "SELECT event_id, year(ts)::BIGINT AS a_year, month(ts)::BIGINT AS a_month, day(ts)::BIGINT AS a_day, 1 AS a_weekday, 1 AS a_weekday_sin, 1 AS a_weekday_cos FROM events")
def drop_zero_datetime(t):
    # Parts of `b` are 0 throughout and go; those of `a` stay.
    kept = [F.year("ts").cast("bigint").alias("a_year"), F.month("ts").cast("bigint").alias("a_month"), F.dayofmonth("ts").cast("bigint").alias("a_day")]
    fixed = [F.lit(1).alias(f"a_{p}") for p in ("weekday", "weekday_sin", "weekday_cos")]
    zero = [F.lit(0).alias(f"b_{p}") for p in dates.PARTS]
    df = t.events.select("event_id", *kept, *fixed, *zero)
    return encode.drop_zero_datetime(encode.drop_zero_datetime(df, "a"), "b")


@query("convert_datetime", f"SELECT event_id, {_parts_sql('ts', 'ts')}, {_parts_sql('ts', 'day')} FROM events")
def convert_datetime(t):
    df = t.events.select("event_id", "ts", F.date_format("ts", "MM dd, yyyy").alias("day"))
    return _tidy(_tidy(encode.convert_datetime(df, ["ts", "day"]).drop("ts", "day"), "ts"), "day")


@query(
    "standard_scale",
    """SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 9) AS p_size_scaled,
              round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 9) AS p_retailprice_scaled FROM part""",
)
def standard_scale(t):
    df = encode.StandardScaler(["p_size", "p_retailprice"]).fit(t.part).transform(t.part)
    return df.select("p_partkey", *[F.round(c, 9).alias(c) for c in ("p_size_scaled", "p_retailprice_scaled")])



@query("one_hot_ignore", f"""SELECT p_partkey, {", ".join(f'p_type = {v!r} AS "p_type_{v}"' for v in TYPES if v != "PROMO")} FROM part""")
def one_hot_ignore(t):
    df = t.part.select("p_partkey", "p_type")
    model = encode.CategoricalEncoder(["p_type"], one_hot_limit=None).fit(df.filter("p_type <> 'PROMO'"))
    return model.transform(df).drop("p_type")


@query("assemble_features", "SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, 2::BIGINT AS width FROM part")
def assemble_features(t):
    df = encode.assemble_features(t.part, ["p_size", "p_retailprice"])
    values = vector_to_array("features")
    return df.select("p_partkey", values[0].alias("a"), values[1].alias("b"), F.size(values).cast("bigint").alias("width"))


@query("cast_float32", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x * 1.0)::FLOAT::DOUBLE)), 6) AS total FROM embeddings")
def cast_float32(t):
    wide = F.col("embedding").cast("array<double>")
    total = F.aggregate(vectors.cast_float32(wide), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return t.embeddings.select("vec_id", F.round(total, 6).alias("total"))


@query("cast_truncate_int", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS c_acctbal FROM customer")
def cast_truncate_int(t):
    return t.customer.select("c_custkey", F.col("c_acctbal").cast("bigint").alias("c_acctbal"))


@query(
    "embedding_stats",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
       SELECT vec_id, round(list_avg(v), 5) AS e_mean, round(list_max(v), 5) AS e_max, round(list_min(v), 5) AS e_min, round(list_stddev_pop(v), 5) AS e_std,
              round(list_median(v), 5) AS e_median, round(sqrt(list_sum(list_transform(v, lambda x: x*x))), 5) AS e_l2 FROM e""",
)
def embedding_stats(t):
    values = vectors.stats(F.col("embedding"))
    return t.embeddings.select("vec_id", *[F.round(v, 5).alias(f"e_{s}") for s, v in values.items()])
