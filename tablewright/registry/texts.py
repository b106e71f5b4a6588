"""Words, term weights, embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import words
from tablewright.operators import text
from tablewright.registry import query

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\W+'), lambda w: length(w) > 0)"
KEPT = f"list_filter({TOKENS}, lambda w: NOT list_contains([{', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in words.STOPWORDS)}], w))"
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@query(
    "word_count",
    r"SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0B\x85\p{Z}]+'))::BIGINT AS words FROM documents",
)
def word_count(t):
    return t.documents.select("doc_id", words.word_count(F.col("text")).cast("bigint").alias("words"))


@query("tokenize", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def tokenize(t):
    return t.dealt("documents").select("doc_id", F.array_join(words.tokenize(F.col("text")), " ").alias("tokens"))


@query("remove_stopwords", f"SELECT doc_id, array_to_string({KEPT}, ' ') AS tokens FROM documents")
def remove_stopwords(t):
    kept = words.remove_stopwords(words.tokenize(F.col("text")))
    return t.dealt("documents").select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query(
    "ngrams",
    f"""WITH k AS (SELECT doc_id, {KEPT} AS t FROM documents)
        SELECT doc_id, array_to_string(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]), '|') AS bigrams FROM k""",
)
def ngrams(t):
    kept = words.remove_stopwords(words.tokenize(F.col("text")))
    pairs = t.dealt("documents").select("doc_id", kept.alias("kept")).select("doc_id", words.ngrams(F.col("kept"), 2).alias("pairs"))
    return pairs.select("doc_id", F.array_join("pairs", "|").alias("bigrams"))


@query(
    "hashing_tf",
    f"""WITH k AS (SELECT doc_id, {KEPT} AS t FROM documents)
        SELECT doc_id, greatest(len(t) - 1, 0)::DOUBLE AS total, 100::BIGINT AS buckets FROM k""",
)
def hashing_tf(t):
    # Which bucket a bigram falls into is Spark's hash; that all are counted can be checked.
    kept = words.ngrams(words.remove_stopwords(words.tokenize(F.col("text"))), 2)
    df = HashingTF(inputCol="pairs", outputCol="tf", numFeatures=text.HASH_BUCKETS).transform(t.dealt("documents").select("doc_id", kept.alias("pairs")))
    counts = vector_to_array("tf")
    total = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
    return df.select("doc_id", total.alias("total"), F.size(counts).cast("bigint").alias("buckets"))


VOCABULARY = f"""c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL),
    v AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term)"""


@query("idf", f"WITH {VOCABULARY} SELECT term, total, df, round(idf, 9) AS idf FROM v")
def idf(t):
    counts = text.term_counts(t.dealt("documents"), "doc_id", "text")
    return text.vocabulary(counts, t.documents.count()).withColumn("idf", F.round("idf", 9))


def _tfidf_sql(size: int | None) -> str:
    top = f"SELECT * FROM v ORDER BY total DESC, term LIMIT {size}" if size else "SELECT * FROM v"
    return f"""WITH {VOCABULARY}, k AS ({top}), w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN k USING (term))
               SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w"""


@query("tfidf_vocab", _tfidf_sql(500))
def tfidf_vocab(t):
    return text.tfidf_terms(t.dealt("documents"), "doc_id", "text", 500).withColumn("weight", F.round("weight", 9))


@query("tfidf_vocab_all", _tfidf_sql(None))
def tfidf_vocab_all(t):
    return text.tfidf_terms(t.dealt("documents"), "doc_id", "text").withColumn("weight", F.round("weight", 9))


@query(
    "tfidf_vectors",
    f"""WITH {VOCABULARY}, k AS (SELECT * FROM v ORDER BY total DESC, term LIMIT 500), w AS (SELECT doc_id, tf * idf AS w FROM c JOIN k USING (term)),
             s AS (SELECT doc_id, count(*) AS terms, sum(w) / sqrt(sum(w * w)) AS total FROM w GROUP BY doc_id)
        SELECT doc_id, coalesce(terms, 0) AS terms, round(coalesce(total, 0), 8) AS total FROM documents LEFT JOIN s USING (doc_id)""",
)
def tfidf_vectors(t):
    documents = t.dealt("documents")
    model = text.TfidfVectorizer("text", 500).fit(documents)
    values = vector_to_array("text_tfidf")
    filled = F.size(F.filter(values, lambda x: x > 0)).cast("bigint")
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return model.transform(documents).select("doc_id", filled.alias("terms"), F.round(total, 8).alias("total"))


@query(
    "tfidf_vectors_all",
    f"""WITH {VOCABULARY}, w AS (SELECT doc_id, tf * idf AS w FROM c JOIN v USING (term)),
             s AS (SELECT doc_id, sum(w) / sqrt(sum(w * w)) AS total FROM w GROUP BY doc_id)
        SELECT doc_id, (SELECT count(*) FROM v) AS width, round(coalesce(total, 0), 8) AS total FROM documents LEFT JOIN s USING (doc_id)""",
)
def tfidf_vectors_all(t):
    documents = t.dealt("documents").select("doc_id", "text")
    weighed = text.TfidfVectorizer("text").fit(documents).transform(documents)
    return weighed.select("doc_id", *_width_and_sum("text_tfidf"))


@F.udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("total", T.DoubleType())]))
def _measured(vector):
    return int(vector.size), float(vector.values.sum())


def _width_and_sum(column):
    measured = _measured(column)
    return measured["width"].alias("width"), F.round(measured["total"], 8).alias("total")


@query("text_tfidf_hash")
def text_tfidf_hash(t):
    df, features = text.text_tfidf_hash(t.dealt("documents").select("doc_id", "text", "source"), ["text", "source"])
    return df.select("doc_id", *[vector_to_array(f).alias(f) for f in features])


@query(
    "text_embedding",
    f"""WITH k AS (SELECT doc_id, len({KEPT}) AS n FROM documents)
        SELECT doc_id, 384::INTEGER AS width, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM k""",
)
def text_embedding(t):
    """The hashed stand-in: its width, and length 1 wherever there is a word."""
    df = text.embed_text(t.dealt("documents").select("doc_id", "text"), "text")
    squares = F.aggregate("text_embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return df.select("doc_id", F.size("text_embedding").alias("width"), F.round(F.sqrt(squares), 4).alias("length"))


@query(
    "text_embedding_model",
    """SELECT doc_id, length(text)::DOUBLE AS chars, len(string_split(text, chr(10)))::DOUBLE AS lines FROM documents""",
)
def text_embedding_model(t):
    """The Arrow path of a sentence model, with a small encoder whose answers are known."""

    def load():
        return lambda texts: np.array([[len(x), x.count("\n") + 1] for x in texts], float).reshape(len(texts), 2)

    df = text.embed_text(t.dealt("documents").select("doc_id", "text"), "text", text.model_embedder(load))
    return df.select("doc_id", *[F.get("text_embedding", i).cast("double").alias(c) for i, c in enumerate(("chars", "lines"))])


@query(
    "pca_reduce",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS j FROM embeddings),
            v AS (SELECT j, var_samp(x) AS v FROM e GROUP BY j)
       SELECT (SELECT count(*) FROM embeddings) AS n, 64::BIGINT AS components, round(sum(v), 4) AS total_variance, true AS falling FROM v""",
)
def pca_reduce(t):
    # Signs are arbitrary; the variances are not: they fall and add up to that of the data.
    model = text.PcaReducer("embedding", "e", k=100).fit(t.embeddings)
    names = model.features
    spread = model.transform(t.embeddings.select("vec_id", "embedding")).agg(
        F.count(F.lit(1)).alias("n"), *[F.var_samp(F.col(c).cast("double")).alias(c) for c in names]
    )
    falling = F.lit(True)
    for a, b in zip(names, names[1:]):
        falling = falling & (F.col(a) >= F.col(b) - F.lit(1e-6))
    total = F.lit(0.0)
    for c in names:
        total = total + F.col(c)
    return spread.select("n", F.lit(len(names)).cast("bigint").alias("components"), F.round(total, 4).alias("total_variance"), falling.alias("falling"))


@query("extract_text_features")
def extract_text_features(t):
    return text.extract_text_features(t.dealt("documents").select("doc_id", "text"), ["text"]).drop("text")
