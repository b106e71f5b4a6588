"""Text features: term weights, hashed n-gram weights, embeddings, principal components."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF,
    PCA,
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    HashingTF,
    NGram,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
)
from pyspark.ml.feature import StandardScaler as VectorScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import vectors, words
from tablewright.operators.ranking import dense_codes
from tablewright.session import checkpoint, written

logger = logging.getLogger(__name__)

# Fixed values of the text features.
HASH_BUCKETS = 100
COMPONENTS = 100
EMBEDDING_SIZE = 384
SLICE_TERMS = 1 << 17  # terms that a task weighs at once
SHIPPED_TERMS, SHIPPED_BYTES = 1_000_000, 64 << 20  # a vocabulary that may travel to every task
RARE, SALTS = 1000, 32  # a term in more than one row of so many is a hot key; parts that such a key is spread over


# --- term weights --------------------------------------------------------------------


def row_term_counts(df: DataFrame, key: str | Sequence[str], column: str) -> DataFrame:
    """The distinct terms of each row and how often they occur: ``key, terms, tfs``, without a shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    # Runs of equal terms in the sorted terms: each begins where a term differs from the one before.
    terms, heads = F.col("__terms"), F.col("__heads")
    n = F.size(terms)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    listed = df.select(*keys, F.sort_array(_term_column(df, column)).alias("__terms"))
    begun = listed.select(*keys, "__terms", F.filter(places, lambda i: (i == 1) | (F.get(terms, i - 1) != F.get(terms, i - 2))).alias("__heads"))
    runs = F.transform(heads, lambda h, k: (F.coalesce(F.get(heads, k + 1), n + 1) - h).cast("bigint"))
    return begun.select(*keys, F.transform(heads, lambda h: F.get(terms, h - 1)).alias("terms"), runs.alias("tfs"))


def term_counts(df: DataFrame, key: str | Sequence[str], column: str) -> DataFrame:
    """How often each term occurs in each row: ``key, term, tf``."""
    keys = [key] if isinstance(key, str) else list(key)
    return row_term_counts(df, keys, column).select(*keys, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))


def vocabulary(counts: DataFrame, rows: int, size: int | None = None) -> DataFrame:
    """``term, total, df, idf`` of the ``size`` most frequent terms (ties alphabetical), or all."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(1.0) + F.lit(rows)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    terms = terms.withColumn("idf", idf)
    return terms if size is None else terms.orderBy(F.col("total").desc(), "term").limit(size)


def _shippable(terms: DataFrame) -> bool:
    """Whether a vocabulary is small enough, by terms and by bytes, for every task to hold it."""
    row = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    return row["n"] <= SHIPPED_TERMS and (row["bytes"] or 0) <= SHIPPED_BYTES


def _slices(batch: pa.RecordBatch, room: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists in column 1 hold about ``room`` values, or one row."""
    lengths = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy()
    part = (np.cumsum(lengths) - lengths) // room
    ends = [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for start, end in zip([0, *ends], ends):
        yield batch.slice(start, end - start)


def _parted(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The most frequent terms, as many as may travel to the tasks, and the others."""
    # A term's idf is lower the more rows hold it. There are few different row counts: n of them need n * n / 2 pairs.
    sizes = terms.groupBy("idf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).collect()
    held = size = 0
    last = 0.0
    for row in sorted(sizes, key=lambda r: r["idf"]):
        held, size = held + row["n"], size + row["bytes"]
        if held > SHIPPED_TERMS or size > SHIPPED_BYTES:
            break
        last = row["idf"]
    return terms.filter(F.col("idf") <= last), terms.filter(F.col("idf") > last)


def _scaled(pairs: str) -> Column:
    """(term, weight) of a row, scaled to length 1."""
    length = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    # A length in a column of its own would be put into the inner function, and be summed again for every term.
    return F.transform(F.array(length), lambda n: F.transform(pairs, lambda x: F.struct(x["value"].alias("term"), (x["w"] / n).alias("weight"))))[0]


def _weighed_rows(df: DataFrame, columns: Sequence[str], text: str, terms: DataFrame, value: str) -> DataFrame:
    """``__own``, a row's ``columns``, and ``__pairs``, the (value, w) of its terms, not scaled yet and in no order.

    For a vocabulary that no task holds. Its most frequent terms, which make up nearly all pairs, are looked up inside
    the row; pairs with other terms are joined and come back to the row, bounded by the row's own terms.
    """
    frequent, rare = _parted(terms)
    table = frequent.select("term", "idf", F.col(value).alias("value")).toArrow().combine_chunks()
    arrays = tuple(pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("term", "idf", "value"))
    known = df.sparkSession.sparkContext.broadcast(arrays)
    kind = terms.schema[value].dataType.simpleString()

    @F.arrow_udf(f"value array<{kind}>, w array<double>, term array<string>, tf array<bigint>")
    def look_up(lists: pa.Array, counts: pa.Array) -> pa.Array:
        names, idf, values = known.value
        flat, tfs, owner = lists.flatten(), counts.flatten(), pc.list_parent_indices(lists).to_numpy()
        code = pc.index_in(flat, value_set=names)
        found = code.is_valid().to_numpy(zero_copy_only=False)
        inside, outside = np.flatnonzero(found), np.flatnonzero(~found)
        at = code.take(pa.array(inside))

        def listed(items: pa.Array, places: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[places], np.arange(len(lists) + 1)), pa.int32()), items)

        w = pa.array(tfs.to_numpy()[inside] * idf.to_numpy()[at.to_numpy()], pa.float64())
        left = pa.array(outside)
        parts = [listed(values.take(at), inside), listed(w, inside), listed(flat.take(left), outside), listed(tfs.take(left), outside)]
        return pa.StructArray.from_arrays(parts, names=["value", "w", "term", "tf"])

    source = _split_name(text) if _split_name(text) in df.columns else text
    own = df.select(F.struct(*columns).alias("__own"), F.monotonically_increasing_id().alias("__row"), source)
    # Written once: counted and looked up once, and the numbers of the rows do not change between the two uses.
    looked = written(row_term_counts(own, ["__own", "__row"], text).select("__own", "__row", look_up("terms", "tfs").alias("found")), "terms")
    pair = f"struct<value:{kind},w:double>"
    others = looked.select("__row", F.inline(F.arrays_zip(F.col("found.term").alias("term"), F.col("found.tf").alias("tf"))))
    others = others.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
    # Terms that are left and still stand in more than one row of RARE would each be one hot key.
    hot = F.col("idf") < math.log(RARE) + 1
    copies = rare.filter(hot).withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    parts = [others.drop("salt").join(rare.filter(~hot), "term")]
    if not rare.filter(hot).isEmpty():
        parts.append(others.join(copies, ["term", "salt"]))
    joined = [x.select("__row", F.struct(F.col(value).alias("value"), (F.col("tf") * F.col("idf")).alias("w")).cast(pair).alias("pair")) for x in parts]
    back = reduce(DataFrame.unionByName, joined).groupBy("__row").agg(F.collect_list("pair").alias("__rare"))
    first = F.arrays_zip(F.col("found.value").alias("value"), F.col("found.w").alias("w")).cast(f"array<{pair}>")
    whole = F.concat(first, F.coalesce("__rare", F.array().cast(f"array<{pair}>")))
    return looked.join(back, "__row", "left").select("__own", whole.alias("__pairs"))


def tfidf_terms(df: DataFrame, key: str, column: str, size: int | None = None) -> DataFrame:
    """Long form of the weights: ``key, term, weight``, each row of ``df`` scaled to length 1.

    All terms of a row lie in that row, so with a vocabulary that every task can hold they are
    weighed and scaled there and only the totals of terms are shuffled. Of a larger vocabulary
    the most frequent terms are weighed there, and only pairs with the others are joined.
    """
    terms = checkpoint(vocabulary(term_counts(df, key, column), df.count(), size).select("term", "idf"))
    if not _shippable(terms):
        weighed = _weighed_rows(df.select(key, F.col(column).alias("__text")), [key], "__text", terms, "term")
        return weighed.select(F.col(f"__own.{key}").alias(key), F.inline(_scaled("__pairs")))
    rows = terms.orderBy("term").collect()
    known = df.sparkSession.sparkContext.broadcast((pa.array([r["term"] for r in rows], pa.string()), np.array([r["idf"] for r in rows], float)))
    schema = T.StructType([df.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = known.value
        # A look-up numbers the whole vocabulary anew, so a slice holds several times as many terms.
        room = max(SLICE_TERMS, 4 * len(names))
        for batch in (part for whole in batches for part in _slices(whole, room)):
            lists, tfs = batch.column(1), batch.column(2).flatten().to_numpy()
            flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            code = pc.index_in(flat, value_set=names)
            keep = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            w = tfs[keep] * idf[code.take(pa.array(keep)).to_numpy()]
            length = np.sqrt(np.bincount(owner[keep], w * w, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), flat.take(pa.array(keep)), pa.array(w / length[owner[keep]])], names=schema.names)

    return row_term_counts(df, key, column).mapInArrow(weigh, schema)


class TfidfVectorizer(Estimator):
    """The same weights as sparse vectors ``{column}_tfidf`` for use in a model.

    A limited vocabulary is chosen by frequency with alphabetical ties, so it does not
    depend on partitioning. Without a limit all terms are taken. A vocabulary that not every
    task can hold stays a table: its terms are numbered there, and vectors are put together from
    joined pairs (``JoinedTfidfModel``), so it may have any size.
    """

    def __init__(self, column: str, size: int | None = None):
        super().__init__()
        self.column, self.size = column, size

    def _fit(self, df: DataFrame) -> TfidfModel | JoinedTfidfModel:
        source, count = f"__{self.column}_terms", f"__{self.column}_tf"
        if self.size is None:  # all terms: how often one occurs in a row plays no part
            counts = df.select(F.explode(F.array_distinct(_term_column(df, self.column))).alias("term"), F.lit(1).alias("tf"))
        else:
            counts = term_counts(df, [], self.column)
        terms = checkpoint(vocabulary(counts, df.count(), self.size).select("term", "idf"))
        if not _shippable(terms):
            return JoinedTfidfModel(self.column, terms)
        held = terms.count()
        if not held:
            raise ValueError(f"column {self.column!r} holds no term")
        if self.size is None:
            # All terms: counted, numbered and weighed without leaving the engine.
            tokens = df.select(_term_column(df, self.column).alias(source))
            counter = CountVectorizer(inputCol=source, outputCol=count, vocabSize=held).fit(tokens)
            idf = IDF(inputCol=count).fit(counter.transform(tokens)).idf.toArray() + 1.0
        else:
            rows = terms.orderBy("term").collect()
            counter = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol=source, outputCol=count)
            idf = np.array([r["idf"] for r in rows])
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=count, outputCol=f"__{self.column}_w")
        unit = Normalizer(p=2.0, inputCol=f"__{self.column}_w", outputCol=f"{self.column}_tfidf")
        return TfidfModel(self.column, PipelineModel([counter, weigh, unit]))


class TfidfModel(Model):
    def __init__(self, column: str, stages: PipelineModel):
        super().__init__()
        self.column, self.stages = column, stages

    @property
    def output(self) -> str:
        return f"{self.column}_tfidf"

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.column
        out = self.stages.transform(df.withColumn(f"__{c}_terms", _term_column(df, c)))
        return out.drop(f"__{c}_terms", f"__{c}_tf", f"__{c}_w")


class JoinedTfidfModel(Model):
    """The vectors of ``TfidfModel`` with a vocabulary that no task holds.

    The most frequent terms, up to ``SHIPPED_TERMS`` and ``SHIPPED_BYTES``, travel to the tasks and are
    looked up inside the rows. Only pairs with the other terms are joined with the numbered vocabulary.
    """

    def __init__(self, column: str, terms: DataFrame):
        super().__init__()
        self.column = column
        codes = dense_codes(terms, "term")
        self.terms = checkpoint(terms.join(codes.withColumnRenamed("value", "term"), "term").select("term", "idf", F.col("code").cast("int").alias("code")))
        self.size = self.terms.count()

    @property
    def output(self) -> str:
        return f"{self.column}_tfidf"

    def _transform(self, df: DataFrame) -> DataFrame:
        weighed = _weighed_rows(df, [c for c in df.columns if c != _split_name(self.column)], self.column, self.terms, "code")
        size = self.size

        # One call a row: no expression makes a sparse vector from arrays.
        @F.udf(VectorUDT())
        def vector(codes, weights):
            order, w = np.argsort(codes), np.array(weights, float)
            return Vectors.sparse(size, np.array(codes, np.int32)[order], (w / max(math.sqrt(w @ w), 1e-300))[order])

        return weighed.select("__own.*", vector("__pairs.value", "__pairs.w").alias(self.output))


def _split_name(column: str) -> str:
    return f"__{column}_split"


def _term_column(df: DataFrame, column: str) -> Column:
    return F.col(_split_name(column)) if _split_name(column) in df.columns else F.coalesce(words.terms(F.col(column)), F.array().cast("array<string>"))


def split_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the terms of texts in place of the texts, written: for term weights that are fitted and applied several times."""
    out = df.withColumns({_split_name(c): _term_column(df, c) for c in columns}).drop(*columns)
    return written(out, "split") if columns else df


# --- hashed n-grams ------------------------------------------------------------------


def hashed_stages(column: str, output: str, buckets: int = HASH_BUCKETS, n: int = 2) -> list:
    """Tokens, stop words out, n-grams, hashed counts, inverse frequency; own names per column."""
    return [
        RegexTokenizer(inputCol=column, outputCol=f"__{column}_words", pattern="\\W"),
        StopWordsRemover(inputCol=f"__{column}_words", outputCol=f"__{column}_kept"),
        NGram(n=n, inputCol=f"__{column}_kept", outputCol=f"__{column}_ngrams"),
        HashingTF(inputCol=f"__{column}_ngrams", outputCol=f"__{column}_tf", numFeatures=buckets),
        IDF(inputCol=f"__{column}_tf", outputCol=output),
    ]


def _drop_steps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[f"__{c}_{step}" for c in columns for step in ("words", "kept", "ngrams", "tf")])


def text_tfidf_hash(df: DataFrame, columns: Sequence[str], buckets: int = HASH_BUCKETS, n: int = 2) -> tuple[DataFrame, list[str]]:
    """``{column}_tfidfFeatures`` for any number of text columns, and their names."""
    outputs = [f"{c}_tfidfFeatures" for c in columns]
    stages = [stage for c, out in zip(columns, outputs) for stage in hashed_stages(c, out, buckets, n)]
    table = df.na.fill("", list(columns))
    return _drop_steps(Pipeline(stages=stages).fit(table).transform(table), columns), outputs


# --- embeddings ----------------------------------------------------------------------


class HashedEmbedder(Estimator):
    """Dense float vectors from hashed word weights, scaled to length 1.

    Stands in for a sentence model where none is installed; see ``model_embedder``.
    """

    def __init__(self, column: str, size: int = EMBEDDING_SIZE):
        super().__init__()
        self.column, self.size = column, size

    def _fit(self, df: DataFrame) -> HashedEmbedderModel:
        return self.fit_counted(self.counted(df))

    def _stages(self) -> list:
        return hashed_stages(self.column, f"__{self.column}_idf", self.size, n=1)

    def counted(self, df: DataFrame) -> DataFrame:
        """``df`` (null texts: empty) with the hashed counts of its words, from which the rest follows without the text."""
        out = PipelineModel(self._stages()[:-1]).transform(df.withColumn(self.column, F.coalesce(F.col(self.column), F.lit(""))))
        return out.drop(*[f"__{self.column}_{step}" for step in ("words", "kept", "ngrams")])

    def fit_counted(self, df: DataFrame) -> HashedEmbedderModel:
        *counting, idf = self._stages()
        unit = Normalizer(p=2.0, inputCol=f"__{self.column}_idf", outputCol=f"__{self.column}_unit")
        return HashedEmbedderModel(self.column, PipelineModel(counting), PipelineModel([idf.fit(df), unit]))


class HashedEmbedderModel(Model):
    def __init__(self, column: str, counting: Model, weighing: Model):
        super().__init__()
        self.column, self.counting, self.weighing = column, counting, weighing

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.embed(self.counting.transform(df.withColumn(self.column, F.coalesce(F.col(self.column), F.lit("")))))

    def embed(self, counted: DataFrame) -> DataFrame:
        """The embeddings of a table that has the counts; they are dropped."""
        c = self.column
        out = self.weighing.transform(counted)
        out = out.withColumn(f"{c}_embedding", vector_to_array(F.col(f"__{c}_unit"), "float32"))
        return _drop_steps(out, [c]).drop(f"__{c}_idf", f"__{c}_unit")


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """An embedding column from any sentence model.

    ``load`` runs once per Python worker and returns a function from texts to a matrix;
    texts arrive in Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            matrix = np.asarray(encode(batch.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(matrix), index=batch.index)

    return embed


def embed_text(df: DataFrame, column: str, embedder: Callable[[Column], Column] | None = None, size: int = EMBEDDING_SIZE) -> DataFrame:
    """Adds ``{column}_embedding`` as array<float>."""
    if embedder is None:
        return HashedEmbedder(column, size).fit(df).transform(df)
    return df.withColumn(f"{column}_embedding", embedder(F.col(column)))


class PcaReducer(Estimator):
    """Principal components ``{name}_PC1..`` (float) of an array<float> column.

    The vectors are centred first. Components stop at the width of the vectors; fewer
    rows than components is an error.
    """

    def __init__(self, column: str, name: str | None = None, k: int = COMPONENTS):
        super().__init__()
        self.column, self.name, self.k = column, name or column, k

    def _fit(self, df: DataFrame) -> PcaReducerModel:
        vectors_ = df.select(array_to_vector(F.col(self.column)).alias("v"))
        shape = df.select(F.size(self.column).alias("width")).agg(F.max("width").alias("width"), F.count("width").alias("n")).first()
        if not shape["n"] or shape["n"] < min(self.k, shape["width"]):
            raise ValueError(f"{shape['n']} rows are too few for {self.k} components")
        k = min(self.k, shape["width"])
        centre = VectorScaler(inputCol="v", outputCol="c", withMean=True, withStd=False)
        stages = Pipeline(stages=[centre, PCA(k=k, inputCol="c", outputCol="p")]).fit(vectors_)
        return PcaReducerModel(self.column, self.name, k, stages)


class PcaReducerModel(Model):
    def __init__(self, column: str, name: str, k: int, stages: Model):
        super().__init__()
        self.column, self.name, self.k, self.stages = column, name, k, stages

    @property
    def features(self) -> list[str]:
        return [f"{self.name}_PC{i + 1}" for i in range(self.k)]

    @property
    def explained(self) -> list[float]:
        return list(self.stages.stages[1].explainedVariance)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.stages.transform(df.withColumn("v", array_to_vector(F.col(self.column))))
        out = out.withColumn("p", vector_to_array(F.col("p"), "float32"))
        return out.select(*df.columns, *[F.col("p")[i].alias(c) for i, c in enumerate(self.features)])


def embedding_stats(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Six numbers per vector under ``{name}_{statistic}``."""
    prefix = name or column
    return df.withColumns({f"{prefix}_{stat}": value for stat, value in vectors.stats(F.col(column)).items()})


class TextFeatures(Estimator):
    """Components and vector statistics of each text column.

    With ``on_error="skip"`` a column that fails (too few rows) is logged and left out.
    """

    def __init__(
        self, columns: Sequence[str], embedder: Callable[[Column], Column] | None = None, k: int = COMPONENTS,
        size: int = EMBEDDING_SIZE, on_error: str = "raise",
    ):
        super().__init__()
        self.columns, self.embedder, self.k, self.size, self.on_error = list(columns), embedder, k, size, on_error

    def _fit(self, df: DataFrame) -> TextFeaturesModel:
        model, table = self._embedded(df.select(*self.columns))
        # The components are found in several passes; a sentence model must not run in each.
        table = table.select(*[f"{c}_embedding" for c in self.columns]).persist()
        try:
            return self._reduced(model, table)
        finally:
            table.unpersist()

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit and apply to one table; each text is embedded once, or its words are counted once."""
        if self.embedder is not None:
            model, table = self._embedded(df)
            table = checkpoint(table)
            return self._reduced(model, table).reduce(table)
        embedders = {c: HashedEmbedder(c, self.size) for c in self.columns}
        # Sparse counts are smaller than the embeddings, which follow from them at little cost in each pass.
        table = checkpoint(reduce(lambda out, e: e.counted(out), embedders.values(), df))
        models = {c: e.fit_counted(table) for c, e in embedders.items()}
        table = reduce(lambda out, m: m.embed(out), models.values(), table)
        return self._reduced(models, table).reduce(table)

    def _embedded(self, df: DataFrame) -> tuple[dict, DataFrame]:
        models = {}
        for c in self.columns:
            models[c] = HashedEmbedder(c, self.size).fit(df) if self.embedder is None else None
        return models, _embed(df, models, self.embedder)

    def _reduced(self, models: dict, table: DataFrame) -> TextFeaturesModel:
        reducers = {}
        for c in self.columns:
            try:
                reducers[c] = PcaReducer(f"{c}_embedding", c, self.k).fit(table)
            except ValueError:
                if self.on_error != "skip":
                    raise
                logger.warning("no text features for column %r", c, exc_info=True)
        return TextFeaturesModel({c: models[c] for c in reducers}, reducers, self.embedder, self.columns)


def _embed(df: DataFrame, models: dict, embedder: Callable[[Column], Column] | None) -> DataFrame:
    for c, model in models.items():
        df = model.transform(df) if model else embed_text(df, c, embedder)
    return df


class TextFeaturesModel(Model):
    def __init__(self, models: dict, reducers: dict[str, PcaReducerModel], embedder: Callable[[Column], Column] | None, columns: Sequence[str]):
        super().__init__()
        self.models, self.reducers, self.embedder, self.columns = models, reducers, embedder, list(columns)

    @property
    def features(self) -> list[str]:
        out = []
        for c, reducer in self.reducers.items():
            out += reducer.features + [f"{c}_embedding_{s}" for s in vectors.STATS]
        return out

    def reduce(self, embedded: DataFrame) -> DataFrame:
        """Components and statistics of a table that has the embeddings; they are dropped."""
        out = embedded
        for c, reducer in self.reducers.items():
            out = embedding_stats(reducer.transform(out), f"{c}_embedding")
        return out.drop(*[f"{c}_embedding" for c in self.columns])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.reduce(_embed(df, self.models, self.embedder))


def extract_text_features(df: DataFrame, columns: Sequence[str], embedder=None, k: int = COMPONENTS, size: int = EMBEDDING_SIZE, on_error: str = "raise") -> DataFrame:
    return TextFeatures(columns, embedder, k, size, on_error).fit_transform(df)
