"""Splits, folds, forests, scaled baseline, search by cross-validation, scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.hashing import HASH_BITS, hash52
from tablewright.operators.encode import CategoricalEncoder, DatetimeEncoder, IndicatorVector, StandardScaler, label_index
from tablewright.operators.forest import ForestClassifier
from tablewright.operators.relational import drop_prefixed
from tablewright.operators.roles import ColumnRoles
from tablewright.operators.selection import Draw, exact_draws
from tablewright.operators.text import TextFeatures, TextFeaturesModel, TfidfVectorizer, split_once
from tablewright.session import written

# Fixed values of the models.
FOREST_TREES = 200
FOREST_GRID = {"numTrees": [100, 200, 300, 400, 500]}  # a search is over these
BASELINE_TREES, BASELINE_DEPTH = 50, 10
FOLDS = 5
TEST_SHARE = 0.2
SPLIT_SEED = 1234
FOLD_BITS = 12  # slices of the hash range that spread a class: 4096
DEEPEST = 30  # the deepest tree Spark grows; the forests it stands for have no limit
SHALLOW = 10  # trees up to here have few nodes, and Spark's own forest grows them well


def train_test_split(df: DataFrame, key, test_size: float = TEST_SHARE, seed: int = SPLIT_SEED, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by hash. A row stays on its side however the table is stored.

    ``exact`` puts exactly the whole part of rows x size, rounded up, into the test side.
    """
    if exact:
        test = exact_draws(df, key, [Draw("split", lambda n, _: -int(-n * test_size // 1))], seed)["split"]
    else:
        test = hash52(key, "split", seed) < F.lit(int(test_size * (1 << HASH_BITS)))
    return df.filter(~test), df.filter(test)


def stratified_fold(df: DataFrame, key, label: str, folds: int = FOLDS, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``fold``: every class is cut into ``folds`` parts whose sizes differ by one at most.

    A row's place in its class is its place in a slice of the hash range plus the rows of the
    class in earlier slices, so any number of classes costs one shuffle, and a class that holds
    most rows is spread over all of its slices. Rows without a class are in fold 0.
    """
    keys = [key] if isinstance(key, str) else list(key)
    sliced = df.withColumn("__h", hash52(keys, "fold", seed)).withColumn("__slice", F.shiftright("__h", HASH_BITS - FOLD_BITS))
    counts = sliced.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("__class"), F.col("__slice").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    of_class = Window.partitionBy("__class")
    earlier = F.sum("__n").over(of_class.orderBy("__of").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    slices = counts.select("__class", "__of", earlier.alias("__before"), F.sum("__n").over(of_class).alias("__size"))
    placed = sliced.join(slices, (F.col(label) == F.col("__class")) & (F.col("__slice") == F.col("__of")), "left")
    place = F.col("__before") + F.row_number().over(Window.partitionBy(label, "__slice").orderBy("__h", *keys))
    fold = F.lit(0)
    for i in range(1, folds):
        fold = fold + F.when(F.col("__place") > F.floor(F.col("__size") * i / folds), 1).otherwise(0)
    return placed.withColumn("__place", place).withColumn("fold", fold.cast("int")).select(*df.columns, "fold")


def accuracy(df: DataFrame, prediction: str | Column, label: str | Column) -> DataFrame:
    """Share of rows whose two values are equal."""
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    a = F.col(label) if isinstance(label, str) else label
    return df.agg(F.avg((p == a).cast("double")).alias("accuracy"))


def rf_classifier(trees: int = FOREST_TREES, depth: int = DEEPEST, seed: int = SPLIT_SEED, **params) -> Estimator:
    """Gini forest over bootstrap samples, square root of the features per split.

    Shallow trees, and any with further parameters of Spark's forest, are Spark's.
    """
    if depth > SHALLOW and not params:
        return ForestClassifier(trees, depth, seed)
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth,
        impurity="gini", featureSubsetStrategy="sqrt", seed=seed, **params,
    )


@dataclass(frozen=True)
class SearchResult:
    model: Model
    params: dict
    best_score: float
    mean_score: float
    scores: tuple[float, ...] = ()  # of each setting


def grid_search_cv(
    df: DataFrame, key, estimator: Estimator, grid: Mapping[str, Sequence] | None = None, folds: int = FOLDS, seed: int = SPLIT_SEED, parallelism: int = 2
) -> SearchResult:
    """Best of a parameter grid by mean accuracy over stratified folds, refitted on all rows.

    ``grid`` maps parameter names of the last stage to values. ``df`` has ``label``.
    """
    learner = estimator.getStages()[-1] if isinstance(estimator, Pipeline) else estimator
    builder = ParamGridBuilder()
    for name, values in (grid or {}).items():
        builder = builder.addGrid(learner.getParam(name), list(values))
    settings = builder.build()
    # Every fold reads the features again, the stages of a pipeline many times. Forests hold what they pass over themselves,
    # so the table is kept out of the executors' memory: several searches may run at a time.
    kept = StorageLevel.MEMORY_AND_DISK_DESER if isinstance(estimator, Pipeline) else StorageLevel.DISK_ONLY
    table = stratified_fold(df, key, "label", folds, seed).persist(kept)

    def score(fold: int) -> list[float]:
        train, held = table.filter(F.col("fold") != fold), table.filter(F.col("fold") == fold)
        judge, scores = MulticlassClassificationEvaluator(metricName="accuracy"), [0.0] * len(settings)
        for i, fitted in estimator.fitMultiple(train, settings):
            scores[i] = judge.evaluate(fitted.transform(held, settings[i]))
        return scores

    def refit(i: int) -> Model:
        return estimator.fit(table, settings[i])

    # Folds do not wait for each other, nor the last fit for them if there is nothing to choose.
    threaded = inheritable_thread_target(df.sparkSession)
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            jobs = [pool.submit(threaded(score), fold) for fold in range(folds)]
            last = pool.submit(threaded(refit), 0) if len(settings) == 1 else None
            by_fold = [job.result() for job in jobs]
            scores = [sum(of) / folds for of in zip(*by_fold)]
            best = max(range(len(scores)), key=lambda i: scores[i])
            model = last.result() if last else refit(best)
    finally:
        table.unpersist()
    chosen = {p.name: v for p, v in settings[best].items()}
    return SearchResult(model, chosen, scores[best], sum(scores) / len(scores), tuple(scores))


class ModelingTable(Estimator):
    """All features of a table: numbers as they are, encoded categories, date parts, text.

    Fitted on one table and applied to others, so test rows never shape the dictionaries.
    """

    def __init__(self, roles: ColumnRoles, target: str, text_components: int = 100, embedding_size: int = 384, embedder=None, on_error: str = "skip"):
        super().__init__()
        self.roles, self.target, self.on_error = roles, target, on_error
        self.text_components, self.embedding_size, self.embedder = text_components, embedding_size, embedder

    def _fit(self, df: DataFrame) -> ModelingTableModel:
        r = self.roles
        parts: list[Model] = []
        if r.categorical:
            parts.append(CategoricalEncoder(r.categorical, on_error=self.on_error).fit(df))
        if r.datetime:
            parts.append(DatetimeEncoder(r.datetime, on_error=self.on_error).fit(df))
        if r.text:
            parts.append(TextFeatures(r.text, self.embedder, self.text_components, self.embedding_size, self.on_error).fit(df))
        names = [c for c in r.numerical if c != self.target]
        names += [f for part in parts for f in part.features if not f.startswith(f"{self.target}_")]
        return ModelingTableModel(self.target, names, parts)


class ModelingTableModel(Model):
    def __init__(self, target: str, features: list[str], parts: list[Model]):
        super().__init__()
        self.target, self.features, self.parts = target, features, parts

    @property
    def embeds(self) -> bool:
        return any(isinstance(part, TextFeaturesModel) and part.features for part in self.parts)

    def _transform(self, df: DataFrame) -> DataFrame:
        for part in self.parts:
            df = part.transform(df)
        return drop_prefixed(df, self.target)


def modeling_table(df: DataFrame, roles: ColumnRoles, target: str, **options) -> DataFrame:
    """The features of ``ModelingTable`` and the target, nothing else."""
    model = ModelingTable(roles, target, **options).fit(df)
    return model.transform(df).select(*model.features, target)


def to_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as one vector; rows with a null among them cannot be scored and are left out."""
    whole = df.na.drop("any", subset=list(features))
    table = whole.withColumns({c: F.col(c).cast("double") for c in features if whole.schema[c].dataType.simpleString() != "vector"}) if features else whole
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(table)


@dataclass(frozen=True)
class Score:
    cv_accuracy: float
    test_accuracy: float
    search: SearchResult


def _made(table: ModelingTableModel, df: DataFrame, more: Sequence[str]) -> DataFrame:
    """The features of ``table`` and the columns ``more``; those of texts are written.

    A test of the features for nulls is pushed below them, and would embed and reduce a text once for each component.
    """
    made = table.transform(df).select(*dict.fromkeys([*more, *table.features]))
    return written(made, "features") if table.embeds else made


def fit_and_score(
    train: DataFrame, test: DataFrame, key, roles: ColumnRoles, target: str, estimator: Estimator | None = None,
    grid: Mapping[str, Sequence] | None = None, folds: int = FOLDS, seed: int = SPLIT_SEED, parallelism: int = 2, **options,
) -> Score:
    """Features from the train rows, search by cross-validation, accuracy on the test rows."""
    keys = [key] if isinstance(key, str) else list(key)
    wanted = train.filter(F.col(target).isNotNull()).withColumn("__label", F.col(target).cast("string"))
    table = ModelingTable(roles, target, **options).fit(wanted)
    indexed, classes = label_index(wanted, "__label", "label")
    features = to_vector(_made(table, indexed, [*keys, "label"]), table.features).select(*keys, "label", "features")
    search = grid_search_cv(features, keys, estimator or rf_classifier(seed=seed), grid, folds, seed, parallelism)
    known = test.filter(F.col(target).isNotNull()).withColumn("__label", F.col(target).cast("string"))
    scored = search.model.transform(to_vector(_made(table, known, ["__label"]), table.features))
    names = F.array(*[F.lit(c) for c in classes])
    named = scored.select(F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("p"), F.col("__label").alias("a"))
    return Score(search.best_score, accuracy(named, "p", "a").first()["accuracy"], search)


def baseline_stages(roles: ColumnRoles, target: str) -> list:
    """Scaled numbers, indicators for all categories and term weights of each text, as one vector."""
    categories = [c for c in roles.categorical if c != target]
    stages: list = [StandardScaler(roles.numerical)] if roles.numerical else []
    stages += [IndicatorVector(c) for c in categories] + [TfidfVectorizer(c) for c in roles.text]
    names = [f"{c}_scaled" for c in roles.numerical] + [f"{c}_vector" for c in categories] + [f"{c}_tfidf" for c in roles.text]
    return [*stages, VectorAssembler(inputCols=names, outputCol="features")]


def rf_pipeline(
    train: DataFrame, test: DataFrame, key, roles: ColumnRoles, target: str, trees: int = BASELINE_TREES, depth: int = BASELINE_DEPTH, folds: int = FOLDS, seed: int = SPLIT_SEED
) -> Score:
    """Scale, indicate, weigh terms, then a forest, searched as one pipeline.

    The scales, categories and term weights of a fold come from its own train rows only.
    Rows without a number have no features and are left out on both sides.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def whole(df: DataFrame) -> DataFrame:
        known = df.filter(F.col(target).isNotNull()).na.drop("any", subset=list(roles.numerical)) if roles.numerical else df.filter(F.col(target).isNotNull())
        return known.withColumn("__label", F.col(target).cast("string"))

    columns = [*keys, *roles.numerical, *[c for c in roles.categorical if c != target], *roles.text]
    indexed, classes = label_index(whole(train), "__label", "label")
    # Spark's forest makes every row dense: with all terms as features that is megabytes a row.
    pipeline = Pipeline(stages=[*baseline_stages(roles, target), ForestClassifier(trees, depth, seed)])
    # Each fold counts and weighs the terms of its own rows; the texts are split once for all of them.
    table = split_once(indexed.select(*dict.fromkeys([*columns, "label"])), [c for c in roles.text if c not in keys])
    search = grid_search_cv(table, keys, pipeline, None, folds, seed)
    scored = search.model.transform(whole(test))
    values = F.array(*[F.lit(c) for c in classes])
    named = scored.select(F.element_at(values, (F.col("prediction") + 1).cast("int")).alias("p"), F.col("__label").alias("a"))
    return Score(search.best_score, accuracy(named, "p", "a").first()["accuracy"], search)
