import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from tablewright.operators import model
from tablewright.operators.clean import Winsorizer
from tablewright.operators.encode import CategoricalEncoder, DatetimeEncoder
from tablewright.operators.roles import ColumnRoles
from tablewright.operators.text import model_embedder
from tablewright.plans import experiment
from tablewright.plans.prepare import StepLog, clean, prepare
from tablewright.streaming import apply_models

ROLES = ColumnRoles(numerical=("x",), categorical=("c",), target=("y",))


@pytest.fixture(scope="module")
def table(spark):
    number = (F.col("id") * 37) % 100
    return spark.range(600).select(
        "id", number.cast("double").alias("x"), F.when(number % 2 == 0, "even").otherwise("odd").alias("c"), F.when(number > 40, "big").otherwise("small").alias("y")
    )


def forest():
    return model.rf_classifier(trees=5, depth=4)


def test_split_is_stable_and_complete(table):
    train, test = model.train_test_split(table, "id", 0.2)
    again = model.train_test_split(table.repartition(50), "id", 0.2)[1]
    assert train.count() + test.count() == 600
    assert {r["id"] for r in test.collect()} == {r["id"] for r in again.collect()}
    assert model.train_test_split(table, "id", 0.15, exact=True)[1].count() == 90


def test_folds_are_even_in_every_class(table):
    counts = model.stratified_fold(table, "id", "y", 5).groupBy("y", "fold").count().collect()
    for y in ("big", "small"):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_features_come_from_train_rows_and_leak_nothing(table):
    roles = ROLES.replace(categorical=("c", "y"))
    fitted = model.ModelingTable(roles, "y").fit(table)
    assert fitted.features == ["x", "c_even", "c_odd"]
    assert not [c for c in fitted.transform(table).columns if c.startswith("y_")]


def test_fit_and_score_learns(table):
    train, test = model.train_test_split(table, "id")
    score = model.fit_and_score(train, test, "id", ROLES, "y", forest(), {"maxDepth": [1, 4]}, folds=3)
    assert score.test_accuracy > 0.95 and score.cv_accuracy > 0.95
    assert score.search.params["maxDepth"] in (1, 4) and score.search.mean_score <= score.search.best_score


def test_a_text_is_embedded_once_where_it_is_fitted_and_once_where_it_is_applied(spark, table):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            calls.add(len(texts))
            return np.array([[len(x), x.count("a"), x.count("b")] for x in texts], float).reshape(len(texts), 3)

        return encode

    texts = table.select("id", "x", "y", F.concat(F.col("y"), F.repeat(F.lit("a"), (F.col("id") % 7).cast("int"))).alias("t"))
    train, test = model.train_test_split(texts, "id")
    score = model.fit_and_score(train, test, "id", ColumnRoles(numerical=("x",), long_text=("t",)), "y", forest(), folds=2, text_components=2, embedder=model_embedder(load))
    assert score.test_accuracy > 0.95
    assert calls.value == 2 * train.count() + test.count()


def test_baseline_learns(table):
    train, test = model.train_test_split(table.withColumn("t", F.concat(F.col("c"), F.lit(" "), F.col("y"), F.lit("ish"))), "id")
    score = model.rf_pipeline(train, test, "id", ROLES.replace(short_text=("t",)), "y", trees=5, depth=4, folds=3)
    assert score.test_accuracy > 0.95


def test_the_texts_of_a_baseline_are_split_once_for_all_folds(table, monkeypatch):
    split, made = [], model.split_once
    monkeypatch.setattr(model, "split_once", lambda df, columns: split.append(made(df, columns)) or split[-1])
    train, test = model.train_test_split(table.withColumn("t", F.concat(F.col("c"), F.lit(" "), F.col("y"), F.lit("ish"))), "id")
    score = model.rf_pipeline(train, test, "id", ROLES.replace(short_text=("t",)), "y", trees=5, depth=4, folds=3)
    assert score.test_accuracy > 0.95 and len(split) == 1
    assert "t" not in split[0].columns and dict(split[0].dtypes)["__t_split"] == "array<string>"


def test_terms_of_the_other_folds_have_no_part_in_a_fit(spark, monkeypatch):
    seen = []
    fit = model.TfidfVectorizer._fit

    def spied(self, df):
        out = fit(self, df)
        seen.append(set(out.stages.stages[0].vocabulary))
        return out

    monkeypatch.setattr(model.TfidfVectorizer, "_fit", spied)
    df = spark.createDataFrame([(i, f"word{i} {'good' if i % 2 else 'bad'}", "ab"[i % 2]) for i in range(60)], "id long, t string, y string")
    train, test = df.filter("id < 50"), df.filter("id >= 50")
    model.rf_pipeline(train, test, "id", ColumnRoles(short_text=("t",), target="y"), "y", trees=3, depth=3, folds=5)
    # Five fits on four fifths of the train rows, one on all of them; never the test rows.
    own = [len([w for w in words if w.startswith("word")]) for words in seen]
    assert sorted(own) == [40] * 5 + [50]
    assert all(int(w[4:]) < 50 for words in seen for w in words if w.startswith("word"))


def test_experiment_scores_every_variant_on_the_same_rows(table):
    variants = experiment.variant_matrix(ROLES, ratio=0.1, trees=5, depth=3)
    assert [v.name for v in variants] == [
        "original", "corrupted", "cleaned", "duplicates", "nulls", "outliers", "duplicates cleaned", "nulls cleaned", "outliers cleaned", "original cleaned",
    ]
    out = experiment.run_experiment(table, "id", "y", [variants[0], variants[2]], ROLES, 400, 2, estimator=forest, folds=2)
    got = [(r["variant"], r["run"]) for r in out.collect()]
    assert got == [("original", 0), ("cleaned", 0), ("original", 1), ("cleaned", 1)]
    assert out.filter("accuracy < 0.5 or accuracy > 1").count() == 0
    assert len(experiment.fraction_sweep(ROLES)) == 10


def test_steps_of_an_experiment_run_once_for_all_variants_that_share_them(spark, table):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    damage = (lambda df, keys, seed: df.mapInPandas(seen, df.schema), experiment.nulls(ROLES, 0.1))
    repair = (experiment.clamp(["x"]), experiment.impute(ROLES, trees=3, depth=2))
    variants = [experiment.Variant("damaged", damage), experiment.Variant("repaired", damage, repair)]
    out = experiment.run_experiment(table, "id", "y", variants, ROLES, None, 1, estimator=forest, folds=2)
    assert [r["variant"] for r in out.collect()] == ["damaged", "repaired"]
    train, _ = model.train_test_split(table, "id", experiment.TEST_SHARE)
    assert calls.value == train.count()


def test_tables_of_an_experiment_are_held_on_disk(spark, table, monkeypatch):
    levels, persist = [], type(table).persist
    monkeypatch.setattr(type(table), "persist", lambda self, *a: levels.append(a) or persist(self, *a))
    variant = experiment.Variant("nulls cleaned", (experiment.nulls(ROLES, 0.1),), (experiment.impute(ROLES, trees=3, depth=2),))
    out = experiment.run_experiment(table, "id", "y", [variant], ROLES, None, 1, estimator=forest, folds=2)
    assert out.count() == 1 and len(levels) >= 3 and all(x == (StorageLevel.DISK_ONLY,) for x in levels)


def test_damage_changes_the_train_side_only(table):
    keys = ["id"]
    out = experiment._apply(table, keys, experiment.variant_matrix(ROLES)[1].corruptions, 7)
    assert out.count() > 600 and out.filter("x is null or c is null").count() > 0


def test_preparation_records_its_steps(spark, table):
    dirty = table.withColumn("x", F.when(F.col("id") % 50 > 0, F.col("x"))).unionByName(table.filter("id = 7"))
    log = StepLog()
    out = prepare(dirty, "id", "y", ROLES, log, trees=5, depth=3)
    steps = {r["step"]: r["rows_affected"] for r in log.table(spark).collect()}
    assert steps == {"dedupe": 1, "winsorize": 0, "impute": 12, "features": None}
    assert out.columns == ["x", "c_even", "c_odd", "y"] and out.filter("x is null").count() == 0 and out.count() == 600


def test_logged_steps_run_once(spark, table):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    watched = table.unionByName(table.filter("id = 7")).withColumn("x", F.when(F.col("id") == 3, 1e6).otherwise(F.col("x"))).mapInPandas(seen, table.schema)
    log = StepLog()
    out = clean(watched, "id", ROLES, order=("dedupe", "winsorize"), log=log)
    rows = {r["step"]: (r["rows_affected"], r["seconds"] > 0) for r in log.table(spark).collect()}
    assert rows == {"dedupe": (1, True), "winsorize": (1, True)} and out.count() == 600
    assert calls.value == 601
    with pytest.raises(ValueError, match="unknown"):
        clean(table, "id", ROLES, order=("polish",))


def test_fitted_models_work_on_a_stream(spark, table, tmp_path):
    batch = table.select("id", "x", "c", F.lit("02 28, 2014").alias("d"))
    models = [m.fit(batch) for m in (Winsorizer(["x"]), CategoricalEncoder(["c"]), DatetimeEncoder(["d"]))]
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = apply_models(stream, models).writeStream.format("memory").queryName("streamed").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(repr, spark.table("streamed").collect())) == sorted(map(repr, apply_models(batch, models).collect()))
