"""Splits, folds, forests, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import model
from tablewright.operators.encode import label_index
from tablewright.operators.roles import ColumnRoles
from tablewright.plans import experiment
from tablewright.plans.prepare import StepLog, clean
from tablewright.registry import query
from tablewright.registry.corruption import CHAIN, damaged_orders
from tablewright.registry.sql import bounds, h, u
from tablewright.session import small_table

ORDER_ROLES = ColumnRoles(numerical=("o_totalprice",), categorical=("o_orderpriority",), datetime=("o_orderdate",), target=("o_orderstatus",))


def small_forest():
    return model.rf_classifier(trees=10, depth=4)


@query("train_test_split", f"SELECT o_orderkey, CASE WHEN {u('o_orderkey', 'split', 1234)} < 0.2 THEN 'test' ELSE 'train' END AS side FROM orders")
def train_test_split(t):
    train, test = model.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", 0.2)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(
    "train_test_split_exact",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {h('o_orderkey', 'split', 1234)}, o_orderkey) <= ceil(count(*) OVER () * 0.1)
               THEN 'test' ELSE 'train' END AS side FROM orders""",
)
def train_test_split_exact(t):
    train, test = model.train_test_split(t.orders.select("o_orderkey"), "o_orderkey", 0.1, exact=True)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(
    "stratified_fold",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h('o_orderkey', 'fold', 1234)}, o_orderkey) AS place,
                          count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders)
        SELECT o_orderkey, o_orderstatus, ((place > size // 5)::INT + (place > size * 2 // 5)::INT + (place > size * 3 // 5)::INT
               + (place > size * 4 // 5)::INT)::INT AS fold FROM r""",
)
def stratified_fold(t):
    return model.stratified_fold(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query(
    "stratified_fold_many",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY {h("concat_ws(':', l_orderkey, l_linenumber, o)", 'fold', 1234)}, l_orderkey, l_linenumber, o) AS place,
                          count(*) OVER (PARTITION BY l_partkey) AS size FROM (SELECT *, l_extendedprice::DECIMAL(18, 2)::VARCHAR AS o FROM lineitem))
        SELECT l_partkey, sum(size)::BIGINT AS rows, count(DISTINCT place > size // 2) AS halves FROM r GROUP BY l_partkey""",
)
def stratified_fold_many(t):
    """Two folds of every one of thousands of classes."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("o"))
    folded = model.stratified_fold(df, ["l_orderkey", "l_linenumber", "o"], "l_partkey", 2)
    return folded.groupBy("l_partkey").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("rows"), F.count_distinct("fold").alias("halves"))


@query("accuracy", "SELECT avg(((n_chars > 800)::INT = quality)::INT::DOUBLE) AS accuracy FROM documents JOIN labels USING (doc_id)")
def accuracy(t):
    df = t.documents.join(t.labels, "doc_id")
    return model.accuracy(df, (F.col("n_chars") > 800).cast("int"), "quality")


@query(
    "modeling_table",
    """SELECT o_orderstatus, o_totalprice, """
    + ", ".join(f"""o_orderpriority = '{v}' AS "o_orderpriority_{v}" """ for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    + """, year(o_orderdate)::BIGINT AS o_orderdate_year, month(o_orderdate)::BIGINT AS o_orderdate_month, day(o_orderdate)::BIGINT AS o_orderdate_day,
         (isodow(o_orderdate) - 1)::BIGINT AS o_orderdate_weekday, round(sin(2*pi()*(isodow(o_orderdate)-1)/7), 9) AS o_orderdate_weekday_sin,
         round(cos(2*pi()*(isodow(o_orderdate)-1)/7), 9) AS o_orderdate_weekday_cos FROM orders""",
)
def modeling_table(t):
    df = model.modeling_table(t.orders, ORDER_ROLES, "o_orderstatus")
    whole = {f"o_orderdate_{p}": F.col(f"o_orderdate_{p}").cast("bigint") for p in ("year", "month", "day", "weekday")}
    return df.withColumns(whole | {f"o_orderdate_{p}": F.round(f"o_orderdate_{p}", 9) for p in ("weekday_sin", "weekday_cos")})


def _vectors(t):
    """Embeddings and their ten classes: a table a forest can learn."""
    features = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    df = t.embeddings.select("vec_id", F.col("label").cast("string").alias("class"), *features)
    indexed, labels = label_index(df, "class", "label")
    return model.to_vector(indexed, [f"e{i}" for i in range(64)]).select("vec_id", "label", "features"), labels


@query("rf_classifier", f"SELECT vec_id, (dense_rank() OVER (ORDER BY label::VARCHAR) - 1)::DOUBLE AS label, true AS known FROM embeddings QUALIFY {u('vec_id', 'split', 1234)} < 0.2")
def rf_classifier(t):
    """The forest of 200 trees on the test side: which rows, their classes, and that each gets a known class."""
    df, labels = _vectors(t)
    train, test = model.train_test_split(df, "vec_id")
    scored = model.rf_classifier().fit(train).transform(test)
    known = F.col("prediction").isin([float(i) for i in range(len(labels))])
    return scored.select("vec_id", "label", known.alias("known"))


@query("grid_search_cv", "SELECT 5::BIGINT AS settings, true AS chosen, true AS best_of_all FROM embeddings GROUP BY ()")
def grid_search_cv(t):
    """Forests of 100 to 500 trees over five folds: settings scored, that a best one was chosen, and that its score is the best."""
    df, _ = _vectors(t)
    found = model.grid_search_cv(df, "vec_id", model.rf_classifier(), model.FOREST_GRID, folds=5)
    at = model.FOREST_GRID["numTrees"].index(found.params["numTrees"])
    row = (len(found.scores), found.scores[at] == max(found.scores), 1 >= found.best_score >= found.mean_score >= 0)
    return small_table(t.spark, [row], "settings bigint, chosen boolean, best_of_all boolean")


@query("rf_pipeline", "SELECT true AS cv_scored, true AS test_scored FROM documents JOIN labels USING (doc_id) GROUP BY ()")
def rf_pipeline(t):
    """Scaled numbers, indicators and term weights, then a forest: the quality label of documents."""
    df = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "lang", F.col("n_chars").cast("double").alias("n_chars"), "quality")
    roles = ColumnRoles(numerical=("n_chars",), categorical=("lang",), long_text=("text",))
    train, test = model.train_test_split(df, "doc_id")
    score = model.rf_pipeline(train, test, "doc_id", roles, "quality")
    return small_table(t.spark, [(0 <= score.cv_accuracy <= 1, 0 <= score.test_accuracy <= 1)], "cv_scored boolean, test_scored boolean")


@query("new_fit", "SELECT true AS cv_scored, true AS test_scored FROM documents JOIN labels USING (doc_id) GROUP BY ()")
def new_fit(t):
    """All features, split, search, both scores."""
    df = t.dealt("documents").join(t.labels, "doc_id").select("doc_id", "text", "lang", F.col("n_chars").cast("double").alias("n_chars"), "quality")
    roles = ColumnRoles(numerical=("n_chars",), categorical=("lang",), long_text=("text",))
    train, test = model.train_test_split(df, "doc_id")
    score = model.fit_and_score(train, test, "doc_id", roles, "quality")
    return small_table(t.spark, [(0 <= score.cv_accuracy <= 1, 0 <= score.test_accuracy <= 1)], "cv_scored boolean, test_scored boolean")


def _orders(t):
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate", "o_orderstatus")


#: Forests and folds of the experiment queries. A study at its full size (4,000 rows, 20 runs of
#: 5 folds over 200 deep trees for each variant) takes hours; ``run_experiment`` defaults to it.
LIGHT = {"trees": 5, "depth": 4}
RUN = {"sample_size": None, "repeats": 1, "folds": 2}


def _scores(variants: list[str], repeats: int = 1) -> str:
    rows = ", ".join(f"({name!r}, {run})" for run in range(repeats) for name in variants)
    return f"SELECT variant, run::INTEGER AS run, (SELECT count(*) FROM orders) > 0 AS scored FROM (VALUES {rows}) v(variant, run)"


def _run(t, variants, **options):
    scores = experiment.run_experiment(_orders(t), "o_orderkey", "o_orderstatus", variants, ORDER_ROLES, **RUN | {"estimator": small_forest} | options)
    return scores.select("variant", "run", (F.col("accuracy").between(0, 1) & F.col("cv_accuracy").between(0, 1)).alias("scored"))


MATRIX = [
    "original", "corrupted", "cleaned", "duplicates", "nulls", "outliers", "duplicates cleaned", "nulls cleaned", "outliers cleaned", "original cleaned",
]
SWEEP = [f"nulls {i / 20:.2f}" for i in range(1, 11)]


def _matrix(names: list[str] = MATRIX):
    return [v for v in experiment.variant_matrix(ORDER_ROLES, **LIGHT) if v.name in names]


@query("exp_before", _scores(["original"], 2))
def exp_before(t):
    return _run(t, [experiment.Variant("original")], repeats=2)


@query("exp_corrupted", _scores(MATRIX[1:2]))
def exp_corrupted(t):
    return _run(t, _matrix(MATRIX[1:2]))


@query("exp_cleaned", _scores(MATRIX[2:3]))
def exp_cleaned(t):
    return _run(t, _matrix(MATRIX[2:3]))


@query("exp_single", _scores(MATRIX[:3]))
def exp_single(t):
    return _run(t, _matrix(MATRIX[:3]))


@query("exp_matrix", _scores(MATRIX))
def exp_matrix(t):
    return _run(t, _matrix())


@query("exp_fraction_sweep", _scores(SWEEP))
def exp_fraction_sweep(t):
    return _run(t, experiment.fraction_sweep(ORDER_ROLES, **LIGHT))


@query(
    "step_timing",
    f"""{CHAIN}, d AS (SELECT DISTINCT o_orderkey, o_custkey, o_totalprice FROM c), {bounds('d', 'o_totalprice', 'fence')}
        SELECT 'dedupe' AS step, (SELECT count(*) FROM c) - (SELECT count(*) FROM d) AS rows_affected, true AS timed
        UNION ALL SELECT 'winsorize', count(*), true FROM d, fence WHERE o_totalprice < lo OR o_totalprice > hi""",
)
def step_timing(t):
    """Steps run, rows each of them changed, and that its seconds were taken."""
    log = StepLog()
    roles = ColumnRoles(numerical=("o_totalprice",))
    clean(damaged_orders(t), ["o_orderkey", "copy"], roles, order=("dedupe", "winsorize"), log=log, ignore=["copy"])
    return log.table(t.spark).select("step", "rows_affected", (F.col("seconds") > 0).alias("timed"))
