"""How much damage costs and repair recovers, over repeated samples.

Each run draws a sample and splits it. A variant damages and repairs the train side,
a model is fitted on what comes out, and every variant is scored on the same untouched
test rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from tablewright.operators import clean, corrupt
from tablewright.operators.impute import impute_missing
from tablewright.operators.model import SPLIT_SEED, fit_and_score, rf_classifier, train_test_split
from tablewright.operators.roles import ColumnRoles, classify_columns
from tablewright.operators.selection import sample_n
from tablewright.session import small_table, written

COPY = "__copy"
SAMPLE_SIZE, REPEATS, TEST_SHARE = 4000, 20, 0.1  # fixed values of the experiment

# A step is given the table, the names that identify its rows, and the seed of the run.
Step = Callable[[DataFrame, list[str], int], DataFrame]


@dataclass(frozen=True)
class Variant:
    name: str
    corruptions: tuple[Step, ...] = ()
    cleaners: tuple[Step, ...] = ()


def duplicates(n: int | None = None) -> Step:
    return lambda df, keys, seed: corrupt.insert_duplicates(df, keys, n, seed, copy=COPY)


def nulls(roles: ColumnRoles, ratio: float = corrupt.NULL_RATIO) -> Step:
    return lambda df, keys, seed: corrupt.introduce_nulls(df, keys, roles, ratio, seed)


def outliers(columns: Sequence[str], n: int | None = None) -> Step:
    return lambda df, keys, seed: corrupt.introduce_outliers(df, keys, columns, n, seed)


def drop_duplicates() -> Step:
    return lambda df, keys, seed: clean.dedupe_rows(df, ignore=[COPY])


def impute(roles: ColumnRoles, **options) -> Step:
    return lambda df, keys, seed: impute_missing(df, keys, roles, seed=seed, **options)


def clamp(columns: Sequence[str]) -> Step:
    return lambda df, keys, seed: clean.winsorize(df, columns)


def _apply(df: DataFrame, key: list[str], steps: Sequence[Step], seed: int) -> DataFrame:
    """Each step is written: the next one passes over its rows several times, and would else run all earlier ones again."""
    for i, step in enumerate(steps):
        keys = key + ([COPY] if COPY in df.columns else [])
        df = written(step(df, keys, seed + i), "step")
    return df


def variant_matrix(roles: ColumnRoles, ratio: float = corrupt.NULL_RATIO, **options) -> list[Variant]:
    """Original, all damage, damage repaired, each damage alone and repaired, repair alone.

    Dates are damaged but not imputed here: rows that still lack one cannot be used to fit.
    """
    damage = {"duplicates": duplicates(), "nulls": nulls(roles, ratio), "outliers": outliers(roles.numerical)}
    fill = impute(roles.replace(datetime=()), **options)
    repair = {"duplicates": drop_duplicates(), "nulls": fill, "outliers": clamp(roles.numerical)}
    every, fixes = tuple(damage.values()), tuple(repair.values())
    out = [Variant("original"), Variant("corrupted", every), Variant("cleaned", every, fixes)]
    out += [Variant(name, (step,)) for name, step in damage.items()]
    out += [Variant(f"{name} cleaned", (damage[name],), (repair[name],)) for name in damage]
    return out + [Variant("original cleaned", (), fixes)]


def fraction_sweep(roles: ColumnRoles, ratios: Sequence[float] = tuple(i / 20 for i in range(1, 11)), **options) -> list[Variant]:
    """Rising shares of nulls, each repaired by imputation."""
    fill = impute(roles.replace(datetime=()), **options)
    return [Variant(f"nulls {r:.2f}", (nulls(roles, r),), (fill,)) for r in ratios]


def run_experiment(
    df: DataFrame, key: str | Sequence[str], target: str, variants: Sequence[Variant], roles: ColumnRoles | None = None,
    sample_size: int | None = SAMPLE_SIZE, repeats: int = REPEATS, seed: int = 0, estimator: Callable[[], Estimator] | None = None,
    folds: int = 5, parallelism: int = 4, **options,
) -> DataFrame:
    """``variant, run, accuracy, cv_accuracy`` for every variant and run.

    Variants of a run are independent: up to ``parallelism`` of them are submitted at a time.
    Variants with the same damage share one damaged table.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    roles = roles or classify_columns(df.drop(*keys), mode="strict", target=[target])

    def score(variant: Variant, run: int, damaged: DataFrame, test: DataFrame) -> tuple[str, int, float, float]:
        repaired = _apply(damaged, keys, variant.cleaners, seed + 1000 * run)
        row_key = keys + ([COPY] if COPY in repaired.columns else [])
        # Variants run side by side already: their folds, each with tables of its own in memory, do not.
        found = fit_and_score(repaired, test, row_key, roles, target, (estimator or rf_classifier)(), folds=folds, parallelism=1, **options)
        return variant.name, run, found.test_accuracy, found.cv_accuracy

    results = []
    with ThreadPoolExecutor(parallelism) as pool:
        for run in range(repeats):
            data = df if sample_size is None else sample_n(df, keys, sample_size, seed + run, "experiment")
            train, test = [written(side, "side") for side in train_test_split(data, keys, TEST_SHARE, SPLIT_SEED + run)]
            apart = dict.fromkeys(v.corruptions for v in variants)
            made = {steps: pool.submit(inheritable_thread_target(spark)(_apply), train, keys, steps, seed + 1000 * run) for steps in apart}
            damaged = {steps: job.result() for steps, job in made.items()}
            jobs = [pool.submit(inheritable_thread_target(spark)(score), v, run, damaged[v.corruptions], test) for v in variants]
            results += [job.result() for job in jobs]
    return small_table(spark, results, "variant string, run int, accuracy double, cv_accuracy double")
