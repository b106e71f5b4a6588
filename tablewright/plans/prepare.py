"""Clean a table and turn it into features, with a record of every step."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.clean import Winsorizer, dedupe_rows
from tablewright.operators.impute import impute_missing
from tablewright.operators.model import modeling_table
from tablewright.operators.profile import null_count_total
from tablewright.operators.roles import ColumnRoles, classify_columns
from tablewright.session import scratch_path, small_table

logger = logging.getLogger(__name__)


@dataclass
class StepLog:
    """Seconds and rows affected per step, as a table instead of a log file."""

    rows: list[tuple[str, str | None, float, int | None]] = field(default_factory=list)

    def run(self, step: str, action: Callable[[], DataFrame], affected: Callable[[DataFrame], int] | None = None, column: str | None = None) -> DataFrame:
        started = time.perf_counter()
        out = action()
        count = affected(out) if affected else None
        seconds = time.perf_counter() - started
        logger.info("%s: %s rows in %.3f s", step, count, seconds)
        self.rows.append((step, column, seconds, count))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, self.rows, "step string, column string, seconds double, rows_affected bigint")


def clean(
    df: DataFrame, key: str | Sequence[str], roles: ColumnRoles, order: Sequence[str] = ("dedupe", "winsorize", "impute"), log: StepLog | None = None, ignore: Sequence[str] = (), **impute
) -> DataFrame:
    """Dedupe, winsorize and impute in the order asked for.

    With a ``log`` every step runs when its turn comes, once: its result is written to the
    shared folder and the next step reads that. Rows affected come from the written tables and
    from values observed during the write. Without a log, steps are lazy but for what they fit.
    """
    steps = {"dedupe": _dedupe, "winsorize": _winsorize, "impute": _impute}
    for step in order:
        if step not in steps:
            raise ValueError(f"unknown cleaning step {step!r}")
    if log is not None:
        df = _written(df, "input")
    for step in order:
        action, affected = steps[step](df, key, roles, ignore, impute)
        df = action() if log is None else log.run(step, lambda: _written(action(), step), affected)
    return df


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dedupe(df, key, roles, ignore, impute):
    return lambda: dedupe_rows(df, ignore), lambda out: df.count() - out.count()


def _winsorize(df, key, roles, ignore, impute):
    seen = Observation(f"winsorize-{uuid.uuid4().hex}")

    def action() -> DataFrame:
        model = Winsorizer(roles.numerical).fit(df)
        outside = F.lit(0)
        for c, (low, high, _) in model.bounds.items():
            outside = outside + F.when((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high)), 1).otherwise(0)
        # Narrow up to the write, so a task that is run again is counted once.
        return model.transform(df.observe(seen, F.sum(outside).alias("n")))

    return action, lambda _: seen.get["n"] or 0


def _impute(df, key, roles, ignore, impute):
    return lambda: impute_missing(df, key, roles, **impute), lambda _: null_count_total(df).first()[0]


def prepare(df: DataFrame, key: str | Sequence[str], target: str, roles: ColumnRoles | None = None, log: StepLog | None = None, **options) -> DataFrame:
    """Classify, clean and encode: the table a model is trained on."""
    keys = [key] if isinstance(key, str) else list(key)
    roles = roles or classify_columns(df.drop(*keys))
    cleaned = clean(df, key, roles, log=log, **options)
    return (log or StepLog()).run("features", lambda: modeling_table(cleaned, roles, target))
