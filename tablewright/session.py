"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator expects; extra settings by keyword or dict."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Timestamps are naive wall-clock values here, so the session runs in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A table of a few computed rows, held in the plan: reading it starts no Python task."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = pd.DataFrame(list(rows), columns=fields.names, dtype=object)
    return spark.createDataFrame(table, fields)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    On a local master that names none (a laptop, the tests) a temporary folder is made for
    this session and removed when Python ends. On a cluster every executor would write to a
    disk of its own, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    active = spark.sparkContext.getCheckpointDir()
    if active is None:
        if folder is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or _temporary())
        active = spark.sparkContext.getCheckpointDir()
    return folder or active


def _temporary() -> str:
    folder = tempfile.mkdtemp(prefix="tablewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and go on from there: smaller than a checkpoint, and read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}/{name}"
