"""Files of fixed-size records: an 8-byte ASCII number followed by float32 values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_BYTES = 8
CHUNK_BYTES = 32 << 20


def _open(path: str):
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def read_fixed_binary(spark: SparkSession, path: str, dim: int = 4096, key: str = "item_id", values: str = "image_features") -> DataFrame:
    """``key, values`` of every whole record; a truncated record at the end is left out.

    The driver learns only the lengths of the files. Record ranges of about 32 MB are
    the rows that tasks work on, so one large file is read by many tasks.
    """
    size = ID_BYTES + 4 * dim
    step = max(CHUNK_BYTES // size, 1)
    files = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / size).alias("records"))
    ranges = files.filter("records > 0").select(
        "path", "records", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.lit(step).cast("bigint"))).alias("first")
    )
    layout = np.dtype([("id", f"S{ID_BYTES}"), ("x", "<f4", (dim,))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, records, first in batch.itertuples(index=False):
                count = min(step, records - first)
                with _open(name) as file:
                    file.seek(first * size)
                    block = np.frombuffer(file.read(count * size), dtype=layout)
                yield pd.DataFrame({key: block["id"].astype("int64"), values: list(block["x"])})

    spread = ranges.repartition(max(spark.sparkContext.defaultParallelism, 1), "path", "first")
    return spread.mapInPandas(read, f"{key} bigint, {values} array<float>")
