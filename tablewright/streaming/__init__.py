"""Fitted models on streams.

Nothing here is a streaming job of its own: fit on a batch table, then apply the model
to ``readStream`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame


def apply_models(stream: DataFrame, models: Sequence[Model]) -> DataFrame:
    """Apply fitted row-wise models in order.

    Winsorizing, fills, encoders, date parts and scalers only project. A category encoder
    whose dictionary is a table makes a stream-static join, which streams allow as well.
    """
    for model in models:
        stream = model.transform(stream)
    return stream
