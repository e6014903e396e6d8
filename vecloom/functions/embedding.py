"""Embedding columns from a user's model, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_embedding(df: DataFrame, load: Callable[[], Callable[[list], Sequence[Sequence[float]]]], dim: int, *, input_col: str, out: str = "embedding") -> DataFrame:
    """``df`` with array<float> ``out``: ``load`` runs once in a worker and
    returns a function from a list of inputs to as many vectors.  Null inputs
    have null vectors; a vector of another length than ``dim`` fails the job.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            known = batch.notna()
            vectors = [np.asarray(v, np.float32) for v in model(batch[known].tolist())] if known.any() else []
            if any(v.shape != (dim,) for v in vectors):
                raise ValueError(f"the model gave a vector of another length than {dim}")
            result = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for i, v in zip(batch.index[known], vectors):
                result[i] = v
            yield result

    return df.withColumn(out, embed(F.col(input_col)))
