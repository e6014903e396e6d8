"""Distances of embeddings as Column expressions.

All are computed in double precision from array<float>.  Smaller is closer:

* cosine: 1 - a.b / (|a| |b|); 1.0 when either vector is zero
* euclidean: the root of the summed squared differences
* dot: -(a.b)
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return metric


def as_vector(vector: Sequence[float] | Column) -> Column:
    """A literal vector (any sequence of numbers) or a column, as array<float>."""
    if isinstance(vector, Column):
        return vector
    # one string literal, folded to a constant array: the plan has one node for it, whatever its length
    return F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in vector) + "]"), "array<float>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def literal_norm(vector: Sequence[float]) -> Column:
    """Squared norm of a literal vector, computed once on the driver from its float32 values."""
    total = 0.0
    for x in np.asarray(vector, np.float32).tolist():
        total += x * x
    return F.lit(total)


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine distance; ``b_norm`` is b's squared norm where it is known, so that it isn't computed again for every row."""
    norms = F.sqrt(squared_norm(a) * (squared_norm(b) if b_norm is None else b_norm))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def distance(a: Column, b: Column, metric: str = "cosine", b_norm: Column | None = None) -> Column:
    """Distance of two array columns; ``ValueError`` for an unknown metric."""
    if check_metric(metric) == "cosine":
        return cosine(a, b, b_norm)
    return euclidean(a, b) if metric == "euclidean" else -dot(a, b)
