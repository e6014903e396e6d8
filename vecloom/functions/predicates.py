"""Filter specifications as Column predicates.

A specification is None (all rows), a condition ``{"field", "op", "value"}``,
a list of conditions (all must hold; an empty list holds), a Column, or a
Python callable on the row's metadata as a dict.  Ops: eq, ne, gt, gte, lt,
lte, in.

Metadata lives in a struct column, a VARIANT column, or the table's own
columns.  Comparisons follow Python's rules for the compared types: a missing
or null field never matches; values of different kinds are different, and have
no order; a number equals a boolean as 1 or 0; NaN is different from all.
``in`` with a string value tests for a substring, with a dict its keys.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in")
_ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def conditions(spec: Any) -> list[tuple[str, str, Any]]:
    """Checked (field, op, value) triples of a dict or list; ``ValueError`` for anything else."""
    if isinstance(spec, dict):
        spec = [spec]
    elif not isinstance(spec, list):
        raise ValueError(f"a filter is a condition, a list of them, a Column, a callable or None, not {type(spec).__name__}")
    out = []
    for c in spec:
        if not isinstance(c, dict) or not c.get("field") or not c.get("op"):
            raise ValueError(f"a condition needs 'field' and 'op': {c!r}")
        if c["op"] not in OPS:
            raise ValueError(f"unknown op {c['op']!r}; known: {', '.join(OPS)}")
        out.append((c["field"], c["op"], c.get("value")))
    return out


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "other"


def _compare(col: Column, kind: str, floating: bool, op: str, value: Any) -> Column:
    """One op on a column of a known kind; null in, null (no match) out."""
    present = col.isNotNull()
    if op == "in":
        if isinstance(value, str):
            return F.lit(value).contains(col) if kind == "string" else F.lit(False)
        members = list(value) if isinstance(value, (list, tuple, set, frozenset, dict)) else []
        hits = [_compare(col, kind, floating, "eq", v) for v in members if v is not None]
        return functools.reduce(operator.or_, hits, F.lit(False)) & present
    if value is None:
        return present if op == "ne" else F.lit(False)
    mine = _kind(value)
    nan_value = isinstance(value, float) and math.isnan(value)
    if {kind, mine} <= {"number", "bool"}:
        left = col.cast("int") if kind == "bool" else col
        right = F.lit(int(value) if mine == "bool" else value)
        unequal = F.isnan(col) if floating else None
    elif kind == mine == "string":
        left, right, unequal = col, F.lit(value), None
    else:
        return present if op == "ne" else F.lit(False)
    if nan_value:
        return present if op == "ne" else F.lit(False)
    if op == "eq":
        return left == right
    if op == "ne":
        return (left != right) if unequal is None else (left != right) | (present & unequal)
    ordered = _ORDER[op](left, right)
    return ordered if unequal is None else ordered & ~unequal


def _typed(col: Column, kind: T.DataType, op: str, value: Any) -> Column:
    name = "number" if isinstance(kind, T.NumericType) else "bool" if isinstance(kind, T.BooleanType) else "string" if isinstance(kind, T.StringType) else "other"
    return _compare(col, name, isinstance(kind, (T.FloatType, T.DoubleType)), op, value)


def _variant(col: Column, field: str, op: str, value: Any) -> Column:
    """An op on a top-level key of a VARIANT: the stored type decides, never a cast from another."""
    path = "$[" + json.dumps(field) + "]"
    item = F.try_variant_get(col, path, "variant")
    stored = F.schema_of_variant(item)
    cases = []
    for name, test, as_type in (
        ("number", stored.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), "double"),
        ("string", stored == "STRING", "string"), ("bool", stored == "BOOLEAN", "boolean"),
    ):
        cases.append((test, _compare(F.try_variant_get(col, path, as_type), name, name == "number", op, value)))
    known = F.when(cases[0][0], cases[0][1]).when(cases[1][0], cases[1][1]).when(cases[2][0], cases[2][1])
    absent = item.isNull() | (stored == "VOID")
    return F.when(absent, F.lit(False)).otherwise(F.coalesce(known.otherwise(F.lit(op == "ne")), F.lit(False)))


def _callable(fn: Callable[[dict], bool], df: DataFrame, metadata: str | None) -> Column:
    names = df.columns if metadata is None else [metadata]
    variant = metadata is not None and isinstance(df.schema[metadata].dataType, T.VariantType)

    @F.pandas_udf("boolean")
    def keep(rows: pd.Series) -> pd.Series:
        return rows.map(lambda text: bool(fn(json.loads(text) if text else {})))

    body = F.struct(*[F.col(f"`{n}`") for n in names]) if metadata is None else F.col(metadata)
    return keep(F.to_json(body) if not variant else F.col(metadata).cast("string"))


def compile_filter(spec: Any, df: DataFrame, metadata: str | None = "metadata") -> Column | None:
    """A predicate on ``df`` for a specification, or None for no filter.

    ``metadata`` names the struct or VARIANT column that holds the fields;
    None means the fields are columns of ``df``.  A field that a struct or the
    table lacks is missing in all rows.
    """
    if spec is None or isinstance(spec, Column):
        return spec
    if callable(spec):
        return _callable(spec, df, metadata)
    made = []
    for field, op, value in conditions(spec):
        if metadata is None:
            home, prefix = df.schema, ""
        else:
            home, prefix = df.schema[metadata].dataType, f"`{metadata}`."
        if isinstance(home, T.VariantType):
            made.append(_variant(F.col(metadata), field, op, value))
        elif isinstance(home, T.StructType) and field in home.names:
            made.append(_typed(F.col(f"{prefix}`{field}`"), home[field].dataType, op, value))
        else:
            made.append(F.lit(False))
    return functools.reduce(operator.and_, made, F.lit(True)) if made else F.lit(True)


def apply_filter(df: DataFrame, spec: Any, metadata: str | None = "metadata") -> DataFrame:
    """Rows of ``df`` that match a specification."""
    predicate = compile_filter(spec, df, metadata)
    return df if predicate is None else df.where(predicate)
