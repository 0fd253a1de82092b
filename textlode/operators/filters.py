"""Metadata filters: a dictionary becomes one Column.

``{"field": value}`` is equality; ``{"field": {"$op": value}}`` one operator; several fields are a conjunction;
``$and`` and ``$or`` take lists of filters. A key that has a column of its own is compared there, where
Parquet can push the predicate down; any other is read from the JSON string.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlode.functions import metadata as M

COMPARISONS = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
OPERATORS = ("$eq", "$ne", "$in", "$nin", *COMPARISONS, "$between", "$like", "$ilike")


def compile_filter(spec: Mapping, metadata: str = "cmetadata", promoted: Mapping[str, str | tuple[str, str]] | None = None) -> Column:
    """The predicate of ``spec`` over the JSON column ``metadata``; ``promoted`` maps keys to the columns that hold them: a name for a column of JSON
    strings, or (name, "number") for one of JSON numbers.

    Equality compares text: the value's ``str`` with the JSON text. ``$ne`` and ``$nin`` are not true where the key is missing.
    Order comparisons hold between numbers or between strings only. An empty filter is true.
    """
    if not isinstance(spec, Mapping):
        raise ValueError("a filter must be a dictionary")
    parts = [_part(k, v, metadata, promoted or {}) for k, v in spec.items()]
    return reduce(and_, parts) if parts else F.lit(True)


def _part(field: object, value: object, metadata: str, promoted: Mapping[str, str]) -> Column:
    if field in ("$and", "$or"):
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError(f"{field} takes a list of filters")
        return reduce(and_ if field == "$and" else or_, [compile_filter(v, metadata, promoted) for v in value])
    if not isinstance(field, str):
        raise ValueError(f"a field must be a string, not {type(field).__name__}")
    if field.startswith("$"):
        raise ValueError(f"{field} is no field")
    if not field.isidentifier():
        raise ValueError(f"{field!r} is no valid field name")
    op, operand = "$eq", value
    if isinstance(value, Mapping):
        if len(value) != 1:
            raise ValueError(f"the filter of {field} must have exactly one operator")
        op, operand = next(iter(value.items()))
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}; one of {OPERATORS}")
    own = promoted.get(field)
    own, own_kind = own if isinstance(own, tuple) else (own, "string")
    text = F.col(own).cast("string") if own_kind == "number" else F.col(own) if own else M.as_text(F.col(metadata), field)
    if op == "$eq":
        return text == F.lit(str(operand))
    if op == "$ne":
        return text != F.lit(str(operand))
    if op in ("$in", "$nin"):
        if not isinstance(operand, (list, tuple, set, frozenset)):
            raise ValueError(f"{op} takes a list")
        inside = text.isin([str(x) for x in operand])
        return inside if op == "$in" else ~inside
    if op in ("$like", "$ilike"):
        return text.like(str(operand)) if op == "$like" else text.ilike(str(operand))
    bounds = operand if op == "$between" else [operand]
    if not isinstance(bounds, (list, tuple)) or len(bounds) != (2 if op == "$between" else 1):
        raise ValueError("$between takes two bounds")
    # a comparison of a number with a string is unknown, wherever the value is kept
    if all(isinstance(b, (int, float)) and not isinstance(b, bool) for b in bounds):
        typed = M.as_number(F.col(metadata), field) if not own else F.col(own) if own_kind == "number" else F.lit(None).cast("double")
    elif all(isinstance(b, str) for b in bounds):
        typed = M.as_string(F.col(metadata), field) if not own else text if own_kind == "string" else F.lit(None).cast("string")
    else:
        raise ValueError(f"{op} compares numbers or strings")
    if op == "$between":
        return typed.between(F.lit(bounds[0]), F.lit(bounds[1]))
    return getattr(typed, COMPARISONS[op])(F.lit(bounds[0]))
