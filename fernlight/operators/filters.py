"""Facet filters and metadata conditions, compiled to columns.

Facets are an open JSON object, read as a variant. A key that is absent differs from one that is null: the first compares
as the text "undefined", the second as "null". Values compare by the rules of JavaScript, which the catalogue's
conditions were defined with.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trim

FIELDS = ("path", "slug", "title", "doc_id", "chunk_uid", "seq", "tier")
# Operators by spelling.
SPELLINGS = {
    "contains": "contains", "not contains": "not contains", "start with": "start", "end with": "end",
    "is": "is", "=": "is", "is not": "is not", "!=": "is not", "≠": "is not", "in": "in", "not in": "not in",
    "empty": "empty", "not empty": "not empty", ">": "gt", "<": "lt", ">=": "ge", "≥": "ge", "<=": "le", "≤": "le",
    "before": "before", "after": "after",
}


class FilterError(ValueError):
    """A filter or condition that can't be compiled."""


@dataclass(frozen=True)
class Value:
    """A value of unknown type in a row. kind: schema_of_variant's first word, null where the value is absent."""

    variant: Column
    kind: Column
    text: Column  # as JavaScript's String()
    number: Column  # as JavaScript's Number(), null for NaN

    def is_kind(self, *kinds: str) -> Column:
        return F.coalesce(self.kind.isin(*kinds), F.lit(False))


_NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT")


def _number_of(text: Column) -> Column:
    flat = trim(text)
    plain = F.regexp_like(flat, F.lit("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z"))
    return F.when(flat == "", 0.0).when(plain, flat.try_cast("double"))


def _of_variant(v: Column) -> Value:
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    as_text = F.try_variant_get(v, "$", "string")
    # Whole numbers have no fraction in JavaScript's text.
    whole = F.regexp_replace(as_text, "(?<=\\d)\\.0+\\z", "")
    items = F.try_variant_get(v, "$", "array<string>")
    joined = F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit(""))), ",")
    text = (
        F.when(v.isNull(), "undefined").when(kind == "VOID", "null").when(kind == "OBJECT", "[object Object]").when(kind == "ARRAY", joined).when(kind.isin(*_NUMBERS), whole).otherwise(as_text)
    )
    number = (
        F.when(v.isNull(), F.lit(None).cast("double"))
        .when(kind == "VOID", 0.0)
        .when(kind == "BOOLEAN", F.when(as_text == "true", 1.0).otherwise(0.0))
        .when(kind.isin(*_NUMBERS), F.try_variant_get(v, "$", "double"))
        .when(kind == "STRING", _number_of(as_text))
        .when(kind == "ARRAY", _number_of(joined))
    )
    return Value(v, F.when(v.isNotNull(), kind), text, number)


def _of_column(name: str, numeric: bool) -> Value:
    c = F.col(name)
    variant = F.to_variant_object(F.struct(c.alias("v")))
    text = F.coalesce(F.regexp_replace(c.cast("string"), "(?<=\\d)\\.0\\z", "") if numeric else c, F.lit("null"))
    kind = F.when(c.isNull(), "VOID").otherwise("DOUBLE" if numeric else "STRING")
    return Value(variant, kind, text, F.coalesce(c.cast("double"), F.lit(0.0)) if numeric else F.when(c.isNull(), 0.0).otherwise(_number_of(c)))


def facet(name: str, facets: str = "facets") -> Column:
    return F.try_variant_get(F.try_parse_json(facets), f"$[{json.dumps(name)}]", "variant")


def value_of(name: str, columns: list[str], facets: str = "facets") -> Value:
    """A facet where there is one of that name, else a field of the row, else absent."""
    own = _of_variant(facet(name, facets))
    if name not in FIELDS or name not in columns:
        return own
    field = _of_column(name, name in ("seq", "tier"))
    has = own.variant.isNotNull()
    return Value(own.variant, F.when(has, own.kind).otherwise(field.kind), F.when(has, own.text).otherwise(field.text), F.when(has, own.number).otherwise(field.number))


def _literal(value: Any) -> tuple[str, float | None]:
    """JavaScript's String() and Number() of a condition's value."""
    if value is None:
        return "null", 0.0
    if isinstance(value, bool):
        return str(value).lower(), float(value)
    if isinstance(value, (int, float)):
        return (str(int(value)) if float(value).is_integer() else repr(value)), float(value)
    if isinstance(value, list):
        text = ",".join("" if v is None else _literal(v)[0] for v in value)
    elif isinstance(value, dict):
        return "[object Object]", None
    else:
        text = value
    try:
        return text, float(text) if text.strip() else 0.0
    except ValueError:
        return text, None


def _equal(v: Value, expected: Any) -> Column:
    text, number = _literal(expected)
    is_number = isinstance(expected, (int, float)) and not isinstance(expected, bool)
    by_number = F.coalesce(v.number == F.lit(number), F.lit(False)) if number is not None else F.lit(False)
    if is_number:
        return by_number
    return F.when(v.is_kind(*_NUMBERS), by_number).otherwise(v.text == F.lit(text))


def _contains(v: Value, expected: Any) -> Column:
    items = F.try_variant_get(v.variant, "$", "array<variant>")
    in_array = F.exists(F.coalesce(items, F.array().cast("array<variant>")), lambda x: _equal(_of_variant(x), expected))
    in_text = F.contains(v.text, F.lit(expected)) if isinstance(expected, str) else F.lit(False)
    return F.when(v.is_kind("ARRAY"), in_array).when(v.is_kind("STRING"), in_text).otherwise(F.lit(False))


def _time(text: Column) -> Column:
    """ISO 8601 in UTC; other forms are no time."""
    return F.when(F.regexp_like(text, F.lit("^\\d{4}-\\d{2}(-\\d{2})?")), text.try_cast("timestamp"))


def condition(name: str, operator: str, value: Any, columns: list[str], facets: str = "facets", index: int = 0) -> Column:
    op = SPELLINGS.get(operator)
    if op is None:
        raise FilterError(f"condition {index}: operator {operator!r} is not supported")
    if op not in ("empty", "not empty") and value is None:
        raise FilterError(f"condition {index}: operator {operator!r} needs a value")
    if op in ("in", "not in") and not isinstance(value, list):
        raise FilterError(f"condition {index}: operator {operator!r} needs a list")
    v = value_of(name, columns, facets)
    no = F.lit(False)
    if op in ("is", "is not"):
        out = _equal(v, value)
    elif op in ("contains", "not contains"):
        out = _contains(v, value)
    elif op in ("start", "end"):
        out = (F.startswith if op == "start" else F.endswith)(v.text, F.lit(value)) & v.is_kind("STRING") if isinstance(value, str) else no
    elif op in ("in", "not in"):
        out = reduce(lambda a, b: a | b, (_equal(v, x) for x in value), no)
    elif op in ("empty", "not empty"):
        items = F.size(F.try_variant_get(v.variant, "$", "array<variant>"))
        keys = F.size(F.try_variant_get(v.variant, "$", "map<string,variant>"))
        out = v.kind.isNull() | v.is_kind("VOID") | (v.is_kind("STRING") & (v.text == "")) | (v.is_kind("ARRAY") & (items == 0)) | (v.is_kind("OBJECT") & (keys == 0))
    elif op in ("before", "after"):
        left, right = _time(v.text), _time(F.lit(_literal(value)[0]))
        out = left < right if op == "before" else left > right
    else:
        number = _literal(value)[1]
        if number is None:
            return no
        out = {"gt": v.number > number, "lt": v.number < number, "ge": v.number >= number, "le": v.number <= number}[op]
    out = F.coalesce(out, no)
    return ~out if op in ("not contains", "is not", "not in", "not empty") else out


def conditions(tree: dict | None, columns: list[str], facets: str = "facets") -> Column:
    """A flat tree {logical_operator, conditions}; without conditions `and` holds and `or` doesn't."""
    if tree is None:
        return F.lit(True)
    if not isinstance(tree, dict) or not isinstance(tree.get("conditions", []), list):
        raise FilterError("a metadata condition is an object with a list of conditions")
    logic = tree.get("logical_operator", "and")
    if logic not in ("and", "or"):
        raise FilterError(f"logical operator {logic!r} is neither and nor or")
    found = []
    for i, c in enumerate(tree.get("conditions") or []):
        if not isinstance(c, dict) or not isinstance(c.get("name"), str) or not isinstance(c.get("comparison_operator"), str):
            raise FilterError(f"condition {i} needs a name and a comparison operator")
        found.append(condition(c["name"], c["comparison_operator"], c.get("value"), columns, facets, i))
    return reduce(lambda a, b: a & b, found, F.lit(True)) if logic == "and" else reduce(lambda a, b: a | b, found, F.lit(False))


def exact(filters: dict[str, str], facets: str = "facets") -> Column:
    """All facets equal, as texts, to what is expected; an absent facet reads "undefined"."""
    return reduce(lambda a, b: a & b, (_of_variant(facet(k, facets)).text == F.lit(v) for k, v in filters.items()), F.lit(True))


def parse_cli(values: list[str]) -> dict[str, str]:
    """key=value texts, split at the first sign; the later of two wins."""
    out = {}
    for v in values:
        key, sign, value = v.partition("=")
        if not sign or not key:
            raise FilterError(f"filter {v!r} is not key=value")
        out[key] = value
    return out


def parse_http(value: Any) -> dict[str, str]:
    if value is None:
        return {}
    if not isinstance(value, dict) or any(v is None or isinstance(v, (dict, list)) for v in value.values()):
        raise FilterError("filters are an object of plain values")
    return {k: _literal(v)[0] for k, v in value.items()}
