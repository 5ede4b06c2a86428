"""Structured filters (field, op, value), compiled to predicates on one element of a nested collection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("eq", "ne", "lt", "lte", "gt", "gte", "includes_all", "includes_any")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any


def valid(filters: Any, fields: set[str]) -> list[Filter]:
    """Those of known field and op that have a value; what isn't a list has none."""
    if not isinstance(filters, list):
        return []
    return [Filter(f["field"], f["op"], f["value"]) for f in filters if isinstance(f, dict) and f.get("field") in fields and f.get("op") in OPS and "value" in f]


def number(value: Any) -> float | None:
    """A value as a comparison with a number takes it: numbers as they are, text if it reads as one (blank: 0), true and false as 1 and 0, nothing as 0."""
    if value is None or isinstance(value, bool | int | float):
        return float(value or 0)
    if not isinstance(value, str):
        return None
    try:
        return float(value.strip() or 0) if "_" not in value and not value.strip().lstrip("+-").lower().startswith(("nan", "inf")) else None
    except ValueError:
        return None


def _same_type(value: Any, kind: T.DataType) -> bool:
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, T.NumericType):
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(kind, T.StringType) and isinstance(value, str)


def compare(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """One condition on a field of a known type, true or false.

    A null field fails every op, `ne` included. Values of another type than the field's are unequal to it; arrays are
    unequal to everything. Only numeric fields have an order; a value that is no number fails. The `includes` ops need an
    array field and a list; of an empty list `includes_all` has all, `includes_any` none.
    """
    if op in ("eq", "ne"):
        same = c == F.lit(value) if _same_type(value, kind) else F.lit(False)
        found = same if op == "eq" else ~same
    elif op in ("lt", "lte", "gt", "gte"):
        bound = number(value) if isinstance(kind, T.NumericType) else None
        found = F.lit(False) if bound is None else {"lt": c < bound, "lte": c <= bound, "gt": c > bound, "gte": c >= bound}[op]
    elif isinstance(kind, T.ArrayType) and isinstance(value, list):
        has = [F.array_contains(c, v) if _same_type(v, kind.elementType) else F.lit(False) for v in value]
        found = reduce(lambda a, b: a & b, has, F.lit(True)) if op == "includes_all" else reduce(lambda a, b: a | b, has, F.lit(False))
    else:
        found = F.lit(False)
    return F.coalesce(c.isNotNull() & found, F.lit(False))


def of_prefix(prefix: Column, op: str, value: Any) -> Column:
    """A condition on a record's code prefix, in any case: equal or not, or one of a list (for both `includes` ops); a record without one fails."""
    said = lambda v: str(v or "").upper()
    if op in ("eq", "ne"):
        found = prefix == F.lit(said(value)) if op == "eq" else prefix != F.lit(said(value))
    else:
        found = prefix.isin([said(v) for v in value]) if op.startswith("includes") and isinstance(value, list) and value else F.lit(False)
    return F.coalesce((prefix != "") & found, F.lit(False))


def predicate(f: Filter, kinds: T.StructType, code: Column | None = None) -> Callable[[Column], Column]:
    """The condition on one section, by the types of its fields; `code_prefix` is asked of the record's code. A field that sections lack is null."""
    if f.field == "code_prefix":
        found = of_prefix(prefix_of(code), f.op, f.value) if code is not None else F.lit(False)
        return lambda element: found
    if f.field not in kinds.names:
        return lambda element: F.lit(False)
    return lambda element: compare(element[f.field], kinds[f.field].dataType, f.op, f.value)


def mask(f: Filter, sections: pa.StructArray, kinds: T.StructType, prefixes: np.ndarray) -> np.ndarray:
    """What `predicate` says, for a batch of sections at once; prefixes: of each section its record's code prefix."""
    n = len(sections)
    if f.field == "code_prefix":
        said = lambda v: str(v or "").upper()
        if f.op in ("eq", "ne"):
            found = (prefixes == said(f.value)) == (f.op == "eq")
        else:
            found = np.isin(prefixes, [said(v) for v in f.value]) if f.op.startswith("includes") and isinstance(f.value, list) and f.value else np.zeros(n, bool)
        return found & (prefixes != "")
    if f.field not in kinds.names:
        return np.zeros(n, bool)
    kind, column = kinds[f.field].dataType, sections.field(kinds.names.index(f.field))
    there = np.asarray(pc.is_valid(column)) & np.asarray(pc.is_valid(sections))
    true = lambda x: np.asarray(pc.fill_null(x, False))
    if f.op in ("eq", "ne"):
        same = true(pc.equal(column, pa.scalar(f.value, column.type if isinstance(f.value, str | bool) else None))) if _same_type(f.value, kind) else np.zeros(n, bool)
        return there & (same if f.op == "eq" else ~same)
    if f.op in ("lt", "lte", "gt", "gte"):
        bound = number(f.value) if isinstance(kind, T.NumericType) else None
        if bound is None:
            return np.zeros(n, bool)
        compared = {"lt": pc.less, "lte": pc.less_equal, "gt": pc.greater, "gte": pc.greater_equal}[f.op]
        return there & true(compared(column, pa.scalar(bound)))
    if not (isinstance(kind, T.ArrayType) and isinstance(f.value, list)):
        return np.zeros(n, bool)
    flat, parent = pc.list_flatten(column), np.asarray(pc.list_parent_indices(column))
    has = []
    for v in f.value:
        hit = np.zeros(n, bool)
        if _same_type(v, kind.elementType):
            hit[parent[true(pc.equal(flat, pa.scalar(v, flat.type if isinstance(v, str | bool) else None)))]] = True
        has.append(hit)
    joined = np.logical_and.reduce(has) if f.op == "includes_all" else np.logical_or.reduce(has)
    return there & (joined if has else np.full(n, f.op == "includes_all"))


def prefix_of(code: Column) -> Column:
    return F.upper(F.split(F.coalesce(code, F.lit("")), r"\s+")[0])


def all_of(filters: list[Filter], kinds: T.StructType, code: Column | None = None) -> Callable[[Column], Column]:
    return lambda element: reduce(lambda a, b: a & b, (predicate(f, kinds, code)(element) for f in filters), F.lit(True))


def stages(filters: list[Filter], fields: tuple[str, ...]) -> list[list[Filter]]:
    """Filters on the leading field alone, then with that on each next one, as far as there are some; none without the leading one."""
    out: list[list[Filter]] = []
    for field in fields:
        f = first(filters, field)
        if f is None:
            break
        out.append([*(out[-1] if out else []), f])
    return out


def first(filters: list[Filter], field: str) -> Filter | None:
    return next((f for f in filters if f.field == field), None)


def described(f: Filter) -> str:
    return f"{f.field} {f.op} {', '.join(map(str, f.value)) if isinstance(f.value, list) else f.value}"


def by_code(filters: list[Filter], known: set[str], field: str = "programs", target: str = "code_prefix") -> list[Filter]:
    """A filter on programs that names known codes becomes one on the code's prefix, without the unknown names; else it stays."""
    out = []
    for f in filters:
        names = f.value if isinstance(f.value, list) else [f.value]
        codes = list(dict.fromkeys(str(v).upper() for v in names if str(v).upper() in known)) if f.field == field else []
        out.append(Filter(target, "includes_any", codes) if codes else f)
    return out


def with_named(filters: list[Filter], named: list[str], target: str = "code_prefix") -> list[Filter]:
    """With a prefix filter for the codes a query names, unless there is one."""
    return filters if first(filters, target) or not named else [*filters, Filter(target, "includes_any", named)]


def fetch_size(k: int, filters: list[Filter]) -> int:
    """Records to fetch for k after later filtering: three times, and once more for each filter."""
    return k * (3 + len(filters))


def without(filters: list[Filter], field: str) -> tuple[list[Filter], list[str]]:
    """The filters on other fields, and the values of those left out, to be said in the query's text instead."""
    values = [v for f in filters if f.field == field for v in (f.value if isinstance(f.value, list) else [f.value])]
    return [f for f in filters if f.field != field], [str(v) for v in values if v is not None]


def in_term(filters: list[Filter], season: str, year: int) -> list[Filter]:
    """With the season and year that a user asks for."""
    return [*filters, Filter("season", "eq", season), Filter("year", "eq", year)]
