"""Predicates as Column expressions: filter maps, time ranges, and condition trees.

The two dialects differ on purpose.  A filter map compares equal to either the raw or the
display value.  A condition is about rows with a display value, except is-null.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.model import Table, TableError, column_type
from traceloom.plans import roles

TRUE_TEXTS, FALSE_TEXTS = ("Yes", "true"), ("No", "false")
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "not-contains", "regex", "is-null", "not-null", "is-sentinel", "not-sentinel")
_NO_VALUE = ("is-null", "not-null", "is-sentinel", "not-sentinel")
#: Times of stored timestamps are counted from here, as far as a Python date reaches.
EPOCH, LAST_NS = datetime(1970, 1, 1), 2**63
#: The narrow windows of values that count as a maximum of unknown width.
UNKNOWN_MAX = [(2.0**32 - 256, 2.0**32 - 1), (1.8446744073709e19, float("inf"))]


def number_text(v: float) -> str:
    """A number as text: whole numbers without point."""
    return str(int(v)) if float(v).is_integer() else repr(float(v))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def truth(table: Table, name: str, value: bool) -> Column:
    raw, fmt = table.raw(name).cast("string"), table.fmt(name)
    numbers, texts = (("1",), TRUE_TEXTS) if value else (("0",), FALSE_TEXTS)
    return _sure(raw.isin(*numbers, texts[1])) | _sure(fmt.isin(*texts))


def _kind(table: Table, name: str) -> T.DataType | None:
    """The type of the raw column, where it is one column of the table."""
    return None if "." in name or f"{name}__fmt" in table.df.columns and name not in table.df.columns else column_type(table.df.schema, name)


def _compared(table: Table, name: str, value: float) -> tuple[Column, Column]:
    """Column and number as comparable expressions, bare where the column is a number, so that they reach the scan.

    Whole numbers are compared as such, so none of 64 bits equals its neighbours.
    """
    raw, kind = table.raw(name), _kind(table, name)
    whole = isinstance(value, int) or float(value).is_integer()
    if isinstance(kind, T.IntegralType):
        return raw, F.lit(int(value)) if whole and abs(value) < 2**63 else F.lit(float(value))
    if isinstance(kind, T.NumericType):
        return raw, F.lit(float(value))
    text = raw.cast("string")
    if whole and abs(value) > 2**53:
        return text.try_cast("decimal(38,0)"), F.lit(int(value)).cast("decimal(38,0)")
    return text.try_cast("double"), F.lit(float(value))


def _same(table: Table, name: str, value) -> list[Column]:
    """Ways to equal a value; null where the cell is null."""
    if isinstance(value, (int, float)):
        a, b = _compared(table, name, value)
        return [a == b] if isinstance(_kind(table, name), T.NumericType) else [_sure(a == b), _sure(table.raw(name).cast("string") == number_text(value))]
    raw = table.raw(name)
    if isinstance(_kind(table, name), T.StringType) and f"{name}__fmt" not in table.df.columns:
        return [raw == str(value)]
    return [_sure(table.fmt(name) == str(value)), _sure(raw.cast("string") == str(value))]


def equals(table: Table, name: str, value) -> Column:
    """Equality with the raw or the display value, for use as a filter: null counts as not equal."""
    if isinstance(value, bool):
        return truth(table, name, value)
    return any_of(_same(table, name, value))


def filter_map(table: Table, wanted: dict | None) -> Column:
    return all_of([equals(table, table.resolve(k), v) for k, v in (wanted or {}).items()])


def time_range(table: Table, start: int | None = None, end: int | None = None) -> Column:
    """Both ends included; without a time column nothing is filtered.

    A time that is computed from a stored timestamp has it beside as <time>__at; whole
    microseconds around the range are compared with that, which file statistics can use.
    """
    time = table.time_column()
    if time is None:
        return F.lit(True)
    c, stored = table.raw(time), f"{time}__at"
    bounds = [(x, op, us) for x, op, us in ((start, "ge", lambda ns: ns // 1000), (end, "le", lambda ns: -(-ns // 1000))) if x is not None]
    parts = [c >= F.lit(x) if op == "ge" else c <= F.lit(x) for x, op, _ in bounds]
    if stored in table.df.columns:
        for x, op, us in bounds:
            if abs(x) < LAST_NS:
                moment = F.lit(EPOCH + timedelta(microseconds=us(x)))
                parts.append(F.col(stored) >= moment if op == "ge" else F.col(stored) <= moment)
    return all_of(parts)


def sentinel(table: Table, name: str) -> Column:
    """Whether the value is the type's documented mark for missing; times also use 0."""
    kind = table.type_of(name) or ""
    f, c = roles.facts(kind), table.raw(name).cast("double")
    marks = []
    if f.sentinel == "zero" or roles.of_type(kind).role == "time":
        marks.append(c == 0)
    if f.sentinel == "max":
        known = roles.max_sentinel(kind)
        marks += [c == float(known)] if known is not None else [c.between(a, z) for a, z in UNKNOWN_MAX]
    if not marks:
        raise TableError(f"type {kind!r} of {name!r} has no documented mark for missing values")
    return _sure(any_of(marks))


def max_sentinel(table: Table, name: str) -> Column | None:
    kind = table.type_of(name) or ""
    if roles.facts(kind).sentinel != "max":
        return None
    c, known = table.raw(name).cast("double"), roles.max_sentinel(kind)
    return _sure(c == float(known)) if known is not None else _sure(any_of([c.between(a, z) for a, z in UNKNOWN_MAX]))


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def condition(table: Table, c: dict) -> Column:
    """A condition {field, op, val | compareCol}, or {allOf: [...]}, or {anyOf: [...]}."""
    if "allOf" in c:
        return all_of([condition(table, x) for x in c["allOf"]])
    if "anyOf" in c:
        return any_of([condition(table, x) for x in c["anyOf"]])
    op, name = c["op"], table.resolve(c["field"], compare=c["op"] not in ("is-null", "not-null"))
    if op not in OPERATORS:
        raise TableError(f"unknown operator {op!r}; there are {', '.join(OPERATORS)}")
    raw, fmt = table.raw(name), table.fmt(name)
    text, there = raw.cast("string"), fmt.isNotNull() if f"{name}__fmt" in table.df.columns else raw.isNotNull()
    if op == "is-null":
        return fmt.isNull()
    if op == "not-null":
        return there
    if op == "is-sentinel":
        return there & sentinel(table, name)
    if op == "not-sentinel":
        return there & ~sentinel(table, name)
    if "compareCol" in c:
        if c.get("val") is not None:
            raise TableError("a condition takes val or compareCol, not both")
        other = table.resolve(c["compareCol"])
        fmt2, text2 = table.fmt(other), table.raw(other).cast("string")
        both = there & fmt2.isNotNull()
        same = (fmt == fmt2) | (text == text2)
        if op in ("eq", "ne"):
            return _sure(both & (same if op == "eq" else ~same))
        if op not in ("gt", "gte", "lt", "lte"):
            raise TableError(f"{op!r} does not compare columns")
        return _sure(both & _ordered(op, text.try_cast("double"), text2.try_cast("double")))
    value = c.get("val")
    if value is None:
        return F.lit(False)
    if isinstance(value, bool):
        if op not in ("eq", "ne"):
            raise TableError(f"{op!r} does not take a truth value")
        met = truth(table, name, value)
        return there & (met if op == "eq" else ~met)
    if op in ("eq", "ne"):
        same = any_of(_same(table, name, value))
        return there & (same if op == "eq" else ~_sure(same))
    if op in ("gt", "gte", "lt", "lte"):
        met = _ordered(op, *_compared(table, name, value))
        return there & (met if isinstance(_kind(table, name), T.NumericType) else _sure(met))
    if op == "regex":
        try:
            re.compile(str(value))
        except re.error as e:
            raise TableError(f"invalid pattern {value!r}: {e}") from None
        return there & (_sure(fmt.rlike(f"(?i){value}")) | _sure(text.rlike(f"(?i){value}")))
    met = _sure(F.instr(fmt, str(value)) > 0) | _sure(F.instr(text, str(value)) > 0)
    return there & (met if op == "contains" else ~met)


def conditions(table: Table, where: list[dict] | None) -> Column:
    return all_of([condition(table, c) for c in where or []])


def like_text(c: Column, part: str) -> Column:
    """Case-insensitive match anywhere; % and _ in part stay wildcards."""
    return _sure(c.ilike(f"%{part}%"))


def overlaps(start: Column, duration: Column, a: int, z: int) -> Column:
    return _sure((start <= F.lit(z)) & (start + duration >= F.lit(a)))
