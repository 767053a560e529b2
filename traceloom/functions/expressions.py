"""Scalar functions as Column expressions, none of them a Python function at run time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_CHARS = 2000
SNIPPET_CHARS = 80
# Header names whose values are hidden in shown cells.
SECRET_HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key", "x-auth-token", "x-access-token", "x-session-token"]


def _fixed(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def format_ns(c: Column) -> Column:
    x = c.cast("double")
    return F.when(x >= 1e9, F.concat(_fixed(x / 1e9), F.lit(" s"))).when(x >= 1e6, F.concat(_fixed(x / 1e6), F.lit(" ms"))).when(x >= 1e3, F.concat(_fixed(x / 1e3), F.lit(" µs"))).otherwise(F.concat(_fixed(x, 0), F.lit(" ns")))


def format_bytes(c: Column) -> Column:
    x, k = c.cast("double"), 1024.0
    return F.when(x >= k**3, F.concat(_fixed(x / k**3), F.lit(" GB"))).when(x >= k**2, F.concat(_fixed(x / k**2), F.lit(" MB"))).when(x >= k, F.concat(_fixed(x / k), F.lit(" KB"))).otherwise(F.concat(_fixed(x, 0), F.lit(" B")))


def format_cycles(c: Column) -> Column:
    x = c.cast("double")
    return F.when(x >= 1e9, F.concat(_fixed(x / 1e9), F.lit("B cycles"))).when(x >= 1e6, F.concat(_fixed(x / 1e6), F.lit("M cycles"))).when(x >= 1e3, F.concat(_fixed(x / 1e3), F.lit("k cycles"))).otherwise(F.concat(_fixed(x, 0), F.lit(" cycles")))


def format_count(c: Column) -> Column:
    """Thousands separators, and two decimals unless whole."""
    x = c.cast("double")
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 2))


def format_unit(c: Column, unit: str | None) -> Column:
    return {"nanoseconds": format_ns, "bytes": format_bytes, "cycles": format_cycles}.get(unit or "", format_count)(c)


def clock_ns(c: Column) -> Column:
    """Nanoseconds of a clock text MM:SS.mmm.uuu or H:MM:SS.mmm.uuu; null if it has another form."""
    form = r"^(?:(\d+):)?(\d+):(\d+)\.(\d{3})\.(\d{3})$"
    part = lambda k: F.regexp_extract(c, form, k).try_cast("long")
    total = ((F.coalesce(part(1), F.lit(0)) * 60 + part(2)) * 60 + part(3)) * 1_000_000_000 + part(4) * 1_000_000 + part(5) * 1_000
    return F.when(c.rlike(form), total)


def shown_cell(c: Column, name: str = "", limit: int = CELL_CHARS) -> Column:
    """Values of secret headers hidden, then cut with a note of the full length.

    Headers are pairs "(name : value)" in columns with header in their name; other text stays.
    """
    names = "|".join(re.escape(h) for h in SECRET_HEADERS)
    safe = F.regexp_replace(c, rf"\(\s*((?i:{names}))\s*:[^()]*\)", "($1 : [REDACTED])") if "header" in name.lower() else c
    return F.when(F.length(safe) > limit, F.concat(F.substring(safe, 1, limit), F.lit("… [truncated — "), F.length(safe).cast("string"), F.lit(" chars total]"))).otherwise(safe)


def snippet(c: Column, limit: int = SNIPPET_CHARS) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def trailing_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)\s*$", 1).try_cast("double")


def frame_count(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)\s+frames?", 1).try_cast("int")


def chain(c: Column) -> Column:
    """The parts of a hierarchy text, split at its arrows or commas."""
    return F.split(c, " ← |, ")


def percent(part: Column, whole: Column) -> Column:
    """One decimal; 0 of nothing is 0."""
    return F.coalesce(F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), 1), F.lit(0.0))


def nearest_rank(c: Column | str, p: float) -> Column:
    """The smallest value that p of the finite values do not exceed."""
    name = c if isinstance(c, str) else c._jc.toString()
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {name})")


def message_fields(c: Column) -> tuple[Column, Column]:
    """An event message a,b,request,...::{json}: its comma-separated head as an array, and its JSON tail."""
    return F.split(F.substring_index(c, "::", 1), ","), F.when(F.instr(c, "::") > 0, F.expr("substring({0}, instr({0}, '::') + 2)".format(c._jc.toString())))


def word_score(name: Column, words: list[str]) -> Column:
    """How many of the words the name holds, whatever their case."""
    return sum((F.when(F.instr(F.lower(name), w.lower()) > 0, 1).otherwise(0) for w in words), F.lit(0))
