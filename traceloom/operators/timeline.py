"""One time-ordered list from several tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.model import ROW, Table, TableError
from traceloom.operators.rows import clamp
from traceloom.plans import predicates as P

LIMIT, MOST = 100, 1000


def merged(tables: list[Table], start: int | None, end: int | None) -> DataFrame:
    """All rows of the window: origin, time, duration, label and row."""
    if start is None and end is None:
        raise TableError("a timeline needs a start or an end")
    if not tables:
        raise TableError("a timeline needs a table")
    parts = []
    for t in tables:
        if t.time_column() is None:
            raise TableError(f"{t.schema} has no time column")
        rows = t.where(P.time_range(t, start, end))
        duration, label = t.duration_column(), t.label_column()
        in_ns = duration is not None and any(c.mnemonic == duration and c.unit == "nanoseconds" for c in t.classified())
        parts.append(rows.df.select(
            F.lit(t.schema).alias("origin"), t.raw(t.time_column()).cast("long").alias("time"), (t.raw(duration).cast("long") if in_ns else F.lit(None).cast("long")).alias("duration"),
            (t.fmt(label) if label else F.lit(None).cast("string")).alias("label"), F.col(ROW).alias("row_idx"),
        ))
    return reduce(DataFrame.unionByName, parts)


def timeline(tables: list[Table], start: int | None, end: int | None, limit: int | None = None) -> DataFrame:
    """The first rows of the window; ties by origin and row."""
    return merged(tables, start, end).orderBy("time", "origin", "row_idx").limit(clamp(limit, LIMIT, MOST))
