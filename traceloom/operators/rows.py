"""Row verbs: query, find and get_row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.expressions import shown_cell
from traceloom.model import ROW, Table, TableError
from traceloom.plans import predicates as P

QUERY_LIMIT, FIND_LIMIT, MAX_LIMIT = 20, 50, 500
WINDOW_OPS = ("running-total", "delta", "rank", "row-number")


def clamp(limit: int | None, default: int, most: int = MAX_LIMIT) -> int:
    return default if limit is None else max(1, min(int(limit), most))


def projected(table: Table, columns: list[str] | None) -> list[str]:
    """Names to show: unknown ones are left out, none given means all columns."""
    return [c.mnemonic for c in table.columns] if columns is None else [c for c in columns if c in table.names()]


def shown(table: Table, name: str) -> Column:
    """What a cell shows: its display text, of a call stack its number of frames and the top one."""
    if table.is_stack(name):
        c = table.raw(name)
        return F.when(F.size(c) > 0, F.format_string("%d frames, top: %s", F.size(c), F.element_at(c, 1)["name"]))
    return table.fmt(name)


def window_value(table: Table, window: dict) -> Column:
    """A window column: ordered by raw values, partitioned by display values.

    A running total covers all rows up to the current one and its peers.  Ties in delta
    and row-number are broken by the row index.
    """
    op, order = window["op"], table.raw(table.resolve(window["orderBy"]))
    if op not in WINDOW_OPS:
        raise TableError(f"unknown window op {op!r}; there are {', '.join(WINDOW_OPS)}")
    parts = [table.fmt(table.resolve(p)) for p in ([window["partitionBy"]] if isinstance(window.get("partitionBy"), str) else window.get("partitionBy") or [])]
    peers = Window.partitionBy(*parts).orderBy(order.asc_nulls_first())
    exact = Window.partitionBy(*parts).orderBy(order.asc_nulls_first(), F.col(ROW))
    measure = window.get("measure")
    if op == "running-total":
        if not measure:
            raise TableError("a running total needs a measure")
        return F.sum(table.raw(table.resolve(measure)).cast("double")).over(peers)
    if op == "delta":
        x = table.raw(table.resolve(measure)) if measure else order
        return x - F.lag(x).over(exact)
    return F.rank().over(peers) if op == "rank" else F.row_number().over(exact)


def query(table: Table, columns: list[str] | None = None, filter: dict | None = None, start: int | None = None, end: int | None = None, sort: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0, window: dict | None = None, display: bool = True) -> DataFrame:
    """Rows that pass an equality filter and a time range, in order, one page of them.

    Without sort the order is that of the rows, or of the window.  limit=0 gives all rows.
    """
    rows = table.where(P.filter_map(table, filter) & P.time_range(table, start, end))
    df = rows.df
    names = projected(table, columns)
    if window:
        df = df.withColumn("__window", window_value(rows, window))
    by = sort or (window or {}).get("orderBy")
    if by:
        key = rows.raw(table.resolve(by))
        order = [key.desc_nulls_last() if sort and descending else key.asc_nulls_first(), F.col(ROW)]
    else:
        order = [F.col(ROW)]
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    if limit != 0:
        out = out.limit(clamp(limit, QUERY_LIMIT))
    cell = (lambda n: shown(table, n)) if display else table.raw
    picked = [cell(n).alias(n.replace(".", "_")) for n in names]
    return out.select(F.col(ROW).alias("row_idx"), *picked, *([F.col("__window").alias(window.get("as", "window_value"))] if window else []))


def find(table: Table, where: list[dict], columns: list[str] | None = None, start: int | None = None, end: int | None = None, sort: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0, display: bool = True) -> DataFrame:
    """Rows that meet all conditions; conditions nest in allOf and anyOf."""
    rows = table.where(P.conditions(table, where) & P.time_range(table, start, end))
    return query(rows, columns, sort=sort, descending=descending, limit=clamp(limit, FIND_LIMIT) if limit != 0 else 0, offset=offset, display=display)


def get_row(table: Table, index: int) -> DataFrame:
    """One row with all its cells as shown; an index out of bounds is an error."""
    if index < 0 or not table.df.where(F.col(ROW) == index).limit(1).count():
        raise TableError(f"{table.schema} has no row {index}")
    return table.df.where(F.col(ROW) == index).select(F.col(ROW).alias("row_idx"), *(shown_cell(shown(table, c.mnemonic), c.mnemonic).alias(c.mnemonic) for c in table.columns))


def empty_note(table: Table, found: int) -> str | None:
    """Why a result is empty: no rows at all, or none that passed."""
    if found:
        return None
    total = table.df.count()
    return f"{table.schema} has no rows" if not total else f"none of the {total} rows of {table.schema} passed the filter"
