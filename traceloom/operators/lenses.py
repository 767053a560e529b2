"""Presets for kinds of tables: requests, updates, leaks, connections, hangs, run loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.expressions import snippet
from traceloom.model import ROW, Catalog, Table, TableError
from traceloom.operators import aggregate as A
from traceloom.operators import relate as R
from traceloom.operators import rows as Q
from traceloom.plans import predicates as P

REQUESTS, MOST = 50, 200
#: Share of leaks without an allocation from which the recording is said to have begun late.
UNATTRIBUTED_SHARE = 0.5
#: How a time at the start of a recording is shown.
AT_START = "00:00.000.000"


def list_requests(table: Table, text: str, columns: list[str], limit: int = REQUESTS, offset: int = 0, errors: str | None = None) -> DataFrame:
    """A page of requests with the beginning of their text, and whether they have errors."""
    flag = [(table.raw(errors).cast("string").try_cast("long") > 0).alias("has_error")] if errors else []
    rows = table.df.orderBy(ROW).offset(offset).limit(max(1, min(limit, MOST)))
    return rows.select(F.col(ROW).alias("row_idx"), *(table.fmt(c).alias(c) for c in columns), snippet(table.fmt(text)).alias("snippet"), *flag)


def find_requests(table: Table, min_duration_ns: int | None = None, has_errors: bool | None = None, contains: dict[str, str] | None = None, **page) -> DataFrame:
    """Requests that are long, failed or not, or hold a text in a column."""
    where = [{"field": table.duration_column(), "op": "gte", "val": min_duration_ns}] if min_duration_ns is not None else []
    if has_errors is not None:
        where.append({"field": "error-count", "op": "gt" if has_errors else "eq", "val": 0})
    where += [{"field": k, "op": "contains", "val": v} for k, v in (contains or {}).items()]
    return Q.find(table, where, **page)


def request_detail(table: Table, index: int, columns: list[str]) -> DataFrame:
    """Texts of one row, whole, with their lengths; JSON is given as normalised JSON, other text as it is."""
    if not table.df.where(F.col(ROW) == index).limit(1).count():
        raise TableError(f"{table.schema} has no row {index}")
    picked = []
    for c in columns:
        text = table.fmt(c)
        picked += [F.coalesce(F.expr(f"to_json(try_parse_json(`{c}`))") if f"{c}__fmt" not in table.df.columns else text, text).alias(c), F.length(text).alias(f"{c}_length")]
    return table.df.where(F.col(ROW) == index).select(F.col(ROW).alias("row_idx"), *picked)


def related_events(table: Table, index: int, key: str) -> DataFrame:
    """Rows with the same key as one row; null keys belong together."""
    anchor = table.df.where(F.col(ROW) == index).select(table.raw(key).alias("__key")).limit(1)
    return table.df.join(F.broadcast(anchor), table.raw(key).eqNullSafe(F.col("__key")), "left_semi").orderBy(ROW)  # anchor is one row


def first_times(df: DataFrame, key: str, kind: str, time: str, marks: dict[str, str]) -> DataFrame:
    """By key the first time of each kind of event."""
    return df.groupBy(key).agg(*(F.min(F.when(F.col(kind) == v, F.col(time))).alias(k) for k, v in marks.items()))


def request_timing(table: Table, message: str = "message", request: str | None = None) -> DataFrame:
    """By request the milliseconds before the first answer, while it is made, and in all, and its token counts.

    Messages read tag,event,request,turn,session::{json}; the request is the third field, what
    happened is the JSON's event.  Of several alike the first row counts.
    """
    text = table.fmt(message)
    tail = F.substring(text, F.instr(text, "::") + 2, F.length(text))
    rows = table.df.where(F.instr(text, "::") > 0).select(ROW, F.get(F.split(F.substring_index(text, "::", 1), ","), F.lit(2)).alias("request"), F.get_json_object(tail, "$.event").alias("event"), tail.alias("tail"), table.raw(table.time_column()).alias("time"))
    rows = rows.where("request != ''" if request is None else F.col("request") == request)
    first = lambda c, event: F.min_by(c, F.when(F.col("event") == event, F.col(ROW)))
    t = rows.groupBy("request").agg(first("time", "request_start").alias("asked"), first("time", "response_start").alias("began"), first("time", "response_complete").alias("done"), first("tail", "response_complete").alias("tail"))
    ms = lambda a, b: ((F.col(b) - F.col(a)) / 1e6)
    count = lambda c: F.get_json_object("tail", f"$.data.{c}").try_cast("double")
    return t.select("request", ms("asked", "began").alias("prefill_ms"), ms("began", "done").alias("generation_ms"), ms("asked", "done").alias("total_ms"), count("cachedTokenCount").alias("cached_tokens"), count("consumedTokenCount").alias("consumed_tokens"), count("generatedTokenCount").alias("generated_tokens"), count("deltasCount").alias("deltas"))


def list_updates(catalog: Catalog, schema: str, position: int, light: list[str] | None = None, **page) -> DataFrame:
    """A page of one of several tables of a schema; wide columns only on request."""
    return Q.query(catalog.get(schema, position=position), light, **page)


def aggregate_updates(catalog: Catalog, schema: str, position: int, group_by: str, measure: str | None = None, op: str = "sum", **how) -> DataFrame:
    if op not in ("sum", "count", "avg"):
        raise TableError("updates are summed, counted or averaged")
    return A.aggregate(catalog.get(schema, position=position), group_by, measure, op, **how)


def unattributed(leaks: DataFrame, allocations: DataFrame, address: str, order: str, columns: list[str]) -> DataFrame:
    """How many leaks have no allocation at their address; of several the last counts."""
    last = R.last_by(allocations, address, order, [order, *columns])
    return leaks.join(last.withColumnRenamed(order, "__row"), address, "left").agg(F.count_if(F.col("__row").isNull()).alias("unattributed"), F.count("*").alias("total"))


def recording_began_late(leaks: DataFrame, allocations: DataFrame, address: str, order: str) -> bool:
    row = unattributed(leaks, allocations, address, order, []).first()
    return row["total"] > 0 and row["unattributed"] / row["total"] >= UNATTRIBUTED_SHARE


def open_at_start(table: Table, time: str = "time") -> DataFrame:
    """Connections that were there when the recording began."""
    return table.df.where(table.fmt(time) == AT_START).agg(F.count("*").alias("open_at_start"))


def hangs(table: Table) -> DataFrame:
    return A.aggregate(table, "hang-type", table.duration_column(), "sum")


def thermal(states: Table, samples: Table | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Time in each thermal state, and the samples taken in it."""
    return A.aggregate(states, "thermal-state", states.duration_column(), "sum"), R.correlate(states, samples, "thermal-state", match_thread=False) if samples else None


def busy_main_turns(table: Table, **page) -> DataFrame:
    return Q.find(table, [{"field": "interval-type", "op": "eq", "val": "Busy"}, {"field": "is-main", "op": "eq", "val": True}], **page)


def run_loop_time(table: Table) -> DataFrame:
    return A.aggregate(table, "interval-type", table.duration_column(), "sum")


def runtime_issues(table: Table, subsystem: str, kind: str, categories: list[str], **page) -> DataFrame:
    return Q.find(table, [{"field": "subsystem", "op": "eq", "val": subsystem}, {"field": "message-type", "op": "eq", "val": kind}, {"anyOf": [{"field": "category", "op": "eq", "val": c} for c in categories]}], **page)


#: What to look at first in a schema: verb and arguments.
QUICK_START: dict[str, list[tuple[str, dict]]] = {
    "time-sample": [("call_tree", {"view": "hot"})],
    "potential-hangs": [("aggregate", {"group_by": "hang-type", "measure": "duration"})],
    "hitches": [("aggregate", {"group_by": "is-system", "op": "count"})],
    "runloop-intervals": [("aggregate", {"group_by": "interval-type", "measure": "duration"})],
    "fs-syscall": [("aggregate", {"group_by": "syscall", "measure": "duration"}), ("aggregate", {"group_by": "path", "measure": "bytes"})],
    "core-data-fetch": [("aggregate", {"group_by": "fetch-entity", "measure": "duration"})],
    "core-data-fault": [("aggregate", {"group_by": "fault-object", "measure": "fault-duration"})],
    "core-data-save": [("aggregate", {"group_by": "thread", "measure": "duration"})],
    "Allocations/Allocations List": [("aggregate", {"group_by": "category", "measure": "size"}), ("call_tree", {"view": "tree"})],
    "SwiftTaskLifetime": [("aggregate", {"group_by": "process", "measure": "duration"})],
    "swiftui-updates": [("aggregate", {"group_by": "description", "measure": "duration"})],
}


def renamed(table: Table, names: dict[str, str]) -> DataFrame:
    """Columns by new names; those that the table lacks are left out."""
    return table.df.select(*(table.raw(m).alias(n) for n, m in names.items() if m in table.names()))


def by_roles(table: Table, roles: list[str]) -> DataFrame:
    """The first column of each role, named by the role."""
    picked: list[Column] = [table.raw(c).alias(r) for r in roles if (c := table.first_with_role(r))]
    return table.df.select(*picked)


def in_condition(table: Table, name: str, values: list) -> Column:
    return P.any_of([P.equals(table, name, v) for v in values])
