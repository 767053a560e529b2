"""Grouped aggregation on display values, with exact nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.expressions import format_unit
from traceloom.model import Table, TableError
from traceloom.plans import predicates as P
from traceloom.plans import roles

PERCENTILES = {"p50": 0.5, "median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
OPS = ("count", "sum", "avg", "min", "max", *PERCENTILES)
TOP = 10
#: Keys under which sums and means count some time twice.
NOT_PARTITIONING = {"frame-color": ("hitches", "hitches-renders", "hitches-gpu", "hitches-updates")}


def _value(op: str) -> Column:
    if op in PERCENTILES:
        return F.expr(f"percentile_disc({PERCENTILES[op]}) WITHIN GROUP (ORDER BY __measure)")
    return F.count("*").cast("double") if op == "count" else getattr(F, op)("__measure")


def summable(table: Table, measure: str) -> None:
    """An error for a measure whose type names things instead of counting them."""
    kind = table.type_of(measure)
    if kind and roles.facts(kind).categorical:
        good = [c.mnemonic for c in table.columns if not roles.facts(c.type).categorical]
        raise TableError(f"{measure!r} has the categorical type {kind!r}; measures are {', '.join(good)}")


def grouped(table: Table, group_by: str | list[str], measure: str | None = None, op: str = "sum", filter: dict | None = None, start: int | None = None, end: int | None = None, having: dict | None = None) -> DataFrame:
    """All groups: key, the parts of the key, value and rows.

    Rows with a null in any key are in no group.  Values of the type's mark for missing
    and null or non-finite measures are left out.  having: minValue, maxValue, minRowCount, maxRowCount.
    """
    if op not in OPS:
        raise TableError(f"unknown op {op!r}; there are {', '.join(OPS)}")
    if op != "count" and not measure:
        raise TableError(f"{op} needs a measure")
    keys = [table.resolve(k) for k in ([group_by] if isinstance(group_by, str) else group_by)]
    parts = [F.col(f"__key{i}") for i in range(len(keys))]
    condition = P.filter_map(table, filter) & P.time_range(table, start, end)
    columns = [table.fmt(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    if op != "count":
        summable(table, measure)
        value = table.raw(table.resolve(measure)).cast("string").try_cast("double") if dict(table.df.dtypes).get(measure) == "string" else table.raw(table.resolve(measure)).cast("double")
        if (missing := P.max_sentinel(table, measure)) is not None:
            condition &= ~missing
        columns.append(value.alias("__measure"))
    rows = table.df.where(condition).select(*columns).where(P.all_of([p.isNotNull() for p in parts]))
    if op != "count":
        rows = rows.where(F.col("__measure").isNotNull())
        if op in PERCENTILES:
            rows = rows.where(~F.isnan("__measure") & (F.abs("__measure") < float("inf")))
    out = rows.groupBy(*(f"__key{i}" for i in range(len(keys)))).agg(F.coalesce(_value(op), F.lit(0.0)).alias("value"), F.count("*").alias("row_count"))
    for name, c, fits in (("minValue", "value", ">="), ("maxValue", "value", "<="), ("minRowCount", "row_count", ">="), ("maxRowCount", "row_count", "<=")):
        if having and having.get(name) is not None:
            out = out.where(F.expr(f"{c} {fits} {having[name]}"))
    return out.select(F.concat_ws(" / ", *parts).alias("group_key"), F.array(*parts).alias("key_parts"), "value", "row_count")


def aggregate(table: Table, group_by: str | list[str], measure: str | None = None, op: str = "sum", top: int | None = TOP, unit: str | None = None, **how) -> DataFrame:
    """The groups with the largest values, whatever the op; ties by key.  top=None gives all groups."""
    out = grouped(table, group_by, measure, op, **how)
    if unit is None and measure and op != "count":
        unit = next((c.unit for c in table.classified() if c.mnemonic == measure), None)
    out = out.withColumn("shown", format_unit(F.col("value"), unit))
    return out.orderBy(F.desc("value"), "group_key").limit(top) if top else out


def totals(table: Table, group_by: str | list[str], measure: str | None = None, op: str = "sum", filter: dict | None = None, start: int | None = None, end: int | None = None, having: dict | None = None) -> dict:
    """Rows before the grouping, groups after having, and rows left out as marks for missing."""
    condition = P.filter_map(table, filter) & P.time_range(table, start, end)
    missing = P.max_sentinel(table, measure) if measure and op != "count" else None
    row = table.df.where(condition).agg(F.count("*").alias("rows"), (F.count_if(missing) if missing is not None else F.lit(0)).alias("missing")).first()
    groups = grouped(table, group_by, measure, op, filter, start, end, having).count()
    return {"total_rows": row["rows"], "total_groups": groups, "sentinel_rows": row["missing"]}


def notes(table: Table, group_by: str | list[str], op: str, result: DataFrame, total_rows: int) -> list[str]:
    """Warnings: the top group has a blank key, or the key does not partition what is summed."""
    out, keys = [], [group_by] if isinstance(group_by, str) else group_by
    top = result.limit(1).collect()
    if len(keys) == 1 and top and top[0]["group_key"] == "":
        out.append(f"the top group has a blank key: {100 * top[0]['row_count'] / max(1, total_rows):.1f} % of the rows")
    if op in ("sum", "avg"):
        out += [f"groups by {k!r} overlap in time in {table.schema}" for k in keys if table.schema in NOT_PARTITIONING.get(k, ())]
    return out
