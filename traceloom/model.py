"""Tables of cells: a raw value, a display value, and what is known of each column.

A table is a DataFrame with a column ``m`` of raw values for each mnemonic ``m`` and, where
raw and display differ, ``m__fmt`` with the display text.  Nested cells are structs, so a
dot path is a column reference.  ``_row_idx`` numbers the rows densely from 0.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.plans import roles

ROW = "_row_idx"


class TableError(ValueError):
    """A request that does not fit the table."""


@dataclass(frozen=True)
class Column:
    mnemonic: str
    type: str = "string"
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.mnemonic


@dataclass
class Table:
    """A schema's rows with its columns; ``hints`` overrides what is derived from the types."""

    schema: str
    df: DataFrame
    columns: list[Column]
    run: int = 1
    position: int = 1
    hints: dict = field(default_factory=dict)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.mnemonic == name), None)

    def classified(self) -> list[roles.Classified]:
        return roles.classify_table(self.schema, self.columns, self.hints)

    def names(self) -> list[str]:
        """Mnemonics, and the dot paths of nested fields."""
        out = []
        for c in self.columns:
            out.append(c.mnemonic)
            if c.mnemonic in self.df.columns and isinstance(kind := self.df.schema[c.mnemonic].dataType, T.StructType):
                out += _paths(c.mnemonic, kind)
        return out

    def is_stack(self, name: str) -> bool:
        c = self.column(name)
        return c is not None and roles.of_type(c.type).role == "backtrace"

    def resolve(self, name: str, compare: bool = True) -> str:
        """The column reference of a mnemonic or dot path; stacks cannot be compared."""
        if name not in self.names():
            raise TableError(f"unknown column {name!r} of {self.schema}; it has {', '.join(self.names())}")
        if compare and self.is_stack(name):
            raise TableError(f"{name!r} holds call stacks, which cannot be compared, sorted or grouped")
        if compare and isinstance(column_type(self.df.schema, name), T.StructType) and f"{name}__fmt" not in self.df.columns:
            raise TableError(f"{name!r} is a compound; take one of its fields")
        return name

    def raw(self, name: str) -> Expr:
        if isinstance(column_type(self.df.schema, name), T.StructType):  # a compound counts as its summary
            return F.col(f"`{name}__fmt`")
        return F.col(".".join(f"`{p}`" for p in name.split(".")))

    def fmt(self, name: str) -> Expr:
        return F.col(f"`{name}__fmt`") if f"{name}__fmt" in self.df.columns else self.raw(name).cast("string")

    def type_of(self, name: str) -> str | None:
        c = self.column(name)
        return c.type if c else None

    def first_with_role(self, role: str) -> str | None:
        return next((c.mnemonic for c in self.classified() if c.role == role), None)

    def time_column(self) -> str | None:
        return roles.primary_time(self.schema, self.classified(), self.hints)

    def duration_column(self) -> str | None:
        return roles.duration_column(self.schema, self.classified(), self.hints)

    def thread_column(self) -> str | None:
        return roles.preferred_thread(self.columns, self.classified())

    def stack_column(self) -> str | None:
        return self.first_with_role("backtrace")

    def label_column(self) -> str | None:
        return self.first_with_role("label") or self.first_with_role("thread")

    def where(self, condition: Expr) -> Table:
        return Table(self.schema, self.df.where(condition), self.columns, self.run, self.position, self.hints)


def _paths(head: str, kind: T.StructType) -> list[str]:
    out = []
    for f in kind.fields:
        out.append(f"{head}.{f.name}")
        if isinstance(f.dataType, T.StructType):
            out += _paths(out[-1], f.dataType)
    return out


def column_type(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


class Catalog:
    """Tables by run, schema and position; a request without run takes the last run."""

    def __init__(self, tables: Iterable[Table] = ()):
        self._tables: list[Table] = list(tables)

    def add(self, table: Table) -> None:
        self._tables.append(table)

    def runs(self) -> list[int]:
        return sorted({t.run for t in self._tables})

    def schemas(self, run: int | None = None) -> list[str]:
        return sorted({t.schema for t in self._tables if run is None or t.run == run})

    def get(self, schema: str, run: int | None = None, position: int | None = None) -> Table:
        run = self.runs()[-1] if run is None and self._tables else run
        found = [t for t in self._tables if t.schema == schema and t.run == run]
        if not found:
            raise TableError(f"no schema {schema!r} in run {run}; it has {', '.join(self.schemas(run))}")
        if position is not None:
            found = [t for t in found if t.position == position]
            if not found:
                raise TableError(f"{schema!r} has no position {position}")
        if len(found) > 1:
            raise TableError(f"{schema!r} is ambiguous: choose a position from {[t.position for t in found]}")
        return found[0]

    def instruments(self) -> dict:
        """Schemas of each run, those in all runs, and those that some runs lack."""
        by_run = {r: self.schemas(r) for r in self.runs()}
        sets = [set(s) for s in by_run.values()]
        common = set.intersection(*sets) if sets else set()
        return {"by_run": by_run, "in_all_runs": sorted(common), "differences": {r: sorted(set(s) - common) for r, s in by_run.items()}}


def with_row_index(df: DataFrame, *order: str) -> DataFrame:
    """df with a dense _row_idx in the order given, without gathering rows in one task.

    The range-partitioned, sorted rows are written once to the shared folder, numbered within
    their partitions.  Counts and rows are both read from there, so the offsets fit even
    if the sort would come out otherwise when it is run again, or partitions are merged.
    """
    import uuid

    from pyspark.sql import Window

    spark, place = df.sparkSession, "_row_place"
    while place in df.columns:
        place = f"_{place}"
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{root.rstrip('/')}/row-index-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(place, T.LongType())])).parquet(path)
    part, own = F.expr(f"shiftright({place}, 33)"), F.expr(f"{place} & {(1 << 33) - 1}L")
    counts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per partition
    at = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    out = stored.select(at, part.alias("_part"), own.alias("_own")).join(F.broadcast(before), "_part")
    return out.select("_row.*", (F.col("_own") + F.col("_before")).cast("long").alias(ROW))
