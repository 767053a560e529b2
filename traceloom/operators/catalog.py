"""What tables there are, what their columns mean, and how they can be related."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from traceloom.model import Catalog, Table

# How many rows make a table small, medium, large; more are a firehose.
SIZES = [(0, "empty"), (999, "small"), (49_999, "medium"), (499_999, "large")]


def describe(spark: SparkSession, catalog: Catalog, schema: str | None = None) -> DataFrame:
    """A row per column: type, role, unit, how sure that is, and whether it is the primary time or weight."""
    rows = []
    for name in [schema] if schema else catalog.schemas(catalog.runs()[-1]):
        t = catalog.get(name)
        for c in t.classified():
            nested = [n for n in t.names() if n.startswith(f"{c.mnemonic}.")]
            rows.append((name, c.mnemonic, c.type, c.role, c.unit, c.confidence, c.mnemonic == t.time_column(), c.mnemonic == t.duration_column(), ", ".join(nested)))
    return spark.createDataFrame(rows, "schema string, mnemonic string, type string, role string, unit string, confidence string, primary_time boolean, primary_weight boolean, nested string")


def size_tier(rows: int) -> str:
    return next((name for most, name in SIZES if rows <= most), "firehose")


def grain(table: Table) -> str:
    """interval, point, or aggregate, by the roles that the table has."""
    if table.time_column() is None:
        return "aggregate"
    return "interval" if any(c.role == "weight" and c.unit == "nanoseconds" for c in table.classified()) else "point"


def hints(table: Table, rows: int | None = None) -> dict:
    """Grain, size, and what to watch out for."""
    rows = table.df.count() if rows is None else rows
    notes = []
    if size_tier(rows) in ("large", "firehose"):
        notes.append("filter by time before listing rows")
    if table.stack_column():
        notes.append("fold call stacks instead of listing them")
    if table.thread_column() is None:
        notes.append("there is no thread column: relations match on time alone")
    return {"grain": grain(table), "size": size_tier(rows), "rows": rows, "notes": notes}


@dataclass(frozen=True)
class Edge:
    """A way to relate two schemas; a has the smaller name."""

    a: str
    b: str
    kind: str  # time-window, tuple or equi
    keys: tuple[tuple[str, str], ...]
    curated: bool = False

    def inverted(self) -> Edge:
        return Edge(self.b, self.a, self.kind, tuple((y, x) for x, y in self.keys), self.curated)


@dataclass
class EdgeRegistry:
    """Derived edges of all pairs of schemas; a curated edge takes the place of the derived ones of its pair."""

    curated: list[Edge] = field(default_factory=list)

    def edges(self, tables: list[Table]) -> list[Edge]:
        out, there = [], {t.schema for t in tables}
        known = {(e.a, e.b): e for e in (e if e.a <= e.b else e.inverted() for e in self.curated)}
        for x, y in combinations(sorted(tables, key=lambda t: t.schema), 2):
            if e := known.get((x.schema, y.schema)):
                out.append(e)
                continue
            times, threads = (x.time_column(), y.time_column()), (x.thread_column(), y.thread_column())
            if None not in times:
                out.append(Edge(x.schema, y.schema, "time-window", (times,)))
                if None not in threads:
                    out.append(Edge(x.schema, y.schema, "tuple", (threads, times)))
            elif None not in threads:
                out.append(Edge(x.schema, y.schema, "equi", (threads,)))
        assert all(e.a in there and e.b in there for e in out)
        return out

    def latent(self, tables: list[Table]) -> list[Edge]:
        """Curated edges from a table that is there to one that is not."""
        there = {t.schema for t in tables}
        return [e for e in self.curated if (e.a in there) != (e.b in there)]


def edges(catalog: Catalog, curated: list[Edge] | None = None) -> list[Edge]:
    run = catalog.runs()[-1]
    return EdgeRegistry(curated or []).edges([catalog.get(s, run) for s in catalog.schemas(run)])


class CallMemo:
    """Results by verb, run, schema and arguments, whatever the arguments' order."""

    def __init__(self) -> None:
        self._held: dict[str, object] = {}

    @staticmethod
    def key(verb: str, run: int | None, schema: str, arguments: dict) -> str:
        return f"{verb}:{run}:{schema}:{json.dumps(arguments, sort_keys=True, default=str)}"

    def get(self, verb: str, run: int | None, schema: str, arguments: dict, make):
        k = self.key(verb, run, schema, arguments)
        if k not in self._held:
            self._held[k] = make()
        return self._held[k]

    def clear(self) -> None:
        self._held.clear()


@dataclass
class Response:
    """A result with a line about it, and what to do next; one step at most is recommended."""

    summary: str
    data: object
    next_actions: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        for extra in [a for a in self.next_actions if a.get("recommended")][1:]:
            extra["recommended"] = False
