"""Relations between two tables: an interval that contains a point, or equal display values.

Containment is planned as an equi-join.  Intervals are sorted into levels by their
length, a level's bins are at least as wide as its intervals, so an interval lies in at
most two bins.  A point gets its bin for each level in use, at most 64.  No interval is
exploded into many bins, however long, and no nested loop is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.model import ROW, Table, TableError
from traceloom.plans import predicates as P

TOP, LIST_LIMIT, LIST_MOST = 10, 20, 200


def containing(a: DataFrame, b: DataFrame, start: str, duration: str, time: str, on: list[tuple[str, str]] | None = None, levels: list[int] | None = None) -> DataFrame:
    """Inner join of intervals a and points b where start <= time <= start + duration.

    Column names of a and b must differ.  Null or negative durations, and null times, match nothing.
    """
    a = a.where(F.col(start).isNotNull() & (F.col(duration) >= 0)).withColumn("__level", F.length(F.bin(F.col(duration))).cast("int"))
    if levels is None:
        levels = sorted(r[0] for r in a.select("__level").distinct().collect())  # at most 64
    width = lambda level: F.expr(f"shiftleft(1L, {level})")
    first = F.floor(F.col(start) / width("__level"))
    last = F.floor((F.col(start) + F.col(duration)) / width("__level"))
    a = a.withColumn("__bin", F.explode(F.array_distinct(F.array(first, last))))
    if not levels:
        levels = [0]
    spread = F.explode(F.array(*(F.lit(x) for x in levels)))
    b = b.where(F.col(time).isNotNull()).withColumn("__blevel", spread).withColumn("__bbin", F.floor(F.col(time) / width("__blevel")))
    inside = (F.col(time) >= F.col(start)) & (F.col(time) <= F.col(start) + F.col(duration))
    keys = (F.col("__level") == F.col("__blevel")) & (F.col("__bin") == F.col("__bbin"))
    return a.join(b, P.all_of([keys, inside, *(F.col(x) == F.col(y) for x, y in on or [])])).drop("__level", "__bin", "__blevel", "__bbin")


@dataclass
class Relation:
    """How A's rows and B's rows belong together, and what is counted."""

    a: Table
    b: Table
    group_by: str
    condition: str = "time-range"  # or "equality"
    on: list[tuple[str, str]] | None = None
    match_thread: bool = True
    measure: str | None = None
    a_filter: dict | None = None
    b_filter: dict | None = None
    start: int | None = None
    end: int | None = None

    def __post_init__(self) -> None:
        if self.condition not in ("time-range", "equality"):
            raise TableError("a relation's condition is time-range or equality")
        if self.condition == "equality" and not self.on:
            raise TableError("an equality relation needs pairs of columns")
        for t, names in ((self.a, [self.group_by, *(x for x, _ in self.on or [])]), (self.b, [y for _, y in self.on or []])):
            for n in names:
                if t.column(n) is None:
                    raise TableError(f"{t.schema} has no column {n!r}")
        self.threads = None
        if self.condition == "time-range":
            if self.a.time_column() is None or self.a.duration_column() is None or self.b.time_column() is None:
                raise TableError("containment needs a time and a duration in the first table and a time in the second")
            if self.match_thread:
                self.threads = (self.a.thread_column(), self.b.thread_column())
                if None in self.threads:
                    raise TableError("matching threads needs a thread column in both tables")

    def left(self) -> DataFrame:
        """A's filtered rows with a group label, before any join."""
        a = self.a.where(P.filter_map(self.a, self.a_filter) & P.time_range(self.a, self.start, self.end) & self.a.fmt(self.group_by).isNotNull())
        keys = [a.fmt(x).alias(f"a_on{i}") for i, (x, _) in enumerate(self.on or [])]
        if self.condition == "time-range":
            keys += [a.raw(a.time_column()).cast("long").alias("a_start"), a.raw(a.duration_column()).cast("long").alias("a_duration")]
            keys += [a.fmt(self.threads[0]).alias("a_thread")] if self.threads else []
        own = [a.raw(self.measure).cast("double").alias("a_measure")] if self.measure and self.a.column(self.measure) else []
        return a.df.select(F.col(ROW).alias("a_row"), a.fmt(self.group_by).alias("a_label"), *keys, *own)

    def right(self) -> DataFrame:
        b = self.b.where(P.filter_map(self.b, self.b_filter) & P.time_range(self.b, self.start, self.end))
        keys = [b.fmt(y).alias(f"b_on{i}") for i, (_, y) in enumerate(self.on or [])]
        if self.condition == "time-range":
            keys += [b.raw(b.time_column()).cast("long").alias("b_time")]
            keys += [b.fmt(self.threads[1]).alias("b_thread")] if self.threads else []
        measure = b.raw(self.measure).cast("double") if self.measure and self.b.column(self.measure) else F.lit(None).cast("double")
        return b.df.select(F.col(ROW).alias("b_row"), measure.alias("b_measure"), *keys)

    def matches(self) -> DataFrame:
        """A row per matching pair."""
        a, b = self.left(), self.right()
        if self.condition == "equality":
            return a.join(b, P.all_of([F.col(f"a_on{i}") == F.col(f"b_on{i}") for i in range(len(self.on))]))
        return containing(a, b, "a_start", "a_duration", "b_time", [("a_thread", "b_thread")] if self.threads else None)

    def per_row(self) -> DataFrame:
        """A's rows with the number of matches and the sum of B's measure over them."""
        if self.condition == "equality":  # B is summed by its keys first, so the pairs are never made
            n = range(len(self.on))
            b = self.right().groupBy(*(f"b_on{i}" for i in n)).agg(F.count("*").alias("matches"), F.sum("b_measure").alias("matched"))
            return self.left().join(b, P.all_of([F.col(f"a_on{i}") == F.col(f"b_on{i}") for i in n]), "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
        found = self.matches().groupBy("a_row").agg(F.count("*").alias("matches"), F.sum("b_measure").alias("matched"))
        return self.left().join(found, "a_row", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))

    def groups(self, exists: bool = True) -> DataFrame:
        """By A's label: rows, matches, rows with and without a match, and the measure's sum.

        With exists the measure is B's over matches, else A's over rows without any.
        """
        rows = self.per_row()
        measure = F.col("matched") if exists else F.when(F.col("matches") == 0, F.col("a_measure")) if "a_measure" in rows.columns else F.lit(None).cast("double")
        out = rows.groupBy(F.col("a_label").alias("label")).agg(
            F.count("*").alias("a_count"), F.sum("matches").alias("match_count"), F.count_if(F.col("matches") > 0).alias("a_matched"), F.count_if(F.col("matches") == 0).alias("a_unmatched"), F.sum(measure).alias("measure_sum")
        )
        return out

    def top(self, exists: bool = True, n: int = TOP) -> DataFrame:
        return self.groups(exists).orderBy(F.desc("match_count" if exists else "a_unmatched"), "label").limit(n)

    def rows(self, exists: bool = True, limit: int | None = LIST_LIMIT) -> DataFrame:
        """A's rows that have, or lack, a match, in row order; limit=None gives all."""
        a = self.left()
        if self.condition == "equality":
            b = self.right().select(*(f"b_on{i}" for i in range(len(self.on))))
            out = a.join(b, P.all_of([F.col(f"a_on{i}") == F.col(f"b_on{i}") for i in range(len(self.on))]), "left_semi" if exists else "left_anti")
        else:
            out = a.join(self.matches().select("a_row").distinct(), "a_row", "left_semi" if exists else "left_anti")
        out = out.select(F.col("a_row").alias("row_idx"), F.col("a_label").alias("label"))
        return out if limit is None else out.orderBy("row_idx").limit(min(limit, LIST_MOST))

    def thread_note(self) -> str | None:
        """Whether nothing matches on the same thread though something does on any."""
        if not self.threads or self.matches().limit(1).count():
            return None
        anyway = Relation(self.a, self.b, self.group_by, self.condition, self.on, False, self.measure, self.a_filter, self.b_filter, self.start, self.end)
        return "no match on the same thread, but there are some on other threads" if anyway.matches().limit(1).count() else None


def summary(groups: DataFrame, exists: bool) -> str:
    row = groups.agg(F.sum("a_count").alias("a"), F.sum("a_matched").alias("m"), F.sum("a_unmatched").alias("u"), F.sum("match_count").alias("n")).first()
    return f"{row['m'] or 0} of {row['a'] or 0} rows have a match, {row['n'] or 0} matches" if exists else f"{row['u'] or 0} of {row['a'] or 0} rows have no match"


def correlate(a: Table, b: Table, group_by: str, measure: str | None = None, top: int = TOP, **how) -> DataFrame:
    """Which of A's intervals contain most of B's points."""
    out = Relation(a, b, group_by, measure=measure, **how).top(True, top)
    return out.select("label", F.col("a_count").alias("windows"), F.col("match_count").alias("events_inside"), F.col("a_matched").alias("windows_with_events"), F.col("measure_sum").alias("measure_inside"))


def last_by(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of the rows with one key the last: one aggregation, no sort of a key's rows."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("__last")).select(key, *(F.col(f"__last.{c}").alias(c) for c in columns))


def nearest_within(a: DataFrame, b: DataFrame, time_a: str, time_b: str, tolerance: int, row_a: str) -> DataFrame:
    """For each row of a the first row of b in time order that is no further than tolerance."""
    spans = a.withColumn("__from", F.col(time_a) - F.lit(tolerance)).withColumn("__span", F.lit(2 * tolerance).cast("long"))
    found = containing(spans, b, "__from", "__span", time_b).drop("__from", "__span")
    names = [c for c in b.columns]
    first = found.groupBy(row_a).agg(F.min_by(F.struct(*names), F.col(time_b)).alias("__b"))
    return a.join(first.select(row_a, *(F.col(f"__b.{c}").alias(c) for c in names)), row_a, "left")


def overlap_rows(table: Table, start: int, end: int) -> Column:
    return P.overlaps(table.raw(table.time_column()), table.raw(table.duration_column()), start, end)
