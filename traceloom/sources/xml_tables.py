"""Readers of exported tables in two XML dialects, and a Parquet store for what was read.

A schema-table declares its columns; each row has one cell per column, by position.  A
cell may give an ``id`` and later cells refer to it by ``ref``, across rows; ``<sentinel/>``
is null.  A track-detail has rows of attributes, and call stacks as nested frames; its
columns are what its rows have.

Files are read by Spark as binary files, so any file system that Spark reaches will do, and
each is parsed as a stream on an executor.  References stay within a file, so a file is the
unit of work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.functions.expressions import clock_ns
from traceloom.model import ROW, Column, Table
from traceloom.plans import roles

#: Nested cells become columns down to this depth.
DEPTH = 6
SAMPLE = 20
STACKS = {"backtrace", "text-backtrace", "tagged-backtrace"}
SAFE = 2**53 - 1
FRAME = "array<struct<name:string,addr:string,binary:string,binary_path:string>>"


@dataclass
class Cell:
    type: str
    raw: str | None = None
    fmt: str | None = None
    children: list[Cell] = field(default_factory=list)
    frames: list[dict] | None = None
    attributes: dict = field(default_factory=dict)


class _Tree:
    """Builds cells of one row at a time from expat's events; ids of a node are kept for its refs."""

    def __init__(self, emit, columns):
        self.emit, self.columns = emit, columns
        self.known: dict[str, Cell] = {}
        self.stack: list[Cell | None] = []
        self.text: list[str] = []
        self.column: dict | None = None
        self.part: str | None = None

    def start(self, tag: str, attrs: dict) -> None:
        self.text = []
        if tag == "node" and not self.stack:
            self.known = {}
        elif tag == "col" and not self.stack:
            self.column = {}
        elif self.column is not None:
            self.part = tag
        elif tag == "row" or self.stack:
            if "ref" in attrs:
                cell = self.known.get(attrs["ref"], Cell(tag))
            elif tag == "sentinel":
                cell = None
            else:
                cell = Cell(tag, fmt=attrs.get("fmt"), attributes=attrs)
                if "id" in attrs:
                    self.known[attrs["id"]] = cell
            if self.stack and self.stack[-1] is not None:
                self.stack[-1].children.append(cell)
            self.stack.append(cell)

    def data(self, text: str) -> None:
        self.text.append(text)

    def end(self, tag: str) -> None:
        text = "".join(self.text).strip()
        if self.column is not None:
            if tag == "col":
                self.columns.append((self.column.get("mnemonic", ""), self.column.get("engineering-type", "string"), self.column.get("name")))
                self.column = None
            elif self.part == tag:
                self.column[tag] = text
        elif self.stack:
            cell = self.stack.pop()
            if cell is not None and text and cell.raw is None and not cell.children:
                cell.raw = text
            if tag == "row" and not self.stack:
                self.emit(cell)
        self.text = []


def _frames(cell: Cell) -> list[dict] | None:
    found = []

    def walk(c: Cell) -> None:
        for x in c.children:
            if x is None:
                continue
            if x.type == "frame":
                binary = next((y for y in x.children if y is not None and y.type == "binary"), None)
                b = binary.attributes if binary else {}
                found.append({"name": x.attributes.get("name", ""), "addr": x.attributes.get("addr"), "binary": b.get("name"), "binary_path": b.get("path")})
            else:
                walk(x)

    walk(cell)
    return found or None


def _flat(prefix: str, cell: Cell, depth: int, out: dict) -> None:
    """A cell and its nested cells by dot path: raw and display text."""
    if cell.type in STACKS or any(x is not None and x.type == "frame" for x in cell.children):
        if frames := _frames(cell):
            out[prefix] = ("frames", json.dumps(frames))
        return
    raw = cell.raw if cell.raw is not None else cell.fmt if cell.children else None
    out[prefix] = (raw, cell.fmt if cell.fmt is not None else raw)
    if depth < DEPTH:
        for x in cell.children:
            if x is not None:
                _flat(f"{prefix}.{x.type}", x, depth + 1, out)


def parse(content: bytes, each) -> list[tuple[str, str, str | None]]:
    """Calls each with every row's cells {path: (raw, fmt)}; returns the declared columns."""
    columns: list[tuple[str, str, str | None]] = []

    def emit(row: Cell) -> None:
        cells: dict = {}
        if columns:
            for (mnemonic, _, _), cell in zip(columns, row.children, strict=False):
                if cell is not None:
                    _flat(mnemonic, cell, 1, cells)
        else:
            for k, v in row.attributes.items():
                cells[k] = (v, v)
            if any(x is not None for x in row.children) and (frames := _frames(row)):
                cells["backtrace"] = ("frames", json.dumps(frames))
        each(cells)

    tree = _Tree(emit, columns)
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = tree.start, tree.end, tree.data
    p.Parse(attribute_names(content), True)
    return columns


def attribute_names(content: bytes) -> bytes:
    """Percent signs within attribute names, which XML does not allow, become ``pct``."""
    return re.sub(rb"(?<=[\s\w-])%(?=[\w-]*=\")|(?<=-)%(?==\")", b"pct", content) if b"%" in content else content


def number_or_text(c):
    """All-digit text that a double holds exactly as a number; anything else stays text."""
    return F.when(c.rlike(r"^\d{1,16}$") & (c.try_cast("long") <= SAFE), c.try_cast("long"))


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row per table row: file, its number in the file, and its cells as a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                columns = parse(content, rows.append)
                at, size = 0, 4096
                while at < len(rows) or at == 0:
                    part = rows[at : at + size]
                    cells = [[(k, {"raw": r, "fmt": f}) for k, (r, f) in x.items()] for x in part]
                    kind = pa.map_(pa.string(), pa.struct([("raw", pa.string()), ("fmt", pa.string())]))
                    declared = json.dumps(columns)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(cells, kind), pa.array([declared] * len(part))], ["file", "line", "cells", "columns"])
                    at += size

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, line long, cells map<string,struct<raw:string,fmt:string>>, columns string")


def declared_columns(spark: SparkSession, path: str) -> list[Column]:
    """The columns of a schema-table, from the head of one file."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 20).alias("head")).first()
    if head is None:
        return []
    columns: list = []
    tree = _Tree(lambda row: None, columns)
    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = tree.start, tree.end, tree.data
    try:
        p.Parse(attribute_names(bytes(head["head"])), False)
    except expat.ExpatError:
        pass  # the head may end within an element
    return [Column(m, t, n) for m, t, n in columns]


def discovered_columns(rows: DataFrame) -> list[Column]:
    """The attributes of a track-detail's rows, with a type from the first of their values."""
    names = [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().collect()]  # as many as the dialect has attributes
    sample = rows.limit(SAMPLE).select("cells").collect()
    out = []
    for n in sorted(names):
        values = [r["cells"][n]["raw"] for r in sample if n in r["cells"]]
        kind = "backtrace" if n == "backtrace" else "start-time" if n == "timestamp" else "uint64" if values and all(v is not None and v.isdigit() for v in values) else "string"
        out.append(Column(n, kind))
    return out


def read_table(spark: SparkSession, path: str, schema: str, run: int = 1, position: int = 1) -> Table:
    """The table of one exported file, or of several that are read one after the other.

    Numbers, times and stacks get their types; nested cells are columns by dot path with
    underscores, as ``thread__process__pid``.
    """
    rows = raw_rows(spark, path)
    columns = declared_columns(spark, path)
    track = not columns
    if track:
        columns = discovered_columns(rows)
    nested = sorted({r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().collect() if "." in r[0]})
    firsts = rows.groupBy("file").agg(F.count("*").alias("n"))
    before = firsts.alias("x").join(firsts.alias("y"), F.col("y.file") < F.col("x.file"), "left").groupBy("x.file").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(before), "file")  # a row per file
    cell = lambda n: F.col("cells")[n]
    picked = [(F.col("before") + F.col("line")).cast("long").alias(ROW)]
    for c in columns:
        raw, fmt = cell(c.mnemonic)["raw"], cell(c.mnemonic)["fmt"]
        rule = roles.of_type(c.type)
        if rule.role == "backtrace":
            picked.append(F.from_json(fmt, T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("name", "addr", "binary", "binary_path")]))).alias(c.mnemonic))
            continue
        if track and c.type == "start-time":
            value = F.coalesce(clock_ns(raw), number_or_text(raw))
        elif rule.role in ("time", "weight") or c.type == "uint64":
            value = number_or_text(raw)
        else:
            value = raw
        picked += [value.alias(c.mnemonic), fmt.alias(f"{c.mnemonic}__fmt")]
    known = {c.mnemonic for c in columns}
    for n in nested:
        if n.split(".")[0] in known:
            picked += [cell(n)["raw"].alias(n.replace(".", "__")), cell(n)["fmt"].alias(f"{n.replace('.', '__')}__fmt")]
    extra = [Column(n.replace(".", "__"), n.split(".")[-1]) for n in nested if n.split(".")[0] in known]
    return Table(schema, rows.select(*picked), [*columns, *extra], run, position)
