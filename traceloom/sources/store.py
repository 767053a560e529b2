"""A Parquet store of tables: written whole or not at all, reused while its source is unchanged.

A table's folder holds its rows, sorted by time within files so that their statistics
serve time ranges, and a manifest that is written last.  A folder without manifest, or
whose manifest names another version of the source, is not served.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from traceloom.model import ROW, Catalog, Column, Table, TableError

VERSION = 1


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def source_mark(spark: SparkSession, source: str) -> str:
    """The source's length and time of change."""
    p, fs = _path(spark, source)
    s = fs.getFileStatus(p)
    return f"{s.getLen()}:{s.getModificationTime()}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, schema: str, run: int, position: int) -> str:
        return f"{self.root}/run={run}/{schema.replace('/', '%2F').replace(' ', '%20')}/position={position}"

    def manifest(self, schema: str, run: int = 1, position: int = 1) -> dict | None:
        p, fs = _path(self.spark, f"{self._folder(schema, run, position)}/manifest.json")
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0])

    def fresh(self, schema: str, mark: str, run: int = 1, position: int = 1) -> bool:
        m = self.manifest(schema, run, position)
        return bool(m) and m["version"] == VERSION and m["mark"] == mark

    def write(self, table: Table, mark: str = "") -> Table:
        folder = self._folder(table.schema, table.run, table.position)
        p, fs = _path(self.spark, f"{folder}/manifest.json")
        fs.delete(p, False)  # from now on the table is not served
        time = table.time_column()
        df = table.df.sortWithinPartitions(time, ROW) if time else table.df.sortWithinPartitions(ROW)
        df.write.mode("overwrite").parquet(f"{folder}/rows")
        columns = [[c.mnemonic, c.type, c.name] for c in table.columns]
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"version": VERSION, "mark": mark, "schema": table.schema, "columns": columns, "hints": table.hints}).encode()))
        out.close()
        return self.read(table.schema, table.run, table.position)

    def read(self, schema: str, run: int = 1, position: int = 1) -> Table:
        m = self.manifest(schema, run, position)
        if m is None:
            raise TableError(f"{schema!r} was not written whole")
        df = self.spark.read.parquet(f"{self._folder(schema, run, position)}/rows")
        hints = m["hints"]
        if "roles" in hints:
            hints["roles"] = {k: tuple(v) for k, v in hints["roles"].items()}
        return Table(schema, df, [Column(*c) for c in m["columns"]], run, position, hints)

    def ensure(self, schema: str, source: str, make, run: int = 1, position: int = 1) -> Table:
        """The stored table, read again by make only if its source has changed."""
        mark = source_mark(self.spark, source)
        return self.read(schema, run, position) if self.fresh(schema, mark, run, position) else self.write(make(), mark)

    def rows(self, schema: str, run: int = 1, position: int = 1) -> int:
        """The number of rows, from file footers."""
        return self.read(schema, run, position).df.select(F.lit(1)).count()

    def catalog(self) -> Catalog:
        p, fs = _path(self.spark, self.root)
        found = Catalog()
        for status in fs.globStatus(_path(self.spark, f"{self.root}/run=*/*/position=*/manifest.json")[0]) or []:
            folder = status.getPath().getParent()
            run = int(folder.getParent().getParent().getName().split("=")[1])
            schema = folder.getParent().getName().replace("%2F", "/").replace("%20", " ")
            found.add(self.read(schema, run, int(folder.getName().split("=")[1])))
        return found
