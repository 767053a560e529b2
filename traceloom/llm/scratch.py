"""Intermediate tables in the shared folder of the cluster.

Lineage is cut by writing a Parquet table into the folder named by
``spark.checkpoint.dir``.  All executors reach that folder, so a lost executor costs
only its running tasks.  Where the setting is missing (local tests) a folder below
the warehouse is set for the session.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a sieve, 8 MB of broadcast whatever the input; a fuller sieve lets more rows pass.
SIEVE_BITS = 26
_MAP_BITS = 32768


def marked(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a flag whether a row's key may be one of the members' keys; a join has to follow.

    Members' keys are marked in a bitmap of fixed size, which is broadcast, so rows that
    cannot match need no shuffle.  key: a long column of both, without nulls.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << SIEVE_BITS))
    part, bit = F.floor(slot / _MAP_BITS).cast("int"), F.pmod(slot, F.lit(_MAP_BITS)).cast("int")
    maps = members.select(part.alias("_sieve_part"), bit.alias("_sieve_bit")).groupBy("_sieve_part").agg(F.bitmap_construct_agg("_sieve_bit").alias("_sieve_map"))
    byte = F.conv(F.hex(F.expr("substring(_sieve_map, _sieve_bit div 8 + 1, 1)")), 16, 10).cast("int")
    out = df.withColumns({"_sieve_part": part, "_sieve_bit": bit}).join(F.broadcast(maps), "_sieve_part", "left")  # at most 2048 rows of 4 KB
    return out.withColumn(flag, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, _sieve_bit % 8)")) != 0, F.lit(False))).drop("_sieve_part", "_sieve_bit", "_sieve_map")


def sieve(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key may be one of the members' keys."""
    return marked(df, members, key, "_sieve_may").where("_sieve_may").drop("_sieve_may")


def free_name(df: DataFrame, name: str) -> str:
    """name, or with more underscores if df has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator call; they go when the application ends or on ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and return the table read back with the same schema."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Let Spark free shuffles and broadcasts of the steps that are done.

        It does so once the driver has collected the objects that stand for them, which a
        long row of short steps puts off until the driver's heap is as large as it may be.
        """
        gc.collect()  # the plans that Python still holds
        self.spark._jvm.System.gc()

    def drop(self, *tables: int) -> None:
        """Delete the tables with these numbers, or all of them."""
        with contextlib.suppress(Exception):
            jvm = self.spark._jvm
            for path in [f"{self.root}/{n}" for n in tables] or [self.root]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for a shuffle of rows, not fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
