"""Following a growing folder of event files with Structured Streaming.

Queries of the engine are about complete tables.  This keeps such a table up to date
while files arrive, and gives running sums per span of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema: T.StructType, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Rows as their files arrive, each key once, as long as it is not later than allowed."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def append(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows to a Parquet table, exactly once, and stops when all files are read."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def spans(rows: DataFrame, time: str, span: str, group: str, measure: str) -> DataFrame:
    """Count and sum of a measure by span of time and group."""
    return rows.groupBy(F.window(time, span).alias("span"), group).agg(F.count("*").alias("n"), F.sum(measure).alias("total")).select(F.col("span.start").alias("start"), group, "n", "total")
