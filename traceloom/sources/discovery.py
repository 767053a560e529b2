"""Finding recordings: a listing of folders, and a search by words of the name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.expressions import word_score

TOP = 10
RECENT_WORDS = {"latest", "newest", "recent", "last"}


def list_recordings(spark: SparkSession, roots: list[str], suffix: str = ".trace") -> DataFrame:
    """Recordings one level below the roots, the newest first."""
    rows = []
    for root in roots:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName().endswith(suffix):
                rows.append((s.getPath().getName(), s.getPath().toString(), s.getModificationTime()))
    return spark.createDataFrame(rows, "name string, path string, changed long").orderBy(F.desc("changed"), "name")


def search(recordings: DataFrame, text: str, top: int = TOP) -> DataFrame:
    """By how many of the words the name holds, then the newest; words for new ones match all."""
    words = text.lower().split()
    wanted = [w for w in words if w not in RECENT_WORDS]
    scored = recordings.withColumn("score", word_score(F.col("name"), wanted) + F.lit(0))
    return (scored if len(wanted) < len(words) and not wanted else scored.where("score > 0")).orderBy(F.desc("score"), F.desc("changed"), "name").limit(top)
