"""Tables and reports on disk: folders that tasks share, golden sets, upserts, an embedding cache, rendered reports."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder serves if driver and executors are one process; else this raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusforge-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is the cluster's to clean then
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the shared folder, which goes at the end of the program."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a list, or with lists under keys."""
    rows = spark.read.json(path, multiLine=True)
    lists = [f.name for f in rows.schema if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    return rows.select(F.explode(lists[0]).alias("x")).select("x.*") if len(rows.columns) == len(lists) else rows


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Stored rows with those of new put in, the newest per key."""
    from corpusforge.operators.feed import latest

    rows = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(rows, key, [F.desc("_new"), *[F.desc_nulls_last(c) for c in order]]).drop("_new")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    return wanted.dropDuplicates(key).join(cache.select(*key), key, "left_anti")


def compact_cache(cache: DataFrame, key: list[str]) -> DataFrame:
    return cache.dropDuplicates(key)


def json_report(df: DataFrame, most: int = 1000) -> str:
    """A report-sized frame as pretty JSON; refuses columns that a report must not carry."""
    from corpusforge.operators.quality import hygiene

    if bad := hygiene(df.columns):
        raise ValueError(f"columns {bad} don't belong into a report")
    return json.dumps([r.asDict(recursive=True) for r in df.limit(most).collect()], indent=2, default=str)


def markdown_report(df: DataFrame, most: int = 1000) -> str:
    rows = [list(map(str, r)) for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])
