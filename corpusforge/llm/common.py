"""Helpers shared by the training-data operators: table access, shared-folder tables, graph components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to a Python worker; bounds a worker's memory when texts are long.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, columns: dict) -> DataFrame:
    """Rows of the driver as a table, by Arrow: Spark turns lists of tuples into rows in Python workers of their own on the executors, which stay.

    columns: values and Arrow type by name.
    """
    import pyarrow as pa

    return spark.createDataFrame(pa.table([pa.array(x, t) for x, t in columns.values()], names=list(columns)))


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small: some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(work):
    """An Arrow map function that gives back, when a task ends, the memory that its worker process would keep for later."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder serves if driver and executors are one process, as in tests; else
    this raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusforge-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is the cluster's to clean then
        pass


#: Bytes of a row group of a stored table: each task that writes holds one in its heap, 128 MB by default.
ROW_GROUP = 16 << 20
#: Tables that were written and not dropped, in order.
_LIVE: list[Stored] = []


def mark() -> int:
    """A place among the tables written, for drop_since."""
    return len(_LIVE)


def drop_since(place: int, *but) -> None:
    """Drop the tables that were written since then, but for these: nothing may read them any more."""
    for s in [s for s in _LIVE[place:] if s not in but]:
        s.drop()


class Stored:
    """A table written to the shared folder: it cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        atexit.register(_remove, spark, self.path)
        _LIVE.append(self)

    def drop(self) -> None:
        _remove(self.spark, self.path)
        if self in _LIVE:
            _LIVE.remove(self)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def ascii_lower(c):
    """Lower-case A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v), u != v: one row (node, root), root the least node reachable.

    Alternates large-star and small-star steps (each a min per node, then a join that AQE may split),
    so long chains take a logarithmic number of rounds and no group is ever gathered in one place. Each
    round is a table in the shared folder. Raises if it has not settled after max_rounds.
    """
    now = Stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        state = now.df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (state["n"], state["h"])
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = Stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = Stored(both.join(least.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "cc-large")
        low = Stored(large.df.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        pulled = large.df.join(low.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = Stored(pulled.unionByName(low.df.select("u", F.col("m").alias("v"))).distinct(), "cc")
        for old in (now, least, large, low):
            old.drop()
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Most ids that are broadcast; 8 bytes each and the hash table stay within some 64 MB.
BROADCAST_IDS = 1_000_000


def unused(columns, *names: str) -> list[str]:
    """The names, each with underscores behind it until none of the columns is called so (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without(docs: DataFrame, ids: DataFrame, key=None) -> DataFrame:
    """docs but for the rows whose key (doc_id) is among ids (one column, any name; null equals null).

    The ids are counted: few are broadcast, so that no text moves, more are joined by a shuffle.
    """
    (name,) = unused(docs.columns, "_gone")
    gone = stored(ids.toDF(name).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, (F.col("doc_id") if key is None else key).eqNullSafe(F.col(name)), "left_anti")
