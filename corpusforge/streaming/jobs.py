"""The job queue and the latest state as Structured Streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """events as a stream; ts is a timestamp so that it can carry a watermark."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # a stream reads a folder
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def latest_state(events: DataFrame, late: str = "30 days") -> DataFrame:
    """The newest event of each user, and how many came; state is bounded by the watermark."""
    newest = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last")
    return events.withWatermark("ts", late).groupBy("user_id").agg(newest, F.count(F.lit(1)).alias("n")).select("user_id", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"), "n")


def drain(stream: DataFrame, mode: str, name: str | None = None) -> DataFrame:
    """Run a stream over what is there now and give its result, by way of a table in the shared folder."""
    from corpusforge.sources.tables import shared_dir

    spark, name = stream.sparkSession, name or f"drained_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"

    def write(batch: DataFrame, number: int) -> None:  # a batch that is run again replaces its own rows
        batch.write.mode("overwrite").parquet(f"{at}/rows" if mode == "complete" else f"{at}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def run_jobs(stream: DataFrame, path: str, checkpoint: str, identity: list[str], order: list[str]) -> None:
    """Each micro-batch adds its newest job per identity as a snapshot folder; a batch that is run again replaces its own."""
    from corpusforge.operators.lifecycle import pending

    def write(batch: DataFrame, number: int) -> None:
        pending(batch, identity, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
