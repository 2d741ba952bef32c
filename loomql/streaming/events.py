"""Event-time windows for batch and stream, and change streams applied batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.session import shared_dir


def _local(c):
    return c.cast("timestamp_ntz")


def tumbling(events: DataFrame, size: str) -> DataFrame:
    g = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(_local(F.col("w.start")).alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str) -> DataFrame:
    g = events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(_local(F.col("w.start")).alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", _local(F.col("w.start")).alias("start"), "n")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with the schema of the table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def run_to_completion(spark: SparkSession, sf_dir: str, query: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a stream over all files at hand and return what it wrote.

    Append results go to exactly-once files; complete results replace the table of the batch before.
    """
    base = f"{shared_dir(spark)}/loomql-stream-{uuid.uuid4().hex}"
    out = query(event_stream(spark, sf_dir))
    writer = out.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(f"{base}/out").awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{base}/out")
    paths: list[str] = []

    def replace(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{n}")
        paths.append(f"{base}/out/{n}")

    writer.outputMode(mode).foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(paths[-1])


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream applied to a keyed table: the newest change of each key wins, batch after batch.

    Each batch writes a new version of the table, so a repeated batch (after a failure) gives the same version.
    """
    base = f"{shared_dir(spark)}/loomql-changes-{uuid.uuid4().hex}"
    versions: dict[int, str] = {}

    def merge(batch: DataFrame, n: int) -> None:
        new = batch.select("user_id", "event_type", "event_id")
        if n - 1 in versions:
            old = spark.read.parquet(versions[n - 1])
            new = new.unionByName(old.select("user_id", F.col("last_type").alias("event_type"), F.col("last_id").alias("event_id")))
        newest = new.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_id"))
        path = f"{base}/{n}"
        newest.write.mode("overwrite").parquet(path)
        versions[n] = path

    stream = event_stream(spark, sf_dir).writeStream.option("checkpointLocation", f"{base}/state")
    stream.trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return spark.read.parquet(versions[max(versions)])
