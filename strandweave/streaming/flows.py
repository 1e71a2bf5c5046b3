"""Structured Streaming flows: ingest once, count by windows, deliver a log of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_folder


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files under a path, with the schema they have now; a path that is one file is a folder of one."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as an instant with a watermark; naive times are taken as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    """Counts by key and window."""
    out = df.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n")


def first_seen(df: DataFrame, *keys: str) -> DataFrame:
    """Each key once; keys beyond the watermark are forgotten."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def by_session(df: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    out = df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives the result as a table of files in the shared folder; the driver holds none of it.

    A batch writes under its number, so one that is run again replaces itself; in complete
    mode each batch is the whole result and only the newest counts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stream-{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch=-1")
    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def deliver(df: DataFrame, path: str, key: str, order: str) -> StreamingQuery:
    """An outbox: each micro-batch writes the latest row of every key under its batch number, so a batch that is run again replaces itself."""

    def upsert(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()


def delivered(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """What an outbox holds: the latest row of every key over all batches."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "batch")).alias("r")).select("r.*")


def each_batch(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Any action on each micro-batch, once over what is there."""
    return df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
