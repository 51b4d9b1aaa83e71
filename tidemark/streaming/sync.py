"""Syncs as Structured Streaming: change feeds applied batch by batch, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.changes import ORACLES as CHANGES
from tidemark.operators.changes import ChangeTable
from tidemark.session import new_path, table


def run_available(stream: DataFrame, each, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, in micro-batches; a restart goes on from the checkpoint."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int) -> DataFrame:
    """A table's files as a stream; a table may be one file or a folder of them."""
    schema = table(spark, sf_dir, name).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mailboxes after their history pages arrived as a stream: same state as in one batch.

    A batch that is delivered again after a failure repeats the same pages, which the change table
    counts once.
    """
    changes = ChangeTable(spark)
    run_available(read_stream(spark, sf_dir, "gmail_history_pages", 4), lambda b, n: changes.apply(b), new_path(spark, "sync-progress"))
    if not changes.batches:
        changes.apply(table(spark, sf_dir, "gmail_history_pages").limit(0))
    return changes.read().select("connection_id", "external_id", "history_id")


def batch_sink(out: str):
    """A writer of micro-batches into folders of their own: a batch that is repeated replaces itself."""
    return lambda batch, n: batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{out}/b={n}")


def written(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """Rows of all micro-batches below ``out``, with the number of their batch."""
    schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/b=none")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def hourly(events: DataFrame, out: str) -> DataFrame:
    """(hour, event_type, events, value) of a stream with ``ts``, ``event_type`` and ``value``.

    A window's state goes when the watermark passes it, and what comes later is dropped; each batch
    writes the windows it changed, of which the last written counts.
    """
    hours = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    flat = hours.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", "value")
    spark = events.sparkSession
    run_available(flat, batch_sink(out), new_path(spark, "hours-progress"), "update")
    last = F.max_by(F.struct("events", "value"), "batch").alias("r")
    return written(spark, out, flat.schema).groupBy("hour", "event_type").agg(last).select("hour", "event_type", "r.*")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their values per hour and type; rows later than a day are dropped by the watermark."""
    return hourly(read_stream(spark, sf_dir, "events", 8).withColumn("ts", F.col("ts").cast("timestamp")), new_path(spark, "hours"))


def first_seen(events: DataFrame, out: str) -> DataFrame:
    """(event_id, event_type) of a stream, each id once within the watermark of its ``ts``."""
    once = events.withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    run_available(once, batch_sink(out), new_path(events.sparkSession, "seen-progress"))
    return written(events.sparkSession, out, once.schema).drop("batch")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event id once, however often it is delivered: deduplicated within the watermark."""
    e = read_stream(spark, sf_dir, "events", 8).withColumn("ts", F.col("ts").cast("timestamp"))
    seen = first_seen(e.unionByName(e), new_path(spark, "seen"))
    return seen.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))


ORACLES = {
    "stream_sync": CHANGES["p2_found"],
    "stream_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_first_seen": "SELECT event_type, count(DISTINCT event_id) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (stream_sync, stream_windows, stream_first_seen)}
