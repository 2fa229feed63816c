"""Event-time windows over a stream of events, and their batch form.

The same transformation serves both: a stream adds a watermark and keeps state per window, a batch aggregates once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.runtime import shared_folder


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A directory of Parquet files (or one file, taken by its name in its directory) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(target).isFile()
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) in tumbling or (with ``slide``) sliding windows."""
    df = timed(events)
    if late:
        df = df.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return df.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no pause of ``gap`` or more."""
    df = timed(events)
    if late:
        df = df.withWatermark("ts", late)
    return df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what a stream holds now and return its output: the sink is a table in the shared folder.

    Results of ``complete`` mode go through a batch write for each trigger, so a restarted query overwrites its own output.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path + "/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", path + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out")
