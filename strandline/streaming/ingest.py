"""Incremental ingest as a stream: each micro-batch adds what is new, once (an extension; the batch operators define the result)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.messages import hashed, only_new


def ingest(stream: DataFrame, target: str, checkpoint: str, order: list[str]):
    """Write first occurrences of the stream's messages to `target` until it is drained; gives the finished query.

    Every batch is deduplicated against the table and within itself. A batch that is run again after a failure
    overwrites its own part (`batch=<id>`), so nothing is written twice. Which of two equal messages of different
    batches is first depends on arrival; the set of hashes does not.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = hashed(batch)
        p = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(p) and fs.listStatus(p):
            known = spark.read.parquet(target).where(F.col("batch") != number).select("hash")
        else:
            known = spark.createDataFrame([], "hash string")
        only_new(rows, known, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window, with a watermark, for batch or stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def read_stream(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
