"""Event streams: the same transformations over a batch and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, length: str = "1 hour", late: str | None = None, time: str = "ts") -> DataFrame:
    """(start, event_type, n, v) of tumbling windows; late is how long a stream waits for late rows."""
    at = events.withColumn("__at", F.col(time).cast("timestamp"))
    if late is not None:
        at = at.withWatermark("__at", late)
    made = at.groupBy(F.window("__at", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return made.select(F.col("w.start").alias("start"), "event_type", "n", "v")


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """A stream without repeated events; the state forgets keys that are older than the watermark."""
    return events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark([key]).drop("__at")


def write_all(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, written exactly once; call again for what has come since."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
    return query
