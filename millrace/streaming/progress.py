"""The event stream: latest state of each unit, and counts by state, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of events as they arrive: unit, seq, state."""
    return spark.readStream.schema("unit long, seq long, state string").json(folder)


def latest(stream: DataFrame) -> DataFrame:
    """unit and state of the last observation by seq, whatever the order of arrival. State is one row a unit."""
    return stream.groupBy("unit").agg(F.max(F.struct("seq", "state"))["state"].alias("state"))


def write_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the table of counts by state."""

    def put(batch: DataFrame, _: int) -> None:
        batch.groupBy("state").agg(F.count("*").alias("units")).write.mode("overwrite").parquet(path)

    return (
        latest(stream).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The events as JSON lines, appended once each whatever fails between."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
