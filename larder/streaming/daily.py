"""Daily units of an event stream: the same sums as the batch, as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def daily_units(events: DataFrame, late: str = "2 days") -> DataFrame:
    """sku, date and units of each closed day; events later than ``late`` behind the newest are dropped, which bounds the state."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    days = stamped.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), F.col("event_type").alias("sku"))
    return days.agg(F.sum("value").alias("units")).select("sku", F.col("w.start").cast("date").alias("date"), "units")


def append_days(units: DataFrame, path: str, checkpoint: str):
    """Writes closed days once each, up to what has arrived by now."""
    return units.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
