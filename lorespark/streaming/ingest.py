"""Ingest as a stream: each event once, then its sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespark.operators.store import append_events, event_hash, sentence_units


def read_events(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder, a bounded number of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def distinct_within(events: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Each content once among events at most ``delay`` apart in event time; state is bounded by it."""
    timed = event_hash(events).withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["hash"]).drop("hash")


def distinct_ever(events: DataFrame) -> DataFrame:
    """Each content once, however far apart; the state holds the hash of every event."""
    return event_hash(events).dropDuplicates(["hash"]).drop("hash")


def windowed_counts(events: DataFrame, time_col: str, delay: str, width: str, by: str) -> DataFrame:
    """(start, by, n) of tumbling windows; events later than ``delay`` are left out."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    return timed.groupBy(F.window(time_col, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def ingest(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Writes new events and their sentences below ``store`` and stops when all files are read.

    A batch is compared with what the store holds, and both tables are written by batch number, so
    a batch that runs again after a failure replaces what it wrote.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        held = _others(spark, f"{store}/events", number, batch)
        new = append_events(held, batch).persist()
        try:
            new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/events")
            sentence_units(new).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/units")
        finally:
            new.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _others(spark: SparkSession, path: str, number: int, batch: DataFrame) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).filter(F.col("batch") != number).select(*batch.columns)
    except AnalysisException:  # nothing is written yet
        return batch.limit(0)
