"""Structured Streaming forms of the incremental stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder as a stream; ``ts`` becomes a timestamp with time zone, as watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def first_of(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark; state is dropped after ``late``."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def weekly_counts(stream: DataFrame, key: str, late: str) -> DataFrame:
    """Counts a key and ISO week (Monday)."""
    week = F.window("ts", "7 days", startTime="4 days")  # the epoch was a Thursday
    return stream.withWatermark("ts", late).groupBy(F.col(key), week.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("date").alias("captured_week"), "n")


def sliding_counts(stream: DataFrame, key: str, late: str) -> DataFrame:
    w = F.window("ts", "30 days", "1 day")
    return stream.withWatermark("ts", late).groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def unprocessed_only(stream: DataFrame, ledger: str, out: str, checkpoint: str, key: str):
    """Each batch's rows whose key is not in the ledger go to ``out`` and to the ledger.

    A batch that is tried again writes the same folder again, so nothing is written twice.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(ledger).where(F.col("batch") != number).select(key)
            batch = batch.join(seen, key, "left_anti")
        except Exception as gone:  # the ledger does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(gone):
                raise
        fresh = batch.dropDuplicates([key]).persist()
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.select(key).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        fresh.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run over what is there and return the result as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
