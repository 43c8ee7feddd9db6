"""Reference records as a stream: re-deliveries dropped under a watermark, incremental counts per publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X


def deduplicated(stream: DataFrame, record_id: str = "dref_id", loaded: str = "loaded_at", delay: str = "30 days") -> DataFrame:
    """First delivery of every record; state older than ``delay`` is dropped, so its size follows the delay and not the history."""
    return stream.withWatermark(loaded, delay).dropDuplicatesWithinWatermark([record_id])


def hourly_counts(stream: DataFrame, loaded: str = "loaded_at", delay: str = "2 hours") -> DataFrame:
    """Records and distinct contents (approximate) per publication and hour of loading."""
    hashed = stream.withColumn("h", X.reference_hash(F.col("raw_content")))
    return hashed.withWatermark(loaded, delay).groupBy(F.window(loaded, "1 hour"), "pub_id").agg(F.count("*").alias("n_records"), F.approx_count_distinct("h").alias("n_contents"))
