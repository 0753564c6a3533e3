"""Fetched pages as a stream: every micro-batch is merged into the tables.

A batch reads and writes only the buckets of the tables that its URLs lie in (`sources.tables.update`).

The merge key is the only memory of what was seen, so no state grows with the stream. A batch that is run again
after a failure gives the same tables, apart from times: events are folded by sequence, and repeated ones change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.ingest import ingest


def fetched_stream(spark: SparkSession, folder: str, files_per_batch: int = 100, kind: str = "parquet") -> DataFrame:
    """Files that a fetcher puts into a folder."""
    return spark.readStream.schema(schemas.FETCHED_PAGES).option("maxFilesPerTrigger", files_per_batch).format(kind).load(folder)


def without_recent(stream: DataFrame, ttl: str = "7 days") -> DataFrame:
    """Fetches of a URL that was fetched within the time to live are dropped; state older than that is forgotten."""
    from ..functions.urls import normalize_url

    keyed = stream.withColumn("__key", normalize_url(F.col("requested_url"))).withWatermark("fetched_at", ttl)
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def merge_stream(stream: DataFrame, tables: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start merging into the tables; with once, what is there now, then stop."""

    def batch(rows: DataFrame, _: int) -> None:
        ingest(rows.sparkSession, tables, rows)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def status_counts(stream: DataFrame, window: str = "10 minutes", late: str | None = "1 hour") -> DataFrame:
    """Fetches per window of time and status, final once the watermark has passed. late None keeps a watermark set before."""
    from ..functions.text import crawl_status

    status = F.when(F.col("error").isNotNull(), "ERROR").otherwise(crawl_status(F.col("status_code")))
    timed = stream if late is None else stream.withWatermark("fetched_at", late)
    counted = timed.groupBy(F.window("fetched_at", window).alias("w"), status.alias("status")).count()
    return counted.select(F.col("w.start").alias("window_start"), "status", "count")
