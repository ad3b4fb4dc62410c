"""Files as a stream: each new dump file is cleaned once, progress survives a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.clean import clean_comments, clean_submissions, parse_objects


def dump_stream(spark: SparkSession, path: str, kind: str, max_bytes: int | None = None, max_files: int | None = None, clean_source: str = "off", archive: str | None = None, name: str | None = None) -> DataFrame:
    """Cleaned records of ``kind`` from dump files that arrive below ``path``.

    ``max_bytes`` / ``max_files`` bound a batch (the back-pressure), ``clean_source`` removes or
    archives consumed files. Files that are no dump of this kind, by their names or the pattern ``name``, are left alone.
    """
    reader = spark.readStream.option("pathGlobFilter", name or f"*_{kind}*").option("cleanSource", clean_source)
    for option, value in (("maxBytesPerTrigger", max_bytes), ("maxFilesPerTrigger", max_files), ("sourceArchiveDir", archive)):
        if value is not None:
            reader = reader.option(option, str(value))
    records = parse_objects(reader.text(path))
    return clean_submissions(records) if kind == "submissions" else clean_comments(records)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Take all files that are there, batch by batch, through ``sink(batch, batch_id)``, and stop.

    The checkpoint holds which files are done; a batch that failed comes again with the same id,
    so a sink that overwrites its batch's folder writes each record exactly once.
    """
    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_until(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], stop: Callable[[], bool], every: float = 1.0) -> StreamingQuery:
    """Take files as they arrive until ``stop()`` is true, then those that are there still, and end.

    A paused run goes on from the same checkpoint; nothing is taken twice.
    """
    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(every * 1000)} milliseconds").start()
    while query.isActive and not stop():
        query.awaitTermination(int(max(1, every)))
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    if query.exception():
        raise query.exception()
    return query


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with one folder per batch."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n of events by event time, late ones up to ``late``; for streams and tables."""
    counted = events.withWatermark(time, late) if events.isStreaming else events
    n = counted.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("window_start"), key, "n")
