"""Data that goes through files: written, listed, probed, read back and streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans import community
from skein.session import read, scratch
from skein.sources import files, sinks
from skein.streaming import ingest


def _dump(spark: SparkSession, sf: str) -> str:
    """The raw lines as compressed text files in a folder of their own; its path."""
    path = f"{scratch(spark, 'dump')}/raw_submissions"
    read(spark, sf, "raw_submissions", "payload").select(F.col("payload").alias("value")).dropna().write.option("compression", "gzip").text(path)
    return path


def ingest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed JSON lines, cleaned, written as Parquet and read back."""
    out = scratch(spark, "cleaned")
    sinks.write_parquet(files.cleaned(spark, _dump(spark, sf)), out, rows_per_file=10_000)
    return files.parquet_set(spark, out)


def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same files as a stream, a few a batch, each taken once."""
    out, source = scratch(spark, "streamed"), _dump(spark, sf)
    stream = ingest.dump_stream(spark, source, "submissions", max_files=2, name="*")
    ingest.run_available(stream, scratch(spark, "progress"), ingest.parquet_sink(out))
    return files.parquet_set(spark, out).drop("batch")


def footer_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of written files by their footers alone, by status."""
    path = scratch(spark, "footers")
    sinks.write_parquet(read(spark, sf, "comments", "name", "score"), path, rows_per_file=1000)
    probed = files.probe_footers(files.manifest(spark, path, "*.parquet"))
    return probed.groupBy("status").agg(F.sum("n_rows").alias("n_rows"))


def partitioned_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events written by type and read back pruned to one folder."""
    path = scratch(spark, "events")
    sinks.write_parquet(read(spark, sf, "events", "event_id", "event_type", "value"), path, partition_by=["event_type"])
    return files.parquet_set(spark, path, "event_id", "value", "event_type").where("event_type = 'click'")


def merged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Files with different columns read as one table, by pattern and without it."""
    path = scratch(spark, "merged")
    orders = read(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.write_parquet(orders.where("o_orderkey % 2 = 0").drop("o_totalprice"), f"{path}/part=0")
    sinks.write_parquet(orders.where("o_orderkey % 2 = 1").drop("o_orderstatus"), f"{path}/part=1")
    return files.parquet_set(spark, path, "o_orderkey", "o_orderstatus", "o_totalprice", "part", merge=True)


def csv_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The delivered edges as one CSV file and back as an edge list."""
    path = scratch(spark, "edges")
    sinks.write_single(read(spark, sf, "reddit_edges_result"), path, "csv")
    return files.edge_list(spark, path, "source", "target", "weight", "csv")


def word_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Names appended to a list twice and read back in one form."""
    path = scratch(spark, "words")
    names = read(spark, sf, "top_posts_per_subreddit", "subreddit").dropna()
    for _ in range(2):
        sinks.append_lines(names, "subreddit", path)
    return files.word_list(spark, path).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (ingest_lines, ingest_stream, footer_counts, partitioned_events, merged_orders, csv_edges, word_lines)}

ORACLE = {
    "ingest_lines": community.ORACLE["clean_submissions"],
    "ingest_stream": community.ORACLE["clean_submissions"],
    "footer_counts": "SELECT 'ok' AS status, count(*) AS n_rows FROM comments",
    "partitioned_events": "SELECT event_id, value, event_type FROM events WHERE event_type = 'click'",
    "merged_orders": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS o_totalprice, CAST(o_orderkey % 2 AS INTEGER) AS part FROM orders",
    "csv_edges": "SELECT source, target, CAST(weight AS DOUBLE) AS weight FROM reddit_edges_result",
    "word_lines": "SELECT lower(trim(subreddit)) AS name, 2 * count(*) AS n FROM top_posts_per_subreddit WHERE trim(subreddit) <> '' GROUP BY 1",
}
