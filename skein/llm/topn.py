"""Top N items within every group by one global sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.keys import community_key, post_key
from skein.session import read


def top_n(df: DataFrame, group: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each ``group`` by ``order``, with their exact position ``rank`` (bigint).

    ``order`` should be total (end it with an identifier): rows equal in all of it are placed in
    no defined order. The table is range-partitioned and sorted by group and order, so a group
    with most of the rows spreads over many tasks. One pass over the sorted partitions keeps, of
    each group, the partition's first ``n`` rows (no others can be among the group's first
    ``n``) and counts the rest; the counts of the earlier partitions, summed, turn a row's place
    in its partition into its place in the group. What meets for a group afterwards is at most
    ``n`` + 1 rows for each partition.

    Rows with a null group are left out, nulls in ``order`` stand where it puts them, groups
    smaller than ``n`` come out whole, an empty table gives none. A column called ``rank`` is
    replaced; ``__part``, ``__place`` and ``__count`` are the names used inside.
    """
    df = df.drop(rank).where(F.col(group).isNotNull())
    columns = df.columns
    ordered = df.repartitionByRange(F.col(group).asc(), *order).sortWithinPartitions(F.col(group).asc(), *order)
    at = columns.index(group)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their place in the partition; at each group's end its count there, in ``__count``."""
        part = TaskContext.get().partitionId()
        last, held = None, 0

        def count_row(b: pa.RecordBatch, g: object, count: int) -> pa.RecordBatch:
            arrays = [pa.array([g if i == at else None], f.type) for i, f in enumerate(b.schema)]
            return out(arrays, b.schema.names, pa.array([None], pa.int64()), pa.array([count], pa.int64()))

        def out(arrays: list, names: list[str], place: pa.Array, count: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(place), pa.int32()), place, count], [*names, "__part", "__place", "__count"])

        b = None
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(at))
            ends, groups = runs.run_ends.to_pylist(), runs.values.to_pylist()
            start, keep, places, counts = 0, [], [], []
            for end, g in zip(ends, groups, strict=True):
                if g != last:
                    if held:
                        counts.append((last, held))
                    last, held = g, 0
                take = min(end - start, max(0, n - held))
                keep += range(start, start + take)
                places += range(held + 1, held + 1 + take)
                held += end - start
                start = end
            if keep:
                kept = b.take(pa.array(keep, pa.int64()))
                yield out(kept.columns, kept.schema.names, pa.array(places, pa.int64()), pa.nulls(len(places), pa.int64()))
            for g, count in counts:
                yield count_row(b, g, count)
        if held and b is not None:
            yield count_row(b, last, held)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    local = ordered.mapInArrow(firsts, f"{kinds}, __part int, __place bigint, __count bigint")
    before = F.coalesce(F.sum("__count").over(Window.partitionBy(group).orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = local.withColumn(rank, before + F.col("__place"))
    return placed.where(F.col("__place").isNotNull() & (F.col(rank) <= n)).select(*columns, rank)


def best_rows(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """For each of ``keys`` the row that is largest by ``measures``, nulls last; merged map-side."""
    return df.groupBy(*keys).agg(F.max(F.struct(*measures)).alias("_best")).select(*keys, *(F.col(f"_best.{m}").alias(m) for m in measures))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best posts of every subreddit: subreddit, rank_in_subreddit, name."""
    posts = read(spark, sf_dir, "top_posts_per_subreddit", "subreddit", "score", "num_comments", "name")
    posts = posts.select(community_key("subreddit").alias("subreddit"), post_key("name").alias("name"), "score", "num_comments")
    posts = best_rows(posts.where("score IS NOT NULL AND name IS NOT NULL AND subreddit IS NOT NULL"), ["subreddit", "name"], ["score", "num_comments"])
    order = [F.desc("score"), F.desc_nulls_last("num_comments"), F.asc("name")]
    return top_n(posts, "subreddit", order, 10, "rank_in_subreddit").select("subreddit", "rank_in_subreddit", "name")


QUERIES = {"p1_found": p1_found}
ORACLE = {
    "p1_found": """
WITH p AS (
  SELECT lower(trim(subreddit)) AS subreddit, CASE WHEN lower(trim(name)) LIKE 't3\\_%' ESCAPE '\\' THEN lower(trim(name)) ELSE 't3_' || lower(trim(name)) END AS name, score, num_comments
  FROM top_posts_per_subreddit WHERE score IS NOT NULL AND subreddit IS NOT NULL AND name IS NOT NULL),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY subreddit, name ORDER BY score DESC, num_comments DESC NULLS LAST) = 1)
SELECT subreddit, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, num_comments DESC NULLS LAST, name) AS rank_in_subreddit, name
FROM b QUALIFY rank_in_subreddit <= 10""",
}
