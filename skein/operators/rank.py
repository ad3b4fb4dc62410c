"""Top K within groups, rank checks and recovery of lost keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: str, order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each ``group``; ``rank`` names a column for the position, if wanted.

    The filter stands right above the window, so every map task first cuts its own part of a
    group to ``k`` rows and no more than that of a group is shuffled by any task. Let ``order``
    be total, else ties fall anyhow. A null group is a group.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def rank_violations(df: DataFrame, group: str, rank: str, k: int) -> DataFrame:
    """Groups whose ranks don't start at 1, leave gaps, repeat or go beyond ``k``."""
    stats = df.groupBy(group).agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count(rank).alias("n"), F.count_distinct(rank).alias("n_ranks"))
    return stats.where((F.col("first") != 1) | (F.col("last") != F.col("n")) | (F.col("n_ranks") != F.col("n")) | (F.col("last") > k))


def recover_key(df: DataFrame, lookup: DataFrame, on: list[str], key: str) -> DataFrame:
    """``df`` with ``key`` from the row of ``lookup`` that agrees in all of ``on``, nulls included.

    Where several agree the least ``key`` counts; where none does it is null. Keys of the
    lookup are merged map-side before anything is joined.
    """
    best = lookup.groupBy(*on).agg(F.min(key).alias(key))
    a, b = df.drop(key).alias("a"), best.alias("b")
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    return a.join(b, cond, "left").select("a.*", f"b.{key}")


def recover_stats(df: DataFrame, key: str) -> DataFrame:
    """Rows with and without a recovered key."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(key).alias("n_found"), F.count(F.when(F.col(key).isNull(), 1)).alias("n_missed"))
