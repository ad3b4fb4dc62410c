"""Checks of results: each gives one row (check, n_violations); none must be above 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import nodes
from skein.operators.rank import rank_violations


def count_where(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return df.agg(F.count(F.when(bad, 1)).alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")


def ranked(df: DataFrame, group: str, rank: str, k: int) -> DataFrame:
    """Ranks start at 1, are contiguous and stay within ``k``."""
    return rank_violations(df, group, rank, k).agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit("ranks").alias("check"), "n_violations")


def embedding_input(df: DataFrame) -> DataFrame:
    """Texts and names are there and ranks are 1 or more."""
    parts = [count_where(df, "text", F.col("title_for_embedding").isNull()), count_where(df, "name", F.col("name").isNull()), count_where(df, "rank", ~F.coalesce(F.col("rank_in_subreddit") >= 1, F.lit(False)))]
    return reduce(DataFrame.unionByName, parts)


def similarity_pairs(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs are as many as ``n`` keys make, finite, within [-1, 1]; edges reach the threshold and are positive."""
    s = F.col("similarity")
    total = pairs.agg(F.abs(F.count(F.lit(1)) - n * (n - 1) // 2).alias("n_violations")).select(F.lit("pairs").alias("check"), "n_violations")
    edges = pairs.where(s >= threshold)
    return total.unionByName(count_where(pairs, "finite", F.isnan(s) | (F.abs(s) > 1 + 1e-5))).unionByName(count_where(edges, "positive", s <= 0))


def graph_sizes(edges: DataFrame, n_edges: int, n_nodes: int) -> DataFrame:
    """The graph has as many edges and nodes as its table says."""
    e = edges.agg(F.abs(F.count(F.lit(1)) - n_edges).alias("n_violations")).select(F.lit("edges").alias("check"), "n_violations")
    v = nodes(edges).agg(F.abs(F.count(F.lit(1)) - n_nodes).alias("n_violations")).select(F.lit("nodes").alias("check"), "n_violations")
    return e.unionByName(v)
