"""How entities move between communities before and after an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period(date: Column, cut: str) -> Column:
    """``pre`` before the cut date, ``post`` from it on; null without a date."""
    return F.when(date < F.lit(cut), "pre").when(date >= F.lit(cut), "post")


def activity(df: DataFrame, entity: str, when: str) -> DataFrame:
    """entity, period, n: records of each entity in each period."""
    return df.where(F.col(entity).isNotNull() & F.col(when).isNotNull()).groupBy(entity, when).agg(F.count(F.lit(1)).alias("n"))


def dominant(df: DataFrame, entity: str, community: str, when: str) -> DataFrame:
    """entity, period, community: the community with most records, the first by name at a tie."""
    n = df.dropna(subset=[entity, community, when]).groupBy(entity, when, community).agg(F.count(F.lit(1)).alias("_n"))
    best = n.groupBy(entity, when).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(community).alias("c"))).alias("_b"))
    return best.select(entity, when, F.col("_b.c").alias(community))


def transitions(df: DataFrame, entity: str, community: str, when: str) -> DataFrame:
    """source, target, n, share: entities by their dominant community before and after; shares of a source sum to 1."""
    d = dominant(df, entity, community, when)
    pre = d.where(F.col(when) == "pre").select(entity, F.col(community).alias("source"))
    post = d.where(F.col(when) == "post").select(entity, F.col(community).alias("target"))
    n = pre.join(post, entity).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def overlap(df: DataFrame, entity: str, community: str, when: str) -> DataFrame:
    """community, n_pre, n_post, n_both, jaccard: how far a community's entities stay the same."""
    seen = df.dropna(subset=[entity, community, when]).groupBy(community, entity).agg(F.max(F.when(F.col(when) == "pre", 1).otherwise(0)).alias("a"), F.max(F.when(F.col(when) == "post", 1).otherwise(0)).alias("b"))
    c = seen.groupBy(community).agg(F.sum("a").alias("n_pre"), F.sum("b").alias("n_post"), F.sum(F.col("a") * F.col("b")).alias("n_both"))
    return c.withColumn("jaccard", F.col("n_both") / (F.col("n_pre") + F.col("n_post") - F.col("n_both")))
