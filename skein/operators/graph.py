"""Weighted community graphs: from shared members, from references, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import skew_join
from skein.session import stage


def communities_per_entity(df: DataFrame, entity: str, community: str) -> DataFrame:
    """(entity, n_communities): distinct communities of each entity."""
    return df.select(entity, community).dropna().distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n_communities"))


def co_membership(df: DataFrame, entity: str, community: str, below: int = 50, min_weight: int = 5) -> DataFrame:
    """source, target (source < target), weight: entities that two communities share.

    Entities in ``below`` communities or more are left out, so an entity makes fewer than
    below^2 / 2 pairs and no entity can be hot; pairs are counted map-side. Edges below
    ``min_weight`` are dropped.
    """
    pairs = stage(df.select(F.col(entity).alias("entity"), F.col(community).alias("community")).dropna().distinct(), "membership")
    sizes = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, below - 1))
    kept = skew_join(pairs, sizes.select("entity"), ["entity"], "left_semi")
    lists = kept.groupBy("entity").agg(F.sort_array(F.collect_list("community")).alias("c"))
    first = lists.select("c", F.posexplode("c").alias("i", "source"))
    met = first.select("source", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("target"))
    return met.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)


def cross_reference(posts: DataFrame, key: str, parent: str, community: str) -> DataFrame:
    """source, target, weight: references from posts of the target community to posts of the source.

    Self-loops stay, a repeated post multiplies the weight, a null community is a group of its
    own. References and posts are each counted per key first, so a post with very many
    references is one row in the join.
    """
    lookup = posts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(community).alias("source")).agg(F.count(F.lit(1)).alias("_n"))
    refs = posts.where(F.col(parent).isNotNull() & ~F.col(parent).isin("None", "")).groupBy(F.col(parent).alias("_k"), F.col(community).alias("target")).agg(F.count(F.lit(1)).alias("_m"))
    return lookup.join(refs, "_k").groupBy("source", "target").agg(F.sum(F.col("_n") * F.col("_m")).alias("weight"))


def canonical(edges: DataFrame, source: str = "source", target: str = "target", weight: str = "weight") -> DataFrame:
    """Each unordered pair once, endpoints in order, by its largest weight; loops and nulls are dropped."""
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.col(weight).alias("w")).dropna().where("a <> b")
    return e.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).agg(F.max("w").alias("weight"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, weighted_degree of an undirected graph."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    """The ``n`` nodes of largest weighted degree, ties by name."""
    return degrees(edges).orderBy(F.desc("weighted_degree"), "node").limit(n)


def subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among ``chosen`` (column node)."""
    for end in ("source", "target"):
        edges = edges.join(chosen.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges.select("source", "target", "weight")


def components(edges: DataFrame) -> DataFrame:
    """node, component: connected components, named by their least node.

    Every node takes the least label of its neighbourhood, then the label of its label; this
    ends after about the logarithm of the longest path. Messages are merged map-side, so a node
    with very many neighbours is one row, and every round is cut off in the shared folder.
    """
    both = stage(edges.select("source", "target").dropna().union(edges.select("target", "source").dropna()).distinct(), "components-edges")
    labels = stage(both.groupBy(F.col("source").alias("node")).agg(F.least(F.min("source"), F.min("target")).alias("component")), "components")
    while True:
        sent = skew_join(both.withColumnRenamed("source", "node"), labels, ["node"]).groupBy(F.col("target").alias("node")).agg(F.min("component").alias("_near"))
        near = labels.join(sent, "node").select("node", F.least("component", "_near").alias("component"), F.col("component").alias("_was"))
        near = stage(near, "components-near")
        up = near.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        jumped = skew_join(near, up, ["component"]).select("node", F.least("component", "_up").alias("component"), "_was")
        jumped = stage(jumped, "components")
        labels = jumped.drop("_was")
        if jumped.where("component <> _was").isEmpty():
            return labels


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, the largest one, mean weighted degree and edge weights; 0 where empty."""
    e = edges.agg(F.count(F.lit(1)).alias("edges"), *(F.coalesce(f("weight").cast("double"), F.lit(0.0)).alias(n) for f, n in ((F.min, "min_weight"), (F.max, "max_weight"), (F.avg, "mean_weight"), (F.sum, "_w"))))
    sizes = components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    c = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    one = e.withColumn("_1", F.lit(1)).join(c.withColumn("_1", F.lit(1)), "_1")
    n = F.col("nodes").cast("double")
    density = F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0)
    mean = F.when(n > 0, 2 * F.col("_w") / n).otherwise(0.0)
    return one.select("nodes", "edges", density.alias("density"), "components", "largest", mean.alias("avg_weighted_degree"), "min_weight", "max_weight", "mean_weight")


def styled_nodes(edges: DataFrame) -> DataFrame:
    """node, size (three times the degree, 5 at least), draw_size (120 + 80 times the weighted degree)."""
    return degrees(edges).select("node", F.greatest(F.col("degree") * 3, F.lit(5)).alias("size"), (F.lit(120) + 80 * F.col("weighted_degree").cast("double")).alias("draw_size"))


def styled_edges(edges: DataFrame) -> DataFrame:
    """source, target, weight, is_red (weight over 0.99), width (1 + 2.5 times the weight)."""
    return edges.select("source", "target", "weight", (F.col("weight") > 0.99).alias("is_red"), (1 + 2.5 * F.col("weight").cast("double")).alias("width"))


def jaccard(df: DataFrame, entity: str, community: str, below: int = 50, min_weight: int = 5) -> DataFrame:
    """source, target, weight, jaccard: shared entities of two communities over the entities of either.

    Entities in ``below`` communities or more are left out of both counts.
    """
    pairs = stage(df.select(entity, community).dropna().distinct(), "jaccard")
    few = pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < below).select(entity)
    kept = stage(skew_join(pairs, few, [entity], "left_semi"), "jaccard-kept")
    sizes = kept.groupBy(community).agg(F.count(F.lit(1)).alias("n"))
    w = co_membership(kept, entity, community, below, min_weight)
    for end in ("source", "target"):
        w = w.join(sizes.select(F.col(community).alias(end), F.col("n").alias(f"n_{end}")), end)
    return w.select("source", "target", "weight", (F.col("weight") / (F.col("n_source") + F.col("n_target") - F.col("weight"))).alias("jaccard"))
