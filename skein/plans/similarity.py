"""Queries on vectors and the graphs made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import embed as e
from skein.operators import checks, graph, similarity
from skein.session import read, stage


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings", "vec_id", "embedding", "label")


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector of each label, in long form."""
    c = similarity.centroids(_vectors(spark, sf), "label", "embedding")
    return c.select("label", "n", F.posexplode("centroid").alias("i", "x")).select("label", "n", "i", F.round("x", 6).alias("x"))


def centroid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = similarity.centroids(_vectors(spark, sf), "label", "embedding")
    return similarity.cosine_pairs(c, "label", "centroid").withColumn("similarity", F.round("similarity", 6))


def _pairs(spark: SparkSession, sf: str, above: float | None) -> DataFrame:
    return similarity.cosine_pairs(_vectors(spark, sf), "vec_id", "embedding", above)


def sim_edges_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors whose cosine is over 0.3, rounded to 4 places."""
    return _pairs(spark, sf, 0.3).withColumn("similarity", F.round("similarity", 4))


def sim_edges_p97(spark: SparkSession, sf: str) -> DataFrame:
    """The three percent most similar of all pairs of vectors."""
    return similarity.pairs_above_percentile(_vectors(spark, sf), "vec_id", "embedding", 0.97).withColumn("similarity", F.round("similarity", 6))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return stage(_pairs(spark, sf, 0.3).withColumnRenamed("similarity", "weight"), "similarity-edges")


def pair_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The delivered community edges, each pair once."""
    return graph.canonical(read(spark, sf, "reddit_edges_result"))


def knn_of_one(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of one given vector."""
    return similarity.nearest(_vectors(spark, sf), "vec_id", "embedding", 0).withColumn("similarity", F.round("similarity", 6))


def knn_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, among all vectors."""
    return similarity.nearest_each(_vectors(spark, sf), "vec_id", "embedding", F.col("vec_id") % 100 == 0).withColumn("similarity", F.round("similarity", 6))


def node_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf)).select("node", "degree", F.round("weighted_degree", 6).alias("weighted_degree"))


def weighted_degree_top(spark: SparkSession, sf: str) -> DataFrame:
    return graph.top_nodes(_edges(spark, sf), 15).select("node", "degree", F.round("weighted_degree", 6).alias("weighted_degree"))


def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = graph.summary(_edges(spark, sf))
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes))


def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(_edges(spark, sf))


def community_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the delivered community graph."""
    return graph.components(graph.canonical(read(spark, sf, "reddit_edges_result")))


def subgraph_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The edges among the 40 nodes of largest weighted degree."""
    e = _edges(spark, sf)
    return graph.subgraph(e, graph.top_nodes(e, 40)).withColumn("weight", F.round("weight", 6))


def styled_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.styled_nodes(graph.canonical(read(spark, sf, "reddit_edges_result")))


def styled_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.styled_edges(_edges(spark, sf).withColumn("weight", F.round("weight", 4)))


def similarity_checks(spark: SparkSession, sf: str) -> DataFrame:
    c = similarity.centroids(_vectors(spark, sf), "label", "embedding")
    return checks.similarity_pairs(similarity.cosine_pairs(c, "label", "centroid"), c.count(), 0.3)


def embed_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all prepared titles by the hashing embedder."""
    t = read(spark, sf, "title_embedding_input", "name", "title_for_embedding").dropna().distinct()
    return t.select("name", e.embed(F.col("title_for_embedding")).alias("embedding"))


def community_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean title vector of each community, with its number of posts."""
    t = read(spark, sf, "title_embedding_input", "subreddit", "title_for_embedding").dropna()
    return similarity.centroids(t.select("subreddit", e.embed(F.col("title_for_embedding")).alias("v")), "subreddit", "v")


QUERIES = {f.__name__: f for f in (
    centroids, centroid_pairs, sim_edges_threshold, sim_edges_p97, pair_dedup, knn_of_one, knn_top10, node_degree, weighted_degree_top, graph_summary, connected_components, community_components, subgraph_topn,
    styled_nodes, styled_edges, similarity_checks, embed_titles, community_vectors,
)}

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_P = f"WITH RECURSIVE {_V}, p AS (SELECT a.vec_id AS source, b.vec_id AS target, list_cosine_similarity(a.e, b.e) AS w FROM v a JOIN v b ON a.vec_id < b.vec_id)"
_E = _P + ", e AS (SELECT source, target, w AS weight FROM p WHERE w > 0.3), n AS (SELECT source AS node, weight FROM e UNION ALL SELECT target, weight FROM e), d AS (SELECT node, count(*) AS degree, sum(weight) AS weighted_degree FROM n GROUP BY node)"
_REACH = ", b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e), r AS (SELECT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x), c AS (SELECT x AS node, min(y) AS component FROM r GROUP BY x)"
_CANON = "WITH RECURSIVE e AS (SELECT least(source, target) AS source, greatest(source, target) AS target, max(weight) AS weight FROM reddit_edges_result WHERE source <> target AND weight IS NOT NULL GROUP BY ALL)"
ORACLE = {
    "centroids": f"WITH {_V}, u AS (SELECT label, vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM v) SELECT label, count(*) AS n, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM u GROUP BY label, i",
    "centroid_pairs": f"""WITH {_V}, u AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), k AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY label)
SELECT a.label AS source, b.label AS target, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM k a JOIN k b ON a.label < b.label""",
    "sim_edges_threshold": _P + " SELECT source, target, round(w, 4) AS similarity FROM p WHERE w > 0.3",
    "sim_edges_p97": _P + " SELECT source, target, round(w, 6) AS similarity FROM p WHERE w >= (SELECT quantile_cont(w, 0.97) FROM p)",
    "pair_dedup": _CANON + " SELECT * FROM e",
    "knn_of_one": f"WITH {_V}, s AS (SELECT b.vec_id AS neighbour, list_cosine_similarity(a.e, b.e) AS w FROM v a, v b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY w DESC, neighbour LIMIT 10) SELECT neighbour, round(w, 6) AS similarity, CAST(row_number() OVER (ORDER BY w DESC, neighbour) AS INTEGER) AS position FROM s",
    "knn_top10": f"WITH {_V}, s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 12) AS w FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY w DESC, neighbour) AS INTEGER) AS position FROM s) SELECT query, neighbour, round(w, 6) AS similarity, position FROM r WHERE position <= 10",
    "node_degree": _E + " SELECT node, degree, round(weighted_degree, 6) AS weighted_degree FROM d",
    "weighted_degree_top": _E + " SELECT node, degree, round(weighted_degree, 6) AS weighted_degree FROM d ORDER BY d.weighted_degree DESC, node LIMIT 15",
    "graph_summary": _E + _REACH + """, z AS (SELECT component, count(*) AS n FROM c GROUP BY 1), g AS (SELECT CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, max(n) AS largest FROM z),
h AS (SELECT count(*) AS edges, min(weight) AS lo, max(weight) AS hi, avg(weight) AS mid, sum(weight) AS total FROM e)
SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1.0)), 6) AS density, components, largest, round(2 * total / nodes, 6) AS avg_weighted_degree, round(lo, 6) AS min_weight, round(hi, 6) AS max_weight, round(mid, 6) AS mean_weight FROM g, h""",
    "connected_components": _E + _REACH + " SELECT node, component FROM c",
    "community_components": _CANON + _REACH + " SELECT node, component FROM c",
    "subgraph_topn": _E + ", t AS (SELECT node FROM d ORDER BY weighted_degree DESC, node LIMIT 40) SELECT source, target, round(weight, 6) AS weight FROM e WHERE source IN (SELECT node FROM t) AND target IN (SELECT node FROM t)",
    "styled_nodes": _CANON + ", n AS (SELECT source AS node, weight FROM e UNION ALL SELECT target, weight FROM e) SELECT node, greatest(count(*) * 3, 5) AS size, CAST(120 + 80 * sum(weight) AS DOUBLE) AS draw_size FROM n GROUP BY node",
    "styled_edges": _E + " SELECT source, target, round(weight, 4) AS weight, round(weight, 4) > 0.99 AS is_red, 1 + 2.5 * round(weight, 4) AS width FROM e",
    "similarity_checks": f"""WITH {_V}, u AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), k AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY label),
p AS (SELECT list_cosine_similarity(a.e, b.e) AS s FROM k a JOIN k b ON a.label < b.label)
SELECT 'pairs' AS "check", abs(count(*) - (SELECT count(*) * (count(*) - 1) // 2 FROM k)) AS n_violations FROM p UNION ALL SELECT 'finite', count(*) FILTER (isnan(s) OR abs(s) > 1.00001) FROM p UNION ALL SELECT 'positive', count(*) FILTER (s >= 0.3 AND s <= 0) FROM p""",
}
