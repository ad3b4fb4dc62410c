"""Orphan references of the community tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.keys import folded, post_key, reference_key
from skein.operators.references import first_seen, orphans, reference_cases
from skein.operators.skew import skew_join
from skein.session import read, stage


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference to a post that is absent, removed or arrived afterwards.

    One row for each referring record and key: ref_table, name, ref_key, ref_state, ref_month.
    Records without a name or an arrival time can't be placed and give no row.
    """
    subs = read(spark, sf_dir, "submissions").select(F.lit("submissions").alias("ref_table"), post_key("name").alias("name"), reference_key("crosspost_parent").alias("ref_key"), F.col("ingested_at").alias("first_at"))
    coms = read(spark, sf_dir, "comments").select(F.lit("comments").alias("ref_table"), folded("name").alias("name"), reference_key("link_id").alias("ref_key"), F.col("ingested_at").alias("first_at"))
    seen = stage(first_seen(subs.unionByName(coms).where(F.col("name").isNotNull()), ["ref_table", "name", "ref_key"], "first_at"), "p2-seen")
    firsts = first_seen(seen, ["ref_table", "name"], "first_at")
    pairs = seen.where(F.col("ref_key").isNotNull()).select("ref_table", "name", "ref_key")
    refs = stage(skew_join(pairs, firsts, ["ref_table", "name"]), "p2-refs")
    parents = firsts.where(F.col("ref_table") == "submissions").select(F.col("name").alias("ref_key"), "first_at")
    removed = read(spark, sf_dir, "removed_posts").select(post_key("name").alias("ref_key"))
    cases = reference_cases(refs, parents, removed)
    return cases.where(F.col("first_at").isNotNull()).select("ref_table", "name", "ref_key", "ref_state", F.date_format("first_at", "yyyy-MM").alias("ref_month"))


def p2_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per table, month and state."""
    return p2_found(spark, sf_dir).groupBy("ref_table", "ref_month", "ref_state").agg(F.count(F.lit(1)).alias("n_refs"))


def p2_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments whose (link_id, subreddit) no submission meets, nulls matched partially, by mask."""
    refs = stage(read(spark, sf_dir, "comments").select(reference_key("link_id").alias("post"), folded("subreddit").alias("community")), "p2-partial")
    parents = read(spark, sf_dir, "submissions").select(post_key("name").alias("name"), folded("subreddit").alias("subreddit"))
    found = orphans(refs, parents, {"post": "name", "community": "subreddit"}, "partial")
    return found.groupBy("null_mask").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("post").alias("n_posts"))


QUERIES = {"p2_found": p2_found, "p2_by_period": p2_by_period, "p2_partial": p2_partial}

_FOUND = """
WITH s AS (
  SELECT CASE WHEN lower(trim(name)) LIKE 't3\\_%' ESCAPE '\\' THEN lower(trim(name)) ELSE 't3_' || lower(trim(name)) END AS name, ingested_at,
         CASE WHEN crosspost_parent IS NULL OR lower(trim(crosspost_parent)) IN ('', 'none', 'null', 'nan') THEN NULL
              WHEN lower(trim(crosspost_parent)) LIKE 't3\\_%' ESCAPE '\\' THEN lower(trim(crosspost_parent)) ELSE 't3_' || lower(trim(crosspost_parent)) END AS ref_key
  FROM submissions),
c AS (
  SELECT lower(trim(name)) AS name, ingested_at,
         CASE WHEN link_id IS NULL OR lower(trim(link_id)) IN ('', 'none', 'null', 'nan') THEN NULL
              WHEN lower(trim(link_id)) LIKE 't3\\_%' ESCAPE '\\' THEN lower(trim(link_id)) ELSE 't3_' || lower(trim(link_id)) END AS ref_key
  FROM comments),
r AS (
  SELECT DISTINCT 'submissions' AS ref_table, name, ref_key, min(ingested_at) OVER (PARTITION BY name) AS first_at FROM s
  UNION ALL
  SELECT DISTINCT 'comments', name, ref_key, min(ingested_at) OVER (PARTITION BY name) FROM c),
p AS (SELECT name AS ref_key, min(ingested_at) AS at FROM s GROUP BY name),
d AS (SELECT DISTINCT CASE WHEN lower(trim(name)) LIKE 't3\\_%' ESCAPE '\\' THEN lower(trim(name)) ELSE 't3_' || lower(trim(name)) END AS ref_key FROM removed_posts),
found AS (
  SELECT ref_table, r.name, r.ref_key,
         CASE WHEN p.ref_key IS NOT NULL THEN 'late' WHEN d.ref_key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS ref_state,
         strftime(first_at, '%Y-%m') AS ref_month
  FROM r LEFT JOIN p ON r.ref_key = p.ref_key LEFT JOIN d ON r.ref_key = d.ref_key
  WHERE r.ref_key IS NOT NULL AND (p.ref_key IS NULL OR p.at > first_at))
"""

ORACLE = {
    "p2_found": _FOUND + "SELECT * FROM found",
    "p2_by_period": _FOUND + "SELECT ref_table, ref_month, ref_state, count(*) AS n_refs FROM found GROUP BY ALL",
    "p2_partial": """
WITH r AS (
  SELECT CASE WHEN link_id IS NULL OR lower(trim(link_id)) IN ('', 'none', 'null', 'nan') THEN NULL
              WHEN lower(trim(link_id)) LIKE 't3\\_%' ESCAPE '\\' THEN lower(trim(link_id)) ELSE 't3_' || lower(trim(link_id)) END AS post,
         lower(trim(subreddit)) AS community FROM comments),
s AS (SELECT DISTINCT lower(trim(name)) AS name, lower(trim(subreddit)) AS subreddit FROM submissions)
SELECT CAST(CASE WHEN post IS NULL THEN 1 ELSE 0 END + CASE WHEN community IS NULL THEN 2 ELSE 0 END AS INTEGER) AS null_mask,
       count(*) AS n_refs, count(DISTINCT post) AS n_posts
FROM r WHERE (post IS NOT NULL OR community IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.name = r.post AND s.subreddit = r.community)
  AND NOT (community IS NULL AND EXISTS (SELECT 1 FROM s WHERE s.name = r.post))
  AND NOT (post IS NULL AND EXISTS (SELECT 1 FROM s WHERE s.subreddit = r.community))
GROUP BY 1""",
}
