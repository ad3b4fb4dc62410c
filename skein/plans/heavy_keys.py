"""Figures per subreddit and per author, the heaviest keys among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.keys import author_key, community_key
from skein.operators.selection import key_quantiles
from skein.session import read

PROBS = {"score_p10": 0.1, "score_p50": 0.5, "score_p90": 0.9}
#: A key is heavy from one row in so many on.
HEAVY_ONE_IN = 50


def _keyed(subs: DataFrame) -> DataFrame:
    """field_name, key_value, score: one row for each key of a post."""
    both = F.array(F.struct(F.lit("subreddit").alias("f"), community_key("subreddit").alias("k")), F.struct(F.lit("author").alias("f"), author_key("author").alias("k")))
    return subs.select("score", F.explode(both).alias("_k")).select(F.col("_k.f").alias("field_name"), F.col("_k.k").alias("key_value"), "score").where(F.col("key_value").isNotNull())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least 2 percent of all rows of submissions: field_name, key_value."""
    subs = read(spark, sf_dir, "submissions", "subreddit", "author", "score")
    total = subs.count()
    figures = key_quantiles(_keyed(subs), ["field_name", "key_value"], "score", PROBS, least_rows=max(1, -(-total // HEAVY_ONE_IN)))
    return figures.select("field_name", "key_value")


def p4_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and exact score quantiles of every subreddit and author."""
    return key_quantiles(_keyed(read(spark, sf_dir, "submissions", "subreddit", "author", "score")), ["field_name", "key_value"], "score", PROBS)


QUERIES = {"p4_found": p4_found, "p4_figures": p4_figures}

_KEYED = """
WITH k AS (
  SELECT 'subreddit' AS field_name, lower(trim(subreddit)) AS key_value, score FROM submissions WHERE subreddit IS NOT NULL
  UNION ALL
  SELECT 'author', lower(trim(author)), score FROM submissions WHERE lower(trim(author)) NOT IN ('', '[deleted]', '[removed]'))
"""
ORACLE = {
    "p4_found": _KEYED + "SELECT field_name, key_value FROM k GROUP BY ALL HAVING count(*) * 50 >= (SELECT count(*) FROM submissions)",
    "p4_figures": _KEYED
    + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY field_name, key_value ORDER BY score NULLS LAST) AS rn,
         count(*) OVER (PARTITION BY field_name, key_value) AS n_rows, count(score) OVER (PARTITION BY field_name, key_value) AS n_values FROM k)
SELECT field_name, key_value, any_value(n_rows) AS n_rows, any_value(n_values) AS n_values,
       max(CASE WHEN rn = greatest(1, ceil(0.1 * n_values)) THEN score END) AS score_p10,
       max(CASE WHEN rn = greatest(1, ceil(0.5 * n_values)) THEN score END) AS score_p50,
       max(CASE WHEN rn = greatest(1, ceil(0.9 * n_values)) THEN score END) AS score_p90
FROM r GROUP BY field_name, key_value""",
}
