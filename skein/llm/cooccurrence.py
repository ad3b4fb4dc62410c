"""Items that appear together, far more often than chance would bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.keys import author_key, community_key
from skein.operators.skew import skew_join
from skein.session import read, stage

#: Items in a block of a basket; a pair of blocks is the unit of work. Many ordinary baskets have several.
#: The blocks of a basket of n items have sqrt(n), up to the second figure, if that is more.
BLOCK, LARGEST_BLOCK = 8, 1024


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """(basket, n_blocks, block, items): the items of a basket, in blocks of about ``block`` or, in large baskets, the root of their number."""
    n = F.ceil(F.col("size") / F.greatest(F.lit(block), F.least(F.sqrt("size"), F.lit(LARGEST_BLOCK)))).cast("int")
    cut = members.select("basket", "item", n.alias("n_blocks"))
    cut = cut.withColumn("block", F.when(F.col("n_blocks") > 1, F.pmod(F.xxhash64("item"), F.col("n_blocks").cast("bigint"))).otherwise(0).cast("int"))
    return cut.groupBy("basket", "n_blocks", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))


def pair_weights(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """In how many baskets each two items meet: source, target (source < target), weight.

    ``members`` has basket, item, ``size`` (items of the basket, or more), each member once.
    Every basket is cut into blocks of about ``block`` items (of sqrt(n), at most 1,024, in a
    large one of n, which then moves n^1.5 items) by a hash of its items. Pairs within
    a block are made in place; each two blocks of a basket meet under their own key, so the
    products of a huge basket spread over all tasks. Pairs
    are counted map-side before they move. Items compare by code point.
    """
    blocks = stage(_blocks(members, block), "cooccurrence-blocks")
    first = blocks.where(F.size("items") > 1).select("items", F.posexplode("items").alias("i", "source"))
    inner = first.select("source", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("target"))
    met = _block_pairs(blocks)
    product = met.select(F.explode("x").alias("p"), "y").select("p", F.explode("y").alias("q"))
    pairs = inner.unionByName(product.select(F.least("p", "q").alias("source"), F.greatest("p", "q").alias("target")))
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(x, y): the items of each two blocks of one basket."""
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    meet = blocks.where("n_blocks > 1").select("basket", "block", "items", other.alias("other")).where("block <> other")
    both = meet.groupBy("basket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).agg(
        F.max(F.when(F.col("block") < F.col("other"), F.col("items"))).alias("x"),
        F.max(F.when(F.col("block") > F.col("other"), F.col("items"))).alias("y"),
    )
    return both.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y")


def associations(df: DataFrame, basket: str, item: str, min_weight: int, min_lift: float, below: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of items that meet in ``min_weight`` baskets and ``min_lift`` times as often as by chance.

    Gives source, target (source < target), weight, n_source, n_target, n_baskets and ``lift``
    = weight * n_baskets / (n_source * n_target). Baskets of ``below`` distinct items or more
    are left out of everything. Rows with a null basket or item and repeated rows don't count;
    other columns are ignored; an empty table gives no pair.

    Two exact bounds keep items from being paired in vain: a pair's weight is at most the
    rarer item's count, so an item below ``min_weight`` has no case, and weight * n >= lift * a * b
    asks for lift * max(a, b) <= n, so an item in more than one in ``min_lift`` baskets has none.
    """
    members = stage(df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct(), "cooccurrence-members")
    sizes = members.groupBy("basket").agg(F.count(F.lit(1)).alias("size"))
    if below is not None:
        sizes = sizes.where(F.col("size") < below)
    kept = stage(skew_join(members, sizes, ["basket"]), "cooccurrence-kept")
    n = kept.select("basket").distinct().count()
    items = stage(kept.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")), "cooccurrence-items")
    fit = items.where((F.col("n_item") >= min_weight) & (F.col("n_item") * min_lift <= n)).select("item")
    weights = pair_weights(skew_join(kept, fit, ["item"], "left_semi"), block).where(F.col("weight") >= min_weight)
    a = items.select(F.col("item").alias("source"), F.col("n_item").alias("n_source"))
    b = items.select(F.col("item").alias("target"), F.col("n_item").alias("n_target"))
    scored = weights.join(a, "source").join(b, "target").withColumn("n_baskets", F.lit(n).cast("bigint"))
    enough: Column = F.col("weight") * F.lit(n) >= F.lit(min_lift) * F.col("n_source") * F.col("n_target")
    lift = F.col("weight") * F.lit(n).cast("double") / (F.col("n_source") * F.col("n_target"))
    return scored.where(enough).select("source", "target", "weight", "n_source", "n_target", "n_baskets", lift.alias("lift"))


def p3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of subreddits that share authors far more often than by chance, with their weights."""
    posts = read(spark, sf_dir, "submissions", "author", "subreddit")
    keyed = posts.select(author_key("author").alias("author"), community_key("subreddit").alias("subreddit"))
    return associations(keyed, "author", "subreddit", min_weight=8, min_lift=5, below=50)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_edges(spark, sf_dir).select("source", "target")


QUERIES = {"p3_found": p3_found, "p3_edges": p3_edges}

_EDGES = """
WITH m AS (
  SELECT DISTINCT lower(trim(author)) AS author, lower(trim(subreddit)) AS subreddit FROM submissions
  WHERE subreddit IS NOT NULL AND lower(trim(author)) NOT IN ('', '[deleted]', '[removed]')),
k AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY author) < 50),
n AS (SELECT count(DISTINCT author) AS n FROM k),
i AS (SELECT subreddit, count(*) AS c FROM k GROUP BY subreddit),
w AS (SELECT x.subreddit AS source, y.subreddit AS target, count(*) AS weight FROM k x JOIN k y ON x.author = y.author AND x.subreddit < y.subreddit GROUP BY ALL),
e AS (SELECT source, target, weight, a.c AS n_source, b.c AS n_target, n AS n_baskets, CAST(weight * CAST(n AS DOUBLE) / (a.c * b.c) AS DOUBLE) AS lift
      FROM w JOIN i a ON a.subreddit = source JOIN i b ON b.subreddit = target, n WHERE weight >= 8 AND weight * n >= 5 * a.c * b.c)
"""
ORACLE = {"p3_found": _EDGES + "SELECT source, target FROM e", "p3_edges": _EDGES + "SELECT * FROM e"}
