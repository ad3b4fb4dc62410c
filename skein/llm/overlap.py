"""Overlap sizes between many large sets, by descending pairs of prefix tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.keys import author_key, community_key
from skein.llm.cooccurrence import pair_weights
from skein.operators.skew import skew_join
from skein.session import read, stage

#: Bits of a member's place in the trie's order: rarity class, then hash.
CLASS_BITS, HASH_BITS = 6, 57
#: Hash bits of the histogram that finds where a set's prefix ends: at most 2^14 buckets a set.
CUT_BITS = 8
#: Members of a hash range, about; a range of a set is one block.
RANGE = 1 << 15


def common(a: np.ndarray, b: np.ndarray, size: int) -> int:
    """Members common to two tries over the places 0 to ``size`` - 1, given as sorted places.

    A subtree is an interval of places and its count the distance of two positions in the sorted
    array, so the array is the trie. Both are descended together, level by level: a branch empty
    in one is skipped; one complete in either adds the other's count and is not entered.
    """
    total, width = 0, 1 << max(0, int(size - 1).bit_length())
    lo = np.zeros(1, np.int64)
    while len(lo):
        hi = np.minimum(lo + width, size)
        n_a = np.searchsorted(a, hi) - np.searchsorted(a, lo)
        n_b = np.searchsorted(b, hi) - np.searchsorted(b, lo)
        full_a, full_b = n_a == hi - lo, n_b == hi - lo
        total += int(n_b[full_a].sum()) + int(n_a[full_b & ~full_a].sum())
        go = (n_a > 0) & (n_b > 0) & ~full_a & ~full_b
        width >>= 1
        lo = np.concatenate((lo[go], lo[go] + width))
        lo = lo[lo < size]
    return total


def _descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        n = [common(np.asarray(x), np.asarray(y), s) for x, y, s in zip(b["x"], b["y"], b["size"], strict=True)]
        yield pd.DataFrame({"source": b["source"], "target": b["target"], "n": n})


def overlaps(df: DataFrame, group: str, member: str, min_members: int, min_jaccard: float) -> DataFrame:
    """Pairs of sets whose common members are at least ``min_jaccard`` of the members of either.

    Gives source, target (source < target), n_source, n_target, n_common, jaccard, all exact.
    Sets are the distinct non-null ``member`` values of a ``group`` with ``min_members`` of them
    or more; other columns are ignored, an empty table gives no pair.

    Every member has a place in one binary trie: a rarity class (log2 of the number of sets it
    is in, rare first), then a hash. Of two sets as alike as asked, the first
    n - ceil(min_jaccard * n) + 1 members of each, in this order, have one in common; a member in
    a great many sets stands at the order's end, where few sets begin. Where a set's first
    members end is read off a bounded histogram of its subtree counts. Sets that share first
    members become candidates if these and all that may follow suffice (both bounds are exact,
    so no pair is lost). The candidates' tries are then descended together, by (set, hash range):
    a popular set meets its candidates in parts. What moves is a set's sorted places in a range
    that both have members in, never an intersection.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = stage(df.select(F.col(group).alias("item"), F.col(member).alias("member")).dropna().distinct(), "overlap-members")
    sizes = stage(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_members), "overlap-sizes")
    kept = stage(skew_join(rows, sizes.select("item"), ["item"], "left_semi"), "overlap-kept")
    members = kept.groupBy("member").agg(F.count(F.lit(1)).alias("n_sets"))
    place = members.select("member", "n_sets", F.floor(F.log2("n_sets")).cast("bigint").alias("class"), F.shiftrightunsigned(F.xxhash64("member"), 64 - HASH_BITS).alias("hash"))
    place = stage(place.withColumn("code", F.shiftleft("class", HASH_BITS) + F.col("hash")), "overlap-places")
    sets = stage(skew_join(kept, place.select("member", "n_sets", "code"), ["member"]), "overlap-sets")

    bucket = F.shiftright("code", HASH_BITS - CUT_BITS)
    counts = sets.groupBy("item", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("item").orderBy("bucket")))
    first = F.col("n") - F.ceil(F.lit(min_jaccard) * F.col("n") - 1e-9) + 1
    ends = counts.join(sizes, "item").where(F.col("upto") >= first).groupBy("item", "n").agg(F.min(F.struct("bucket", "upto")).alias("end"))
    ends = stage(ends.select("item", "n", F.col("end.bucket").alias("cut"), (F.col("n") - F.col("end.upto")).alias("rest")), "overlap-cuts")

    begin = skew_join(sets.where("n_sets > 1"), ends.select("item", "cut"), ["item"]).where(bucket <= F.col("cut"))
    shared = pair_weights(begin.select(F.col("member").alias("basket"), "item", F.col("n_sets").alias("size")))
    left = ends.select(F.col("item").alias("source"), F.col("n").alias("n_source"), F.col("cut").alias("cut_a"), F.col("rest").alias("rest_a"))
    right = ends.select(F.col("item").alias("target"), F.col("n").alias("n_target"), F.col("cut").alias("cut_b"), F.col("rest").alias("rest_b"))
    asked = F.lit(min_jaccard / (1 + min_jaccard)) * (F.col("n_source") + F.col("n_target")) - 1e-6
    rest = F.when(F.col("cut_a") <= F.col("cut_b"), F.col("rest_a")).otherwise(F.col("rest_b"))
    most = F.least(F.col("weight") + rest, F.col("n_source"), F.col("n_target"))
    pairs = shared.join(left, "source").join(right, "target").where(most >= asked)
    pairs = stage(pairs.select("source", "target", "n_source", "n_target"), "overlap-candidates")

    n_members = place.where("n_sets > 1").count()
    bits = max(0, int(n_members / RANGE).bit_length())
    order = Window.partitionBy("range").orderBy("code", "member")
    dense = place.where("n_sets > 1").withColumn("range", F.shiftright("code", HASH_BITS - bits))
    dense = dense.select("member", "range", (F.row_number().over(order) - 1).alias("at"))
    widths = dense.groupBy("range").agg(F.count(F.lit(1)).cast("int").alias("size"))
    asked_sets = pairs.select(F.explode(F.array("source", "target")).alias("item")).distinct()
    some = skew_join(sets.where("n_sets > 1"), asked_sets, ["item"], "left_semi").select("item", "member")
    blocks = skew_join(stage(some, "overlap-asked"), dense, ["member"]).groupBy("item", "range").agg(F.sort_array(F.collect_list("at")).alias("places"))
    blocks = stage(blocks.join(widths, "range"), "overlap-blocks")
    spans = stage(blocks.groupBy("item").agg(F.collect_list("range").alias("ranges")), "overlap-ranges")
    met = skew_join(pairs.select("source", "target"), spans.select(F.col("item").alias("source"), F.col("ranges").alias("r")), ["source"])
    met = skew_join(stage(met, "overlap-met"), spans.select(F.col("item").alias("target"), F.col("ranges").alias("s")), ["target"])
    met = stage(met.select("source", "target", F.explode(F.array_intersect("r", "s")).alias("range")), "overlap-met")
    met = skew_join(met, blocks.select(F.col("item").alias("source"), "range", "size", F.col("places").alias("x")), ["source", "range"])
    met = skew_join(stage(met, "overlap-met"), blocks.select(F.col("item").alias("target"), "range", F.col("places").alias("y")), ["target", "range"])
    parts = met.select("source", "target", "size", "x", "y").mapInPandas(_descend, f"source {kind}, target {kind}, n bigint")
    found = parts.groupBy("source", "target").agg(F.sum("n").alias("n_common")).join(pairs, ["source", "target"])
    jaccard = F.col("n_common") / (F.col("n_source") + F.col("n_target") - F.col("n_common"))
    return found.withColumn("jaccard", jaccard).where(F.col("jaccard") >= min_jaccard - 1e-12).select("source", "target", "n_source", "n_target", "n_common", "jaccard")


def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of subreddits whose audiences largely coincide, with the sizes."""
    posts = read(spark, sf_dir, "submissions", "author", "subreddit")
    keyed = posts.select(author_key("author").alias("author"), community_key("subreddit").alias("subreddit"))
    return overlaps(keyed, "subreddit", "author", min_members=30, min_jaccard=0.4)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_overlaps(spark, sf_dir).select("source", "target")


QUERIES = {"p6_found": p6_found, "p6_overlaps": p6_overlaps}

_OVERLAPS = """
WITH m AS (
  SELECT DISTINCT lower(trim(author)) AS author, lower(trim(subreddit)) AS subreddit FROM submissions
  WHERE subreddit IS NOT NULL AND lower(trim(author)) NOT IN ('', '[deleted]', '[removed]')),
s AS (SELECT subreddit, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 30),
k AS (SELECT m.* FROM m JOIN s USING (subreddit)),
w AS (SELECT x.subreddit AS source, y.subreddit AS target, count(*) AS n_common FROM k x JOIN k y ON x.author = y.author AND x.subreddit < y.subreddit GROUP BY ALL),
o AS (SELECT source, target, a.n AS n_source, b.n AS n_target, n_common, n_common / CAST(a.n + b.n - n_common AS DOUBLE) AS jaccard
      FROM w JOIN s a ON a.subreddit = source JOIN s b ON b.subreddit = target WHERE n_common >= 0.4 * (a.n + b.n - n_common))
"""
ORACLE = {"p6_found": _OVERLAPS + "SELECT source, target FROM o", "p6_overlaps": _OVERLAPS + "SELECT * FROM o"}
