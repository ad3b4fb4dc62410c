"""Vector means, cosine similarity of pairs and graphs of similar things."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from skein.operators.selection import key_quantiles
from skein.session import stage

#: Vectors of a block; a pair of blocks is one matrix product.
BLOCK = 1024


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group``, n, centroid (array<double>): the mean vector of each group, summed in double.

    Vectors are exploded and their places merged map-side, so a large group moves one row per
    place and task. Null vectors don't count.
    """
    parts = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(group, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    lists = means.groupBy(group).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p"))
    return lists.select(group, "n", F.col("p.m").alias("centroid"))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def cosine_pairs(df: DataFrame, key: str, vector: str, above: float | None = None, block: int = BLOCK) -> DataFrame:
    """source, target (source < target), similarity of each two keys, or of those ``above`` a value (strictly).

    Rows are cut into blocks by a hash of the key; each two blocks meet once, under their own
    key, and are multiplied as matrices in one task, so no task sees more than two blocks and
    only what passes ``above`` leaves it. A zero vector is similar to nothing (0). Rows without
    key or vector don't count; keys should be unique.
    """
    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, s, keep = _products(pdf)
        return _pairs_of(a, b, s, keep if above is None else keep & (s > above))

    blocks, kind = _block_pairs(df, key, vector, block)
    return blocks.applyInPandas(product, f"source {kind}, target {kind}, similarity double")


def _block_pairs(df: DataFrame, key: str, vector: str, block: int) -> tuple[GroupedData, str]:
    """The rows (key, v, b, x, y) grouped by each two blocks x and y, and the type of the key."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v")).dropna()
    n = max(1, -(-rows.count() // block))
    cut = rows.withColumn("b", F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(n)).cast("int"))
    spread = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.select("key", "v", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y")).groupBy("x", "y"), rows.schema["key"].dataType.simpleString()


def _products(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the rows and columns of a matrix of similarities, the matrix, and which of it are pairs."""
    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    left, right = pdf[pdf["b"] == x], pdf[pdf["b"] == y]
    a, b = left["key"].to_numpy(), right["key"].to_numpy()
    if not len(left) or not len(right):
        return a, b, np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
    return a, b, _unit(left["v"]) @ _unit(right["v"]).T, np.less.outer(a, b) if x == y else np.ones((len(a), len(b)), bool)


def _pairs_of(a: np.ndarray, b: np.ndarray, s: np.ndarray, keep: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(keep)
    p, q = a[i], b[j]
    swap = p > q
    return pd.DataFrame({"source": np.where(swap, q, p), "target": np.where(swap, p, q), "similarity": s[i, j]})


def percentile(df: DataFrame, value: str, q: float) -> float | None:
    """The percentile (0 to 1) of ``value`` with linear interpolation, by distributed selection; None if empty."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return None
    h = (n - 1) * q
    low = int(h)
    probs = {"a": (low + 0.5) / n, "b": (min(low + 1, n - 1) + 0.5) / n}
    row = key_quantiles(df.select(F.lit(0).alias("_k"), F.col(value).alias("_x")), ["_k"], "_x", probs).first()
    return row["a"] + (row["b"] - row["a"]) * (h - low)


#: Equal bins of [-1, 1] in which similarities are counted; so many counts reach the driver at most.
BINS = 1 << 15


def pairs_above_percentile(df: DataFrame, key: str, vector: str, q: float = 0.97, block: int = BLOCK) -> DataFrame:
    """source, target, similarity of the pairs whose similarity is at least the ``q`` percentile of all, exactly.

    As :func:`cosine_pairs`, in two passes of block products. In the first each task counts its
    similarities in bins and only counts leave it; they tell in which bin the percentile lies. In
    the second only pairs from that bin on are written; the percentile is selected among those
    of its bin. No task or table ever has all pairs. Fewer than two rows give no pair.
    """
    blocks, kind = _block_pairs(df, key, vector, block)
    bins = lambda s: np.clip(((s + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, s, keep = _products(pdf)
        n = np.bincount(bins(s[keep]), minlength=BINS)
        return pd.DataFrame({"bin": np.flatnonzero(n), "n": n[n > 0]})

    counts = {r["bin"]: r["n"] for r in blocks.applyInPandas(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    h = max(total - 1, 0) * q
    low, below, lower, upper = int(h), 0, 0, BINS
    for at in sorted(counts):
        lower = at if below <= low else lower
        below += counts[at]
        if below > min(low + 1, total - 1):
            upper = at + 1
            break
    edge = lambda at: at / (BINS / 2) - 1

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, s, keep = _products(pdf)
        return _pairs_of(a, b, s, keep & (s >= edge(lower) - 1e-9))

    kept = stage(blocks.applyInPandas(product, f"source {kind}, target {kind}, similarity double"), "similarity-kept")
    if not total:
        return kept
    near = kept.where(F.col("similarity") <= edge(upper) + 1e-9)
    n, first = near.count(), low - (total - kept.count())
    ranks = {name: (min(first + i, n - 1) + 0.5) / n for i, name in enumerate("ab")}
    row = key_quantiles(near.select(F.lit(0).alias("_k"), F.col("similarity").alias("_x")), ["_k"], "_x", ranks).first()
    return kept.where(F.col("similarity") >= row["a"] + (row["b"] - row["a"]) * (h - low))


def nearest(df: DataFrame, key: str, vector: str, of: object, k: int = 10) -> DataFrame:
    """The ``k`` rows most similar to the row with key ``of``, itself left out: neighbour, similarity, position."""
    row = df.where(F.col(key) == of).select(vector).first()
    if row is None or row[0] is None:
        return df.select(F.col(key).alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("position")).where(F.lit(False))
    v = np.asarray(row[0], np.float64)
    unit = (v / (np.linalg.norm(v) or 1.0)).tolist()
    query = F.array(*map(F.lit, unit))
    dot = F.aggregate(F.zip_with(F.col(vector), query, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scored = df.where((F.col(key) != of) & F.col(vector).isNotNull()).select(F.col(key).alias("neighbour"), F.when(norm == 0, 0.0).otherwise(dot / norm).alias("similarity"))
    best = scored.orderBy(F.desc("similarity"), "neighbour").limit(k)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("similarity"), "neighbour")))


def nearest_each(df: DataFrame, key: str, vector: str, of: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows most similar to each row for which ``of`` is true, itself left out: query, neighbour, similarity, position.

    Queries and rows are cut into blocks by a hash of the key; each block of queries meets each
    block of rows under their own key as one matrix product, of which the ``k`` best of each query
    leave the task. Similarities are rounded to 12 places, so that equal vectors tie; ties go to
    the lower key. A zero vector is similar to nothing (0). Rows without key or vector don't
    count; keys should be unique.
    """
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.coalesce(of, F.lit(False)).alias("asks")).dropna()
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("m")).first()
    n, m = (max(1, -(-sizes[c] // block)) for c in ("n", "m"))
    kind = rows.schema["key"].dataType.simpleString()
    place = lambda parts: F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = rows.where("asks").select("key", "v", F.lit(True).alias("asks"), place(m).alias("x"), every(n).alias("y"))
    given = rows.select("key", "v", F.lit(False).alias("asks"), every(m).alias("x"), place(n).alias("y"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("key")
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "neighbour": [], "similarity": []})
        s = np.round(_unit(left["v"]) @ _unit(right["v"]).T, 12)
        a, b = left["key"].to_numpy(), right["key"].to_numpy()
        s[np.equal.outer(a, b)] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(s, top, 1)
        i, j = np.nonzero(found > -np.inf)
        return pd.DataFrame({"query": a[i], "neighbour": b[top[i, j]], "similarity": found[i, j]})

    scored = asked.unionByName(given).groupBy("x", "y").applyInPandas(best, f"query {kind}, neighbour {kind}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
