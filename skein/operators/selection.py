"""Exact figures per key by distributed selection: histograms refined until the ranks resolve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.skew import skew_join
from skein.session import stage


def _bucket(v: Column, lo: Column, hi: Column, buckets: int, whole: bool) -> Column:
    """The bucket, 0 to ``buckets`` - 1, of ``v`` in [lo, hi]; monotone, lo and hi never share one."""
    edge = F.when(v == lo, 0).otherwise(buckets - 1)
    if whole:
        rel, width = F.try_subtract(v, lo).cast("double"), F.try_subtract(hi, lo).cast("double")
        far, width_far = v.cast("double") - lo.cast("double"), hi.cast("double") - lo.cast("double")
        at = F.when(width.isNotNull(), rel / width).otherwise(far / width_far)
        return F.when(v == hi, buckets - 1).otherwise(F.least(F.floor(at * buckets), F.lit(buckets - 1))).cast("int")
    inf = float("inf")
    width = hi * 0.5 - lo * 0.5
    ends = F.when(v == -inf, 0).when(v == inf, 2).otherwise(1)
    inner = F.when(v == hi, buckets - 1).otherwise(F.least(F.floor((v * 0.5 - lo * 0.5) / width * buckets), F.lit(buckets - 1)))
    return F.when((lo == -inf) | (hi == inf), ends).when(width == 0, edge).otherwise(inner).cast("int")


def key_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], least_rows: int = 1, buckets: int = 256) -> DataFrame:
    """Row counts and exact quantiles of ``value`` for each key, heavy keys like any other.

    Gives ``keys``, ``n_rows``, ``n_values`` (without nulls and NaN) and for each name in
    ``probs`` the value of rank ceil(p * n_values), rank 1 at least, in ascending order; null
    where a key has no value. Only keys with ``least_rows`` rows or more come out. Rows with a
    null among the keys are no key; decimals count as doubles; an empty ``df`` gives no row; other columns are ignored.

    Rows are first merged into counts of (key, value), which spreads a hot key over all tasks.
    Every round then splits the value range of each open (key, quantile) into ``buckets``,
    merges the counts of each bucket map-side and keeps the bucket that holds the rank with its
    true minimum and maximum, until these are equal. What meets in one task for a key is one
    histogram, never its values. Ties need no rule, since equal values are one entry.
    """
    given, keys = keys, [f"__k{i}" for i in range(len(keys))]
    whole = not isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    v = F.col(value).cast("long" if whole else "double")
    kept = df.select(*(F.col(g).alias(k) for g, k in zip(given, keys, strict=True)), (v if whole else F.when(~F.isnan(v), v)).alias("_v")).dropna(subset=keys)
    hist = stage(kept.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "selection-counts")
    totals = hist.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_values"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    totals = stage(totals.where(F.col("n_rows") >= least_rows), "selection-totals")
    names = list(probs)
    pick = F.explode(F.array(*(F.struct(F.lit(n).alias("q"), F.lit(float(probs[n])).alias("p")) for n in names)))
    state = totals.where("n_values > 0").select(*keys, "n_values", "_lo", "_hi", pick.alias("_q"))
    state = state.select(*keys, F.col("_q.q").alias("_name"), F.greatest(F.lit(1), F.ceil(F.col("_q.p") * F.col("n_values"))).alias("_rank"), "_lo", "_hi")
    done: list[DataFrame] = []
    while True:
        done.append(state.where("_lo = _hi").select(*keys, "_name", F.col("_lo").alias("_value")))
        open_ = state.where("_lo < _hi")
        if open_.isEmpty():
            break
        goals = open_.groupBy(*keys).agg(F.collect_list(F.struct("_name", "_rank", "_lo", "_hi")).alias("_goals"), F.min("_lo").alias("_min"), F.max("_hi").alias("_max"))
        met = skew_join(hist, goals, keys).where("_v between _min and _max")
        met = met.select(*keys, "_v", "_n", F.explode("_goals").alias("_g")).where("_v between _g._lo and _g._hi")
        counts = met.groupBy(*keys, F.col("_g._name").alias("_name"), _bucket(F.col("_v"), F.col("_g._lo"), F.col("_g._hi"), buckets, whole).alias("_b")).agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_g._rank").alias("_rank")
        )
        below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_name").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = counts.withColumn("_below", below).where("_rank > _below and _rank <= _below + _n")
        state = stage(state.select(*keys, "_name", (F.col("_rank") - F.col("_below")).alias("_rank"), "_lo", "_hi"), "selection-round")
    values = reduce(DataFrame.unionByName, done)
    wide = values.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in names))
    out = totals.select(*keys, "n_rows", "n_values").join(wide, keys, "left")
    return out.select(*(F.col(k).alias(g) for g, k in zip(given, keys, strict=True)), "n_rows", "n_values", *names)
