"""Joins and groupings that hold when one key has a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import stage

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Fewer rows than this go through one task without harm, whatever their share.
HOT_ROWS = 20_000


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> list[tuple]:
    """The keys with at least ``share`` of the rows of ``df`` and at least ``least`` rows.

    At most ``1 / share`` tuples reach the driver, whatever the data. Rows with a null among the
    keys are no key. ``df`` is read once and should be cheap to read again (a staged table).
    """
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    top = counts.orderBy(F.desc("__n")).limit(round(1 / share)).collect()
    if not top:
        return []
    total = df.count()
    return [tuple(r[k] for k in keys) for r in top if r["__n"] >= share * total]


#: Rows of ``right`` for the hot keys are broadcast up to so many bytes; beyond, the hot rows are salted.
MOST_BYTES, SALTS = 64 << 20, 64
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _bytes(df: DataFrame, columns: list[str]) -> int:
    """About the bytes of ``columns`` in ``df``, which should be staged; fixed-width ones are left out."""
    wide = [c for c in columns if not isinstance(df.schema[c].dataType, _FIXED)]
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] or 0) if wide else 0


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = HOT_SHARE, least: int = HOT_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Equi-join of ``left`` with ``right``, whose ``keys`` are unique, without a hot task.

    ``how`` is inner, left, left_semi or left_anti. Rows of ``left`` with a hot key meet the few
    rows of ``right`` with these keys (at most ``1 / share``) by broadcast and never move; all
    others are shuffled. If these few rows, written and measured, have more than ``most_bytes``,
    they are copied to each of :data:`SALTS` salts instead and the hot rows spread over the salts. A null
    key matches nothing. ``left`` should be staged: it is read twice and counted once.
    """
    hot = hot_keys(left, keys, share, least)
    if not hot:
        return left.join(right, keys, how)
    spark = left.sparkSession
    table = F.broadcast(spark.createDataFrame(hot, left.select(*keys).schema))
    is_hot = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    cold = left.where(is_hot).join(table, keys, "left_anti").unionByName(left.where(~is_hot))
    few = right.join(table, keys, "left_semi")
    rest = [c for c in right.columns if c not in keys]
    if any(not isinstance(right.schema[c].dataType, _FIXED) for c in rest):
        few = stage(few, "skew-few")
    many = left.join(table, keys, "left_semi")
    if _bytes(few, rest) <= most_bytes:
        many = many.join(F.broadcast(few), keys, how)
    else:
        salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        many = many.withColumn("__salt", F.monotonically_increasing_id() % SALTS).join(salted, [*keys, "__salt"], how).drop("__salt")
    return cold.join(right, keys, how).unionByName(many)
