"""References to records that do not exist: composite keys, nulls, late arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import skew_join

MATCH = ("simple", "partial", "full")


def _null_mask(columns: list[str]):
    """Bit i is set where column i is null."""
    return sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))


def orphans(refs: DataFrame, parents: DataFrame, columns: dict[str, str], match: str = "simple") -> DataFrame:
    """Rows of ``refs`` whose reference has no record in ``parents``, with ``null_mask`` (int).

    ``columns`` maps the referring columns to the columns of ``parents``. References are grouped
    by their null mask and each group is anti-joined on its non-null columns:

    - ``simple``: a reference with any null refers to nothing and is never an orphan;
    - ``partial``: the non-null columns must be met by one record; an all-null reference is none;
    - ``full``: all or none may be null; a mixed one is an orphan without any look-up.

    Empty ``refs`` give no rows; with empty ``parents`` every reference is an orphan. Repeated
    rows of ``refs`` stay repeated, repeated parents count once, further columns pass through
    (``null_mask`` is overwritten). ``refs`` should be staged: it is read once for each mask.
    """
    if match not in MATCH:
        raise ValueError(f"match is one of {MATCH}, not {match!r}")
    names = list(columns)
    full = (1 << len(names)) - 1
    refs = refs.drop("null_mask").withColumn("null_mask", _null_mask(names).cast("int"))
    masks = [0] if match != "partial" else range(full)
    out = None
    for mask in masks:
        on = [c for i, c in enumerate(names) if not mask >> i & 1]
        keys = parents.select(*(F.col(columns[c]).alias(c) for c in on)).dropna().distinct()
        part = refs.where(F.col("null_mask") == mask)
        part = skew_join(part, keys, on, "left_anti").select(*refs.columns)
        out = part if out is None else out.unionByName(part)
    if match == "full" and full > 1:
        out = out.unionByName(refs.where(~F.col("null_mask").isin(0, full)))
    return out


def first_seen(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The first time each key was seen; pre-aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.min(at).alias(at))


def reference_cases(refs: DataFrame, parents: DataFrame, removed: DataFrame, key: str = "ref_key", at: str = "first_at") -> DataFrame:
    """``refs`` that name a record which is absent, removed or came later, with ``ref_state``.

    ``parents`` has each ``key`` once, with ``at`` when it was first seen; ``removed`` has keys
    known to be removed. ``late``: the record is there but was first seen after the reference;
    ``deleted`` or ``missing``: it is not there and is, or is not, in ``removed``. A reference or
    record without a time is never late; a null reference is no case; repeated rows stay repeated;
    other columns pass through (``ref_state`` is overwritten). ``refs`` should be staged.
    """
    refs = refs.drop("ref_state")
    gone = orphans(refs, parents, {key: key}).drop("null_mask")
    known = removed.select(key).dropna().distinct().withColumn("__removed", F.lit(True))
    gone = skew_join(gone, known, [key], "left").withColumn("ref_state", F.when(F.col("__removed"), "deleted").otherwise("missing"))
    seen = skew_join(refs, parents.select(key, F.col(at).alias("__parent_at")), [key], "inner")
    late = seen.where(F.col("__parent_at") > F.col(at)).withColumn("ref_state", F.lit("late"))
    columns = [*refs.columns, "ref_state"]
    return gone.select(*columns).unionByName(late.select(*columns))
