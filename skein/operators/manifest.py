"""Decisions about files: triage, quotas, batches, folders, deletions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.keys import folded
from skein.operators.sequence import running
from skein.session import stage

MIB = 1 << 20


def base_name(path: Column) -> Column:
    """The name after the last slash."""
    return F.substring_index(path, "/", -1)


def sensitive(name: Column, keywords: list[str]) -> Column:
    """True where a keyword occurs capitalised, or in lower case where no letter stands before it.

    ``keywords`` is a given list; each is tried only on names that contain it at all.
    """
    lower = F.lower(name)
    tests = [F.contains(lower, F.lit(k)) & (F.contains(name, F.lit(k[:1].upper() + k[1:])) | lower.rlike(f"(^|[^a-zA-Z]){_literal(k)}")) for k in (w.lower() for w in keywords) if k]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _literal(word: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", word)


def triage(files: DataFrame, trash: DataFrame, banned: DataFrame, present: DataFrame, keywords: list[str], least: int = MIB) -> DataFrame:
    """``files`` (path, size) with ``reason``, the first that holds.

    too_small (under ``least`` bytes), trash (base name listed), banned (community listed, any case),
    present (name already stored, any case, without its ending), sensitive (keyword), keep.
    The lists have one column ``name`` each and are joined by equality.
    """
    f = files.withColumn("_name", base_name(F.col("path"))).withColumn("_base", F.regexp_replace(F.lower("_name"), r"\.zst$", ""))
    f = f.withColumn("_community", F.regexp_replace("_base", "_(submissions|comments)$", ""))
    marks = {"trash": (trash.select(F.col("name").alias("_name")), "_name"), "banned": (banned.select(F.lower("name").alias("_community")), "_community"), "present": (present.select(F.lower("name").alias("_base")), "_base")}
    for mark, (names, on) in marks.items():
        f = f.join(names.dropna().distinct().withColumn(f"_{mark}", F.lit(True)), on, "left")
    reason = F.when(F.col("size") < least, "too_small")
    for mark in marks:
        reason = reason.when(F.col(f"_{mark}"), mark)
    reason = reason.when(sensitive(base_name(F.col("path")), keywords), "sensitive").otherwise("keep")
    return f.select(*files.columns, reason.alias("reason"))


def reason_totals(triaged: DataFrame) -> DataFrame:
    """Files and bytes of each reason."""
    return triaged.groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def pick_small_first(files: DataFrame, quota: int, tie: str) -> DataFrame:
    """The files taken in ascending size (ties by ``tie``) while their total stays within ``quota``."""
    placed = running(files, [F.asc("size"), F.asc(tie)], "size")
    return placed.where(F.col("before") + F.col("size") <= quota).drop("position", "before")


def pick_large_first(files: DataFrame, quota: int, tie: str) -> DataFrame:
    """The files taken in descending size (ties by ``tie``), leaving out each that doesn't fit any more.

    Round by round: the longest run of fitting files is a prefix sum; the first file that doesn't fit is larger
    than what is left but no larger than any taken, so what is left halves with each round.
    """
    placed = stage(running(files, [F.desc("size"), F.asc(tie)], "size"), "quota-placed")
    taken, left, after = None, quota, 0
    while True:
        rest = placed.where((F.col("position") > after) & (F.col("size") <= left))
        head = rest.orderBy("position").select("position", "before").first()
        if head is None:
            break
        run = placed.where((F.col("position") >= head["position"]) & (F.col("before") - head["before"] + F.col("size") <= left))
        end = run.agg(F.max("position").alias("p"), F.sum("size").alias("s")).first()
        left, after = left - end["s"], end["p"]
        taken = run if taken is None else taken.unionByName(run)
    return (placed.limit(0) if taken is None else taken).drop("position", "before")


def next_batch(files: DataFrame, target: int, order: str) -> DataFrame:
    """The files, in ``order``, up to and with the one that reaches ``target`` bytes."""
    return running(files, [F.asc(order)], "size").where(F.col("before") < target).drop("position", "before")


def folders(files: DataFrame, order: str, start: int = 1, filled: int = 0, most: int = 9000) -> DataFrame:
    """``folder`` of each file: the folder ``start`` already holds ``filled`` files, each at most ``most``."""
    return running(files, [F.asc(order)]).withColumn("folder", (F.floor((F.col("position") - 1 + filled) / most) + start).cast("bigint")).drop("position", "before")


def folder_state(paths: DataFrame, path: str = "path", prefix: str = "folder_") -> DataFrame:
    """Number of files in each numbered folder."""
    index = F.regexp_extract(F.col(path), f"{prefix}([0-9]+)/", 1).try_cast("bigint")
    return paths.select(index.alias("folder")).dropna().groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


def chunks(ids: DataFrame, order: str, size: int) -> DataFrame:
    """``chunk`` (from 0) of each row, ``size`` rows in each."""
    return running(ids, [F.asc(order)]).withColumn("chunk", F.floor((F.col("position") - 1) / size).cast("bigint")).drop("position", "before")


def sibling(name: Column) -> Column:
    """What goes with a discarded file: of its comments the cleaned submissions, and the other way round."""
    to = F.when(name.endswith("_comments.zst"), F.regexp_replace(name, r"_comments\.zst$", "_submissions_cleaned.parquet"))
    return to.when(name.endswith("_submissions.zst"), F.regexp_replace(name, r"_submissions\.zst$", "_comments_cleaned.parquet"))


def siblings_of_trash(stored: DataFrame, trash: DataFrame) -> DataFrame:
    """Stored paths that are the sibling of a discarded file (equal base names)."""
    doomed = trash.select(sibling(base_name(F.col("name"))).alias("_base")).dropna().distinct()
    return stored.withColumn("_base", base_name(F.col("path"))).join(doomed, "_base", "left_semi").drop("_base")


def deletions(stored: DataFrame, trash: DataFrame, wanted: DataFrame, keywords: list[str], batch: int = 100) -> DataFrame:
    """path, batch_no of what to delete: siblings of trash and sensitive names, without ``wanted``."""
    both = siblings_of_trash(stored, trash).select("path").union(stored.where(sensitive(base_name(F.col("path")), keywords)).select("path")).distinct()
    kept = both.join(wanted.select(F.col("name").alias("path")).distinct(), "path", "left_anti")
    return chunks(kept, "path", batch).withColumnRenamed("chunk", "batch_no")


def states(files: DataFrame, processed: DataFrame, safe: DataFrame) -> DataFrame:
    """``state`` of each torrent file (idx, size, progress, priority): ready, active, candidate or idle.

    ready: complete, safe and not yet processed; active: wanted and not complete; candidate: not
    wanted yet, not complete, safe and not processed; all others are idle.
    """
    f = files.join(processed.select("idx", F.lit(True).alias("_done")).distinct(), "idx", "left").join(safe.select("idx", F.lit(True).alias("_safe")).distinct(), "idx", "left")
    free = F.col("_done").isNull() & F.col("_safe").isNotNull()
    state = F.when((F.col("progress") == 1) & free, "ready").when((F.col("progress") < 1) & (F.col("priority") > 0), "active")
    return f.withColumn("state", state.when((F.col("progress") < 1) & (F.col("priority") == 0) & free, "candidate").otherwise("idle")).drop("_done", "_safe")


def in_folder(path: Column, folder: str) -> Column:
    """True for a Parquet file of submissions below ``folder``."""
    return path.startswith(folder) & path.endswith(".parquet") & F.contains(F.lower(path), F.lit("submission"))


def map_files(df: DataFrame, community: str, stored: DataFrame, name: str) -> DataFrame:
    """community, n_rows, path: the stored file of each community of ``df``, names compared in lower case without blanks around.

    ``stored`` has ``name`` (lower case, once each) and ``path``. Rows are counted map-side before
    the join; a community without a file keeps a null path.
    """
    asked = df.select(folded(community).alias("community")).dropna().groupBy("community").agg(F.count(F.lit(1)).alias("n_rows"))
    return asked.join(stored.select(F.col(name).alias("community"), "path"), "community", "left").select("community", "n_rows", "path")


def map_misses(mapped: DataFrame) -> DataFrame:
    """One row: communities, those without a file, and the rows these have."""
    gone = F.col("path").isNull()
    return mapped.agg(F.count(F.lit(1)).alias("n_communities"), F.count_if(gone).alias("n_missing"), F.coalesce(F.sum(F.when(gone, F.col("n_rows"))), F.lit(0)).alias("n_rows_missing"))


def in_units(size: Column, unit: str) -> Column:
    """Bytes as MB or GB (of 1024), two places."""
    return F.round(size / {"MB": 1 << 20, "GB": 1 << 30}[unit], 2)
