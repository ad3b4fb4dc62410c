"""Scans: compressed JSON lines, Parquet sets with differing schemas, lists, manifests, footers."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from skein.functions.keys import strip
from skein.operators.clean import clean_comments, clean_submissions, parse_objects


def json_lines(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """``record`` (variant) and ``file_name`` of each JSON object in text files, plain or ``.zst`` / ``.gz``.

    A compressed file is one task; give ``partitions`` to spread what follows. Blank, broken and
    other lines are dropped.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return parse_objects(lines.repartition(partitions) if partitions else lines).drop("value")


def file_kind(name: str) -> str:
    """``submissions`` or ``comments``, from a file's name."""
    for kind in ("submissions", "comments"):
        if f"_{kind}" in name.lower():
            return kind
    raise ValueError(f"neither submissions nor comments: {name}")


def cleaned(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A dump file as the cleaned table of its kind."""
    clean = clean_submissions if file_kind(os.path.basename(path)) == "submissions" else clean_comments
    return clean(json_lines(spark, path, partitions))


def parquet_set(spark: SparkSession, path: str, *columns: str, merge: bool = False, skip_corrupt: bool = False, glob: str | None = None) -> DataFrame:
    """Parquet files below ``path``, pruned to ``columns``; hive directories become columns."""
    reader = spark.read.option("mergeSchema", str(merge).lower()).option("ignoreCorruptFiles", str(skip_corrupt).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def compatible_files(spark: SparkSession, paths: list[str], required: list[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Paths whose footers have all ``required`` columns, sorted, and for each other path what it lacks.

    Footers are read by the tasks, 16 paths each; a folder counts by its first file with a footer.
    A path that can't be read lacks everything.
    """

    def lacking(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            yield pd.DataFrame({"path": b["path"], "lacks": [[c for c in required if c not in _footer_columns(p)] for p in b["path"]]})

    table = spark.createDataFrame([(p,) for p in sorted(paths)], "path string").repartition(max(1, len(paths) // 16), "path")
    found = sorted((r["path"], r["lacks"]) for r in table.mapInPandas(lacking, "path string, lacks array<string>").collect())
    good = [p for p, lacks in found if not len(lacks)]
    if not good:
        raise FileNotFoundError("no file has the required columns")
    return good, {p: list(lacks) for p, lacks in found if len(lacks)}


def _opened(path: str):
    """File system and path of a path or URI that executors share; a plain path is a local or mounted one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+://", path) else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _footer_columns(path: str) -> list[str]:
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = _opened(path)
    try:
        if system.get_file_info(at).type == fs.FileType.Directory:
            files = sorted(f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.path.endswith(".parquet"))
        else:
            files = [at]
        for f in files:
            return pq.read_schema(f, filesystem=system).names
    except (OSError, pa.ArrowInvalid):
        pass
    return []


def edge_list(spark: SparkSession, path: str, source: str, target: str, weight: str, form: str = "parquet") -> DataFrame:
    """source, target, weight (double) from a Parquet or CSV file; an error names what is missing."""
    try:
        df = spark.read.csv(path, header=True) if form == "csv" else spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no edges at {path}") from e
    if missing := sorted({source, target, weight} - set(df.columns)):
        raise ValueError(f"edges lack {', '.join(missing)}")
    return df.select(F.col(source).alias("source"), F.col(target).alias("target"), F.col(weight).try_cast("double").alias("weight"))


def word_list(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """``name``: the lines of a list, stripped, without byte order mark and blank lines; a missing file is empty."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "name string")
    name = strip(F.regexp_replace("value", "^﻿", ""))
    return lines.select((F.lower(name) if lower else name).alias("name")).where("name <> ''")


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, modified of the files below ``path``, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def stored_names(files: DataFrame, prefix: str = "folder_") -> DataFrame:
    """``name`` of the stored Parquet files in numbered folders: lower case, without ending."""
    kept = files.where(F.contains("path", F.lit(f"/{prefix}")) & F.col("path").endswith(".parquet"))
    return kept.select(F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"(_cleaned)?\.parquet$", "")).alias("name")).distinct()


def probe_footers(files: DataFrame, attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """path, n_rows, status of Parquet files by their footers alone: ok, corrupted or unreachable.

    Paths and URIs are opened by the executors; a footer that can't be reached is tried
    ``attempts`` times, ``wait`` seconds apart and each time twice as long.
    """

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for b in parts:
            rows = []
            for path in b["path"]:
                n, status = None, "unreachable"
                for i in range(attempts):
                    try:
                        system, at = _opened(path)
                        n, status = pq.read_metadata(at, filesystem=system).num_rows, "ok"
                        break
                    except (pa.ArrowInvalid, ValueError):
                        status = "corrupted"
                        break
                    except OSError:
                        if i < attempts - 1:
                            time.sleep(wait * 2**i)
                rows.append((path, n, status))
            yield pd.DataFrame(rows, columns=["path", "n_rows", "status"]).astype({"n_rows": "Int64"})

    return files.select("path").mapInPandas(probe, "path string, n_rows bigint, status string")
