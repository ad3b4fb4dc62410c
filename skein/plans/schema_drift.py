"""Raw submissions whose schema drifts from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators.drift import catalogue, changes, lifespans, records, unified
from skein.session import read, stage


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(read(spark, sf_dir, "raw_submissions", "series", "file_no", "payload"))


def p5_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, file_no, n_records, field, n_carry, json_type of every field of every file."""
    return catalogue(_parsed(spark, sf_dir)).drop("content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a field: series, file_no, change_kind, old_field, new_field."""
    return changes(lifespans(stage(catalogue(_parsed(spark, sf_dir)), "drift-catalogue")))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed table of submissions from all files, whatever their fields are called."""
    parsed = stage(_parsed(spark, sf_dir), "drift-records")
    fields = stage(catalogue(parsed), "drift-catalogue")
    return unified(parsed, fields, changes(lifespans(fields)))


QUERIES = {"p5_found": p5_found, "p5_catalogue": p5_catalogue, "p5_table": p5_table}
ORACLE: dict[str, str] = {}
