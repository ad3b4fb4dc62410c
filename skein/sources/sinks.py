"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def cleaned_name(path: str) -> str:
    """Where the cleaned table of a dump file goes."""
    return f"{path.removesuffix('.zst')}_cleaned.parquet"


def write_parquet(df: DataFrame, path: str, rows_per_file: int = 2_000_000, partition_by: list[str] | None = None) -> bool:
    """Overwrite ``path``; False, and nothing left there, for an empty table. Rows are counted as they are written."""
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    if seen.get["n"]:
        return True
    spark = df.sparkSession
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return False


def write_single(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """One file, for small final results such as edge lists: only the last step runs in one task."""
    w = df.repartition(1).write.mode(mode)
    w.csv(path, header=True) if form == "csv" else w.parquet(path)


def append_lines(df: DataFrame, column: str, path: str) -> None:
    """Append a column of names to a list of lines."""
    df.select(df[column].cast("string").alias("value")).write.mode("append").text(path)


def preview(df: DataFrame, *order, n: int = 20) -> DataFrame:
    """The first ``n`` rows by a total order."""
    return df.orderBy(*order).limit(n)
