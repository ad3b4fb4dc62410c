"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the operators rely on. ANSI stays on: every doubtful cast is a ``try_`` one.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[*]", app: str = "skein", **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` wins."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) is a temporary folder made; on a
    cluster an unset folder is an error, since a machine-local one would be lost with its machine.
    """
    set_already = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Tables written by this driver and not yet swept.
_STAGED: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete the tables staged so far and give their number; results that still read them must be written before."""
    jvm, n = spark._jvm, len(_STAGED)
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted by :func:`sweep`."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    Parquet rather than ``checkpoint()``: compressed, and later reads prune columns and rows.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One table of a data directory, pruned to ``columns`` if given."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df
