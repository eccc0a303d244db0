"""Spark session defaults, written intermediate tables and small pinned tables."""

from __future__ import annotations

import itertools
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound for anything sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64

_serial = itertools.count()


def build_session(cores: str = "*", app: str = "conforank") -> SparkSession:
    """Local session for tests and small libraries; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="conforank-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/conforank-{context.applicationId}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    This cuts lineage, so a lost executor costs a re-read and not a recomputation,
    and it keeps column pruning and size statistics for later plans.
    """
    path = f"{work_folder(df.sparkSession)}/{next(_serial):06d}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, row_bytes: int, name: str, limit: int = BROADCAST_BYTES):
    """Evaluate a table expected to be small.

    Returns ``(table, fits)``. When at most ``limit / row_bytes`` rows come back
    and no more than ``limit`` bytes, the table is a local relation and may be broadcast;
    otherwise it is written.
    """
    most = max(1, limit // row_bytes)
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows <= most and rows.nbytes <= limit:
        return df.sparkSession.createDataFrame(rows, schema=df.schema), True
    return write_table(df, name), False


def attach(big: DataFrame, small: DataFrame, on: list[str], fits: bool, salt_by: list[str]) -> DataFrame:
    """Inner join of row data with per-group values.

    Groups may hold any share of the rows. A pinned table that fits is broadcast;
    otherwise both sides are salted so that a hot group spreads over many tasks.
    """
    if fits:
        return big.join(F.broadcast(small), on)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")
