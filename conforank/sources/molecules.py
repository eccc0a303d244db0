"""Molecule libraries from CSV, SDF and MOL files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import need_columns, reject_duplicates, reject_if_any
from ..storage import pin, write_table
from .tables import file_ordered, read_csv

FORMATS = (".csv", ".sdf", ".mol")


def read_molecules(spark: SparkSession, path: str, toolkit: Callable[[], object]) -> DataFrame:
    """(parent_pos, parent_id, canonical_smiles) in file order.

    ``toolkit`` makes an object with ``canonical(smiles)`` and ``from_block(block)``,
    both returning canonical SMILES or None. It is made once per task.
    """
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"molecules must come as one of {', '.join(FORMATS)}")
    raw = _read_csv(spark, path) if suffix == ".csv" else _read_blocks(spark, path, suffix)
    parsed = _parse(raw, toolkit, "canonical" if suffix == ".csv" else "from_block")
    table = write_table(parsed, "molecules")
    check_molecules(table)
    return table


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, ordered=True)
    smiles = "canonical_smiles" if "canonical_smiles" in raw.columns else "smiles"
    need_columns(raw, ["parent_molecule_id", smiles], "molecule table")
    rows = raw.select(
        F.trim(F.coalesce("parent_molecule_id", F.lit(""))).alias("parent_id"),
        F.trim(F.coalesce(smiles, F.lit(""))).alias("structure"), "line",
    )
    return number_lines(rows, "parent_pos").drop("line")


def number_lines(rows: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan from 0 in file order; no row moves to another task.

    Each split of a file is a run of rows within a task. Its rows are counted, and it starts
    where the splits before it end.
    """
    placed = rows.withColumns(
        {
            "_part": F.shiftright("line.row", 33), "_file": F.col("line.file"), "_start": F.col("line.start"),
            "_row": F.col("line.row"),
        }
    )
    split = ["_part", "_file", "_start"]
    sizes = placed.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    # One row for each split of the input, which the driver has planned itself.
    before = Window.orderBy("_file", "_start", "_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    starts, fits = pin(sizes.select(*split, shift.alias("_shift")), 512, "line-starts")
    met = placed.join(F.broadcast(starts) if fits else starts, split)
    return met.withColumn(name, F.col("_row") + F.col("_shift")).drop(*split, "_row", "_shift")


def _read_blocks(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    if suffix == ".mol":
        raw = spark.read.text(str(path), wholetext=True).select("value", F.lit(0).cast("bigint").alias("parent_pos"))
    else:
        records = file_ordered(spark.read.option("lineSep", "$$$$").text(str(path)))
        raw = number_lines(records, "parent_pos")
        # Each record but the first starts with the end of the separator line.
        rest = F.regexp_replace("value", r"^\r?\n", "")
        raw = raw.withColumn("value", F.when(F.col("parent_pos") > 0, rest).otherwise(F.col("value")))
        last = raw.agg(F.max("parent_pos")).first()[0]
        raw = raw.where(~((F.col("parent_pos") == F.lit(last)) & (F.trim(F.regexp_replace("value", r"\s", "")) == "")))
    title = F.trim(F.regexp_replace(F.split("value", "\n")[0], r"\s+$", ""))
    numbered = F.concat(F.lit("molecule_"), (F.col("parent_pos") + 1).cast("string"))
    return raw.select(
        F.when(title == "", numbered).otherwise(title).alias("parent_id"),
        F.col("value").alias("structure"), "parent_pos",
    )


def _parse(raw: DataFrame, toolkit: Callable[[], object], method: str) -> DataFrame:
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parse = getattr(toolkit(), method)
        for structures in batches:
            yield pd.Series([parse(s) for s in structures], dtype=object)

    canonical = F.pandas_udf(convert, "string")
    return raw.select("parent_pos", "parent_id", canonical("structure").alias("canonical_smiles"))


def check_molecules(table: DataFrame) -> None:
    if table.isEmpty():
        raise ValueError("no molecules in the input")
    place = (F.col("parent_pos") + 1).cast("string")
    reject_if_any(table.where("parent_id = ''"), ValueError, "empty molecule ID at row", place)
    reject_if_any(
        table.where("canonical_smiles is null"), ValueError, "structure not understood for", F.col("parent_id")
    )
    reject_duplicates(table, ["parent_id"], "molecule IDs")
