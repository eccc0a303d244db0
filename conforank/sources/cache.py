"""Parquet caches of vectors, reference pools and whiteners."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import to_lists
from ..operators.means import with_counts
from ..operators.references import validate_pool
from ..operators.whitening import from_long, to_long
from ..schema import CONFORMER_COLUMNS, need_columns, reject_duplicates, reject_if_any

# Rows handed to Spark at a time when foreign arrays are read.
IMPORT_ROWS = 10_000

CONFORMERS = "parent_pos bigint, parent_id string, n_conf bigint, pose_idx int, embedding array<float>, target_id string"
MOLECULES = "target_id string, parent_pos bigint, parent_id string, n_conf bigint"
LABELS = "target_id string, parent_id string, label int"
POOL = "parent_pos bigint, parent_id string, n_conf bigint, pose_idx int, embedding array<float>, canonical_smiles string"


def write_cache(conformers: DataFrame, path: str, labels: DataFrame | None = None) -> None:
    """Write a library. Existing output is an error.

    Rows are range ordered by molecule, so a molecule's vectors stay together, file
    statistics narrow a lookup by ID, and a target is one directory.
    """
    rows = with_counts(conformers).select(
        *[F.col(c) for c in CONFORMER_COLUMNS if c != "embedding"],
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    place = ["target_id", "parent_pos", "pose_idx"]
    ordered = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.write.mode("errorifexists").partitionBy("target_id").parquet(f"{path}/conformers")
    stored = read_conformers(conformers.sparkSession, path)
    stored.where("pose_idx = 0").select("target_id", "parent_pos", "parent_id", "n_conf").write.mode(
        "errorifexists"
    ).parquet(f"{path}/molecules")
    if labels is not None:
        labels.select("target_id", "parent_id", F.col("label").cast("int")).write.mode("errorifexists").parquet(
            f"{path}/labels"
        )


def read_conformers(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Vectors of all targets, or of one, which prunes to its directory."""
    df = spark.read.schema(CONFORMERS).parquet(f"{path}/conformers").select(*CONFORMER_COLUMNS)
    return df if target is None else df.where(F.col("target_id") == target)


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MOLECULES).parquet(f"{path}/molecules")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Activity labels, kept apart so that scoring never reads them."""
    labels = spark.read.schema(LABELS).parquet(f"{path}/labels")
    reject_if_any(
        labels.where("label is null or label not in (0, 1)"), ValueError, "labels must be 0 or 1", F.col("parent_id")
    )
    return labels


def validate_cache(spark: SparkSession, path: str) -> None:
    """Index and vectors agree: unique IDs, counts, one vector width, labels for all."""
    molecules, conformers = read_molecules(spark, path), read_conformers(spark, path)
    reject_duplicates(molecules, ["target_id", "parent_id"], "molecule IDs")
    reject_duplicates(molecules, ["target_id", "parent_pos"], "molecule positions")
    stored = conformers.groupBy("target_id", "parent_pos").agg(F.count(F.lit(1)).alias("rows"))
    both = molecules.join(stored, ["target_id", "parent_pos"], "full")
    reject_if_any(
        both.where("n_conf is null or rows is null or n_conf < 1 or rows <> n_conf"), ValueError,
        "molecule counts differ from the vectors", F.col("parent_id"),
    )
    widths = conformers.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if widths["low"] != widths["high"]:
        raise ValueError(f"vector widths range from {widths['low']} to {widths['high']}")


def validate_labels(molecules: DataFrame, labels: DataFrame) -> None:
    """Every molecule has exactly one label, 0 or 1. One join, one answer."""
    keys = ["target_id", "parent_id"]
    given = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("given"), F.count_if(F.col("label").isin(0, 1)).alias("valid"))
    bad = label_violations(molecules.select(*keys).distinct().join(given, keys, "left"))
    reject_if_any(bad, ValueError, "labels are missing, repeated or not 0 or 1", F.concat_ws(" ", "parent_id", "problem"))


def label_violations(counted: DataFrame) -> DataFrame:
    """Rows of (..., given, valid) that break the rule, with ``problem``."""
    problem = (
        F.when(F.coalesce("given", F.lit(0)) == 0, "missing")
        .when(F.col("given") > 1, "repeated")
        .when(F.col("valid") == 0, "invalid")
    )
    return counted.withColumn("problem", problem).where("problem is not null")


def library_violations(molecules: DataFrame, conformers: DataFrame) -> DataFrame:
    """(target_id, parent_id, problem) where index and vectors disagree or an ID occurs twice."""
    key = ["target_id", "parent_id"]
    ids = molecules.groupBy(*key).agg(F.count(F.lit(1)).alias("uses"), F.max("n_conf").alias("n"), F.max("parent_pos").alias("pos"))
    stored = conformers.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("parent_pos").alias("places"), F.max("parent_pos").alias("at")
    )
    problem = (
        F.when(F.col("uses").isNull(), "not in the index")
        .when(F.col("rows").isNull(), "no vectors")
        .when((F.col("uses") > 1) | (F.col("places") > 1), "repeated ID")
        .when((F.col("n") < 1) | (F.col("n") != F.col("rows")) | (F.col("pos") != F.col("at")), "counts differ")
    )
    both = ids.join(stored, key, "full").withColumn("problem", problem)
    return both.where("problem is not null").select(*key, "problem")


def validate_library(molecules: DataFrame, conformers: DataFrame) -> None:
    """Index and vectors agree, IDs occur once, and all vectors are equally wide."""
    bad = library_violations(molecules, conformers)
    reject_if_any(bad, ValueError, "the library is inconsistent", F.concat_ws(" ", "parent_id", "problem"))
    widths = conformers.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if widths["low"] != widths["high"]:
        raise ValueError(f"vector widths range from {widths['low']} to {widths['high']}")


def gather_ranges(vectors: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows ``row_start .. row_start + n_conf - 1`` of a positional vector table.

    ``vectors``: (row_id, embedding); ``ranges``: (target_id, parent_pos, parent_id,
    row_start, n_conf). Ranges may overlap and need not be ordered.
    """
    reject_if_any(ranges.where("n_conf < 1 or row_start < 0"), ValueError, "invalid ranges for", F.col("parent_id"))
    rows = ranges.select(
        "target_id", "parent_pos", "parent_id", "n_conf",
        F.posexplode(F.sequence(F.col("row_start"), F.col("row_start") + F.col("n_conf") - 1)).alias("pose_idx", "row_id"),
    )
    end = vectors.agg(F.max("row_id")).first()[0]
    outside = ranges.where(F.col("row_start") + F.col("n_conf") - 1 > F.lit(-1 if end is None else end))
    reject_if_any(outside, ValueError, "ranges outside the vector table for", F.col("parent_id"))
    return rows.join(vectors, "row_id").select(*CONFORMER_COLUMNS)


def write_pool(pool: DataFrame, path: str) -> None:
    need_columns(pool, ["embedding"], "an encoded reference pool")
    pool = with_counts(pool.withColumn("target_id", F.lit("")))
    smiles = F.col("canonical_smiles") if "canonical_smiles" in pool.columns else F.lit(None).cast("string")
    pool.select(
        F.col("parent_pos").cast("bigint").alias("parent_pos"), "parent_id",
        F.col("n_conf").cast("bigint").alias("n_conf"), F.col("pose_idx").cast("int").alias("pose_idx"),
        F.col("embedding").cast("array<float>").alias("embedding"), smiles.alias("canonical_smiles"),
    ).write.mode("errorifexists").parquet(str(path))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    pool = spark.read.schema(POOL).parquet(str(path))
    validate_pool(pool)
    return pool


def write_whitener(spark: SparkSession, matrix: np.ndarray, path: str) -> None:
    to_long(spark, matrix).write.mode("errorifexists").parquet(str(path))


def read_whitener(spark: SparkSession, path: str) -> np.ndarray:
    """Projection from our table (i, j, p) or from an ``.npz`` with ``projection``."""
    if str(path).endswith(".npz"):
        with np.load(path, allow_pickle=False) as stored:
            names = set(stored.files)
            matrix = np.asarray(stored["projection"], dtype=np.float32) if "projection" in names else None
    else:
        table = spark.read.parquet(str(path))
        names = set(table.columns)
        matrix = from_long(table, "p") if {"i", "j", "p"} <= names else None
    if matrix is None:
        raise KeyError(f"no projection in {path}")
    if "mean" in names:
        raise ValueError(f"{path} carries a fixed mean; only a projection is accepted")
    return np.asarray(matrix, dtype=np.float64)


def _open(uri: str):
    """Seekable input of any file system Arrow knows, for use inside tasks."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:/").lstrip("/")
    files, path = FileSystem.from_uri(uri)
    return files.open_input_file(path)


def _npy_header(stream) -> tuple[int, int, np.dtype]:
    form = np.lib.format
    version = form.read_magic(stream)
    read = form.read_array_header_1_0 if version == (1, 0) else form.read_array_header_2_0
    shape, by_column, dtype = read(stream)
    if len(shape) != 2 or by_column:
        raise ValueError("vector shards must be row-major matrices")
    return shape[0], shape[1], dtype


def read_npy_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings_*.npy`` shards as (row_id, embedding), numbered in name order.

    Executors read the shards piece by piece. A first pass reads only the headers;
    the driver sees one line per shard.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "embeddings_*.npy").load(str(folder)).select("path")

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for path in pdf["path"]:
                with _open(path) as stream:
                    made.append((path, *_npy_header(stream)[:2]))
            yield pd.DataFrame(made, columns=["path", "rows", "width"])

    shards = files.mapInPandas(shapes, "path string, rows bigint, width int").toPandas().sort_values("path")
    if shards.empty:
        raise FileNotFoundError(f"no embeddings_*.npy under {folder}")
    if shards["width"].nunique() != 1:
        raise ValueError(f"vector widths differ between shards: {sorted(set(shards['width']))}")
    first = shards["rows"].cumsum() - shards["rows"]
    starts = spark.sparkContext.broadcast(dict(zip(shards["path"], first.astype(int))))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with _open(path) as stream:
                    count, width, dtype = _npy_header(stream)
                    for at in range(0, count, IMPORT_ROWS):
                        size = min(IMPORT_ROWS, count - at)
                        part = np.frombuffer(stream.read(size * width * dtype.itemsize), dtype).reshape(size, width)
                        yield pd.DataFrame(
                            {
                                "row_id": starts.value[path] + at + np.arange(size),
                                "embedding": list(part.astype(np.float32)),
                            }
                        )

    return files.mapInPandas(rows, "row_id bigint, embedding array<float>")


def read_npz_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """``index.npz`` as ranges (see ``gather_ranges``) and labels, if it has them.

    The file is one archive, so one executor task unpacks it and streams rows out.
    """
    files = spark.read.format("binaryFile").load(str(path)).select("path")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                with np.load(_open(name), allow_pickle=False) as stored:
                    names = stored["target_ids"].astype(str)
                    offsets, ids = stored["parent_offsets"].astype(np.int64), stored["parent_ids"].astype(str)
                    starts, counts = stored["parent_starts"], stored["parent_counts"]
                    labels = stored["parent_labels"] if "parent_labels" in stored.files else None
                sound = len(offsets) == len(names) + 1 and offsets[0] == 0 and offsets[-1] == len(ids)
                if not sound or not len(ids) == len(starts) == len(counts):
                    raise ValueError("index arrays do not fit together")
                if len(set(names)) != len(names):
                    raise ValueError("index repeats a target")
                if labels is not None and len(labels) != len(ids):
                    raise ValueError("index labels do not fit the molecules")
                for name, begin, end in zip(names, offsets[:-1], offsets[1:]):
                    for at in range(begin, end, IMPORT_ROWS):
                        cut = slice(at, min(at + IMPORT_ROWS, end))
                        yield pd.DataFrame(
                            {
                                "target_id": name, "parent_pos": np.arange(cut.start, cut.stop) - begin,
                                "parent_id": ids[cut], "row_start": starts[cut].astype(np.int64),
                                "n_conf": counts[cut].astype(np.int64),
                                "label": pd.array([None] * (cut.stop - cut.start) if labels is None else labels[cut].astype(int), dtype="Int32"),
                            }
                        )

    rows = files.mapInPandas(
        unpack, "target_id string, parent_pos bigint, parent_id string, row_start bigint, n_conf bigint, label int"
    )
    labelled = rows.where("label is not null").select("target_id", "parent_id", "label")
    return rows.drop("label"), (None if labelled.isEmpty() else labelled)


def import_npz_cache(spark: SparkSession, source: str, output: str) -> None:
    """Convert an index-and-shards folder into a Parquet cache."""
    ranges, labels = read_npz_index(spark, f"{source}/index.npz")
    vectors = read_npy_vectors(spark, f"{source}/embeddings")
    write_cache(gather_ranges(vectors, ranges), output, labels)


def import_npz_pool(spark: SparkSession, source: str) -> DataFrame:
    """A saved reference pool archive as pool rows; pools are small."""
    with np.load(Path(source), allow_pickle=False) as stored:
        ids, counts = stored["parent_ids"].astype(str), stored["parent_counts"].astype(np.int64)
        raw, smiles = stored["raw_embeddings"].astype(np.float32), stored["canonical_smiles"].astype(str)
    if len(ids) != len(counts) or (counts < 1).any() or counts.sum() != len(raw):
        raise ValueError("pool counts do not fit the vectors")
    owner = np.repeat(np.arange(len(ids)), counts)
    first = np.cumsum(counts) - counts
    rows = pa.table(
        {
            "parent_pos": owner, "parent_id": ids[owner].tolist(), "n_conf": counts[owner],
            "pose_idx": (np.arange(len(owner)) - first[owner]).astype(np.int32), "embedding": to_lists(raw),
            "canonical_smiles": pa.array(smiles[owner].tolist() if len(smiles) else [None] * len(owner), pa.string()),
        }
    )
    pool = spark.createDataFrame(rows)
    validate_pool(pool)
    return pool
