"""Fitting and applying the covariance whitener."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import to_lists, to_matrix, unit_rows
from ..functions.vectors import l2_normalize, doubles, vector_mean, vector_sum
from ..storage import attach, pin, write_table
from .means import balanced_means, molecule_means

# The projection and everything of its shape is held on the driver and broadcast.
MATRIX_BYTES = 1 << 30
# Targets whose moment matrices one task keeps before emitting them.
OPEN_TARGETS = 16


def check_width(width: int) -> int:
    if 8 * width * width > MATRIX_BYTES:
        raise ValueError(f"a {width} x {width} matrix takes more than the {MATRIX_BYTES} bytes the driver may hold (MATRIX_BYTES)")
    return width


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum ``weight * x x^T`` per group inside a task, one output row per matrix row."""
    open_sums: dict[str, np.ndarray] = {}

    def emit(group: str) -> pa.RecordBatch:
        total = open_sums.pop(group)
        width = len(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([group] * width), pa.array(np.arange(width, dtype=np.int32)), to_lists(total)],
            names=["grp", "i", "row"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        x = to_matrix(batch.column("x"))
        weight = batch.column("weight").to_numpy(zero_copy_only=False)
        groups = batch.column("grp").dictionary_encode()
        codes = groups.indices.to_numpy()
        for code, group in enumerate(groups.dictionary.to_pylist()):
            part = x[codes == code]
            moment = (part * weight[codes == code, None]).T @ part
            if group in open_sums:
                open_sums[group] += moment
            else:
                if len(open_sums) >= OPEN_TARGETS:
                    yield emit(next(iter(open_sums)))
                open_sums[group] = moment
    for group in list(open_sums):
        yield emit(group)


def weighted_moments(rows: DataFrame) -> DataFrame:
    """``sum(weight * x x^T)`` per ``grp`` as (grp, i, row array<double>).

    Tasks send d rows of length d each, merged by (grp, i), so neither the merge
    nor the traffic depends on how the vectors are spread over groups.
    """
    partial = rows.select("grp", "weight", "x").mapInArrow(
        _moment_rows, "grp string, i int, row array<double>"
    )
    return partial.groupBy("grp", "i").agg(vector_sum("row").alias("row"))


def _centered_means(conformers: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Molecule means minus their target's mean, and the size of each target."""
    means = write_table(molecule_means(conformers), "molecule-means")
    width = check_width(vector_width(means, "mean"))
    stats, fits = pin(
        means.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), vector_mean("mean").alias("m")),
        8 * width + 128, "target-means",
    )
    rows = attach(means.select("target_id", "parent_pos", "mean"), stats, ["target_id"], fits, ["parent_pos"])
    centered = F.zip_with("mean", "m", lambda x, m: x - m)
    return rows.select("target_id", "parent_pos", "n", centered.alias("x")), stats.select("target_id", "n"), width


def covariance_by_target(conformers: DataFrame) -> DataFrame:
    """Population covariance of molecule means: (target_id, i, j, c)."""
    rows, _, _ = _centered_means(conformers)
    # Range order keeps a task on few targets; a hot target still covers many tasks.
    ordered = rows.repartitionByRange("target_id", "parent_pos")
    moments = weighted_moments(
        ordered.select(F.col("target_id").alias("grp"), (F.lit(1.0) / F.col("n")).alias("weight"), "x")
    )
    return moments.select(F.col("grp").alias("target_id"), "i", F.posexplode("row").alias("j", "c"))


def macro_covariance(conformers: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Unweighted average of the target covariances: (i, j, c), d x d rows.

    A molecule of a target with n of them has weight 1/(T n), which makes the average
    over T targets a single moment sum; no d x d matrix per target is formed.
    """
    rows, sizes, width = _centered_means(conformers)
    info = sizes.agg(
        F.count(F.lit(1)).alias("targets"), F.sum("n").alias("molecules"), F.min("n").alias("least")
    ).first()
    if info["molecules"] <= width:
        raise ValueError(
            f"fitting {width} dimensions needs more than {width} molecules, found {info['molecules']}"
        )
    if info["least"] < 2:
        raise ValueError("every target needs two molecules or more")
    weight = F.lit(1.0 / info["targets"]) / F.col("n")
    moments = weighted_moments(rows.select(F.lit("").alias("grp"), weight.alias("weight"), "x"))
    cov = write_table(moments.select("i", F.posexplode("row").alias("j", "c")), "macro-covariance")
    return cov, {"targets": info["targets"], "molecules": info["molecules"], "dimension": width}


def shrink(cov: DataFrame, shrinkage: float) -> DataFrame:
    """Blend with the scaled identity of equal trace."""
    if not 0.0 <= shrinkage <= 1.0:
        raise ValueError("shrinkage must lie in [0, 1]")
    variance = cov.where("i = j").agg(F.avg("c")).first()[0]
    if variance is None or variance <= 0.0:
        raise ValueError("the embeddings do not vary")
    identity = F.when(F.col("i") == F.col("j"), F.lit(shrinkage * variance)).otherwise(F.lit(0.0))
    return cov.select("i", "j", (F.lit(1.0 - shrinkage) * F.col("c") + identity).alias("c"))


def inverse_root(cov: np.ndarray, eps: float) -> np.ndarray:
    """Symmetric inverse square root of ``cov`` with ``eps`` added to its spectrum."""
    if eps <= 0.0:
        raise ValueError("eps must be positive")
    values, basis = np.linalg.eigh((cov + cov.T) / 2.0)
    return basis @ np.diag(1.0 / np.sqrt(np.clip(values, 0.0, None) + eps)) @ basis.T


def fit_whitener(conformers: DataFrame, shrinkage: float = 0.01, eps: float = 1e-5):
    """Fit the projection. Returns ``(matrix float32[d,d], info)``; no mean is kept."""
    if not 0.0 <= shrinkage <= 1.0:
        raise ValueError("shrinkage must lie in [0, 1]")
    if eps <= 0.0:
        raise ValueError("eps must be positive")
    cov, info = macro_covariance(conformers)
    return projection_from(cov, shrinkage, eps), info


def projection_from(cov: DataFrame, shrinkage: float, eps: float) -> np.ndarray:
    return inverse_root(from_long(shrink(cov, shrinkage), "c"), eps).astype(np.float32)


def from_long(table: DataFrame, value: str) -> np.ndarray:
    """Collect a d x d table (i, j, value); its size is bounded by MATRIX_BYTES."""
    rows = table.select("i", "j", value).toArrow()
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    width = check_width(int(max(i.max(), j.max())) + 1) if rows.num_rows else 0
    if rows.num_rows != width * width:
        raise ValueError("matrix table is not square and complete")
    out = np.empty((width, width))
    out[i, j] = rows.column(value).to_numpy()
    return out


def to_long(spark: SparkSession, matrix: np.ndarray, value: str = "p") -> DataFrame:
    width = len(matrix)
    grid = np.indices(matrix.shape, dtype=np.int32).reshape(2, width * width)
    table = pa.table({"i": grid[0], "j": grid[1], value: np.asarray(matrix, dtype=np.float64).ravel()})
    return spark.createDataFrame(table)


def vector_width(df: DataFrame, column: str) -> int:
    row = df.select(F.size(column)).first()
    if row is None:
        raise ValueError("the library is empty")
    return int(row[0])


def whiten(conformers: DataFrame, projection: np.ndarray | None) -> DataFrame:
    """Replace ``embedding`` by ``normalize((raw - target mean) @ projection)``.

    Without a projection rows are only brought to unit length.
    """
    if projection is None:
        return conformers.withColumn("embedding", l2_normalize(doubles("embedding")))
    matrix = np.asarray(projection, dtype=np.float64)
    means, fits = pin(balanced_means(conformers), 8 * len(matrix) + 64, "balanced-means")
    shared = conformers.sparkSession.sparkContext.broadcast(matrix)
    rows = attach(conformers, means, ["target_id"], fits, ["parent_pos", "pose_idx"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = to_matrix(batch.column("embedding"))
            if raw.shape[1] != len(p):
                raise ValueError("projection and embedding widths differ")
            white = unit_rows((raw - to_matrix(batch.column("mean"))) @ p)
            names = [n for n in batch.schema.names if n not in ("embedding", "mean")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [to_lists(white)], names=names + ["embedding"]
            )

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in conformers.schema if f.name != "embedding"]
    ordered = [c for c in rows.columns if c not in ("embedding", "mean")] + ["embedding", "mean"]
    by_name = {f.split(" ", 1)[0]: f for f in kept}
    schema = ", ".join([by_name[c] for c in ordered[:-2]] + ["embedding array<double>"])
    return rows.select(*ordered).mapInArrow(apply, schema).select(*conformers.columns)
