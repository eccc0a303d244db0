"""Molecule means, balanced means and molecule centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, vector_mean

MOLECULE = ["target_id", "parent_pos"]


def with_counts(conformers: DataFrame) -> DataFrame:
    """Add ``n_conf``; only the keys are aggregated, vectors move once in the join."""
    if "n_conf" in conformers.columns:
        return conformers
    counts = conformers.groupBy(*MOLECULE).agg(F.count(F.lit(1)).alias("n_conf"))
    return conformers.join(counts, MOLECULE)


def molecule_means(conformers: DataFrame) -> DataFrame:
    """One mean vector per molecule: (target_id, parent_pos, parent_id, n_conf, mean)."""
    return conformers.groupBy(*MOLECULE).agg(
        F.first("parent_id").alias("parent_id"),
        F.count(F.lit(1)).alias("n_conf"),
        vector_mean("embedding").alias("mean"),
    )


def balanced_means(conformers: DataFrame) -> DataFrame:
    """Per target, the mean with equal weight on every molecule.

    With ``n_conf`` on each row the mean of molecule means is a weighted row mean,
    so no vector is shuffled by molecule: each task sends one partial per target.
    """
    if "n_conf" in conformers.columns:
        return conformers.groupBy("target_id").agg(
            vector_mean("embedding", F.lit(1.0) / F.col("n_conf")).alias("mean")
        )
    return molecule_means(conformers).groupBy("target_id").agg(vector_mean("mean").alias("mean"))


def molecule_centers(conformers: DataFrame) -> DataFrame:
    """Unit-length molecule means of already whitened rows."""
    return molecule_means(conformers).withColumn("center", l2_normalize(F.col("mean"))).drop("mean")
