"""Library, label, series and reference tables derived from the test tables.

Every vector of ``embeddings`` is used. Fifteen consecutive vectors form five
molecules with one to five conformers; molecules alternate between two targets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import sample_labeled_all
from ..schema import Params

KS = [1, 2, 3]
# References with several conformers reach the conformer limit.
PARAMS = Params(
    graph_neighbors=20,
    graph_temperature=0.22650207299094172,
    graph_indegree_exponent=0.09668681093234655,
    graph_restart_probability=0.15899843191942972,
    graph_propagation_steps=9,
    graph_weight=2.233284812475988,
    max_reference_conformers=3,
    support_similarity_topk=4,
)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    r = F.col("vec_id") % 15
    member = F.when(r < 1, 0).when(r < 3, 1).when(r < 6, 2).when(r < 10, 3).otherwise(4)
    start = F.when(r < 1, 0).when(r < 3, 1).when(r < 6, 3).when(r < 10, 6).otherwise(10)
    pos = F.floor(F.col("vec_id") / 15) * 5 + member
    return v.select(
        F.format_string("T%d", pos % 2).alias("target_id"),
        pos.cast("bigint").alias("parent_pos"),
        F.format_string("mol_%06d", pos).alias("parent_id"),
        (r - start).cast("int").alias("pose_idx"),
        "embedding",
        "label",
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).drop("label")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).groupBy("target_id", "parent_pos", "parent_id").agg(
        F.count(F.lit(1)).alias("n_conf")
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active: the first conformer carries label 0."""
    return poses(spark, sf_dir).where("pose_idx = 0").select(
        "target_id", "parent_pos", "parent_id", (F.col("label") == 0).cast("int").alias("label")
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by the label of the last conformer; 9 means none unless it is active."""
    rows = poses(spark, sf_dir).groupBy("target_id", "parent_id").agg(
        F.max_by("label", "pose_idx").alias("last"), F.min_by("label", "pose_idx").alias("first")
    )
    return rows.where("last <> 9 or first = 0").select(
        "target_id", "parent_id", F.format_string("s%d", "last").alias("series_id")
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_labeled_all(labels(spark, sf_dir), KS)


def projection(width: int = 64) -> np.ndarray:
    """Fixed full-rank matrix given by a rule both engines can evaluate."""
    i, j = np.indices((width, width))
    return np.where(i == j, 1.0, 0.0) + 0.25 / (1.0 + i + 2.0 * j)
