"""Result files."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import score_order


def write_ranking(scores: DataFrame, path: str) -> None:
    """Ranking as CSV part files in descending score; reading them in name order
    gives the ranking, and no single task holds it."""
    scores.orderBy(*score_order()).select(
        F.col("parent_id").alias("parent_molecule_id"), "score", "similarity", "direct", "graph"
    ).write.mode("errorifexists").csv(str(path), header=True)


def stamped(path: str) -> str:
    """Output folder name with the UTC time of the run."""
    now = datetime.now(timezone.utc)
    return f"{str(path).rstrip('/')}-{now:%Y%m%d-%H%M%S-%f}Z"


def write_benchmark(scores: DataFrame, summary: DataFrame, path: str) -> None:
    """``scores`` and ``summary`` below ``path``, one folder per target and seed."""
    keys = ["target_id", "seed"]
    ranked = scores.select(
        *keys, F.col("k").alias("K"), F.col("parent_id").alias("id"), "score", "rank", "label",
        "similarity", "direct", "graph",
    )
    ranked.repartitionByRange("target_id", "seed", "K", "rank").sortWithinPartitions(
        "target_id", "seed", "K", "rank"
    ).write.mode("errorifexists").partitionBy(*keys).csv(f"{path}/scores", header=True)
    names = [f"`{c}`" for c in summary.columns if c not in keys]
    flat = summary.withColumn("support_parent_ids", F.to_json("support_parent_ids"))
    flat.select(*keys, *names).sortWithinPartitions("target_id", "K").write.mode("errorifexists").partitionBy(
        *keys
    ).csv(f"{path}/summary", header=True, quote='"', escape='"')
