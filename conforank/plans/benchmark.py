"""Retrospective evaluation of episodes against labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, splits
from ..operators.ranking import rank_rows
from ..operators.references import check_references
from ..schema import EPISODE_KEY, Params, reject_if_any
from ..sources import cache as store
from ..sources import tables
from ..sources.sinks import stamped, write_benchmark
from ..storage import pin, write_table
from .scoring import score_episode_libraries, score_library

# Split protocols of each benchmark and their folders.
BENCHMARK_SPLITS = {
    "truedecoy": ("molecule-random", "series-disjoint"),
    "randomdecoy": ("molecule-random", "series-disjoint"),
    "litpcba": ("molecule-random", "ave"),
}
SPLIT_FOLDERS = {"molecule-random": "random", "series-disjoint": "series_disjoint", "ave": "ave"}
MAX_K = 10


def score_episodes(
    conformers: DataFrame, refs: DataFrame, members: DataFrame, split: str,
    params: Params, projection: np.ndarray | None,
) -> DataFrame:
    """Scores of all episodes. Random splits see whole targets and share their graph;
    the others give each episode its own, newly centred library."""
    if split == "molecule-random":
        return score_library(conformers, refs, params, projection)
    return score_episode_libraries(conformers, refs, members, params, projection)


def check_ranked(scores: DataFrame, members: DataFrame) -> None:
    """The rows that are returned are exactly the molecules to rank, once each."""
    keys = [*EPISODE_KEY, "parent_id"]
    ranked = members.where("ranked").select(*keys, F.lit(1).alias("wanted"))
    both = ranked.join(scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("made")), keys, "full")
    reject_if_any(
        both.where("wanted is null or made is null or made <> 1"), RuntimeError,
        "scored molecules differ from the split", F.concat_ws("/", *[F.col(c).cast("string") for c in keys]),
    )


def evaluate(
    conformers: DataFrame, molecules: DataFrame, labels: DataFrame, episodes: DataFrame, split: str,
    params: Params, projection: np.ndarray | None,
    series: DataFrame | None = None, candidates: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked scores with labels, and one summary row per episode.

    ``episodes`` as read by ``read_episodes``. Labels meet the scores only after ranking;
    a molecule of these targets without exactly one label is an error.
    """
    seen = episodes.select("target_id").distinct()
    store.validate_labels(molecules.join(seen, "target_id", "left_semi"), labels)
    refs = tables.episode_references(episodes)
    check_references(refs, molecules)
    members = splits.episode_members(molecules, refs, split, series, candidates)
    if split != "molecule-random":
        members = write_table(members, "members")
    counts, _ = pin(splits.member_counts(members, labels, split), 128, "member-counts")
    splits.reconcile(counts, episodes)
    scores = score_episodes(conformers, refs, members, split, params, projection)
    labelled = scores.join(labels.select("target_id", "parent_id", "label"), ["target_id", "parent_id"], "left")
    largest = counts.agg(F.max("candidate_count")).first()[0]
    ranked = write_table(rank_rows(labelled, EPISODE_KEY, largest_group=largest), "ranked")
    check_ranked(ranked, members)
    measured = metrics.screening_metrics(ranked, EPISODE_KEY)
    summary = (
        episodes.select(*EPISODE_KEY, "support_parent_ids", F.size("support_parent_ids").alias("support_count"))
        .join(counts, EPISODE_KEY)
        .join(measured, EPISODE_KEY)
    )
    return ranked, pin(summary, 4096, "summary")[0]


def run_benchmark(
    spark: SparkSession, data_root: str, benchmark: str, split: str, ks: list[int], params: Params,
    output: str, seed: int = 0, targets: list[str] | None = None, cache: str = "cache", whitener: str = "whitener",
) -> dict:
    """Evaluate saved episodes of a benchmark folder and write scores and summary."""
    if split not in BENCHMARK_SPLITS[benchmark]:
        raise ValueError(f"{benchmark} has the splits {', '.join(BENCHMARK_SPLITS[benchmark])}")
    if not ks or len(set(ks)) != len(ks) or not all(1 <= k <= MAX_K for k in ks):
        raise ValueError(f"K values must be distinct and between 1 and {MAX_K}")
    root = f"{data_root}/{benchmark}"
    folder = f"{root}/splits/{SPLIT_FOLDERS[split]}"
    episodes = tables.read_episodes(spark, f"{folder}/episodes.csv", seed, ks)
    episodes = write_table(splits.restrict_targets(episodes, targets), "episodes")
    wanted = episodes.select("target_id").distinct()
    path = stamped(output)
    series = candidates = None
    if split == "series-disjoint":
        series = splits.latest_series(tables.read_series(spark, f"{folder}/series_assignments.csv"))
        series = write_table(series.join(wanted, "target_id", "left_semi"), "series")
    if split == "ave":
        names = [r[0] for r in wanted.collect()]
        candidates = write_table(tables.read_candidates(spark, f"{folder}/official_ave", names), "candidates")
    conformers, molecules, labels = (
        part.join(wanted, "target_id", "left_semi")
        for part in (
            store.read_conformers(spark, f"{root}/{cache}"),
            store.read_molecules(spark, f"{root}/{cache}"),
            store.read_labels(spark, f"{root}/{cache}"),
        )
    )
    store.validate_library(molecules, conformers)
    projection = store.read_whitener(spark, f"{root}/{whitener}")
    scores, summary = evaluate(
        conformers, molecules, labels, episodes, split, params, projection, series, candidates
    )
    table = summary.select(
        F.lit(benchmark).alias("benchmark"), F.lit(split).alias("split"), "target_id", "seed",
        F.col("k").alias("K"), "support_parent_ids", "support_count", "visible_count", "candidate_count",
        "positive_count", "negative_count", "excluded_count", *[F.col(f"`{m}`") for m in metrics.METRICS],
    )
    write_benchmark(scores, table, path)
    report(summary, seed)
    return {"targets": wanted.count(), "scores": scores.count(), "output": path}


def report(summary: DataFrame, seed: int) -> None:
    """One JSON line for each episode, then one for each K with the means over its targets."""
    for line in summary.orderBy("target_id", "k").toJSON().toLocalIterator():
        print(line, flush=True)
    means = metrics.macro_summary(summary, ["k"]).withColumn("seed", F.lit(seed))
    for line in means.orderBy("k", "metric").toJSON().toLocalIterator():
        print(line, flush=True)
