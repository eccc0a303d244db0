"""Ranking a library from a few known positives."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import zscore
from ..operators.episodes import episode_features
from ..operators.graph import LANES, build_graph, propagate
from ..operators.references import check_references
from ..operators.similarity import (
    FILTER_IDS,
    build_contexts,
    centers_from_features,
    features_beyond_broadcast,
    molecule_features,
    pooled_from_features,
)
from ..operators.splits import episode_libraries, library_name
from ..schema import CONFORMER_COLUMNS, EPISODE_KEY, Params, need_columns, reject_if_any
from ..storage import BROADCAST_BYTES, attach, pin, write_table

MOLECULE_IN_EPISODE = [*EPISODE_KEY, "parent_pos"]


def score_library(
    conformers: DataFrame,
    refs: DataFrame,
    params: Params,
    projection: np.ndarray | None = None,
    side: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Score every non-reference molecule, for all targets and episodes together.

    ``conformers``: (target_id, parent_pos, parent_id, pose_idx, embedding[, n_conf])
    with raw vectors; ``refs``: (target_id, seed, k, parent_id). Returns
    (target_id, seed, k, parent_pos, parent_id, score, similarity, direct, graph).
    Episodes of one target share its means, centres and graph.
    """
    need_columns(conformers, [c for c in CONFORMER_COLUMNS if c != "n_conf"], "library")
    refs = refs.select(
        "target_id", F.col("seed").cast("int").alias("seed"), F.col("k").cast("int").alias("k"), "parent_id"
    )
    refs, fits = pin(refs, 128, "references")
    library = _referenced_targets(conformers, refs, fits)
    library = library.withColumn("parent_pos", F.col("parent_pos").cast("bigint"))
    check_references(refs, library)

    contexts = build_contexts(
        library, refs, projection, params.max_reference_conformers,
        params.support_similarity_topk, broadcast_bytes,
    )
    if contexts is None:
        centers, pooled = features_beyond_broadcast(
            library, refs, projection, params.max_reference_conformers, params.support_similarity_topk
        )
    else:
        features = write_table(molecule_features(library, contexts, projection), "features")
        centers, pooled = centers_from_features(features), pooled_from_features(features)
    return _scores(centers, pooled, refs, params, side)


def score_episode_libraries(
    conformers: DataFrame,
    refs: DataFrame,
    members: DataFrame,
    params: Params,
    projection: np.ndarray | None = None,
    side: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``score_library`` where each episode sees only its visible ``members``, re-centred on them.

    The vectors are read as they lie, by all episodes together; only references too large to
    broadcast make a library of its own for each episode.
    """
    refs = refs.select(
        "target_id", F.col("seed").cast("int").alias("seed"), F.col("k").cast("int").alias("k"), "parent_id"
    )
    refs, fits = pin(refs, 128, "references")
    library = _referenced_targets(conformers, refs, fits)
    library = library.withColumn("parent_pos", F.col("parent_pos").cast("bigint"))
    features = episode_features(
        library, refs, members, projection, params.max_reference_conformers,
        params.support_similarity_topk, broadcast_bytes,
    )
    named = refs.withColumn("target_id", library_name())
    if features is None:
        scores = score_library(episode_libraries(library, members), named, params, projection, side, broadcast_bytes)
    else:
        features = write_table(features, "features")
        scores = _scores(centers_from_features(features), pooled_from_features(features), named, params, side)
    return scores.withColumn("target_id", F.regexp_replace("target_id", "#[^#]*#[^#]*$", ""))


def _scores(centers: DataFrame, pooled: DataFrame, refs: DataFrame, params: Params, side: int | None) -> DataFrame:
    """Scores from molecule centres and pooled pose similarities."""
    centers = write_table(centers, "centers")
    walk = graph_scores(centers, refs, params, side)
    queries = pooled.join(refs, [*EPISODE_KEY, "parent_id"], "left_anti")
    queries = queries.join(walk, MOLECULE_IN_EPISODE, "left").fillna(0.0, ["walk"])
    queries = write_table(queries, "queries")
    moments, fits = episode_moments(queries, params)
    empty = refs.select(*EPISODE_KEY).distinct().join(moments, EPISODE_KEY, "left_anti")
    reject_if_any(
        empty, ValueError, "no molecules left after removing the references", F.concat_ws("/", *EPISODE_KEY)
    )
    return fuse(queries, moments, fits, params)


def _referenced_targets(conformers: DataFrame, refs: DataFrame, fits: bool) -> DataFrame:
    """Rows of targets with references; a short list becomes a filter that prunes folders."""
    if fits:
        names = pc.unique(refs.select("target_id").toArrow().column(0)).to_pylist()
        if len(names) <= FILTER_IDS:
            return conformers.where(F.col("target_id").isin(names))
    wanted, fits = pin(refs.select("target_id").distinct(), 64, "scored-targets")
    return attach(conformers, wanted, ["target_id"], fits, ["parent_pos", "pose_idx"])


def graph_scores(centers: DataFrame, refs: DataFrame, params: Params, side: int | None = None) -> DataFrame:
    """Random walk states (target_id, seed, k, parent_pos, walk); absent ones are 0."""
    graph = build_graph(
        centers, params.graph_neighbors, params.graph_temperature, params.graph_indegree_exponent, side
    )
    # A target has few episodes, so numbering them per target is a bounded window.
    numbered = refs.groupBy(*EPISODE_KEY).agg(F.count(F.lit(1)).alias("size"))
    slot = F.row_number().over(Window.partitionBy("target_id").orderBy("seed", "k")) - 1
    episodes, fits = pin(numbered.withColumn("slot", slot), 128, "episode-slots")
    slots = int(episodes.agg(F.max("slot")).first()[0]) + 1
    # Slots go to lanes of a row, and to further rows of a node beyond LANES.
    columns = [f"s{n}" for n in range(min(slots, LANES))]
    part = "part" if slots > LANES else None
    placed = (
        refs.join(episodes, EPISODE_KEY)
        .join(centers.select("target_id", "parent_id", "parent_pos"), ["target_id", "parent_id"])
        .select(
            "target_id", F.col("parent_pos").alias("pos"), "size",
            F.expr(f"slot div {LANES}").cast("int").alias("part"), (F.col("slot") % LANES).alias("lane"),
        )
    )
    seeds = placed.groupBy("target_id", "pos", "part").agg(
        *[
            F.sum(F.when(F.col("lane") == n, F.lit(1.0) / F.col("size")).otherwise(0.0)).alias(c)
            for n, c in enumerate(columns)
        ]
    )
    seeds, _ = pin(seeds, 64 + 8 * len(columns), "seeds")
    state = propagate(
        graph, seeds, columns, params.graph_restart_probability, params.graph_propagation_steps, part
    )
    row = F.col("part") if part else F.lit(0)
    long = state.select(
        "target_id", F.col("pos").alias("parent_pos"), row.alias("part"), F.posexplode(F.array(*columns)).alias("lane", "walk")
    ).withColumn("slot", F.col("part") * LANES + F.col("lane"))
    keyed = episodes.select(*EPISODE_KEY, "slot")
    if fits:
        keyed = F.broadcast(keyed)
    return long.join(keyed, ["target_id", "slot"]).select(*MOLECULE_IN_EPISODE, "walk")


def episode_moments(queries: DataFrame, params: Params) -> tuple[DataFrame, bool]:
    """All means and deviations of an episode from one aggregate, pinned.

    The pose z-score is linear and monotone in the pose similarity, so the moments
    of its maximum per molecule follow from those of ``hi`` (``lo`` for a negative
    weight).
    """
    extreme = "hi" if params.similarity_weight >= 0 else "lo"
    stats = queries.groupBy(*EPISODE_KEY).agg(
        F.sum("n").alias("poses"),
        F.sum("s").alias("total"),
        F.sum("ss").alias("squares"),
        F.avg(extreme).alias("extreme_mean"),
        F.stddev_samp(extreme).alias("extreme_std"),
        F.avg("walk").alias("walk_mean"),
        F.stddev_samp("walk").alias("walk_std"),
    )
    mean = F.col("total") / F.col("poses")
    spread = F.greatest(F.col("squares") - F.col("total") * mean, F.lit(0.0))
    pose_std = F.when(F.col("poses") > 1, F.sqrt(spread / (F.greatest(F.col("poses"), F.lit(2)) - 1)))
    return pin(stats.withColumns({"pose_mean": mean, "pose_std": pose_std}), 256, "episode-moments")


def fuse(queries: DataFrame, moments: DataFrame, fits: bool, params: Params) -> DataFrame:
    """z-scores over poses, molecules and walk states, and their weighted sum.

    ``queries``: one row per episode and non-reference molecule with pose count
    ``n``, pose similarity ``hi``/``lo``/``s``/``ss`` and ``walk``.
    """
    weight = params.similarity_weight
    extreme = "hi" if weight >= 0 else "lo"
    rows = attach(queries, moments, EPISODE_KEY, fits, ["parent_pos"])

    def pooled(x: str):
        return F.lit(weight) * zscore(F.col(x), F.col("pose_mean"), F.col("pose_std"))

    pooled_std = F.lit(abs(weight)) * zscore(F.col("extreme_std"), F.lit(0.0), F.col("pose_std"))
    direct = zscore(pooled(extreme), pooled("extreme_mean"), pooled_std)
    graph = zscore(F.col("walk"), F.col("walk_mean"), F.col("walk_std"))
    return rows.withColumns({"direct": direct, "graph": graph}).select(
        *MOLECULE_IN_EPISODE, "parent_id",
        (F.col("direct") + F.lit(params.graph_weight) * F.col("graph")).alias("score"),
        F.col("hi").alias("similarity"), "direct", "graph",
    )
