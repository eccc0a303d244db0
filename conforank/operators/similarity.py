"""Similarity of library conformers to reference conformers, and molecule features."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import to_lists, to_matrix, unit_rows
from ..functions.vectors import l2_normalize, vector_sum
from ..schema import EPISODE_KEY
from ..storage import BROADCAST_BYTES, attach, pin, write_table
from .means import balanced_means, molecule_centers
from .topk import topk_between
from .whitening import vector_width, whiten

# Number of distinct reference IDs written into the scan filter, where the file
# statistics can skip row groups; longer lists rely on the join alone.
FILTER_IDS = 1000

EPISODE_STATS = "array<struct<seed:int,k:int,hi:double,lo:double,s:double,ss:double>>"
FEATURES = f"target_id string, parent_pos bigint, parent_id string, n bigint, vec array<double>, ep {EPISODE_STATS}"


class Context(NamedTuple):
    """What a task needs to know about one target; sent as a plain tuple."""

    mean: np.ndarray | None
    support: np.ndarray
    episodes: list[tuple[int, int, np.ndarray, int]]


def _plain(contexts: dict[str, Context]) -> dict[str, tuple]:
    return {target: tuple(context) for target, context in contexts.items()}


def mean_topk(sims: np.ndarray, k: int) -> np.ndarray:
    """Row-wise mean of the ``k`` largest entries."""
    take = min(k, sims.shape[1])
    if take < sims.shape[1]:
        sims = np.partition(sims, sims.shape[1] - take, axis=1)[:, -take:]
    return sims.mean(axis=1)


def reference_rows(
    conformers: DataFrame, refs: DataFrame, max_conformers: int, ids: set[str] | None = None
) -> DataFrame:
    """First ``max_conformers`` rows of every distinct reference, with raw vectors.

    ``ids``: the distinct reference IDs where the caller has them.
    """
    wanted = refs.select("target_id", "parent_id").distinct()
    scan = conformers.where(F.col("pose_idx") < max_conformers)
    if ids is not None and len(ids) <= FILTER_IDS:
        scan = scan.where(F.col("parent_id").isin(sorted(ids)))
    return scan.join(wanted, ["target_id", "parent_id"], "left_semi").select(
        "target_id", "parent_pos", "parent_id", "pose_idx", "embedding"
    )


def build_contexts(
    conformers: DataFrame, refs: DataFrame, projection: np.ndarray | None,
    max_conformers: int, topk: int, limit: int = BROADCAST_BYTES,
) -> dict[str, Context] | None:
    """Target means and whitened reference rows, or None if they exceed ``limit`` bytes."""
    width = vector_width(conformers, "embedding") if projection is None else len(projection)
    row_bytes = 8 * width + 128
    most = max(1, limit // 128)
    link = refs.select(*EPISODE_KEY, "parent_id").limit(most + 1).toPandas()
    if len(link) > most:
        return None
    own = reference_rows(conformers, refs, max_conformers, set(link["parent_id"]))
    support, fits = pin(own, row_bytes, "support", limit)
    if not fits:
        return None
    means: dict[str, np.ndarray] = {}
    if projection is not None:
        table, fits = pin(balanced_means(conformers), row_bytes, "balanced-means", limit)
        if not fits:
            return None
        rows = table.toArrow()
        if rows.num_rows:
            means = dict(zip(rows.column("target_id").to_pylist(), to_matrix(rows.column("mean"))))
    frame = support.orderBy("target_id", "parent_pos", "pose_idx").toArrow()
    if frame.num_rows == 0:
        return {}
    vectors = to_matrix(frame.column("embedding"))
    rows_of = pd.Series(frame.column("target_id").to_pylist()).groupby(frame.column("target_id").to_pylist()).indices
    parents = np.array(frame.column("parent_id").to_pylist(), dtype=object)
    contexts = {}
    for target, own in link.groupby("target_id"):
        at = rows_of[target]
        raw = vectors[at]
        mean = means.get(target)
        white = unit_rows(raw if projection is None else (raw - mean) @ projection)
        episodes = []
        for (seed, k), part in own.groupby(["seed", "k"]):
            cols = np.flatnonzero(np.isin(parents[at], part["parent_id"].to_numpy(dtype=object)))
            episodes.append((int(seed), int(k), cols, min(topk, len(cols))))
        contexts[target] = Context(mean, white, episodes)
    return contexts


def _runs(pos: np.ndarray) -> np.ndarray:
    """Start offsets of equal neighbouring values."""
    return np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])


def _molecule_partials(context: Context, raw: np.ndarray, pos: np.ndarray, projection: np.ndarray | None):
    return molecule_sums(context, unit_rows(raw if projection is None else (raw - context.mean) @ projection), pos)


def molecule_sums(context: Context, white: np.ndarray, pos: np.ndarray):
    """Per molecule of one batch of unit vectors: run starts, vector sums, counts, episode statistics."""
    starts = _runs(pos)
    sizes = np.diff(np.r_[starts, len(pos)])
    sims = white @ context.support.T
    columns = {name: [] for name in ("seed", "k", "hi", "lo", "s", "ss")}
    for seed, k, cols, take in context.episodes:
        pose = mean_topk(sims[:, cols], take)
        columns["seed"].append(np.full(len(starts), seed, dtype=np.int32))
        columns["k"].append(np.full(len(starts), k, dtype=np.int32))
        columns["hi"].append(np.maximum.reduceat(pose, starts))
        columns["lo"].append(np.minimum.reduceat(pose, starts))
        columns["s"].append(np.add.reduceat(pose, starts))
        columns["ss"].append(np.add.reduceat(pose * pose, starts))
    # Episodes run fastest, so the values of one molecule are adjacent.
    stacked = {name: np.stack(parts, axis=1).ravel() for name, parts in columns.items()}
    return starts, np.add.reduceat(white, starts, axis=0), sizes, stacked


def molecule_features(
    conformers: DataFrame, contexts: dict[str, Context], projection: np.ndarray | None
) -> DataFrame:
    """Whiten, compare and pre-aggregate each conformer in a single scan.

    Output has one row per molecule and Arrow batch: the sum of whitened vectors,
    and per episode the max, min, sum and sum of squares of the pose similarity.
    """
    shared = conformers.sparkSession.sparkContext.broadcast((_plain(contexts), projection))
    names = [f.name for f in T._parse_datatype_string(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = to_matrix(batch.column("embedding"))
            pos = batch.column("parent_pos").to_numpy(zero_copy_only=False)
            encoded = batch.column("target_id").dictionary_encode()
            codes = encoded.indices.to_numpy()
            for code, target in enumerate(encoded.dictionary.to_pylist()):
                if target not in known:
                    continue
                at = np.flatnonzero(codes == code)
                context = Context(*known[target])
                starts, sums, sizes, ep = _molecule_partials(context, raw[at], pos[at], matrix)
                count = len(context.episodes)
                offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * np.int32(count))
                structs = pa.StructArray.from_arrays([pa.array(v) for v in ep.values()], names=list(ep))
                first = at[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([target] * len(starts), pa.string()),
                        pa.array(pos[first].astype(np.int64)),
                        batch.column("parent_id").take(pa.array(first)),
                        pa.array(sizes.astype(np.int64)),
                        to_lists(sums),
                        pa.ListArray.from_arrays(offsets, structs),
                    ],
                    names=names,
                )

    rows = conformers.select("target_id", "parent_pos", "parent_id", "embedding")
    return rows.mapInArrow(run, FEATURES)


def centers_from_features(features: DataFrame) -> DataFrame:
    merged = features.groupBy("target_id", "parent_pos").agg(
        F.first("parent_id").alias("parent_id"), F.sum("n").alias("n_conf"), vector_sum("vec").alias("v")
    )
    mean = F.transform(F.col("v"), lambda x: x / F.col("n_conf"))
    return merged.select(
        "target_id", "parent_pos", "parent_id", "n_conf", l2_normalize(mean).alias("center")
    )


def pooled_from_features(features: DataFrame) -> DataFrame:
    """Per episode and molecule: pose count, max, min, sum, sum of squares."""
    flat = features.select("target_id", "parent_pos", "parent_id", "n", F.explode("ep").alias("e"))
    return flat.groupBy("target_id", "e.seed", "e.k", "parent_pos").agg(
        F.first("parent_id").alias("parent_id"),
        F.sum("n").alias("n"),
        F.max("e.hi").alias("hi"),
        F.min("e.lo").alias("lo"),
        F.sum("e.s").alias("s"),
        F.sum("e.ss").alias("ss"),
    )


def pool_poses(pose_scores: DataFrame) -> DataFrame:
    """The same table from one row per (episode, molecule, pose) with ``similarity``."""
    sim = F.col("similarity")
    return pose_scores.groupBy(*EPISODE_KEY, "parent_pos").agg(
        F.first("parent_id").alias("parent_id"),
        F.count(F.lit(1)).alias("n"),
        F.max(sim).alias("hi"),
        F.min(sim).alias("lo"),
        F.sum(sim).alias("s"),
        F.sum(sim * sim).alias("ss"),
    )


def pose_similarity(
    white: DataFrame, refs: DataFrame, max_conformers: int, topk: int, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Mean top-k similarity of every non-reference conformer, per episode.

    ``white`` holds unit vectors. References within ``limit`` bytes are broadcast;
    larger sets go through the blocked top-k join.
    """
    contexts = build_contexts(white, refs, None, max_conformers, topk, limit)
    if contexts is None:
        scored = _pose_similarity_blocked(white, refs, max_conformers, topk)
    else:
        scored = _pose_similarity_broadcast(white, contexts)
    return scored.join(
        refs.select(*EPISODE_KEY, "parent_id"), [*EPISODE_KEY, "parent_id"], "left_anti"
    )


def _pose_similarity_broadcast(white: DataFrame, contexts: dict[str, Context]) -> DataFrame:
    shared = white.sparkSession.sparkContext.broadcast(_plain(contexts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = to_matrix(batch.column("embedding"))
            encoded = batch.column("target_id").dictionary_encode()
            codes = encoded.indices.to_numpy()
            for code, target in enumerate(encoded.dictionary.to_pylist()):
                if target not in known:
                    continue
                at = np.flatnonzero(codes == code)
                context = Context(*known[target])
                sims = vectors[at] @ context.support.T
                base = pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(at)) for c in ("target_id", "parent_pos", "parent_id", "pose_idx")],
                    names=["target_id", "parent_pos", "parent_id", "pose_idx"],
                )
                for seed, k, cols, take in context.episodes:
                    yield pa.RecordBatch.from_arrays(
                        [
                            *base.columns,
                            pa.array(np.full(len(at), seed, dtype=np.int32)),
                            pa.array(np.full(len(at), k, dtype=np.int32)),
                            pa.array(mean_topk(sims[:, cols], take)),
                        ],
                        names=[*base.schema.names, "seed", "k", "similarity"],
                    )

    schema = "target_id string, parent_pos bigint, parent_id string, pose_idx int, seed int, k int, similarity double"
    rows = white.select(
        "target_id", F.col("parent_pos").cast("bigint").alias("parent_pos"), "parent_id",
        F.col("pose_idx").cast("int").alias("pose_idx"), "embedding",
    )
    return rows.mapInArrow(run, schema)


def _pose_similarity_blocked(white: DataFrame, refs: DataFrame, max_conformers: int, topk: int) -> DataFrame:
    """Reference sets of any size: each episode is joined as its own pair of sets."""
    label = F.concat_ws("\u0001", "target_id", "seed", "k").alias("target_id")
    episodes = refs.groupBy(*EPISODE_KEY).agg(F.count(F.lit(1)).alias("refs"))
    support = reference_rows(white, refs, max_conformers)
    support = support.join(refs.select(*EPISODE_KEY, "parent_id"), ["target_id", "parent_id"]).select(
        label, F.monotonically_increasing_id().alias("pos"), F.col("embedding").alias("vec")
    )
    support = write_table(support, "support-rows")
    pinned, fits = pin(episodes, 128, "episodes")
    # Rows are numbered once and written, so that the winners can be joined back.
    rows = attach(white, pinned, ["target_id"], fits, ["parent_pos", "pose_idx"]).select(
        *EPISODE_KEY, "parent_pos", "parent_id", "pose_idx", "embedding",
        F.monotonically_increasing_id().alias("pos"),
    )
    rows = write_table(rows, "query-rows")
    queries = rows.select(label, "pos", F.col("embedding").alias("vec"))
    hits = topk_between(queries, support, topk)
    scored = hits.groupBy(F.col("src").alias("pos")).agg(F.avg("sim").alias("similarity"))
    return rows.drop("embedding").join(scored, "pos").select(
        "target_id", F.col("parent_pos").cast("bigint").alias("parent_pos"), "parent_id",
        F.col("pose_idx").cast("int").alias("pose_idx"), "seed", "k", "similarity",
    )


def features_beyond_broadcast(
    conformers: DataFrame, refs: DataFrame, projection: np.ndarray | None, max_conformers: int, topk: int
) -> tuple[DataFrame, DataFrame]:
    """Centres and pooled similarities when the references cannot be broadcast."""
    white = write_table(whiten(conformers, projection), "whitened")
    pooled = pool_poses(_pose_similarity_blocked(white, refs, max_conformers, topk))
    return molecule_centers(white), pooled
