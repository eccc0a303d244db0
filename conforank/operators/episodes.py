"""Episode libraries as masks over one library: means, whitening and similarity without copies of vectors.

An episode that hides molecules is centred on the mean of what it shows. Vectors are not
copied for that: a pass over the library multiplies each batch with the projection once, and
subtracts the projected mean of each episode from the product. Which molecules an episode
shows is a bitmap over library positions where all bitmaps fit the broadcast limit; beyond it,
sums are made for every molecule and those that are not shown leave by a join of molecules,
never of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import to_lists, to_matrix, unit_rows
from ..functions.vectors import vector_sum
from ..schema import EPISODE_KEY
from ..storage import BROADCAST_BYTES, pin
from .means import MOLECULE, molecule_means, with_counts
from .similarity import FEATURES, FILTER_IDS, Context, molecule_sums, reference_rows
from .splits import library_name
from .whitening import vector_width

#: Positions in one piece of a bitmap, as Spark's bitmap functions cut them, and its bytes.
PIECE_BITS = 32_768
PIECE_BYTES = PIECE_BITS // 8


class Masks(NamedTuple):
    """Of one target: its episodes (seed, k) and, for each, the bits of the positions that it shows."""

    episodes: list[tuple[int, int]]
    bits: np.ndarray

    def shown(self, pos: np.ndarray) -> np.ndarray:
        """Rows: positions; columns: episodes."""
        at = pos >> 3
        inside = at < self.bits.shape[1]
        found = self.bits[:, np.where(inside, at, 0)] >> (pos & 7).astype(np.uint8) & 1
        return ((found == 1) & inside).T


def episode_masks(members: DataFrame, limit: int = BROADCAST_BYTES) -> dict[str, tuple] | None:
    """Target -> ``Masks`` of its episodes, or None if all together exceed ``limit`` bytes."""
    one_based = F.col("parent_pos") + 1
    pieces = members.where("visible").groupBy(*EPISODE_KEY, F.call_function("bitmap_bucket_number", one_based).alias("piece"))
    pieces = pieces.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", one_based)).alias("bits"))
    found, fits = pin(pieces, PIECE_BYTES + 64, "episode-bits", limit)
    if not fits:
        return None
    frame = found.toArrow().to_pandas()
    masks, total = {}, 0
    for target, own in frame.groupby("target_id"):
        episodes = sorted({(int(s), int(k)) for s, k in zip(own["seed"], own["k"])})
        total += len(episodes) * int(own["piece"].max()) * PIECE_BYTES
        if total > limit:
            return None
        bits = np.zeros((len(episodes), int(own["piece"].max()) * PIECE_BYTES), np.uint8)
        row = {e: i for i, e in enumerate(episodes)}
        for s, k, piece, data in zip(own["seed"], own["k"], own["piece"], own["bits"]):
            start = (int(piece) - 1) * PIECE_BYTES
            bits[row[int(s), int(k)], start : start + PIECE_BYTES] = np.frombuffer(data, np.uint8)
        masks[target] = tuple(Masks(episodes, bits))
    return masks


def _by_target(batch: pa.RecordBatch, known) -> Iterator[tuple[str, np.ndarray]]:
    """(target, rows of it) of a batch, for targets that are known."""
    encoded = batch.column("target_id").dictionary_encode()
    codes = encoded.indices.to_numpy()
    for code, target in enumerate(encoded.dictionary.to_pylist()):
        if target in known:
            yield target, np.flatnonzero(codes == code)


def _masked_sums(conformers: DataFrame, masks: dict[str, tuple]) -> DataFrame:
    """(target_id, seed, k, n, total): molecules shown and the sum of their mean vectors, one partial a task and episode."""
    shared = conformers.sparkSession.sparkContext.broadcast(masks)
    names = [*EPISODE_KEY, "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums: dict[str, np.ndarray] = {}
        weights: dict[str, np.ndarray] = {}
        for batch in batches:
            for target, at in _by_target(batch, known):
                part = batch.take(pa.array(at))
                raw = to_matrix(part.column("embedding"))
                weight = 1.0 / part.column("n_conf").to_numpy(zero_copy_only=False)
                shown = Masks(*known[target]).shown(part.column("parent_pos").to_numpy(zero_copy_only=False)) * weight[:, None]
                if target not in sums:
                    sums[target] = np.zeros((shown.shape[1], raw.shape[1]))
                    weights[target] = np.zeros(shown.shape[1])
                sums[target] += shown.T @ raw
                weights[target] += shown.sum(0)
        for target, total in sums.items():
            seeds, ks = zip(*known[target][0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([target] * len(total)), pa.array(seeds, pa.int32()), pa.array(ks, pa.int32()), pa.array(weights[target]), to_lists(total)],
                names,
            )

    rows = with_counts(conformers).select(*MOLECULE, "n_conf", "embedding")
    partial = rows.mapInArrow(run, "target_id string, seed int, k int, n double, total array<double>")
    return partial.groupBy(*EPISODE_KEY).agg(F.sum("n").alias("n"), vector_sum("total").alias("total"))


def _algebraic_sums(conformers: DataFrame, members: DataFrame) -> DataFrame:
    """The same sums as (all molecules of the target) - (hidden ones); molecule means meet members, vectors do not."""
    means = molecule_means(conformers).select(*MOLECULE, "mean")
    whole = means.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n"), vector_sum("mean").alias("_total"))
    hidden = members.where(~F.col("visible")).select(*EPISODE_KEY, "parent_pos")
    gone = means.join(hidden, MOLECULE).groupBy(*EPISODE_KEY).agg(F.count(F.lit(1)).alias("_gone"), vector_sum("mean").alias("_sum"))
    episodes = members.select(*EPISODE_KEY).distinct().join(whole, "target_id").join(gone, EPISODE_KEY, "left")
    n = (F.col("_n") - F.coalesce("_gone", F.lit(0))).cast("double")
    total = F.when(F.col("_sum").isNull(), F.col("_total")).otherwise(F.zip_with("_total", "_sum", lambda a, b: a - b))
    return episodes.select(*EPISODE_KEY, n.alias("n"), total.alias("total"))


def episode_means(conformers: DataFrame, members: DataFrame, masks: dict[str, tuple] | None = None) -> DataFrame:
    """(target_id, seed, k, mean): molecule-balanced mean of what each episode shows.

    With ``masks`` (of ``episode_masks``) it is one pass over the vectors; without, it follows
    from the target's sum and that of the hidden molecules.
    """
    sums = _masked_sums(conformers, masks) if masks is not None else _algebraic_sums(conformers, members)
    mean = F.transform("total", lambda x: x / F.col("n"))
    return sums.where("n > 0").select(*EPISODE_KEY, mean.alias("mean"))


def _contexts(
    conformers: DataFrame, refs: DataFrame, members: DataFrame, masks: dict[str, tuple] | None,
    projection: np.ndarray | None, max_conformers: int, topk: int, limit: int,
) -> dict[str, list[tuple]] | None:
    """Target -> (seed, k, projected mean, ``Context`` of whitened references) of its episodes; None beyond ``limit`` bytes."""
    width = vector_width(conformers, "embedding")
    link = refs.select(*EPISODE_KEY, "parent_id").limit(limit // 128 + 1).toPandas()
    if len(link) > limit // 128:
        return None
    own = reference_rows(conformers, refs, max_conformers, set(link["parent_id"]))
    support, fits = pin(own, 8 * width + 128, "support", limit)
    if not fits:
        return None
    means: dict[tuple, np.ndarray] = {}
    if projection is not None:
        table, fits = pin(episode_means(conformers, members, masks), 8 * width + 128, "episode-means", limit)
        if not fits:
            return None
        rows = table.toArrow()
        if rows.num_rows:
            means = dict(zip(zip(*(rows.column(c).to_pylist() for c in EPISODE_KEY)), to_matrix(rows.column("mean"))))
    frame = support.orderBy("target_id", "parent_pos", "pose_idx").toArrow()
    vectors = to_matrix(frame.column("embedding"))
    rows_of: dict[tuple, list[int]] = {}
    for i, owner in enumerate(zip(frame.column("target_id").to_pylist(), frame.column("parent_id").to_pylist())):
        rows_of.setdefault(owner, []).append(i)
    contexts: dict[str, list[tuple]] = {}
    held = 0
    for (target, seed, k), part in link.groupby(EPISODE_KEY):
        at = np.array(sorted(i for p in part["parent_id"] for i in rows_of[target, p]))
        raw, centre = vectors[at], None
        if projection is not None:
            mean = means[target, int(seed), int(k)]
            raw, centre = (raw - mean) @ projection, mean @ projection
        held += 8 * width * (len(at) + 1)
        if held > limit:  # references of several episodes count in each
            return None
        context = Context(None, unit_rows(raw), [(int(seed), int(k), np.arange(len(at)), min(topk, len(at)))])
        contexts.setdefault(target, []).append((int(seed), int(k), centre, tuple(context)))
    return contexts


def episode_features(
    conformers: DataFrame, refs: DataFrame, members: DataFrame, projection: np.ndarray | None,
    max_conformers: int, topk: int, limit: int = BROADCAST_BYTES,
) -> DataFrame | None:
    """``molecule_features`` of every episode library, named by ``library_name``, in one scan of the vectors.

    Rows: one for each episode, molecule that it shows and Arrow batch. None if the references
    or means exceed ``limit`` bytes.
    """
    masks = episode_masks(members, limit)
    contexts = _contexts(conformers, refs, members, masks, projection, max_conformers, topk, limit)
    if contexts is None:
        return None
    shared = conformers.sparkSession.sparkContext.broadcast((contexts, masks, projection))
    names = ["target_id", "parent_pos", "parent_id", "n", "vec", "ep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shown_by, matrix = shared.value
        for batch in batches:
            for target, at in _by_target(batch, known):
                part = batch.take(pa.array(at))
                raw = to_matrix(part.column("embedding"))
                pos = part.column("parent_pos").to_numpy(zero_copy_only=False)
                product = raw if matrix is None else raw @ matrix  # once for all episodes
                mask = None if shown_by is None else Masks(*shown_by[target])
                shown = None if mask is None else mask.shown(pos)
                for seed, k, centre, context in known[target]:
                    rows = np.arange(len(pos)) if mask is None else np.flatnonzero(shown[:, mask.episodes.index((seed, k))])
                    if not len(rows):
                        continue
                    white = unit_rows(product[rows] if centre is None else product[rows] - centre)
                    starts, sums, sizes, ep = molecule_sums(Context(*context), white, pos[rows])
                    structs = pa.StructArray.from_arrays([pa.array(v) for v in ep.values()], names=list(ep))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{target}#{seed}#{k}"] * len(starts), pa.string()),
                            pa.array(pos[rows][starts].astype(np.int64)),
                            part.column("parent_id").take(pa.array(rows[starts])),
                            pa.array(sizes.astype(np.int64)),
                            to_lists(sums),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32)), structs),
                        ],
                        names,
                    )

    rows = conformers
    targets = sorted(contexts)
    if len(targets) <= FILTER_IDS:
        rows = rows.where(F.col("target_id").isin(targets))
    features = rows.select("target_id", F.col("parent_pos").cast("bigint").alias("parent_pos"), "parent_id", "embedding").mapInArrow(run, FEATURES)
    if masks is None:
        visible = members.where("visible").select(library_name().alias("target_id"), "parent_pos")
        features = features.join(visible, MOLECULE, "left_semi")
    return features
