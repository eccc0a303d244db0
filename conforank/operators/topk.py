"""Exact top-k inner products between sets of unit vectors, in bounded panels.

Rows are hashed into blocks of about ``side`` vectors within their target. A task owns
one block, its panel, and reads up to SPAN other blocks as a stream. It keeps a running
top-k for the rows of its panel, so they leave the task once and not once per block.

Within one set the blocks stand in a circle and a panel meets the half that follows it:
a pair of blocks is multiplied once, and the same product also gives the streamed rows
their best k of the panel. With n vectors of a target in b blocks, a vector is sent
about b / 2 + b / (2 * SPAN) times, and as many times k candidates of it are merged. All
n^2 / 2 products are formed, as the result is exact. A task holds its panel with the k
partners of each row (BLOCK_BYTES together; the vectors twice while they are put in order),
one Arrow batch and a few arrays of PRODUCT_BYTES, and reads at most SPAN + 1 blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrow import to_matrix
from ..storage import attach, pin

# Bytes of a block with its partners, of one product held at a time, and the smallest block
# worth a task of its own.
BLOCK_BYTES = 64 * 1024 * 1024
PRODUCT_BYTES = 16 * 1024 * 1024
SMALL_SIDE = 512
# Results that leave a task in one Arrow batch.
FOUND_HITS = 200_000
# Blocks that a task reads beside its panel.
SPAN = 8
# A similarity in [-1, 1] is held as an integer of this resolution above the column
# number, so one partial sort orders by similarity and then by library position.
RESOLUTION = 1 << 38
COLUMN_BITS = 24

HITS = "target_id string, src bigint, dst bigint, sim double"


NEVER = np.iinfo(np.int64).min


def _best_keys(sims: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Keys of the best ``k`` columns per row, in no order; NEVER for the column ``skip`` of a row."""
    rows, cols = sims.shape
    scaled = sims * RESOLUTION
    keys = np.rint(scaled, out=scaled).astype(np.int64)
    del scaled
    keys <<= COLUMN_BITS
    keys += (1 << COLUMN_BITS) - 1 - np.arange(cols, dtype=np.int64)
    if skip is not None:
        keys[np.arange(rows), skip] = NEVER
    take = min(k, cols)
    if take == 0:
        return keys[:, :0]
    if take == cols:
        return keys
    keys.partition(cols - take, axis=1)
    return keys[:, cols - take :].copy()  # a view would keep all columns


def _column(keys: np.ndarray) -> np.ndarray:
    last = (1 << COLUMN_BITS) - 1
    return last - (keys & last)


def best_columns(sims: np.ndarray, k: int, skip: np.ndarray | None = None):
    """Best ``k`` columns per row: (row, column, similarity); ties to the left.

    ``skip`` names one column per row that may not be chosen.
    """
    keys = _best_keys(sims, k, skip)
    row, slot = np.nonzero(keys != NEVER)
    chosen = keys[row, slot]
    return row, _column(chosen), (chosen >> COLUMN_BITS) / RESOLUTION


def block_side(width: int, k: int = 0) -> int:
    """Vectors per block for vectors of this width that keep ``k`` partners each."""
    return min(max(SMALL_SIDE, BLOCK_BYTES // (8 * width + 16 * k)), 1 << COLUMN_BITS)


def _sorted_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a batch in ascending order, and their vectors."""
    pos = batch.column("pos").to_numpy()
    order = np.argsort(pos, kind="stable")
    return pos[order], to_matrix(batch.column("vec"))[order]


class _Panel:
    """Vectors of one block with the best k partners met so far.

    ``sims`` are integers of RESOLUTION, ``partners`` library positions; both are as wide as
    partners were offered, and at most k.
    """

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], k: int, own: bool):
        self.k = k
        self.pos = np.concatenate([p for p, _ in parts]) if parts else np.empty(0, np.int64)
        self.vectors = np.concatenate([v for _, v in parts]) if parts else np.empty((0, 0))
        parts.clear()
        order = np.argsort(self.pos, kind="stable")
        self.pos, self.vectors = self.pos[order], self.vectors[order]
        self.chunk = max(1, PRODUCT_BYTES // (8 * max(1, len(self.pos))))
        self.sims = np.empty((len(self.pos), 0), np.int64)
        self.partners = np.empty((len(self.pos), 0), np.int64)
        if own and len(self.pos):
            self._meet_itself()

    def _widen(self, offered: int) -> None:
        """Room for ``offered`` more partners a row, up to k."""
        wide = min(self.k, self.sims.shape[1] + offered)
        sims, partners = np.empty((2, len(self.pos), wide), np.int64)
        sims[:, : self.sims.shape[1]], partners[:, : self.sims.shape[1]] = self.sims, self.partners
        self.sims, self.partners = sims, partners

    def _meet_itself(self) -> None:
        self._widen(min(self.k, len(self.pos)))
        for start in range(0, len(self.pos), self.chunk):
            part = self.vectors[start : start + self.chunk] @ self.vectors.T
            rows = np.arange(start, start + len(part))
            self._offer(rows, 0, _best_keys(part, self.k, rows), self.pos)

    def _offer(self, rows: np.ndarray, held: int, keys: np.ndarray, pos: np.ndarray) -> None:
        """Merge candidates of some rows, which have ``held`` partners."""
        step = max(1, PRODUCT_BYTES // (64 * max(1, held + keys.shape[1])))
        for start in range(0, len(rows), step):
            own, new = rows[start : start + step], keys[start : start + step]
            sims = np.concatenate([self.sims[own, :held], new >> COLUMN_BITS], axis=1)
            places = np.where(new != NEVER, _column(new), 0)
            partners = np.concatenate([self.partners[own, :held], pos[places]], axis=1)
            best = np.lexsort((partners, -sims), axis=-1)[:, : self.k]
            self.sims[own] = np.take_along_axis(sims, best, 1)
            self.partners[own] = np.take_along_axis(partners, best, 1)

    def meet(self, pos: np.ndarray, vectors: np.ndarray, mutual: bool) -> Iterator[tuple]:
        """Take in the partners ``pos``; gives (src, dst, sim) of theirs in return if ``mutual``."""
        if not len(self.pos) or not self.k:
            return
        for start in range(0, len(pos), self.chunk):
            part = vectors[start : start + self.chunk] @ self.vectors.T
            here = pos[start : start + len(part)]
            if mutual:
                row, col, sim = best_columns(part, self.k)
                yield here[row], self.pos[col], sim
            held = self.sims.shape[1]
            if held < self.k:
                rows = np.arange(len(self.pos))
                self._widen(min(self.k, len(part)))
            else:  # most rows have k better partners after a few chunks
                rows = np.flatnonzero(part.max(axis=0) * RESOLUTION >= self.sims[:, -1] - 1)
            if len(rows):
                self._offer(rows, held, _best_keys(part.T[rows], self.k), here)

    def found(self, rows: slice = slice(None)) -> tuple:
        """(src, dst, sim) of some rows of the panel."""
        sims, partners = self.sims[rows], self.partners[rows]
        row, slot = np.nonzero(sims != NEVER >> COLUMN_BITS)
        return self.pos[rows][row], partners[row, slot], sims[row, slot] / RESOLUTION


def _panel_task(k: int, within: bool):
    """Kernel for one panel and the blocks streamed past it; ``within`` one set, pairs serve both ways."""

    def batch_of(target: str, src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"target_id": pa.array([target] * len(src), pa.string()), "src": src, "dst": dst, "sim": sim}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, panel, target, own = [], None, None, False
        for batch in batches:
            if target is None:
                target = batch.column("target_id")[0].as_py()
                own = within and batch.column("span")[0].as_py() == 0
            side = batch.column("side").to_numpy()
            split = int((side == 0).sum())
            if (np.diff(side) < 0).any() or (split and panel is not None):
                raise RuntimeError("the rows of a panel must come before the rows it meets")
            if split:
                parts.append(_sorted_rows(batch.slice(0, split)))
            if split < len(side):
                panel = panel or _Panel(parts, k, own)
                for hits in panel.meet(*_sorted_rows(batch.slice(split)), within):
                    yield batch_of(target, *hits)
        panel = panel or _Panel(parts, k, own)
        step = max(1, FOUND_HITS // max(1, k))
        for start in range(0, max(1, len(panel.pos)), step):
            yield batch_of(target, *panel.found(slice(start, start + step)))

    return run


def _hits(rows: DataFrame, k: int, within: bool) -> DataFrame:
    """Candidates of all panels; ``rows`` (target_id, a, span, side, pos, vec) with side 0 for the panel's own."""
    keys = ["target_id", "a", "span"]
    # The grouping needs rows clustered and ordered by the keys only and keeps this finer order.
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "side")
    return ordered.groupBy(*keys).applyInArrow(_panel_task(k, within), HITS)


def _block_count(n, side: int, parallelism: int):
    """Blocks for ``n`` vectors: full blocks, more when that would leave cores idle."""
    wanted = math.ceil(math.sqrt(2 * parallelism))
    return F.greatest(
        F.ceil(n / F.lit(side)),
        F.least(F.ceil(n / F.lit(min(side, SMALL_SIDE))), F.lit(wanted)),
    ).cast("int")


def _merge(hits: DataFrame, k: int) -> DataFrame:
    """Best k of the per-cell winners; a source has at most k per block of partners."""
    order = Window.partitionBy("target_id", "src").orderBy(F.desc("sim"), "dst")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def library_sizes(centers: DataFrame) -> tuple[DataFrame, bool]:
    """Vectors per target, pinned."""
    return pin(centers.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")), 128, "library-sizes")


def knn(
    centers: DataFrame, k: int, side: int | None = None, sizes: tuple[DataFrame, bool] | None = None
) -> DataFrame:
    """k nearest neighbours of each unit vector within its target, itself excluded.

    ``centers``: (target_id, parent_pos, center). ``k`` beyond n - 1 gives n - 1.
    Ties go to the smaller library position.
    """
    return _merge(knn_candidates(centers, k, side, sizes), k)


def knn_candidates(
    centers: DataFrame, k: int, side: int | None = None, sizes: tuple[DataFrame, bool] | None = None
) -> DataFrame:
    """Best k of every panel that a vector met, among which its k nearest neighbours are."""
    if k < 0:
        raise ValueError("the number of neighbours must not be negative")
    cores = centers.sparkSession.sparkContext.defaultParallelism
    side = _checked(side or _side_of(centers, "center", k))
    sizes, fits = sizes or library_sizes(centers)
    # Spans get shorter when there are fewer pairs of blocks than would keep all cores evenly busy.
    blocks = sizes.select("target_id", _block_count(F.col("n"), side, cores).alias("blocks")).withColumn(
        "reach", F.least(F.lit(SPAN), F.greatest(F.lit(1), F.floor(F.col("blocks") * F.col("blocks") / F.lit(16 * cores)))).cast("int")
    )
    placed = attach(
        centers.select("target_id", F.col("parent_pos").alias("pos"), F.col("center").alias("vec")),
        blocks, ["target_id"], fits, ["pos"],
    ).withColumn("block", F.pmod(F.xxhash64("pos"), F.col("blocks").cast("long")).cast("int"))
    # A panel meets the blocks 1 .. half steps ahead of it. Blocks opposite each other in an
    # even circle are half steps apart both ways, and only the first half of panels meet them.
    opposite = (F.col("blocks") % 2 == 0) & (F.col("blocks") > 1)
    half = (F.col("blocks") / 2).cast("int")
    ahead = half - F.when(opposite & (F.col("block") >= half), 1).otherwise(0)
    behind = half - F.when(opposite & (F.col("block") < half), 1).otherwise(0)
    spans = F.greatest(F.lit(1), F.ceil(ahead / F.col("reach"))).cast("int")
    own = F.transform(
        F.sequence(F.lit(0), spans - 1),
        lambda s: F.struct(F.col("block").alias("a"), s.alias("span"), F.lit(0).alias("side")),
    )
    steps = F.when(behind > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), behind))).otherwise(F.array().cast("array<int>"))
    met = F.transform(
        steps,
        lambda t: F.struct(
            F.pmod(F.col("block") - t, F.col("blocks")).alias("a"),
            F.floor((t - 1) / F.col("reach")).cast("int").alias("span"),
            F.lit(1).alias("side"),
        ),
    )
    return _hits(placed.select("target_id", F.inline(F.concat(own, met)), "pos", "vec"), k, True)


def _checked(side: int) -> int:
    if not 1 <= side <= 1 << COLUMN_BITS:
        raise ValueError(f"a block takes 1 to {1 << COLUMN_BITS} vectors")
    return side


def _side_of(df: DataFrame, column: str, k: int) -> int:
    row = df.select(F.size(column)).first()
    return block_side(row[0] if row else 1, k)


def topk_between(queries: DataFrame, data: DataFrame, k: int, side: int | None = None) -> DataFrame:
    """Best k of ``data`` for each of ``queries``, both (target_id, pos, vec) of unit length."""
    side = _checked(side or _side_of(data, "vec", k))

    def sized(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("target_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(side)).cast("int").alias(name))

    grid, fits = pin(sized(queries, "qn").join(sized(data, "dn"), "target_id"), 128, "grid-sizes")

    def placed(df: DataFrame, blocks: str) -> DataFrame:
        tagged = attach(df.select("target_id", "pos", "vec"), grid, ["target_id"], fits, ["pos"])
        return tagged.withColumn("block", F.pmod(F.xxhash64("pos"), F.col(blocks).cast("long")).cast("int"))

    spans = F.ceil(F.col("dn") / F.lit(SPAN)).cast("int")
    panels = placed(queries, "qn").select(
        "target_id", F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), spans - 1)).alias("span"),
        F.lit(0).alias("side"), "pos", "vec",
    )
    met = placed(data, "dn").select(
        "target_id", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("a"),
        F.floor(F.col("block") / F.lit(SPAN)).cast("int").alias("span"), F.lit(1).alias("side"), "pos", "vec",
    )
    return _merge(_hits(panels.unionByName(met), k, False), k)
