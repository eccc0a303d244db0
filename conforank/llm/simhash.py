"""Near duplicates by SimHash: fingerprints within two bits of each other, found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import write_table
from .common import BATCH_ROWS
from .jaccard import components

WIDTH, SEED, RADIUS = 3, 42, 2
BITS, SEGMENT = 64, 32
#: Fingerprints of a table cell that are compared one by one; fuller cells are split by midpoints.
CELL = 32
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, in order and with repeats; fewer words are one shingle, none give none."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, and the six ASCII white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[i : j - 1], SEED) for i, j in zip([0, *ends], last)), np.uint64, len(last))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number; 0 without hashes."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), SLICE):
        part = hashes[start : start + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(_id, fp) of every row, one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(start, BATCH_ROWS)
                texts = piece.column(1).cast(pa.binary())
                prints = [fingerprint(shingle_hashes(t.as_py(), width)) for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(prints, pa.int64())], ["_id", "fp"])

    kind = T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _bits(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT)


def _cells(fp: Column) -> Column:
    """The fingerprint's own cell in the table of either segment."""
    low = fp.bitwiseAND(F.lit((1 << SEGMENT) - 1)) + F.lit(1 << SEGMENT)
    return F.array(_high(fp), low)


def _probes(fp: Column) -> Column:
    """Cells that hold every fingerprint within two bits.

    Of two bits, at most one lies in the upper segment, or none in the lower one. So the ball of
    one bit is enumerated in the upper segment and the lower one is looked up as it is.
    """
    ball = F.transform(_bits(SEGMENT), lambda i: _high(fp).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(_cells(fp), ball)


def links_within_radius(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b of distinct fingerprints ``fp``: links that connect all that are within ``RADIUS`` bits.

    A cell of up to ``CELL`` fingerprints is compared with all that probe it. The members and
    probers of a fuller cell are instead indexed by the fingerprints at most one bit from them:
    those that meet in such a midpoint, 65 at most, are all within two bits of each other and are
    linked to the smallest, and any two within two bits meet in one. So rows grow with the number
    of fingerprints, not with the square of a cell, and no link is lost.
    """
    entries = nodes.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    probes = nodes.select("fp", F.explode(_probes(F.col("fp"))).alias("cell"))
    alone = (F.col("n") == 1) & F.array_contains(_cells(F.col("fp")), F.col("cell"))
    met = write_table(probes.join(sizes, "cell").where(~alone), "simhash-cells")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    few = met.where(F.col("n") <= CELL).join(entries.withColumnRenamed("fp", "b"), "cell")
    few = few.select(F.col("fp").alias("a"), "b").where("a < b")
    full = met.where(F.col("n") > CELL).select("fp").distinct()
    middle = F.transform(_bits(BITS), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    full = full.select("fp", F.explode(F.concat(F.array("fp"), middle)).alias("middle"))
    groups = full.groupBy("middle").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    full = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return few.unionByName(full).where(near).distinct()


def simhash_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, ``fingerprint`` (16 hex digits) and ``component_id`` of every row: groups connected by links.

    A-Z is lower-cased and whole texts are cut at ASCII white space into words; shingles of
    ``width`` words, repeats included, vote on the 64 bits by their XXH64 with seed 42, and a bit
    is set if it is set in over half of them. Documents are linked if their fingerprints differ
    in at most two bits. Every fingerprint within that radius is found (see ``links_within_radius``).

    Equal fingerprints are one node, so copies of any number cost a row each; a third of all rows
    may share one. Null and empty texts, and those without a word, have fingerprint zero and are
    linked like any other. Repeated rows of an id are each returned, in the group of their
    fingerprint. ``component_id`` is the smallest id of the group; null ids are never the
    smallest while others are there. Other columns are not read, so no name can clash.
    """
    prints = write_table(fingerprints(docs, width), "simhash-prints")
    nodes = write_table(prints.groupBy("fp").agg(F.min("_id").alias("rep")), "simhash-nodes")
    comps = components(nodes.withColumnRenamed("fp", "key"), links_within_radius(nodes.select("fp"))).withColumnRenamed("key", "fp")
    comps = write_table(comps, "simhash-components")
    smallest = nodes.join(comps, "fp").groupBy("comp").agg(F.min("rep").alias("component_id"))
    placed = comps.join(smallest, "comp").select("fp", "component_id")
    out = prints.join(placed, "fp")
    hexes = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("_id").alias("doc_id"), hexes.alias("fingerprint"), F.coalesce("component_id", "_id").alias("component_id"))
