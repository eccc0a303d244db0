"""Find benchmark items inside documents by SimHash windows and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import write_table
from .common import alone, ascii_words, unused
from .jaccard import _PLACES, CACHE_WORDS, WORDS, _mixed

#: Fingerprints of 64 bits in eight blocks of eight: within ``RADIUS`` at least one block differs
#: in at most one bit, which the index looks up.
BITS, BLOCKS, RADIUS = 64, 8, 15
#: Characters of items handled in one pass over the documents.
ITEM_CHARS = 32_000_000
_PROBES = np.concatenate([[0], 1 << np.arange(8)]).astype(np.uint8)
#: Items looked up at once for the windows of a text; a window with more is alone.
LOOKED_UP = 250_000


class PlainHashes(dict):
    """word -> 64-bit hash of it in lower case without marks around it; 0 if nothing is left."""

    def __missing__(self, word: str) -> int:
        plain = word.lower()
        start, end = 0, len(plain)
        while start < end and not plain[start].isalnum():
            start += 1
        while end > start and not plain[end - 1].isalnum():
            end -= 1
        plain = plain[start:end]
        value = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) | 1 if plain else 0
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


@alone
def plain_hashes() -> PlainHashes:
    """One for each Python worker, over all its tasks."""
    return PlainHashes()


def shingles_of(text: str | None, hashes: PlainHashes) -> np.ndarray:
    """Hashes of the 5-word shingles in order; empty under five words."""
    words = ascii_words(text) if text else []
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    one = one[one != 0]
    if len(one) < WORDS:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(one) - WORDS + 1, np.uint64)
    for i in range(WORDS):
        out += one[i : len(one) - WORDS + 1 + i] * _PLACES[i]
    return _mixed(out)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def weighted_similarity(a: np.ndarray, b: np.ndarray, weight) -> float:
    """Sum of the smaller over sum of the larger counts of each shingle, by its weight."""
    keys = np.unique(np.concatenate([a, b]))
    counts = [np.bincount(np.searchsorted(keys, x), minlength=len(keys)) for x in (a, b)]
    w = weight(keys)
    return float((np.minimum(*counts) * w).sum() / (np.maximum(*counts) * w).sum())


class ItemIndex:
    """Fingerprints of items by size and block, and the weights of their shingles.

    A shingle weighs log(1 + items / items that have it); one of no item weighs as one of a
    single item. Weights depend on all items given, and on nothing else.
    """

    def __init__(self, ids: list, texts: list[str | None], weights: tuple[np.ndarray, np.ndarray, float]):
        hashes = PlainHashes()
        self.known, self.known_weight, self.other = weights
        kept = [(i, s) for i, t in zip(ids, texts) if len(s := shingles_of(t, hashes))]
        self.ids, self.sets = [i for i, _ in kept], [s for _, s in kept]
        self.prints = np.array([self.fingerprint(s) for s in self.sets], np.uint64).reshape(-1)
        self.all = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            by_size.setdefault(len(s), []).append(k)
        self.sizes = {size: self._cells(np.array(ks)) for size, ks in by_size.items()}

    def _cells(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items by block and byte, in each byte of theirs and those one bit away, and where each byte's begin."""
        blocks = self.prints[items].astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        cells = (blocks[:, :, None] ^ _PROBES).astype(np.int64) + 256 * np.arange(BLOCKS)[:, None]
        order = np.argsort(cells, axis=None, kind="stable")
        starts = np.searchsorted(cells.ravel()[order], np.arange(256 * BLOCKS + 1))
        return items[order // (BLOCKS * len(_PROBES))].astype(np.int32), starts

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.other)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
            hit = self.known[at] == shingles
            out[hit] = self.known_weight[at[hit]]
        return out

    def fingerprint(self, shingles: np.ndarray) -> np.uint64:
        total = (_signs(shingles) * self.weight(shingles)[:, None]).sum(0)
        return np.packbits(total > 1e-9).view("<u8")[0]

    def near(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of one size within ``RADIUS``."""
        items, starts = self.sizes[size]
        cells = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS) + 256 * np.arange(BLOCKS)
        counts = starts[cells + 1] - starts[cells]
        upto = np.cumsum(counts.sum(1)) // LOOKED_UP
        ends = (np.flatnonzero(np.diff(upto)) + 1).tolist()
        for low, high in zip([0, *ends], [*ends, len(prints)]):
            n = counts[low:high].ravel()
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = items[np.repeat(starts[cells[low:high]].ravel(), n) + offset]
            window = np.repeat(np.arange(low, high), counts[low:high].sum(1))
            close = np.bitwise_count(prints[window] ^ self.prints[found]) <= RADIUS
            yield from sorted(set(zip(window[close].tolist(), found[close].tolist())))

    def matches(self, text: str | None, hashes: PlainHashes, num: int, den: int) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): the best window of the text for each item found."""
        shingles = shingles_of(text, hashes)
        n = len(shingles)
        if not n or not len(self.all):
            return []
        at = np.minimum(np.searchsorted(self.all, shingles), len(self.all) - 1)
        hit = self.all[at] == shingles
        if not hit.any():
            return []
        weight = self.weight(shingles)
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        shared = np.concatenate([[0.0], np.cumsum(weight * hit)])
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.sizes:
            m = min(size, n)
            # What a window shares with any item bounds its similarity; the rest are no candidates.
            share = den * (shared[m:] - shared[:-m]) - num * (upto[m:] - upto[:-m])
            starts = np.flatnonzero(share >= -1e-6)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1) if len(starts) else []:
                for at in range(0, len(part), 4096):
                    some = part[at : at + 4096]
                    low, high = some[0], some[-1] + m
                    signs = _signs(shingles[low:high]) * weight[low:high, None]
                    sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(signs, 0)])
                    prints = np.packbits(sums[some - low + m] - sums[some - low] > 1e-9, axis=1).view("<u8").ravel()
                    for w, k in self.near(size, prints):
                        i = int(some[w])
                        value = weighted_similarity(shingles[i : i + m], self.sets[k], self.weight)
                        if den * value >= num - 1e-9 and (value, -i) > (best.get(k, (0.0, 1, 0))[0], -best.get(k, (0.0, 1, 0))[1]):
                            best[k] = (value, i, m)
        return [(k, i, m + WORDS - 1, value) for k, (value, i, m) in sorted(best.items())]


def _weights(items: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles that several items share, their weights, weight of all others)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = PlainHashes()
        for batch in batches:
            sets = [np.unique(shingles_of(t, hashes)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"s": pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.int64))})

    n = max(items.count(), 1)
    often = items.select("text").mapInArrow(cut, "s long").groupBy("s").count().where("count > 1").toArrow()
    s = often["s"].to_numpy().astype(np.int64).astype(np.uint64)
    order = np.argsort(s)
    return s[order], np.log1p(n / often["count"].to_numpy())[order], float(np.log1p(n))


def find_items(docs: DataFrame, items: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, first_word, n_words, similarity.

    Words are compared in lower case without marks around them. For every item size, a window of
    that many shingles slides over each whole text word by word (a shorter text is one window).
    Windows that could reach the similarity get a SimHash fingerprint; blocks of eight bits, looked
    up with up to one bit changed, find every item of that size within ``RADIUS`` of it; then the
    weighted similarity of 5-word shingles decides exactly. The best window of an item is returned
    (ties: the first), one row for each document row and item.

    Documents are read in place and only findings leave a task, so copies and long texts need no
    shuffle. Items go to the executors in parts of ``ITEM_CHARS`` characters, one pass over the
    documents for each part. Null or empty texts, documents and items of under five words match
    nothing; repeated items and repeated rows are each reported; tables may be empty.
    """
    spark: SparkSession = docs.sparkSession
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(chars) // ITEM_CHARS))
    weights = _weights(items)
    id_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("item_id", item_type), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())]
    )
    found = spark.createDataFrame([], schema)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        shared = spark.sparkContext.broadcast(ItemIndex(rows["item_id"].to_pylist(), rows["text"].to_pylist(), weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = shared.value, plain_hashes()
            for batch in batches:
                out: list[tuple] = []
                for at in range(batch.num_rows):
                    for k, first, words, value in index.matches(batch.column(1)[at].as_py(), hashes, num, den):
                        out.append((batch.column(0)[at].as_py(), index.ids[k], first, words, value))
                if out:
                    a, b, c, d, e = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, batch.schema.field(0).type), pa.array(b), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.float64())], schema.names
                    )

        one = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = one if parts == 1 else found.unionByName(one)
    return found


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id has no finding, columns unchanged. Rows without an id go together."""
    mark = unused(docs, "hit")
    hits = write_table(find_items(docs, items).select(F.col("doc_id").alias(mark)).distinct(), "items-found")
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits[mark]), "left_anti")
