"""Two tokenizers aligned: where their tokens end together, and which identifiers do so in the whole corpus."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import write_table
from .common import alone, carried, restored
from .pieces import BYTE, NORMAL, read_pieces
from .vocabulary import small_batches

#: Texts encoded at once, in characters; a longer text is a batch of its own.
BATCH_CHARS = 250_000
#: Irregular pairs whose counts every executor holds, the most frequent ones: 16 bytes each. The
#: others are joined by a shuffle; any number gives the same result.
HELD_PAIRS = 500_000
#: Links whose counts are looked up at once; a row of more is alone.
LOOKED_LINKS = 250_000


def _byte_letters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both vocabularies as bytes by identifier, and the array from each A identifier to the B identifier of the same bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        known = model["model"]["vocab"]
        special = {t["id"]: t["content"].encode() for t in model.get("added_tokens", ())}
        self.bytes_a = [b""] * (1 + max([*known.values(), *special]))
        for token, i in known.items():
            self.bytes_a[i] = special[i] if i in special else bytes(letters[c] for c in token)
        for i, content in special.items():
            self.bytes_a[i] = content
        self.bytes_b, normal, raw = [], {}, {}
        for i, (piece, _, kind) in enumerate(read_pieces(path_b)):
            value = bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace("▁", " ").encode()
            self.bytes_b.append(value)
            if kind in (NORMAL, BYTE):
                (normal if kind == NORMAL else raw).setdefault(value, i)
        same = raw | normal
        self.same = np.array([same.get(value, -1) for value in self.bytes_a], np.int64)
        ends = ((",", len(self.bytes_a)), ("|", len(self.bytes_a)), (",", len(self.bytes_b)), (";", len(self.bytes_b)))
        self.decimals = pa.array([f"{i}{mark}" for mark, top in ends for i in range(top)], pa.large_binary())
        self.spell_a, self.spell_b = (pa.array(x, pa.large_binary()) for x in (self.bytes_a, self.bytes_b))
        self.sizes_a, self.sizes_b = (np.array([len(v) for v in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Flat identifiers and row ends of A (of a space and the text) and of B (of the text); rows that either does not spell have none."""
        there = np.array([bool(t) for t in texts])
        some = [t for t in texts if t]
        wanted = [b" " + t.encode() for t in some]
        by_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in some], add_special_tokens=False)]
        by_b = self.b.encode(some, num_threads=1)
        sides = [(*_flat(by_a), self.spell_a), (*_flat(by_b), self.spell_b)]
        good = np.ones(len(some), bool)
        whole = b"".join(wanted)
        for ids, ends, table in sides:
            spelt = table.take(pa.array(ids))
            _, places, data = spelt.buffers()
            data = memoryview(data or b"").cast("B")  # compared as unsigned bytes
            if data != whole:
                at = np.frombuffer(places, np.int64, len(spelt) + 1)[ends].tolist()
                good &= [data[i:j] == w for i, j, w in zip(at, at[1:], wanted)]
        out = []
        for ids, ends, _ in sides:
            n = np.zeros(len(texts), np.int64)
            n[there] = np.where(good, np.diff(ends), 0)
            out.append((ids[np.repeat(good, np.diff(ends))], np.concatenate([[0], np.cumsum(n)])))
        return out[0], out[1]


@alone
def pair(path_a: str, path_b: str) -> Pair:
    """One for each Python worker and files."""
    return Pair(path_a, path_b)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


#: The groups of a text: identifiers of both sides, and how many of each a group has.
LISTS = ("a_ids", "b_ids", "a_sizes", "b_sizes")
#: Links of a text: A identifiers of one-to-one groups that the map gives, and packed pairs of all other groups.
LINKS = ("regular", "irregular")


class Groups:
    """Groups of a batch of texts as flat arrays, each with the row ends within it."""

    def __init__(self, both: Pair, texts: list[str]):
        self.both = both
        (self.a, rows_a), (self.b, rows_b) = both.encode(texts)
        # Both sides spell the same bytes row by row, so ends over the whole batch compare.
        ends_a, ends_b = np.cumsum(both.sizes_a[self.a]), np.cumsum(both.sizes_b[self.b])
        mark = np.zeros((int(ends_a[-1]) if len(ends_a) else 0) + 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] |= 2
        self.last_a, self.last_b = np.flatnonzero(mark[ends_a] == 3), np.flatnonzero(mark[ends_b] == 3)
        self.size_a, self.size_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        rows = np.searchsorted(self.last_a, rows_a, "left")
        self.ends = dict(zip(LISTS, (rows_a, rows_b, rows, rows)))

    def lists(self) -> list[pa.ListArray]:
        values = (self.a, self.b, self.size_a.astype(np.int32), self.size_b.astype(np.int32))
        return [_lists(v, self.ends[c]) for v, c in zip(values, LISTS)]

    def links(self) -> list[pa.ListArray]:
        """The identifiers that end together, one link for each group, as ``LINKS``."""
        a, b = self.a[self.last_a].astype(np.int64), self.b[self.last_b].astype(np.int64)
        regular = (self.size_a == 1) & (self.size_b == 1) & (self.both.same[a] == b)
        at = np.concatenate([[0], np.cumsum(regular)])[self.ends["a_sizes"]]
        return [_lists(a[regular].astype(np.int32), at), _lists((a << 32 | b)[~regular], self.ends["a_sizes"] - at)]

    def digests(self) -> list[pa.Array]:
        """n_a, n_b, n_groups and the SHA-256 of the groups as text: ``a1,a2|b1;a3|b2,b3``; '' for rows without tokens."""
        n, m = len(self.both.bytes_a), len(self.both.bytes_b)
        of_a, of_b = (np.repeat(np.arange(len(s)), s) for s in (self.size_a, self.size_b))
        before_b, upto_a = np.cumsum(self.size_b) - self.size_b, np.cumsum(self.size_a)
        code_a, code_b = self.a.astype(np.int64), self.b + np.int64(2 * n)
        code_a[self.last_a] += n
        code_b[self.last_b] += m
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + before_b[of_a]] = code_a
        code[np.arange(len(self.b)) + upto_a[of_b]] = code_b
        text = self.both.decimals.take(pa.array(code))
        _, places, data = text.buffers()
        rows = self.ends["a_ids"] + self.ends["b_ids"]
        ends = np.frombuffer(places, np.int64, len(text) + 1)[rows].tolist() if len(text) else [0] * len(rows)
        data = memoryview(data or b"")
        hashed = [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:])]
        return [*(pa.array(np.diff(self.ends[c])) for c in LISTS[:3]), pa.array(hashed, pa.string())]


def token_groups(rows: DataFrame, text: str, path_a: str, path_b: str, digests: bool = False) -> DataFrame:
    """``rows`` with the column ``text`` replaced by the groups, or by their digests, and by the links."""
    others = [c for c in rows.columns if c != text]
    made = "n_a long, n_b long, n_groups long, groups_sha256 string" if digests else ", ".join(f"{c} array<int>" for c in LISTS)
    kind = T._parse_datatype_string(f"{made}, regular array<int>, irregular array<long>")
    names = [*others, *kind.names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        both = pair(path_a, path_b)
        for batch in batches:
            at = 0
            for texts in small_batches((t.as_py() or "" for t in batch.column(len(others))), BATCH_CHARS):
                piece = batch.slice(at, len(texts))
                groups = Groups(both, texts)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *(groups.digests() if digests else groups.lists()), *groups.links()], names)
                at += len(texts)

    return rows.select(*others, text).mapInArrow(cut, T.StructType([rows.schema[c] for c in others] + kind.fields))


def _flat_rows(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists, and the row ends within them."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])


def pair_counts(groups: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a_id, b_id, n_links, best, regular): how often identifiers end together, and whether no other A does so as often with this B.

    One-to-one groups of equal bytes are counted in a vector over A's vocabulary in each task,
    which yields at most a row for each identifier; only pairs of irregular groups enter the
    shuffle as pairs, counted by batch before it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = pair(path_a, path_b).same
        vector = np.zeros(len(same), np.int64)
        names = ["a_id", "b_id", "n", "regular"]
        for batch in batches:
            vector += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(vector))
            found, n = np.unique(batch.column(1).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((found >> 32).astype(np.int32)), pa.array((found & 0xFFFFFFFF).astype(np.int32)), pa.array(n), pa.array(np.zeros(len(n), bool))], names)
        a = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(same[a].astype(np.int32)), pa.array(vector[a]), pa.array(np.ones(len(a), bool))], names)

    counted = groups.select(*LINKS).mapInArrow(count, "a_id int, b_id int, n long, regular boolean")
    counted = write_table(counted.groupBy("a_id", "b_id", "regular").agg(F.sum("n").alias("n_links")), "align-counts")
    most = counted.groupBy("b_id").agg(F.max("n_links").alias("_most"))  # at most a row for each identifier of B
    out = counted.join(F.broadcast(most), "b_id")
    return out.select("a_id", "b_id", "n_links", (F.col("n_links") == F.col("_most")).alias("best"), "regular")


def _held(counts: DataFrame, held_pairs: int) -> tuple[np.ndarray, int]:
    """Packed irregular pairs (sorted) with count and best flag: all whose count is above the level that still fits, and that level."""
    irregular = counts.where(~F.col("regular"))
    level = F.floor(8 * F.log2("n_links"))
    steps = irregular.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 512 levels at most
    room, lowest = held_pairs, 1 << 30
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        lowest = r["level"]
    rows = irregular.where(level >= lowest).toArrow()
    packed = rows["a_id"].to_numpy().astype(np.int64) << 32 | rows["b_id"].to_numpy()
    order = np.argsort(packed)
    value = rows["n_links"].to_numpy() * 2 + rows["best"].to_numpy(zero_copy_only=False)
    return np.stack([packed[order], value.astype(np.int64)[order]]), lowest


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows that have at most ``limit`` links beside those of their first row."""
    ends = (np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1).tolist()
    for start, end in zip([0, *ends], [*ends, len(sizes)]):
        yield start, end - start


def _looked_up(regular: pa.ListArray, irregular: pa.ListArray, vector: np.ndarray, names: np.ndarray, values: np.ndarray) -> pa.StructArray:
    """n_links, n_best and count_sum of each row by the counts held, and its pairs without one; ``LOOKED_LINKS`` at once."""

    def row_sums(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Links, best links and counts of each row."""
        total = np.zeros((3, len(value) + 1), np.int64)
        for row, part in zip(total, (value > 0, value & 1, value >> 1)):
            np.cumsum(part, out=row[1:])
        return np.diff(total[:, ends], axis=1)

    def run(regular: pa.ListArray, irregular: pa.ListArray) -> pa.StructArray:
        ids, id_ends = _flat_rows(regular)
        pairs, pair_ends = _flat_rows(irregular)
        at = np.searchsorted(names, pairs)
        known = np.zeros(len(pairs), bool)
        value = np.zeros(len(pairs), np.int64)
        if len(names):
            at = np.minimum(at, len(names) - 1)
            known = names[at] == pairs
            value[known] = values[at[known]]
        sums = row_sums(vector[ids], id_ends) + row_sums(value, pair_ends)
        sums[0] = np.diff(id_ends) + np.diff(pair_ends)
        rare = _lists(pairs[~known], np.concatenate([[0], np.cumsum(~known)])[pair_ends])
        return pa.StructArray.from_arrays([*map(pa.array, sums), rare], ["n_links", "n_best", "count_sum", "rare"])

    sizes = sum(x.value_lengths().to_numpy(zero_copy_only=False) for x in (regular, irregular))
    return pa.concat_arrays([run(regular.slice(*r), irregular.slice(*r)) for r in _runs(sizes, LOOKED_LINKS)])


def score_links(groups: DataFrame, counts: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """n_links, n_best and count_sum of each row of ``groups``, in place of its links; ``_row`` tells rows apart.

    Counts of regular pairs are vectors over A's vocabulary and those of the most frequent
    irregular ones a sorted array, both broadcast and bounded; the remaining pairs of each row,
    the rare ones, are joined with their counts by a shuffle in which no key is frequent.
    """
    vector = np.zeros(len(pair(path_a, path_b).same), np.int64)
    rows = counts.where("regular").toArrow()  # at most a row for each identifier of A
    vector[rows["a_id"].to_numpy()] = rows["n_links"].to_numpy() * 2 + rows["best"].to_numpy(zero_copy_only=False)
    held, lowest = _held(counts, held_pairs)
    sent = groups.sparkSession.sparkContext.broadcast((vector, held))

    @F.arrow_udf("n_links long, n_best long, count_sum long, rare array<long>")
    def look(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        vector, (names, values) = sent.value
        for regular, irregular in batches:
            yield _looked_up(regular, irregular, vector, names, values)

    scored = groups.withColumn("_s", look(*LINKS)).drop(*LINKS)
    scored = write_table(scored.select("*", "_s.*").drop("_s"), "align-scored")
    rare = scored.select("_row", F.explode("rare").alias("_pair")).groupBy("_row", "_pair").agg(F.count(F.lit(1)).alias("_n"))
    level = F.floor(8 * F.log2("n_links"))
    values = counts.where(~F.col("regular") & (level < lowest))
    values = values.select((F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")).alias("_pair"), F.col("n_links").alias("_c"), "best")
    rare = rare.join(values, "_pair").groupBy("_row").agg(F.sum(F.col("_n") * F.col("_c")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("_n")).otherwise(0)).alias("_best"))
    out = scored.drop("rare").join(rare, "_row", "left")
    out = out.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return out.drop("_sum", "_best")


def _encoded(docs: DataFrame, path_a: str, path_b: str, digests: bool) -> DataFrame:
    """Groups or digests and links of each row with ``_row``, a number of its own, and ``_all``, its other columns; written."""
    rows = carried(docs).select(
        F.monotonically_increasing_id().alias("_row"), F.col("_all").dropFields("text").alias("_all"), "_text"
    )
    return write_table(token_groups(rows, "_text", path_a, path_b, digests), "align-groups")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Alignment of each document, and the counts of pairs of identifiers over all of them.

    A (byte-level, ``tokenizers``) encodes a space and the text, B (``sentencepiece`` with byte
    fallback) the text, to which it adds the space; strings of special tokens are plain text.
    Where tokens of both end at the same byte, a group ends, and its last tokens are linked: one
    link for each group, as every token has bytes. Rows: the columns of ``docs`` without ``text``,
    then a_ids, b_ids, a_sizes and b_sizes (tokens of each group), n_links, n_best (links whose
    count is the highest of their B identifier, ties included) and count_sum (their counts).
    The second table is that of ``pair_counts``.

    Null and empty texts, and texts that either side does not spell byte by byte (B gives U+2581
    back as a space), have no tokens and no links. Repeated rows count each time and get equal
    results, null ids like any other. A column named like a result is replaced. A very long text
    is a batch of its own, in memory in proportion to its length.
    """
    rows = _encoded(docs, path_a, path_b, False)
    counts = write_table(pair_counts(rows, path_a, path_b), "align-pairs")
    out = rows.join(score_links(rows.select("_row", *LINKS), counts, path_a, path_b, held_pairs), "_row")
    return restored(out, docs.drop("text"), **{c: F.col(c) for c in (*LISTS, "n_links", "n_best", "count_sum")}), counts


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``align_tokenizers`` in figures: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the hash of the groups.

    The groups are hashed in the task that makes them, so no list of identifiers is written or shuffled.
    """
    rows = _encoded(docs.select("doc_id", "text"), path_a, path_b, True)
    counts = write_table(pair_counts(rows, path_a, path_b), "align-pairs")
    scored = score_links(rows.withColumn("doc_id", F.col("_all.doc_id")).drop("_all"), counts, path_a, path_b, held_pairs)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
