"""Exact near-duplicate groups by a Jaccard join over token-combination prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import pin, write_table
from .common import BATCH_ROWS, LOWER_MAP, alone, ascii_words, unused

WORDS = 5
#: Tokens that begin the hash order of more than so many sets are of the frequent class; at most so
#: many are (the most frequent), 8 bytes each on every executor. Any choice gives the same result.
FREQUENT, MOST_FREQUENT = 32, 500_000
#: The class goes by the upper 40 bits of a token, which take less room to count.
CLASS_SHIFT = np.uint64(24)
#: Words whose hashes a worker remembers; workers keep them over stages, so the bound is low.
CACHE_WORDS = 250_000
#: Counters of a set's sketch.
SKETCH = 256
#: Members of a signature that are compared pair by pair; those of larger ones meet by their
#: differences from a centre. Any number gives the same result.
PAIRED_MEMBERS = 32
#: Sets of centres that a worker remembers.
CACHE_CENTRES = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) ** 7 % 2**64 | 1 for i in range(WORDS)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash of it with A-Z lower-cased, the same in every process; remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.translate(LOWER_MAP).encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


@alone
def word_hashes() -> WordHashes:
    """One for each Python worker, over all its tasks."""
    return WordHashes()


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words are one shingle, none give none."""
    words = ascii_words(text) if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    # Weights that depend on the place, then one mix: cheap, and words in another order differ.
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out += one[i : n - width + 1 + i] * _PLACES[i]
    out = _mixed(out)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) > 1 else out


def set_key(shingles: np.ndarray) -> int:
    """64-bit identity of a set; with its size it stands for the set."""
    return int(_mixed(shingles ^ _MIX).sum(dtype=np.uint64).astype(np.int64)) if len(shingles) else 0


def sketch(shingles: np.ndarray) -> bytes:
    """Tokens in each of ``SKETCH`` hash buckets, as bytes; 255 stands for that many or more."""
    counts = np.bincount((shingles & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _may_link(a: Column, b: Column, na: Column, nb: Column, num: int, den: int) -> Column:
    """False only for sets that cannot be similar enough: buckets bound what two sets share."""

    @F.arrow_udf("boolean")
    def bounded(xs: pa.Array, ys: pa.Array, ns: pa.Array, ms: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (xs, ys))
        n, m = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (ns, ms))
        most = np.where((x == 255) | (y == 255), 1 << 40, np.minimum(x, y)).sum(1)
        most = np.minimum(most, np.minimum(n, m))
        return pa.array(den * most >= num * (n + m - most))

    return bounded(a, b, na, nb)


def allowed(n: int, num: int, den: int) -> int:
    """Prefix length: one more than the tokens that a partner may lack."""
    return n - -(-n * num // den) + 1


def _counted(n: int, num: int, den: int) -> int:
    """First tokens of each set that are counted: past the prefix, because leaving out frequent ones moves its end."""
    return allowed(n, num, den) * 3 // 2 + 8


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known``?"""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _size_class(n: int, num: int, den: int) -> int:
    return int(math.floor(math.log(n) / math.log(den / num) + 1e-9))


def index_length(n: int, num: int, den: int) -> int:
    """Prefix length towards partners that are not smaller: these must share more."""
    return n - -(-2 * n * num // (num + den)) + 1


def _prefix(rare: np.ndarray, often: np.ndarray, buckets: tuple[int, ...], need: int, num: int, den: int) -> tuple[np.ndarray, bool]:
    if len(rare) >= need:
        return rare[:need], True
    out = [rare]
    for bucket in buckets:
        classes = max(1, int((den / num) ** (bucket - 1)) // 8)
        deal = (often >> np.uint64(7)) % np.uint64(classes)
        order = np.argsort(deal, kind="stable")
        repeated = np.zeros(len(often), bool)
        repeated[order[1:]] = deal[order[1:]] == deal[order[:-1]]
        enough = np.flatnonzero(np.cumsum(repeated) >= need - len(rare))
        take = int(enough[0]) + 1 if len(enough) else len(often)
        part, deal = often[:take], deal[:take]
        order = np.argsort(deal, kind="stable")
        part, deal = part[order], deal[order]
        for gap in range(1, len(part)):
            same = deal[gap:] == deal[:-gap]
            if not same.any():
                break
            out.append(_mixed(part[:-gap][same] * _MIX + part[gap:][same] + np.uint64(bucket)))
    return np.unique(np.concatenate(out)), False


def signatures(shingles: np.ndarray, frequent: np.ndarray, num: int, den: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Signatures of one set, which of them are for its index, and whether all, and those, are plain tokens.

    ``shingles`` may be the first tokens of a set of ``size`` if these hold a whole prefix of rare ones.

    Of two linked sets, an index signature of the smaller one (either, if they are as large) is a
    signature of the other. The global order is rare tokens by hash, then frequent ones by hash.
    If a prefix is all rare, each token is a signature. Otherwise frequent tokens are dealt to
    classes by hash and indexed by pairs within a class; a class whose tokens share no pair lacks
    all but one of them, so the prefix goes on until the rare tokens and all but one token of each
    class reach its length. The number of classes follows the size, so pairs stay about as many as
    tokens; sets of neighbouring sizes meet because each is indexed for its own size class and the
    next. The index takes the shorter prefix that suffices towards partners not smaller, so a set
    whose rare tokens already tell it from all that share its frequent ones is not met there.
    """
    n = len(shingles) if size is None else size
    is_frequent = _among(shingles >> CLASS_SHIFT, frequent)
    own = _size_class(n, num, den)
    parts = shingles[~is_frequent], shingles[is_frequent], (own, own + 1)
    every, plain = _prefix(*parts, allowed(n, num, den), num, den)
    if plain:  # in the same order, so the index takes the first of them
        return every, np.arange(len(every)) < index_length(n, num, den), True, True
    some, some_plain = _prefix(*parts, index_length(n, num, den), num, den)
    return every, np.isin(every, some), plain, some_plain


def _sets(docs: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, n, key, sketch and first tokens of every document; those of a set come once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = word_hashes(), set()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(start, BATCH_ROWS)
                ns, keys, lows, sketches = [], [], [], []
                for text in piece.column(1).to_pylist():
                    shingles = shingle_set(text, hashes)
                    n, key = len(shingles), set_key(shingles)
                    ns.append(n)
                    keys.append(key)
                    fresh = n > 1 and (key, n) not in seen
                    lows.append(shingles[: _counted(n, num, den)].astype(np.int64) if fresh else None)
                    sketches.append(sketch(shingles) if fresh else None)
                    seen.add((key, n))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(lows, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["_id", "_hash", "_n", "_key", "_low", "_sketch"],
                )

    kind = docs.schema["_id"].dataType
    schema = T.StructType(
        [T.StructField("_id", kind), *[T.StructField(c, T.LongType()) for c in ("_hash", "_n", "_key")], T.StructField("_low", T.ArrayType(T.LongType())), T.StructField("_sketch", T.BinaryType())]
    )
    return docs.mapInArrow(run, schema)


SIGNED = "sig long, key long, n int, index boolean, plain boolean, index_plain boolean"


def _signed_batch(sets: Iterator[tuple[np.ndarray, int, int]], frequent: np.ndarray, num: int, den: int) -> pa.RecordBatch:
    """Signatures of sets given as (tokens or first tokens, key, size)."""
    sigs, marks, sizes, found = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [0], [(0, 0, True, True)]
    for shingles, key, n in sets:
        some, index, *plain = signatures(shingles, frequent, num, den, n)
        sigs.append(some.astype(np.int64))
        marks.append(index)
        sizes.append(len(some))
        found.append((key, n, *plain))
    key, n, plain, index_plain = (np.repeat(np.array(c), sizes) for c in zip(*found))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(sigs)), pa.array(key, pa.int64()), pa.array(n, pa.int32()), *map(pa.array, (np.concatenate(marks), plain.astype(bool), index_plain.astype(bool)))],
        ["sig", "key", "n", "index", "plain", "index_plain"],
    )


def _signed(sets: DataFrame, long: DataFrame, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """(sig, key, n, index, plain, index_plain) of every set, once a task.

    The first tokens that ``_sets`` wrote hold the whole prefix of most sets; the others, ``long``,
    come as texts.
    """

    def by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                low, ns, keys = batch.slice(start, BATCH_ROWS).columns
                values = low.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                ns = ns.to_numpy()
                found, ends = _rare_first(low, frequent)
                whole = ~_past_first(found, np.diff(ends), ns, num, den)
                rows = zip(ends[:-1][whole].tolist(), ends[1:][whole].tolist(), keys.to_numpy()[whole].tolist(), ns[whole].tolist())
                yield _signed_batch(((values[i:j], key, n) for i, j, key, n in rows), frequent, num, den)

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                texts = batch.slice(start, BATCH_ROWS).column(0).to_pylist()
                whole = (shingle_set(text, hashes) for text in texts)
                yield _signed_batch(((x, set_key(x), len(x)) for x in whole), frequent, num, den)

    first = sets.where(F.col("_low").isNotNull()).select("_low", "_n", "_key").mapInArrow(by_first, SIGNED)
    return first.unionByName(long.select("text").mapInArrow(by_text, SIGNED))


def _postings(rows: DataFrame) -> DataFrame:
    """Each set of a signature in ``rows`` (see ``_signed``) that may link to the smallest one indexed there, with that one as ``p``.

    Signatures of a single set, most of them, leave no row; nor do sets smaller than all that
    are indexed. One sort by signature; running windows hold a row at a time, so the size of a
    group does not matter.
    """
    order = Window.partitionBy("sig").orderBy("n", F.col("index").desc(), "key")
    rows = rows.withColumns(
        {
            "p": F.first(F.when(F.col("index"), F.struct("key", "n", "plain", "index_plain")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_again": F.coalesce((F.lag("key").over(order) == F.col("key")) & (F.lag("n").over(order) == F.col("n")), F.lit(False)),
        }
    )
    other = (F.col("key") != F.col("p.key")) | (F.col("n") != F.col("p.n"))
    return rows.where(~F.col("_again") & other).drop("_again")


def _possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, na, pa, b, nb, pb) with na <= nb that share enough signatures, once each.

    Where the index of ``a`` and all of ``b`` are plain, shared tokens beyond the prefixes are at
    most what one of them has there; the rest of the least overlap must be among their common
    signatures.
    """
    fits = F.lit(den) * F.col("na") >= F.lit(num) * F.col("nb")
    counted = pairs.where(fits).groupBy("a", "na", "pa", "b", "nb", "pb").count()
    overlap = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")).cast("long") / F.lit(num + den) - 1e-9)
    beyond_a = F.ceil(F.col("na").cast("long") * 2 * num / F.lit(num + den) - 1e-9) - 1
    beyond_b = F.ceil(F.col("nb").cast("long") * num / F.lit(den) - 1e-9) - 1
    few = F.col("count") >= overlap - F.greatest(beyond_a, beyond_b)
    return counted.where(~(F.col("pa") & F.col("pb")) | few).select("a", "b")


def _linked(a: Column, b: Column, key: Column, num: int, den: int) -> Column:
    """Do two texts have shingle sets that are similar enough? ``key`` tells texts ``a`` that come again."""

    @F.arrow_udf("boolean")
    def verify(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = word_hashes()
        last, kept = None, np.zeros(0, np.uint64)
        for xs, ys, keys in batches:
            out = []
            for x, y, k in zip(xs, ys, keys.to_pylist()):
                if k != last:
                    last, kept = k, shingle_set(x.as_py(), hashes)
                other = shingle_set(y.as_py(), hashes)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                out.append(den * both >= num * (len(kept) + len(other) - both))
            yield pa.array(out, pa.bool_())

    return verify(a, b, key)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, comp): the smallest key reachable over ``edges`` (a, b), for every key of ``nodes``.

    Alternates large-star and small-star steps until no edge changes, so a chain of any length
    takes a logarithmic number of rounds; each round is written, so lost executors cost a re-read.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if small:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        met = both.join(least, "a")
        if small:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        else:
            out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = write_table(edges.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while before != (now := state(edges)):
        before = now
        edges = write_table(star(star(edges, False), True), "stars")
    found = edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("_m"))
    return nodes.select("key").join(found, "key", "left").select("key", F.coalesce("_m", "key").alias("comp"))


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of signatures that hold several components, an indexed one among them, with ``comp`` and their number."""
    placed = members.join(comps, "key")
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.count(F.lit(1)).alias("members"))
    mixed = mixed.where("_x <> _y").select("sig", "members")
    return write_table(placed.join(mixed, "sig"), "jaccard-left")


def _differences(met: DataFrame, nodes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """``met`` (p, key, comp) with ``n``, ``np``, ``far`` (no link between the two) and the tokens that one of both lacks; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, centres = word_hashes(), {}
        names = ["p", "key", "comp", "n", "np", "far", "tokens"]
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(start, BATCH_ROWS)
                ns, nps, far, found = [], [], [], []
                for p, centre, text in zip(*(piece.column(i).to_pylist() for i in (0, 3, 4))):
                    if p not in centres:
                        if len(centres) >= CACHE_CENTRES:
                            centres.clear()
                        centres[p] = shingle_set(centre, hashes)
                    own, other = shingle_set(text, hashes), centres[p]
                    apart = np.setxor1d(own, other, assume_unique=True)
                    ns.append(len(own))
                    nps.append(len(other))
                    far.append(len(apart) * (num + den) > (len(own) + len(other)) * (den - num))
                    found.append(apart.astype(np.int64))
                values = (pa.array(ns, pa.int64()), pa.array(nps, pa.int64()), pa.array(far, pa.bool_()), pa.array(found, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], *values], names)

    needed = met.select(F.explode(F.array("p", "key")).alias("key")).distinct().join(nodes, "key")
    found = _texts(needed, docs).dropDuplicates(["key"])  # repeated rows of a document give its text again
    rows = met.join(found.withColumnRenamed("text", "_t"), "key").join(found.select(F.col("key").alias("p"), F.col("text").alias("_c")), "p")
    rows = rows.select("p", "key", "comp", "_c", "_t").mapInArrow(run, "p long, key long, comp long, n long, np long, far boolean, tokens array<long>")
    return write_table(rows, "jaccard-apart")


def _fewer_centres(members: DataFrame, centres: DataFrame) -> DataFrame:
    """``centres`` (sig, p), each that is a member elsewhere replaced by the centre of most signatures that hold it.

    A centre need not be a member, as differences from any set tell the same pairs. Sets of a family
    are members of ever more large signatures as it grows, whose centres are of that family too:
    with these replaced, a set meets about one centre, not one for each kind of signature.
    """
    met = members.join(centres, "sig").where("key <> p")
    met = met.join(centres.select(F.col("p").alias("key")).distinct(), "key", "left_semi").groupBy("key", "p").count()
    onward = met.groupBy(F.col("key").alias("p")).agg(F.max_by("p", F.struct("count", "p")).alias("_next"))
    return centres.join(onward, "p", "left").select("sig", F.coalesce("_next", "p").alias("p"))


def _through_centres(members: DataFrame, nodes: DataFrame, docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members of a signature to its centre, and the pairs (a, b) of its other members that may link.

    The centre of a signature is the member that most signatures hold, or that one's own centre
    elsewhere (see ``_fewer_centres``). Two sets X and Y share as
    many of the tokens that tell them from the centre P as makes |X - Y| + |Y - X| at most
    (den - num) / (num + den) of their sizes. Members near P are linked to it, hence joined; where X
    or Y is far from P, the least overlap of their differences is above 0 and bounds prefixes of
    these: changes of near copies are mostly their own, so few pairs share one of the first, rarest
    tokens. Of two linked sets, the first common one has enough tokens behind it on both sides.
    """
    popular = members.groupBy("key").agg(F.count(F.lit(1)).alias("_c"))
    centres = members.join(popular, "key").groupBy("sig").agg(F.max_by("key", F.struct("_c", "key")).alias("p"))
    centres = _fewer_centres(members, write_table(centres, "jaccard-popular"))
    met = members.join(centres, "sig").where("key <> p").select("p", "key", "comp").distinct()
    apart = _differences(write_table(met, "jaccard-centres"), nodes, docs, num, den)
    near = apart.where(~F.col("far")).select(F.col("p").alias("a"), F.col("key").alias("b"))

    tokens = apart.select("p", "key", "comp", "n", "np", "far", F.size("tokens").cast("long").alias("d"), F.explode("tokens").alias("token"))
    shared = tokens.groupBy("p", "token").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    # Rare tokens first, so ``left``, the tokens from one to the end, counts from the most frequent one.
    order = Window.partitionBy("p", "key").orderBy(F.desc("_c"), F.desc("token"))
    rows = tokens.join(shared, ["p", "token"]).withColumn("left", F.row_number().over(order).cast("long"))
    room = 2 * (num + den) * F.col("left")
    least = lambda size: (num + den) * F.col("d") - (den - num) * size
    fits = num * F.col("left") >= num * F.col("d") - (den - num) * F.col("n")
    rows = rows.withColumn("first", room >= least(F.col("n") - F.col("np")))  # towards partners far from the centre
    rows = rows.where(fits & (F.col("first") | (F.col("far") & (room >= least(F.col("n") + F.col("np"))))))
    rows = write_table(rows.select("p", "token", "key", "comp", "n", "d", "far", "left", "first"), "jaccard-changes")
    named = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("key", "comp", "n", "d", "far", "left", "first")]
    x, y = rows.where("first").select("p", "token", *named("x")), rows.where("far").select("p", "token", *named("y"))
    small, large = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    enough = (num + den) * (F.col("d_x") + F.col("d_y")) - (den - num) * (F.col("n_x") + F.col("n_y")) <= 2 * (num + den) * F.least("left_x", "left_y")
    once = ~F.col("far_x") | (F.col("first_y") & (F.col("key_x") < F.col("key_y")))
    pairs = x.join(y, ["p", "token"]).where((F.col("comp_x") != F.col("comp_y")) & once & (den * small >= num * large) & enough)
    return near, pairs.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()


def _unknown(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """``pairs`` that are not among those ``done``."""
    known = done.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    return pairs.join(known, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def _most_frequent(tokens: DataFrame) -> np.ndarray:
    """The tokens (token, count, level) of the highest levels, ``MOST_FREQUENT`` at most, sorted."""
    level, room = 0, MOST_FREQUENT
    for r in tokens.groupBy("level").count().orderBy(F.desc("level")).collect():  # a few hundred levels at most
        room -= r["count"]
        if room < 0:
            break
        level = r["level"]
    most = tokens.where(F.col("level") >= level) if level else tokens.limit(0)
    return np.unique(most.select("token").toArrow()["token"].to_numpy().astype(np.int64).astype(np.uint64))


def _rare_first(low: pa.ListArray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first tokens of each set are not frequent, and the row ends within them."""
    rare = ~_among(low.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> CLASS_SHIFT, frequent)
    ends = np.concatenate([[0], np.cumsum(low.value_lengths().to_numpy(zero_copy_only=False))])
    return np.diff(np.concatenate([[0], np.cumsum(rare)])[ends]), ends


def _past_first(rare: np.ndarray, given: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Does the prefix of a set of ``n`` go past the tokens given, so many of them rare?"""
    return (rare < n + (-n * num) // den + 1) & (given < n)


def _lacks_rare(low: Column, n: Column, frequent: np.ndarray, num: int, den: int) -> Column:
    """Are so many of a set's first tokens frequent that its prefix goes past them?"""

    @F.arrow_udf("boolean")
    def lacks(lists: pa.Array, sizes: pa.Array) -> pa.Array:
        found, ends = _rare_first(lists, frequent)
        return pa.array(_past_first(found, np.diff(ends), sizes.to_numpy(zero_copy_only=False), num, den))

    return lacks(low, n)


def _later_tokens(num: int, den: int):
    """Tokens of each text past those that ``_sets`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                found = [np.zeros(0, np.uint64)]
                for text in batch.slice(start, BATCH_ROWS).column(0).to_pylist():
                    shingles = shingle_set(text, hashes)
                    found.append(shingles[_counted(len(shingles), num, den) :] >> CLASS_SHIFT)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], ["token"])

    return run


def _long(sets: DataFrame, docs: DataFrame, frequent: np.ndarray, num: int, den: int) -> DataFrame:
    """(key, text) of the sets whose prefix goes past the tokens that ``sets`` holds."""
    lacking = sets.where(F.col("_low").isNotNull()).where(_lacks_rare(F.col("_low"), F.col("_n"), frequent, num, den))
    lacking = lacking.groupBy("_key", "_n").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_hash")).alias("_r"))
    lacking = lacking.select(F.xxhash64("_key", "_n").alias("key"), F.col("_r._id").alias("rep"), F.col("_r._hash").alias("rep_hash"))
    return _texts(write_table(lacking, "jaccard-short"), docs)


def near_duplicate_groups(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, ``n_shingles`` and ``component_id`` of every row: connected groups of similar documents.

    Documents are linked if their sets of 5-word shingles (A-Z lower-cased) have a Jaccard
    similarity of at least ``num / den``. The result is exact: signatures (see ``signatures``) miss
    no link, and every candidate pair is verified on its whole texts.

    Equal sets are one node, so copies of any number cost a row each. Within a signature all sets
    are first compared with the smallest only; verified links are joined to components, and then
    just the pairs of different components are compared, in large signatures only those whose
    differences from one central member have enough in common (see ``_through_centres``). A group
    of thousands of near copies so costs pairs in proportion to its size as far as links to one set
    join it, and few beyond where each has changes of its own. A passage that many documents share is of the
    frequent class and no signature of theirs. Sizes, the number of common
    signatures and counts of tokens in hash buckets filter pairs beforehand, without losing a link.

    Null and empty texts, and texts without a word, have 0 shingles and are alone. Repeated rows
    of an id are each returned, in the group of their id. ``component_id`` is the smallest id of
    the group (null ids are never the smallest while others are there).
    """
    if 2 * num <= den:
        raise ValueError("the similarity must be above one half")
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    sets = write_table(_sets(texts, num, den), "jaccard-sets")
    counted = lambda t, name: write_table(t.groupBy("token").count().where(F.col("count") > FREQUENT).withColumn("level", F.floor(4 * F.log2("count"))), name)
    tokens = counted(sets.select(F.explode("_low").alias("_low")).select(F.shiftrightunsigned("_low", int(CLASS_SHIFT)).alias("token")), "jaccard-frequent")
    frequent = _most_frequent(tokens)
    # Near copies in great number share more than the tokens counted so far, which hide that the next are frequent too.
    long = _long(sets, docs, frequent, num, den)
    if not long.isEmpty():
        rest = long.select("text").mapInArrow(_later_tokens(num, den), "token long")
        frequent = _most_frequent(tokens.unionByName(counted(rest, "jaccard-frequent")))
        long = _long(sets, docs, frequent, num, den)

    node = lambda key, n: F.xxhash64(F.col(key), F.col(n).cast("long"))
    postings = _postings(_signed(sets, long, frequent, num, den))
    first = F.struct(node("p.key", "p.n").alias("key"), "p.n", "p.plain", "p.index_plain")
    postings = postings.select("sig", node("key", "n").alias("key"), "n", "index", "plain", "index_plain", first.alias("p"))
    postings = write_table(postings, "jaccard-postings")
    nodes = sets.where("_n > 0").groupBy("_key", "_n").agg(
        F.min(F.struct(F.col("_id").isNull(), "_id", "_hash")).alias("_r"), F.max("_sketch").alias("sketch")
    )
    nodes = nodes.select(
        node("_key", "_n").alias("key"), F.col("_n").alias("n"), "sketch", F.col("_r._id").alias("rep"), F.col("_r._hash").alias("rep_hash")
    )
    nodes = write_table(nodes, "jaccard-nodes")
    sides = lambda *c: [F.col(x).alias(y) for x, y in zip(c, ("a", "na", "pa", "b", "nb", "pb"))]
    stars = _possible(postings.select(*sides("p.key", "p.n", "p.index_plain", "key", "n", "plain")), num, den)
    done = _verified(_bounded(stars, nodes, num, den), nodes, docs, num, den)
    comps = write_table(components(nodes, done.where("linked")), "jaccard-components")

    # Members of a signature that are still in different components, its smallest set included.
    smallest = postings.select("sig", "p.key", "p.n", F.lit(True).alias("index"), "p.plain", "p.index_plain").distinct()
    members = postings.drop("p").unionByName(smallest)
    links = done.where("linked").select("a", "b")
    left = _unsettled(members, comps)
    large, left = left.where(F.col("members") > PAIRED_MEMBERS), left.where(F.col("members") <= PAIRED_MEMBERS)
    x, y = (left.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "index", "plain", "index_plain", "comp")]) for s in "xy")
    # The smaller one is indexed; of equal ones, either, and the smaller key is named first.
    equal = (F.col("n_x") == F.col("n_y")) & (F.col("key_x") < F.col("key_y")) & (F.col("index_x") | F.col("index_y"))
    rest = x.join(y, "sig").where((F.col("comp_x") != F.col("comp_y")) & (((F.col("n_x") < F.col("n_y")) & F.col("index_x")) | equal))
    rest = _possible(rest.select(*sides("key_x", "n_x", "index_plain_x", "key_y", "n_y", "plain_y")), num, den)
    crowded = not large.isEmpty()
    if crowded:  # pairs that small signatures show too rarely, as they share a large one, are among these
        near, other = _through_centres(large, nodes, docs, num, den)
        links = links.unionByName(near)
        rest = rest.unionByName(other).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = _bounded(_unknown(rest, done), nodes, num, den)
    if crowded or not rest.isEmpty():
        more = _verified(rest, nodes, docs, num, den)
        links = links.unionByName(more.where("linked").select("a", "b"))
        comps = write_table(components(nodes, links), "jaccard-components")

    # Rows of one id may have different texts; then their groups are one through the id.
    placed = sets.where("_n > 0").select("_id", F.xxhash64("_key", "_n").alias("key")).join(comps, "key")
    ids = placed.groupBy("comp").agg(F.min("_id").alias("component_id"))
    out = sets.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.when(F.col("_n") > 0, F.xxhash64("_key", "_n")).alias("_node"))
    out = out.join(comps.select(F.col("key").alias("_node"), "comp"), "_node", "left").join(ids, "comp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Columns unchanged.

    Rows that share an id are one document, of which the row with the smallest text hash stays.
    Rows without an id always stay, as nothing tells them apart.
    """
    groups = near_duplicate_groups(docs.select("doc_id", "text"))
    groups = write_table(groups, "jaccard-groups")
    named = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    marks = named.agg(F.count(F.lit(1)).alias("rows"), F.min((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"))
    mark, place = unused(docs, "mark"), unused(docs, "place")
    gone = write_table(marks.where("first = 0").select(F.col("doc_id").alias(mark)), "jaccard-gone")
    left = docs.join(gone, docs["doc_id"] == gone[mark], "left_anti")
    again = marks.where("rows > 1 AND first = 1").select(F.col("doc_id").alias(mark))
    if again.isEmpty():
        return left
    again = write_table(again, "jaccard-repeated")
    once = left.join(again, left["doc_id"] == again[mark], "left_anti")
    more = left.join(again, left["doc_id"] == again[mark], "left_semi")
    picked = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    more = more.withColumn(place, F.row_number().over(picked)).where(F.col(place) == 1).drop(place)
    return once.unionByName(more)


def _bounded(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b) without those whose sketches rule a link out."""
    of = lambda s: nodes.select(F.col("key").alias(s), F.col("n").alias(f"_n{s}"), F.col("sketch").alias(f"_s{s}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    kept = met.where(_may_link(F.col("_sa"), F.col("_sb"), F.col("_na"), F.col("_nb"), num, den))
    return write_table(kept.select("a", "b"), "jaccard-pairs")


def _texts(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, text) of ``needed`` (key, rep, rep_hash): the text of one document each; written."""
    small, fits = pin(needed.select("key", "rep", "rep_hash"), 64, "jaccard-needed")
    texts = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64("text"))
    match = texts["doc_id"].eqNullSafe(small["rep"]) & (texts["_hash"] == small["rep_hash"])
    return write_table(texts.join(F.broadcast(small) if fits else small, match).select("key", "text"), "jaccard-texts")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b) of nodes with ``linked``, each by the whole texts of one document of both."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(nodes, "key")
    found = _texts(needed, docs)
    second = pairs.join(found.select(F.col("key").alias("b"), F.col("text").alias("_tb")), "b")
    both = second.join(found.select(F.col("key").alias("a"), F.col("text").alias("_ta")), "a")
    checked = both.select("a", "b", _linked(F.col("_ta"), F.col("_tb"), F.col("a"), num, den).alias("linked"))
    return write_table(checked.groupBy("a", "b").agg(F.max("linked").alias("linked")), "jaccard-verified")
