"""SentencePiece byte-pair encoding and decoding by matching pieces in a suffix array."""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone

#: Characters encoded at once; a longer text is a batch of its own.
BATCH_CHARS = 2_000_000
#: Rows decoded at once.
DECODE_ROWS = 500
#: Segments and piece pairs that a worker remembers, and the longest segment kept.
CACHE_SEGMENTS, CACHE_PAIRS, CACHE_CHARS = 600_000, 1_000_000, 64
NORMAL, BYTE = 1, 6
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a serialized protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file, by identifier."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
            out.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
    return out


class PieceCodec:
    """Encode and decode for byte-pair models with byte fallback, an identity normalizer and a dummy prefix.

    A text is cut before each run of spaces, around line breaks and tabs that no piece has, and
    between letters and a punctuation mark that no piece has after a letter; no piece crosses
    such a cut. The new segments of a batch are joined and indexed by a suffix array
    (to the depth of the longest piece). Binary search gives the occurrences of every piece;
    each is an edge from its start to its end. Edges are sorted by position and relaxed from
    left to right: a prefix has one encoding, and an edge extends it if its piece and the last
    piece before it are left alone when merged on their own - which for pieces of distinct
    scores holds exactly for the result of the merges. Runs of spaces, the only pieces that
    share a score, are merged directly.
    """

    def __init__(self, path: str):
        pieces = read_pieces(path)
        self.texts = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.normal = sorted(self.ids)
        self.depth = max(map(len, self.normal))
        if any("▁" in p.lstrip("▁") for p in self.normal):
            raise ValueError("a piece has a space after other characters; such models are not supported")
        same = [p for p in self.normal if p.strip("▁")]
        if len({self.scores[p] for p in same}) != len(same):
            raise ValueError("pieces share a score; such models are not supported")
        self.chars = {c for p in self.normal for c in p}
        cut = "".join(c for c in "\n\t\r" if c not in self.chars)
        inner = {p[i : i + 2] for p in self.normal for i in range(len(p) - 1)}
        marks = "".join(c for c in ",.;:!?" if not any(x[1] == c and re.match(f"[{LETTERS}]", x) for x in inner))
        letters = f" *[{LETTERS}]+(?=[{marks}])|" if marks else ""
        self.split = re.compile(letters + (f" *[^ {cut}]+| +|[{cut}]" if cut else " *[^ ]+| +")).findall
        self.lengths = np.array([len(p) for p in self.normal])
        self.names = np.array(self.normal, dtype=f"<U{self.depth}")
        top = "\U0010ffff"
        self.tops = np.array([p + top * (self.depth - len(p)) for p in self.normal], dtype=f"<U{self.depth}")
        self.number = np.array([self.ids[p] for p in self.normal])
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.made: dict[str, tuple[str, str] | None] = {}

    def merge(self, text: str, but: str | None = None) -> list[str]:
        """The merges as such: best score first, then leftmost, none to ``but``. For short strings and runs of spaces."""
        parts = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.scores.get(whole := parts[i] + parts[j])) is not None and whole != but:
                heapq.heappush(heap, (-s, i, whole))

        heap: list[tuple[float, int, str]] = []
        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The last two pieces that merge to this one; two empty ones for a character, None if merges of its text end otherwise."""
        known = self.made.get(piece, 0)
        if known == 0:
            parts = self.merge(piece, piece) if len(piece) > 1 else ["", ""]
            known = self.made[piece] = tuple(parts) if len(parts) == 2 else None
        return known

    def stay(self, left: str, right: str) -> bool:
        """Do the merges of two pieces, neither made of spaces only, leave them? Their last merges are taken back, the later one first.

        A merge across the border that comes before the ones taken back is one that they do not get to.
        """
        a, b, score, made = left, right, self.scores.get, self.halves
        if made(left) is None or made(right) is None:
            return False
        lowest, first = -math.inf, False  # a merge must be above this score, or not below it where it is the leftmost
        while True:
            across = score(a + b)
            if across is not None and (across > lowest or first and across == lowest):
                return False
            rank_a = score(a) if len(a) > 1 else math.inf
            rank_b = score(b) if len(b) > 1 else math.inf
            if rank_a == rank_b == math.inf:
                return True
            # Of equal merges the left one comes first, so the right one is the later.
            if rank_a < rank_b:
                lowest, first, a = rank_a, False, made(a)[1]
            else:
                lowest, first, b = rank_b, True, made(b)[0]

    def apart(self, left: int, right: int) -> bool:
        """Do two pieces next to each other stay as they are?"""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            a, b = self.texts[left], self.texts[right]
            known = self.pairs[pair] = self.stay(a, b) if a.strip("▁") and b.strip("▁") else self.merge(a + b) == [a, b]
        return known

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of a piece in ``text``, sorted by end, then start."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, depth = len(codes), self.depth
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
        width = 1
        while width < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = rank[width:] if width < n else 0
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        padded = np.concatenate([codes, np.zeros(depth, np.uint32)])
        heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[suffixes]).view(f"<U{depth}").ravel()
        low = np.searchsorted(heads, self.names, "left")
        counts = np.maximum(np.searchsorted(heads, self.tops, "right") - low, 0)
        piece = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = suffixes[np.repeat(low, counts) + offset]
        end = start + self.lengths[piece]
        fits = end <= n
        order = np.lexsort((start[fits], end[fits]))
        return start[fits][order], end[fits][order], self.number[piece[fits]][order]

    def relax(self, words: list[str]) -> list[list[int]]:
        """Identifiers of each word; -1 - code point stands for a character that no piece has."""
        text = "\0".join(words)
        sizes = np.array([len(w) for w in words])
        firsts = np.cumsum(sizes + 1) - sizes - 1
        opening = np.zeros(len(text) + 1, bool)
        opening[firsts] = True
        last = [None] * (len(text) + 1)
        came = [0] * (len(text) + 1)
        start, end, piece = self.edges(text)
        # Characters without a piece are edges of their own and open the text after them.
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        bare = np.ones(len(text), bool)
        single = end - start == 1
        bare[start[single]] = False
        odd = np.flatnonzero(bare)
        for at, code in zip(odd.tolist(), codes[odd].tolist()):
            last[at + 1], came[at + 1] = -1 - code, at
        opening[odd + 1] = True
        opens, known, apart = opening.tolist(), self.pairs.get, self.apart
        for i, j, p in zip(start.tolist(), end.tolist(), piece.tolist()):
            if last[j] is not None:  # a prefix has one encoding
                continue
            if not opens[i]:
                q = last[i]
                if q is None or not (known(q << 32 | p) or apart(q, p)):
                    continue
            last[j], came[j] = p, i
        out = []
        for first, size in zip(firsts.tolist(), sizes.tolist()):
            ids, at = [], first + size
            while at > first:
                ids.append(last[at])
                at = came[at]
            out.append(ids[::-1])
        return out

    def numbers(self, parts: list[int]) -> list[int]:
        if not parts or min(parts) >= 0:
            return parts
        out: list[int] = []
        for p in parts:
            out += [p] if p >= 0 else [self.bytes[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")]
        return out

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """Encodings of new segments."""
        words = sorted({("▁" if s[0] == " " else "") + b for s in segments if (b := s.lstrip(" "))})
        known = dict(zip(words, self.relax(words))) if words else {}
        spaces = functools.cache(lambda n: [self.ids[p] for p in self.merge("▁" * n)])
        out = {}
        for s in segments:
            body = s.lstrip(" ")
            k = len(s) - len(body)
            ids = known[("▁" if k else "") + body] if body else []
            if k and body:
                single = ids[0] == self.ids["▁"]
                ids = spaces(k if single else k - 1) + ids[single:] if k > 1 else ids
            elif k:
                ids = spaces(k)
            out[s] = array("i", self.numbers(ids)).tobytes()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text as packed 32-bit integers."""
        cut = [self.split(" " + t.replace("▁", " ")) if t else [] for t in texts]
        new = set().union(*cut).difference(self.cache)
        found = self.learn(new) if new else {}
        if len(self.cache) + len(found) > CACHE_SEGMENTS:
            # Segments of this batch may be in either; keep the old ones for it.
            look = {**self.cache, **found}
            self.cache = {s: v for s, v in found.items() if len(s) <= CACHE_CHARS}
        else:
            self.cache.update((s, v) for s, v in found.items() if len(s) <= CACHE_CHARS)
            look = self.cache if all(len(s) <= CACHE_CHARS for s in found) else {**self.cache, **found}
        return [b"".join(map(look.__getitem__, c)) for c in cut]

    def encode(self, texts: Iterable[str], batch_chars: int = BATCH_CHARS) -> Iterator[bytes]:
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= batch_chars:
                yield from self.encode_batch(held)
                held, size = [], 0
        yield from self.encode_batch(held)

    @functools.cached_property
    def _piece_bytes(self) -> list[bytes]:
        return [
            bytes([self.byte_of[i]]) if i in self.byte_of else p.replace("▁", " ").encode() if p in self.ids else b""
            for i, p in enumerate(self.texts)
        ]

    def decode(self, ids: np.ndarray) -> str:
        """Text of identifiers: bytes are joined, control pieces are nothing, the first space goes."""
        whole = b"".join(map(self._piece_bytes.__getitem__, ids.tolist()))
        return whole.decode("utf-8", "replace").removeprefix(" ")

    def decode_batch(self, lists: pa.ListArray) -> list[str]:
        """Text of each array of identifiers, as ``decode`` gives it; null gives the empty text."""
        whole = pa.array(self._piece_bytes, pa.large_binary()).take(lists.values)
        _, ends, data = whole.buffers()
        if not len(whole):
            return [""] * len(lists)
        ends = np.frombuffer(ends, np.int64, len(whole) + 1, 8 * whole.offset)
        cuts = ends[lists.offsets.to_numpy()].tolist()
        data, there = memoryview(data), lists.is_valid().to_pylist()
        return [str(data[a:b], "utf-8", "replace").removeprefix(" ") if t else "" for a, b, t in zip(cuts, cuts[1:], there)]


@alone
def codec(path: str) -> PieceCodec:
    """One for each Python worker and file."""
    return PieceCodec(path)


def _lists(encodings: Iterable[bytes]) -> pa.ListArray:
    packed = list(encodings)
    ends = np.cumsum([0, *[len(x) // 4 for x in packed]], dtype=np.int64)
    values = pa.array(np.frombuffer(b"".join(packed), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def encoded(text: Column, path: str, batch_chars: int = BATCH_CHARS) -> Column:
    """Identifiers of each text (array of int; null and empty texts have none)."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(path)
        for texts in batches:
            yield _lists(coder.encode((x.as_py() or "" for x in texts), batch_chars))

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of each array of identifiers; null gives the empty text."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(path)
        for lists in batches:
            yield pa.array(coder.decode_batch(lists), pa.string())

    return decode(ids)


def encode_pieces(docs: DataFrame, path: str, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Replace ``text`` by ``ids`` (array of int) and ``n_tokens``; other columns stay.

    Identifiers equal those of the SentencePiece library without begin and end. Each row by
    itself, nothing is shuffled. Null and empty texts have no identifiers; repeated rows get
    equal ones; strings of control pieces inside a text are ordinary text. Whole texts are
    encoded: a very long one is a batch of its own, in memory in proportion to its length. Fewer
    ``batch_chars`` take less memory and more time; identifiers are the same.
    """
    out = docs.withColumn("ids", encoded(F.col("text"), path, batch_chars)).drop("text")
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


def encoded_and_decoded(text: Column, path: str) -> Column:
    """Identifiers of each text, SHA-256 of what they decode to, and whether that is the text.

    One worker does both, so a task holds one codec; only identifiers reach the decoder.
    """

    @F.arrow_udf("ids array<int>, decoded_sha256 string, round_trip boolean")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = codec(path)
        for texts in batches:
            lists = _lists(coder.encode(x.as_py() or "" for x in texts))
            hashes, same = [], []
            for start in range(0, len(texts), DECODE_ROWS):
                back = coder.decode_batch(lists.slice(start, DECODE_ROWS))
                hashes += [hashlib.sha256(b.encode()).hexdigest() for b in back]
                same += [b == (x.as_py() or "") for b, x in zip(back, texts.slice(start, DECODE_ROWS))]
            yield pa.StructArray.from_arrays(
                [lists, pa.array(hashes, pa.string()), pa.array(same, pa.bool_())], ["ids", "decoded_sha256", "round_trip"]
            )

    return both(text)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """``encode_pieces`` with ``decoded_sha256`` of the text decoded from ``ids`` and ``round_trip``, its equality with ``text``.

    Null texts come back empty, which counts as equal. The character that stands for spaces in
    pieces comes back as a space, as from the library; such texts are not equal.
    """
    out = docs.withColumn("_both", encoded_and_decoded(F.col("text"), path)).drop("text")
    out = out.withColumns({c: F.col(f"_both.{c}") for c in ("ids", "decoded_sha256", "round_trip")}).drop("_both")
    return out.withColumn("n_tokens", F.size("ids").cast("long"))
