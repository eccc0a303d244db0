"""Count byte-pair tokens without producing identifiers."""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose counts a task remembers, and the longest of them; beyond, they are counted again.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 64


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """word -> number of tokens, by popping the adjacent pair of lowest rank from a heap.

    The symbols form a doubly linked list; a popped pair that no longer exists is skipped. Each
    merge removes one symbol, so the count is initial symbols minus merges: O(n log n).
    """

    def __init__(self, merges: list[tuple[str, str]], end: str):
        super().__init__()
        self.ranks = {pair: rank for rank, pair in reversed(list(enumerate(merges)))}
        self.symbols, self.end = _byte_symbols(), end

    def count(self, word: str) -> int:
        parts = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        if not parts:
            return 0
        parts[-1] += self.end
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            merges += 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return n - merges

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


class TextCounter:
    """Tokens of whole texts for a vocabulary file with word ends, lower case and byte symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = MergeCounter(merges, model["end_of_word_suffix"] or "")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Unicode white space, without the separators U+001C to U+001F that Python adds.
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(pattern).findall
        plain = pattern.replace(r"\p{White_Space}", r"\x20\t-\r").replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]")
        self.split_ascii = re.compile(plain.replace(r"\p{L}\p{N}", "a-z0-9")).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def plain(self, text: str) -> int:
        if text.isascii():
            found = self.split_ascii(text.lower())
        else:
            # One character at a time: no special form of sigma at the end of a word.
            found = self.split(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return sum(map(self.words.__getitem__, found))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


@functools.cache
def text_counter(path: str) -> TextCounter:
    """One for each Python worker and file."""
    return TextCounter(path)


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of each text. ``path`` must exist on every executor."""

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = text_counter(path)
        for texts in batches:
            yield pa.array([count(x.as_py()) for x in texts], pa.int64())

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Strings of added tokens inside a text count as one token each, as the library does by
    default. Each row by itself: no shuffle, and repeated rows get equal counts. Null and empty
    texts have 0 bytes and 0 tokens. Counts of words are remembered in each Python worker up to
    ``CACHE_WORDS``; results don't depend on that.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.withColumn("n_tokens", n_tokens(F.col("text"), path))
    return counted.withColumns(
        {"n_bytes": F.octet_length(text).cast("long"), "over_limit": F.col("n_tokens") > F.lit(limit)}
    )
