"""Vectors of words, computed once in each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Words a worker remembers before it starts again, and characters handled at once.
CACHE_WORDS, BATCH_CHARS = 1_000_000, 4_000_000


class WordVectors:
    """word -> row of a growing matrix; new words of a batch are computed together."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int):
        self.compute, self.width = compute, width
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def lookup(self, lists: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Row numbers for each list of words, and the matrix."""
        new = set().union(*lists).difference(self.index)
        if self.index and len(self.index) + len(new) > CACHE_WORDS:
            self.clear()
            new = set().union(*lists)
        if new:
            words, n = list(new), len(self.index)
            if n + len(words) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), n + len(words)), self.width), np.float32)
                grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n : n + len(words)] = self.compute(words)
            self.index.update(zip(words, range(n, n + len(words))))
        find = self.index.__getitem__
        return [np.fromiter(map(find, x), np.int64, len(x)) for x in lists], self.rows


def small_batches(texts: Iterable[str], limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Lists of texts of about ``limit`` characters; a longer text is a list of its own."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
