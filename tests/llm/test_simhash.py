"""SimHash groups against brute force."""

import re

import numpy as np
import pytest

pytest.importorskip("conforank.llm")

import xxhash
from conforank.llm import simhash
from test_text_operators import frame, lower, odd_rows, pairs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i), d)) for i, d in enumerate(ids)), key=repr)


@pytest.mark.parametrize("cell", [1, 3, 32])
def test_simhash_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 3000)}"
    base = [word() for _ in range(400)]
    rows = odd_rows()
    for i in range(60):  # near copies with one to four words changed
        copy = list(base)
        for j in rng.integers(0, len(copy), 1 + i // 15):
            copy[j] = word()
        rows.append((1000 + i, "\t".join(copy)))
    rows += [(1100, "One"), (1101, "one  "), (1102, "one two"), (1103, "ONE\x0btwo three"), (1104, "é\xa0x É"), (1000, rows[-1][1])]
    prints = [brute_print(t) for _, t in rows]
    got = pairs_of(simhash.simhash_groups(frame(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert got == groups([i for i, _ in rows], prints)
    assert len({c for d, _, c in got if d is not None and 1000 <= d < 1060}) < 60
    assert simhash.simhash_groups(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("cell", [1, 2, 5, 1000])
def test_links_connect_all_within_two_bits(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(12)
    prints = set()
    for centre in rng.integers(0, 1 << 62, 6).tolist() + [0, (1 << 64) - 1]:
        for _ in range(25):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links_within_radius(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    joined = list(range(len(signed)))
    at = {p: i for i, p in enumerate(signed)}

    def find(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for r in links:
        joined[find(at[r.a])] = find(at[r.b])
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                assert find(a) == find(b)
