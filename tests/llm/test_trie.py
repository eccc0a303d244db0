"""Prefix trie against brute force and its SQL."""

import collections
import hashlib
import random
import zlib

import pytest

pytest.importorskip("conforank.llm")

import compare
from conforank.llm import trie
from conforank.llm.queries import REGISTRY


def order(turn, role, text):
    digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, digest)


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: order(*x))] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = (*own.get(c - c % 100, [])[:h], *own[c][h:])
    members = collections.defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn int, role string, text string, conv string, pos string, block int, k1 int, n_convs string, t1 int"


def strange():
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 140), *range(205, 230), 1_000_000_007]:
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None, "hello there"])))
    rows += [(300 + i, t, "user", f"same {t}") for i in range(60) for t in range(7)]  # common conversations
    rows += [(c, t, "user", f"turn {t // 2}") for c in (400, 401, 402, 444, 477) for t in range(90 - c % 7)]  # many blocks
    rows += [(5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "b", "other"), (7, None, None, None), (7, None, "x", "y"), (None, 1, "user", "no conversation")]
    rows += [(600, 0, "user", "x" * 100_000)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", 1, 2, "n", 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block, piece", [(1, 7), (3, 1000), (8, 5), (50, 1000)])
def test_trie(spark, monkeypatch, block, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = strange()
    got = trie.conversation_trie(table(spark, rows), block)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_trie_of_nothing(spark):
    assert trie.conversation_trie(table(spark, strange()).limit(0)).count() == 0
    assert trie.conversation_trie(table(spark, [(None, 1, "user", "x")])).count() == 0
    # A turnless conversation: its own only turn is among the first h, and its base is absent.
    c = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6)
    got = [tuple(r) for r in trie.conversation_trie(table(spark, [(c, 0, "user", "x")])).collect()]
    assert got == brute([(c, 0, "user", "x")]) and len(got) == 1


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_trie_equals_sql(spark, folder):
    run, sql = REGISTRY["op13_conversation_trie"]
    folder = f"/root/testdata/{folder}"
    want = compare.connect(folder).execute(sql).fetch_df()
    assert compare.difference(run(spark, folder).toPandas(), want) is None
