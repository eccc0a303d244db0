import dataclasses
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conforank.operators import graph as g
from conforank.operators import topk

import oracle


def frame(spark, libraries):
    rows = [(t, i, f"{t}{i}", [float(x) for x in v]) for t, m in libraries.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "target_id string, parent_pos long, parent_id string, center array<double>")


def random_units(n, d, seed):
    return oracle.unit(np.random.default_rng(seed).normal(size=(n, d)))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(0, 40), st.integers(0, 10**6), st.booleans())
def test_best_columns(rows, cols, k, seed, ties):
    rng = np.random.default_rng(seed)
    sims = rng.uniform(-1, 1, (rows, cols))
    if ties:
        sims = np.round(sims, 1)
    row, col, sim = topk.best_columns(sims, k)
    for r in range(rows):
        want = sorted(range(cols), key=lambda c: (-np.rint(sims[r, c] * topk.RESOLUTION), c))[:k]
        assert set(col[row == r]) == set(want)
        np.testing.assert_allclose(sim[row == r], sims[r, col[row == r]], atol=1e-11)


@pytest.mark.parametrize("side", [None, 8])
def test_knn_is_exact_across_blocks(spark, side):
    libraries = {"A": random_units(61, 5, 1), "B": random_units(7, 5, 2), "C": random_units(1, 5, 3)}
    # A third of the library is one vector: ties follow the library order.
    libraries["D"] = np.concatenate([random_units(20, 5, 4), np.tile(random_units(1, 5, 5), (10, 1))])
    got = topk.knn(frame(spark, libraries).repartition(3), 9, side).toPandas()
    assert not got.duplicated(["target_id", "src", "dst"]).any()
    for name, m in libraries.items():
        dst, sims = oracle.knn(np.round(m, 15), 9)
        own = got[got.target_id == name]
        assert len(own) == dst.size
        for src in range(len(m)):
            part = own[own.src == src].sort_values(["sim", "dst"], ascending=[False, True])
            np.testing.assert_allclose(part["sim"], sims[src], atol=1e-10)
            assert src not in set(part["dst"])
            if name != "D" or src >= 20:
                assert part["dst"].tolist() == dst[src].tolist()


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 9, 20])
def test_pairs_of_blocks_meet_once(spark, blocks):
    n, k = 40 * blocks, 6
    m = random_units(n, 4, blocks)
    centers = frame(spark, {"T": m})
    hits = topk.knn_candidates(centers, k, 40)
    rows = hits.toPandas()
    # Neighbours leave a task once a vector; the panels of others add at most k each.
    spans = -(-blocks // 2)
    assert len(rows) <= n * k * (blocks // 2 + spans) and not rows.duplicated(["src", "dst"]).any()
    got = topk.knn(centers, k, 40).toPandas().sort_values(["src", "sim"], ascending=[True, False])
    dst, _ = oracle.knn(m, k)
    assert got["dst"].to_numpy().reshape(n, k).tolist() == dst.tolist()
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 1, "the order by side must serve the grouping"


def test_panel_keeps_the_best_of_a_stream():
    rng = np.random.default_rng(3)
    left, right = np.round(random_units(30, 2, 10), 1), np.round(random_units(500, 2, 11), 1)
    pos = rng.permutation(500)
    panel = topk._Panel([(np.arange(1000, 1030), left)], 7, False)
    back = []
    for part in np.array_split(np.arange(500), 9):
        order = part[np.argsort(pos[part])]
        back += panel.meet(pos[order], right[order], True)
    src, dst, sim = panel.found()
    sims = np.rint(left @ right.T * topk.RESOLUTION)
    for i in range(30):
        want = sorted(range(500), key=lambda j: (-sims[i, j], pos[j]))[:7]
        assert dst[src == 1000 + i].tolist() == pos[want].tolist()
    src, dst = np.concatenate([x for x, _, _ in back]), np.concatenate([x for _, x, _ in back])
    for j in range(500):
        want = sorted(range(30), key=lambda i: (-sims[i, j], i))[:7]
        assert sorted(dst[src == pos[j]] - 1000) == sorted(want)


def test_between_sets(spark):
    q, d = random_units(23, 4, 6), random_units(31, 4, 7)
    make = lambda m: frame(spark, {"T": m}).selectExpr("target_id", "parent_pos as pos", "center as vec")
    got = topk.topk_between(make(q), make(d), 5, side=6).toPandas()
    want = np.sort(q @ d.T, axis=1)[:, ::-1][:, :5]
    for i in range(len(q)):
        np.testing.assert_allclose(np.sort(got[got.src == i]["sim"])[::-1], want[i], atol=1e-10)


@pytest.mark.parametrize("hot_degree", [1_000_000, 44, 3])
def test_graph_and_walk(spark, hot_degree):
    m = np.concatenate([random_units(30, 4, 8), np.tile(random_units(1, 4, 9), (15, 1))])
    centers = frame(spark, {"T": m})
    graph = g.build_graph(centers, 6, 0.3, 0.2, hot_degree=hot_degree)
    assert (graph.hot is None) == (hot_degree > 10)
    edges = graph.edges.toPandas()
    dst, sims = oracle.knn(m, 6)
    np.testing.assert_allclose(edges.groupby("src")["w"].sum(), 1.0, atol=1e-12)
    degree = edges.groupby("dst")["src"].count()
    raw = np.exp(edges["sim"] / 0.3) / degree[edges["dst"]].to_numpy() ** 0.2
    np.testing.assert_allclose(edges["w"], raw / raw.groupby(edges["src"]).transform("sum"), atol=1e-12)
    w = np.zeros((len(m), len(m)))
    w[edges["src"], edges["dst"]] = edges["w"]
    seeds = spark.createDataFrame([("T", 0, 1.0, 0.0), ("T", 3, 0.0, 0.5), ("T", 40, 0.0, 0.5)], "target_id string, pos long, s0 double, s1 double")
    seed = np.zeros((len(m), 2))
    seed[0, 0], seed[3, 1], seed[40, 1] = 1.0, 0.5, 0.5
    for steps in (0, 1, 4, 12):
        state = seed
        for _ in range(steps):
            state = 0.2 * seed + 0.8 * w @ state
        for nodes in (45, 1_000_000):  # a small state, and one that is hashed
            sized = dataclasses.replace(graph, nodes=nodes)
            got = g.propagate(sized, seeds, ["s0", "s1"], 0.2, steps).toPandas().set_index("pos")
            assert got.index.is_unique
            got = got.reindex(range(len(m)), fill_value=0.0)
            np.testing.assert_allclose(got[["s0", "s1"]], state, atol=1e-12)
    parts = seeds.selectExpr("target_id", "pos", "explode(array(0, 1)) AS part", "s0", "s1")
    parts = parts.selectExpr("target_id", "pos", "part", "IF(part = 0, s0, s1) AS s0")
    got = g.propagate(graph, parts, ["s0"], 0.2, 12, "part").toPandas().pivot(index="pos", columns="part", values="s0")
    np.testing.assert_allclose(got.reindex(range(len(m))).fillna(0.0), state, atol=1e-12)


@pytest.mark.parametrize("chunks", [1, 2, 40])
def test_panel_memory_follows_its_rows(monkeypatch, chunks):
    """A panel of n rows holds their partners, not n x n similarities, and finds the best ones."""
    n, met, k = 1500, 700, 6
    m = random_units(n + met, 8, 3)
    monkeypatch.setattr(topk, "PRODUCT_BYTES", 1 << 18)
    pos = np.random.default_rng(1).permutation(n + met)
    tracemalloc.start()
    panel = topk._Panel([(pos[:n], m[pos[:n]])], k, True)
    for at in np.array_split(pos[n:], chunks):
        for _ in panel.meet(at, m[at], True):
            pass
    src, dst, sim = panel.found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n  # all similarities of the panel to itself are eight times that
    assert len(src) == n * k
    sims = m @ m.T
    np.fill_diagonal(sims, -2)
    for p in pos[:n:50]:
        best = np.argsort(-sims[p], kind="stable")[:k]
        assert dst[src == p].tolist() == best.tolist()
        np.testing.assert_allclose(sim[src == p], sims[p, best], atol=1e-10)
