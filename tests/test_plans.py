"""What reaches the scans, and which joins the plans use."""

import numpy as np
import pandas as pd

from conforank.catalog import views
from conforank.operators import graph as g
from conforank.operators import similarity, splits
from conforank.plans import scoring
from conforank.plans.scoring import score_library
from conforank.sources import cache


def plan(df):
    return df._jdf.queryExecution().toString()


def test_pruning_and_pushdown(spark, sf, tmp_path):
    cache.write_cache(views.library(spark, sf), str(tmp_path / "c"))
    library = cache.read_conformers(spark, str(tmp_path / "c"), "T1")
    assert "PartitionFilters: [isnotnull(target_id" in plan(library)
    ids = plan(library.select("parent_id"))
    assert "ReadSchema: struct<parent_id:string>" in ids
    refs = views.references(spark, sf)
    rows = plan(similarity.reference_rows(library, refs, 2, {"mol_000001", "mol_000003"}))
    assert "PushedFilters: [" in rows and "In(parent_id" in rows and "LessThan(pose_idx,2)" in rows


def test_no_cross_joins(spark, sf, monkeypatch):
    from conforank import storage
    from conforank.operators import graph
    from conforank.plans import scoring

    seen = []
    real = storage.write_table

    def record(df, name):
        seen.append(plan(df))
        return real(df, name)

    monkeypatch.setattr(graph, "write_table", record)
    monkeypatch.setattr(scoring, "write_table", record)
    refs = views.references(spark, sf)
    seen.append(plan(score_library(views.library(spark, sf), refs, views.PARAMS)))
    seen.append(plan(splits.episode_members(views.molecules(spark, sf), refs, "series-disjoint", views.series(spark, sf))))
    assert len(seen) > 5
    for text in seen:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def ring(spark, n):
    """A written graph in which every node has edges to the next two; it is said to have a million nodes."""
    rows = [("T", i, (i + d) % n, 0, 0.5, 0.5) for i in range(n) for d in (1, 2)]
    edges = spark.createDataFrame(rows, "target_id string, src long, dst long, salt int, sim double, w double")
    return g.Graph(g.write_table(edges, "ring"), None, 1_000_000)


def executed(df):
    """The plan as it ran: joins without broadcasts, as large tables have them."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_walk_steps_do_not_sort_or_move_edges(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seeds = spark.createDataFrame([("T", 0, 1.0)], "target_id string, pos long, s0 double")
        text = executed(g.propagate(ring(spark, 50), seeds, ["s0"], 0.2, 9))
        assert text.count("ShuffledHashJoin") == 9 and "Sort" not in text.replace("SortAggregate", "")
        assert text.count("FileScan parquet") == 1 and text.count("ReusedExchange") == 8  # edges are read and dealt once
        unsized, tight = g.Graph(ring(spark, 50).edges, None), {"hash_bytes": 1 << 20}
        assert "ShuffledHashJoin" not in executed(g.propagate(unsized, seeds, ["s0"], 0.2, 2))
        assert "ShuffledHashJoin" not in executed(g.propagate(ring(spark, 50), seeds, ["s0"], 0.2, 2, **tight))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_episodes_share_a_walk(spark, monkeypatch):
    """300 episodes of one target: every one has the walk it would have alone, in a plan of LANES columns."""
    rng, n, episodes = np.random.default_rng(4), 40, 300
    vectors = rng.normal(size=(n, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    centers = spark.createDataFrame([("T", f"m{i}", i, v.tolist()) for i, v in enumerate(vectors)], "target_id string, parent_id string, parent_pos long, center array<double>")
    refs = spark.createDataFrame([("T", e, 2, f"m{i}") for e in range(episodes) for i in (e % n, (7 * e + 1 + e // n) % n)], "target_id string, seed int, k int, parent_id string").distinct()
    widths = []
    real = scoring.propagate
    monkeypatch.setattr(scoring, "propagate", lambda graph, seeds, columns, *rest: widths.append(len(columns)) or real(graph, seeds, columns, *rest))
    got = scoring.graph_scores(centers, refs, views.PARAMS).toPandas()
    assert widths == [g.LANES] and not got.duplicated(["seed", "parent_pos"]).any()
    graph = g.build_graph(centers, views.PARAMS.graph_neighbors, views.PARAMS.graph_temperature, views.PARAMS.graph_indegree_exponent)
    edges = graph.edges.toPandas()
    w = np.zeros((n, n))
    w[edges["src"], edges["dst"]] = edges["w"]
    seed = np.zeros((n, episodes))
    for (e,), some in refs.toPandas().groupby(["seed"]):
        seed[[int(x[1:]) for x in some["parent_id"]], e] = 1.0 / len(some)
    state = seed
    for _ in range(views.PARAMS.graph_propagation_steps):
        state = views.PARAMS.graph_restart_probability * seed + (1 - views.PARAMS.graph_restart_probability) * w @ state
    table = pd.pivot_table(got, index="parent_pos", columns="seed", values="walk").reindex(index=range(n), columns=range(episodes)).fillna(0.0)
    np.testing.assert_allclose(table, state, atol=1e-12)
