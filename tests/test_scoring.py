import dataclasses

import numpy as np
import pytest

from conforank import score_library
from conforank.catalog import views
from conforank.schema import PUBLISHED

import oracle


def collect_library(df):
    pdf = df.toPandas().sort_values(["target_id", "parent_pos", "pose_idx"]).reset_index(drop=True)
    out = {}
    for target, own in pdf.groupby("target_id"):
        ids = own.drop_duplicates("parent_pos")["parent_id"].tolist()
        owner = own["parent_pos"].rank(method="dense").astype(int).to_numpy() - 1
        out[target] = (np.stack(own["embedding"]).astype(float), owner, ids)
    return out


def check(scores, library, refs, params, projection):
    got = scores.toPandas()
    episodes = refs.toPandas()
    assert not got.duplicated(["target_id", "seed", "k", "parent_id"]).any()
    total = 0
    for (target, seed, k), part in episodes.groupby(["target_id", "seed", "k"]):
        raw, owner, ids = library[target]
        at = [ids.index(i) for i in part.sort_values("ref_order")["parent_id"]]
        want = oracle.score(raw, owner, at, params, projection)
        own = got[(got.target_id == target) & (got.seed == seed) & (got.k == k)].sort_values("parent_pos")
        assert own["parent_id"].tolist() == [ids[q] for q in want["query"]]
        for column in ("score", "similarity", "direct", "graph"):
            np.testing.assert_allclose(own[column], want[column], rtol=0, atol=1e-8)
        total += len(own)
    assert total == len(got)


@pytest.mark.parametrize("case", ["plain", "projection", "negative", "blocked", "published", "no_graph"])
def test_score_library_matches_definition(spark, sf, case):
    lib = views.library(spark, sf)
    refs = views.references(spark, sf)
    params, projection, extra = views.PARAMS, None, {}
    if case == "projection":
        projection = views.projection()
    if case == "negative":
        params = dataclasses.replace(params, similarity_weight=-0.7)
    if case == "blocked":
        projection, extra = views.projection(), {"side": 16, "broadcast_bytes": 1}
    if case == "published":
        params = PUBLISHED
    if case == "no_graph":
        params = dataclasses.replace(params, graph_neighbors=0)
    scores = score_library(lib, refs, params, projection, **extra)
    check(scores, collect_library(lib), refs, params, projection)


def test_partitioning_does_not_matter(spark, sf):
    lib = views.library(spark, sf)
    refs = views.references(spark, sf)
    a = score_library(lib.repartition(7, "embedding"), refs, views.PARAMS).toPandas()
    b = score_library(lib.coalesce(1), refs, views.PARAMS).toPandas()
    keys = ["target_id", "seed", "k", "parent_pos"]
    a, b = a.sort_values(keys), b.sort_values(keys)
    np.testing.assert_allclose(a["score"], b["score"], atol=1e-9)


def test_bad_references(spark, sf):
    lib = views.library(spark, sf)
    make = lambda ids: spark.createDataFrame(
        [("T0", 0, len(ids), n, i) for n, i in enumerate(ids)],
        "target_id string, seed int, k int, ref_order int, parent_id string",
    )
    with pytest.raises(KeyError):
        score_library(lib, make(["nobody"]), views.PARAMS)
    with pytest.raises(ValueError):
        score_library(lib, make(["mol_000000", "mol_000000"]), views.PARAMS)
    with pytest.raises(ValueError):
        score_library(lib, make([]), views.PARAMS)
    everyone = [r[0] for r in lib.where("target_id = 'T0'").select("parent_id").distinct().collect()]
    with pytest.raises(ValueError):
        score_library(lib, make(everyone), views.PARAMS)


def test_single_query_gives_nan(spark):
    rows = [("T", 0, "a", 0, [1.0, 0.0]), ("T", 1, "b", 0, [0.6, 0.8])]
    lib = spark.createDataFrame(rows, "target_id string, parent_pos long, parent_id string, pose_idx int, embedding array<float>")
    refs = spark.createDataFrame([("T", 0, 1, "a")], "target_id string, seed int, k int, parent_id string")
    row = score_library(lib, refs, views.PARAMS).first()
    assert np.isnan(row["score"]) and np.isnan(row["direct"]) and np.isnan(row["graph"])
    assert abs(row["similarity"] - 0.6) < 1e-6
