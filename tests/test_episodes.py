"""Episode libraries as masks against libraries of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conforank.catalog import queries, views
from conforank.operators import episodes, means, splits
from conforank.plans import scoring
from conforank.sources import cache

KEYS = ["target_id", "seed", "k", "parent_pos"]


def members_of(spark, sf, split):
    return queries._members(spark, sf, split)


@pytest.mark.parametrize("split", ["series-disjoint", "ave"])
def test_masks_hold_the_members(spark, sf, split):
    members = members_of(spark, sf, split)
    masks = episodes.episode_masks(members)
    rows = members.toPandas()
    rows = rows[[t in masks for t in rows["target_id"]]]
    assert len(rows) > 100 and not rows["visible"].all()
    for (target, seed, k), own in rows.groupby(["target_id", "seed", "k"]):
        mask = episodes.Masks(*masks[target])
        got = mask.shown(own["parent_pos"].to_numpy())[:, mask.episodes.index((seed, k))]
        assert (got == own["visible"].to_numpy()).all()
        assert not mask.shown(np.array([10**9])).any()
    assert episodes.episode_masks(members, limit=5000) is None


def test_bits_across_pieces(spark):
    pos = [0, 7, 8, 32767, 32768, 32769, 70000]
    rows = [("T", 0, 1, p, f"m{p}", True, True) for p in pos] + [("T", 0, 2, 5, "m5", True, True), ("T", 0, 2, 6, "m6", False, False)]
    members = spark.createDataFrame(rows, "target_id string, seed int, k int, parent_pos long, parent_id string, visible boolean, ranked boolean")
    mask = episodes.Masks(*episodes.episode_masks(members)["T"])
    every = np.arange(100_000)
    shown = mask.shown(every)
    assert mask.episodes == [(0, 1), (0, 2)]
    assert every[shown[:, 0]].tolist() == pos and every[shown[:, 1]].tolist() == [5]


@pytest.mark.parametrize("split, counted", [("series-disjoint", True), ("ave", False)])
def test_means_of_masks_and_of_algebra(spark, sf, split, counted):
    library, members = views.library(spark, sf), members_of(spark, sf, split)
    library = means.with_counts(library) if counted else library
    copied = means.balanced_means(splits.episode_libraries(views.library(spark, sf), members)).collect()
    want = {r["target_id"]: r["mean"] for r in copied}
    for masks in (episodes.episode_masks(members), None):
        got = {f"{r.target_id}#{r.seed}#{r.k}": r["mean"] for r in episodes.episode_means(library, members, masks).collect()}
        assert set(got) == set(want)
        for name in want:
            np.testing.assert_allclose(got[name], want[name], atol=1e-12)


@pytest.mark.parametrize(
    "split, case", [("series-disjoint", "projection"), ("series-disjoint", "no_masks"), ("ave", "plain"), ("ave", "no_broadcast")]
)
def test_scores_equal_those_of_copied_libraries(spark, sf, split, case, monkeypatch):
    library, members, refs = views.library(spark, sf), members_of(spark, sf, split), views.references(spark, sf)
    projection = None if case == "plain" else views.projection()
    named = refs.withColumn("target_id", splits.library_name())
    want = scoring.score_library(splits.episode_libraries(library, members), named, views.PARAMS, projection)
    want = want.withColumn("target_id", F.split("target_id", "#")[0]).toPandas().sort_values(KEYS, ignore_index=True)
    if case == "no_masks":
        monkeypatch.setattr(episodes, "episode_masks", lambda *_: None)
    extra = {"broadcast_bytes": 1} if case == "no_broadcast" else {}
    got = scoring.score_episode_libraries(library, refs, members, views.PARAMS, projection, **extra)
    got = got.toPandas().sort_values(KEYS, ignore_index=True)
    assert len(got) == len(want) > 100 and (got[[*KEYS, "parent_id"]] == want[[*KEYS, "parent_id"]]).all(axis=None)
    for column in ("score", "similarity", "direct", "graph"):
        np.testing.assert_allclose(got[column], want[column], rtol=0, atol=1e-8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_scanned_once_and_never_joined(spark, sf, tmp_path):
    cache.write_cache(means.with_counts(views.library(spark, sf)), str(tmp_path / "c"))
    library = cache.read_conformers(spark, str(tmp_path / "c"))
    refs, members = views.references(spark, sf), members_of(spark, sf, "series-disjoint")
    masks = episodes.episode_masks(members)
    projection = views.projection()
    features = episodes.episode_features(library, refs, members, projection, 3, 4)
    for passed in (plan(features), plan(episodes.episode_means(library, members, masks))):
        assert passed.count("FileScan parquet") == 1 and "Join" not in passed
    # Beyond the limit of the masks, members meet one row a molecule.
    sums = plan(episodes._algebraic_sums(library, members))
    joined = [line for line in sums.splitlines() if "FileScan parquet" in line and "embedding" in line]
    assert joined and "Generate" not in sums
