import numpy as np
import pytest
from pyspark.sql import functions as F

from conforank import fit_whitener, whiten
from conforank.operators import means, whitening
from conforank.sources import cache

import oracle


def library(spark, sizes=(40, 25), width=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for t, n in enumerate(sizes):
        for m in range(n):
            for p in range(1 + m % 3):
                rows.append((f"T{t}", m, f"m{m}", p, (rng.normal(size=width) * (1 + np.arange(width)) + t).tolist()))
    return spark.createDataFrame(rows, "target_id string, parent_pos long, parent_id string, pose_idx int, embedding array<double>")


def dense(df):
    pdf = df.toPandas().sort_values(["target_id", "parent_pos", "pose_idx"])
    return {t: (np.stack(o["embedding"]), o["parent_pos"].to_numpy()) for t, o in pdf.groupby("target_id")}


def test_fit_matches_definition(spark):
    lib = library(spark)
    total = 0
    for raw, owner in dense(lib).values():
        m = np.stack([raw[owner == i].mean(0) for i in range(owner.max() + 1)])
        total = total + np.cov(m.T, bias=True) / 2
    shrunk = 0.9 * total + 0.1 * np.trace(total) / 4 * np.eye(4)
    matrix, info = fit_whitener(lib.repartition(5), 0.1, 1e-3)
    assert info == {"targets": 2, "molecules": 65, "dimension": 4} and matrix.dtype == np.float32
    np.testing.assert_allclose(matrix @ (shrunk + 1e-3 * np.eye(4)) @ matrix, np.eye(4), atol=1e-5)
    np.testing.assert_allclose(matrix, matrix.T, atol=1e-7)


def test_fit_rejects_bad_input(spark):
    lib = library(spark)
    for s, e in ((-0.1, 1e-5), (1.1, 1e-5), (0.1, 0.0)):
        with pytest.raises(ValueError):
            fit_whitener(lib, s, e)
    with pytest.raises(ValueError):
        fit_whitener(library(spark, (3,)))
    with pytest.raises(ValueError):
        fit_whitener(library(spark, (30, 1)))
    with pytest.raises(ValueError):
        fit_whitener(lib.withColumn("embedding", F.array(*[F.lit(1.0)] * 4)))


def test_apply_and_zero_vector(spark):
    lib = library(spark)
    p = np.random.default_rng(1).normal(size=(4, 4))
    for counted in (lib, means.with_counts(lib)):
        got = dense(whiten(counted, p))
        for t, (raw, owner) in dense(lib).items():
            np.testing.assert_allclose(got[t][0], oracle.whiten(raw, owner, p), atol=1e-12)
    zero = spark.createDataFrame([("T", 0, "a", 0, [0.0, 0.0])], lib.schema)
    assert whiten(zero, None).first()["embedding"] == [0.0, 0.0]
    with pytest.raises(Exception, match="widths differ"):
        whiten(lib, np.eye(3)).collect()


def test_widths_must_agree(spark):
    lib = library(spark).unionByName(
        spark.createDataFrame([("T0", 99, "z", 0, [1.0])], "target_id string, parent_pos long, parent_id string, pose_idx int, embedding array<double>")
    )
    with pytest.raises(Exception, match="(?i)width|dimension"):
        whiten(lib, np.eye(4)).collect()


def test_whitener_files(spark, tmp_path):
    matrix = np.arange(9.0).reshape(3, 3)
    cache.write_whitener(spark, matrix, str(tmp_path / "w"))
    np.testing.assert_array_equal(cache.read_whitener(spark, str(tmp_path / "w")), matrix)
    np.savez(tmp_path / "w.npz", projection=matrix.astype(np.float32))
    np.testing.assert_array_equal(cache.read_whitener(spark, str(tmp_path / "w.npz")), matrix)
    np.savez(tmp_path / "m.npz", projection=matrix, mean=matrix[0])
    with pytest.raises(ValueError):
        cache.read_whitener(spark, str(tmp_path / "m.npz"))
    np.savez(tmp_path / "n.npz", other=matrix)
    with pytest.raises(KeyError):
        cache.read_whitener(spark, str(tmp_path / "n.npz"))


def test_covariance_by_target_with_many_targets(spark):
    # More targets than a task keeps open at once.
    lib = library(spark, tuple([5] * 40), width=3, seed=4)
    got = whitening.covariance_by_target(lib.repartition(2)).toPandas()
    for t, (raw, owner) in dense(lib).items():
        m = np.stack([raw[owner == i].mean(0) for i in range(owner.max() + 1)])
        own = got[got.target_id == t].sort_values(["i", "j"])
        np.testing.assert_allclose(own["c"].to_numpy().reshape(3, 3), np.cov(m.T, bias=True), atol=1e-10)
