import json
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conforank import cli
from conforank.catalog import views
from conforank.operators import references, splits
from conforank.schema import PUBLISHED, Params
from conforank.sources import cache, molecules, tables


class Toolkit:
    """Accepts structures without '?', upper-cases them; conformers from the length."""

    def canonical(self, smiles):
        return None if "?" in smiles or not smiles else smiles.upper()

    def from_block(self, block):
        lines = block.splitlines()
        return None if len(lines) < 2 else lines[1].strip().upper()

    def conformers(self, parent_id, smiles, count, seed):
        return [(smiles, n) for n in range(min(count, len(smiles)))]


class Encoder:
    def encode(self, shapes):
        out = np.zeros((len(shapes), 3), dtype=np.float32)
        for row, (smiles, n) in enumerate(shapes):
            out[row] = [len(smiles), n + 1, sum(map(ord, smiles)) % 13]
        return out


def test_params(tmp_path):
    raw = {**{n: getattr(PUBLISHED, n) for n in PUBLISHED.__dataclass_fields__}, "graph_neighbors": 5.9, "extra": 1}
    raw.pop("similarity_weight"), raw.pop("graph_search_precision")
    path = tmp_path / "p.json"
    path.write_text(json.dumps(raw))
    p = Params.from_json(path)
    assert p.graph_neighbors == 5 and p.similarity_weight == 1.0 and p.graph_search_precision == "fp32"
    with pytest.raises(KeyError):
        Params.from_dict({"graph_neighbors": 1})
    with pytest.raises(ValueError):
        Params.from_dict({**raw, "graph_search_precision": "int8"})


def test_molecule_csv(spark, tmp_path):
    path = tmp_path / "a.CSV"
    path.write_text("parent_molecule_id,smiles,note\n x ,cco,1\ny, c1 ,2\nz,\"n,n\",3\n")
    rows = molecules.read_molecules(spark, str(path), Toolkit).orderBy("parent_pos").collect()
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, "x", "CCO"), (1, "y", "C1"), (2, "z", "N,N")]
    for text in ("id,smiles\na,c\n", "parent_molecule_id,smiles\n", "parent_molecule_id,smiles\n  ,c\n",
                 "parent_molecule_id,smiles\na,?\n", "parent_molecule_id,smiles\na,c\na ,c\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            molecules.read_molecules(spark, str(path), Toolkit)
    with pytest.raises(ValueError):
        molecules.read_molecules(spark, "a.txt", Toolkit)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_molecule_blocks(spark, tmp_path, end):
    path = tmp_path / "a.sdf"
    blocks = [["first ", "cc"], ["", "nn"], ["third", "oo"]]
    path.write_bytes("".join(end.join([*b, "M  END", "> <p>", "1", "", "$$$$"]) + end for b in blocks).encode())
    rows = molecules.read_molecules(spark, str(path), Toolkit).orderBy("parent_pos").collect()
    assert [(r["parent_id"], r["canonical_smiles"]) for r in rows] == [("first", "CC"), ("molecule_2", "NN"), ("third", "OO")]
    one = tmp_path / "b.mol"
    one.write_bytes(end.join(["", "cc", "M  END"]).encode())
    assert molecules.read_molecules(spark, str(one), Toolkit).first()["parent_id"] == "molecule_1"


def test_text_tables(spark, tmp_path):
    head = "target_id,seed,K,support_parent_ids,candidate_count,positive_count,negative_count"
    e = tmp_path / "e.csv"
    e.write_text(head + '\nT,0,2,"[""a"",""b""]",5,2,3\nT,0,1,"[""a""]",6,3,3\nT,1,1,"[""a""]",6,3,3\n')
    rows = tables.read_episodes(spark, str(e), 0, [1, 2]).orderBy("k").collect()
    assert [list(r["support_parent_ids"]) for r in rows] == [["a"], ["a", "b"]]
    assert rows[0]["series_excluded_count"] == 0
    with pytest.raises(ValueError):
        tables.read_episodes(spark, str(e), 5, [1])
    for bad in ('"[""a"",""a""]"', '"[""a""]"'):
        e.write_text(head + f"\nT,0,2,{bad},5,2,3\n")
        with pytest.raises(ValueError):
            tables.read_episodes(spark, str(e), 0, [2])
    s = tmp_path / "s.csv"
    s.write_text("target_id,parent_molecule_id,series_id\nT,a,s1\nT,b,s1\nT,a,s2\n")
    got = splits.latest_series(tables.read_series(spark, str(s))).toPandas()
    assert dict(zip(got["parent_id"], got["series_id"])) == {"a": "s2", "b": "s1"}
    smi = tmp_path / "x.smi"
    smi.write_text("CC\tignored  id1 \nCO id2\nCC id1\n")
    assert {r[0] for r in tables.read_smi_ids(spark, [str(smi)]).collect()} == {"id1", "id2"}
    smi.write_text("CC id1\n\nCO id2\n")
    with pytest.raises(ValueError):
        tables.read_smi_ids(spark, [str(smi)])


def test_sampling_equals_python(spark, sf):
    labels = views.labels(spark, sf)
    actives = sorted(r[0] for r in labels.where("target_id = 'T1' and label = 1").select("parent_id").collect())
    for seed, k in ((0, 3), (9, len(actives))):
        want = list(actives)
        random.Random(seed).shuffle(want)
        got = references.sample_labeled(labels, "T1", k, seed).orderBy("ref_order").toPandas()
        assert got["parent_id"].tolist() == want[:k]
    for k in (0, len(actives) + 1):
        with pytest.raises(ValueError):
            references.sample_labeled(labels, "T1", k)
    with pytest.raises(ValueError):
        references.from_ids(labels, "T", [])


def test_selection_and_pool_errors(spark, sf):
    lib = views.library(spark, sf)
    wanted = spark.createDataFrame([("T0", "nobody")], "target_id string, parent_id string")
    with pytest.raises(KeyError):
        references.select_parents(lib, wanted)
    with pytest.raises(ValueError):
        references.select_parents(lib, wanted.limit(0))
    own = lib.where("target_id = 'T0'")
    pool = own.limit(3).drop("target_id")
    with pytest.raises(ValueError):
        references.materialize_external(own, pool, "T0")
    with pytest.raises(ValueError):
        references.materialize_external(own, pool.limit(0), "T0")
    other = pool.withColumn("parent_id", F.concat(F.lit("n"), "parent_id"))
    with pytest.raises(ValueError):
        references.materialize_external(own, other.withColumn("embedding", F.slice("embedding", 1, 3)), "T0")
    with pytest.raises(ValueError):
        references.validate_pool(other.withColumn("n_conf", F.lit(77)))


def test_split_errors(spark):
    mols = spark.createDataFrame([("T", i, f"m{i}") for i in range(4)], "target_id string, parent_pos long, parent_id string")
    refs = spark.createDataFrame([("T", 0, 1, "m0")], "target_id string, seed int, k int, parent_id string")
    series = spark.createDataFrame([("T", "m1", "a")], "target_id string, parent_id string, series_id string")
    with pytest.raises(KeyError):
        splits.episode_members(mols, refs, "series-disjoint", series)
    with pytest.raises(ValueError):
        splits.episode_members(mols, refs, "series-disjoint", series.where("false"))
    with pytest.raises(ValueError):
        splits.episode_members(mols, refs, "other")
    with pytest.raises(ValueError):
        splits.restrict_targets(refs, ["nope"])


def stored(path, reader="csv"):
    parts = sorted(Path(path).rglob("part-*"))
    frames = [pd.read_csv(p) for p in parts if p.stat().st_size]
    return pd.concat(frames, ignore_index=True)


@pytest.fixture()
def quiet(monkeypatch):
    """Keep the shared session and its tables when a command ends."""
    monkeypatch.setattr(cli, "clear_tables", lambda spark: None)


def test_command_line_round_trip(spark, tmp_path, quiet, capsys):
    theta = tmp_path / "theta.json"
    theta.write_text(json.dumps({n: getattr(views.PARAMS, n) for n in views.PARAMS.__dataclass_fields__}))
    csv = tmp_path / "lib.csv"
    names = [f"m{i}" for i in range(30)]
    csv.write_text("parent_molecule_id,canonical_smiles\n" + "".join(f"{n},{'cno'[i % 3] * (1 + i % 5)}{n}\n" for i, n in enumerate(names)))
    tools = ["--toolkit", "test_sources:Toolkit", "--encoder", "test_sources:Encoder"]
    out = str(tmp_path / "cache")
    cli.main(["build-cache", "--molecules", str(csv), "--output", out, "--target", "L", "--conformers", "3", *tools])
    assert json.loads(capsys.readouterr().out)["molecules"] == 30
    cache.validate_cache(spark, out)
    with pytest.raises(Exception):
        cli.main(["build-cache", "--molecules", str(csv), "--output", out, *tools])
    cli.main(["fit-whitener", "--cache", out, "--output", str(tmp_path / "w")])
    assert json.loads(capsys.readouterr().out)["dimension"] == 3
    base = ["infer", "--cache", out, "--whitener", str(tmp_path / "w"), "--target", "L", "--theta", str(theta)]
    cli.main([*base, "--output", str(tmp_path / "r1"), "--reference-ids", "m3", "m7"])
    info = json.loads(capsys.readouterr().out)
    assert info["references"] == ["m3", "m7"] and info["ranked_molecules"] == 28 and info["library_molecules"] == 30
    ranking = stored(tmp_path / "r1")
    assert list(ranking.columns) == ["parent_molecule_id", "score", "similarity", "direct", "graph"]
    assert len(ranking) == 28 and ranking["score"].is_monotonic_decreasing
    pool = tmp_path / "pool.csv"
    pool.write_text("parent_molecule_id,canonical_smiles\nk1,cccq\nk2,nnz\n")
    cli.main(["build-reference-pool", "--molecules", str(pool), "--output", str(tmp_path / "p"), "--conformers", "2", *tools])
    assert json.loads(capsys.readouterr().out)["reference_conformers"] == 4
    cli.main([*base, "--output", str(tmp_path / "r2"), "--reference-pool", str(tmp_path / "p")])
    info = json.loads(capsys.readouterr().out)
    assert info["library_molecules"] == 32 and info["ranked_molecules"] == 30 and info["reference_mode"] == "external_actives"
    with pytest.raises(KeyError):
        cli.main([*base[:6], "nope", *base[7:], "--output", str(tmp_path / "r3"), "--reference-ids", "m3"])
    with pytest.raises(SystemExit):
        cli.main([*base, "--output", "x"])


def test_benchmark_command(spark, sf, tmp_path, quiet, capsys):
    root = tmp_path / "data" / "truedecoy"
    lib, labels, refs = views.library(spark, sf), views.labels(spark, sf), views.references(spark, sf)
    cache.write_cache(lib, str(root / "cache"), labels)
    cache.validate_cache(spark, str(root / "cache"))
    cache.validate_labels(cache.read_molecules(spark, str(root / "cache")), cache.read_labels(spark, str(root / "cache")))
    cache.write_whitener(spark, views.projection(), str(root / "whitener"))
    series = views.series(spark, sf)
    members = splits.episode_members(views.molecules(spark, sf), refs, "series-disjoint", series)
    counts = splits.member_counts(members, labels, "series-disjoint").toPandas()
    ids = refs.toPandas().sort_values("ref_order").groupby(["target_id", "seed", "k"])["parent_id"].apply(list).reset_index()
    table = ids.merge(counts, on=["target_id", "seed", "k"]).rename(columns={"k": "K", "excluded_count": "series_excluded_count"})
    table["support_parent_ids"] = table.pop("parent_id").map(json.dumps)
    folder = root / "splits" / "series_disjoint"
    folder.mkdir(parents=True)
    table.to_csv(folder / "episodes.csv", index=False)
    series.toPandas().rename(columns={"parent_id": "parent_molecule_id"}).to_csv(folder / "series_assignments.csv", index=False)
    theta = tmp_path / "theta.json"
    theta.write_text(json.dumps({n: getattr(views.PARAMS, n) for n in views.PARAMS.__dataclass_fields__}))
    common = ["benchmark", "--data-root", str(tmp_path / "data"), "--benchmark", "truedecoy", "--theta", str(theta), "--output-dir", str(tmp_path / "out")]
    cli.main([*common, "--split", "series-disjoint", "--k", "2", "--target", "T1"])
    text = capsys.readouterr().out
    lines = [json.loads(x) for x in text.splitlines() if x.startswith('{"')]
    assert lines[0]["target_id"] == "T1" and lines[0]["k"] == 2 and {"metric", "mean", "k"} <= set(lines[-1])
    made = next(tmp_path.glob("out-*"))
    summary = stored(made / "summary")
    assert summary["K"].tolist() == [2] and len(json.loads(summary["support_parent_ids"][0])) == 2
    scores = stored(made / "scores")
    assert scores["rank"].tolist() == list(range(1, len(scores) + 1)) and scores["score"].is_monotonic_decreasing
    assert len(scores) == summary["candidate_count"][0] and scores["label"].sum() == summary["positive_count"][0]
    for extra in (["--split", "ave", "--k", "1"], ["--split", "series-disjoint", "--k", "0"], ["--split", "series-disjoint", "--k", "1", "1"]):
        with pytest.raises(ValueError):
            cli.main([*common, *extra])
    with pytest.raises(ValueError):
        cli.main([*common, "--split", "series-disjoint", "--k", "2", "--target", "T9"])
    table["candidate_count"] += 1
    table.to_csv(folder / "episodes.csv", index=False)
    with pytest.raises(ValueError, match="split counts"):
        cli.main([*common, "--split", "series-disjoint", "--k", "1"])


def test_candidate_lists(spark, tmp_path):
    for target, kind, text in (("A", "active", "C a1\n"), ("A", "inactive", "C a2\nC a1\n"), ("B b", "active", "C b1\n"), ("B b", "inactive", "C b2\n")):
        path = tmp_path / target / f"{kind}_V.smi"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    got = tables.read_candidates(spark, str(tmp_path), ["A", "B b"]).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == [("A", "a1"), ("A", "a2"), ("B b", "b1"), ("B b", "b2")]


def test_array_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    raw = rng.normal(size=(9, 3)).astype(np.float32)
    (tmp_path / "src" / "embeddings").mkdir(parents=True)
    np.save(tmp_path / "src" / "embeddings" / "embeddings_000000.npy", raw[:4])
    np.save(tmp_path / "src" / "embeddings" / "embeddings_000001.npy", raw[4:])
    index = dict(
        target_ids=np.array(["A", "B"]), parent_offsets=np.array([0, 2, 4]), parent_ids=np.array(["a", "b", "c", "d"]),
        parent_starts=np.array([3, 0, 5, 3]), parent_counts=np.array([2, 3, 4, 2]), parent_labels=np.array([1, 0, 0, 1], dtype=np.int8),
    )
    np.savez(tmp_path / "src" / "index.npz", **index)
    cache.import_npz_cache(spark, str(tmp_path / "src"), str(tmp_path / "dst"))
    got = cache.read_conformers(spark, str(tmp_path / "dst")).toPandas()
    for p in range(4):
        own = got[got.parent_id == index["parent_ids"][p]].sort_values("pose_idx")
        begin, count = index["parent_starts"][p], index["parent_counts"][p]
        np.testing.assert_array_equal(np.stack(own["embedding"]), raw[begin : begin + count])
    labels = cache.read_labels(spark, str(tmp_path / "dst")).toPandas()
    assert dict(zip(labels["parent_id"], labels["label"])) == {"a": 1, "b": 0, "c": 0, "d": 1}
    np.savez(tmp_path / "src" / "index.npz", **{**index, "parent_starts": np.array([3, 0, 7, 3])})
    with pytest.raises(ValueError, match="outside"):
        cache.import_npz_cache(spark, str(tmp_path / "src"), str(tmp_path / "dst2"))
    np.savez(tmp_path / "pool.npz", parent_ids=np.array(["p", "q"]), parent_counts=np.array([1, 2]), raw_embeddings=raw[:3], canonical_smiles=np.array([], dtype=str))
    pool = cache.import_npz_pool(spark, str(tmp_path / "pool.npz"))
    assert pool.count() == 3 and pool.where("canonical_smiles is null").count() == 3
    cache.write_pool(pool, str(tmp_path / "pool"))
    assert cache.read_pool(spark, str(tmp_path / "pool")).count() == 3
