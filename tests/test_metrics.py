import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conforank.operators import metrics as m


def brute(labels, scores):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    total, actives = len(labels), sum(labels)
    inactives = total - actives
    pairs = [(a, b) for a in range(total) for b in range(total) if labels[a] == 1 and labels[b] == 0]
    out = {
        "auc_roc": sum((scores[a] > scores[b]) + 0.5 * (scores[a] == scores[b]) for a, b in pairs) / len(pairs)
    }
    ap = 0.0
    curve = []
    for t in sorted(set(scores), reverse=True):
        hit = sum(l for l, s in zip(labels, scores) if s >= t)
        seen = sum(s >= t for s in scores)
        new = sum(l for l, s in zip(labels, scores) if s == t)
        ap += new / actives * hit / seen
        curve.append(((seen - hit) / inactives, hit / actives))
    out["auc_pr"] = ap
    last = 0
    for name, f in zip(("ef_0.5%", "ef_1%", "ef_5%"), (0.005, 0.01, 0.05)):
        last = max(math.ceil(total * f), last + 1)
        out[name] = sum(labels[i] for i in order[:last]) * total / (last * actives)
    for name, a in zip(("bedroc_20", "bedroc_80.5", "bedroc_85"), (20.0, 80.5, 85.0)):
        s = sum(math.exp(-a * (r + 1) / total) for r, i in enumerate(order) if labels[i])
        rie = s / (actives * (1 / total) * (1 - math.exp(-a)) / (math.exp(a / total) - 1))
        q = actives / total
        hi = (1 - math.exp(-a * q)) / (q * (1 - math.exp(-a)))
        lo = (1 - math.exp(a * q)) / (q * (1 - math.exp(a)))
        out[name] = (rie - lo) / (hi - lo)
    for name, f in zip(("bayes_ef_0.5%", "bayes_ef_1%", "bayes_ef_5%"), (0.005, 0.01, 0.05)):
        fpr, tpr = next(c for c in curve if c[0] >= f)
        out[name] = tpr / fpr
    return out


def frame(spark, groups):
    rows = [(g, i, float(s), int(l)) for g, (ls, ss) in groups.items() for i, (l, s) in enumerate(zip(ls, ss))]
    return spark.createDataFrame(rows, "g string, parent_pos long, score double, label int")


@pytest.mark.parametrize("window_rows", [1_000_000, 10])
def test_metrics_match_brute_force(spark, window_rows):
    rng = random.Random(3)
    groups = {"small": ([1, 0, 1, 0, 0], [5.0, 4.0, 4.0, 2.0, 1.0])}
    for name, n, levels in (("ties", 150, 12), ("plain", 240, 10**6), ("flat", 60, 1)):
        labels = [int(rng.random() < 0.2) for _ in range(n)]
        labels[0], labels[1] = 0, 1
        groups[name] = (labels, [float(rng.randrange(levels)) for _ in range(n)])
    groups["perfect"] = ([1] * 5 + [0] * 200, [float(-i) for i in range(205)])
    got = m.screening_metrics(frame(spark, groups).repartition(5), ["g"], window_rows=window_rows).toPandas()
    assert set(got["g"]) == set(groups)
    for row in got.to_dict("records"):
        want = brute(*groups[row["g"]])
        for name in m.METRICS:
            assert row[name] == pytest.approx(want[name], abs=1e-10), (row["g"], name)
    perfect = got[got.g == "perfect"].iloc[0]
    assert perfect["bedroc_20"] == pytest.approx(1.0) and perfect["auc_roc"] == 1.0


def test_metric_input_errors(spark):
    for groups in (
        {"one": ([1] * 9, range(9))},
        {"nan": ([1, 0, 1, 0, 0], [1, 2, float("nan"), 3, 4])},
        {"inf": ([1, 0, 1, 0, 0], [1, 2, float("inf"), 3, 4])},
        {"label": ([1, 0, 2, 0, 0], range(5))},
        {"tiny": ([1, 0, 0], range(3))},
    ):
        with pytest.raises(ValueError):
            m.screening_metrics(frame(spark, groups), ["g"])
    good = frame(spark, {"g": ([1, 0, 1, 0, 0], range(5))})
    with pytest.raises(ValueError):
        m.bayes_enrichment_factors(good, ["g"], (0.0,))
    with pytest.raises(ValueError):
        m.bayes_enrichment_factors(good, ["g"], (0.01,), require_measurable=True)
    assert m.bayes_enrichment_factors(good, ["g"], (0.5,), require_measurable=True).count() == 1


def test_macro_summary_skips_nan(spark):
    base = {n: 1.0 for n in m.METRICS}
    rows = [(1, *base.values()), (1, *{**base, "auc_pr": 3.0}.values()), (1, *{**base, "auc_pr": float("nan")}.values()), (2, *base.values())]
    df = spark.createDataFrame(rows, ["k", *m.METRICS])
    out = {(r["k"], r["metric"]): (r["mean"], r["std"]) for r in m.macro_summary(df, ["k"]).collect()}
    assert out[1, "auc_pr"] == (2.0, pytest.approx(math.sqrt(2)))
    assert out[2, "auc_pr"][0] == 1.0 and math.isnan(out[2, "auc_pr"][1])


@pytest.mark.parametrize("window_rows", [1_000_000, 3])
def test_ranks(spark, window_rows):
    from conforank.operators.ranking import number_rows, rank_rows

    scores = [1.0, float("nan"), 3.0, 3.0, -2.0, 0.0, 3.0]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(scores)] + [("b", 0, 1.0)], "g string, parent_pos long, score double")
    out = rank_rows(df, ["g"], window_rows=window_rows).where("g = 'a'").toPandas().sort_values("rank")
    assert out["parent_pos"].tolist() == [2, 3, 6, 0, 5, 4, 1]
    assert out["rank"].tolist() == list(range(1, 8))
    many = spark.range(500).repartition(9)
    numbered = number_rows(many, [F.desc("id")], "n", window_rows=window_rows).toPandas()
    assert np.array_equal(numbered["n"], 499 - numbered["id"])


def test_labels_must_be_complete(spark):
    from conforank.sources import cache

    molecules = spark.createDataFrame([("T", "a"), ("T", "b")], "target_id string, parent_id string")
    given = lambda *rows: spark.createDataFrame([("T", *r) for r in rows], "target_id string, parent_id string, label int")
    cache.validate_labels(molecules, given(("a", 1), ("b", 0), ("c", 5)))
    for rows in ([("a", 1)], [("a", 1), ("b", 0), ("b", 0)], [("a", 1), ("b", 2)], [("a", 1), ("b", None)]):
        with pytest.raises(ValueError, match="labels"):
            cache.validate_labels(molecules, given(*rows))


def test_vectors_must_be_finite():
    import pyarrow as pa

    from conforank.functions.arrow import to_matrix

    assert to_matrix(pa.array([[1.0, 2.0]])).shape == (1, 2)
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            to_matrix(pa.array([[1.0, bad]]))
