"""Columns named like working columns of the filtering stages."""

import pytest

pytest.importorskip("conforank.llm")

from pyspark.sql import functions as F

from conforank.llm import common, decontaminate, jaccard, quality

NAMES = ["_bad", "bad", "_gone", "_again", "_hit", "hit", "_place", "place", "mark", "MARK_", "_both", "_language"]


def test_unused_names(spark):
    docs = spark.range(1).select("id", F.lit(1).alias("Mark"), F.lit(1).alias("_mark"))
    assert common.unused(docs, "mark") == "__mark" and common.unused(docs, "hit") == "hit"


def test_filters_keep_clashing_columns(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (2, text + " more"), (2, text + " more"), (3, "another text " * 3 + " ".join(f"own{i}" for i in range(30))), (None, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in NAMES])
    items = spark.createDataFrame([(1, " ".join(f"own{i}" for i in range(30)))], "item_id long, text string")
    one = jaccard.keep_one(docs)
    assert one.columns == docs.columns and sorted((r.doc_id or 0, r._place) for r in one.collect()) == [(0, "_place"), (1, "_place"), (3, "_place")]
    clean = decontaminate.without_items(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {1, 2, None}
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {1, 2} <= {r.doc_id for r in good.collect()}
