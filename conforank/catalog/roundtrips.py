"""Queries that write the given data with our writers and read it back, and ones that find planted faults."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from ..operators import references, splits
from ..schema import EPISODE_KEY
from ..sources import cache, tables
from ..storage import work_folder
from . import duck, views

_serial = itertools.count()

CONFORMER_SQL = duck.sql(
    duck.BASE,
    f"""SELECT target_id, parent_pos, parent_id, count(*) OVER (PARTITION BY parent_pos) AS n_conf, pose_idx,
        {duck.r6('v[1]', 'x_first')}, {duck.r6('v[64]', 'x_last')} FROM base""",
)
INDEX_SQL = duck.sql(
    duck.BASE, "SELECT target_id, parent_pos, parent_id, count(*) AS n_conf FROM base GROUP BY ALL"
)
LABEL_SQL = duck.sql(duck.BASE, "SELECT target_id, parent_id, label FROM actives")
SERIES_SQL = duck.sql(duck.BASE, "SELECT target_id, parent_id, series_id FROM series")
REFS_SQL = duck.sql(duck.BASE, "SELECT target_id, seed, k, ref_order, parent_id FROM refs")
POOL_SQL = duck.sql(
    duck.BASE,
    f"SELECT parent_pos, parent_id, pose_idx, {duck.r6('v[1]', 'x_first')} FROM base WHERE target_id = 'T1'",
)
UNLABELLED_SQL = duck.sql(
    duck.BASE,
    """SELECT target_id, parent_id, CASE WHEN parent_pos % 7 = 0 THEN 'missing' ELSE 'repeated' END AS problem
       FROM actives WHERE parent_pos % 7 < 2""",
)
BROKEN_SQL = duck.sql(
    duck.BASE,
    """SELECT target_id, parent_id, CASE parent_pos % 11 WHEN 0 THEN 'not in the index' WHEN 1 THEN 'repeated ID'
              WHEN 2 THEN 'counts differ' END AS problem FROM actives WHERE parent_pos % 11 < 3""",
)


def place(spark) -> str:
    return f"{work_folder(spark)}/roundtrip-{next(_serial):04d}"


def _x(number: int, name: str):
    return (F.round(F.element_at("embedding", number).cast("double"), 6) + F.lit(0.0)).alias(name)


def stored(spark, sf) -> str:
    path = place(spark)
    cache.write_cache(views.library(spark, sf), path, views.labels(spark, sf))
    return path


def cache_scan(spark, sf):
    rows = cache.read_conformers(spark, stored(spark, sf))
    return rows.select("target_id", "parent_pos", "parent_id", "n_conf", "pose_idx", _x(1, "x_first"), _x(64, "x_last"))


def cache_index(spark, sf):
    return cache.read_molecules(spark, stored(spark, sf))


def cache_labels(spark, sf):
    return cache.read_labels(spark, stored(spark, sf))


def series_csv(spark, sf):
    path = place(spark)
    rows = views.series(spark, sf).withColumnRenamed("parent_id", "parent_molecule_id")
    rows.write.csv(path, header=True)
    return splits.latest_series(tables.read_series(spark, path))


def episodes_csv(spark, sf):
    path = place(spark)
    ids = views.references(spark, sf).groupBy(*EPISODE_KEY).agg(
        F.to_json(F.array_sort(F.collect_list("parent_id"))).alias("support_parent_ids")
    )
    counts = [F.lit(n).alias(c) for n, c in enumerate(("candidate_count", "positive_count", "negative_count"))]
    ids.select("target_id", "seed", F.col("k").alias("K"), "support_parent_ids", *counts).write.csv(
        path, header=True, quote='"', escape='"'
    )
    return tables.episode_references(tables.read_episodes(spark, path, 0, list(views.KS)))


def pool_scan(spark, sf):
    path = place(spark)
    cache.write_pool(views.library(spark, sf).where("target_id = 'T1'").drop("target_id"), path)
    return cache.read_pool(spark, path).select("parent_pos", "parent_id", "pose_idx", _x(1, "x_first"))


def unlabelled_detected(spark, sf):
    """Labels with gaps and repeats: every broken molecule is reported."""
    labels = views.labels(spark, sf)
    broken = labels.where("parent_pos % 7 <> 0").unionByName(labels.where("parent_pos % 7 = 1"))
    counted = broken.groupBy("target_id", "parent_id").agg(
        F.count(F.lit(1)).alias("given"), F.count_if(F.col("label").isin(0, 1)).alias("valid")
    )
    found = labels.select("target_id", "parent_id").join(counted, ["target_id", "parent_id"], "left")
    return cache.label_violations(found).select("target_id", "parent_id", "problem")


def violations_detected(spark, sf):
    """An index without some molecules, with some twice, and with wrong counts."""
    index, rows = views.molecules(spark, sf), views.library(spark, sf)
    at = F.col("parent_pos") % 11
    broken = index.where(at != 0).withColumn("n_conf", F.col("n_conf") + (at == 2).cast("int"))
    broken = broken.unionByName(index.where(at == 1))
    return cache.library_violations(broken, rows)


# The generator's order of n positions; the first three for every n the tables may have.
MOST_ACTIVES = 1000


def sampled_sql(target: str, k: int, seed: int) -> str:
    places = []
    for n in range(k, MOST_ACTIVES):
        order = list(range(n))
        random.Random(seed).shuffle(order)
        places += [f"({n},{i},{p})" for i, p in enumerate(order[:k])]
    steps = [
        *duck.BASE,
        ("own", f"""SELECT parent_id, row_number() OVER (ORDER BY parent_id) - 1 AS place, count(*) OVER () AS n
                    FROM actives WHERE target_id = '{target}' AND label = 1"""),
        ("places", f"SELECT * FROM (VALUES {','.join(places)}) t(n, ref_order, place)"),
    ]
    return duck.sql(
        steps,
        f"SELECT '{target}' AS target_id, {seed} AS seed, {k} AS k, ref_order, parent_id FROM own JOIN places USING (n, place)",
    )


def sample_labeled(spark, sf):
    """K actives in the order of a seeded shuffle."""
    return references.sample_labeled(views.labels(spark, sf), "T0", 3, 7)


ENTRIES = {
    "cache_scan": (cache_scan, CONFORMER_SQL),
    "cache_index": (cache_index, INDEX_SQL),
    "cache_labels": (cache_labels, LABEL_SQL),
    "series_csv": (series_csv, SERIES_SQL),
    "episodes_csv": (episodes_csv, REFS_SQL),
    "pool_scan": (pool_scan, POOL_SQL),
    "unlabelled_detected": (unlabelled_detected, UNLABELLED_SQL),
    "violations_detected": (violations_detected, BROKEN_SQL),
    "sample_labeled": (sample_labeled, sampled_sql("T0", 3, 7)),
}
