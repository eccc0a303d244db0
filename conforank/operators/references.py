"""Reference sets: cached IDs, labelled samples and external pools."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import EPISODE_KEY, need_columns, reject_duplicates, reject_if_any
from .means import with_counts
from .ranking import number_rows

REFERENCES = "target_id string, seed int, k int, ref_order int, parent_id string"


def from_ids(like: DataFrame, target_id: str, ids: list[str], seed: int = 0) -> DataFrame:
    """References already present in the library, in the order given."""
    if not ids:
        raise ValueError("no references given")
    rows = [(target_id, seed, len(ids), n, str(i)) for n, i in enumerate(ids)]
    return like.sparkSession.createDataFrame(rows, REFERENCES)


def sample_labeled(labels: DataFrame, target_id: str, k: int, seed: int = 0) -> DataFrame:
    """K actives of one target in the order of a seeded shuffle of their sorted IDs.

    The order must equal that of Python's generator. It depends only on how many
    actives there are, so the driver shuffles positions and fetches K IDs.
    """
    if k < 1:
        raise ValueError("K must be at least 1")
    own = labels.where((F.col("target_id") == target_id) & (F.col("label") == 1))
    actives = own.count()
    if actives < k:
        raise ValueError(f"target {target_id} offers {actives} actives but K={k}")
    places = list(range(actives))
    random.Random(seed).shuffle(places)
    numbered = number_rows(own.select("parent_id"), [F.col("parent_id")], "place")
    ids = dict(numbered.where(F.col("place").isin(places[:k])).select("place", "parent_id").collect())
    return from_ids(labels, target_id, [ids[p] for p in places[:k]], seed)


def sample_labeled_all(labels: DataFrame, ks: list[int]) -> DataFrame:
    """Per target the first K actives by ID, for every K at once.

    Only the K smallest IDs of a target survive the map side of the window limit.
    """
    order = Window.partitionBy("target_id").orderBy("parent_id")
    firsts = (
        labels.where("label = 1")
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= max(ks))
    )
    return firsts.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("n <= k").select(
        "target_id", F.lit(0).alias("seed"), "k", (F.col("n") - 1).alias("ref_order"), "parent_id"
    )


def check_references(refs: DataFrame, molecules: DataFrame) -> None:
    """References exist, are unique per episode and are present in the library."""
    need_columns(refs, [*EPISODE_KEY, "parent_id"], "references")
    if refs.isEmpty():
        raise ValueError("at least one reference is needed")
    key = ["target_id", "parent_id"]
    # Library rows are narrowed to referenced ones first, which needs no shuffle of them.
    found = molecules.select(*key, "parent_pos").join(refs.select(*key).distinct(), key, "left_semi")
    found = found.groupBy(*key).agg(F.count_distinct("parent_pos").alias("places"))
    uses = refs.groupBy(*EPISODE_KEY, "parent_id").count()
    problem = (
        F.when(F.col("places").isNull(), "absent").when(F.col("count") > 1, "repeated").when(F.col("places") > 1, "ambiguous")
    )
    bad = uses.join(found, key, "left").withColumn("problem", problem).where("problem is not null")
    # Up to five IDs of each kind, so that the kind reported does not depend on the order of rows.
    kinds = bad.groupBy("problem").agg(F.slice(F.array_sort(F.collect_set("parent_id")), 1, 5).alias("ids"))
    found_bad = {r["problem"]: ", ".join(r["ids"]) for r in kinds.collect()}
    if "absent" in found_bad:
        raise KeyError(f"references not in the library: {found_bad['absent']}")
    if "repeated" in found_bad:
        raise ValueError(f"reference IDs must be unique: {found_bad['repeated']}")
    if "ambiguous" in found_bad:
        raise ValueError(f"library IDs must be unique: {found_bad['ambiguous']}")


def validate_pool(pool: DataFrame) -> None:
    """External pool rows (parent_pos, parent_id, pose_idx, embedding) are consistent."""
    need_columns(pool, ["parent_pos", "parent_id", "pose_idx", "embedding"], "reference pool")
    if pool.isEmpty():
        raise ValueError("the reference pool is empty")
    owners = pool.select("parent_id", "parent_pos").distinct()
    reject_duplicates(owners, ["parent_id"], "reference pool IDs")
    if "n_conf" in pool.columns:
        wrong = pool.groupBy("parent_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n_conf").alias("n"))
        reject_if_any(
            wrong.where("n < 1 or rows <> n"), ValueError,
            "reference conformer counts differ from the vectors", F.col("parent_id"),
        )


def collisions(molecules: DataFrame, pool: DataFrame) -> DataFrame:
    """IDs present both in the library and in the external pool."""
    return molecules.select("parent_id").join(pool.select("parent_id").distinct(), "parent_id", "left_semi").distinct()


def union_external(conformers: DataFrame, pool: DataFrame, target_id: str) -> DataFrame:
    """Candidate rows followed by the pool rows, in library position order."""
    conformers, pool = with_counts(conformers), with_counts(pool.withColumn("target_id", F.lit(target_id)))
    last = conformers.agg(F.max("parent_pos")).first()[0]
    if last is None:
        raise ValueError("the candidate library is empty")
    moved = pool.withColumn("parent_pos", F.col("parent_pos") + F.lit(last + 1))
    columns = ["target_id", "parent_pos", "parent_id", "n_conf", "pose_idx", "embedding"]
    return conformers.select(*columns).unionByName(
        moved.select(*[F.col(c).cast(conformers.schema[c].dataType).alias(c) for c in columns])
    )


def materialize_external(conformers: DataFrame, pool: DataFrame, target_id: str, seed: int = 0):
    """Validated union of one target's library with an external pool, and its references."""
    validate_pool(pool)
    reject_if_any(
        collisions(conformers, pool), ValueError, "pool IDs already in the library", F.col("parent_id")
    )
    first, second = conformers.select(F.size("embedding")).first(), pool.select(F.size("embedding")).first()
    if first is not None and first[0] != second[0]:
        raise ValueError("pool and library embedding widths differ")
    names = pool.select("parent_pos", "parent_id").distinct()
    count = names.count()
    refs = names.select(
        F.lit(target_id).alias("target_id"), F.lit(seed).alias("seed"), F.lit(count).alias("k"),
        F.col("parent_pos").cast("int").alias("ref_order"), "parent_id",
    )
    return union_external(conformers, pool, target_id), refs


def select_parents(conformers: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of the selected (target_id, parent_id); unknown IDs are an error."""
    wanted = selected.select("target_id", "parent_id").distinct()
    absent = wanted.join(conformers.select("target_id", "parent_id"), ["target_id", "parent_id"], "left_anti")
    reject_if_any(absent, KeyError, "IDs not in the library", F.col("parent_id"))
    if wanted.isEmpty():
        raise ValueError("nothing selected")
    return conformers.join(wanted, ["target_id", "parent_id"], "left_semi").select(*conformers.columns)


def targets(conformers: DataFrame) -> DataFrame:
    return conformers.select("target_id").distinct().orderBy("target_id")
