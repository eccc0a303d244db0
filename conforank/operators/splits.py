"""Which molecules an episode sees and ranks, under three split protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EPISODE_KEY, reject_if_any
from ..storage import attach, pin

SPLITS = ("molecule-random", "series-disjoint", "ave")
MEMBERS = [*EPISODE_KEY, "parent_pos", "parent_id", "visible", "ranked"]


def latest_series(assignments: DataFrame) -> DataFrame:
    """One series per molecule: the last assignment by ``line`` wins."""
    return assignments.groupBy("target_id", "parent_id").agg(F.max_by("series_id", "line").alias("series_id"))


def episode_sets(refs: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """References of each episode, and their series, as arrays."""
    if series is None:
        return refs.groupBy(*EPISODE_KEY).agg(F.collect_list("parent_id").alias("refs"))
    tagged = refs.join(series, ["target_id", "parent_id"], "left")
    reject_if_any(
        tagged.where("series_id is null"), KeyError, "references without a series", F.col("parent_id")
    )
    return tagged.groupBy(*EPISODE_KEY).agg(
        F.collect_list("parent_id").alias("refs"), F.collect_set("series_id").alias("ref_series")
    )


def episode_members(
    molecules: DataFrame, refs: DataFrame, split: str,
    series: DataFrame | None = None, candidates: DataFrame | None = None,
) -> DataFrame:
    """One row per episode and molecule with ``visible`` and ``ranked``.

    ``molecules``: (target_id, parent_pos, parent_id); ``series``: (target_id,
    parent_id, series_id); ``candidates``: (target_id, parent_id). Membership is a
    column test against the small reference arrays; molecules only meet series or
    candidates by their own key.
    """
    if split not in SPLITS:
        raise ValueError(f"split must be one of {', '.join(SPLITS)}")
    rows = molecules.select("target_id", "parent_pos", "parent_id")
    if split == "series-disjoint":
        if series is None:
            raise ValueError("series assignments are needed")
        unassigned = refs.select("target_id").distinct().join(
            series.select("target_id").distinct(), "target_id", "left_anti"
        )
        reject_if_any(unassigned, ValueError, "no series assignments for", F.col("target_id"))
        rows = rows.join(series, ["target_id", "parent_id"], "left")
    if split == "ave":
        if candidates is None:
            raise ValueError("candidate lists are needed")
        marked = candidates.select("target_id", "parent_id").distinct().withColumn("candidate", F.lit(True))
        rows = rows.join(marked, ["target_id", "parent_id"], "left")
    episodes, fits = pin(
        episode_sets(refs, series if split == "series-disjoint" else None), 2048, "episode-sets"
    )
    joined = attach(rows, episodes, ["target_id"], fits, ["parent_pos"])
    visible, ranked = _tests(split)
    return joined.withColumns({"visible": visible, "ranked": ranked}).select(*MEMBERS)


def _tests(split: str) -> tuple[Column, Column]:
    is_ref = F.array_contains("refs", F.col("parent_id"))
    if split == "molecule-random":
        return F.lit(True), ~is_ref
    if split == "series-disjoint":
        # A molecule without a series shares none.
        shares = F.coalesce(F.array_contains("ref_series", F.col("series_id")), F.lit(False))
        return is_ref | ~shares, ~is_ref & ~shares
    candidate = F.coalesce(F.col("candidate"), F.lit(False))
    return is_ref | candidate, candidate


def member_counts(members: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """Visible, candidate, positive, negative and excluded molecules per episode."""
    labelled = members.join(labels.select("target_id", "parent_id", "label"), ["target_id", "parent_id"], "left")
    ranked = F.col("ranked")
    positive = ranked & (F.col("label") == 1)
    excluded = F.count_if(~F.col("visible")) if split == "series-disjoint" else F.lit(0).cast("bigint")
    return labelled.groupBy(*EPISODE_KEY).agg(
        F.count_if("visible").alias("visible_count"),
        F.count_if(ranked).alias("candidate_count"),
        F.count_if(positive).alias("positive_count"),
        F.count_if(ranked & (F.col("label") == 0)).alias("negative_count"),
        excluded.alias("excluded_count"),
    )


def reconcile(counts: DataFrame, episodes: DataFrame) -> None:
    """Observed counts equal the saved ones, and both classes occur."""
    saved = episodes.select(
        *EPISODE_KEY,
        F.col("candidate_count").alias("c"), F.col("positive_count").alias("p"),
        F.col("negative_count").alias("n"), F.col("series_excluded_count").alias("x"),
    )
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in EPISODE_KEY])
    both = counts.join(saved, EPISODE_KEY, "full")
    observed = F.array("candidate_count", "positive_count", "negative_count", "excluded_count")
    expected = F.array("c", "p", "n", "x").cast("array<bigint>")
    reject_if_any(
        both.where(~observed.eqNullSafe(expected)), ValueError, "split counts differ from the saved ones",
        F.concat(key, F.lit(" observed "), F.to_json(observed), F.lit(" saved "), F.to_json(expected)),
    )
    reject_if_any(
        counts.where("positive_count = 0 or negative_count = 0"), ValueError, "both classes are needed", key
    )


def episode_libraries(conformers: DataFrame, members: DataFrame) -> DataFrame:
    """Rows visible to each episode under its own library name.

    The episode library is re-centred when scored, because it is a library of its own.
    """
    own = members.where("visible").select(
        "target_id", "parent_pos", library_name().alias("library")
    )
    joined = conformers.join(own, ["target_id", "parent_pos"])
    kept = [c for c in conformers.columns if c != "target_id"]
    return joined.select(F.col("library").alias("target_id"), *kept)


def library_name() -> Column:
    return F.concat_ws("#", F.col("target_id"), F.col("seed").cast("string"), F.col("k").cast("string"))


def restrict_targets(episodes: DataFrame, targets: list[str] | None) -> DataFrame:
    """Keep the requested targets; an unknown one is an error."""
    if not targets:
        return episodes
    found = {r[0] for r in episodes.where(F.col("target_id").isin(targets)).select("target_id").distinct().collect()}
    unknown = sorted(set(targets) - found)
    if unknown:
        raise ValueError(f"targets not available: {', '.join(unknown)}")
    return episodes.where(F.col("target_id").isin(targets))
