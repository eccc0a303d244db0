"""Ranking one target of a cache."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import from_ids, materialize_external, sample_labeled
from ..schema import Params
from ..sources import cache as store
from ..sources.sinks import write_ranking
from .scoring import score_library

# How a run names the origin of its references.
FROM_LABELS, FROM_IDS, FROM_POOL = "benchmark_actives", "cached_known_actives", "external_actives"


def infer(
    spark: SparkSession,
    cache: str,
    target: str,
    params: Params,
    projection: np.ndarray | None,
    sample: int | None = None,
    ids: list[str] | None = None,
    pool: DataFrame | None = None,
    seed: int = 0,
) -> tuple[DataFrame, dict]:
    """Scores of one target and a description of the run.

    Exactly one of ``sample`` (K labelled actives), ``ids`` and ``pool`` is given.
    """
    if sum(x is not None for x in (sample, ids, pool)) != 1:
        raise ValueError("give exactly one kind of references")
    molecules = store.read_molecules(spark, cache).where(F.col("target_id") == target)
    library_size = molecules.count()
    if library_size == 0:
        raise KeyError(f"target {target} is not in the cache")
    library = store.read_conformers(spark, cache, target)
    store.validate_library(molecules, library)
    if sample is not None:
        mode = FROM_LABELS
        refs = sample_labeled(store.read_labels(spark, cache), target, sample, seed)
    elif ids is not None:
        mode = FROM_IDS
        refs = from_ids(molecules, target, ids, seed)
    else:
        mode = FROM_POOL
        if projection is None:
            raise ValueError("an external pool needs a whitener")
        library, refs = materialize_external(library, pool, target, seed)
        library_size += refs.count()
    scores = score_library(library, refs, params, projection)
    info = {
        "target": target,
        "reference_mode": mode,
        "references": [r[0] for r in refs.orderBy("ref_order").select("parent_id").collect()],
        "library_molecules": library_size,
        "ranked_molecules": scores.count(),
    }
    return scores, info


def infer_to_csv(spark: SparkSession, output: str, **options) -> dict:
    scores, info = infer(spark, **options)
    write_ranking(scores, output)
    return {**info, "output": str(output)}
