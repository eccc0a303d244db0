"""Column layouts, scoring parameters and input checks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key of one library, and of one set of references used against it.
LIBRARY_KEY = ["target_id"]
EPISODE_KEY = ["target_id", "seed", "k"]

CONFORMER_COLUMNS = ["target_id", "parent_pos", "parent_id", "n_conf", "pose_idx", "embedding"]

SEARCH_PRECISIONS = ("fp16", "fp32")


@dataclass(frozen=True)
class Params:
    """Scoring parameters. All arithmetic is done in double precision."""

    graph_neighbors: int
    graph_temperature: float
    graph_indegree_exponent: float
    graph_restart_probability: float
    graph_propagation_steps: int
    graph_weight: float
    max_reference_conformers: int
    support_similarity_topk: int
    similarity_weight: float = 1.0
    graph_search_precision: str = "fp32"

    def __post_init__(self) -> None:
        if self.graph_search_precision not in SEARCH_PRECISIONS:
            raise ValueError(
                f"graph_search_precision must be one of {', '.join(SEARCH_PRECISIONS)}"
            )

    @classmethod
    def from_dict(cls, values: dict) -> "Params":
        """Build from a mapping; unknown keys are ignored, integers truncated."""
        kinds = {
            name: {"int": int, "float": float, "str": str}[field.type]
            for name, field in cls.__dataclass_fields__.items()
        }
        optional = {"similarity_weight", "graph_search_precision"}
        absent = [n for n in kinds if n not in values and n not in optional]
        if absent:
            raise KeyError(f"parameters missing: {', '.join(sorted(absent))}")
        return cls(**{n: kind(values[n]) for n, kind in kinds.items() if n in values})

    @classmethod
    def from_json(cls, path: str | Path) -> "Params":
        return cls.from_dict(json.loads(Path(path).read_text()))


# The published scoring configuration.
PUBLISHED = Params(
    graph_neighbors=69,
    graph_temperature=0.22650207299094172,
    graph_indegree_exponent=0.09668681093234655,
    graph_restart_probability=0.15899843191942972,
    graph_propagation_steps=9,
    graph_weight=2.233284812475988,
    max_reference_conformers=7,
    support_similarity_topk=9,
    graph_search_precision="fp16",
)


def need_columns(df: DataFrame, columns: list[str], what: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks columns: {', '.join(absent)}")


def reject_if_any(df: DataFrame, error: type[Exception], message: str, show: Column) -> None:
    """Raise with up to five offending values when ``df`` has a row."""
    bad = [r[0] for r in df.select(show.cast("string")).limit(5).collect()]
    if bad:
        raise error(f"{message}: {', '.join(map(str, bad))}")


def reject_duplicates(df: DataFrame, keys: list[str], what: str) -> None:
    repeated = df.groupBy(*keys).count().where("count > 1")
    reject_if_any(repeated, ValueError, f"{what} must be unique", F.concat_ws("/", *keys))
