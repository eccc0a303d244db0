"""Conformer generation and encoding with user-supplied toolkits and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ENCODED = (
    "parent_pos bigint, parent_id string, canonical_smiles string, n_conf bigint, pose_idx int, embedding array<float>"
)


def encode_molecules(
    molecules: DataFrame,
    toolkit: Callable[[], object],
    encoder: Callable[[], object],
    conformers: int = 10,
    seed: int = 0,
    molecule_batch: int = 256,
    encoder_batch: int = 128,
) -> DataFrame:
    """One vector per generated conformer of (parent_pos, parent_id, canonical_smiles).

    ``toolkit().conformers(id, smiles, count, seed)`` returns conformer objects and
    ``encoder().encode(list)`` a matrix with one row for each. Both are made once per
    task. The seed does not depend on the batch, so partitioning changes nothing.
    """
    if conformers < 1:
        raise ValueError("at least one conformer per molecule is needed")
    if molecule_batch < 1 or encoder_batch < 1:
        raise ValueError("batch sizes must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools, model = toolkit(), encoder()
        for pdf in batches:
            for at in range(0, len(pdf), molecule_batch):
                yield _encode(pdf.iloc[at : at + molecule_batch], tools, model)

    def _encode(part: pd.DataFrame, tools, model) -> pd.DataFrame:
        shapes, counts = [], []
        for name, smiles in zip(part["parent_id"], part["canonical_smiles"]):
            made = list(tools.conformers(name, smiles, conformers, seed))
            if not made:
                raise RuntimeError(f"no conformers for {name}")
            shapes += made
            counts.append(len(made))
        pieces = [
            np.asarray(model.encode(shapes[s : s + encoder_batch]), dtype=np.float32)
            for s in range(0, len(shapes), encoder_batch)
        ]
        vectors = np.concatenate(pieces)
        if len(vectors) != len(shapes):
            raise ValueError("the encoder returned another number of rows than conformers")
        rows = part.loc[part.index.repeat(counts)]
        return pd.DataFrame(
            {
                "parent_pos": rows["parent_pos"].to_numpy(),
                "parent_id": rows["parent_id"].to_numpy(),
                "canonical_smiles": rows["canonical_smiles"].to_numpy(),
                "n_conf": np.repeat(counts, counts),
                "pose_idx": np.concatenate([np.arange(c, dtype=np.int32) for c in counts]),
                "embedding": list(vectors),
            }
        )

    spread = int(molecules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return molecules.select("parent_pos", "parent_id", "canonical_smiles").repartition(spread, "parent_id").mapInPandas(
        run, ENCODED
    )
