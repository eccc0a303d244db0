"""Text inputs: episodes, series, ID lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EPISODE_KEY, need_columns, reject_if_any


def read_csv(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """CSV with a header, all columns strings; ``ordered`` adds the file order."""
    df = spark.read.csv(str(path), header=True, quote='"', escape='"', multiLine=True)
    return file_ordered(df) if ordered else df


def file_ordered(df: DataFrame) -> DataFrame:
    """Add ``line``, a sortable (file, split offset, position) order of a text scan."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", place.alias("line"))


def read_episodes(spark: SparkSession, path: str, seed: int, ks: list[int]) -> DataFrame:
    """Episodes of one seed and the given K with their references as an array."""
    raw = read_csv(spark, path)
    need_columns(
        raw,
        ["target_id", "seed", "K", "support_parent_ids", "candidate_count", "positive_count", "negative_count"],
        "episode table",
    )
    own = raw.where((F.col("seed").cast("int") == seed) & F.col("K").cast("int").isin(list(ks)))
    excluded = F.col("series_excluded_count") if "series_excluded_count" in raw.columns else F.lit("0")
    out = own.select(
        "target_id",
        F.col("seed").cast("int").alias("seed"),
        F.col("K").cast("int").alias("k"),
        parse_ids(F.col("support_parent_ids")).alias("support_parent_ids"),
        F.col("candidate_count").cast("bigint").alias("candidate_count"),
        F.col("positive_count").cast("bigint").alias("positive_count"),
        F.col("negative_count").cast("bigint").alias("negative_count"),
        excluded.cast("bigint").alias("series_excluded_count"),
    )
    check_episodes(out)
    return out


def parse_ids(column: Column) -> Column:
    """JSON list of identifiers to an array of strings."""
    return F.from_json(column, "array<string>")


def check_episodes(episodes: DataFrame) -> None:
    if episodes.isEmpty():
        raise ValueError("no episodes for this seed and these K")
    ids = F.col("support_parent_ids")
    wrong = ids.isNull() | (F.size(ids) != F.col("k")) | (F.size(F.array_distinct(ids)) != F.col("k"))
    reject_if_any(
        episodes.where(wrong), ValueError, "references do not match K",
        F.concat_ws("/", *[F.col(c).cast("string") for c in EPISODE_KEY]),
    )


def episode_references(episodes: DataFrame) -> DataFrame:
    return episodes.select(*EPISODE_KEY, F.posexplode("support_parent_ids").alias("ref_order", "parent_id"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Series assignments (target_id, parent_id, series_id, line) in file order."""
    raw = read_csv(spark, path, ordered=True)
    need_columns(raw, ["target_id", "parent_molecule_id", "series_id"], "series table")
    # An empty cell is a series of its own name, not a missing one.
    series = F.coalesce("series_id", F.lit("")).alias("series_id")
    return raw.select("target_id", F.col("parent_molecule_id").alias("parent_id"), series, "line")


def smi_fields(value: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def smi_ids(lines: DataFrame) -> DataFrame:
    """Distinct molecule IDs, the last field of each line of column ``value``."""
    return lines.select(F.element_at(smi_fields(F.col("value")), -1).alias("parent_id")).distinct()


def check_smi(lines: DataFrame) -> None:
    short = lines.where(F.size(smi_fields(F.col("value"))) < 2)
    reject_if_any(short, ValueError, "a structure and an ID are needed in", F.concat(F.lit("'"), "value", F.lit("'")))


def read_smi_ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.text([str(p) for p in paths])
    check_smi(lines)
    return smi_ids(lines)


def read_candidates(spark: SparkSession, root: str, targets: list[str]) -> DataFrame:
    """(target_id, parent_id) from ``<root>/<target>/{active,inactive}_V.smi``."""
    paths = [f"{root}/{t}/{kind}_V.smi" for t in targets for kind in ("active", "inactive")]
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    check_smi(lines)
    return lines.select(
        F.url_decode(F.element_at(F.split("file", "/"), -2)).alias("target_id"),
        F.element_at(smi_fields(F.col("value")), -1).alias("parent_id"),
    ).distinct()
