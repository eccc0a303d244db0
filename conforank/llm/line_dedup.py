"""Drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, carried, restored


def without(items: Column, drop: Column) -> Column:
    """``items`` without the sorted 0-based positions ``drop``: the runs between them, joined again."""
    ends = F.concat(drop, F.array(F.size(items)))
    runs = F.transform(
        ends,
        lambda end, i: F.slice(
            items,
            F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1) + 1,
            end - F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1),
        ),
    )
    return F.flatten(runs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    r"""Lines are split at \n; keys found in at least ``min_docs`` documents lose all their lines.

    A key is the line without white space at its ends, A-Z lower-cased; keys under ``min_chars``
    code points are never dropped. Returns the columns of ``docs`` with ``text`` cleaned,
    ``n_lines`` (before) and ``n_dropped``.

    Only hashes (96 bits) of the lines are shuffled to be counted and looked up; texts move
    once, to meet the positions dropped from them. A line held by a third of all documents is
    counted from distinct (line, document) pairs, which spread over all tasks, and is looked
    up by a sort-merge join whose large partitions AQE splits.

    Null and empty texts are one empty line. Documents are told apart by ``doc_id``: repeated
    rows count once, all rows without an id count as one document, and every row is returned.
    A line repeated inside a document counts once and is dropped at each place.
    """
    rows = carried(docs)
    key = F.btrim(F.col("_line"), F.lit(SPACE))
    lines = rows.select("_id", "_hash", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.withColumn("_key", ascii_lower(key)).where(F.length("_key") >= min_chars)
    lines = lines.select("_id", "_hash", "_pos", F.xxhash64("_key").alias("_k"), F.hash("_key").alias("_k2"))
    pairs = lines.select("_k", "_k2", "_id").distinct()
    common = pairs.groupBy("_k", "_k2").count().where(F.col("count") >= min_docs).drop("count")
    hits = lines.join(common, ["_k", "_k2"], "left_semi")
    hits = hits.groupBy(F.col("_id").alias("_hit"), F.col("_hash").alias("_hit_hash")).agg(
        F.sort_array(F.collect_set("_pos")).alias("_drop")
    )
    met = rows.join(hits, F.col("_id").eqNullSafe(F.col("_hit")) & (F.col("_hash") == F.col("_hit_hash")), "left")
    met = met.withColumn("_lines", F.split("_text", "\n", -1))
    text = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(
        F.array_join(without(F.col("_lines"), F.col("_drop")), "\n")
    )
    return restored(
        met,
        docs,
        text=text,
        n_lines=F.size("_lines").cast("long"),
        n_dropped=F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long"),
    )
