"""Running totals and rank numbers over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import attach, pin, write_table

# Largest group that one window task may hold.
WINDOW_ROWS = 1_000_000


def score_order(score: str = "score", position: str = "parent_pos") -> list[Column]:
    """Descending score, NaN last, ties in library order."""
    return [F.isnan(score).asc(), F.col(score).desc(), F.col(position).asc()]


def running_totals(
    df: DataFrame, by: list[str], order: list[Column], totals: dict[str, Column],
    largest_group: int | None = None, window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add inclusive running sums along ``order`` within ``by``.

    Groups known to fit a task use a plain window. Otherwise rows are range
    partitioned by (by, order), each range is summed on its own, and the sums of
    the ranges before it are added, so a group may span any number of tasks.
    """
    frame = (Window.unboundedPreceding, Window.currentRow)
    if largest_group is None:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else df.agg(F.count(F.lit(1)).alias("n"))
        largest_group = counts.agg(F.max("n")).first()[0] or 0
    if largest_group <= window_rows:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*frame)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in totals.items()])

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(totals)
    placed = df.select("*", *[c.alias(n) for n, c in totals.items()])
    placed = placed.repartitionByRange(ranges, *[F.col(c) for c in by], *order)
    # Written, because the ranges are sampled and must not change between uses.
    placed = write_table(placed.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    # At most one row per range and group it touches.
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in names]
    )
    offsets, fits = pin(offsets, 128 + 16 * len(names), "range-offsets")
    rows = attach(placed, offsets, [*by, "_range"], fits, ["_range"])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(*frame)
    kept = [c for c in df.columns]
    return rows.select(*kept, *[(F.sum(n).over(inside) + F.col(f"_{n}")).alias(n) for n in names])


def rank_rows(
    df: DataFrame, by: list[str], score: str = "score", position: str = "parent_pos",
    largest_group: int | None = None, window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``rank`` 1..n by descending score within ``by``."""
    one = {"rank": F.lit(1).cast("bigint")}
    return running_totals(df, by, score_order(score, position), one, largest_group, window_rows)


def number_rows(df: DataFrame, order: list[Column], name: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Add a dense 0-based row number over the whole table."""
    numbered = running_totals(df, [], order, {name: F.lit(1).cast("bigint")}, window_rows=window_rows)
    return numbered.withColumn(name, F.col(name) - 1)
