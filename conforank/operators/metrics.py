"""Ranking metrics of labelled scores, grouped by any key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import reject_if_any
from ..storage import attach, pin
from .ranking import WINDOW_ROWS, running_totals

# Fractions, exponents and names of the reported metrics.
ENRICHMENT_FRACTIONS = (0.005, 0.01, 0.05)
BAYES_FRACTIONS = (0.005, 0.01, 0.05)
BEDROC_ALPHAS = (20.0, 80.5, 85.0)
METRICS = (
    "auc_roc",
    "auc_pr",
    "ef_0.5%",
    "ef_1%",
    "ef_5%",
    "bedroc_20",
    "bedroc_80.5",
    "bedroc_85",
    "bayes_ef_0.5%",
    "bayes_ef_1%",
    "bayes_ef_5%",
)


def class_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, actives, inactives and unusable values per group."""
    bad_score = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    bad_label = F.coalesce(~F.col("label").isin(0, 1), F.lit(True))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("label").cast("bigint")).alias("actives"),
        F.sum(bad_score.cast("bigint")).alias("bad_scores"),
        F.sum(bad_label.cast("bigint")).alias("bad_labels"),
    ).withColumn("inactives", F.col("total") - F.col("actives"))


def check_classes(counts: DataFrame, by: list[str]) -> None:
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    reject_if_any(counts.where("bad_scores > 0"), ValueError, "scores must be finite", key)
    reject_if_any(counts.where("bad_labels > 0"), ValueError, "labels must be 0 or 1", key)
    reject_if_any(
        counts.where("actives = 0 or inactives = 0"), ValueError, "both classes are needed", key
    )


def check_measurable(counts: DataFrame, by: list[str], fractions: tuple[float, ...]) -> None:
    """Every false-positive fraction is reachable with the inactives present."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    low = counts.where(F.lit(min(fractions)) < F.lit(1.0) / F.col("inactives"))
    reject_if_any(low, ValueError, "too few inactives for the requested fraction", key)


def check_fractions(fractions: tuple[float, ...]) -> None:
    if not fractions or any(not 0.0 < f <= 1.0 for f in fractions):
        raise ValueError("fractions must lie in (0, 1]")


def enrichment_cutoffs(total: Column, fractions: tuple[float, ...] = ENRICHMENT_FRACTIONS) -> list[Column]:
    """Rows counted for each fraction: its ceiling, but always past the one before."""
    cutoffs: list[Column] = []
    for fraction in fractions:
        wanted = F.ceil(total.cast("double") * F.lit(fraction))
        cutoffs.append(F.greatest(wanted, cutoffs[-1] + 1 if cutoffs else F.lit(1).cast("bigint")))
    return cutoffs


def check_enrichment(counts: DataFrame, by: list[str]) -> None:
    """The last cut-off must leave a row below it."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    tiny = counts.where(enrichment_cutoffs(F.col("total"))[-1] > F.col("total") - 1)
    reject_if_any(tiny, ValueError, "too few rows for the enrichment fractions", key)


def threshold_table(
    df: DataFrame, by: list[str], position: str, counts: DataFrame, fits: bool,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """One row per distinct score with cumulative counts and rank-based sums.

    Equal scores are merged by an aggregate with map-side combine, so a score shared
    by most rows is no hot spot. ``rank`` and ``hits`` are cumulative and include it.
    """
    largest = counts.agg(F.max("total")).first()[0] or 0
    rows = df.select(*by, position, (F.col("score") + F.lit(0.0)).alias("score"), F.col("label").cast("bigint").alias("label"))
    ranked = running_totals(
        rows, by, [F.col("score").desc(), F.col(position).asc()],
        {"rank": F.lit(1).cast("bigint"), "hits": F.col("label")}, largest, window_rows,
    )
    ranked = attach(ranked, counts.select(*by, "total", "actives", "inactives"), by, fits, [position])
    active = F.col("label") == 1
    share = F.col("rank") / F.col("total")
    sums = {
        f"top_{n}": F.sum(F.when(active & (F.col("rank") <= c), 1).otherwise(0))
        for n, c in enumerate(enrichment_cutoffs(F.col("total")))
    }
    sums |= {
        f"decay_{n}": F.sum(F.when(active, F.exp(F.lit(-a) * share)).otherwise(0.0))
        for n, a in enumerate(BEDROC_ALPHAS)
    }
    return ranked.groupBy(*by, "score").agg(
        F.first("total").alias("total"),
        F.first("actives").alias("actives"),
        F.first("inactives").alias("inactives"),
        F.max("rank").alias("rank"),
        F.max("hits").alias("hits"),
        F.sum("label").alias("new_hits"),
        F.count(F.lit(1)).alias("size"),
        *[expr.alias(name) for name, expr in sums.items()],
    )


def auc_roc() -> Column:
    """Share of (active, inactive) pairs in order, ties counting one half."""
    below = F.col("inactives") - (F.col("rank") - F.col("hits"))
    tied = F.col("size") - F.col("new_hits")
    pairs = F.first("actives").cast("double") * F.first("inactives")
    return F.sum(F.col("new_hits") * (below + 0.5 * tied)) / pairs


def auc_pr() -> Column:
    """Average precision with one step per distinct score."""
    return F.sum(F.col("new_hits") / F.col("actives") * F.col("hits") / F.col("rank"))


def enrichment(n: int) -> Column:
    total, actives = F.first("total"), F.first("actives")
    cutoff = F.first(enrichment_cutoffs(F.col("total"))[n])
    return F.sum(f"top_{n}") * total.cast("double") / (cutoff.cast("double") * actives)


def bedroc(n: int) -> Column:
    """Exponentially weighted early recognition, scaled between its extremes."""
    alpha = F.lit(BEDROC_ALPHAS[n])
    total, actives = F.first("total").cast("double"), F.first("actives").cast("double")
    ratio = actives / total
    uniform = (1 - F.exp(-alpha)) / (total * (F.exp(alpha / total) - 1))
    found = F.sum(f"decay_{n}") / (actives * uniform)
    best = (1 - F.exp(-alpha * ratio)) / (ratio * (1 - F.exp(-alpha)))
    worst = (1 - F.exp(alpha * ratio)) / (ratio * (1 - F.exp(alpha)))
    return F.when(best == worst, 1.0).otherwise((found - worst) / F.when(best != worst, best - worst))


def bayes_enrichment(fraction: float) -> Column:
    """TPR / FPR at the first whole threshold whose FPR reaches the fraction."""
    fpr = (F.col("rank") - F.col("hits")) / F.col("inactives")
    tpr = F.col("hits") / F.col("actives")
    reached = fpr >= fraction
    return F.min_by(F.when(reached, tpr / F.when(reached, fpr)), F.when(reached, F.col("rank")))


def metric_columns() -> dict[str, Column]:
    values = [auc_roc(), auc_pr()]
    values += [enrichment(n) for n in range(len(ENRICHMENT_FRACTIONS))]
    values += [bedroc(n) for n in range(len(BEDROC_ALPHAS))]
    values += [bayes_enrichment(f) for f in BAYES_FRACTIONS]
    return dict(zip(METRICS, values))


def screening_metrics(
    df: DataFrame, by: list[str], position: str = "parent_pos", window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """All metrics per group of (``by``, ``position``, ``score``, ``label``).

    Rank metrics break ties by ``position``; the others treat equal scores as one.
    """
    counts, fits = pin(class_counts(df, by), 256, "class-counts")
    check_classes(counts, by)
    check_enrichment(counts, by)
    table = threshold_table(df, by, position, counts, fits, window_rows)
    return table.groupBy(*by).agg(*[c.alias(n) for n, c in metric_columns().items()])


def bayes_enrichment_factors(
    df: DataFrame, by: list[str], fractions: tuple[float, ...] = BAYES_FRACTIONS,
    require_measurable: bool = False, position: str = "parent_pos",
) -> DataFrame:
    """Only the TPR / FPR ratios: (``by``, fraction, bayes_ef)."""
    check_fractions(fractions)
    counts, fits = pin(class_counts(df, by), 256, "class-counts")
    check_classes(counts, by)
    if require_measurable:
        check_measurable(counts, by, fractions)
    table = threshold_table(df, by, position, counts, fits)
    wide = table.groupBy(*by).agg(*[bayes_enrichment(f).alias(f"f{n}") for n, f in enumerate(fractions)])
    pairs = F.array(*[F.struct(F.lit(f).alias("fraction"), F.col(f"f{n}").alias("bayes_ef")) for n, f in enumerate(fractions)])
    return wide.select(*by, F.inline(pairs))


def macro_summary(summary: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of every metric over targets, NaN left out."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in METRICS])
    long = summary.select(*by, F.inline(pairs)).withColumn(
        "value", F.when(~F.isnan("value"), F.col("value"))
    )
    nan = F.lit(float("nan"))
    return long.groupBy(*by, "metric").agg(
        F.coalesce(F.avg("value"), nan).alias("mean"),
        F.coalesce(F.stddev_samp("value"), nan).alias("std"),
    )
