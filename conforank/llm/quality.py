"""Reject documents whose text statistics are outliers of their language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import write_table
from .common import SPACE, SPACES, let, unused

#: Chi-square points for five dimensions and the matching consistency factors.
SUBSET_SHARE = 0.75
SUBSET_FACTOR = 1.412
REWEIGHT_POINT = 12.833
REWEIGHT_FACTOR = 1.055
#: Squared distance above which a document is rejected (chi-square, five dimensions, 1 in 10^6).
REJECT_POINT = 35.89
#: Robust steps; each is one pass over the table of statistics.
STEPS = 4
#: Groups of fewer distinct vectors are pooled by language, then all together, then judged by the base rules only.
MIN_GROUP = 60
#: name -> (transformed statistic, standard deviation that is always allowed). Zero-heavy
#: statistics would otherwise get no variance from the central subset.
AXES = {
    "x0": (lambda: F.log1p("n_words"), 1.0),
    "x1": (lambda: F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), 0.08),
    "x2": (lambda: F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)), 0.04),
    "x3": (lambda: F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1)), 0.12),
    "x4": (lambda: F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 1)), 0.1),
}
NAMES = list(AXES)
P = len(NAMES)


def _repeat_words(grams: Column) -> Column:
    """Number of positions covered by equal 5-word windows, from their hashes in text order.

    Windows are sorted twice, by different bits of the hash with the position packed below;
    a window counts if it has an equal neighbour both times. Linear in memory, n log n in time,
    so a text of millions of words is no problem.
    """

    def flagged(keys: Column, bits: Column) -> Column:
        packed = F.sort_array(F.transform(keys, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))

        def marked(p: Column) -> Column:
            high = lambda v: F.call_function("shiftright", v, bits)
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            same = lambda v, j: F.coalesce(high(F.get(p, j)) == high(v), F.lit(False))
            hit = F.transform(p, lambda v, j: F.when(same(v, j - 1) | same(v, j + 1), v.bitwiseAND(mask)))
            return F.filter(hit, lambda x: x.isNotNull())

        return let(packed, marked)

    def covered(q: Column) -> Column:
        return F.aggregate(
            F.transform(q, lambda x, j: F.least(F.lit(5).cast("long"), F.coalesce(F.get(q, j + 1) - x, F.lit(5).cast("long")))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        )

    def count(g: Column) -> Column:
        bits = F.length(F.bin(F.size(g).cast("long")))
        both = F.array_intersect(flagged(g, bits), flagged(F.transform(g, lambda h: F.xxhash64(h)), bits))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(both), covered)
        )

    return let(grams, count)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` reduced to doc_id, lang, source and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))

    def of_words(w: Column) -> Column:
        starts = F.when(F.size(w) >= 5, F.sequence(F.lit(0), F.size(w) - 5)).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)]))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(grams).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    df = docs.select(
        "doc_id",
        "lang",
        "source",
        let(words, of_words).alias("_w"),
        let(lines, of_lines).alias("_l"),
        symbols.cast("long").alias("n_symbols"),
    )
    return df.select(
        "doc_id",
        "lang",
        "source",
        "_w.n_words",
        "_w.word_chars",
        "n_symbols",
        F.col("_l.dup").cast("long").alias("n_dup_lines"),
        "_w.n_repeat_words",
        F.col("_l.n").cast("long").alias("n_lines"),
    )


def _grouped(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Give each vector its group: (language, source), or a pool where that is too small."""
    exact = F.concat_ws("/", F.lit("s"), *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])
    pool = F.concat_ws("/", F.lit("l"), F.coalesce(F.concat(F.lit("="), F.col(keys[0]).cast("string")), F.lit("-")))
    sizes = write_table(vectors.groupBy(*keys).count(), "quality-sizes")
    small = sizes.where(F.col("count") < MIN_GROUP)
    pools = small.groupBy(keys[0]).agg(F.sum("count").alias("_pooled"))
    named = sizes.join(pools.select(F.col(keys[0]).alias("_p"), "_pooled"), F.col(keys[0]).eqNullSafe(F.col("_p")), "left")
    group = F.when(F.col("count") >= MIN_GROUP, exact).when(F.col("_pooled") >= MIN_GROUP, pool).otherwise("*")
    return named.select(*keys, group.alias("_g"))


def _distance(df: DataFrame) -> Column:
    """Squared Mahalanobis distance from the columns m<i> and l<i><j> (Cholesky factor)."""
    solved: list[Column] = []
    for i in range(P):
        rest = reduce(lambda a, b: a - b, [F.col(f"l{i}{j}") * solved[j] for j in range(i)], F.col(f"x{i}") - F.col(f"m{i}"))
        solved.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [y * y for y in solved])


def _fit(rows: DataFrame, factor: float, name: str) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group, with the allowed variances added."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(NAMES)],
        *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i, j in pairs],
    )
    extra = [AXES[x][1] ** 2 for x in NAMES]
    cov = sums.select(
        "_g",
        *[f"m{i}" for i in range(P)],
        *[
            ((F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (extra[i] if i == j else 0.0)).alias(f"c{i}{j}")
            for i, j in pairs
        ],
    )
    for j in range(P):  # one column of the factor after another; the table has one row a group
        under = lambda i: reduce(lambda a, b: a - b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"c{i}{j}"))  # noqa: B023, E731
        cov = cov.withColumn(f"l{j}{j}", F.sqrt(F.greatest(under(j), F.lit(extra[j]))))
        cov = cov.withColumns({f"l{i}{j}": under(i) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    return write_table(cov.select("_g", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in pairs]), name)


def _central(rows: DataFrame, score: Column) -> DataFrame:
    """The rows of each group whose score lies in the bins that hold the first three quarters.

    Scores are binned (0.5 % wide), so the threshold comes from counts, the same in any order
    of rows, and a group of any size needs no sort and no task of its own.
    """
    scored = rows.withColumn("_bin", F.floor(F.log1p(score) * 200))
    bins = scored.groupBy("_g", "_bin").count()
    upto = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_g")
    cut = bins.withColumn("_upto", F.sum("count").over(upto)).withColumn("_all", F.sum("count").over(whole))
    cut = cut.where(F.col("_upto") >= SUBSET_SHARE * F.col("_all")).groupBy("_g").agg(F.min("_bin").alias("_cut"))
    return scored.join(write_table(cut, "quality-cut"), "_g").where(F.col("_bin") <= F.col("_cut"))


def judge_quality(docs: DataFrame) -> DataFrame:
    """Text statistics of every document and the verdict of robust multivariate outlier rules.

    Returns doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    ``base_failed``, ``distance`` (squared Mahalanobis) and ``kept``.

    The statistics become five transformed coordinates (``AXES``). For each language and source
    a minimum-covariance-determinant estimate is made: start from medians and median deviations,
    then ``STEPS`` times take the three quarters of the vectors nearest by Mahalanobis distance
    and fit mean and covariance to them; a last fit uses all vectors within ``REWEIGHT_POINT``.
    Documents above ``REJECT_POINT`` are rejected. Equal vectors count once a group, so thousands
    of copies cannot become the centre. Groups of fewer than ``MIN_GROUP`` vectors are pooled by
    language, what is left over all together; below that size only the base rules judge.

    Everything is DataFrame functions. Texts are read once and never shuffled; a group is only
    ever aggregated, with partial sums, so a source with a third of all rows is no special case.
    Tables of one row a group are written, so Spark knows their size: it broadcasts them while
    they are small, and beyond that AQE splits the large side of the join.

    Null text has no words; null language or source is a value of its own; repeated rows each
    get the verdict of their text; an empty table gives an empty result.
    """
    stats = write_table(with_statistics(docs), "quality-stats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    placed = stats.withColumns({x: F.round(make(), 4) for x, (make, _) in AXES.items()}).withColumn("base_failed", failed)
    vectors = placed.where(~failed).select("lang", "source", *NAMES).distinct()
    vectors = write_table(vectors, "quality-vectors")
    groups = write_table(_grouped(vectors, ["lang", "source"]), "quality-groups")
    match = lambda df: df["lang"].eqNullSafe(F.col("_lang")) & df["source"].eqNullSafe(F.col("_source"))
    renamed = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_g")
    grouped = vectors.join(renamed, match(vectors)).drop("_lang", "_source", "lang", "source").distinct()
    grouped = write_table(grouped, "quality-grouped")

    centre = _medians(grouped, {x: F.col(x) for x in NAMES}, "m")
    near = grouped.join(centre, "_g")
    spread = _medians(near, {x: F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(NAMES)}, "s")
    near = near.join(spread, "_g")
    start = reduce(
        lambda a, b: a + b,
        [
            F.pow(F.col(x) - F.col(f"m{i}"), 2) / (F.pow(1.4826 * F.col(f"s{i}"), 2) + AXES[x][1] ** 2)
            for i, x in enumerate(NAMES)
        ],
    )
    plain = ["_g", *NAMES]
    fit = _fit(_central(near, start).select(*plain), SUBSET_FACTOR, "quality-fit0")
    for step in range(STEPS):
        scored = grouped.join(fit, "_g")
        fit = _fit(_central(scored, _distance(scored)).select(*plain), SUBSET_FACTOR, f"quality-fit{step + 1}")
    scored = grouped.join(fit, "_g")
    fit = _fit(scored.where(_distance(scored) <= REWEIGHT_POINT).select(*plain), REWEIGHT_FACTOR, "quality-fit-last")
    known = fit.join(grouped.groupBy("_g").count().where(F.col("count") >= MIN_GROUP).drop("count"), "_g", "left_semi")
    known = write_table(renamed.join(known, "_g"), "quality-known")
    judged = placed.join(known, match(placed), "left")
    judged = judged.withColumn("distance", _distance(judged))
    return judged.select(
        *stats.drop("n_lines").columns,
        "base_failed",
        "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= REJECT_POINT, F.lit(True))).alias("kept"),
    )


def _medians(rows: DataFrame, values: dict[str, Column], prefix: str) -> DataFrame:
    """Lower median of each value by group, from counts in bins of 0.01 (values are bounded, so bins are few)."""
    long = rows.select(
        "_g",
        F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.floor(v * 100).alias("bin")) for i, v in enumerate(values.values())])).alias("_b"),
    ).select("_g", "_b.axis", "_b.bin")
    bins = long.groupBy("_g", "axis", "bin").count()
    upto = Window.partitionBy("_g", "axis").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_g", "axis")
    cut = bins.withColumn("_upto", F.sum("count").over(upto)).withColumn("_all", F.sum("count").over(whole))
    cut = cut.where(2 * F.col("_upto") >= F.col("_all"))
    return write_table(
        cut.groupBy("_g").agg(
            *[F.min(F.when(F.col("axis") == i, (F.col("bin") + 0.5) / 100)).alias(f"{prefix}{i}") for i in range(P)]
        ),
        f"quality-median-{prefix}",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, columns unchanged.

    A document goes by its id: of rows that share one, all go if one is rejected (rows without
    an id count as sharing it).
    """
    verdicts = judge_quality(docs.select("doc_id", "text", "lang", "source"))
    mark = unused(docs, "bad")
    bad = write_table(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias(mark)).distinct(), "quality-rejected")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[mark]), "left_anti")
