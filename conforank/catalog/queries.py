"""Registered queries: name -> (Spark function of (spark, folder), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, l2_normalize, scale, zscore
from ..operators import graph as g
from ..operators import episodes, means, metrics, ranking, references, similarity, splits, topk, whitening
from ..plans import scoring
from ..plans.benchmark import evaluate
from ..schema import EPISODE_KEY
from ..sources import cache, tables
from ..storage import write_table
from . import duck, views
from .roundtrips import ENTRIES
from .views import PARAMS

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

EP = "target_id, seed, k"


def register(sql: str | None):
    def add(function: Query) -> Query:
        REGISTRY[function.__name__] = (function, sql)
        return function

    return add


def six(name: str, alias: str | None = None):
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(alias or name)


def long(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("i", "x")).select(*keys, "i", six("x"))


def long_sql(steps: list, source: str, keys: str, vector: str = "v") -> str:
    return duck.sql(
        steps,
        f"SELECT {keys}, i::INT AS i, {duck.r6('x')} FROM "
        f"(SELECT {keys}, unnest({vector}) AS x, unnest(range(len({vector}))) AS i FROM {source})",
    )


def normed(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(views.library(spark, sf), None)


def centers(spark: SparkSession, sf: str) -> DataFrame:
    return write_table(means.molecule_centers(normed(spark, sf)), "centers")


BASE, LIB = duck.BASE, duck.PLAIN_LIB
NORMED = [*BASE, *LIB, *duck.NORMED]


# -- vectors ----------------------------------------------------------------------


@register(
    duck.sql(
        BASE,
        f"SELECT a.target_id, a.parent_pos, a.pose_idx, {duck.r6('list_dot_product(a.v, b.v)', 'dot')} "
        "FROM base a JOIN base b USING (target_id, parent_pos) WHERE b.pose_idx = 0",
    )
)
def vec_dot(spark, sf):
    rows = views.library(spark, sf).withColumn("v", doubles("embedding"))
    first = rows.where("pose_idx = 0").select("target_id", "parent_pos", F.col("v").alias("first"))
    both = rows.join(first, ["target_id", "parent_pos"]).withColumn("dot", dot(F.col("v"), F.col("first")))
    return both.select("target_id", "parent_pos", "pose_idx", six("dot"))


@register(
    long_sql(
        [*BASE, ("scaled", "SELECT vec_id, list_transform(v, lambda x: x * vec_id) AS v FROM base"),
         ("unit", f"SELECT vec_id, {duck.UNIT.format('v')} AS v FROM scaled")],
        "unit", "vec_id",
    )
)
def vec_l2_normalize(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    unit = l2_normalize(scale(doubles("embedding"), F.col("vec_id").cast("double")))
    return long(rows.select("vec_id", unit.alias("v")), ["vec_id"], "v")


@register(duck.sql([*BASE, *LIB, *duck.MEANS], f"SELECT target_id, parent_pos, n AS n_conf, i::INT AS i, {duck.r6('x')} FROM mol"))
def molecule_means(spark, sf):
    return long(means.molecule_means(views.library(spark, sf)), ["target_id", "parent_pos", "n_conf"], "mean")


@register(long_sql([*BASE, *LIB, *duck.MEANS], "tmean", "target_id", "m"))
def balanced_mean(spark, sf):
    return long(means.balanced_means(means.with_counts(views.library(spark, sf))), ["target_id"], "mean")


@register(long_sql([*NORMED, *duck.CENTERS], "centers", "target_id, parent_pos"))
def molecule_centers(spark, sf):
    return long(means.molecule_centers(normed(spark, sf)), ["target_id", "parent_pos"], "center")


@register(long_sql([*BASE, *LIB, *duck.IDENTITY], "white", "target_id, parent_pos, pose_idx"))
def center_normalize(spark, sf):
    white = whitening.whiten(views.library(spark, sf), np.eye(64))
    return long(white, ["target_id", "parent_pos", "pose_idx"], "embedding")


@register(long_sql([*BASE, *LIB, *duck.PROJECTED], "white", "target_id, parent_pos, pose_idx"))
def whiten_apply(spark, sf):
    white = whitening.whiten(views.library(spark, sf), views.projection())
    return long(white, ["target_id", "parent_pos", "pose_idx"], "embedding")


# -- whitener ---------------------------------------------------------------------

COV = [
    *BASE, *LIB, *duck.MEANS,
    ("cov", """SELECT a.target_id, a.i, b.i AS j, covar_pop(a.x, b.x) AS c
               FROM mol a JOIN mol b USING (target_id, parent_pos) GROUP BY ALL"""),
    ("macro", "SELECT i, j, avg(c) AS c FROM cov GROUP BY ALL"),
]


@register(duck.sql(COV, f"SELECT target_id, i::INT AS i, j::INT AS j, {duck.r6('c')} FROM cov"))
def covariance_pop(spark, sf):
    cov = whitening.covariance_by_target(views.library(spark, sf))
    return cov.select("target_id", "i", "j", six("c"))


@register(
    duck.sql(
        COV,
        "SELECT i::INT AS i, j::INT AS j, round(0.9::DOUBLE * c + CASE WHEN i = j THEN 0.1::DOUBLE * "
        "(SELECT avg(c) FROM macro WHERE i = j) ELSE 0 END, 6) + 0.0 AS c FROM macro",
    )
)
def covariance_macro_shrunk(spark, sf):
    cov, _ = whitening.macro_covariance(views.library(spark, sf))
    return whitening.shrink(cov, 0.1).select("i", "j", six("c"))


@register(
    duck.sql(
        COV,
        "SELECT a.i::INT AS i, b.i::INT AS j, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END::DOUBLE AS v "
        "FROM (SELECT DISTINCT i FROM macro) a, (SELECT DISTINCT i FROM macro) b",
    )
)
def fit_whitener_identity(spark, sf):
    """The fitted projection turns the shrunk covariance plus eps into the identity."""
    eps = 1e-5
    cov, info = whitening.macro_covariance(views.library(spark, sf))
    matrix = whitening.projection_from(cov, 0.01, eps).astype(np.float64)
    dense = whitening.from_long(whitening.shrink(cov, 0.01), "c") + eps * np.eye(info["dimension"])
    check = matrix @ dense @ matrix
    return whitening.to_long(spark, np.round(check, 4) + 0.0, "v")


# -- graph ------------------------------------------------------------------------

GRAPH = [*NORMED, *duck.GRAPH]


@register(duck.sql(GRAPH, f"SELECT target_id, src, dst, {duck.r6('sim')} FROM knn"))
def knn_edges(spark, sf):
    return topk.knn(centers(spark, sf), PARAMS.graph_neighbors).select("target_id", "src", "dst", six("sim"))


@register(duck.sql(GRAPH, "SELECT target_id, dst, indegree FROM degree"))
def knn_indegree(spark, sf):
    return g.indegree(topk.knn(centers(spark, sf), PARAMS.graph_neighbors))


@register(duck.sql(GRAPH, f"SELECT target_id, src, dst, {duck.r6('w')} FROM edge"))
def knn_weights(spark, sf):
    return _graph(spark, sf).edges.select("target_id", "src", "dst", six("w"))


def _graph(spark, sf):
    return g.build_graph(
        centers(spark, sf), PARAMS.graph_neighbors, PARAMS.graph_temperature, PARAMS.graph_indegree_exponent
    )


def _walk(spark, sf, steps):
    import dataclasses

    params = dataclasses.replace(PARAMS, graph_propagation_steps=steps)
    walk = scoring.graph_scores(centers(spark, sf), views.references(spark, sf), params)
    # States that are exactly 0 may be absent.
    return walk.where("walk <> 0").select(
        *EPISODE_KEY, "parent_pos", (F.round(F.col("walk"), 9) + F.lit(0.0)).alias("walk")
    )


def _walk_sql(steps):
    return duck.sql(
        [*GRAPH, *duck.walk(steps)], f"SELECT {EP}, parent_pos, round(walk, 9) + 0.0 AS walk FROM walk WHERE walk <> 0"
    )


@register(_walk_sql(1))
def rwr_step1(spark, sf):
    return _walk(spark, sf, 1)


@register(_walk_sql(9))
def rwr_9(spark, sf):
    return _walk(spark, sf, 9)


# -- similarity and scoring -------------------------------------------------------

POSE = [*NORMED, *duck.POSE]


@register(duck.sql(POSE, f"SELECT {EP}, parent_pos, pose_idx, {duck.r6('similarity')} FROM pose"))
def topk_mean_similarity(spark, sf):
    return _pose(spark, sf).select(*EPISODE_KEY, "parent_pos", "pose_idx", six("similarity"))


def _pose(spark, sf):
    return similarity.pose_similarity(
        normed(spark, sf), views.references(spark, sf),
        PARAMS.max_reference_conformers, PARAMS.support_similarity_topk,
    )


@register(duck.sql(POSE, "SELECT DISTINCT target_id, parent_id, pose_idx FROM support"))
def first_m_conformers(spark, sf):
    rows = similarity.reference_rows(
        views.library(spark, sf), views.references(spark, sf), PARAMS.max_reference_conformers
    )
    return rows.select("target_id", "parent_id", "pose_idx")


@register(duck.sql([*POSE, *duck.POOLED], f"SELECT {EP}, parent_pos, {duck.r6('similarity')} FROM pool"))
def max_pool(spark, sf):
    pooled = similarity.pool_poses(_pose(spark, sf))
    return pooled.select(*EPISODE_KEY, "parent_pos", six("hi", "similarity"))


@register(duck.sql([*POSE, *duck.POOLED], f"SELECT {EP}, parent_pos, pose_idx, {duck.r6('z')} FROM zpose"))
def zscore_pose(spark, sf):
    pose = write_table(_pose(spark, sf), "pose")
    stats = pose.groupBy(*EPISODE_KEY).agg(F.avg("similarity").alias("m"), F.stddev_samp("similarity").alias("sd"))
    rows = pose.join(F.broadcast(stats), EPISODE_KEY)  # one row per episode
    return rows.withColumn("z", zscore(F.col("similarity"), F.col("m"), F.col("sd"))).select(
        *EPISODE_KEY, "parent_pos", "pose_idx", six("z")
    )


SCORE_COLUMNS = ["score", "similarity", "direct", "graph"]
SCORE_SQL = f"SELECT {EP}, parent_pos, parent_id, " + ", ".join(duck.r6(c) for c in SCORE_COLUMNS) + " FROM scores"


def _scores(spark, sf, projection=None):
    return scoring.score_library(views.library(spark, sf), views.references(spark, sf), PARAMS, projection)


def _rounded(scores):
    return scores.select(*EPISODE_KEY, "parent_pos", "parent_id", *[six(c) for c in SCORE_COLUMNS])


@register(duck.sql(duck.scoring(duck.NORMED), SCORE_SQL))
def score_library(spark, sf):
    return _rounded(_scores(spark, sf))


@register(duck.sql(duck.scoring(duck.PROJECTED), SCORE_SQL))
def score_library_whitened(spark, sf):
    return _rounded(_scores(spark, sf, views.projection()))


@register(
    duck.sql(
        duck.scoring(duck.IDENTITY),
        f"SELECT {EP}, parent_id, row_number() OVER (PARTITION BY {EP} ORDER BY isnan(score), score DESC, parent_pos) AS rank, "
        f"{duck.r6('score')} FROM scores",
    )
)
def rank_library(spark, sf):
    return ranking.rank_rows(_scores(spark, sf, np.eye(64)), EPISODE_KEY).select(*EPISODE_KEY, "parent_id", "rank", six("score"))


# -- selections, references, splits -------------------------------------------------


@register(
    duck.sql(BASE, "SELECT b.target_id, b.parent_pos, b.parent_id, b.pose_idx FROM base b JOIN actives a USING (target_id, parent_id) WHERE a.label = 1")
)
def get_subset(spark, sf):
    chosen = views.labels(spark, sf).where("label = 1")
    rows = references.select_parents(views.library(spark, sf), chosen)
    return rows.select("target_id", "parent_pos", "parent_id", "pose_idx")


@register(duck.sql(BASE, "SELECT DISTINCT target_id FROM base"))
def target_listing(spark, sf):
    return references.targets(views.library(spark, sf))


MEMBER_COLUMNS = [*EPISODE_KEY, "parent_pos", "parent_id", "visible", "ranked"]


def candidates(spark, sf):
    refs = views.references(spark, sf).where(F.col("k") == max(views.KS))
    held = views.series(spark, sf).where("series_id = 's5'")
    keys = ["target_id", "parent_id"]
    pool = views.labels(spark, sf).select(*keys)
    return pool.join(refs, keys, "left_anti").join(held, keys, "left_anti")


def _members(spark, sf, split):
    return splits.episode_members(
        views.molecules(spark, sf), views.references(spark, sf), split,
        views.series(spark, sf) if split == "series-disjoint" else None,
        candidates(spark, sf) if split == "ave" else None,
    )


def _members_sql(split):
    return duck.sql([*BASE, *duck.members(split)], f"SELECT {', '.join(MEMBER_COLUMNS)} FROM members")


@register(_members_sql("molecule-random"))
def split_random(spark, sf):
    return _members(spark, sf, "molecule-random")


@register(_members_sql("series-disjoint"))
def split_series(spark, sf):
    return _members(spark, sf, "series-disjoint")


@register(_members_sql("ave"))
def split_candidates(spark, sf):
    return _members(spark, sf, "ave")


@register(duck.sql([*BASE, *duck.members("series-disjoint")], duck.counts("series-disjoint")))
def episode_counts(spark, sf):
    return splits.member_counts(_members(spark, sf, "series-disjoint"), views.labels(spark, sf), "series-disjoint")


EPISODE_MEANS = [
    *[("refs0" if n == "refs" else n, t) for n, t in BASE],
    *[(n, t.replace("FROM refs ", "FROM refs0 ")) for n, t in duck.members("series-disjoint")],
    *duck.EPISODE_LIB, *duck.MEANS,
]


@register(long_sql(EPISODE_MEANS, "tmean", "target_id", "m"))
def subset_recenter(spark, sf):
    """Means of the episode libraries, which are what re-centring subtracts, by bitmaps of what each shows."""
    members = _members(spark, sf, "series-disjoint")
    return _episode_means(spark, sf, members, episodes.episode_masks(members))


def _episode_means(spark, sf, members, masks):
    rows = episodes.episode_means(views.library(spark, sf), members, masks)
    return long(rows.withColumn("target_id", splits.library_name()), ["target_id"], "mean")


@register(long_sql(EPISODE_MEANS, "tmean", "target_id", "m"))
def subset_recenter_algebra(spark, sf):
    """The same from the sums of targets and of hidden molecules, for libraries whose bitmaps are too large to send."""
    return _episode_means(spark, sf, _members(spark, sf, "series-disjoint"), None)


@register(
    duck.sql(
        BASE,
        """SELECT 'T0' AS target_id, parent_pos, parent_id, pose_idx FROM base WHERE target_id = 'T0'
           UNION ALL
           SELECT 'T0', parent_pos + 1 + (SELECT max(parent_pos) FROM base WHERE target_id = 'T0'), parent_id, pose_idx
           FROM base WHERE target_id = 'T1'""",
    )
)
def external_refs_union(spark, sf):
    """The second target as an external pool of the first."""
    library = views.library(spark, sf)
    pool = library.where("target_id = 'T1'").drop("target_id")
    rows, _ = references.materialize_external(library.where("target_id = 'T0'"), pool, "T0")
    return rows.select("target_id", "parent_pos", "parent_id", "pose_idx")


@register(duck.sql(BASE, "SELECT parent_id FROM actives WHERE label = 1"))
def collision_check(spark, sf):
    pool = views.labels(spark, sf).where("label = 1")
    return references.collisions(views.molecules(spark, sf), pool)


@register(duck.sql(BASE, "SELECT target_id, seed, k, ref_order, parent_id FROM refs"))
def first_actives(spark, sf):
    return views.references(spark, sf)


@register(
    duck.sql(BASE, "SELECT target_id, parent_id, 's' || CASE WHEN vec_id % 2 = 0 THEN pose_idx ELSE pose_idx + 1 END AS series_id "
             "FROM base QUALIFY row_number() OVER (PARTITION BY target_id, parent_id ORDER BY vec_id DESC) = 1")
)
def series_last_wins(spark, sf):
    rows = views.poses(spark, sf)
    vec = F.col("parent_pos") * 15 + F.col("pose_idx")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id")
    keyed = rows.select("target_id", "parent_id", "pose_idx", vec.alias("line"), _vec_id().alias("vec_id")).join(v, "vec_id")
    n = F.when(F.col("vec_id") % 2 == 0, F.col("pose_idx")).otherwise(F.col("pose_idx") + 1)
    return splits.latest_series(keyed.withColumn("series_id", F.format_string("s%d", n)))


def _vec_id():
    """Inverse of the position rule of ``views.poses``."""
    member, block = F.col("parent_pos") % 5, F.floor(F.col("parent_pos") / 5)
    first = (member * (member + 1) / 2).cast("bigint")
    return block * 15 + first + F.col("pose_idx")


@register(
    long_sql(
        [*BASE, ("counted", "SELECT *, count(*) OVER (PARTITION BY parent_pos) AS n_conf FROM base")],
        "counted", "target_id, parent_pos, parent_id, n_conf, pose_idx",
    )
)
def range_gather(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding")
    rows = views.poses(spark, sf).withColumn("row_id", _vec_id())
    ranges = rows.groupBy("target_id", "parent_pos", "parent_id").agg(
        F.min("row_id").alias("row_start"), F.count(F.lit(1)).alias("n_conf")
    )
    got = cache.gather_ranges(vectors, write_table(ranges, "ranges"))
    whole = got.withColumn("embedding", doubles("embedding"))
    return long(whole, ["target_id", "parent_pos", "parent_id", "n_conf", "pose_idx"], "embedding")


@register(duck.sql(BASE, "SELECT DISTINCT parent_id FROM base"))
def smi_ids(spark, sf):
    lines = views.poses(spark, sf).select(
        F.concat(F.lit(" C"), F.col("pose_idx").cast("string"), F.lit(" \t x "), "parent_id", F.lit("  ")).alias("value")
    )
    return tables.smi_ids(lines)


@register(duck.sql(BASE, "SELECT target_id, seed, k, ref_order, parent_id FROM refs"))
def json_refs(spark, sf):
    refs = views.references(spark, sf)
    cells = refs.groupBy(*EPISODE_KEY).agg(F.to_json(F.array_sort(F.collect_list("parent_id"))).alias("cell"))
    episodes = cells.withColumn("support_parent_ids", tables.parse_ids(F.col("cell")))
    return tables.episode_references(episodes)


# -- metrics ------------------------------------------------------------------------


def documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    q = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    return d.join(q, "doc_id").select(
        # Two groups that hold both classes at every scale.
        F.when(F.col("lang") == "en", "en").otherwise("other").alias("g"), F.col("doc_id").alias("pos"),
        F.col("n_chars").cast("double").alias("score"), F.col("quality").cast("int").alias("label"),
    )


def _metric(names):
    def run(spark, sf):
        out = metrics.screening_metrics(documents(spark, sf), ["g"], "pos")
        return out.select("g", *[(F.round(F.col(f"`{n}`"), 6) + F.lit(0.0)).alias(n) for n in names])

    return run


def _metric_sql(names):
    cols = ", ".join(f'round("{n}", 6) + 0.0 AS "{n}"' for n in names)
    return duck.sql([duck.DOCS, *duck.metric_steps()], f"SELECT g, {cols} FROM metrics")


for _name, _columns in {
    "auc_roc": ["auc_roc"],
    "auc_pr": ["auc_pr"],
    "enrichment": ["ef_0.5%", "ef_1%", "ef_5%"],
    "bedroc": ["bedroc_20", "bedroc_80.5", "bedroc_85"],
    "screening_metrics": list(metrics.METRICS),
}.items():
    REGISTRY[_name] = (_metric(_columns), _metric_sql(_columns))


BAYES_NAMES = {0.005: "bayes_ef_0.5%", 0.01: "bayes_ef_1%", 0.05: "bayes_ef_5%"}


@register(
    duck.sql(
        [duck.DOCS, *duck.metric_steps()],
        " UNION ALL ".join(f'SELECT g, {f}::DOUBLE AS fraction, round("{n}", 6) + 0.0 AS bayes_ef FROM metrics' for f, n in BAYES_NAMES.items()),
    )
)
def bayes_ef(spark, sf):
    out = metrics.bayes_enrichment_factors(documents(spark, sf), ["g"], tuple(BAYES_NAMES), position="pos")
    return out.select("g", "fraction", six("bayes_ef"))


@register(
    duck.sql(
        [duck.DOCS, *duck.metric_steps()],
        " UNION ALL ".join(
            f"SELECT '{n}' AS metric, round(avg(\"{n}\"), 6) + 0.0 AS mean, round(stddev_samp(\"{n}\"), 6) + 0.0 AS std FROM metrics"
            for n in metrics.METRICS
        ),
    )
)
def macro_summary(spark, sf):
    per_group = metrics.screening_metrics(documents(spark, sf), ["g"], "pos").withColumn("k", F.lit(1))
    return metrics.macro_summary(per_group, ["k"]).select("metric", six("mean"), six("std"))


# -- evaluation ---------------------------------------------------------------------


def _episodes(spark, sf, split):
    refs = views.references(spark, sf)
    saved = splits.member_counts(_members(spark, sf, split), views.labels(spark, sf), split)
    ids = refs.groupBy(*EPISODE_KEY).agg(F.array_sort(F.collect_list("parent_id")).alias("support_parent_ids"))
    return write_table(
        ids.join(saved, EPISODE_KEY).withColumnRenamed("excluded_count", "series_excluded_count"), "episodes"
    )


SUMMARY_COUNTS = ["visible_count", "candidate_count", "positive_count", "negative_count", "excluded_count"]


def _evaluation(split, projection):
    def run(spark, sf):
        _, summary = evaluate(
            views.library(spark, sf), views.molecules(spark, sf), views.labels(spark, sf),
            _episodes(spark, sf, split), split, PARAMS, projection,
            views.series(spark, sf) if split == "series-disjoint" else None,
            candidates(spark, sf) if split == "ave" else None,
        )
        return summary.select(
            *EPISODE_KEY, *SUMMARY_COUNTS,
            *[(F.round(F.col(f"`{n}`"), 6) + F.lit(0.0)).alias(n) for n in metrics.METRICS],
        )

    return run


def _evaluation_sql(split, prep):
    if split == "molecule-random":
        steps = [*duck.scoring(prep), *duck.members(split)]
        name = "s.target_id"
    else:
        steps, name = duck.episode_scoring(split, prep), "regexp_replace(s.target_id, '#.*', '')"
    steps = [
        *steps,
        ("counts", duck.counts(split)),
        ("scored", f"""SELECT {name} || '#' || s.seed || '#' || s.k AS g, s.parent_pos AS pos, s.score, a.label
                       FROM scores s JOIN actives a ON a.target_id = {name} AND a.parent_id = s.parent_id"""),
        *duck.metric_steps(),
    ]
    cols = ", ".join(f'round(m."{n}", 6) + 0.0 AS "{n}"' for n in metrics.METRICS)
    return duck.sql(
        steps,
        f"SELECT c.target_id, c.seed, c.k, {', '.join('c.' + c for c in SUMMARY_COUNTS)}, {cols} "
        "FROM counts c JOIN metrics m ON m.g = c.target_id || '#' || c.seed || '#' || c.k",
    )


REGISTRY["evaluate_random"] = (_evaluation("molecule-random", None), _evaluation_sql("molecule-random", duck.NORMED))
REGISTRY["evaluate_series"] = (
    _evaluation("series-disjoint", views.projection()), _evaluation_sql("series-disjoint", duck.PROJECTED)
)
REGISTRY["evaluate_candidates"] = (_evaluation("ave", np.eye(64)), _evaluation_sql("ave", duck.IDENTITY))


# -- readers, writers and checks ----------------------------------------------------

REGISTRY |= ENTRIES
