"""ANSI SQL for DuckDB, built from named steps over the registered tables."""

from __future__ import annotations

from .views import KS, PARAMS

POSES = """
SELECT 'T' || (pos % 2) AS target_id, pos AS parent_pos, 'mol_' || lpad(pos::VARCHAR, 6, '0') AS parent_id,
       (r - first)::INT AS pose_idx, v, label, vec_id
FROM (SELECT *, (vec_id // 15) * 5 + member AS pos FROM (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, vec_id % 15 AS r,
    CASE WHEN r < 1 THEN 0 WHEN r < 3 THEN 1 WHEN r < 6 THEN 2 WHEN r < 10 THEN 3 ELSE 4 END AS member,
    CASE WHEN r < 1 THEN 0 WHEN r < 3 THEN 1 WHEN r < 6 THEN 3 WHEN r < 10 THEN 6 ELSE 10 END AS first
  FROM embeddings))
"""
ACTIVES = "SELECT target_id, parent_pos, parent_id, (label = 0)::INT AS label FROM base WHERE pose_idx = 0"
SERIES = """
SELECT target_id, parent_id, 's' || last AS series_id FROM (
  SELECT target_id, parent_id, max_by(label, pose_idx) AS last, min_by(label, pose_idx) AS first FROM base GROUP BY ALL)
WHERE last <> 9 OR first = 0
"""
REFS = f"""
SELECT a.target_id, 0 AS seed, k.k::INT AS k, (a.n - 1)::INT AS ref_order, a.parent_id
FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY parent_id) AS n FROM actives WHERE label = 1) a
JOIN (SELECT unnest({KS}) AS k) k ON a.n <= k.k
"""
BASE = [("base", POSES), ("actives", ACTIVES), ("series", SERIES), ("refs", REFS)]

UNIT = "list_transform({0}, lambda x: x / greatest(sqrt(list_dot_product({0}, {0})), 1e-12))"
NORMED = [("white", f"SELECT * REPLACE ({UNIT.format('v')} AS v) FROM lib")]
MEANS = [
    ("dims", "SELECT target_id, parent_pos, parent_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM lib"),
    ("mol", "SELECT target_id, parent_pos, parent_id, i, avg(x) AS x, count(*) AS n FROM dims GROUP BY ALL"),
    ("tmean", "SELECT target_id, list(x ORDER BY i) AS m FROM (SELECT target_id, i, avg(x) AS x FROM mol GROUP BY ALL) GROUP BY ALL"),
]
SHIFT = "list_transform(list_zip(v, m), lambda p: p[1] - p[2])"
IDENTITY = [*MEANS, ("shifted", f"SELECT lib.* REPLACE ({SHIFT} AS v) FROM lib JOIN tmean USING (target_id)"),
            ("white", f"SELECT * REPLACE ({UNIT.format('v')} AS v) FROM shifted")]
PROJECTED = [
    *MEANS,
    ("pcol", """SELECT j, list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 0.25::DOUBLE / (1.0::DOUBLE + i + 2 * j) ORDER BY i) AS col
                FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) GROUP BY j"""),
    ("shifted", f"SELECT lib.* REPLACE ({SHIFT} AS v) FROM lib JOIN tmean USING (target_id)"),
    ("mapped", """SELECT target_id, parent_pos, parent_id, pose_idx, list(list_dot_product(v, col) ORDER BY j) AS v
                  FROM shifted, pcol GROUP BY ALL"""),
    ("white", f"SELECT target_id, parent_pos, parent_id, pose_idx, {UNIT.format('v')} AS v FROM mapped"),
]
CENTERS = [
    ("wdims", "SELECT target_id, parent_pos, parent_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM white"),
    ("wmol", """SELECT target_id, parent_pos, parent_id, list(x ORDER BY i) AS v FROM (
                SELECT target_id, parent_pos, parent_id, i, avg(x) AS x FROM wdims GROUP BY ALL) GROUP BY ALL"""),
    ("centers", f"SELECT target_id, parent_pos, parent_id, {UNIT.format('v')} AS v FROM wmol"),
]
KNN = [
    ("sims", """SELECT a.target_id, a.parent_pos AS src, b.parent_pos AS dst, list_dot_product(a.v, b.v) AS sim
                FROM centers a JOIN centers b ON a.target_id = b.target_id AND a.parent_pos <> b.parent_pos"""),
    ("knn", f"""SELECT target_id, src, dst, sim FROM sims
                QUALIFY row_number() OVER (PARTITION BY target_id, src ORDER BY sim DESC, dst) <= {PARAMS.graph_neighbors}"""),
    ("degree", "SELECT target_id, dst, count(*) AS indegree FROM knn GROUP BY ALL"),
    ("rawedge", f"""SELECT target_id, src, dst, sim,
                    exp(sim / {PARAMS.graph_temperature}::DOUBLE) / pow(indegree, {PARAMS.graph_indegree_exponent}::DOUBLE) AS w
                    FROM knn JOIN degree USING (target_id, dst)"""),
    ("edge", "SELECT target_id, src, dst, sim, w / greatest(sum(w) OVER (PARTITION BY target_id, src), 1e-12) AS w FROM rawedge"),
]


def walk(steps: int) -> list[tuple[str, str]]:
    r = PARAMS.graph_restart_probability
    out = [
        ("size", "SELECT target_id, seed, k, count(*) AS size FROM refs GROUP BY ALL"),
        ("seedv", """SELECT c.target_id, s.seed, s.k, c.parent_pos AS pos,
                     CASE WHEN f.parent_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / s.size END AS s
                     FROM centers c JOIN size s USING (target_id)
                     LEFT JOIN refs f ON f.target_id = c.target_id AND f.seed = s.seed AND f.k = s.k AND f.parent_id = c.parent_id"""),
    ]
    last = "seedv"
    for n in range(1, steps + 1):
        out.append(
            (f"w{n}", f"""SELECT z.target_id, z.seed, z.k, z.pos,
                          {r}::DOUBLE * z.s + (1 - {r}::DOUBLE) * coalesce(p.s, 0) AS s
                          FROM seedv z LEFT JOIN (
                            SELECT e.target_id, q.seed, q.k, e.src, sum(e.w * q.s) AS s FROM edge e
                            JOIN {last} q ON q.target_id = e.target_id AND q.pos = e.dst GROUP BY ALL
                          ) p ON p.target_id = z.target_id AND p.seed = z.seed AND p.k = z.k AND p.src = z.pos""")
        )
        last = f"w{n}"
    return [*out, ("walk", f"SELECT target_id, seed, k, pos AS parent_pos, s AS walk FROM {last}")]


POSE = [
    ("support", f"""SELECT r.target_id, r.seed, r.k, w.parent_id, w.pose_idx, w.v FROM refs r
                    JOIN white w USING (target_id, parent_id) WHERE w.pose_idx < {PARAMS.max_reference_conformers}"""),
    ("pairs", """SELECT w.target_id, s.seed, s.k, w.parent_pos, w.parent_id, w.pose_idx, list_dot_product(w.v, s.v) AS sim
                 FROM white w JOIN support s ON s.target_id = w.target_id
                 ANTI JOIN refs f ON f.target_id = w.target_id AND f.seed = s.seed AND f.k = s.k AND f.parent_id = w.parent_id"""),
    ("pose", f"""SELECT target_id, seed, k, parent_pos, parent_id, pose_idx, avg(sim) AS similarity FROM (
                 SELECT * FROM pairs QUALIFY row_number() OVER (
                   PARTITION BY target_id, seed, k, parent_pos, pose_idx ORDER BY sim DESC) <= {PARAMS.support_similarity_topk}
               ) GROUP BY ALL"""),
]
Z = "({0} - avg({0}) OVER e) / (coalesce(stddev_samp({0}) OVER e, 'NaN'::DOUBLE) + 1e-6)"
EP = "WINDOW e AS (PARTITION BY target_id, seed, k)"
POOLED = [
    ("zpose", f"SELECT *, {Z.format('similarity')} AS z FROM pose {EP}"),
    ("pool", """SELECT target_id, seed, k, parent_pos, parent_id, max(z) AS z, max(similarity) AS similarity
                FROM zpose GROUP BY ALL"""),
]
SCORES = [
    ("fused", f"""SELECT target_id, seed, k, parent_pos, parent_id, similarity, {Z.format('z')} AS direct, {Z.format('walk')} AS graph
                  FROM pool JOIN walk USING (target_id, seed, k, parent_pos) {EP}"""),
    ("scores", f"SELECT *, direct + {PARAMS.graph_weight}::DOUBLE * graph AS score FROM fused"),
]
PLAIN_LIB = [("lib", "SELECT target_id, parent_pos, parent_id, pose_idx, v FROM base")]
GRAPH = [*CENTERS, *KNN]


def scoring(prep: list, lib: list = PLAIN_LIB, base: list = BASE) -> list:
    return [*base, *lib, *prep, *GRAPH, *walk(PARAMS.graph_propagation_steps), *POSE, *POOLED, *SCORES]


# Steps read by several later ones.
SHARED = {"base", "actives", "lib", "white", "centers", "knn", "edge", "mol", "pose", "scores", "members", "thresholds"}


def sql(steps: list[tuple[str, str]], final: str) -> str:
    parts = []
    for name, text in steps:
        keep = " MATERIALIZED" if name in SHARED or (name[0] == "w" and name[1:].isdigit()) else ""
        parts.append(f"{name} AS{keep} ({text})")
    return "WITH " + ",\n".join(parts) + "\n" + final


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


# -- splits ---------------------------------------------------------------------

EPISODES = ("episodes", "SELECT target_id, seed, k, list(parent_id) AS refs FROM refs GROUP BY ALL")


def members(split: str) -> list:
    is_ref = "list_contains(e.refs, a.parent_id)"
    source = "actives a JOIN episodes e USING (target_id)"
    steps = [EPISODES]
    if split == "series-disjoint":
        steps.append(
            ("refseries", "SELECT r.target_id, r.seed, r.k, list(DISTINCT s.series_id) AS ref_series FROM refs r JOIN series s USING (target_id, parent_id) GROUP BY ALL")
        )
        source += " JOIN refseries rs USING (target_id, seed, k) LEFT JOIN series s ON s.target_id = a.target_id AND s.parent_id = a.parent_id"
        shares = "coalesce(list_contains(rs.ref_series, s.series_id), false)"
        visible, ranked = f"({is_ref} OR NOT {shares})", f"(NOT {is_ref} AND NOT {shares})"
    elif split == "ave":
        steps.append(("cand", CANDIDATES))
        source += " LEFT JOIN cand c ON c.target_id = a.target_id AND c.parent_id = a.parent_id"
        visible, ranked = f"({is_ref} OR c.parent_id IS NOT NULL)", "(c.parent_id IS NOT NULL)"
    else:
        visible, ranked = "true", f"(NOT {is_ref})"
    return [
        *steps,
        ("members", f"""SELECT a.target_id, e.seed, e.k, a.parent_pos, a.parent_id, a.label, {visible} AS visible, {ranked} AS ranked
                        FROM {source}"""),
    ]


# Candidates: everything that is not a reference of the largest episode and not in series 5.
CANDIDATES = f"""
SELECT a.target_id, a.parent_id FROM actives a
ANTI JOIN (SELECT * FROM refs WHERE k = {max(KS)}) r ON r.target_id = a.target_id AND r.parent_id = a.parent_id
ANTI JOIN (SELECT * FROM series WHERE series_id = 's5') s ON s.target_id = a.target_id AND s.parent_id = a.parent_id
"""
EPISODE_LIB = [
    ("lib", """SELECT b.target_id || '#' || m.seed || '#' || m.k AS target_id, b.parent_pos, b.parent_id, b.pose_idx, b.v
               FROM base b JOIN members m USING (target_id, parent_pos) WHERE m.visible""")
]
EPISODE_REFS = ("refs", "SELECT target_id || '#' || seed || '#' || k AS target_id, seed, k, ref_order, parent_id FROM refs0")


def episode_scoring(split: str, prep: list) -> list:
    """Scores with one library per episode; references are renamed to match."""
    head = [("refs0" if n == "refs" else n, t) for n, t in BASE]
    own = [(n, t.replace("FROM refs ", "FROM refs0 ").replace("(SELECT * FROM refs WHERE", "(SELECT * FROM refs0 WHERE")) for n, t in members(split)]
    return [*head, *own, EPISODE_REFS, *EPISODE_LIB, *prep, *GRAPH, *walk(PARAMS.graph_propagation_steps), *POSE, *POOLED, *SCORES]


COUNTS = """SELECT target_id, seed, k, count(*) FILTER (visible) AS visible_count, count(*) FILTER (ranked) AS candidate_count,
  count(*) FILTER (ranked AND label = 1) AS positive_count, count(*) FILTER (ranked AND label = 0) AS negative_count,
  {excluded} AS excluded_count FROM members GROUP BY ALL"""


def counts(split: str) -> str:
    return COUNTS.format(excluded="count(*) FILTER (NOT visible)" if split == "series-disjoint" else "0::BIGINT")


# -- metrics --------------------------------------------------------------------

DOCS = ("scored", """SELECT CASE WHEN d.lang = 'en' THEN 'en' ELSE 'other' END AS g, d.doc_id AS pos, d.n_chars::DOUBLE AS score, l.quality AS label
                     FROM documents d JOIN labels l USING (doc_id)""")
METRIC_STEPS = [
    ("ranked", """SELECT *, row_number() OVER o AS rnk, sum(label) OVER o AS hits FROM scored
                  WINDOW o AS (PARTITION BY g ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING)"""),
    ("total", "SELECT g, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p, (count(*) - sum(label))::DOUBLE AS q FROM scored GROUP BY g"),
    ("cuts", """SELECT *, greatest(ceil(n * 0.01::DOUBLE), c1 + 1) AS c2, greatest(ceil(n * 0.05::DOUBLE), greatest(ceil(n * 0.01::DOUBLE), c1 + 1) + 1) AS c3
                FROM (SELECT *, greatest(ceil(n * 0.005::DOUBLE), 1) AS c1 FROM total)"""),
    ("thresholds", """SELECT g, score, max(rnk)::DOUBLE AS r, max(hits)::DOUBLE AS h, sum(label)::DOUBLE AS d, count(*)::DOUBLE AS c
                      FROM ranked GROUP BY g, score"""),
    ("curve", """SELECT g, t.score, d / p * h / r AS ap, d * (q - (r - h) + 0.5::DOUBLE * (c - d)) / (p * q) AS auc,
                 (r - h) / q AS fpr, h / p AS tpr, r FROM thresholds t JOIN total USING (g)"""),
]


def _bedroc(alpha: str) -> str:
    a = f"{alpha}::DOUBLE"
    best = f"((1 - exp(-{a} * p / n)) / (p / n * (1 - exp(-{a}))))"
    worst = f"((1 - exp({a} * p / n)) / (p / n * (1 - exp({a}))))"
    rie = f"(sum(label * exp(-{a} * rnk / n)) / (any_value(p) / any_value(n) * (1 - exp(-{a})) / (exp({a} / any_value(n)) - 1)))"
    best, worst = (x.replace("p / n", "any_value(p) / any_value(n)") for x in (best, worst))
    return f"CASE WHEN {best} = {worst} THEN 1.0 ELSE ({rie} - {worst}) / ({best} - {worst}) END"


def _ef(cut: str) -> str:
    return f"sum(CASE WHEN rnk <= {cut} THEN label ELSE 0 END) * any_value(n) / (any_value({cut}) * any_value(p))"


def _bayes(fraction: str) -> str:
    return f"min_by(tpr / fpr, r) FILTER (fpr >= {fraction}::DOUBLE)"


METRIC_SQL = {
    "auc_roc": "sum(auc)",
    "auc_pr": "sum(ap)",
    "ef_0.5%": _ef("c1"),
    "ef_1%": _ef("c2"),
    "ef_5%": _ef("c3"),
    "bedroc_20": _bedroc("20.0"),
    "bedroc_80.5": _bedroc("80.5"),
    "bedroc_85": _bedroc("85.0"),
    "bayes_ef_0.5%": _bayes("0.005"),
    "bayes_ef_1%": _bayes("0.01"),
    "bayes_ef_5%": _bayes("0.05"),
}
CURVE = {"auc_roc", "auc_pr", "bayes_ef_0.5%", "bayes_ef_1%", "bayes_ef_5%"}


def metric_steps() -> list:
    on_curve = ", ".join(f'{e} AS "{n}"' for n, e in METRIC_SQL.items() if n in CURVE)
    on_rows = ", ".join(f'{e} AS "{n}"' for n, e in METRIC_SQL.items() if n not in CURVE)
    return [
        *METRIC_STEPS,
        ("m1", f"SELECT g, {on_curve} FROM curve GROUP BY g"),
        ("m2", f"SELECT g, {on_rows} FROM ranked JOIN cuts USING (g) GROUP BY g"),
        ("metrics", "SELECT * FROM m1 JOIN m2 USING (g)"),
    ]
