"""Neighbour graph weights and random walk with restart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import pin, write_table
from .topk import knn, library_sizes

# In-degree above which a node's edges are split over several join keys.
HOT_DEGREE = 1_000_000
# Steps of the walk planned as one query before its state is written.
STEPS_PER_WRITE = 10
# Episodes that walk in one row; a target with more of them has more rows per node.
LANES = 16
# Bytes of state that a task may hold in a hash table; a whole state of SMALL_STATE is left
# to AQE, which broadcasts it by its measured size.
HASH_BYTES = 64 * 1024 * 1024
SMALL_STATE = 10 * 1024 * 1024

WEIGHT_FLOOR = 1e-12


@dataclass
class Graph:
    """``edges`` (target_id, src, dst, salt, sim, w), ``hot`` (target_id, dst, salts):
    nodes whose incoming edges are split, and how many nodes there are, if known."""

    edges: DataFrame
    hot: DataFrame | None
    nodes: int | None = None


def indegree(edges: DataFrame) -> DataFrame:
    """How often a node is chosen as neighbour; counts combine before the shuffle."""
    return edges.groupBy("target_id", "dst").agg(F.count(F.lit(1)).alias("indegree"))


def _split_hot(edges: DataFrame, degrees: DataFrame, hot_degree: int):
    """Give edges of very popular nodes a salt.

    At most (edge count / hot_degree) nodes can be that popular, so the list that
    is broadcast has a proven bound.
    """
    popular = degrees.where(F.col("indegree") > hot_degree).select(
        "target_id", "dst", F.ceil(F.col("indegree") / F.lit(hot_degree)).cast("int").alias("salts")
    )
    hot, fits = pin(popular, 64, "hot-nodes")
    if hot.isEmpty():
        return edges.withColumn("salt", F.lit(0)), None
    side = F.broadcast(hot) if fits else hot
    salt = F.pmod(F.xxhash64("src"), F.coalesce(F.col("salts"), F.lit(1)).cast("long")).cast("int")
    return edges.join(side, ["target_id", "dst"], "left").withColumn("salt", salt).drop("salts"), hot


def _with_salts(nodes: DataFrame, hot: DataFrame | None) -> DataFrame:
    """One copy of a node per salt of its incoming edges; ``nodes`` keyed (target_id, dst)."""
    if hot is None:
        return nodes.withColumn("salt", F.lit(0))
    return (
        nodes.join(hot, ["target_id", "dst"], "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
        .drop("salts")
    )


def weigh(
    edges: DataFrame, temperature: float, exponent: float, largest: int | None = None, hot_degree: int = HOT_DEGREE
):
    """Normalised edge weights ``exp(sim/T) / indegree[dst]^gamma`` per source row.

    ``largest`` is the size of the largest library if known: no in-degree exceeds it.
    """
    degrees = indegree(edges)
    if largest is not None and largest <= hot_degree:
        salted, hot = edges.withColumn("salt", F.lit(0)), None
    else:
        salted, hot = _split_hot(edges, degrees, hot_degree)
    raw = salted.join(_with_salts(degrees, hot), ["target_id", "dst", "salt"]).withColumn(
        "w", F.exp(F.col("sim") / F.lit(temperature)) / F.pow(F.col("indegree"), F.lit(exponent))
    )
    # A source has at most k edges, so this window is bounded.
    total = F.sum("w").over(Window.partitionBy("target_id", "src"))
    out = raw.withColumn("w", F.col("w") / F.greatest(total, F.lit(WEIGHT_FLOOR)))
    return out.select("target_id", "src", "dst", "salt", "sim", "w"), hot


def build_graph(
    centers: DataFrame,
    neighbors: int,
    temperature: float,
    exponent: float,
    side: int | None = None,
    hot_degree: int = HOT_DEGREE,
) -> Graph:
    """Directed kNN graph over ``centers`` (target_id, parent_pos, center)."""
    sizes, fits = library_sizes(centers)
    largest, nodes = sizes.agg(F.max("n"), F.sum("n")).first()
    neighbours = write_table(knn(centers, neighbors, side, (sizes, fits)), "neighbours")
    edges, hot = weigh(neighbours, temperature, exponent, largest, hot_degree)
    return Graph(write_table(edges, "edges"), hot, nodes)


def propagate(
    graph: Graph,
    seeds: DataFrame,
    columns: list[str],
    restart: float,
    steps: int,
    part: str | None = None,
    hash_bytes: int = HASH_BYTES,
) -> DataFrame:
    """``s = restart*seed + (1-restart) * W s`` repeated; all ``columns`` walk together.

    ``seeds``: (target_id, pos, *columns). The state is sparse: it starts as the seeds
    and gains the nodes they reach; a node that is absent has state 0. A step joins
    edges and state by destination and sums by source. The edge side is the same exchange
    in every step, so a query over many steps shuffles the edges once and then only
    partial sums.

    Edges stream through a hash table of the state, unsorted, where all nodes of a task fit
    ``hash_bytes``. A larger state, or one of unknown size, is sorted like the edges, and a
    small one left to AQE.

    With ``part``, a further column of the seeds, a node has one state per value of it, so
    any number of episodes walks in plans of the same size; edges are still shuffled once,
    and the state once more a step. Without it, the sums lie where the next join wants them.
    """
    kept = ["target_id", "pos", *([part] if part else []), *columns]
    state = seeds = seeds.select(*kept)
    parts = seeds.select(part).distinct().count() if part else 1
    hashed = False
    if graph.nodes is not None:
        tasks = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # A hashed row takes about 64 bytes beside its numbers; hashing fills tasks within a factor of two.
        size = graph.nodes * parts * (64 + 8 * len(columns))
        hashed = SMALL_STATE < size <= tasks * hash_bytes // 2
    for done in range(0, steps, STEPS_PER_WRITE):
        count = min(STEPS_PER_WRITE, steps - done)
        state = _walk(graph, seeds, state, columns, restart, count, part, hashed)
        if done + count < steps:
            state = write_table(state, f"walk-{done + count}")
    return state


def _walk(
    graph: Graph,
    seeds: DataFrame,
    state: DataFrame,
    columns: list[str],
    restart: float,
    steps: int,
    part: str | None,
    hashed: bool,
) -> DataFrame:
    """``steps`` updates as one statement, so that it is analysed once."""
    on = ["target_id", "dst"] if graph.hot is None else ["target_id", "dst", "salt"]
    # The filter that joins would infer for some steps only; stated for all, it lets
    # every step read the same shuffle of the edges.
    present = " AND ".join(f"{c} IS NOT NULL" for c in [*on, "src"])
    edges = graph.edges.select(*on, "src", "w").where(present)
    carried = [part] if part else []
    keys = ", ".join(["target_id", "pos", *carried])
    names = ", ".join([*carried, *columns])
    pulled = ", ".join([*(f"s.{c}" for c in carried), *(f"{1.0 - restart!r}D * e.w * s.{c} AS {c}" for c in columns)])
    seeded = ", ".join([*carried, *(f"{restart!r}D * {c} AS {c}" for c in columns)])
    sums = ", ".join(f"sum({c}) AS {c}" for c in columns)
    hint = "/*+ SHUFFLE_HASH(s) */" if hashed else ""
    source = "SELECT target_id, pos AS dst, {names} FROM {last}"
    if graph.hot is not None:
        source = (
            "SELECT target_id, dst, {names}, explode(sequence(0, coalesce(salts, 1) - 1)) AS salt"
            " FROM (SELECT target_id, pos AS dst, {names} FROM {last}) LEFT JOIN {{hot}} USING (target_id, dst)"
        )
    written, last = [], "{state}"
    for n in range(1, steps + 1):
        written.append(
            f"""step_{n} AS (
              SELECT {keys}, {sums} FROM (
                SELECT {hint} e.target_id, e.src AS pos, {pulled}
                FROM {{edges}} e JOIN ({source.format(names=names, last=last)}) s USING ({", ".join(on)})
                UNION ALL SELECT target_id, pos, {seeded} FROM {{seeds}}
              ) GROUP BY {keys})"""
        )
        last = f"step_{n}"
    query = "WITH " + ", ".join(written) + f" SELECT target_id, pos, {names} FROM {last}"
    frames = {"edges": edges, "seeds": seeds, "state": state}
    if graph.hot is not None:
        frames["hot"] = graph.hot
    return graph.edges.sparkSession.sql(query, **frames)
