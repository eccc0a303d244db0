"""Prefix trie of conversations: ROLLUP over positional turn columns, in blocks keyed by the node before them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import write_table

#: Turns in a block, each a column of the ROLLUP (Spark takes up to 61); a longer conversation continues in further blocks.
BLOCK = 8
#: Conversations that share the first turns of one of them, and the number of head lengths (0 to HEADS - 1).
SHARE, HEADS = 100, 6
#: Conversation numbers joined into one piece of a digest.
PIECE = 1_000
TURN = "struct<digest: binary, n_chars: bigint>"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, turn): positions from 1 by turn, null first; ``turn`` is a digest of role and text with the text's code points.

    Null roles and texts are empty. Turns of equal number are ordered by that digest, so the
    result does not depend on the order of rows, and texts are not shuffled. Rows without
    conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length(role), F.concat(role, text))))
    turn = F.struct(digest.alias("digest"), F.char_length(text).cast("long").alias("n_chars"))
    rows = turns.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("_t"), turn.alias("turn"))
    order = Window.partitionBy("conv").orderBy(F.col("_t").asc_nulls_first(), "turn")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("pos"), "turn")


def share_heads(turns: DataFrame) -> DataFrame:
    """Rebuilt conversations, as ``ordered_turns`` gives them, with a row of pos 0 for each conversation as such.

    Conversation c starts with the first h turns of conversation c - c % SHARE, where h is the
    unsigned CRC-32 of its decimal number modulo HEADS, and goes on with its own turns after its first h.
    """
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))
    convs = turns.where("pos = 1").select("conv", head.alias("_h"), (F.col("conv") - F.col("conv") % SHARE).alias("_base"))
    first = turns.where((F.col("conv") % SHARE == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv").alias("_base"))
    first = first.agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("_head"))  # HEADS - 1 turns at most
    met = convs.join(first, "_base", "left").withColumn("_head", F.slice(F.coalesce("_head", F.array()), 1, F.col("_h").cast("int")))
    itself = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast(TURN).alias("turn")))
    started = met.select("conv", F.inline(F.concat(itself, "_head")))
    # Own later turns keep their positions unless the base is shorter than h.
    short = met.where(F.size("_head") < F.col("_h")).select("conv", (F.col("_h") - F.size("_head")).alias("_back"))
    own = turns.where(F.col("pos") > head).join(short, "conv", "left")
    return started.unionByName(own.select("conv", (F.col("pos") - F.coalesce("_back", F.lit(0))).alias("pos"), "turn"))


def _mark(seed: int, pos: Column, turn: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos.cast("long"), turn["digest"])


def _blocks(rebuilt: DataFrame, size: int) -> DataFrame:
    """A row for each conversation and block: its turns t1.., the key p1, p2 of the node before it, and the key k1, k2 at its end.

    A node's key is the exclusive or of hashes of its positions and turns, 128 bits, so the key
    before each block is a running aggregate and conversations of any length are done at once.
    """
    rows = rebuilt.repartition("conv")
    at = F.greatest(F.floor((F.col("pos") - 1) / F.lit(size)), F.lit(0)).cast("long")
    marks = [F.bit_xor(F.when(F.col("pos") > 0, _mark(s, F.col("pos"), F.col("turn")))).alias(f"x{s}") for s in (1, 2)]
    held = F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "turn")))).alias("held")
    rows = rows.groupBy("conv", at.alias("block")).agg(held, *marks)
    order = Window.partitionBy("conv").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            **{f"p{s}": F.coalesce(F.bit_xor(f"x{s}").over(before), F.lit(0).cast("long")) for s in (1, 2)},
            "last": F.lead("block").over(order).isNull(),
        }
    )
    turns = [F.get("held", F.lit(i))["turn"].alias(f"t{i + 1}") for i in range(size)]
    ends = [F.col(f"p{s}").bitwiseXOR(F.coalesce(f"x{s}", F.lit(0).cast("long"))).alias(f"k{s}") for s in (1, 2)]
    # A node has no child if no member goes on below it; `reach` is one more than the block's end for those that do.
    reach = F.col("block") * size + F.size("held") + F.when(F.col("last"), 0).otherwise(1)
    return rows.select("conv", "block", "p1", "p2", *turns, *ends, "last", reach.alias("reach"))


def _rolled(rows: DataFrame, size: int, sums: str) -> DataFrame:
    """``sums`` of every prefix of t1.. below each node before a block, with its length ``d`` in the block."""
    columns = ", ".join(f"t{i + 1}" for i in range(size))
    found = rows.sparkSession.sql(
        f"SELECT block, p1, p2, {columns}, grouping_id() AS _level, {sums} FROM {{rows}} GROUP BY block, p1, p2, ROLLUP ({columns})",
        rows=rows,
    )
    # Columns beyond a prefix are the lowest bits of the grouping; a prefix that ends in a missing turn is no node.
    d = F.lit(size) - F.bit_count("_level").cast("int")
    found = found.withColumn("d", d).drop("_level")
    top = (F.col("block") == 0) & (F.col("d") == 0)
    return found.where(top | F.coalesce(F.try_element_at(_turns(size), F.when(F.col("d") > 0, F.col("d"))).isNotNull(), F.lit(False)))


def _turns(size: int) -> Column:
    return F.array(*[F.col(f"t{i + 1}") for i in range(size)])


def _keys(nodes: DataFrame, size: int) -> DataFrame:
    """Adds the key k1, k2 of each node and q1, q2 of its parent (null for the root)."""
    added: dict[str, Column] = {}
    for s in (1, 2):
        marks = [F.when(F.col("d") >= i + 1, _mark(s, F.col("block") * size + i + 1, F.col(f"t{i + 1}"))).otherwise(F.lit(0).cast("long")) for i in range(size)]
        added[f"k{s}"] = reduce(lambda x, y: x.bitwiseXOR(y), marks, F.col(f"p{s}"))
        own = F.array(*marks)
        added[f"q{s}"] = F.when(F.col("d") > 0, F.element_at(own, F.greatest("d", F.lit(1))))
    out = nodes.withColumns(added)
    return out.withColumns({f"q{s}": F.col(f"k{s}").bitwiseXOR(F.col(f"q{s}")) for s in (1, 2)})


def _below_blocks(nodes: DataFrame, size: int, blocks: int) -> DataFrame:
    """(k1, k2, more, more_leaves): sums of ``value`` and ``leaf`` over everything below each node that further blocks continue.

    Such nodes are a tree of their own, whose depth is the number of blocks; pointer doubling
    sums its subtrees in a logarithmic number of rounds, each written.
    """
    sums = nodes.where("block > 0").groupBy("p1", "p2").agg(F.sum("value").alias("more"), F.sum("leaf").alias("more_leaves"))
    place = nodes.where(F.col("d") == size).select("k1", "k2", *[F.when(F.col("block") > 0, F.col(f"p{s}")).alias(f"a{s}") for s in (1, 2)])
    state = sums.withColumnsRenamed({"p1": "k1", "p2": "k2"}).join(place, ["k1", "k2"])
    state = write_table(state, "trie-blocks")
    step = 1
    while step < blocks:
        given = state.where("a1 IS NOT NULL").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2"))
        given = given.agg(F.sum("more").alias("_m"), F.sum("more_leaves").alias("_l"))
        above = state.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("_a1"), F.col("a2").alias("_a2"))
        state = state.join(given, ["k1", "k2"], "left").join(above, ["a1", "a2"], "left")
        state = state.select(
            "k1", "k2", (F.col("more") + F.coalesce("_m", F.lit(0))).alias("more"), (F.col("more_leaves") + F.coalesce("_l", F.lit(0))).alias("more_leaves"),
            F.col("_a1").alias("a1"), F.col("_a2").alias("a2"),
        )
        state = write_table(state, "trie-blocks")
        step *= 2
    return state.select("k1", "k2", "more", "more_leaves")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ascending, comma-joined numbers ``conv`` of each key.

    Numbers are first joined in pieces of at most ``PIECE`` in all tasks; then one task reads
    the pieces of a key in order, a batch at a time, as a digest cannot be taken in parts.
    """
    pieces = ends.groupBy("k1", "k2", F.floor(F.col("conv") / F.lit(PIECE)).alias("piece"))
    pieces = pieces.agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("numbers"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for k1, k2, numbers in zip(*columns):
                if (k1, k2) != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(numbers.encode())
                else:
                    state.update(b"," + numbers.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, state.hexdigest())))], schema)

    names = ("k1", "k2", "ends_sha256")
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    pieces = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece")
    return pieces.select("k1", "k2", "numbers").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations (conv, pos, turn; pos 0 stands for the conversation as such).

    Each distinct sequence of the first d turns is a node of depth d, from the root of d = 0, which
    exists if there is any conversation. One row for each: ``conv_id`` (smallest conversation that
    starts so), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (nodes without children in its subtree, itself included), ``saved_tokens`` (sum over
    its subtree of the code points of a node's last text, for each conversation but one) and
    ``ends_sha256`` (digest of the numbers of conversations that end there).

    All prefixes within ``block`` turns are aggregated by one ROLLUP; longer conversations have a
    row for each block, grouped under the node before it. A second ROLLUP over the nodes sums
    subtrees. A turn or conversation that a third of all share is aggregated before it is
    shuffled; turns of equal role and text are the same whatever their code points' number of copies.
    An empty table gives no rows.
    """
    rows = write_table(_blocks(rebuilt, block), "trie-rows")
    nodes = _rolled(rows, block, "min(conv) AS conv_id, count(*) AS n_convs, max(reach) AS reach")
    chars = F.coalesce(F.try_element_at(_turns(block), F.when(F.col("d") > 0, F.col("d")))["n_chars"], F.lit(0))
    depth = F.col("block") * block + F.col("d")
    nodes = nodes.withColumns({"value": (F.col("n_convs") - 1) * chars, "leaf": (F.col("reach") <= depth).cast("long"), "depth": depth})
    nodes = write_table(_keys(nodes, block), "trie-nodes")
    blocks = nodes.agg(F.max("block")).first()[0] or 0
    valued = nodes
    if blocks:
        more = _below_blocks(nodes, block, blocks)
        valued = nodes.join(more, ["k1", "k2"], "left").withColumns(
            {"value": F.col("value") + F.coalesce("more", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("more_leaves", F.lit(0))}
        )
    sums = "min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(value) AS saved_tokens, sum(leaf) AS n_leaves"
    # Members of a node below are members of it, so its own numbers are the extremes of its subtree.
    summed = _keys(_rolled(valued, block, sums), block).withColumn("depth", (F.col("block") * block + F.col("d")).cast("long"))
    summed = write_table(summed.select("k1", "k2", "q1", "q2", "conv_id", "depth", "n_convs", "n_leaves", "saved_tokens"), "trie-sums")
    children = nodes.where("q1 IS NOT NULL").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _end_digests(rows.where("last").select("k1", "k2", "conv"))
    parents = summed.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = summed.join(children, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left").join(parents, ["q1", "q2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``prefix_trie`` of the conversations rebuilt by ``share_heads``.

    Null roles and texts are empty, null turns come first, turns of equal number are ordered by a
    digest, repeated rows are turns of their own, and rows without conv_id are in no conversation.
    A conversation that is left without turns is a member of the root. Other columns are not read.
    """
    turns = write_table(ordered_turns(turns), "trie-turns")
    return prefix_trie(share_heads(turns), block)
