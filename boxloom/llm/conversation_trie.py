"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

1. Turns are numbered in each conversation; a conversation with very many turns is numbered in
   two levels (``plans.running``). Conversations are rebuilt by joins on the base conversation.
2. A prefix is named by the XOR of 128-bit digests of (place, role, text) over its turns. XOR is
   associative, so a long conversation runs in blocks. One aggregate, combined map-side, makes
   the nodes.
3. Contraction, in rounds of joins until no node is left:
   compress - every chain of nodes with one child is jumped over by pointer doubling; its lowest
   node stays and hangs below what stood above the chain;
   rake - leaves are complete; they add their totals to their parents and go.
   A chain of n nodes takes log n rounds, and a phase at least halves the leaves.
4. Contracted nodes come back in reverse order: the total of a node in a chain is the sum over
   the chain from it down, plus the total of the lowest node.
5. The ids that end at a node are joined to text in sorted pieces, and the pieces of a node run
   in order through one digest, so a node where very many end holds no list.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or
text is empty; turns of one number are in the order of role, then text; repeated rows are turns
each. A conversation whose rebuilt form has no turn ends at the root. An empty table has no root.
Columns beyond (conv_id, turn, role, text) are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.plans.running import number_rows, value_bucket
from boxloom.plans.skew import split_hot
from boxloom.session import durable

# Fixed values of the rebuilt conversations.
GROUP = 20
HEADS = 4

#: Turns of a conversation up to which one window numbers them.
TURN_LIMIT = 100_000
#: Turns that run together; the blocks of a longer conversation are combined.
BLOCK = 65_536
#: Ids of one piece of a node's ends.
PIECE = 4_096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, words): turns in order from 0, role and text as a digest."""
    empty = F.lit("")
    turns = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = ["turn", "role", "text"]
    usual, hot = split_hot(turns, ["conv_id"], TURN_LIMIT)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    rows = usual.withColumn("i", place.cast("bigint"))
    if hot is not None:
        rows = rows.unionByName(number_rows(hot, ["conv_id"], value_bucket(hot, F.col("turn")), [F.col(c) for c in order], "i"))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.select("conv_id", (F.col("i") - 1).alias("i"), F.unhex(F.md5(said)).alias("digest"), word_count(F.col("text")).alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their rebuilt turns (conv_id, pos, digest, words)."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("heads")
    base = sizes.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), heads)
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("heads", F.coalesce("base_n", F.lit(0))))
    own = F.greatest(F.col("n") - F.col("heads"), F.lit(0))
    convs = durable(convs.select("conv_id", "base", "heads", "taken", (F.col("taken") + own).alias("length")), "conversations")
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("i") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").where("i < taken").select("conv_id", F.col("i").alias("pos"), "digest", "words", "length")
    kept = turns.join(convs, "conv_id").where("i >= heads").select(
        "conv_id", (F.col("i") - F.col("heads") + F.col("taken")).alias("pos"), "digest", "words", "length")
    return convs.select("conv_id", "length"), taken.union(kept)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, parent, depth, conv_id, words, ends): each conversation's node at each depth, root included."""
    halves = ("x", "y")
    # The number comes first: it seeds the hash of the digest, so the halves are independent.
    marked = turns.withColumns({c: F.xxhash64(F.lit(k), "digest", "pos") for k, c in enumerate(halves)})
    marked = marked.withColumn("block", F.floor(F.col("pos") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.withColumns({f"run_{c}": F.bit_xor(c).over(inside) for c in halves})
    longest = convs.agg(F.max("length")).first()[0]
    if longest and longest > BLOCK:
        long = marked.where(F.col("length") > BLOCK)
        before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = long.groupBy("conv_id", "block").agg(*[F.bit_xor(c).alias(c) for c in halves]).select(
            "conv_id", "block", *[F.bit_xor(c).over(before).alias(f"before_{c}") for c in halves])
        run = run.join(offsets, ["conv_id", "block"], "left").withColumns(
            {f"run_{c}": F.col(f"run_{c}").bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0))) for c in halves})
    node = F.struct(*[F.col(f"run_{c}").alias(c) for c in halves])
    above = F.struct(*[F.col(f"run_{c}").bitwiseXOR(F.col(c)).alias(c) for c in halves])
    root = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in halves])
    depth = F.col("pos") + 1
    return run.select(node.alias("id"), above.alias("parent"), depth.alias("depth"), "conv_id", "words",
                      (depth == F.col("length")).alias("ends")).union(
        convs.select(root.alias("id"), F.lit(None).cast("struct<x:bigint,y:bigint>").alias("parent"),
                     F.lit(0).cast("bigint").alias("depth"), "conv_id", F.lit(0).cast("bigint").alias("words"),
                     (F.col("length") == 0).alias("ends")))


def compressed(live: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``live`` without its nodes of one child, and those (id, low, leaves, saved): what the chain
    holds from the node down to ``low``, its lowest node, exclusive. None if there are none."""
    single = live.where("kids = 1").select(F.col("id").alias("above"), "leaves", "saved")
    # The node above a child is one, so each chain node meets its only child.
    down = durable(single.join(live.select(F.col("parent").alias("above"), F.col("id").alias("low"),
                                           F.col("more_leaves").alias("ml"), F.col("more_saved").alias("ms")), "above").select(
        F.col("above").alias("id"), "low", (F.col("leaves") + F.col("ml")).alias("leaves"),
        (F.col("saved") + F.col("ms")).alias("saved"), F.lit(True).alias("going")), "chains")
    if down.isEmpty():
        return live, None
    while True:
        jump = down.select(F.col("id").alias("low"), F.col("low").alias("next"), F.col("leaves").alias("jl"),
                           F.col("saved").alias("js"), F.col("going").alias("on"))
        down = durable(
            down.where("going").join(jump, "low", "left").select(
                "id", F.coalesce("next", "low").alias("low"), (F.col("leaves") + F.coalesce("jl", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("js", F.lit(0))).alias("saved"), F.coalesce("on", F.lit(False)).alias("going"))
            .union(down.where("NOT going")), "chains")
        if down.where("going").isEmpty():
            break
    down = down.drop("going")
    # The top of a chain passes its place and all the chain holds to the chain's lowest node.
    tops = live.where("kids = 1").join(live.where("kids = 1").select(F.col("id").alias("parent")), "parent", "left_anti")
    moved = tops.select("id", "parent", "more_leaves", "more_saved").join(
        down.withColumnsRenamed({"leaves": "cl", "saved": "cs"}), "id").select(
        F.col("low").alias("id"), F.col("parent").alias("to"), (F.col("more_leaves") + F.col("cl")).alias("tl"),
        (F.col("more_saved") + F.col("cs")).alias("ts"))
    rest = live.where("kids <> 1").join(moved, "id", "left").select(
        "id", F.when(F.col("tl").isNotNull(), F.col("to")).otherwise(F.col("parent")).alias("parent"), "kids", "leaves", "saved",
        F.coalesce("tl", "more_leaves").alias("more_leaves"), F.coalesce("ts", "more_saved").alias("more_saved"))
    return durable(rest, "live"), down


def raked(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``live`` without its leaves, which have added to their parents, and those leaves."""
    leaves = live.where("kids = 0")
    given = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("gone"), F.sum(F.col("leaves") + F.col("more_leaves")).alias("gl"),
        F.sum(F.col("saved") + F.col("more_saved")).alias("gs"))
    left = live.where("kids > 0").join(given, "id", "left").select(
        "id", "parent", *[(F.col(c) + F.coalesce(g, F.lit(0)) * sign).alias(c) for c, g, sign in
                          (("kids", "gone", -1), ("leaves", "gl", 1), ("saved", "gs", 1))], "more_leaves", "more_saved")
    return durable(left, "live"), leaves.select("id", "leaves", "saved")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(id, leaves, saved) summed over each node's subtree, from (id, parent, kids, leaves, saved).

    ``more_leaves`` and ``more_saved`` of a live node are what contracted nodes between it and its
    parent hold; they pass upwards with its own totals.
    """
    live = nodes.select("id", "parent", "kids", "leaves", "saved",
                        F.lit(0).cast("bigint").alias("more_leaves"), F.lit(0).cast("bigint").alias("more_saved"))
    totals, chains = [], []
    while True:
        live, chain = compressed(live)
        chains.append((len(totals), chain))
        live, leaves = raked(live)
        totals.append(leaves)
        if live.isEmpty():
            break
    known = totals[0]
    for more in totals[1:]:
        known = known.union(more)
    for _, chain in reversed(chains):
        if chain is not None:
            ends = known.select(F.col("id").alias("low"), F.col("leaves").alias("el"), F.col("saved").alias("es"))
            known = durable(known.union(chain.join(ends, "low").select(
                "id", (F.col("leaves") + F.col("el")).alias("leaves"), (F.col("saved") + F.col("es")).alias("saved"))), "totals")
    return known


def end_digests(rows: DataFrame) -> DataFrame:
    """(id, ends_sha256) of nodes where conversations end: SHA-256 of their ids, ascending, comma-joined."""
    pieces = rows.where("ends").groupBy("id", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:  # sorted by node and piece; a node may go on in the next batch
            done: list[tuple] = []
            for x, y, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if at == (x, y):
                    digest.update(b"," + ids.encode())
                    continue
                if at:
                    done.append((*at, digest.hexdigest()))
                at, digest = (x, y), hashlib.sha256(ids.encode())
            yield packed(done)
        if at:
            yield packed([(*at, digest.hexdigest())])

    def packed(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["x", "y", "ends_sha256"])

    flat = pieces.select("id.x", "id.y", "ids", "piece").repartition("x", "y").sortWithinPartitions("x", "y", "piece")
    found = flat.mapInArrow(run, "x bigint, y bigint, ends_sha256 string")
    return found.select(F.struct("x", "y").alias("id"), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, from (conv_id, turn, role, text)."""
    convs, turns = rebuilt(durable(numbered_turns(conversations), "turns"))
    rows = durable(prefixes(convs, turns), "prefixes")
    nodes = durable(rows.groupBy("id", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    zero = F.lit(0).cast("bigint")
    counted = durable(nodes.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", zero)), "counted")
    totals = subtree_totals(counted.select(
        "id", "parent", "kids", F.when(F.col("kids") == 0, 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    above = counted.where("kids > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (counted.join(above, "parent", "left").join(totals, "id").join(end_digests(rows), "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))
