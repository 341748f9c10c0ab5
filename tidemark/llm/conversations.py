"""Prefix tries of conversations: what conversations share from their first turn on.

A turn is its role and text, here a digest and a number of characters; texts themselves are read once. Equal conversations are one
sequence with a count and a smallest id, found by partial aggregation, so a conversation of many copies enters a trie once.

1. Partition. Sequences go by the digest of their first turn into groups of about TURNS turns. A first turn whose sequences hold more is
   a trunk node, and they are dealt by their next turn instead, and so on; turns that all of them share are passed over at once.
2. Tries. A group's sequences build tries of dictionaries, one pointer for each turn, inside applyInPandas. An iterative postorder adds
   up subtrees; depth is no limit.
3. Trunk. From the deepest up, a trunk node adds up the tops of the tries and trunk nodes below it, by a grouped aggregation. The root is
   the trunk node above all first turns.
4. Ends. The ids that end at a node are sorted by Spark and hashed as they stream by, in constant memory.

Cases: a null role or text counts as empty; turns go by number, null first, and equal numbers by digest; repeated rows are turns of their
own; rows with a null conv_id are left out; an empty table has no root and gives no rows; texts of any length are one digest; a single
conversation is held whole, as digests; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Turns in a group at most, unless one conversation has more.
TURNS = 20_000
NODE = "own string, parent string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, whole string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns in order, each (digest, chars). Of a long text only its digest moves."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.char_length(text).cast("bigint").alias("chars"),
    )
    # Ties: equal turn numbers go by digest, which is that of role and text.
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "chars")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t.digest.alias("digest"), t.chars.alias("chars"))).alias("turns"))


def with_shared_heads(turns: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """Conversations that begin with the first `head` turns (`longest` at most) of conversation `base`, then go on with their own after as many."""
    heads = turns.select(F.col("conv_id").alias("_of"), F.slice("turns", 1, longest).alias("_head"))
    own = turns.select("conv_id", "turns", base.alias("_base"), head.cast("int").alias("_n"))
    first = F.coalesce(F.slice("_head", F.lit(1), F.col("_n")), F.expr("slice(turns, 1, 0)"))
    rest = F.slice("turns", F.col("_n") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, F.col("_base") == F.col("_of"), "left").select("conv_id", F.concat(first, rest).alias("turns"))


def key_of(depth: Column) -> Column:
    """Names the node of a sequence at a depth."""
    return F.md5(F.array_join(F.transform(F.slice("turns", F.lit(1), depth), lambda t: t.digest), ""))


def ends(members: DataFrame) -> DataFrame:
    """(whole, ends_sha256) over the ids of each sequence, ascending, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, state, done = None, None, []
        for batch in batches:
            for key, conv_id in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key == whole:
                    state.update(f",{conv_id}".encode())
                    continue
                if whole is not None:
                    done.append((whole, state.hexdigest()))
                whole, state = key, hashlib.sha256(str(conv_id).encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([v for _, v in done], pa.string())], ["whole", "ends_sha256"])
            done = []
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole]), pa.array([state.hexdigest()])], ["whole", "ends_sha256"])

    return members.repartition("whole").sortWithinPartitions("whole", "conv_id").mapInArrow(run, "whole string, ends_sha256 string")


class Node:
    """A trie's node: pointers to the next turns by digest, and what is known of its subtree."""

    __slots__ = ("below", "chars", "conv_id", "depth", "leaves", "n", "saved", "up", "whole")

    def __init__(self, up: Node | None, depth: int, chars: int):
        self.up, self.depth, self.chars = up, depth, chars
        self.below: dict[str, Node] = {}
        self.n = self.leaves = self.saved = 0
        self.conv_id = self.whole = None


def tries(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a group's tries, from the depth of their tops (skip + 1) on."""
    tops: dict[str, tuple[Node, str]] = {}
    for s in group.itertuples(index=False):
        if s.top not in tops:
            tops[s.top] = (Node(None, s.skip + 1, s.chars[s.skip]), s.parent)
        node = tops[s.top][0]
        for digest, chars in zip(s.digests[s.skip + 1 :], s.chars[s.skip + 1 :], strict=True):
            if (found := node.below.get(digest)) is None:
                found = node.below[digest] = Node(node, node.depth + 1, chars)
            node = found
        node.n, node.conv_id, node.whole = s.n, s.conv_id, s.whole
    rows = []
    for name, (top, parent) in tops.items():
        order, open_ = [], [top]
        while open_:  # parents before children
            node = open_.pop()
            order.append(node)
            open_.extend(node.below.values())
        for node in reversed(order):  # children before parents
            for child in node.below.values():
                node.n += child.n
                node.leaves += child.leaves
                node.saved += child.saved
                node.conv_id = child.conv_id if node.conv_id is None else min(node.conv_id, child.conv_id)
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.chars
        for node in order:
            up = node.up
            rows.append((None if up else name, None if up else parent, node.conv_id, node.depth, up.conv_id if up else None, node.n, len(node.below), node.leaves, node.saved, node.whole))
    found = pd.DataFrame(rows, columns=[f.split()[0] for f in NODE.split(", ")])
    return found.astype({"parent_conv_id": "Int64"})


def common_turns(first: Column, last: Column) -> Column:
    """How many leading digests two sequences share; of the least and greatest of a set, that is what all of it shares."""
    differ = F.array_position(F.zip_with(first, last, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differ > 0, differ - 1).otherwise(F.size(first)).cast("int")


def split(found: DataFrame, groups_of: int) -> tuple[DataFrame, list[DataFrame]]:
    """Sequences with the trie's top that takes them; and trunk nodes, those above first. A trunk node is a chain of nodes from the depth
    `start` to `depth`, all of the same members; `ended` is the sequence that ends at its last, chars the lengths of its turns.
    """
    ready, trunk = [], []
    open_ = found.select("*", F.lit("").alias("top"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("start"), F.lit(0).alias("depth"))
    while True:
        at_end = F.when(F.size("turns") == F.col("depth"), F.struct("n", "conv_id", "whole"))
        lengths = F.when(F.col("start") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(
            F.transform(F.slice("turns", F.greatest("start", F.lit(1)), F.col("depth") - F.col("start") + 1), lambda t: t.chars)
        )
        nodes = open_.groupBy(F.col("top").alias("own")).agg(*(F.first(c).alias(c) for c in ("parent", "start", "depth")), F.max(at_end).alias("ended"), F.first(lengths).alias("chars"))
        trunk.append(materialize(nodes, "trunk"))
        below = open_.filter(F.size("turns") > F.col("depth")).select(
            "whole", "n", "conv_id", "turns", key_of(F.col("depth") + 1).alias("top"), F.col("top").alias("parent"), (F.col("depth") + 1).alias("start")
        )
        digests = F.transform("turns", lambda t: t.digest)
        sizes = below.groupBy("top").agg(F.sum(F.size("turns") - F.col("start") + 1).alias("size"), F.min(digests).alias("first"), F.max(digests).alias("last")).filter(F.col("size") > groups_of)
        large = materialize(sizes.select(F.col("top").alias("_large"), common_turns(F.col("first"), F.col("last")).alias("depth")), "crowded")
        if not large.take(1):
            ready.append(below)
            break
        marked = materialize(below.join(large, F.col("top") == F.col("_large"), "left"), "dealt")
        ready.append(marked.filter("_large is null").drop("_large", "depth"))
        open_ = marked.filter("_large is not null").drop("_large")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    return every, trunk


def trie(conversations: DataFrame, groups_of: int | None = None) -> DataFrame:
    """All nodes of the tries of (conv_id, turns), turns as turns_of() gives them: conv_id, the smallest member, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256, over the conversations that end there.
    """
    groups_of = groups_of or TURNS
    named = materialize(conversations.withColumn("whole", key_of(F.greatest(F.size("turns"), F.lit(1)))), "conversations")
    found = named.groupBy("whole").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min_by("turns", "conv_id").alias("turns"))
    found = materialize(found, "sequences")
    turns = found.agg(F.sum(F.size("turns") + 1).alias("n")).first().n or 0
    ready, trunk = split(found, groups_of)
    group = F.pmod(F.xxhash64("top"), F.lit(max(1, -(-turns // groups_of)))).alias("group")
    lists = (F.transform("turns", lambda t: t.digest).alias("digests"), F.transform("turns", lambda t: t.chars).alias("chars"))
    dealt = ready.select(group, "top", "parent", (F.col("start") - 1).alias("skip"), *lists, "n", "conv_id", "whole")
    nodes = materialize(dealt.groupBy("group").applyInPandas(tries, NODE), "nodes")

    tops = nodes.filter("own is not null")
    summary = ["parent", "conv_id", "n_convs", "n_leaves", "saved_tokens"]
    below, levels = tops.select(*summary), []
    for level in reversed(trunk):  # the deepest first
        added = below.groupBy(F.col("parent").alias("of")).agg(
            F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
        )
        n = F.coalesce("n", F.lit(0)) + F.coalesce("ended.n", F.lit(0))
        last = level.join(added, F.col("own") == F.col("of"), "left").select(
            "own", "parent", "start", "depth", "chars", F.col("ended.whole").alias("whole"),
            F.least("least", "ended.conv_id").alias("conv_id"), n.alias("n_convs"), F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (n - 1) * F.element_at("chars", -1)).alias("saved"),
        )
        chain = last.withColumn("at", F.explode(F.sequence("start", "depth")))
        higher = F.aggregate(F.slice("chars", F.col("at") - F.col("start") + 1, F.col("depth") - F.col("at")), F.lit(0).cast("bigint"), lambda a, b: a + b)
        is_last, is_first = F.col("at") == F.col("depth"), F.col("at") == F.col("start")
        every = chain.select(
            F.when(is_first, F.col("own")).alias("own"),
            F.when(is_first, F.col("parent")).alias("parent"),
            "conv_id",
            F.col("at").cast("bigint").alias("depth"),
            F.when(~is_first, F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.when(is_last, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"),
            "n_leaves",
            (F.col("saved") + (F.col("n_convs") - 1) * higher).alias("saved_tokens"),
            F.when(is_last, F.col("whole")).alias("whole"),
        )
        levels.append(materialize(every, "trunk"))
        below = tops.select(*summary).unionByName(levels[-1].filter("own is not null").select(*summary))
    of_trunk = levels[0]
    for level in levels[1:]:
        of_trunk = of_trunk.unionByName(level)
    root = levels[-1].select("conv_id").first()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "whole"]
    every = nodes.unionByName(of_trunk)
    # What hangs below the root, which may be most tops, has its id as a constant; other trunk nodes are looked up.
    of_root = every.filter("parent = ''").withColumn("parent_conv_id", F.lit(root.conv_id if root else None).cast("bigint"))
    above = of_trunk.filter("own <> ''").select(F.col("own").alias("up"), F.col("conv_id").alias("up_conv_id"))
    of_others = every.filter("parent <> ''").drop("parent_conv_id").join(above, F.col("parent") == F.col("up")).withColumnRenamed("up_conv_id", "parent_conv_id")
    rest = every.filter("parent is null")
    joined = rest.select(*columns).unionByName(of_root.select(*columns)).unionByName(of_others.select(*columns))
    return joined.join(ends(named.select("whole", "conv_id")), "whole", "left").select(*columns[:-1], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
