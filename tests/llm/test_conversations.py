"""Prefix tries against nodes that are counted one by one."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations

TURN = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(convs):
    """All nodes of {conv_id: ((role, text), ...)}, by the definition."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        saved[p] = sum(saved[b] for b in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if convs[c] == p))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], digest(p)) for p, m in members.items()
    )


def nodes(df):
    return sorted(tuple(r[c] for c in NODE) for r in df.collect())


def table(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return conversations.turns_of(spark.createDataFrame(rows, TURN))


def some(rng, n):
    """Conversations that share beginnings of any length; many copies of one."""
    found = {}
    for c in range(n):
        turns = found[rng.randrange(c)] if c and rng.random() < 0.7 else ()
        turns = turns[: rng.randint(0, len(turns))] + tuple((rng.choice("ab"), rng.choice(["x", "yé", "z" * 9])) for _ in range(rng.randint(0, 4)))
        found[c] = turns or (("a", "only"),)
    return found


@pytest.mark.parametrize("groups_of", [3, 40, 100_000])
def test_equals_nodes_counted_one_by_one(spark, groups_of):
    convs = some(random.Random(groups_of), 120)
    assert nodes(conversations.trie(table(spark, convs), groups_of)) == brute(convs)


def test_turns_that_all_of_a_large_group_share_are_passed_over(spark):
    long = tuple(("u", f"t{i}") for i in range(150))
    convs = {i: (*long[: 100 + i], ("u", f"own {i}")) for i in range(0, 50, 10)} | {50 + i: (*long, ("v", str(i))) for i in range(10)} | {100: long, 101: long, 102: (("u", "t0"),)}
    df = conversations.trie(table(spark, convs), 200)
    assert nodes(df) == brute(convs)


def test_deep_conversations(spark):
    convs = {1: tuple(("u", str(i)) for i in range(5_000)), 2: tuple(("u", str(i)) for i in range(4_000))}
    assert nodes(conversations.trie(table(spark, convs))) == brute(convs)


def test_copies_of_one_conversation(spark):
    convs = dict.fromkeys(range(500), (("u", "hello"), ("a", "hi"))) | {900: (("u", "hello"),)}
    found = nodes(conversations.trie(table(spark, convs)))
    assert found == brute(convs) and [r[3] for r in found] == [501, 501, 500]


def test_shared_heads(spark):
    convs = {c: tuple(("u", f"{c}-{i}") for i in range(c % 8 + 1)) for c in [*range(0, 30), 101, 102, 250, 299, 300, 305]} | {c: (("u", "lone"),) for c in range(401, 408)}

    def rebuilt(c):
        h = zlib.crc32(str(c).encode()) % 6
        return convs.get(c - c % 100, ())[:h] + convs[c][h:]

    conv_id = F.col("conv_id")
    heads = conversations.with_shared_heads(table(spark, convs), conv_id - conv_id % 100, F.crc32(conv_id.cast("string").cast("binary")) % 6, 5)
    right = {c: rebuilt(c) for c in convs}
    assert () in right.values()  # a conversation without turns is a member of the root
    assert nodes(conversations.trie(heads)) == brute(right)
    assert nodes(conversations.trie(heads, 2)) == brute(right)


def test_odd_rows(spark):
    rows = [(1, None, "u", "first"), (1, 5, "u", "b"), (1, 5, "u", "b"), (2, 0, None, None), (2, 1, "", ""), (3, 0, "", None), (None, 0, "u", "x"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "t", "w") for r in rows], TURN + ", top string, whole string")
    convs = {1: (("u", "first"), ("u", "b"), ("u", "b")), 2: (("", ""), ("", "")), 3: (("", ""),)}
    assert nodes(conversations.trie(conversations.turns_of(df))) == brute(convs)
    long = "x" * 3_000_000
    convs = {1: (("u", long), ("a", "y")), 2: (("u", long),)}
    assert nodes(conversations.trie(table(spark, convs))) == brute(convs)


def test_role_and_text_do_not_run_together(spark):
    convs = {1: (("ab", "c"),), 2: (("a", "bc"),), 3: (("", "abc"),), 4: (("1:a", ""),)}
    assert nodes(conversations.trie(table(spark, convs))) == brute(convs)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")]])
def test_no_conversations(spark, rows):
    assert conversations.trie(conversations.turns_of(spark.createDataFrame(rows, TURN))).count() == 0
