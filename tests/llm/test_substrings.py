"""Repeated passages against a brute-force search of all windows."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """[(doc_id, n_words, n_removed, kept text)] by the definition."""
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, words in texts:
        for i in range(len(words) - 49 if d is not None else 0):
            key = tuple(words[i : i + 50])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, words in texts:
        gone = set()
        for i in range(len(words) - 49 if d is not None else 0):
            if least[tuple(words[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def compared(spark, rows):
    found = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in found), key=str) == brute(rows)
    for r in found:
        assert sum(s.end - s.first for s in r.removed) == r.n_removed and all(a.end < b.first for a, b in zip(r.removed, r.removed[1:], strict=False))
    return {r.doc_id: r for r in found}


def some_texts(rng, n):
    """Texts of few words, with passages of 40 to 120 words that several share, at any place."""
    words = [f"w{i}" for i in range(30)] + ["Über", "A", "a"]
    passages = [rng.choices(words, k=rng.randint(40, 120)) for _ in range(12)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choices(words, k=rng.randint(0, 60))
            p = rng.choice(passages)
            text += p[rng.randint(0, 10) : rng.randint(len(p) - 20, len(p))]
        rows.append((i * 3 % n, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows


def test_equals_brute_force(spark):
    compared(spark, some_texts(random.Random(1), 150))


def test_frequent_prefixes_are_extended(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SUFFIXES", 40)
    rows = some_texts(random.Random(2), 80)
    start = "one two three four five six seven eight nine ten eleven twelve"  # a frequent prefix of 12 words
    rows += [(1000 + i, f"{start} " + " ".join(f"v{i % 7}-{j}" for j in range(60))) for i in range(40)]
    compared(spark, rows)


def test_groups_follow_prefixes_of_any_depth():
    prints = [np.array([1, 2, 3], np.uint64) << np.uint64(40 + d) for d in range(5)]
    large = np.zeros((4, substrings.BUCKETS), bool)
    plain = substrings.grouped_by_prefix(prints, large, 1_000)
    large[0, substrings.bucket(prints[0])[:2]] = True
    large[1, substrings.bucket(prints[1])[:1]] = True
    found = substrings.grouped_by_prefix(prints, large, 1_000)
    of = [substrings.mixed(prints[d] + np.uint64(d)) % np.uint64(1_000) for d in range(3)]
    assert plain.tolist() == of[0].tolist() and found.tolist() == [of[2][0], of[1][1], of[0][2]]


def test_subtree_orders_suffixes_and_their_common_depths():
    rng = np.random.default_rng(3)
    suffixes = np.zeros(200, substrings.SUFFIX)
    for name in substrings.SUFFIX.names:
        suffixes[name] = rng.integers(0, 2, 200)
    ordered, common = substrings.subtree(suffixes)
    paths = [tuple(int(s[n]) for n in substrings.SUFFIX.names[:-1]) for s in ordered]
    assert paths == sorted(paths)
    for a, b, depth in zip(paths, paths[1:], common[1:], strict=False):
        same = next((i for i in range(5) if a[i] != b[i]), 5)
        assert depth == (0, *substrings.DEPTHS)[same]


def test_many_copies_and_repeats_within_a_document(spark):
    text = " ".join(f"x{i}" for i in range(130))
    rows = [(i, text) for i in range(300)] + [(500, "go " * 400), (501, "go " * 70 + text), (502, "stop " * 200)]
    found = compared(spark, rows)
    assert found[0].n_removed == 0 and found[299].n_removed == 130 and found[502].n_removed == 0


def test_windows_are_judged_on_the_input(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    compared(spark, [(1, a), (2, a + " " + b), (3, b), (4, b + " " + a)])


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = substrings.dedup(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in found), key=str) == brute(rows)


def test_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(55)) for c in "ab")
    compared(spark, [(2, a), (2, a), (2, b), (1, b), (3, a), (None, a), (None, b)])


def test_control_characters_and_other_spaces_are_words(spark):
    words = " ".join(["\x00", "\x01a", "b\x1f", " ", " x"] * 12)
    compared(spark, [(1, words), (2, words.upper()), (3, "q\r\n" + words + "\x0b\x0cq")])


def test_a_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900_000)]  # more than a slice
    found = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame([(1, " ".join(words[500_000:500_080])), (2, " ".join(words))], "doc_id long, text string")).collect()}
    assert found[2].n_words == 900_000 and [(s.first, s.end) for s in found[2].removed] == [(500_000, 500_080)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)]])
def test_no_words(spark, rows):
    assert [r.text for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [""] * len(rows)
