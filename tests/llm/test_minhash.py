import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import minhash as m
from tidemark.llm import words
from tidemark.llm.words import ALPHANUMERIC, BETWEEN_SPACES, hashed_words, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(docs, k, percent):
    sets = [brute_set(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and (100 * both >= percent * (len(a) + len(sets[j]) - both) and both or docs[i][0] == docs[j][0]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    root = {}
    for i, (n, _) in enumerate(docs):
        root[find(i)] = min(n, root.get(find(i), n))
    return sorted((n, len(sets[i]), root[find(i)] if sets[i] else n) for i, (n, _) in enumerate(docs))


def near_copies(prose, rng, base, n):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(prose).split()[0]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 5])
def test_components_equal_brute_force(spark, prose, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rng = random.Random(5)
    texts = prose[:60] + near_copies(prose, rng, prose[0] + " " + prose[1], 40) + near_copies(prose, rng, prose[2] + " " + prose[3], 15)
    texts += [prose[5]] * 3 + ["One two", "one  two", "one", "", None, "   "]
    rng.shuffle(texts)
    docs = list(enumerate(texts, 10)) + [(10, texts[0])]
    found = m.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute(docs, 3, 85)


def test_odd_rows(odd_docs, no_docs):
    found = m.near_duplicates(odd_docs, 3, 85).collect()
    assert len(found) == 8
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in found)
    assert m.near_duplicates(no_docs, 3, 85).count() == 0


def test_signatures_estimate_similarity_and_stop_early():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = a.copy()
    b[:60] = rng.integers(0, 2**63, 60).astype(np.uint64)
    s = m.super_minhash(np.concatenate([a, b]), np.array([300, 300]), 240)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.1
    # A signature is the same alone and beside others, and each place's value is unique.
    assert (m.super_minhash(b, np.array([300]), 240)[0] == s[1]).all()
    assert len(set(s[0])) == 240
    # Few elements: all ranks are needed, and each element's ranks are a permutation.
    one = m.super_minhash(a[:1], np.array([1]), 16)[0]
    assert sorted(np.floor(one)) == list(range(16))
    assert np.isinf(m.super_minhash(a[:0], np.array([0]), 4)).all()


def test_components_of_chains(spark):
    rng = random.Random(2)
    ids = rng.sample(range(1000), 200)
    edges = [(a, b) for a, b in zip(ids[:99], ids[1:100])] + [(a, b) for a, b in zip(ids[100:199], ids[101:200])] + [(5000, 5000)]
    rng.shuffle(edges)
    found = {r.node: r.root for r in m.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[i] for i in ids[:100]} == {min(ids[:100])}
    assert {found[i] for i in ids[100:]} == {min(ids[100:])}


def test_words_are_those_of_the_patterns():
    rng = random.Random(4)
    texts = ["".join(chr(rng.choice([0, 9, 11, 13, 32, 33, 47, 48, 65, 90, 97, 122, 127, 0xE9, 0x2003, 0x4E00, 0x1F600])) for _ in range(30)) for _ in range(200)] + ["", None, "a"]
    for table, pattern in ((BETWEEN_SPACES, "[^\x20\x09-\x0d]+"), (ALPHANUMERIC, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        hashes, counts = hashed_words(pa.array(texts), table)
        want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_shingles_of_slices():
    texts = pa.array(["pad", "a b c d", "a b", None, "x a b c d"])
    whole = shingles(*hashed_words(texts, BETWEEN_SPACES), 3)
    part = shingles(*hashed_words(texts.slice(1, 3), BETWEEN_SPACES), 3)
    assert whole[1].tolist() == [1, 2, 1, 0, 3]
    assert part[0].tolist() == whole[0][1:4].tolist()


def test_long_texts_part_by_part(prose, monkeypatch):
    """Words, shingles and signatures do not depend on how much is taken at once."""
    texts = pa.array([" ".join(prose[:30]), "", None, "x" * 5000 + " a b", "one two", "a\x00b " * 300, *prose[30:50]])
    whole = [(hashed_words(texts, t), shingles(*hashed_words(texts, t), 3)) for t in (ALPHANUMERIC, BETWEEN_SPACES)]
    signed = m.super_minhash(*whole[1][1], 40)
    monkeypatch.setattr(words, "PIECE", 1000)
    monkeypatch.setattr(words, "MANY_WORDS", 100)
    monkeypatch.setattr(m, "ELEMENTS", 97)
    for table, (hashed, shingled) in zip((ALPHANUMERIC, BETWEEN_SPACES), whole, strict=True):
        again = hashed_words(texts, table)
        assert all((a == b).all() for a, b in zip(again, hashed, strict=True))
        assert all((a == b).all() for a, b in zip(shingles(*again, 3), shingled, strict=True))
    assert (m.super_minhash(*whole[1][1], 40) == signed).all()


def test_memory_of_a_very_long_text():
    """Five million words stay below 1 GB."""
    code = """
import resource, numpy as np, pyarrow as pa
from tidemark.llm import minhash as m
from tidemark.llm.words import BETWEEN_SPACES, hashed_words, shingles
rng = np.random.default_rng(1)
text = pa.array([" ".join(map(str, rng.integers(0, 10**6, 5_000_000).tolist()))])
values, counts = shingles(*hashed_words(text, BETWEEN_SPACES), 3)
assert m.super_minhash(values, counts, 240).max() < 240 and counts[0] > 4_999_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True, cwd=Path(__file__).parents[2])
    assert int(done.stdout) < 1000


def test_other_kinds_of_ids(spark, prose):
    docs = [(f"d{i:03d}", t) for i, t in enumerate([*prose[:5], prose[0], prose[1] + " more"])]
    found = m.near_duplicates(spark.createDataFrame(docs, "doc_id string, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: {"d005": "d000", "d006": "d001"}.get(d, d) for d, _ in docs}
