"""Yinyang Lloyd against plain Lloyd in unlimited integers."""

import random

import numpy as np
import pytest

from tidemark.llm import codebooks

KINDS = "vec_id long, embedding array<float>, label int, code string"


def plain(rows):
    """{vec_id: (code, error)} and all final entries, by the definition; rows are (vec_id, components)."""
    scaled = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in sorted(rows)]
    parts = codebooks.widths(len(scaled[0][1]))
    books = [[v[p] for _, v in scaled[:256]] for p in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p, book in zip(parts, books, strict=True):
            members = {}
            for _, v in scaled:
                members.setdefault(nearest(v[p], book)[1], []).append(v[p])
            for i, xs in members.items():
                book[i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = {}
    for i, v in scaled:
        best = [nearest(v[p], book) for p, book in zip(parts, books, strict=True)]
        found[i] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best))
    return found, books


def compared(spark, rows):
    codes, entries = codebooks.train(spark.createDataFrame([(i, v, i % 3, "x") for i, v in rows], KINDS).repartition(5))
    found = {r.vec_id: (bytes(r.code).hex(), r.error) for r in codes.collect()}
    right, books = plain(rows)
    assert found == right
    assert [e.tolist() for e in entries] == books


def test_equals_plain_lloyd_with_many_ties(spark):
    rng = random.Random(3)
    compared(spark, [(i, [rng.randint(-3, 3) / 4 for _ in range(8)]) for i in range(700)])  # few values: equal parts, equal distances


def test_equals_plain_lloyd_on_clusters(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(40)]
    compared(spark, [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(900)])


def test_fewer_rows_than_entries_and_uneven_parts(spark):
    rng = random.Random(5)
    compared(spark, [(i, [rng.gauss(0, 1) for _ in range(10)]) for i in range(30)])


def test_wide_components_stay_exact(spark):
    rng = random.Random(6)
    compared(spark, [(i, [rng.uniform(-120_000, 120_000) for _ in range(8)]) for i in range(300)])


def test_most_groups_are_skipped_once_entries_rest():
    rng = np.random.default_rng(1)
    x = (rng.choice(rng.normal(0, 1000, (256, 16)), 4_000) + rng.normal(0, 10, (4_000, 16))).astype(np.int64)
    book = codebooks.Codebook.of(x[:256].copy())
    code, _, lower = codebooks.assign(x, book, None, None)
    again, square, _ = codebooks.assign(x, book, code, lower)
    assert (again == code).all() and (square == ((x - book.entries[code]) ** 2).sum(axis=1)).all()
    assert (lower > np.sqrt(square)[:, None]).mean() > 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -1.0, 2.0], None, "a"), (1, [0.5, 1.0, -1.0, 2.0], None, "a"), (2, None, 1, "a"), (3, [nan, 0.0, 0.0, 0.0], 1, "a"), (4, [inf, 0.0, 0.0, 0.0], 1, "a")]
    rows += [(5, [1.0, None, 0.0, 0.0], 1, "a"), (6, [], 1, "a"), (7, [1.0, 2.0], 1, "a"), (None, [1.0, 1.0, 1.0, 1.0], None, "a"), (8, [0.0, 0.0, 0.0, 0.0], 2, None), (9, [3e5, 0.0, 0.0, 0.0], 2, None)]
    codes, entries = codebooks.train(spark.createDataFrame(rows, KINDS))
    found = codebooks.with_label_error(codes).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == [(False, 1), (False, 1), (False, 8), (True, 0)]
    assert all(r.error == 0 for r in found) and {r.label for r in found} == {None, 2} and [len(e) for e in entries] == [4] * 4


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "a")]])
def test_no_rows(spark, rows):
    codes, entries = codebooks.train(spark.createDataFrame(rows, KINDS))
    assert codebooks.with_label_error(codes).count() == 0 and codebooks.digest(entries) == codebooks.digest([])
