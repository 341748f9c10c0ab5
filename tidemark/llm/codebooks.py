"""Vector codes by product quantization whose codebooks are trained by Yinyang Lloyd, in integers.

Each component x becomes floor(SCALE * x). Vectors are cut into PARTS consecutive parts of equal length (the first ones are longer by one
where the length does not divide); each part's codebook starts as that part of the ENTRIES rows of smallest ids. Each of ROUNDS rounds
assigns every part to its nearest entry and moves each entry to the floored mean of its parts; unused entries stay. Then parts are
assigned once more.

Yinyang. The entries of a codebook are clustered once into groups of about ten. A row keeps, for each part and group, a lower bound of
the distance to the group's entries other than its own. A round lowers that bound by the group's largest drift, computes the exact
distance to the row's own entry, and scans only the groups whose bound isn't above it. Bounds are rounded down and distances up, so a
group that is skipped holds no entry as near; those scanned are compared by exact integer squares, ties to the lower index. So the result
is that of plain Lloyd.

Rows and bounds of a round are a table in the shared folder, so a lost executor loses nothing; the round before it goes. The sums of a
round are added up in each task and then by Spark; only entries (ENTRIES * PARTS) reach the driver.

Cases: vectors that are null, empty, hold null or non-finite components or components of WIDEST and more (whose squared errors a long
cannot hold), or have another length than the kept vector of the smallest id take no part; rows of one id count each (equal ids by their
components); null ids come last; fewer rows than ENTRIES give fewer entries; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS, WIDEST = 1024, 4, 256, 4, 1 << 17
#: Entries in a group on average, rows that are assigned at once, relative room for the rounding of square roots, labels sent to all tasks.
PER_GROUP, ROWS, ROOM, SENT_LABELS = 10, 8_192, 1e-9, 10_000


@dataclass
class Codebook:
    """The entries of one part (rows of int64), the group of each, and how far each group has moved in the last round at most."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Codebook:
        n = max(1, len(entries) // PER_GROUP)
        points = entries.astype(np.float64)
        centres = points[np.linspace(0, len(points) - 1, n).astype(int)]
        for _ in range(5):  # any grouping gives right results; near entries in one group give tight bounds
            group = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.stack([points[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(n)])
        return Codebook(entries, group, np.zeros(n))

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebook:
        """With each used entry at its parts' floored mean."""
        entries = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], self.entries)
        far = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=1)) * (1 + ROOM)
        return Codebook(entries, self.group, np.array([far[self.group == g].max(initial=0) for g in range(len(self.drift))]))


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows from all entries."""
    most = 2 * max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64  # floats are exact there, and faster
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def assign(x: np.ndarray, book: Codebook, code: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared distances, lower bounds by group) of rows x, whose codes and bounds of the last round are given, if any."""
    n, groups = len(x), len(book.drift)
    rows = np.arange(n)
    if code is None:
        own, best_square = None, np.full(n, np.iinfo(np.int64).max)
        best, lower = np.full(n, len(book.entries)), np.zeros((n, groups))
    else:
        own = ((x - book.entries[code]) ** 2).sum(axis=1)
        best, best_square = code.astype(np.int64), own.copy()
        lower = lower.astype(np.float64) - book.drift
    second = np.zeros((n, groups))
    scanned = np.zeros((n, groups), bool)
    for g in range(groups):
        members = np.flatnonzero(book.group == g)
        if not len(members):
            lower[:, g] = np.inf
            continue
        open_ = np.flatnonzero(lower[:, g] <= np.sqrt(best_square) * (1 + ROOM))
        if not len(open_):
            continue
        d = squares(x[open_], book.entries[members])
        at = d.argmin(axis=1)
        least = d[np.arange(len(open_)), at]
        first = members[at]
        d[np.arange(len(open_)), at] = np.iinfo(np.int64).max
        scanned[open_, g] = True
        lower[open_, g], second[open_, g] = np.sqrt(least), np.sqrt(d.min(axis=1))
        better = (least < best_square[open_]) | ((least == best_square[open_]) & (first < best[open_]))
        best[open_[better]], best_square[open_[better]] = first[better], least[better]
    of_best = book.group[best]
    seen = scanned[rows, of_best]
    lower[rows[seen], of_best[seen]] = second[rows[seen], of_best[seen]]  # without the row's own entry
    if own is not None:
        left = np.flatnonzero(best != code)  # the entry left counts in its group again
        of_old = book.group[code[left]]
        lower[left, of_old] = np.minimum(lower[left, of_old], np.sqrt(own[left]))
    low = (lower * (1 - ROOM)).astype(np.float32)
    return best.astype(np.uint8), best_square, np.nextafter(low, np.float32(-np.inf))


def widths(dimension: int) -> list[slice]:
    """Where the parts of a vector lie."""
    ends = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(dimension), PARTS))]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _matrix(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    """Binary values of one length, as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def quantised(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, x): x holds the scaled components as 32-bit integers."""
    usable = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < WIDEST), F.lit(False)))
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.floor(np.asarray(v, np.float64) * SCALE).astype(np.int32).tobytes() for v in batch.column("v").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(x, pa.binary())], ["vec_id", "label", "x"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary")


def assigned(state: DataFrame, books: list[Codebook], bounds: bool = True) -> DataFrame:
    """The rows with their codes, their error and, if asked for, the bounds of the next round."""
    parts = widths(sum(b.entries.shape[1] for b in books))
    known = "code" in state.columns
    names = ["vec_id", "label", "x", "code", "error", "bounds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                n = batch.num_rows
                x = _matrix(batch.column("x"), np.int32, n).astype(np.int64)
                codes, error, kept, at = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64), [], 0
                if known:
                    before, lower = _matrix(batch.column("code"), np.uint8, n), _matrix(batch.column("bounds"), np.float32, n)
                for p, book in enumerate(books):
                    width = len(book.drift)
                    codes[:, p], square, low = assign(x[:, parts[p]], book, before[:, p] if known else None, lower[:, at : at + width] if known else None)
                    error += square
                    kept.append(low)
                    at += width
                low = np.concatenate(kept, axis=1) if bounds else np.zeros((n, 0), np.float32)
                columns = [batch.column("vec_id"), batch.column("label"), batch.column("x"), _binary(codes), pa.array(error), _binary(low) if bounds else pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    return state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary, code binary, error bigint, bounds binary")


def sums(state: DataFrame, dimension: int) -> DataFrame:
    """For each part and entry in use: number of parts and their sums (key = part * ENTRIES + entry)."""
    parts = widths(dimension)
    most = max(s.stop - s.start for s in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS * ENTRIES, most), np.int64), np.zeros(PARTS * ENTRIES, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, code = _matrix(batch.column("x"), np.int32, batch.num_rows).astype(np.int64), _matrix(batch.column("code"), np.uint8, batch.num_rows)
                for p, s in enumerate(parts):
                    order = np.argsort(code[:, p], kind="stable")
                    found, first, n = np.unique(code[order, p], return_index=True, return_counts=True)
                    keys = p * ENTRIES + found.astype(np.int64)
                    total[keys, : s.stop - s.start] += np.add.reduceat(x[order, s], first, axis=0)
                    count[keys] += n
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["key", "n", "s"])

    added = state.select("x", "code").mapInArrow(run, "key bigint, n bigint, s array<bigint>")
    return added.groupBy("key").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(most))).alias("s"))


def train(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code binary, error) of each kept row, and the final entries of each part."""
    rows = materialize(quantised(vectors, vec_id, vector, label), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), "x"]
    first = rows.orderBy(*order).limit(1).select("x").collect()
    if not first:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("bigint").alias("error")), []
    rows = rows.filter(F.length("x") == len(first[0].x))  # rows of another length take no part
    start = np.stack([np.frombuffer(r.x, np.int32) for r in rows.orderBy(*order).limit(ENTRIES).select("x").collect()]).astype(np.int64)
    parts = widths(start.shape[1])
    books = [Codebook.of(start[:, s]) for s in parts]
    state = rows
    for _ in range(ROUNDS):
        earlier, state = state, materialize(assigned(state, books), "assigned")
        if earlier is not rows:
            discard(earlier)
        counts, totals = np.zeros(PARTS * ENTRIES, np.int64), np.zeros((PARTS * ENTRIES, max(s.stop - s.start for s in parts)), np.int64)
        for r in sums(state, start.shape[1]).collect():  # a row for each entry of each part at most
            counts[r.key], totals[r.key] = r.n, r.s
        for p, s in enumerate(parts):
            own = slice(p * ENTRIES, p * ENTRIES + len(books[p].entries))
            books[p] = books[p].moved(totals[own, : s.stop - s.start], counts[own])
    last = materialize(assigned(state, books, bounds=False).select("vec_id", "label", "code", "error"), "codes")
    discard(state)
    return last, [b.entries for b in books]


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over rows of one label (null labels are one; null if a long cannot hold it)."""
    by_label = materialize(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of_label")
    if by_label.count() <= SENT_LABELS:
        by_label = F.broadcast(by_label)
    return codes.join(by_label, codes.label.eqNullSafe(by_label.of_label)).drop("of_label")


def digest(entries: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(v) for e in entries for v in e.ravel().tolist()).encode()).hexdigest()
