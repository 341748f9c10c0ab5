"""Byte-level BPE by a pair occurrence index.

The distinct new pre-tokens of a slice of a partition are laid out as one chain of symbols. An index maps each pair of
neighbouring symbols, named by its rank, to all its positions. The ranks present are applied in ascending order, each at all
its positions from left to right, and the lists of the pairs to its left and right are updated: the first COMMON ranks with
their long lists as whole arrays, the others from a heap, position by position. A merge only makes pairs of
higher rank, so this equals merging each word on its own.

Cases: null text is empty; an empty text has no ids; repeated rows give equal rows; other columns pass through, and a
column of the output's name is replaced; a text of any length is encoded whole.
"""

from __future__ import annotations

import functools
import heapq
import json
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import byte_slices, text_of

#: Fixed values of the tokenizer's file format: how byte-level pre-tokenization splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words kept from slice to slice, per Python worker.
CACHE = 200_000
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1_000
SHIFT, MASK = 20, (1 << 20) - 1
#: Ranks that are applied to all their positions at once.
COMMON = 200


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The merges and tokens of a tokenizer file, with ids in place of strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: A pair is one number: its left id shifted, plus its right id.
        self.ranks = {(ids[a] << SHIFT) + ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        order = sorted(self.ranks)
        #: The same for many pairs at once.
        self.pairs = np.array(order, np.int64)
        self.pair_ranks = np.array([self.ranks[p][0] for p in order], np.int64)
        self.by_rank = [((p >> SHIFT, p & MASK), new) for p, (_, new) in sorted(self.ranks.items(), key=lambda x: x[1][0])]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = {i: bytes(letters[c] for c in token) for token, i in ids.items()} | {i: c.encode() for c, i in self.special.items()}
        self.start, self.length, self.bytes = _laid_out([pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)])
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = ids[c]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and each word's number of ids; by one pair index over all of them."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        if not sym.size:
            return sym, length
        last = ends[length > 0] - 1
        after = np.arange(1, sym.size + 1)
        after[last] = -1
        before = np.arange(-1, sym.size - 1)
        before[last[:-1] + 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        at = np.flatnonzero(after >= 0)
        self._enter(index, at, (sym[at] << SHIFT) + sym[at + 1])
        self._merge_common(sym, after, before, index)
        done = np.array(self._merge_rare(sym.tolist(), after.tolist(), before.tolist(), {r: np.concatenate(x).tolist() for r, x in index.items()}))
        kept = done >= 0
        total = np.concatenate([[0], np.cumsum(kept)])
        return done[kept], total[ends] - total[ends - length]

    def _enter(self, index: dict[int, list[np.ndarray]], at: np.ndarray, pairs: np.ndarray) -> None:
        """Adds positions to the lists of their pairs, which are named by rank; pairs that never merge are left out."""
        if not at.size:
            return
        found = np.minimum(np.searchsorted(self.pairs, pairs), self.pairs.size - 1)
        known = self.pairs[found] == pairs
        at, ranks = at[known], self.pair_ranks[found[known]]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist() if ranks.size else (), np.split(at, cuts), strict=False):
            index.setdefault(rank, []).append(part)

    def _merge_common(self, sym: np.ndarray, after: np.ndarray, before: np.ndarray, index: dict[int, list[np.ndarray]]) -> None:
        """Applies the first ranks, whose lists are long, each at all its positions at once."""
        for rank in range(min(COMMON, len(self.by_rank))):
            if rank not in index:
                continue
            at = np.unique(np.concatenate(index.pop(rank)))
            (a, b), new = self.by_rank[rank]
            right = after[at]
            ok = (sym[at] == a) & (right >= 0)
            at, right = at[ok], right[ok]
            ok = sym[right] == b
            at, right = at[ok], right[ok]
            if a == b and at.size:  # in a run of equal symbols every other position merges, from the left
                firsts, taken = [], -1
                for i, j in zip(at.tolist(), right.tolist(), strict=True):
                    if i != taken:
                        firsts.append(i)
                        taken = j
                at = np.array(firsts, np.int64)
                right = after[at]
            if not at.size:
                continue
            sym[at], sym[right] = new, -1
            beyond = after[right]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            front = before[at]
            left = front[front >= 0]
            # A pair of two new symbols is met from both sides; np.unique above takes it once.
            self._enter(index, at[has], (sym[at[has]] << SHIFT) + sym[beyond[has]])
            self._enter(index, left, (sym[left] << SHIFT) + sym[after[left]])

    def _merge_rare(self, sym: list[int], after: list[int], before: list[int], places: dict[int, list[int]]) -> list[int]:
        """Applies the other ranks in ascending order, position by position."""
        active = list(places)
        heapq.heapify(active)
        rank_of, put, by_rank = self.ranks.get, heapq.heappush, self.by_rank
        while active:
            rank = heapq.heappop(active)
            (a, b), new = by_rank[rank]
            at = places.pop(rank, ())
            for i in sorted(at) if a == b else at:  # only equal symbols can overlap
                if sym[i] != a or (j := after[i]) < 0 or sym[j] != b:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if found := rank_of((new << SHIFT) + sym[k]):
                        if (r := found[0]) in places:
                            places[r].append(i)
                        else:
                            places[r] = [i]
                            put(active, r)
                if (k := before[i]) >= 0 and (found := rank_of((sym[k] << SHIFT) + new)):
                    if (r := found[0]) in places:
                        places[r].append(k)
                    else:
                        places[r] = [k]
                        put(active, r)
        return sym

    def split(self, text: str) -> list[str]:
        if self.cut and any(s in text for s in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.words.findall(part))]
        return self.words.findall(text)

    def encode(self, texts: Iterable[str], known: dict[str, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and each text's number of ids. known: the words met before, kept up to date."""
        known = {} if known is None else known
        split = [self.split(t) for t in texts]
        number = {w: i for i, w in enumerate(set(chain.from_iterable(split)))}
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64)
        texts_words = np.fromiter(map(len, split), np.int64, len(split))
        del split
        fresh = [w for w in number if w not in known and w not in self.special]
        ids, counts = self.merge([w.encode() for w in fresh])
        raw, ends = ids.astype(np.int32).tobytes(), np.cumsum(counts * 4)
        known.update((w, raw[a:b]) for w, a, b in zip(fresh, (ends - counts * 4).tolist(), ends.tolist(), strict=True))
        known.update((w, i.to_bytes(4, sys.byteorder)) for w, i in self.special.items())
        start, length, flat = _laid_out([known[w] for w in number])
        start, length, flat = start // 4, length // 4, flat.view(np.int32)
        if len(known) > CACHE:  # the words of this slice stay
            kept = {w: known[w] for w in number}
            known.clear()
            known.update(kept)
        words_before = np.concatenate([[0], np.cumsum(length[which])])
        ends = np.cumsum(texts_words)
        return _gathered(start, length, flat, which), words_before[ends] - words_before[ends - texts_words]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids that lie one after another, counts of them each."""
        raw = _gathered(self.start, self.length, self.bytes, ids).tobytes()
        before = np.concatenate([[0], np.cumsum(self.length[ids])])
        ends = np.cumsum(counts)
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(before[ends - counts].tolist(), before[ends].tolist(), strict=True)]


@functools.lru_cache(4)
def vocabulary_at(path: str) -> Vocabulary:
    """Read once for each Python worker, which serves many tasks."""
    return Vocabulary(path)


def _laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each part starts, its length, and all parts one after another, in bytes."""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.cumsum(length) - length, length, np.frombuffer(b"".join(parts), np.uint8)


def _gathered(start: np.ndarray, length: np.ndarray, flat: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The parts numbered by which, one after another."""
    n = length[which]
    return flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [values], keep + [name])


def bpe_encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of each whole text, and what they decode to if `decoded` names a column for it.

    vocabulary: the tokenizer file's path, as every executor sees it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary_at(vocabulary), {}
        for batch in byte_slices(batches, text, SLICE_BYTES):
            found, counts = v.encode(((t or "") for t in batch.column(text).to_pylist()), known)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            batch = _put(batch, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(found)))
            yield batch if decoded is None else _put(batch, decoded, pa.array(v.decode(found, counts), pa.string()))

    df = df.withColumn(text, text_of(text))
    schema = _with(df.schema, ids, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, schema if decoded is None else _with(schema, decoded, T.StringType()))


def bpe_decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_at(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                column = part.column(ids)
                counts = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield _put(part, text, pa.array(v.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts), pa.string()))

    return df.mapInArrow(run, _with(df.schema, text, T.StringType()))
