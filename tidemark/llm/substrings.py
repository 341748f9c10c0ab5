"""Repeated passages of WINDOW words and more, by prefix-partitioned suffix trees.

A suffix is what follows a word of a text. Only its first WINDOW words matter: they are its path, a string of five symbols, each the
fingerprint of the words up to one of the DEPTHS (the last has 64 bits, the others 16). Two suffixes meet at a node of depth WINDOW
exactly if a document repeats WINDOW words of another.

1. Anchors. Of the runs of GRAM words within a window the one of least hash is its anchor, so equal windows have equal anchors, and there is
   one in about (WINDOW - GRAM) / 2 words. Anchors that lie in one document only rule out their windows; the rest are candidates.
   The same pass counts all suffixes by prefix, at each depth, in BUCKETS classes.
2. Prefixes. A suffix belongs to the shortest of its prefixes whose class holds SUFFIXES at most, else to its whole path. So a prefix is as
   long as its frequency needs, and equal windows are never parted. Suffixes of short frequent prefixes share a group by hash.
3. Suffixes. Documents meet their candidate anchors and give the suffixes there, packed by group. Of one window, a task sends the smallest
   document only; its other documents are settled there. So a passage that many documents hold is sent once by each task.
4. Trees. A group is sorted by path; the depth to which neighbours agree gives the tree, whose nodes of depth WINDOW and more are the
   repeats. All documents of such a node but its smallest are told.
5. Spans. Documents meet what they were told; the windows that repeat an earlier document are united to maximal spans.

The text is dealt by document once for 3 and 5. Work and memory grow with the text, not with the square of a group.

Words are runs of anything but white space, unchanged. Cases: a null text has no words; a document of fewer words than WINDOW loses
none and is no source; a window that repeats in its own document only stays; rows of one doc_id are one document (each loses what an
earlier id has); rows whose doc_id is null lose nothing and are no source; texts of any length are taken whole; an empty table gives no
rows; other columns are not looked at. doc_id is an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import byte_slices, materialize, text_of
from .words import CASED_BETWEEN_SPACES, buffer_of, hashed_words, mixed, rolling, sliding_min, word_bounds

WINDOW, GRAM, DEPTHS = 50, 20, (4, 10, 20, 34, 50)
#: Classes of prefixes, suffixes in a group at most (on average and by prefix), bytes of text and suffixes held at once.
BUCKETS, SUFFIXES, SLICE, HELD = 1 << 14, 1 << 17, 4 << 20, 1 << 20

PAIR = np.dtype([("doc", np.int64), ("path", np.uint64)])
SUFFIX = np.dtype([(f"to{d}", np.uint16) for d in DEPTHS[:-1]] + [("path", np.uint64), ("doc", np.int64)])


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words; the words at which windows begin; the row of each window."""
    hashes, counts = hashed_words(texts, CASED_BETWEEN_SPACES)
    n = np.maximum(counts - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    first = np.cumsum(counts) - counts
    return hashes, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row], row


def anchors_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return sliding_min(rolling(hashes, GRAM), WINDOW - GRAM + 1)[at]


def bucket(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(40)).astype(np.int64) % BUCKETS


def anchors(docs: DataFrame) -> DataFrame:
    """(kind, a, b): of kind 0 each anchor a of document b, of kind 1 the number b of suffixes whose prefix is of depth and class a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(DEPTHS) - 1) * BUCKETS, np.int64)
        for whole in batches:
            for batch in byte_slices([whole], "text", SLICE):
                hashes, at, row = windows_of(batch.column("text"))
                if not len(at):
                    continue
                docs_at = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                found = anchors_of(hashes, at)
                new = np.ones(len(at), bool)
                new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                for i, d in enumerate(DEPTHS[:-1]):
                    counts[i * BUCKETS : (i + 1) * BUCKETS] += np.bincount(bucket(rolling(hashes, d)[at]), minlength=BUCKETS)
                a, b = found[new].view(np.int64), docs_at[row[new]]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int8)), pa.array(a), pa.array(b)], ["kind", "a", "b"])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int8)), pa.array(used), pa.array(counts[used])], ["kind", "a", "b"])

    return docs.mapInArrow(run, "kind tinyint, a bigint, b bigint")


def candidates(found: DataFrame) -> DataFrame:
    """(doc_id, anchors) of the anchors that lie in two documents at least."""
    own = found.filter("kind = 0").select("a", "b")
    repeated = own.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).filter("least < most").select("a")
    return own.join(repeated, "a").groupBy(F.col("b").alias("doc_id")).agg(F.collect_set("a").alias("anchors"))


def crowded(found: DataFrame) -> tuple[np.ndarray, int]:
    """Which classes of prefixes hold more than SUFFIXES, and how many groups there are."""
    counts = np.zeros((len(DEPTHS) - 1, BUCKETS), np.int64)
    for r in found.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).collect():  # a row for each class at most
        counts[r.a // BUCKETS, r.a % BUCKETS] = r.n
    return counts > SUFFIXES, max(1, int(-(-counts[0].sum() // SUFFIXES)))


def grouped_by_prefix(prints: list[np.ndarray], large: np.ndarray, groups: int) -> np.ndarray:
    """The group of each suffix: of its shortest prefix that is rare enough."""
    group = prints[-1] % np.uint64(groups)
    for d in reversed(range(len(DEPTHS) - 1)):
        group = np.where(large[d][bucket(prints[d])], group, mixed(prints[d] + np.uint64(d)) % np.uint64(groups))
    return group.astype(np.int64)


def told(doc: np.ndarray, path: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each document, the windows that an earlier one has."""
    order = np.argsort(doc, kind="stable")
    doc, path = doc[order], path[order]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(doc)] if len(doc) else [], strict=True):
        yield int(doc[a]), path[a:b].tobytes()


def suffixes(docs: DataFrame, large: np.ndarray, groups: int) -> DataFrame:
    """(kind, key, held): of kind 0 the packed suffixes of group `key`, of kind 1 windows of document `key` that an earlier one has."""

    def sent(held: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((held["doc"], held["s"]["path"]))
        held = held[order]
        path, doc = held["s"]["path"], held["doc"]
        first = np.r_[True, path[1:] != path[:-1]]
        least = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        other = (doc != least) & np.r_[True, (doc[1:] != doc[:-1]) | first[1:]]
        rows = [(1, k, v) for k, v in told(doc[other], path[other])]
        kept = held[first]
        kept = kept[np.argsort(kept["group"], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, kept["group"][1:] != kept["group"][:-1]])
        rows += [(0, int(kept["group"][a]), kept["s"][a:b].tobytes()) for a, b in zip(cuts, np.r_[cuts[1:], len(kept)], strict=True)]
        kind, key, packed = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(key, pa.int64()), pa.array(packed, pa.binary())], ["kind", "key", "held"])

    record = np.dtype([("group", np.int64), ("doc", np.int64), ("s", SUFFIX)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for batch in byte_slices([whole], "text", SLICE):
                hashes, at, row = windows_of(batch.column("text"))
                wanted = np.unique(batch.column("anchors").flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
                if not len(at) or not len(wanted):
                    continue
                chosen = np.isin(anchors_of(hashes, at), wanted)
                at, row = at[chosen], row[chosen]
                prints = [rolling(hashes, d)[at] for d in DEPTHS]
                one = np.empty(len(at), record)
                one["group"] = grouped_by_prefix(prints, large, groups)
                one["doc"] = one["s"]["doc"] = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                for d, p in zip(DEPTHS[:-1], prints, strict=False):
                    one["s"][f"to{d}"] = p.astype(np.uint16)
                one["s"]["path"] = prints[-1]
                held.append(one)
                n += len(one)
                if n >= HELD:
                    yield sent(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield sent(np.concatenate(held))

    return docs.mapInArrow(run, "kind tinyint, key bigint, held binary")


def subtree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their paths (then of their documents), and to how many words each agrees with the one before."""
    names = [*(f"to{d}" for d in DEPTHS[:-1]), "path"]
    suffixes = suffixes[np.lexsort([suffixes["doc"], *(suffixes[n] for n in reversed(names))])]
    common, agree = np.zeros(len(suffixes), np.int64), np.ones(max(len(suffixes) - 1, 0), bool)
    for name, depth in zip(names, DEPTHS, strict=True):
        agree &= suffixes[name][1:] == suffixes[name][:-1]
        common[1:][agree] = depth
    return suffixes, common


def later_documents(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, paths) under the nodes of depth WINDOW, without the smallest document of each node."""
    suffixes, common = subtree(suffixes)
    first = np.maximum.accumulate(np.where(common < WINDOW, np.arange(len(suffixes)), 0))
    later = suffixes["doc"] != suffixes["doc"][first]
    return suffixes["doc"][later], suffixes["path"][later]


def repeats(sent: DataFrame) -> DataFrame:
    """(bucket, pairs): packed (document, window that an earlier document has), by buckets of documents, one row of each bucket for a task."""
    buckets = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def close(packed: list[bytes], docs: list[np.ndarray], paths: list[np.ndarray]) -> int:
        doc, path = later_documents(np.frombuffer(b"".join(packed), SUFFIX))
        docs.append(doc)
        paths.append(path)
        return len(doc)

    def given(docs: list[np.ndarray], paths: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.empty(sum(map(len, docs)), PAIR)
        pairs["doc"], pairs["path"] = np.concatenate(docs), np.concatenate(paths)
        bucket = (mixed(pairs["doc"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        packed = [x.tobytes() for x in np.split(pairs[order], first[1:])] if len(found) else []
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, paths, group, packed, n = [], [], None, [], 0
        for batch in batches:
            kinds, keys, held = (batch.column(c).to_pylist() for c in ("kind", "key", "held"))
            for kind, key, one in zip(kinds, keys, held, strict=True):
                if kind:
                    paths.append(np.frombuffer(one, np.uint64))
                    docs.append(np.full(len(paths[-1]), key, np.int64))
                    n += len(paths[-1])
                elif key == group:
                    packed.append(one)
                else:
                    n += close(packed, docs, paths)
                    group, packed = key, [one]
                if n >= HELD:
                    yield given(docs, paths)
                    docs, paths, n = [], [], 0
        close(packed, docs, paths)
        yield given(docs, paths)

    dealt = sent.repartition("kind", "key").sortWithinPartitions("kind", "key")
    return dealt.mapInArrow(run, "bucket bigint, pairs binary")


def by_document(found: DataFrame) -> DataFrame:
    """(doc_id, paths): one row for each document that was told of windows."""

    def given(packed: list[bytes]) -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join(packed), PAIR)
        rows = list(told(pairs["doc"], pairs["path"]))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["doc_id", "paths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, packed = None, []
        for batch in batches:
            for key, pairs in zip(batch.column("bucket").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if key != bucket:
                    yield given(packed)
                    bucket, packed = key, []
                packed.append(pairs)
        yield given(packed)

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id bigint, paths binary")


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, covered.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The words joined by one space."""
    parts = []
    for i in range(0, len(starts), 1 << 18):
        a, n = starts[i : i + (1 << 18)], ends[i : i + (1 << 18)] - starts[i : i + (1 << 18)] + 1
        out = np.cumsum(n)
        index = np.arange(out[-1]) + np.repeat(a - (out - n), n)
        chars = data[np.minimum(index, len(data) - 1)]
        chars[out - 1] = 32
        parts.append(chars.tobytes())
    return b"".join(parts)[:-1].decode()


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, text) of each row: removed holds the spans of words (first, end) that repeat an earlier document."""
    # A column that is one already keeps its name without an alias: with one, the two exchanges of the texts would look different.
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(doc_id, text_of().alias("text"))
    named = rows.filter("doc_id is not null")
    found = materialize(anchors(named), "anchors")
    large, groups = crowded(found)
    named = named.repartition("doc_id")  # both joins below read this one exchange of the texts
    sent = suffixes(named.join(candidates(found), "doc_id").select("doc_id", "text", "anchors"), large, groups)
    whole = named.join(by_document(repeats(sent)), "doc_id", "left").select("doc_id", "text", "paths")
    whole = whole.union(rows.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrived in batches:
            for batch in byte_slices([arrived], "text", SLICE):
                texts = batch.column("text")
                data, offsets = buffer_of(texts)
                starts, ends = word_bounds(data, offsets, CASED_BETWEEN_SPACES)
                border = np.searchsorted(starts, offsets)
                covered = np.zeros(len(starts) + 1, np.int64)
                lists = batch.column("paths").to_pylist()
                if any(lists):
                    hashes, at, row = windows_of(texts)
                    known = [np.frombuffer(p or b"", np.uint64) for p in lists]
                    salt = mixed(np.arange(len(lists), dtype=np.uint64) + np.uint64(1))
                    wanted = mixed(np.concatenate(known) ^ np.repeat(salt, [len(p) for p in known]))
                    at = at[np.isin(mixed(rolling(hashes, WINDOW)[at] ^ salt[row]), wanted)] if len(at) else at
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + WINDOW, -1)
                covered = np.cumsum(covered)[:-1] > 0
                n_words, n_removed, removed, kept = [], [], [], []
                for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
                    gone = covered[a:b]
                    first, end = spans_of(gone)
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    removed.append([{"first": int(f), "end": int(e)} for f, e in zip(first, end, strict=True)])
                    kept.append(kept_words(data, starts[a:b][~gone], ends[a:b][~gone]))
                spans = pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), spans, pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "removed", "text"])

    return whole.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<first:bigint,end:bigint>>, text string")
