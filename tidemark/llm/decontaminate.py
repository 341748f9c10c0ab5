"""Which words of training documents lie in phrases of a benchmark: a distributed positional inverted index.

1. Each benchmark item gives its windows of WIDTH consecutive words (one of all words if it has fewer).
2. The index: the postings (term, document, position) of the training documents, stored as a table in the shared folder. A
   posting is left out only where no phrase can lie: an occurrence of a window is a run of words each pair of which follow
   each other in some window, so positions outside such runs of the shortest window's length are not needed (windows of one
   word need their words only). Pairs and words are sent to the tasks if there are at most PAIRS; beyond that every position is stored.
3. Each window starts from its rarest term, that with the fewest postings over the whole corpus: each of its postings, moved by the
   term's offset in the window, is a place where the window may stand.
4. These places are intersected with the second rarest term's list moved by its own offset, and what is left with the lists of
   all other terms at once: a place counts if every term of the window has its posting there.
5. Hits of one document are merged into intervals, so words in several windows count once.

proximity() finds the documents in which all terms of a phrase lie within a span, in any order, from the same postings.

Cases: null texts have no words and no hits; repeated rows give equal rows; rows of one doc_id with other texts are judged
apart; an item without id counts for hits but not for items; empty tables give no hits; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import byte_slices, materialize, text_of
from .words import ALPHANUMERIC, hashed_words, mixed

WIDTH, PAIRS, SLICE_BYTES = 13, 500_000, 1 << 20


def term_lists(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """ids and the term hashes of each text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text, SLICE_BYTES):
            hashes, counts = hashed_words(batch.column(text), ALPHANUMERIC)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), lists], [*ids, "terms"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)
    return df.select(*ids, text_of(text).alias(text)).mapInArrow(run, fields + ", terms array<bigint>")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, terms, item_id) of each item's windows. window: a hash of the terms."""
    lists = term_lists(items, ["item_id"]).filter(F.size("terms") > 0)
    n = F.greatest(F.size("terms") - width, F.lit(0))
    each = lists.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("terms", i + 1, width))).alias("terms"))
    return each.select(F.xxhash64("terms").alias("window"), "terms", "item_id").distinct()


def document_key():
    """Tells apart rows of one doc_id by their texts."""
    return F.xxhash64("doc_id", text_of())


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(3) + b)


def _bounded(df: DataFrame) -> np.ndarray | None:
    """The rows as numbers if there are at most PAIRS, else nothing."""
    got = df.distinct().limit(PAIRS + 1).toArrow()
    return None if got.num_rows > PAIRS else np.stack([c.to_numpy().view(np.uint64) for c in got.columns], axis=1).reshape(-1, len(got.columns))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones."""
    if not known.size:
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), known.size - 1)] == values


def indexed(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, terms, places) of each document: the terms and positions of its postings.

    distinct: the windows' terms. key tells apart rows of one doc_id.
    """
    spark = docs.sparkSession
    n = F.size("terms")
    long = distinct.filter(n > 1)
    follow = long.select(F.explode(F.arrays_zip(F.slice("terms", 1, n - 1).alias("a"), F.slice("terms", 2, n - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    shortest = long.agg(F.min(n)).first()[0] or 2
    pairs, words = _bounded(follow), _bounded(distinct.filter(n == 1).select(F.get("terms", F.lit(0)).alias("a")))
    pairs = None if pairs is None else np.sort(_pair(pairs[:, 0], pairs[:, 1]))
    words = None if words is None else np.sort(words[:, 0])
    sent = spark.sparkContext.broadcast((pairs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = sent.value  # None: too many to send, every position is kept
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            hashes, counts = hashed_words(batch.column("text"), ALPHANUMERIC)
            begin = np.cumsum(counts) - counts
            doc = np.repeat(np.arange(len(counts)), counts)
            linked = np.zeros(len(hashes), bool)  # to the word before
            linked[1:] = doc[1:] == doc[:-1]
            if pairs is not None:
                linked[1:] &= _among(_pair(hashes[:-1], hashes[1:]), pairs)
            starts = np.flatnonzero(~linked)
            size = np.diff(np.append(starts, len(hashes)))
            kept = np.repeat(size >= shortest, size)
            kept |= True if words is None else _among(hashes, words)  # windows of one word
            at = np.flatnonzero(kept)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(counts)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes[at].view(np.int64), at - begin[doc[at]])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(counts), *lists], ["key", "doc_id", "n_words", "terms", "places"])

    rows = docs.select(document_key().alias("key"), "doc_id", text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"key bigint, doc_id {kind}, n_words bigint, terms array<bigint>, places array<bigint>")


def postings(index: DataFrame) -> DataFrame:
    """(term, key, doc_id, place)."""
    each = index.select("key", "doc_id", F.explode(F.arrays_zip("terms", "places")).alias("p"))
    return each.select(F.col("p.terms").alias("term"), "key", "doc_id", F.col("p.places").alias("place"))


def occurrences(lists: DataFrame, distinct: DataFrame) -> DataFrame:
    """(key, doc_id, window, start, length) of each place where a window's terms stand one after another. lists: postings."""
    frequency = lists.groupBy("term").agg(F.count(F.lit(1)).alias("n"))  # summed before the shuffle, so a hot term is one row a task
    wanted = distinct.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term")).join(frequency, "term", "left")
    ordered = wanted.groupBy("window", "size").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("by"), F.count("n").alias("known"))
    ordered = materialize(ordered.filter(F.col("known") == F.col("size")), "window-terms")  # a term without postings: the phrase is nowhere
    offset = F.col("t.offset").cast("long")
    anchors = ordered.select("window", "size", "by", F.expr("by[0]").alias("t"))
    begun = anchors.join(lists, F.col("t.term") == F.col("term")).select("window", "size", "by", "key", "doc_id", (F.col("place") - offset).alias("start")).filter("start >= 0")

    def met(begun: DataFrame, first: int, last) -> DataFrame:
        """The places where the lists of the terms from `first` on, `last` of them, have their postings too."""
        few = F.slice("by", F.lit(first + 1), F.greatest(last, F.lit(0)))
        each = begun.filter(F.size(few) > 0).select("window", "size", "by", "key", "doc_id", "start", F.explode(few).alias("t"))
        each = each.withColumns({"_term": F.col("t.term"), "_place": F.col("start") + offset, "_key": F.col("key"), "_id": F.col("doc_id")}).drop("key", "doc_id")
        same = (F.col("_term") == F.col("term")) & (F.col("_key") == F.col("key")) & (F.col("_place") == F.col("place")) & F.col("_id").eqNullSafe(F.col("doc_id"))
        found = each.join(lists, same).groupBy("window", "size", "key", "doc_id", "start").agg(F.first("by").alias("by"), F.size(F.collect_set("_place")).alias("m"))
        found = found.filter(F.col("m") == F.least(last, F.col("size") - first)).select("window", "size", "by", "key", "doc_id", "start")
        return found.unionByName(begun.filter(F.size(few) <= 0))

    begun = begun.distinct()  # repeated rows
    second = met(begun, 1, F.lit(1))
    return met(materialize(second, "second-terms"), 2, F.col("size") - 2).select("key", "doc_id", "window", "start", F.col("size").cast("long").alias("length"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each document: doc_id, key, n_words, n_hit, n_items, item_ids (sorted strings)."""
    each = materialize(windows(items, width), "benchmark-windows")
    distinct = each.groupBy("window").agg(F.first("terms").alias("terms"))
    index = materialize(indexed(docs, distinct), "postings")
    found = materialize(occurrences(postings(index), distinct), "occurrences")
    # Each start counts the words up to the next start, its window's length at most; of equal starts the longest window.
    starts = found.groupBy("key", "doc_id", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    by = W.partitionBy("key", "doc_id").orderBy("start")
    upto = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    covered = starts.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(upto, F.lit(0)))))
    hits = covered.groupBy("key", "doc_id").agg(F.sum("new").alias("n_hit"))
    named = found.select("key", "doc_id", "window").distinct().join(each.select("window", F.col("item_id").cast("string").alias("item")), "window")
    named = named.groupBy("key", "doc_id").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))  # a null doc_id is one too
    named = named.withColumnsRenamed({"key": "_key", "doc_id": "_id"})
    hits = hits.join(named, same, "left").select("key", "doc_id", "n_hit", "item_ids").withColumnsRenamed({"key": "_key", "doc_id": "_id"})
    rows = index.select("key", "doc_id", "n_words")
    joined = rows.join(hits, same, "left")
    return joined.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def is_contaminated():
    """The rule of the contract: hit at all, and in a twentieth of its words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def proximity(docs: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """(doc_id, key, item_id) where all distinct terms of an item lie within `span` words, in any order.

    The documents come from the postings of the item's rarest term. There the item's postings go in order of place, and each looks
    back over the `span` places up to its own. key tells apart rows of one doc_id.
    """
    wanted = term_lists(items, ["item_id"]).select("item_id", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    texts = docs.select(document_key().alias("key"), "doc_id", F.col("text"))
    lists = term_lists(texts, ["key", "doc_id"]).select("key", "doc_id", F.posexplode("terms").alias("place", "term")).join(wanted.select("term").distinct(), "term", "left_semi")
    lists = materialize(lists.distinct(), "proximity-postings")
    frequency = lists.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    need = wanted.join(frequency, "term", "left").groupBy("item_id").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.collect_set("term").alias("all"), F.count("n").alias("known"))
    need = need.filter(F.col("known") == F.size("all"))
    begun = lists.join(need, "term").select("key", "doc_id", "item_id", "all").distinct()
    begun = begun.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), "item_id", F.size("all").alias("size"), F.explode("all").alias("_term"))
    near = begun.join(lists, (F.col("_term") == F.col("term")) & (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    back = W.partitionBy("key", "doc_id", "item_id").orderBy("place").rangeBetween(-(span - 1), 0)
    return near.withColumn("met", F.size(F.collect_set("term").over(back))).filter(F.col("met") == F.col("size")).select("doc_id", "key", "item_id").distinct()
