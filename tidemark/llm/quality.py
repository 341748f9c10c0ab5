"""Document quality by hierarchical empirical Bayes.

1. Evidence of the document: two logistic models (good, toxic) over figures of the text and sums of the log-odds of its words
   and word beginnings. They are fitted on at most SAMPLE labelled documents, by the order of a hash of the doc_id: the weights
   come from log-odds of the other half of them. Whole texts are learned from and judged alike: tasks count the features of the
   sample and make its rows of figures, and only the WORDS features that say most and these rows reach the driver.
2. Evidence of the site: over all documents, grouped sums of what is known of each host and of each path within a host: the
   label where there is one, else the model's probability. A host's rate is shrunk towards the global rate, a path's towards its
   host's, by beta priors whose strengths come from the spread between hosts, or between paths, beyond chance (method of
   moments). So a site of few documents says little, and hosts that do not differ say nothing. A document is one of its site's
   n documents and is not taken out of its sums again: its share in its own path's rate is 1 / (n + strength).
3. Posterior: the document's log-odds plus the path's log-odds less the global log-odds, for each model.

A document is kept if it is good with probability GOOD or more and toxic with at most TOXIC.

Cases: null and empty texts have the figures of an empty text; null hosts and paths count as empty names; documents without labels and
tables without any are judged by sites alone (prior 1/2) and kept; repeated rows give equal rows; other columns pass through
unless they carry an output's name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import byte_slices, fresh, materialize, text_of

SAMPLE, WORDS, LEAST, GOOD, TOXIC = 8_000, 20_000, 4, 0.5, 0.5
#: Sites that are sent to all tasks; with more of them the documents are joined by a shuffle.
SENT_SITES = 50_000
SLICE_BYTES = 1 << 20
PREFIX = 5
OUTPUTS = ("good", "toxic", "kept", "good_evidence", "toxic_evidence")

_WORD = regex.compile(r"[\p{L}\p{M}]+")


def pieces(text: str) -> tuple[list[str], set[str]]:
    """The words, lower-cased, and the features: distinct words, and beginnings of longer ones with a mark."""
    words = _WORD.findall(text.lower())
    distinct = set(words)
    return words, distinct | {w[:PREFIX] + "-" for w in distinct if len(w) > PREFIX}


def figures(text: str, words: list[str]) -> list[float]:
    """Shares of kinds of characters and of repetition."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size, n = max(1, len(text)), max(1, len(words))
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    signs = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    plain = int(raw[39] + raw[44] + raw[45] + raw[46])
    lines = text.split("\n")
    times = Counter(words)
    most = max(times.values(), default=0)
    return [
        math.log1p(len(words)),
        (signs - plain) / size,
        plain / size,
        int(raw[65:91].sum()) / letters,
        int(raw[33]) / size,
        int(raw[124]) / size,
        int(raw[48:58].sum()) / size,
        sum(map(eq, words, words[1:])) / n,
        math.log1p(len(times)) / math.log1p(n),
        most / n,
        sum(map(len, words)) / n / 10,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(lines)),
    ]


@dataclass
class Part:
    """Weights of one label, fitted on texts with the log-odds of others."""

    label: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(_expanded((rows - self.mean) / self.scale) @ self.weights, -12, 12)


@dataclass
class Model:
    """Log-odds of features (one column for each part), the parts, and what is known of each label without any text."""

    number: dict[str, int]
    odds: np.ndarray
    parts: list[Part]
    base: list[float]

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Log-odds of each label (texts x labels): the mean over its parts."""
        rows = np.array([_row(self.number, self.odds, t) for t in texts]) if self.parts else None
        out = np.tile(np.array(self.base), (len(texts), 1))
        for label in range(len(self.base)):
            if own := [p.log_odds(rows[:, i]) for i, p in enumerate(self.parts) if p.label == label]:
                out[:, label] = np.mean(own, axis=0)
        return out


def _expanded(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -8, 8)
    return np.c_[x, x**2, np.ones(len(x))]


def _row(number: dict[str, int], odds: np.ndarray, text: str) -> np.ndarray:
    """For each part: the text's figures, and sums and extremes of the log-odds of its features."""
    words, features = pieces(text)
    found = odds[sorted(number[f] for f in features if f in number)]  # in order, so that sums come out alike everywhere
    up, down = np.maximum(found, 0), np.maximum(-found, 0)
    own = np.tile(np.array(figures(text, words)), (odds.shape[1], 1))
    return np.c_[own, np.log1p(up.sum(axis=0)), np.log1p(down.sum(axis=0)), up.max(axis=0, initial=0), down.max(axis=0, initial=0), found.sum(axis=0) / (5 + len(features))]


def _taken(rows: DataFrame, places: dict, wanted: list[tuple[int, int]]) -> list[dict[str, float]]:
    """For each (label, half): the log-odds of the features that say most; counts are of texts. rows: doc_id and whole texts."""
    sent = rows.sparkSession.sparkContext.broadcast((places, wanted))
    names = [f"{v}{k}" for k in range(len(wanted)) for v in ("no", "yes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, wanted = sent.value
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            counts: dict[str, list[int]] = {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if doc_id not in places:
                    continue
                i, y = places[doc_id]
                at = [2 * k + y[label] for k, (label, h) in enumerate(wanted) if i % 2 == h and y[label] >= 0]
                for f in pieces(text)[1]:
                    row = counts.setdefault(f, [0] * len(names))
                    for k in at:
                        row[k] += 1
            values = np.array(list(counts.values()), np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], ["feature", *names])

    fields = [T.StructField("feature", T.StringType()), *(T.StructField(n, T.LongType()) for n in names)]
    counted = rows.select("doc_id", "text").mapInArrow(run, T.StructType(fields)).groupBy("feature").agg(*(F.sum(n).alias(n) for n in names))
    counted = materialize(counted, "quality-counts")
    out = []
    for k, (label, h) in enumerate(wanted):
        y = [own[label] for i, own in places.values() if i % 2 == h]
        n_no, n_yes = y.count(0), y.count(1)
        no, yes = F.col(f"no{k}"), F.col(f"yes{k}")
        value = F.log((yes + 0.5) / (n_yes + 1)) - F.log((no + 0.5) / (n_no + 1))
        found = counted.select("feature", no.alias("no"), yes.alias("yes"), value.alias("value")).filter((F.col("no") + F.col("yes") >= LEAST) & (F.abs("value") > 1.0))
        top = found.orderBy(F.desc(F.abs("value") * F.sqrt(F.col("no") + F.col("yes"))), "feature").limit(WORDS).collect()
        out.append({r["feature"]: math.log((r["yes"] + 0.5) / (n_yes + 1)) - math.log((r["no"] + 0.5) / (n_no + 1)) for r in top})
    return out


def _rows(rows: DataFrame, places: dict, number: dict[str, int], odds: np.ndarray) -> np.ndarray:
    """The rows of the sample's whole texts (texts x parts x figures), in the order of their places."""
    sent = rows.sparkSession.sparkContext.broadcast((places, number, odds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, number, odds = sent.value
        for batch in byte_slices(batches, "text", SLICE_BYTES):
            own = [(places[d][0], t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if d in places]
            values = [_row(number, odds, t).ravel().tolist() for _, t in own]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array(values, pa.list_(pa.float64()))], ["i", "row"])

    found = rows.select("doc_id", "text").mapInArrow(run, "i long, row array<double>").collect()
    return np.array([r["row"] for r in sorted(found, key=lambda r: r["i"])]).reshape(len(found), odds.shape[1], -1)


def fit(rows: DataFrame, places: dict) -> Model:
    """A model of 0/1 labels. rows: doc_id and whole texts; places: doc_id to its place and labels (-1 for unknown). A label
    without both values only has its share.

    Each half of the texts gives the log-odds for weights that are fitted on the other half, so no text is judged by words it
    has itself brought in; both of these parts count.
    """
    labels = np.array([y for _, y in sorted(places.values())], np.int64).reshape(-1, 2)
    half, wanted, base = np.arange(len(labels)) % 2, [], []
    for y in labels.T:
        yes, no = int((y == 1).sum()), int((y == 0).sum())
        base.append(math.log((yes + 1) / (no + 1)))
        if min(((y == v) & (half == h)).sum() for v in (0, 1) for h in (0, 1)) >= 2:
            wanted += [(len(base) - 1, 0), (len(base) - 1, 1)]
    columns = _taken(rows, places, wanted) if wanted else []
    number = {f: i for i, f in enumerate(sorted(set().union(*columns)))}
    odds = np.zeros((len(number), len(columns)))
    for k, column in enumerate(columns):
        for f, value in column.items():
            odds[number[f], k] = value
    found = _rows(rows, places, number, odds) if wanted else None
    parts = []
    for k, (label, h) in enumerate(wanted):
        rest = (half != h) & (labels[:, label] >= 0)
        x, y = found[rest, k], labels[rest, label].astype(float)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        parts.append(Part(label, mean, scale, _weights(_expanded((x - mean) / scale), y)))
    return Model(number, odds, parts, base)


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of good (quality 1) and toxic (1), from at most `sample` labelled documents."""
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    rows = materialize(rows, "quality-sample")
    got = sorted(rows.select("doc_id", "quality", "toxic", F.sha2("text", 256).alias("digest")).collect(), key=lambda r: r["doc_id"])
    got = list({r["digest"]: r for r in got}.values())  # copies would count their words again and again
    return fit(rows, {r["doc_id"]: (i, tuple(-1 if r[c] is None else int(r[c] > 0) for c in ("quality", "toxic"))) for i, r in enumerate(got)})


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds good_evidence and toxic_evidence: log-odds from the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["good_evidence", "toxic_evidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in byte_slices(batches, text, SLICE_BYTES):
            found = model.evidence([t or "" for t in batch.column(text).to_pylist()])
            values = [pa.array(np.ascontiguousarray(c)) for c in found.T]
            keep = [n for n in batch.schema.names if n not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *values], [*keep, *names])

    fields = [f for f in docs.schema.fields if f.name not in names] + [T.StructField(n, T.DoubleType()) for n in names]
    return docs.mapInArrow(run, T.StructType(fields))


def _strength(groups: DataFrame, n: str, rate: str, parent: str) -> float:
    """The beta prior's strength: how many documents the parent's rate is worth. Large when groups differ by chance only."""
    r = groups.agg(
        F.sum(F.col(n)).alias("n"),
        F.sum(F.col(n) * (F.col(rate) - F.col(parent)) ** 2).alias("spread"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("chance"),
        F.sum(F.col(n) * F.col(parent) * (1 - F.col(parent))).alias("whole"),
    ).first()
    if not r["n"]:
        return 1.0
    between = max((r["spread"] - r["chance"]) / r["n"], 1e-9)
    return max(1.0, r["whole"] / r["n"] / between - 1)


def sites(scored: DataFrame, labels: DataFrame, host: str, path: str) -> DataFrame:
    """(_host, _path, good_prior, toxic_prior): log-odds shifts of each path of each host, from all documents. scored: narrow."""
    named = scored.select("doc_id", F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(path, F.lit("")).alias("_path"), "good_evidence", "toxic_evidence")
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"), F.max("toxic").alias("_t"))
    logistic = lambda c: 1 / (1 + F.exp(-F.col(c)))
    each = named.join(known, "doc_id", "left")
    each = each.withColumns({"good": F.coalesce(F.col("_q").cast("double"), logistic("good_evidence")), "toxic": F.coalesce(F.col("_t").cast("double"), logistic("toxic_evidence"))})
    paths = materialize(each.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "quality-paths")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).first()
    out = paths
    for name in ("good", "toxic"):
        rate = F.lit((whole[name] + 0.5) / (whole["n"] + 1.0) if whole["n"] else 0.5)
        hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum(name).alias("hs")).withColumns({"whole": rate, "hr": F.col("hs") / F.col("hn")})
        k = _strength(hosts, "hn", "hr", "whole")
        hosts = hosts.select("_host", ((F.col("hs") + k * rate) / (F.col("hn") + k)).alias("hp"))
        own = out.join(hosts, "_host").withColumn("pr", F.col(name) / F.col("n"))
        k = _strength(own, "n", "pr", "hp")
        odds = lambda p: F.log(p) - F.log(1 - p)
        post = (F.col(name) + k * F.col("hp")) / (F.col("n") + k)
        post = F.greatest(F.least(post, F.lit(1 - 1e-6)), F.lit(1e-6))
        out = own.withColumn(f"{name}_prior", odds(post) - odds(rate)).drop("hp", "pr")
    return out.select("_host", "_path", "good_prior", "toxic_prior")


def decide(scored: DataFrame, found: DataFrame, host: str, path: str) -> DataFrame:
    """Adds good and toxic (posterior probabilities) and kept."""
    found = materialize(found, "quality-sites")
    if found.count() <= SENT_SITES:
        found = F.broadcast(found)
    own = dict(zip(found.columns, fresh(scored.columns, *found.columns), strict=True))
    found = found.withColumnsRenamed(own)
    match = (F.coalesce(scored[host], F.lit("")) == F.col(own["_host"])) & (F.coalesce(scored[path], F.lit("")) == F.col(own["_path"]))

    def posterior(name: str) -> Column:
        return 1 / (1 + F.exp(-(F.col(f"{name}_evidence") + F.coalesce(own[f"{name}_prior"], F.lit(0.0)))))

    joined = scored.join(found, match, "left").withColumns({"good": posterior("good"), "toxic": posterior("toxic")})
    joined = joined.withColumn("kept", (F.col("good") >= GOOD - 1e-9) & (F.col("toxic") <= TOXIC + 1e-9))
    return joined.drop(*own.values())


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", text: bool = False) -> DataFrame:
    """Each document with its evidence, posteriors and kept. text: whether the documents' own columns come along."""
    model = train(docs, labels)
    if text:  # the texts are written with their evidence, so that they are scored once
        scored = materialize(score(docs, model), "quality-scored")
    else:
        scored = materialize(score(docs.select("doc_id", host, path, text_of().alias("text")), model).drop("text"), "quality-scores")
    return decide(scored, sites(scored, labels, host, path), host, path)
