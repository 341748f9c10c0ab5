"""Language identification by cross-parsing entropy.

The labelled text of each language becomes a suffix automaton. A text is parsed greedily against each: a phrase is the
longest piece from the current place that occurs in the language's text. The language that needs the fewest phrases for
each character wins; ties go to the smaller name.

Text is normalised for learning and for parsing alike: lower case, letters kept, every other run of characters one space.
The automata are learned from a bounded sample of the labelled rows: of each language at most ROWS different texts, in the order
of a hash of them; of all passages of PASSAGE characters of these whole texts, in the order of a hash again, CHARS characters. That
is each language's own budget, however many there are; so the model grows with the number of languages (about 16 MB each) and with
nothing else. No language is left out. The texts judged are parsed whole:
tasks parse pieces of STEP characters beside each other, then each piece's last phrase goes on into the next piece until a phrase
begins where one began in that piece too. From there both parses are one, so the phrases are those of the one greedy parse.

Cases: a null text, or one without a letter, is `und` with score 0; with nothing to learn from, all are; repeated rows give
equal rows; other columns pass through unless they carry an output's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .shared import byte_slices, materialize, text_of

CHARS, ROWS, PASSAGE, STEP, SLICE_BYTES = 30_000, 400, 500, 512, 1 << 20
#: Letters of a language that have a column in its automaton's table; the ways of its rarer ones are a sorted list.
ALPHABET = 64

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


class Automaton:
    """The automaton of all pieces of a text of symbols 0 to size - 1, the commonest first; 0 is the start, -1 no way on.

    letters: where each symbol stands among the letters of all languages. Any number of symbols matches: the first ALPHABET ones
    by a table (states x ALPHABET + 1, the last column has no ways), the others by their sorted keys (state * size + symbol).
    """

    def __init__(self, text: np.ndarray):
        found, first, times = np.unique(text, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.letters, self.size = found[order], len(order)
        goes = suffix_automaton(rank[first].tolist())
        self.table = np.full((len(goes), ALPHABET + 1), -1, np.int32)
        self.start = np.full(self.size + 1, -1, np.int32)
        rare = []
        for s, to in enumerate(goes):
            for c, t in to.items():
                if c < ALPHABET:
                    self.table[s, c] = t
                else:
                    rare.append((s * self.size + c, t))
        for c, t in goes[0].items():
            self.start[c] = t
        rare.sort()
        self.keys, self.to = np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32)

    def symbols(self, letters: np.ndarray, known: int) -> np.ndarray:
        """Symbols of letters (of `known`, and one for all others); what this language lacks is `size`."""
        symbol = np.full(known + 1, self.size, np.int32)
        symbol[self.letters] = np.arange(self.size)
        return symbol[letters]

    def one(self, now: int, c: int) -> int:
        """step() for one state."""
        if c < ALPHABET:
            return int(self.table[now, c])
        if c < self.size and len(self.keys):
            place = int(np.searchsorted(self.keys, now * self.size + c))
            if place < len(self.keys) and self.keys[place] == now * self.size + c:
                return int(self.to[place])
        return -1

    def step(self, now: np.ndarray, c: np.ndarray) -> np.ndarray:
        to = self.table.ravel()[now.astype(np.int64) * (ALPHABET + 1) + np.minimum(c, ALPHABET)]
        if len(self.keys):
            at = np.flatnonzero((c >= ALPHABET) & (c < self.size))
            keys = now[at].astype(np.int64) * self.size + c[at]
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            to[at] = np.where(self.keys[place] == keys, self.to[place], -1)
        return to


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The ways on from each state."""
    goes: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return goes


class Model:
    """languages, the letters of all of them, and one automaton for each language."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        points = np.unique(np.concatenate([_points(t) for t in samples.values()] or [np.empty(0, np.int64)]))
        self.known = len(points)
        self.letter = np.full(int(points.max(initial=0)) + 2, self.known, np.int32)  # the last one stands for all later code points
        self.letter[points] = np.arange(self.known)
        self.automata = [Automaton(self.letter[_points(samples[x])]) for x in self.languages]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases (texts x languages) of the normalised texts."""
        points = [_points(t) for t in texts]
        length = np.fromiter(map(len, points), np.int64, len(points))
        flat = self.letter[np.minimum(np.concatenate(points), len(self.letter) - 1)] if len(points) else np.empty(0, np.int32)
        laid = Pieces(length)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for k, automaton in enumerate(self.automata):
            out[:, k] = laid.parsed(automaton, automaton.symbols(flat, self.known))
        return out


class Pieces:
    """Texts that lie one after another, in pieces of STEP symbols, the longest pieces first."""

    def __init__(self, length: np.ndarray):
        self.text_end = np.cumsum(length)
        self.text_begin = self.text_end - length
        parts = -(-length // STEP)
        self.first = np.cumsum(parts) - parts  # of each text
        self.owner = np.repeat(np.arange(len(length)), parts)
        self.begin = self.text_begin[self.owner] + STEP * (np.arange(len(self.owner)) - self.first[self.owner])
        self.end = np.minimum(self.begin + STEP, self.text_end[self.owner])
        self.order = np.argsort(self.begin - self.end, kind="stable")

    def parsed(self, automaton: Automaton, symbols: np.ndarray) -> np.ndarray:
        """The number of phrases of each text."""
        starts, state = self.alone(automaton, symbols)
        met, extra, pos = self.gone_on(automaton, symbols, starts, state)
        before = np.concatenate([[0], np.cumsum(starts)])
        out = before[self.text_end] - before[self.text_begin]
        for t in np.flatnonzero(self.text_end - self.text_begin > STEP).tolist():
            out[t] = self.walked(t, automaton, symbols, starts, before, state, met, extra, pos)
        return out

    def alone(self, automaton: Automaton, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases begin if each piece is parsed from its beginning, and the state at each piece's end."""
        starts, last = np.zeros(len(symbols), bool), np.zeros(len(self.owner), np.int32)
        begin, size = self.begin[self.order], (self.end - self.begin)[self.order]
        state = np.zeros(len(begin), np.int32)
        live = np.searchsorted(-size, -np.arange(STEP), side="left")  # pieces with more than i symbols
        for i in range(STEP):
            n = live[i]
            if not n:
                break
            at = begin[:n] + i
            starts[at], state[:n] = self.moved(automaton, state[:n], symbols[at])
        last[self.order] = state
        return starts, last

    @staticmethod
    def moved(automaton: Automaton, now: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a phrase begins with the symbol, and the state after it."""
        to = automaton.step(now, c)
        new = (to < 0) | (now == 0)
        stuck = np.flatnonzero(to < 0)
        to[stuck] = np.maximum(automaton.start[c[stuck]], 0)  # a letter that the language lacks is a phrase of its own
        return new, to

    def gone_on(self, automaton: Automaton, symbols: np.ndarray, starts: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece that is not its text's last, parsed on for STEP symbols at most: where it meets the parse of a later piece
        (-1: not yet, the text's end: never), the phrases that begin before that, and how far it has come. Changes state."""
        met, extra, pos = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64), self.end.copy()
        lanes = np.flatnonzero(self.end < self.text_end[self.owner])
        for _ in range(STEP):
            if not lanes.size:
                break
            at = pos[lanes]
            new, to = self.moved(automaton, state[lanes], symbols[at])
            same = new & starts[at]
            met[lanes[same]] = at[same]
            lanes, new, to = lanes[~same], new[~same], to[~same]
            extra[lanes] += new
            state[lanes] = to
            pos[lanes] += 1
            over = pos[lanes] == self.text_end[self.owner[lanes]]
            met[lanes[over]] = pos[lanes[over]]
            lanes = lanes[~over]
        return met, extra, pos

    def walked(self, t: int, automaton: Automaton, symbols: np.ndarray, starts: np.ndarray, before: np.ndarray, state: np.ndarray, met: np.ndarray, extra: np.ndarray, pos: np.ndarray) -> int:
        """The phrases of text t: from piece to piece where their parses meet."""
        at, end, found = int(self.text_begin[t]), int(self.text_end[t]), 0
        while at < end:
            p = int(self.first[t]) + (at - int(self.text_begin[t])) // STEP
            found += int(before[self.end[p]] - before[at])
            if self.end[p] == end:
                break
            found += int(extra[p])
            at = int(met[p])
            if at < 0:  # it did not meet the next piece's parse: symbol by symbol
                at, now = int(pos[p]), int(state[p])
                while at < end:
                    c = int(symbols[at])
                    to = automaton.one(now, c)
                    if to < 0 or now == 0:
                        if starts[at]:
                            break
                        found += 1
                    now = to if to >= 0 else max(int(automaton.start[c]), 0)
                    at += 1
        return found


def _points(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows. The rows are found by narrow columns; only those taken bring their texts."""
    known = docs.select(F.col(lang).alias("_lang"), F.col(text).cast("string").alias("_text")).filter("_lang is not null and _text is not null")
    known = known.withColumn("_h", F.xxhash64("_text"))
    different = known.groupBy("_lang", "_h").agg(F.max(F.char_length("_text")).alias("chars"))
    chosen = different.withColumn("_n", F.row_number().over(W.partitionBy("_lang").orderBy(F.xxhash64("_h"), "_h"))).filter(F.col("_n") <= ROWS)
    chosen = materialize(chosen.drop("_n"), "language-rows")  # at most ROWS of a language
    passages = chosen.select("_lang", "_h", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("chars") / PASSAGE), F.lit(1)).cast("int") - 1)).alias("i"))
    number = F.row_number().over(W.partitionBy("_lang").orderBy(F.xxhash64("_h", "i"), "_h", "i"))
    taken = materialize(passages.withColumn("_n", number).filter(F.col("_n") <= CHARS // PASSAGE), "language-passages")
    texts = known.join(F.broadcast(taken.select("_lang", "_h").distinct()), ["_lang", "_h"]).groupBy("_lang", "_h").agg(F.min("_text").alias("_text"))
    taken = texts.join(F.broadcast(taken), ["_lang", "_h"]).select("_lang", "_n", F.expr(f"substring(_text, 1 + i * {PASSAGE}, {PASSAGE})").alias("t"))
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in taken.select("_lang", "_n", "t").collect():  # CHARS characters of each language
        samples.setdefault(r["_lang"], []).append((r["_n"], normalised(r["t"])))
    return Model({k: " ".join(x for _, x in sorted(v) if x) for k, v in samples.items()})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score: how far the winner is ahead of the second, 0 to 1 (1 if there is no second)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in byte_slices(batches, text, SLICE_BYTES):
            clean = [normalised(t or "") for t in batch.column(text).to_pylist()]
            ok = [bool(_LETTER.search(t)) and bool(model.languages) for t in clean]
            pred, score = ["und"] * len(clean), np.zeros(len(clean))
            if picked := [i for i, x in enumerate(ok) if x]:
                rate = model.phrases([clean[i] for i in picked]) / np.fromiter((len(clean[i]) for i in picked), np.int64)[:, None]
                best = rate.argmin(axis=1)
                if rate.shape[1] > 1:
                    two = np.partition(rate, 1, axis=1)
                    score[picked] = np.clip(1 - two[:, 0] / two[:, 1], 0, 1)
                else:
                    score[picked] = 1.0
                for i, b in zip(picked, best.tolist(), strict=True):
                    pred[i] = model.languages[b]
            keep = [n for n in batch.schema.names if n not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(pred), pa.array(score)], [*keep, "lang_pred", "score"])

    docs = docs.withColumn(text, text_of(text)).drop("lang_pred", "score")
    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType(fields))
