"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A slice of texts is one buffer of UTF-8 bytes. A table of 256 entries says which bytes belong to words and lower-cases A-Z;
bytes of 128 and more are parts of code points outside ASCII. The hash of a word is a polynomial over its bytes modulo
2 to the 64, read off a running sum, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed, and words whose shingles are made, at once; what is longer goes piece by piece to the same hashes.
PIECE, MANY_WORDS = 4 << 20, 1 << 20

with np.errstate(over="ignore"):
    _BASE = np.uint64(0x9E3779B97F4A7C15)
    _BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_LETTER = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)


def byte_table(is_word) -> np.ndarray:
    """What each byte counts as: 0 outside words, else itself, with A-Z as a-z. is_word: says so of a lower-cased byte."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([b if is_word(b) else 0 for b in lower], np.uint8)


#: Runs of anything but white space and control characters 9 to 13.
BETWEEN_SPACES = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: The same, case kept.
CASED_BETWEEN_SPACES = np.array([0 if b == 0x20 or 9 <= b <= 13 else b for b in range(256)], np.uint8)
#: Runs of digits, letters and code points beyond ASCII.
ALPHANUMERIC = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins and the last ends; nulls are empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _inside(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a word. The table keeps 0 for separators, so a NUL that is no separator is found apart."""
    inside = table[data] > 0
    return inside | (data == 0) if table[1] else inside  # where other control characters are letters


def hashed_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many words each text has."""
    data, offsets = buffer_of(texts)
    if data.size <= PIECE:
        return _hashed(data, offsets, table)
    parts, counts, begin = [], np.zeros(len(texts), np.int64), 0
    while begin < data.size:  # cut behind a separator
        end = step = min(begin + PIECE, data.size)
        if end < data.size:
            gaps = np.flatnonzero(~_inside(data[begin:end], table))
            while not gaps.size and step < data.size:  # a word longer than a piece
                gaps = np.flatnonzero(~_inside(data[step : step + PIECE], table)) + step - begin
                step += PIECE
            end = begin + int(gaps[0 if step > end else -1]) + 1 if gaps.size else data.size
        found, n = _hashed(data[begin:end], np.clip(offsets, begin, end) - begin, table)
        parts.append(found)
        counts += n
        begin = end
    return np.concatenate(parts), counts


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the texts between the offsets begins and ends."""
    if not data.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = _inside(data, table)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < data.size]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends_mask[lasts] = inside[lasts]
    return starts, np.flatnonzero(ends_mask) + 1


def _hashed(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not data.size:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts, ends = word_bounds(data, offsets, table)
    power, inverse = _powers_to(data.size + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(_LETTER[table[data]] * power[:-1], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    at = np.searchsorted(starts, offsets)
    return hashes, np.diff(at)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the runs of k words that begin at each of the first len - k + 1 words, text borders disregarded."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    power, inverse = _powers_to(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mixed(hashes + np.uint64(k)) * power, out=sums[1:])
        return mixed((sums[k:] - sums[:n]) * inverse[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n, held = len(values) - width + 1, 1
    if n < 1:
        return values[:0]
    while 2 * held <= width:
        values = np.minimum(values[:-held], values[held:])
        held *= 2
    return np.minimum(values[:n], values[width - held : width - held + n])


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of k words, sorted within each text, and their number. Fewer words are one shingle."""
    if len(hashes) > MANY_WORDS:
        ends = np.cumsum(counts)
        each = [_of_one(hashes[e - n : e], k) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.cumsum(counts)
    left = end[doc] - np.arange(len(hashes))  # words from here to the end of the text
    with np.errstate(over="ignore"):
        value = mixed(hashes + np.uint64(1))
        for j in range(1, k):
            following = np.zeros_like(hashes)
            following[: len(hashes) - j] = hashes[j:]
            value = np.where(left > j, mixed(value * _BASE + following), value)
    whole = (left >= k) | ((counts[doc] < k) & (left == counts[doc]))
    doc, value = doc[whole], value[whole]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(doc[new], minlength=len(counts))


def _of_one(hashes: np.ndarray, k: int) -> np.ndarray:
    """shingles() of one text, in less memory."""
    m = len(hashes) - k + 1
    if m <= 1:
        return shingles(hashes, np.array([len(hashes)]), k)[0]
    with np.errstate(over="ignore"):
        value = mixed(hashes[:m] + np.uint64(1))
        for j in range(1, k):
            value *= _BASE
            value += hashes[j : m + j]
            value = mixed(value)
    value.sort()
    new = np.ones(m, bool)
    np.not_equal(value[1:], value[:-1], out=new[1:])
    return value[new]
