"""Substring dedup on words: an FM-index per shard.

Candidates meet by minimizer (see ``windows``), so that a task's shard holds
all stretches that may share a window. The shard's words are numbered and
indexed: suffix array, Burrows-Wheeler transform, and the transform as a
wavelet matrix of packed bit vectors with block counts. Stretches that occur
twice as a whole are settled by their counts before (see ``windows``), so a
shard holds each stretch once; the index can also count copies, which the
operator doesn't ask of it. The stretches are then streamed through backward
search, many positions at once: the matching statistic of a position is the
longest stretch ending there that occurs at least twice; where it reaches
``length`` words, the window repeats. All that a statistic spans repeats with
it, and a statistic grows by one at most from a position to the next, so that a
short one rules out the next positions.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

Defined results: a null text has no words; windows never cross texts; repeated
rows match each other; texts of fewer words than ``length`` stay whole (their
words joined by one space); a text is taken whole by one task, at some 80 bytes
of memory a word; an empty table gives an empty result. Columns named n_words
and removed are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.suffixes import BYTE_VALUES
from orrery.llm.windows import Alphabet, Hasher, covered, mix, repeated_windows, shielded, with_marks

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, in bytes."""
    inside = ~SPACES[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return edges[::2], edges[1::2]


def word_symbols(raw: bytes) -> np.ndarray:
    starts, ends = word_bounds(raw)
    hashed = Hasher(BYTE_VALUES[np.frombuffer(raw, np.uint8)])
    return mix(hashed(starts, ends) + (ends - starts).astype(np.uint64))


def word_stretch(raw: bytes, lo: np.ndarray, n: np.ndarray) -> list[bytes]:
    starts, ends = word_bounds(raw)
    return [raw[a:b] for a, b in zip(starts[lo].tolist(), ends[lo + n - 1].tolist())]


WORDS = Alphabet(word_symbols, word_stretch)


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``ids`` must end in a value of its own."""
    rank, span = ids.astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-span] = rank[span:] + 1
        order = np.argsort(rank * (len(rank) + 2) + after)
        key = rank[order] * (len(rank) + 2) + after[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[0, np.diff(key) > 0])
        if rank[order[-1]] == len(rank) - 1:
            return order
        span *= 2


class BitVector:
    """Packed bits with counts before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.r_[packed, np.zeros(16 - len(packed) % 8, np.uint8)].view(np.uint64)
        self.before = np.r_[0, np.bitwise_count(self.words).cumsum()[:-1]].astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before the places ``at``."""
        w = at >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    """FM-index of a sequence of numbers below ``sigma``, as a wavelet matrix; ``copies`` says how often each place counts."""

    def __init__(self, ids: np.ndarray, sigma: int, copies: np.ndarray | None = None):
        order = suffix_order(ids)
        column = ids[order - 1]
        self.first = np.r_[0, np.bincount(ids, minlength=sigma).cumsum()]
        self.copies = np.r_[0, np.cumsum(np.ones(len(ids), np.int64) if copies is None else copies[order])]
        self.levels = []
        symbols, base = np.arange(sigma), np.zeros(sigma, np.int64)  # where each number's run begins at the last level
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (column >> bit & 1).astype(bool)
            vector, zeros = BitVector(ones), int(len(ones) - ones.sum())
            self.levels.append((bit, vector, zeros))
            before = vector.rank(base)
            base = np.where(symbols >> bit & 1, zeros + before, base - before)
            column = np.r_[column[~ones], column[ones]]
        self.shift = self.first[:-1] - base
        self.n = len(ids)

    def step(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of ``id`` + pattern, from those of the patterns."""
        shift = self.shift[ids]
        for bit, vector, zeros in self.levels:
            one = (ids >> bit & 1).astype(bool)
            a, b = vector.rank(lo), vector.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return shift + lo, shift + hi

    def matching(self, text: np.ndarray, ends: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """For each end, how many symbols before it occur together at least twice, up to its ``longest``."""
        size = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(longest > 0)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        k = 0
        while len(live):
            k += 1
            lo, hi = self.step(text[ends[live] - k], lo, hi)
            good = self.copies[hi] - self.copies[lo] > 1
            size[live[good]] = k
            good &= longest[live] > k
            live, lo, hi = live[good], lo[good], hi[good]
        return size


def resolve_words(contents: list[np.ndarray], length: int, copies: list[int] | None = None, stride: int = 12) -> list[np.ndarray]:
    """For each stretch of words, which of its windows occur twice among them, ``copies`` of each counted."""
    marks = np.arange(len(contents))  # a number of its own ends each stretch
    words = np.unique(np.concatenate(contents), return_inverse=True)[1] + len(contents)
    sizes = np.array([len(c) for c in contents])
    stops = np.cumsum(sizes)
    text = np.insert(words, stops, marks)
    index = FMIndex(text, int(text.max()) + 1, np.repeat(np.array(copies or [1] * len(contents)), sizes + 1))
    starts = stops - sizes + np.arange(len(contents))
    counts = sizes - length + 1
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)  # of a window in its stretch
    ends = place + np.repeat(starts, counts) + length
    last = np.arange(len(place)) - place + np.repeat(counts, counts)  # where the stretch's windows end
    repeats, open_ = np.zeros(len(ends), bool), np.ones(len(ends), bool)
    blocks = np.flatnonzero((last - 1 - np.arange(len(ends))) % length == 0)  # the last window of a stretch, and every length-th before
    whole = index.matching(text, ends[blocks], np.minimum(place[blocks] + length, 2 * length - 1))
    settled = blocks[whole >= length]
    step = np.zeros(len(ends) + 1, np.int64)
    np.add.at(step, settled - (whole[whole >= length] - length), 1)
    np.add.at(step, settled + 1, -1)
    repeats[step[:-1].cumsum() > 0] = True
    open_ &= ~repeats
    probes = np.flatnonzero(open_ & (place % stride == 0))
    size = index.matching(text, ends[probes], np.full(len(probes), length))
    repeats[probes] = size == length
    ruled = np.zeros(len(ends) + 1, np.int64)
    np.add.at(ruled, probes, 1)
    np.add.at(ruled, np.minimum(probes + np.maximum(1, length - size), last[probes]), -1)
    rest = np.flatnonzero(open_ & (ruled[:-1].cumsum() == 0))
    repeats[rest] = index.matching(text, ends[rest], np.full(len(rest), length)) == length
    return np.split(repeats, np.cumsum(counts)[:-1])


def dedup_substrings(docs: DataFrame, length: int = 35, *, text_col: str = "text", gram: int = 6) -> DataFrame:
    """Remove every word covered by a ``length``-word window that also starts elsewhere.

    The columns of ``docs``, with kept words joined by one space as the text,
    and n_words and removed (spans as (start, end) of words).
    """
    docs, back = shielded(docs.drop("n_words", "removed"))

    def resolve(contents: list[np.ndarray], copies: list[int]) -> list[np.ndarray]:
        return resolve_words(contents, length, copies)

    texts, marks = repeated_windows(docs, WORDS, length, gram, resolve, "substrings", text_col=text_col)
    names, at = docs.columns, docs.columns.index(text_col)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, kept, removed = [], [], []
                for text, found in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                    words = (text or "").encode().split()
                    sizes.append(len(words))
                    edges = np.zeros((0, 2), int)
                    if found:
                        gone = covered(len(words), length, found)
                        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    kept.append(b" ".join(words).decode())
                    removed.append([{"start": a, "end": b} for a, b in edges.tolist()])
                cols = list(part.columns[: len(names)])
                cols[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(removed, spans)], [*names, "n_words", "removed"])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "n_words long, removed array<struct<start:bigint,end:bigint>>"])
    return with_marks(texts, marks).select(*names, "found").mapInArrow(finish, schema).withColumnsRenamed(back)
