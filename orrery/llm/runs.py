"""Periodic runs of words: stretches that repeat with a period, each found whole.

A run of a text is a stretch of words with smallest period q (words q apart are
equal) of at least ``max(min_length, exponent * q)`` words, which no neighbouring
word extends keeping that period.

Method: block matching. A block of s words at a multiple of s is aligned; s is a
power of two. A run of period q holds an aligned block whose copy q words on is
in the run as well, if ``2 * s - 1 <= (exponent - 1) * q``; the largest such s
is the scale of q. So at each scale the aligned blocks become the keys of an
Aho-Corasick automaton over integer sequences, which is searched across the
document; a block that occurs at a distance of the block's own scale is a seed,
and a seed is extended in both directions, word by word, to all it can reach.

* Where a word doesn't come again within the longest distance of a scale, no run
  of that scale passes. Only the stretches between such words are searched.
* A stretch inside a known run of a smaller scale holds no run of its own: both
  periods would hold in an overlap of their sum.
* Keys have ``KEY`` words at most (a longer block's first ones) and automata
  ``NODES`` nodes or so, whatever the length of a text: long stretches are
  searched part by part, each part as far beyond its blocks as the scale goes.

Defined results: a null or empty text has no words and no runs, and collapses to
an empty text; texts of any length a column holds are taken whole; repeated rows
are searched each on its own; runs are ordered by start, then period; an empty
table gives an empty result; columns of the output's names are replaced, others
are kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orrery.llm.pieces import slices

#: Bytes of text that are searched at a time (a longer text alone).
BLOCK_BYTES = 8 << 20
KEY, NODES = 4096, 1 << 18
_FAR = np.int64(1 << 40)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts (parted by ASCII white space) in a row, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    none = pc.binary_length(trimmed).to_numpy(zero_copy_only=False) == 0
    if none.any():  # an empty text splits into one empty word
        flat = flat.filter(pa.array(~np.repeat(none, counts)))
        counts[none] = 0
    return flat, counts


def next_same(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How far on each word comes again in its own text."""
    far = np.full(len(ids), _FAR)
    order = np.argsort(ids, kind="stable")
    text = np.repeat(np.arange(len(counts)), counts)
    a, b = order[:-1], order[1:]
    same = (ids[a] == ids[b]) & (text[a] == text[b])
    far[a[same]] = (b - a)[same]
    return far


def reach(ids: np.ndarray, at: int, d: int, lo: int, hi: int) -> tuple[int, int]:
    """The stretch of places in lo .. hi around ``at`` that equal the word d places on."""
    left, right, step = at, at + 1, 64
    while left > lo:
        start = max(lo, left - step)
        odd = np.flatnonzero(ids[start:left] != ids[start + d : left + d])
        if len(odd):
            left = start + int(odd[-1]) + 1
            break
        left, step = start, 2 * step
    step = 64
    while right < hi:
        end = min(hi, right + step)
        odd = np.flatnonzero(ids[right:end] != ids[right + d : end + d])
        if len(odd):
            right += int(odd[0])
            break
        right, step = end, 2 * step
    return left, right


def primitive(word: np.ndarray, q: int) -> bool:
    """Whether q is the smallest period of a stretch of period q (twice as long at least)."""
    rest, p = q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            g = q // p
            if np.array_equal(word[:q], word[g : g + q]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def seeds(ids: np.ndarray, lo: int, hi: int, end: int, origin: int, s: int, least: int, most: int) -> Iterator[tuple[int, int]]:
    """(place, distance) of the aligned blocks of s words in lo .. hi that occur least .. most words on, before ``end``."""
    import ahocorasick

    size = min(s, KEY)
    per = max(1, NODES // size)
    first = lo + (origin - lo) % s
    for start in range(first, hi - s + 1, per * s):
        places = range(start, min(start + per * s, hi - s + 1), s)
        found: dict[tuple, list[int]] = {}
        for p in places:
            found.setdefault(tuple(ids[p : p + size].tolist()), []).append(p)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in found.items():
            automaton.add_word(key, own)
        automaton.make_automaton()
        base = start + least
        for last, own in automaton.iter(tuple(ids[base : min(end, places[-1] + most + size)].tolist())):
            at = base + last - size + 1
            for p in own[bisect_left(own, at - most) : bisect_right(own, at - least)]:
                yield p, at - p


def find_runs(ids: np.ndarray, counts: np.ndarray, min_length: int = 6, exponent: int = 4) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by text, for the texts that have any.

    ``ids`` are the words of the texts in a row, as numbers. ``exponent`` is 2
    at least.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period once at least: exponent >= 2")
    found: dict[int, list[tuple[int, int, int]]] = {}
    if not len(ids):
        return found
    edges = np.r_[0, np.cumsum(counts)]
    again = next_same(ids, counts)
    # of the known run that reaches farthest over a place, end and period
    over, period = np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64)
    breaks = np.arange(len(ids))
    s = 1
    while 4 * s <= exponent:
        s *= 2
    while True:
        least, most = -(-(2 * s - 1) // (exponent - 1)), -(-(4 * s - 1) // (exponent - 1)) - 1
        least = max(least, 1)
        if least * exponent > counts.max():
            break
        need = min(max(min_length, exponent * q) - q for q in {least, most, min(most, max(least, min_length // exponent))})
        breaks = breaks[again[breaks] > most]
        starts = np.r_[0, breaks[:-1] + 1]
        some = np.flatnonzero(breaks - starts >= need)
        texts = np.searchsorted(edges, starts[some], "right") - 1
        for lo, hi, text in zip(starts[some].tolist(), breaks[some].tolist(), texts.tolist()):
            if over[lo] >= hi and period[lo] < least:
                continue
            end, done = int(edges[text + 1]), {}
            for p, d in seeds(ids, lo, hi, end, int(edges[text]), s, least, most):
                if p < done.get(d, 0) or (over[p] >= p + s + d and d % period[p] == 0):
                    continue
                a, b = reach(ids, p, d, lo, min(hi, end - d))
                done[d] = b
                length = b - a + d
                if length >= max(min_length, exponent * d) and primitive(ids[a : a + 2 * d], d):
                    found.setdefault(text, []).append((a - int(edges[text]), length, d))
                    better = np.flatnonzero(over[a : a + length] < a + length) + a
                    over[better], period[better] = a + length, d
        s *= 2
    for runs in found.values():
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return step.cumsum()[:n] > 0


def periodic_runs(docs: DataFrame, *, min_length: int = 6, exponent: int = 4, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period) and collapsed.

    collapsed is the text without the words that a run contains after its first
    period, joined by one space.
    """
    made = ["n_words", "runs", "collapsed"]
    docs = docs.drop(*(c for c in made if c != text_col))
    names, at = docs.columns, docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, BLOCK_BYTES):
                words, counts = split_words(part.column(at))
                runs = find_runs(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), counts, min_length, exponent)
                edges, keep, left = np.r_[0, np.cumsum(counts)], np.ones(len(words), bool), counts.copy()
                for text, own in runs.items():
                    gone = repeats(int(counts[text]), own)
                    keep[edges[text] : edges[text + 1]] = ~gone
                    left[text] -= gone.sum()
                kept = words.filter(pa.array(keep)) if runs else words
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)].astype(np.int32)), kept)
                listed = [[dict(zip(("start", "length", "period"), r)) for r in runs.get(i, ())] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts), pa.array(listed, kind), pc.binary_join(lists, " ")], [*names, *made])

    fields = [*(f"`{n}` {t}" for n, t in docs.dtypes), "n_words long", "runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"]
    return docs.mapInArrow(run, ", ".join(fields))
