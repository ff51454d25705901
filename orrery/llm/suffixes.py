"""Suffix-array dedup: bytes covered by strings that occur elsewhere.

Method: longest-previous-factor arrays. Candidates meet by minimizer (see
``windows``); a task sorts the suffixes of the stretches that it got, by prefix
doubling from packed symbols. In suffix order, the previous and next smaller
positions of a suffix are its best earlier matches: the longer of the two common
prefixes is its longest previous factor. The previous and next larger positions
give its best later match likewise. Common prefixes are read off the ranks of
the doubling. Stretches that occur twice as a whole are settled by their counts
before (see ``windows``), so a task holds each stretch once; stretches can also
be given with a number of copies, which the operator doesn't do.

A window goes whose longest previous (or next) factor reaches ``length``. So
every copy is removed, the first included: whether a byte goes depends on the
strings that there are, not on the order of the rows.

Defined results: a null text has no bytes; matches never cross texts; repeated
rows match each other; texts shorter than ``length`` stay whole; a text is taken
whole by one task, at some 80 bytes of memory a byte (measured: 875 MB at 10
million); an empty table gives an empty result. Columns named n_bytes, kept and removed are replaced, all
others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.windows import Alphabet, covered, mix, repeated_windows, shielded, with_marks

BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def byte_symbols(raw: bytes) -> np.ndarray:
    return BYTE_VALUES[np.frombuffer(raw, np.uint8)]


def byte_stretch(raw: bytes, lo: np.ndarray, n: np.ndarray) -> list[bytes]:
    return [raw[a : a + b] for a, b in zip(lo.tolist(), n.tolist())]


BYTES = Alphabet(byte_symbols, byte_stretch)


def dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct ones."""
    order = np.argsort(keys)
    ascending = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.r_[False, ascending[1:] != ascending[:-1]])
    return rank


class SuffixArray:
    """Suffixes of stretches in their order, compared up to ``length`` symbols or more.

    ranks: by span, the rank of each position's next symbols (equal ones rank
    equally; positions are of the stretches one after another, each with an end
    of its own); order: positions in suffix order, those that agree by place.
    """

    def __init__(self, contents: list[np.ndarray], length: int):
        sizes = np.array([len(c) for c in contents])
        self.starts = np.r_[0, np.cumsum(sizes + 1)]
        symbols = dense(np.concatenate(contents))
        ids = np.insert(symbols, np.cumsum(sizes), symbols.max(initial=0) + 1 + np.arange(len(contents)))
        n, bits = len(ids), int(ids.max(initial=0) + 1).bit_length()
        span = 1
        key = ids + 1  # 0: past the end
        while 2 * span * bits <= 62:  # as many symbols as a number holds
            key = (key << span * bits) + np.r_[key[span:], np.zeros(min(span, n), np.int64)][:n]
            span *= 2
        rank = dense(key)
        self.symbols, self.ranks = ids, {span: rank}
        while span < length:
            after = np.r_[rank[span:] + 1, np.zeros(min(span, n), np.int64)][:n]
            rank = dense(rank * (n + 1) + after)
            span *= 2
            self.ranks[span] = rank
        self.order = np.argsort(rank * n + np.arange(n))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, of twice the largest span less one at most; 0 where either is -1."""
        size = np.zeros(len(a), np.int64)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[live], b[live]
        spans = sorted(self.ranks, reverse=True)
        for span in [*spans, *[1] * (spans[-1] - 1)]:
            rank = self.ranks.get(span, self.symbols)  # an end of its own stops every match, so a and b stay inside
            step = np.where(rank[a] == rank[b], span, 0)
            size[live] += step
            a, b = a + step, b + step
            if span == spans[-1]:  # suffixes that differ at once are most
                open_ = np.flatnonzero(self.symbols[a] == self.symbols[b])
                live, a, b = live[open_], a[open_], b[open_]
        return size

    def neighbours(self, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
        """By position: the previous and the next in suffix order that stand before it (smaller) or after it; -1 if none."""
        found = []
        for place in (self.order, self.order[::-1]):
            value = place if smaller else -place
            near = np.arange(len(value)) - 1
            open_ = np.flatnonzero(near >= 0)
            open_ = open_[value[near[open_]] > value[open_]]
            while len(open_):  # what lies between is larger, so its own neighbour can be taken over
                near[open_] = near[near[open_]]
                open_ = open_[near[open_] >= 0]
                open_ = open_[value[near[open_]] > value[open_]]
            out = np.empty(len(value), np.int64)
            out[place] = np.where(near >= 0, place[near], -1)
            found.append(out)
        return found[0], found[1]

    def factors(self, earlier: bool, at: np.ndarray) -> np.ndarray:
        """Longest previous (or next) factor of the suffixes ``at``."""
        a, b = self.neighbours(earlier)
        return np.maximum(self.common(at, a[at]), self.common(at, b[at]))


def resolve_suffixes(contents: list[np.ndarray], length: int, copies: list[int] | None = None) -> list[np.ndarray]:
    """For each stretch, which of its windows occur elsewhere among them, ``copies`` of each counted."""
    if copies and min(copies) > 1:
        return [np.ones(len(c) - length + 1, bool) for c in contents]
    array = SuffixArray(contents, length)
    counts = np.array([len(c) - length + 1 for c in contents])
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place + np.repeat(array.starts[:-1], counts)
    longest = np.repeat([len(c) for c in contents], counts) - place  # between copies: the rest of the stretch
    once = np.repeat(np.array(copies or [1] * len(contents)), counts) == 1
    longest[once] = np.maximum(array.factors(True, at[once]), array.factors(False, at[once]))
    return np.split(longest >= length, np.cumsum(counts)[:-1])


def dedup_suffixes(docs: DataFrame, length: int = 200, *, text_col: str = "text", gram: int = 32) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere.

    The columns of ``docs`` but the text, and n_bytes, kept (the bytes that
    stay), removed (spans as (start, end) of bytes).
    """
    docs, back = shielded(docs.drop("n_bytes", "kept", "removed"))

    def resolve(contents: list[np.ndarray], copies: list[int]) -> list[np.ndarray]:
        return resolve_suffixes(contents, length, copies)

    texts, marks = repeated_windows(docs, BYTES, length, gram, resolve, "suffixes", text_col=text_col)
    names = [c for c in docs.columns if c != text_col]
    kinds = dict(docs.dtypes)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, kept, removed = [], [], []
                for text, found in zip(part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist()):
                    raw = (text or "").encode()
                    sizes.append(len(raw))
                    if not found:
                        kept.append(raw)
                        removed.append([])
                        continue
                    gone = covered(len(raw), length, found)
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    removed.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, spans)], [*names, "n_bytes", "kept", "removed"])

    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "n_bytes long, kept binary, removed array<struct<start:bigint,end:bigint>>"])
    return with_marks(texts, marks).select(*names, text_col, "found").mapInArrow(finish, schema).withColumnsRenamed(back)
