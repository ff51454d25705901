"""Windows of fixed length that occur more than once in a table of texts.

The shared frame of the substring operators. A text is a sequence of symbols
(bytes, or words); a window is ``length`` symbols in a row. How repeated
windows are found, exactly:

1. Every window has a minimizer, the least hash of its ``gram``-symbol grams.
   A run of windows with the same minimizer is a record. Equal windows have
   equal minimizers, so they meet under one minimizer wherever they stand.
2. Minimizers are counted over all texts. Those that occur twice are marked in
   a bitmap of fixed size; the second pass keeps the records that it hits, with
   their symbols. (As the bitmap fills up, more records are kept, no fewer.)
3. Records are counted by minimizer and content. All windows of a content that
   occurs twice repeat. Of the distinct contents of a minimizer, up to
   ``GROUP`` go to one task's ``resolve`` together, which says which of their
   windows occur twice; where there are more, their windows are counted by hash,
   first in blocks and then, where a block does not repeat, one by one, which no
   group can overload.
4. What was found is gathered by text.

Texts without a kept record take no part after step 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import staged

BITS = 1 << 25
GROUP = 64
#: Symbols hashed at a time; a longer text is hashed alone.
BLOCK = 1 << 20
#: Windows of a record; longer runs (of periodic texts) are cut.
RUN = 512
POSITION_BITS = 31  # a column's value has no more bytes
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Columns made on the way (see ``shielded``).
RESERVED = ("_row", "_hit", "_rec", "_gram", "_content", "_lo", "_windows", "_inner", "_held", "found")
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        _powers[:] = [np.r_[np.uint64(1), np.full(n - 1, b)].cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of any stretch of a symbol sequence, by prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * power[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[: len(self.sums)][start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    m, span = values, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(values) - width + 1], m[width - span :]) if span < width else m


@dataclass
class Records:
    text: np.ndarray  # number of the text in the block
    lo: np.ndarray  # its first window
    windows: np.ndarray
    gram: np.ndarray  # the minimizer
    content: np.ndarray
    inner: np.ndarray  # windows inside may equal one another


def find_records(symbols: np.ndarray, starts: np.ndarray, length: int, gram: int) -> Records:
    """Records of texts that stand one after another from ``starts`` (with the end)."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(starts)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return Records(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool))
    hashed = Hasher(symbols)
    n = len(symbols)
    grams = hashed(slice(0, n - gram + 1), slice(gram, n + 1))
    shift = np.uint64(POSITION_BITS)
    least = sliding_min((grams >> shift << shift) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    counts = sizes[long] - length + 1
    text = np.repeat(long, counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    place = (least[at] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    value = grams[place]
    new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    run = np.diff(np.r_[first, len(text)])
    if run.max() > RUN:
        pieces = -(-run // RUN)
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + offset * RUN
        run = np.diff(np.r_[first, len(text)])
    last = first + run - 1
    content = hashed(at[first], at[last] + length) ^ mix(run.astype(np.uint64))
    return Records(text[first], at[first] - starts[text[first]], run, value[first], content, place[first] != place[last])


@dataclass
class Alphabet:
    """How texts become symbols.

    symbols(raw) gives 64-bit symbol values of UTF-8 bytes; stretch(raw, lo,
    n) the bytes that hold symbols lo .. lo + n, n arrays at once.
    """

    symbols: Callable[[bytes], np.ndarray]
    stretch: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]


def _blocks(batches: Iterator[pa.RecordBatch], text: int, alphabet: Alphabet) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]]:
    """(rows, texts' bytes, symbols, starts) of some BLOCK symbols at a time."""
    for batch in batches:
        raws = [(t or "").encode() for t in batch.column(text).to_pylist()]
        lo, size, parts = 0, 0, []
        for i, raw in enumerate(raws):
            own = alphabet.symbols(raw)
            if parts and size + len(own) > BLOCK:
                yield batch.slice(lo, i - lo), raws[lo:i], np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
                lo, size, parts = i, 0, []
            parts.append(own)
            size += len(own)
        if parts:
            yield batch.slice(lo), raws[lo:], np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


def shielded(docs: DataFrame, names: tuple[str, ...] = RESERVED) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns of these names called otherwise, and what to call them back."""
    taken, back = {c.lower() for c in docs.columns} | {n.lower() for n in names}, {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            i = 0
            while f"_own{i}" in taken:
                i += 1
            taken.add(f"_own{i}")
            back[f"_own{i}"] = c
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def repeated_windows(docs: DataFrame, alphabet: Alphabet, length: int, gram: int, resolve: Callable[[list[np.ndarray], list[int]], list[np.ndarray]], label: str, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, marks): which windows occur more than once, anywhere in ``docs``.

    texts: the columns of ``docs`` and _row (unique) and _hit (it may have
    marks). marks: _row and found, an array of (lo, windows, offsets): repeated
    windows start at symbols lo + offset, or, where offsets is null, at each of
    the record's windows.
    """
    at = docs.columns.index(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, symbols, starts in _blocks(batches, 0, alphabet):
            r = find_records(symbols, starts, length, gram)
            if len(r.text):
                yield pa.RecordBatch.from_arrays([pa.array(r.gram.view(np.int64)), pa.array(1 + r.inner.astype(np.int64))], ["gram", "n"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(8)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(own % np.uint64(BITS)).astype(np.int32))], ["bit"])

    twice = docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")
    marked = np.zeros(BITS, bool)  # at most BITS rows come back
    marked[twice.mapInArrow(bits, "bit int").distinct().toArrow().column("bit").to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))
    own_fields = ["_row", "_hit", "_rec", "_gram", "_content", "_lo", "_windows", "_inner", "_held"]
    own_kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, row = sent.value, TaskContext.get().partitionId() << 36
        rec = row
        for part, raws, symbols, starts in _blocks(batches, at, alphabet):
            r = find_records(symbols, starts, length, gram)
            bit = (r.gram >> np.uint64(8)) % np.uint64(BITS)
            some = np.flatnonzero(packed[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & 1)
            held: list[bytes] = []
            cuts = np.searchsorted(r.text[some], np.arange(len(raws) + 1))
            for i, raw in enumerate(raws):
                mine = some[cuts[i] : cuts[i + 1]]
                if len(mine):
                    held += alphabet.stretch(raw, r.lo[mine], r.windows[mine] + length - 1)
            n, m = part.num_rows, len(some)
            if m:
                rows = [row + r.text[some], None, rec + np.arange(m), r.gram[some].view(np.int64), r.content[some].view(np.int64), r.lo[some], r.windows[some].astype(np.int32), r.inner[some], held]
                cols = [pa.nulls(m, c.type) for c in part.columns] + [pa.nulls(m, k) if v is None else pa.array(v, k) for v, k in zip(rows, own_kinds)]
                yield pa.RecordBatch.from_arrays(cols, [*names, *own_fields])
            own = [pa.array(row + np.arange(n)), pa.array(np.diff(cuts) > 0), *[pa.nulls(n, k) for k in own_kinds[2:]]]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], [*names, *own_fields])
            row += n
            rec += m

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", _row long, _hit boolean, _rec long, _gram long, _content long, _lo long, _windows int, _inner boolean, _held binary"
    kept = staged(docs.mapInArrow(keep, schema), label)
    texts = kept.filter(F.col("_hit").isNotNull()).select(*names, "_row", "_hit")
    records = kept.filter(F.col("_hit").isNull()).select("_row", "_rec", "_gram", "_content", "_lo", "_windows", "_inner", "_held")

    key = ["_gram", "_content"]
    # counted without their symbols, which one record of a content brings along where it has partners
    contents = staged(records.groupBy(*key).agg(F.count("*").alias("n"), F.max("_inner").alias("_inner"), F.min("_rec").alias("_rec")), f"{label}-contents")
    groups = staged(contents.groupBy("_gram").agg(F.count("*").alias("members")).filter("members > 1"), f"{label}-groups")
    every = contents.filter("n > 1").select(*key, F.lit(None).cast("array<int>").alias("offsets"))
    partners = contents.join(groups, "_gram", "left").withColumn("members", F.coalesce("members", F.lit(1))).filter("members > 1 or _inner")
    partners = staged(partners.join(records.select("_rec", "_held"), "_rec").select("n", *key, "members", "_held"), f"{label}-partners")
    small = partners.filter(F.col("members") <= GROUP).select("n", *key, "_held").repartition("_gram").sortWithinPartitions("_gram")

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of records, some at a time; a group never parts."""

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = resolve([alphabet.symbols(r[3]) for r in rows], [1] * len(rows))
            out = [(r[1], r[2], np.flatnonzero(f).astype(np.int32)) for r, f in zip(rows, found) if r[0] == 1 and f.any()]
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], [*key, "offsets"])

        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size > 1 << 18 and r[1] != waiting[-1][1]:
                    yield flush(waiting)
                    waiting, size = [], 0
                waiting.append(r)
                size += len(r[3])
        if waiting:
            yield flush(waiting)

    block = max(4, gram // 2)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of ``block`` windows, counted off from the minimizer, with their windows' hashes."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for g, c, held in zip(*(x.to_pylist() for x in part.columns)):
                    symbols = alphabet.symbols(held)
                    n, hashed = len(symbols) - length + 1, Hasher(symbols)
                    grams = hashed(slice(0, len(symbols) - gram + 1), slice(gram, len(symbols) + 1))
                    first = int(np.argmax(grams.view(np.int64) == g)) % block
                    edges = np.r_[0, np.arange(first or block, n, block), n] if n > (first or block) else np.array([0, n])
                    whole = hashed(edges[:-1], edges[1:] + length - 1) ^ mix(np.diff(edges).astype(np.uint64))
                    own = hashed(slice(0, n), slice(length, n + length)).view(np.int64)
                    rows += [(g, c, e, h, own[e:f]) for e, f, h in zip(edges[:-1].tolist(), edges[1:].tolist(), whole.view(np.int64).tolist())]
                cols = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], [*key, "start", "whole", "windows"])

    large = partners.filter(F.col("members") > GROUP).select(*key, "_held").mapInArrow(blocks, "_gram long, _content long, start int, whole long, windows array<bigint>")
    large = staged(large, f"{label}-blocks")
    place = F.struct("_content", "start")
    again = staged(large.groupBy("_gram", "whole").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1"), f"{label}-again")
    large = staged(large.join(again, ["_gram", "whole"], "left"), f"{label}-blocks")
    # blocks that repeat as a whole are settled; one of each still meets the windows of the others
    open_ = large.filter(F.col("times").isNull() | (F.col("first") == place)).select(*key, "times", "start", F.posexplode("windows").alias("i", "window"))
    again = staged(open_.groupBy("_gram", "window").count().filter("count > 1").select("_gram", "window"), f"{label}-again")
    single = open_.filter("times is null").join(again, ["_gram", "window"]).select(*key, F.array(F.col("start") + F.col("i")).alias("own"))
    settled = large.filter("times is not null").select(*key, F.sequence("start", F.col("start") + F.size("windows") - 1).alias("own"))
    counted = settled.unionByName(single).groupBy(*key).agg(F.flatten(F.collect_list("own")).alias("offsets"))
    partly = small.mapInArrow(resolved, "_gram long, _content long, offsets array<int>").unionByName(counted)
    once = contents.filter("n = 1").select(*key)
    found = staged(every.unionByName(partly.join(once, key, "left_semi")), f"{label}-found")
    spots = records.select("_row", *key, "_lo", "_windows").join(found, key)
    marks = spots.groupBy("_row").agg(F.collect_list(F.struct(F.col("_lo").alias("lo"), F.col("_windows").alias("windows"), "offsets")).alias("found"))
    return texts, marks


def with_marks(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts with found; only those with kept records meet the marks."""
    none = F.lit(None).cast("array<struct<lo:bigint,windows:int,offsets:array<int>>>").alias("found")
    return texts.filter("not _hit").select("*", none).unionByName(texts.filter("_hit").join(marks, "_row", "left").select(*texts.columns, "found"))


def covered(n: int, length: int, found: list[dict] | None) -> np.ndarray:
    """Which of n symbols are covered by the found windows."""
    step = np.zeros(n + 1, np.int32)
    for spot in found or []:
        if spot["offsets"] is None:
            step[spot["lo"]] += 1
            step[spot["lo"] + spot["windows"] - 1 + length] -= 1
            continue
        starts = spot["lo"] + np.asarray(spot["offsets"], np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + length, -1)
    return step.cumsum()[:n] > 0
