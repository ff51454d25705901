"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Method: bulk-synchronous best-fit. Documents are taken in order of length,
longest first, and gaps in order of size. In each round every waiting document
of the next length looks up its successor in the gaps (the tightest gap that
holds it); where more documents than gaps meet, the documents' ranks decide who
gets one and the rest sweep on to the next gap size; gaps are then updated and
the next round begins. All documents of one length are interchangeable, so a
round moves whole rank ranges: the state of the rounds is a table of at most
``capacity`` lengths and the gap sizes, whatever the number of documents. Ranks
are assigned, and ranges turned back into rows, by distributed jobs.

Defined results: a null text packs as an empty one (only the end id); repeated
rows are packed each on its own; an empty table gives an empty result; ties of
length are ordered by input partition and place in it.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import staged

#: Texts beyond ASCII words and Latin-1 letters take the tokenizer's own path.
UNUSUAL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xbf\xd7\xf7]|[^\x00-\xff]|<\\|")
#: The vocabulary file's pre-tokenizer pattern, over the characters that UNUSUAL lets through.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")
#: Words remembered by a worker: some 100 bytes each.
MEMO_WORDS = 700_000
_workers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Ids of texts under a word-level BPE vocabulary, remembering ids by word.

    The vocabulary's words are tokenized independently, so a text's ids are
    those of its words in a row. New words go to the tokenizers library
    together; the id that ends a word tells them apart again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # a word that does not end once: ask word by word
                for w in part:
                    self.memo[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            raw, start = ids.astype("<u4").tobytes(), 0
            for w, cut in zip(part, (cuts * 4).tolist()):
                self.memo[w] = raw[start:cut]
                start = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        split: list[tuple[int, list[str]]] = []
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            if UNUSUAL.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes()
            elif text:
                words = WORD.findall(text.lower())
                fresh.update(w for w in set(words) if w not in self.memo)
                split.append((i, words))
        if fresh:
            self.learn(list(fresh))
        get = self.memo.__getitem__
        for i, words in split:
            out[i] = b"".join(map(get, words))
        return out


def _worker(path: str) -> WordTokenizer:
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def tokenized_pieces(docs: DataFrame, vocab: str, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Cut each document's ids (then ``end_id``) into pieces of at most ``capacity``.

    Columns: doc_id, piece, start, length, ids_crc32, shard and place (the rank
    among the pieces of this length that the shard's task made); with
    ``keep_ids`` also ids (array of int).
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, place long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tokens = TaskContext.get().partitionId(), _worker(vocab)
        seen = np.zeros(capacity + 1, np.int64)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), tokens.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += tail
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        n = len(own) // 4
                        row = (doc, piece, start, n, zlib.crc32(own), shard, int(seen[n]))
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if keep_ids else row)
                        seen[n] += 1
                cols = list(zip(*rows))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "place"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                if keep_ids:
                    names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(cut, schema + (", ids array<int>" if keep_ids else ""))


def best_fit_rounds(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best-fit over length classes.

    Returns moves (length, first rank, documents, first sequence, documents per
    sequence, offset of the first): documents ``first rank + i`` of the length
    go to sequence ``first sequence + i // per`` at ``offset + (i % per) *
    length``.
    """
    sizes: list[int] = []  # of the gaps there are, ascending
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: ranges (first sequence, sequences)
    moves: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def add(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)  # the successor: the tightest gap that holds it
            if k < len(sizes):
                size = sizes[k]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[k]
            else:
                per = capacity // length
                size, first, n = capacity, opened, -(-left // per)
                opened += n
            per = size // length
            full = min(n, left // per)
            if full:
                moves.append((length, rank, full * per, first, per, capacity - size))
                add(size - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:  # fewer documents than the last gap holds
                moves.append((length, rank, left, first + full, left, capacity - size))
                add(size - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            if full < n:
                add(size, first + full, n - full)
    return moves


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to staged pieces (see ``tokenized_pieces``)."""
    cells = pieces.groupBy("shard", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    cells = staged(cells.withColumn("before", F.coalesce(before, F.lit(0))), "pack-cells")
    # at most `capacity` rows, whatever the input
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("n")).collect()}
    moves = sorted(best_fit_rounds(counts, capacity))
    plan = np.array(moves, np.int64).reshape(-1, 6)
    starts = (plan[:, 0] << 44) + plan[:, 1]
    ranked = pieces.join(cells.drop("n"), ["shard", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "shard")
    names = ranked.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            move = plan[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            i = rank - move[:, 1]
            found = [pa.array(move[:, 3] + i // move[:, 4]), pa.array(move[:, 5] + i % move[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{n} {t}" for n, t in ranked.dtypes)
    return ranked.mapInArrow(placed, f"{fields}, sequence_id long, offset long").drop("rank")


def pack_documents(docs: DataFrame, vocab: str, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenize and pack documents; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    ids with ``keep_ids``.
    """
    pieces = staged(tokenized_pieces(docs, vocab, capacity, id_col=id_col, text_col=text_col, end_id=end_id, keep_ids=keep_ids), "pack-pieces")
    return pack_pieces(pieces, capacity)
