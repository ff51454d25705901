"""SentencePiece encoding and decoding of texts.

Shared-prefix forward search: the distinct marked words (a word with the
spaces before it, which the model writes as marks) of a block of texts are sorted, which lays out their
trie; it is traversed depth-first, and the forward states of a common prefix
are computed once and kept on a stack. A state is a piece and the place where
it starts; the encoding is read off backwards at the end of a word.

* Unigram models: Viterbi. The state of a prefix holds its best score too.
* BPE models (the public one): the best-scoring path is not the encoding, as
  merges are made in the order of their scores. The state is the last piece of
  the prefix's own encoding. That is enough: a prefix of an encoding is the
  encoding of that prefix, and pieces in a row are an encoding if each two
  neighbours are the encoding of their own text. So the last piece is the one
  that fits the state of the prefix before it.

Blocks are split into words, and ids joined into rows, by Arrow's kernels, so
that Python only sees distinct words.

Defined results: a null text encodes as an empty one, to no ids; characters
without a piece become byte pieces; the mark character U+2581 in a text counts
as a space; texts of any length take linear memory, with or without spaces;
repeated rows are encoded each on its own; an empty table gives an empty
result; a column of the output's name is replaced, others are kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words (twice as many at most) and pairs that a worker remembers, some 200 and 100 bytes each.
MEMO_WORDS, MEMO_PAIRS = 150_000, 250_000
#: Bytes of text that are encoded at a time (a longer text alone).
BLOCK_BYTES = 4 << 20
#: What an unknown character costs under the least score of a unigram model.
UNKNOWN_COST = 10.0
_coders: dict[str, "PieceCoder"] = {}


class PieceCoder:
    """Encodes and decodes under a model with byte pieces.

    ``pieces`` are (text, score) by id; ``bytes_`` the ids of the byte pieces,
    ``control`` those of pieces that no text holds.
    """

    def __init__(self, pieces: list[tuple[str, float]], bytes_: dict[int, int], control: set[int], merged: bool):
        self.merged = merged
        self.text = [t.replace(MARK, " ") for t, _ in pieces]  # a space, not its mark: strings of one byte a character
        self.score = [s for _, s in pieces]
        self.bytes = bytes_
        hidden = control | set(bytes_.values())
        self.id = {t: i for i, t in enumerate(self.text) if i not in hidden}
        self.reach: dict[str, int] = {}  # by last three characters: the longest piece that ends so
        for piece in self.id:
            self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 1))
        # a line break that no piece holds parts words as well
        stop = "" if any("\n" in t for t in self.id) else "\n"
        self.unit = re.compile(f" *[^ {stop}]+| +|\n")
        self.unknown = min((self.score[i] for i in self.id.values()), default=0.0) - UNKNOWN_COST
        raw = {i: bytes([b]) for b, i in bytes_.items()}
        whole = [raw.get(i, b"" if i in control else t.encode()) for i, t in enumerate(self.text)]
        # a text's first piece goes without the space before it
        self.raw = pa.array([*whole, *(w[1:] if w.startswith(b" ") else w for w in whole)], pa.large_binary())
        self.coded = [i.to_bytes(4, "little") for i in range(len(pieces))]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def load(cls, path: str) -> "PieceCoder":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        bytes_ = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        control = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in ids], bytes_, control, model_type(model.serialized_model_proto()) == 2)

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """The encoding of a text of known characters, merge by merge, and the pair that was merged last."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        open_: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.id:
                    heapq.heappush(open_, (-self.score[self.id[both]], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        last = None
        while open_:
            _, i, both = heapq.heappop(open_)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            last = (self.id[parts[i]], self.id[parts[j]])
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.id[p] for p in parts if p], last

    def split(self, k: int) -> tuple[int, int] | None:
        """The pieces whose merge makes piece k; (k, k) for one character, None if its text isn't encoded as k."""
        if k not in self.parts:
            if len(self.text[k]) == 1:
                self.parts[k] = (k, k)
            else:
                found, last = self.merge(self.text[k])
                self.parts[k] = last if found == [k] else None
        return self.parts[k]

    def fits(self, a: int, b: int) -> bool:
        """Whether pieces a, b in a row are the encoding of their text.

        Merges are undone from the last one: at no time may the pieces at the
        border have been a better merge than the one made next to it.
        """
        if self.split(a) is None or self.split(b) is None:
            return False
        text, score = self.text, self.score
        limit, strict = float("-inf"), True  # the pair must be worse than this, or as bad and later
        while True:
            k = self.id.get(text[a] + text[b])
            if k is not None and (score[k] > limit or score[k] == limit and not strict):
                return False
            undo_a = len(text[a]) > 1 and (len(text[b]) == 1 or score[a] < score[b])  # of equal pieces, the right one was made last
            if undo_a:
                limit, strict = score[a], True  # on a tie the left merge came first
                a = self.split(a)[1]
            elif len(text[b]) > 1:
                limit, strict = score[b], False
                b = self.split(b)[0]
            else:
                return True
            if self.split(a) is None or self.split(b) is None:
                return self.merge(text[a] + text[b])[0] == [a, b]

    def learn(self, words: list[str]) -> None:
        """Encode sorted distinct words, depth-first along their common prefixes."""
        extend = self._extend_merged if self.merged else self._extend_scored
        # by prefix length: the last piece (-1: an unknown character), where it starts, and the best score
        last, first, best = [-1], [0], [0.0]
        coded, learned, before = self.coded, self.words, ""
        for word in words:
            if self.merged and (word.startswith("  ") or word == " "):  # spaces in a row tie in score
                learned[word] = self._encode_marks(word)
                continue
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], first[shared + 1 :], best[shared + 1 :]
            extend(word, shared, last, first, best)
            before = word
            ids, at = [], len(word)
            while at:
                k = last[at]
                if k >= 0:
                    ids.append(coded[k])
                    at = first[at]
                else:
                    ids += [coded[self.bytes[b]] for b in reversed(word[at - 1].encode())]
                    at -= 1
            ids.reverse()
            learned[word] = b"".join(ids)

    def _extend_merged(self, word: str, shared: int, last: list, first: list, best: list) -> None:
        get, pairs, kinds, reach = self.id.get, self.pairs, len(self.text), self.reach.get
        for end in range(shared + 1, len(word) + 1):
            if word[end - 1] not in self.id:
                last.append(-1)
                first.append(end - 1)
                continue
            far = end - reach(word[end - 3 : end] if end > 2 else word[:end], 2)
            for start in range(far if far > 0 else 0, end):
                k = get(word[start:end])
                if k is None:
                    continue
                left = last[start] if start else -1
                if left >= 0:
                    fit = pairs.get(left * kinds + k)
                    if fit is None:
                        if len(pairs) > MEMO_PAIRS:
                            pairs.clear()
                        fit = pairs[left * kinds + k] = self.fits(left, k)
                    if fit:
                        break
                elif self.split(k) is not None:
                    break
            last.append(k)
            first.append(start)

    def _extend_scored(self, word: str, shared: int, last: list, first: list, best: list) -> None:
        get, reach, score = self.id.get, self.reach.get, self.score
        for end in range(shared + 1, len(word) + 1):
            top, piece, begin = best[end - 1] + self.unknown, -1, end - 1
            far = end - reach(word[end - 3 : end] if end > 2 else word[:end], 2)
            for start in range(far if far > 0 else 0, end):
                k = get(word[start:end])
                if k is not None and best[start] + score[k] > top:
                    top, piece, begin = best[start] + score[k], k, start
            best.append(top)
            last.append(piece)
            first.append(begin)

    def _encode_marks(self, word: str) -> bytes:
        ids: list[int] = []
        for run in re.findall(f"[{re.escape(''.join(c for c in set(word) if c in self.id))}]+|.", word, re.S):
            if run[0] in self.id:
                ids += self.merge(run)[0]
            else:
                ids += [self.bytes[b] for b in run.encode()]
        return np.array(ids, "<i4").tobytes()

    def known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct marked words; words of this and the last block or more are remembered."""
        fresh = []
        for w in words:
            if w not in self.words:
                if w in self.older:
                    self.words[w] = self.older[w]
                else:
                    fresh.append(w)
        self.learn(sorted(fresh))
        out = [self.words[w] for w in words]
        if len(self.words) > MEMO_WORDS:
            self.older, self.words = self.words, {}
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; nulls are empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return pa.array([], pa.list_(pa.int32()))
        # spaces in a row, at an end, or marks: these texts are split by the pattern
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        counts, flat = np.diff(plain.offsets.to_numpy()), plain.flatten()
        flat = flat.cast(pa.large_string())
        empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        found = flat.dictionary_encode()
        words = found.dictionary.to_pylist()
        own = [" " + w for w in words]
        split = {i: self.unit.findall(" " + texts[i].as_py().replace(MARK, " ")) for i in np.flatnonzero(odd).tolist()}
        place: dict[str, int] = {}
        for units in split.values():
            for w in units:
                if w not in place:
                    place[w] = len(own)
                    own.append(w)
        # line breaks alone part words too
        broken = {j: self.unit.findall(own[j]) for j in np.flatnonzero(pc.match_substring(pa.array(own), "\n")).tolist()}
        parts = dict.fromkeys(w for j, w in enumerate(own) if j not in broken)
        parts.update(dict.fromkeys(w for units in broken.values() for w in units))
        coded = dict(zip(parts, self.known(list(parts))))
        ids = pa.array([b"".join(map(coded.__getitem__, broken[j])) if j in broken else coded[w] for j, w in enumerate(own)], pa.large_binary())
        skipped = np.repeat(odd | empty, counts)
        index = found.indices.to_numpy()[~skipped]
        counts = np.where(odd | empty, 0, counts)
        if split:
            at = np.repeat(np.r_[0, np.cumsum(counts)][list(split)], [len(u) for u in split.values()])
            index = np.insert(index, at, [place[w] for units in split.values() for w in units])
            counts[list(split)] = [len(u) for u in split.values()]
        taken = ids.take(pa.array(index))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]) // 4, [None, taken.buffers()[2]])
        ends = offsets[np.r_[0, np.cumsum(counts)]] // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids; null lists are empty."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type))
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        edges = np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))].astype(np.int64)
        first = edges[:-1][np.diff(edges) > 0]
        flat[first] += len(self.text)
        taken = self.raw.take(pa.array(flat))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        out = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(offsets[edges].tobytes()), taken.buffers()[2]])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # byte pieces that are no text
            out = pa.array([b.decode(errors="replace") for b in out.cast(pa.large_binary()).to_pylist()], pa.large_string())
        return out.cast(pa.string())


def model_type(proto: bytes) -> int:
    """1 for a unigram, 2 for a BPE model: field 3 of the trainer's settings, field 2 of the model file."""

    def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = raw[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(raw):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                n = {1: 8, 5: 4}.get(key & 7)
                n = number() if n is None else n
                yield key >> 3, raw[at : at + n]
                at += n

    settings = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(settings) if k == 3), 1)


def coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder.load(path)
    return _coders[path]


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of some ``most`` units of size each (a larger row alone)."""
    lo = 0
    whole = np.cumsum(sizes)
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(whole, (whole[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def encode_pieces(docs: DataFrame, model: str, *, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text as array<int>; a column of that name is replaced."""
    docs = docs.drop(out_col) if out_col != text_col else docs
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes):
                yield pa.RecordBatch.from_arrays([*part.columns, coder(model).encode(part.column(at))], [*names, out_col])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{out_col}` array<int>"]))


def decode_pieces(docs: DataFrame, model: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids; null ids decode to an empty text."""
    docs = docs.drop(out_col)
    names, at = docs.columns, docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, BLOCK_BYTES // 4):
                yield pa.RecordBatch.from_arrays([*part.columns, coder(model).decode(part.column(at))], [*names, out_col])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{out_col}` string"]))


def spaced(text: Column) -> Column:
    """What a text decodes to: marks become spaces."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))
