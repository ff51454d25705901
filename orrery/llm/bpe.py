"""BPE encoding and decoding under a word-level vocabulary.

Method: a pair occurrence index. The distinct words of a block of texts of a
partition stand one after another in one array of symbols. Each pair of
neighbours that the vocabulary merges has a rank, and the index maps the rank to
all the pair's positions. Active ranks are applied in ascending order: all the
positions of a rank are merged at once, the pairs on both sides of them change,
and their positions are entered under the ranks that they have now. A position
whose pair has changed since it was entered is passed over. Where a merge can
make a pair of a rank below its own, a rank's positions are applied one per word
at a time, leftmost first, as merging word by word would.

Texts are split as the vocabulary file says: by patterns of our own where texts
have ASCII and Latin-1 letters only, by the library's normalizer and pattern
otherwise. The library never encodes.

Defined results: a null text encodes as an empty one, to no ids, and null ids
decode to an empty text; ids that the vocabulary lacks are left out of a decoded
text; the vocabulary's added tokens are cut out of texts before anything else;
texts of any length a column holds are taken whole, in linear memory, in a block
of their own; repeated rows are encoded each on its own; an empty table gives an
empty result; a column of the output's name is replaced, others are kept.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orrery.llm.packing import UNUSUAL, WORD
from orrery.llm.pieces import slices

#: Words (three times as many at most) that a worker remembers, some 200 bytes each.
MEMO_WORDS = 100_000
#: Bytes of text whose new words are encoded together (a longer text alone), and ids that are decoded together.
BLOCK_BYTES, BLOCK_IDS = 16 << 20, 1 << 20
#: A pair that is never merged.
NEVER = np.int32(2**31 - 1)
_loaded: dict[tuple[type, str], object] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class PairCoder:
    """Encodes and decodes under a byte-level BPE vocabulary whose words end in ``suffix``.

    ``vocab`` has ids by token, ``merges`` the pairs in order of rank, ``added``
    the tokens that are cut out of texts as they stand.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int], suffix: str = "", library=None):
        self.library, self.added = library, added
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        size = 1 + max([*vocab.values(), *added.values()])
        self.size = np.int64(size + 1)  # one number more, for what stands outside all words
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.product = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.twins = left == right
        keys = left * self.size + right
        first = np.full(size, len(merges))  # by token, the least rank of a pair that it is part of
        rank = np.arange(len(merges))
        for side in (left, right):
            np.minimum.at(first, side, rank)
        self.uneven = first[self.product] < rank
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], rank[order].astype(np.int32)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "PairCoder":
        from tokenizers import Tokenizer

        told = read_vocabulary(path)
        model = told["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in told["added_tokens"]}, model.get("end_of_word_suffix") or "", Tokenizer.from_file(path))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, NEVER where they don't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words' tokens in a row, and the edges of the words in them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ends = np.cumsum(sizes)
        symbol = np.r_[self.inner[raw], np.int32(self.size - 1)].astype(np.int64)
        symbol[ends - 1] = self.final[raw[ends - 1]]
        # neighbours within the word; n is outside
        after = np.arange(1, n + 2, dtype=np.int32)
        after[ends - 1] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[ends - sizes] = n
        rank = np.full(n + 1, NEVER)
        inside = np.flatnonzero(after[:n] < n).astype(np.int32)
        rank[inside] = self.rank_of(symbol[inside], symbol[inside + 1])
        index: dict[int, list[np.ndarray]] = {}  # of each active rank, where its pair was met
        active: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            some = ranks < NEVER
            places, ranks = places[some], ranks[some]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(places, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        enter(inside, rank[inside])
        fresh, live = np.zeros(n + 1, bool), np.ones(n, bool)
        word = np.repeat(np.arange(len(words)), sizes) if self.uneven.any() else None
        while active:
            r = heapq.heappop(active)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank[at] == r]
            if self.uneven[r] and len(at) > 1:
                at = np.sort(at)
                lead = np.r_[True, word[at[1:]] != word[at[:-1]]]
                enter(at[~lead], rank[at[~lead]])
                at = at[lead]
            elif self.twins[r] and len(at) > 1:  # of three alike, the first two merge
                at = np.sort(at)
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            rest = after[gone]
            symbol[at] = self.product[r]
            after[at] = rest
            before[rest] = at  # also of n, which is never read
            rank[gone] = NEVER
            live[gone] = False
            fresh[at] = True
            prior = before[at]
            prior = prior[(prior < n) & ~fresh[prior]]
            fresh[at] = False
            changed = np.concatenate([prior, at])
            rank[changed] = now = self.rank_of(symbol[changed], symbol[after[changed]])
            enter(changed, now)
        edges = np.r_[0, np.cumsum(live)][np.r_[0, ends]]
        return symbol[:n][live], edges

    def learn(self, words: list[str]) -> None:
        if words:
            ids, edges = self.merge([w.encode() for w in words])
            raw, cuts = ids.astype("<u4").tobytes(), (4 * edges).tolist()
            for w, lo, hi in zip(words, cuts, cuts[1:]):
                self.words[w] = raw[lo:hi]

    def split(self, text: str) -> list[str]:
        """The words of a text; an added token stands as a word of its own."""
        if not UNUSUAL.search(text):
            return WORD.findall(text.lower())
        out = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(part)
            elif part:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(bytes(map(self.byte.__getitem__, word)).decode())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; words of this and the last block or more are remembered."""
        need: set[str] = set()
        for t in texts:  # split once more below: the words of a block, all at once, would take many times its bytes
            if t:
                need.update(self.split(t))
        fresh = []
        for w in need:
            if w in self.added:
                self.words[w] = np.array([self.added[w]], "<u4").tobytes()
            elif w not in self.words:
                if w in self.older:
                    self.words[w] = self.older[w]
                else:
                    fresh.append(w)
        self.learn(fresh)
        get = self.words.__getitem__
        out = [b"".join(map(get, self.split(t))) if t else b"" for t in texts]
        if len(self.words) > MEMO_WORDS:
            self.older, self.words = self.words if len(self.words) <= 2 * MEMO_WORDS else {}, {}
        return out


class TokenTable:
    """Decodes ids: their tokens, joined by spaces."""

    def __init__(self, tokens: dict[str, int]):
        listed = [b""] * (1 + max(tokens.values()))
        for token, i in tokens.items():
            listed[i] = token.encode()
        self.known = np.array([*map(bool, listed), False])
        # a text's first token goes without the space before it
        self.raw = pa.array([*(b" " + t for t in listed), *listed], pa.large_binary())

    @classmethod
    def load(cls, path: str) -> "TokenTable":
        told = read_vocabulary(path)
        return cls({**told["model"]["vocab"], **{t["content"]: t["id"] for t in told["added_tokens"]}})

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The texts of ids in a row, cut at ``edges``: tokens joined by spaces."""
        ids = np.minimum(ids.astype(np.int64), len(self.known) - 1)
        some = self.known[ids]
        if not some.all():
            edges = np.r_[0, np.cumsum(some)][edges]
            ids = ids[some]
        ids[edges[:-1][np.diff(edges) > 0]] += len(self.raw) // 2
        taken = self.raw.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        found = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(offsets[edges].tobytes()), taken.buffers()[2]])
        return found.cast(pa.string())


def read_vocabulary(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def loaded(kind: type, path: str):
    """One of each kind and path in a worker."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind.load(path)
    return _loaded[kind, path]


def encode_bpe(docs: DataFrame, vocab: str, *, text_col: str = "text", out_col: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` with the ids of the text; ``packed``: as binary of little-endian unsigned 32-bit ids, else array<int>."""
    docs = docs.drop(out_col) if out_col != text_col else docs
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, BLOCK_BYTES):
                ids = pa.array(loaded(PairCoder, vocab).encode(part.column(at).to_pylist()), pa.binary())
                if not packed:
                    lengths = pc.binary_length(ids).to_numpy(zero_copy_only=False) // 4
                    values = pa.Array.from_buffers(pa.int32(), int(lengths.sum()), [None, ids.buffers()[2]])
                    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*names, out_col])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{out_col}` {'binary' if packed else 'array<int>'}"]))


def decode_bpe(docs: DataFrame, vocab: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids, which are array<int> or packed binary."""
    docs = docs.drop(out_col)
    names, at = docs.columns, docs.columns.index(ids_col)
    packed = dict(docs.dtypes)[ids_col] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null((pc.binary_length if packed else pc.list_value_length)(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for part in slices(batch, lengths // 4 if packed else lengths, BLOCK_IDS):
                ids = part.column(at)
                if packed:
                    raws = [r or b"" for r in ids.to_pylist()]
                    flat, sizes = np.frombuffer(b"".join(raws), "<u4"), np.array([len(r) // 4 for r in raws], np.int64)
                else:
                    ids = pc.fill_null(ids, pa.scalar([], ids.type))
                    flat, sizes = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False).view(np.uint32), pc.list_value_length(ids).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, loaded(TokenTable, vocab).decode(flat, np.r_[0, np.cumsum(sizes)])], [*names, out_col])

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{out_col}` string"]))
