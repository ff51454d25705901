import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from orrery.llm import bpe
from orrery.llm.bpe import PairCoder, TokenTable, byte_letters, decode_bpe, encode_bpe

VOCAB = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello, it's 42 o'clock!!", "", "a\tb\n\nc  ''s x'll", "été À ß ñ ü×÷", "naïve — dash", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>z", "<|ENDOFTEXT|>", "IT'S!'S", "\x1ca\x85b\xa0c", "ΑΣ İ ǅ", "a_b-c @#$%", "x" * 3000, "aaaaaaa hahahaha aaaa", "日本語 \U0001f600 é", "①Ⅷﬁ", "é é", " 　x", None]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(VOCAB)


def unpack(raw):
    return np.frombuffer(raw, "<u4").tolist()


def decoded(table, raw):
    ids = np.frombuffer(raw, "<u4")
    return table.decode(ids, np.array([0, len(ids)])).to_pylist()[0]


def test_equals_library(lib):
    own, table, rnd = PairCoder.load(VOCAB), TokenTable.load(VOCAB), random.Random(0)
    letters = "abcdeilnorst ABé-.,'12 \nßΣ中\x85"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    texts += pq.ParquetFile("/root/testdata/sf0.01/documents.parquet").read(columns=["text"])["text"].to_pylist()
    for text, raw in zip(texts, own.encode(texts)):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert unpack(raw) == want, (text or "")[:80]
        assert decoded(table, raw) == lib.decode(want, skip_special_tokens=False), (text or "")[:80]


def one_by_one(word, rank, suffix):
    """Merge the pair of least rank, leftmost first, until none is left."""
    parts = [c for c in word[:-1]] + [word[-1] + suffix]
    while True:
        best = min(((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_merges(seed):
    """Vocabularies whose merges make pairs of lower rank than their own, and twins."""
    rnd, suffix = random.Random(seed), "</w>" if seed % 2 else ""
    tokens = list(dict.fromkeys([*byte_letters(), *(c + suffix for c in byte_letters())]))
    pool, merges = ["a", "b", "c", *(c + suffix for c in "abc"), "aa"], [("a", "a")]
    for _ in range(60):
        a, b = rnd.choice(pool), rnd.choice(pool)
        if (a, b) not in merges and (not suffix or suffix not in a):
            merges.append((a, b))
            pool.append(a + b)
    rnd.shuffle(merges)
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*tokens, *pool]))}
    own = PairCoder(vocab, merges, {}, suffix)
    assert own.uneven.any() and own.twins.any()
    rank = {m: i for i, m in enumerate(merges)}
    words = ["".join(rnd.choice("abc" if rnd.random() < 0.7 else "a") for _ in range(rnd.randrange(1, 25))) for _ in range(800)]
    ids, edges = own.merge([w.encode() for w in words])
    for w, lo, hi in zip(words, edges, edges[1:]):
        assert ids[lo:hi].tolist() == [vocab[p] for p in one_by_one(w, rank, suffix)], w


def test_what_is_remembered_changes_nothing(monkeypatch):
    texts = pq.ParquetFile("/root/testdata/sf0.001/documents.parquet").read(columns=["text"])["text"].to_pylist()
    want = PairCoder.load(VOCAB).encode(texts)
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    other = PairCoder.load(VOCAB)
    assert [raw for lo in range(0, len(texts), 17) for raw in other.encode(texts[lo : lo + 17])] == want


def test_frames(spark, lib):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate([*ODD, "same text", "same text"])], "doc_id long, text string, ids string, decoded int")
    for packed in (True, False):
        coded = encode_bpe(docs, VOCAB, packed=packed)
        assert dict(coded.dtypes)["ids"] == ("binary" if packed else "array<int>")
        for r in decode_bpe(coded, VOCAB).collect():
            want = lib.encode(r["text"] or "", add_special_tokens=False).ids
            assert (unpack(r["ids"]) if packed else r["ids"]) == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert encode_bpe(docs.limit(0), VOCAB).count() == 0
    odd = spark.createDataFrame([(0, None), (1, []), (2, [320, 99_999, None, 320]), (3, [-1])], "i int, ids array<int>")
    one = lib.decode([320])
    assert [r["decoded"] for r in decode_bpe(odd, VOCAB).orderBy("i").collect()] == ["", "", f"{one} {one}", ""]


def test_long_texts(lib):
    """A word of a million letters, and a million words."""
    own, rnd = PairCoder.load(VOCAB), random.Random(1)
    for text in ("".join(rnd.choice("abcdefgh") for _ in range(1_000_000)), "a " * 1_000_000):
        raw = own.encode([text])[0]
        assert unpack(raw) == lib.encode(text, add_special_tokens=False).ids


def test_query_equals_library(spark, lib):
    from orrery.llm.queries import op12_bpe

    got = {r["doc_id"]: tuple(r)[1:] for r in op12_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d["text"] or "", add_special_tokens=False).ids
        digest = sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d["doc_id"]] == (len(ids), digest, sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
