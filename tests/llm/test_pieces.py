import itertools
import random
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from orrery.llm import pieces
from orrery.llm.pieces import MARK, PieceCoder, decode_pieces, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return PieceCoder.load(MODEL)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_library(own, lib):
    rnd = random.Random(0)
    odd = ["", " ", "a", " a ", "a  b   c", "\n\n\t", "é中\U0001f600x", "<s></s><unk><0x0A>", "aaaaaaa aaaa", "Ⅷﬁ", "=" * 50, "a▁b", "日本語 text", "x" * 400, *[" " * n + "x" for n in range(40)], *["x" + " " * n for n in range(40)], "1234567890 3.14159", "don't CAN'T", " 　", "\n", "a\n", "\na b", "a\n\nb \n c", None]
    letters = "abcdeilnorst ABé-.,'12 \n"
    odd += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    odd += pq.ParquetFile("/root/testdata/sf0.01/documents.parquet").read(columns=["text"])["text"].to_pylist()[:300]
    ids = own.encode(pa.array(odd, pa.string()))
    for text, got, back in zip(odd, ids.to_pylist(), own.decode(ids).to_pylist()):
        assert got == lib.encode(text or ""), (text or "")[:80]
        assert back == (text or "").replace(MARK, " "), (text or "")[:80]


def test_pairs_fit_as_merges_say(own):
    """Undoing merges at the border tells the same as merging the whole text."""
    rnd = random.Random(3)
    plain = [i for i in own.id.values() if own.split(i) is not None]
    joined = [(a, b) for a, b in ((rnd.choice(plain), rnd.choice(plain)) for _ in range(20_000))]
    for t in rnd.sample(list(own.id), 8000):  # pieces cut anywhere: pairs that do merge among them
        for cut in range(1, len(t)):
            if t[:cut] in own.id and t[cut:] in own.id:
                joined.append((own.id[t[:cut]], own.id[t[cut:]]))
    held = 0
    for a, b in joined:
        if own.split(a) is None or own.split(b) is None or (own.text[a] + own.text[b]).startswith("  "):
            continue
        want = own.merge(own.text[a] + own.text[b])[0] == [a, b]
        assert own.fits(a, b) == want, (own.text[a], own.text[b])
        held += want
    assert 1000 < held < len(joined)


def test_long_unbroken_texts(own, lib):
    """Linear in memory and time: no spaces, only spaces, one character, other scripts."""
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789/+") for _ in range(200_000)), "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(200_000)), " " * 200_000, "x" * 200_000, "ab" * 100_000, "\n" * 200_000]
    for text in texts:
        tracemalloc.start()
        began = time.time()
        ids = own.encode(pa.array([text]))
        took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert took < 30 and peak < 500 << 20, (text[:5], took, peak)
        assert own.decode(ids).to_pylist() == [text]
        if text[0] != " ":
            assert ids.to_pylist()[0] == lib.encode(text)


def test_blocks_and_memory_of_words(own, monkeypatch):
    """The same ids whatever is remembered, and however rows are cut."""
    monkeypatch.setattr(pieces, "MEMO_WORDS", 50)
    texts = pq.ParquetFile("/root/testdata/sf0.001/documents.parquet").read(columns=["text"])["text"].combine_chunks()
    want = own.encode(texts).to_pylist()
    other = PieceCoder.load(MODEL)
    got = [i for lo in range(0, len(texts), 17) for i in other.encode(texts.slice(lo, 17)).to_pylist()]
    assert got == want
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    sizes = np.array([len(t or "") for t in texts.to_pylist()])
    assert [t for p in pieces.slices(batch, sizes, 1000) for t in p.column(0).to_pylist()] == texts.to_pylist()


def test_unigram_model_takes_the_best_path():
    """Viterbi against all segmentations, with shared prefixes and unknown characters."""
    rnd = random.Random(7)
    table = {MARK: -2.0, **{c: -3.0 - i for i, c in enumerate("abc")}}
    while len(table) < 60:
        table.setdefault(rnd.choice(["", MARK]) + "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 5))), -rnd.uniform(2, 9))
    listed = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *table.items()]
    own = PieceCoder(listed, {b: b + 1 for b in range(256)}, {0}, merged=False)
    worst = min(table.values()) - pieces.UNKNOWN_COST

    def best(word):
        top = None
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in zip(edges, edges[1:])]
            if all(p in table or len(p) == 1 for p in parts):
                total = sum(table.get(p, worst) for p in parts)
                top = total if top is None or total > top else top
        return top

    texts = [" ".join("".join(rnd.choice("abcabcz") for _ in range(rnd.randrange(1, 8))) for _ in range(3)) for _ in range(60)]
    for text, ids in zip(texts, own.encode(pa.array(texts)).to_pylist()):
        scores = [table.get(own.text[i].replace(" ", MARK), worst) for i in ids]
        assert abs(sum(scores) - sum(best(MARK + w) for w in text.split())) < 1e-9
        assert own.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [text]


def test_model_type():
    assert pieces.model_type(sentencepiece.SentencePieceProcessor(model_file=MODEL).serialized_model_proto()) == 2
    assert pieces.model_type(b"") == 1


def test_frames(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "Hello  world", "y"), (2, "Hello  world", "y"), (3, "", "z")], "doc_id long, text string, ids string")
    rows = decode_pieces(encode_pieces(docs, MODEL), MODEL).collect()
    assert sorted((r["doc_id"], r["decoded"], len(r["ids"])) for r in rows) == [(1, "", 0), (2, "Hello  world", 3), (2, "Hello  world", 3), (3, "", 0)]
    assert encode_pieces(docs.limit(0), MODEL).count() == 0
    odd = spark.createDataFrame([(None,), ([300, 13],), ([],), ([131, 131],)], "ids array<int>")
    assert [r["decoded"] for r in decode_pieces(odd, MODEL).collect()][0] == ""


def test_query(spark):
    from orrery.llm.queries import op4_pieces

    rows = op4_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and all(r["restored"] for r in rows)
