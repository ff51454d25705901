import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from orrery.llm.packing import WordTokenizer, best_fit_rounds, pack_documents

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def test_word_tokenizer_equals_library():
    texts = ["Hello, it's 42 o'clock!!", "", "a\tb\n\nc  ''s x'll", "été À ß ñ ü×÷", "naïve — dash", "<|endoftext|>", "IT'S!'S", "\x1ca\x85b\xa0c", "ΑΣ İ ǅ", "a_b-c @#$%", "x" * 3000]
    t = Tokenizer.from_file(VOCAB)
    got = WordTokenizer(VOCAB).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        best = min(fit, key=lambda b: b[0]) if fit else None
        if best is None:
            bins.append([capacity - n])
        else:
            best[0] -= n
    return len(bins)


def test_rounds_equal_plain_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(60):
        cap = int(rng.integers(5, 60))
        lengths = rng.integers(1, cap + 1, rng.integers(1, 80)).tolist()
        counts = {n: lengths.count(n) for n in set(lengths)}
        fill, spans = {}, {}
        for length, rank, n, first, per, offset in best_fit_rounds(counts, cap):
            for i in range(n):
                spans.setdefault(first + i // per, []).append((offset + i % per * length, length))
        for seq, got in spans.items():
            got.sort()
            assert [s for s, _ in got] == np.cumsum([0, *[n for _, n in got]])[:-1].tolist()
            assert sum(n for _, n in got) <= cap
        assert sum(len(x) for x in spans.values()) == len(lengths)
        assert len(spans) == plain_best_fit(lengths, cap)


def test_pack_documents(spark):
    rows = [(1, "a " * 5000, 5), (2, None, 1), (3, "", 2), (4, "word " * 30, 3), (4, "word " * 30, 3), (5, "b " * 2047, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(docs, VOCAB, keep_ids=True).collect()
    t = Tokenizer.from_file(VOCAB)
    by = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    ids = [i for r in sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["piece"]) for i in r["ids"]]
    assert ids == t.encode("a " * 5000, add_special_tokens=False).ids + [0]
    assert len(got) == 8 and len(by) == 4
    assert pack_documents(docs.limit(0), VOCAB).count() == 0
