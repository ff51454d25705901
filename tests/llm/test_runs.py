import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orrery.llm import runs as module
from orrery.llm.runs import find_runs, periodic_runs, primitive, split_words


def plain_runs(words, min_length=6, exponent=4):
    """All maximal stretches of every period, each under its smallest."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(min_length, exponent * q):
                out.setdefault((start, length), q)
            i += 1
    return sorted((start, length, q) for (start, length), q in out.items())


def collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def some_words(rnd, most=200):
    n, letters = rnd.randrange(most), rnd.choice([1, 2, 3, 10])
    words = [rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randrange(4)):
        if n:
            a, p = rnd.randrange(n), rnd.randrange(1, 30)
            for i in range(a + p, min(n, a + p * rnd.randrange(2, 9))):
                words[i] = words[i - p]
    return words


def found(texts, *rules):
    got = find_runs(np.array([w for t in texts for w in t], np.int32), np.array([len(t) for t in texts], np.int64), *rules)
    return [got.get(i, []) for i in range(len(texts))]


@pytest.mark.parametrize("rules", [(6, 4), (2, 2), (6, 3), (12, 5), (40, 4), (6, 9)])
def test_equals_plain_search(rules):
    rnd, total = random.Random(str(rules)), 0
    for _ in range(250):
        texts = [some_words(rnd) for _ in range(rnd.randrange(1, 5))]
        want = [plain_runs(t, *rules) for t in texts]
        assert found(texts, *rules) == want
        total += sum(map(len, want))
    assert total > 50


def test_parts_of_long_stretches(monkeypatch):
    """Short keys and small automata find the same."""
    rnd = random.Random(2)
    texts = [some_words(rnd, 1500) for _ in range(60)] + [[i % 97 for i in range(1500)], [0] * 700, [0] * 300 + [1] + [0] * 300 + [1] + [0] * 300 + [1] + [0] * 300]
    want = [plain_runs(t) for t in texts]
    monkeypatch.setattr(module, "KEY", 8)
    monkeypatch.setattr(module, "NODES", 32)
    assert found(texts) == want


def test_long_texts_in_linear_time():
    one = np.zeros(1_000_000, np.int32)
    assert find_runs(one, np.array([len(one)])) == {0: [(0, 1_000_000, 1)]}
    wide = np.tile(np.arange(30_000, dtype=np.int32), 10)
    assert find_runs(wide, np.array([len(wide)])) == {0: [(0, 300_000, 30_000)]}
    nested = np.tile(np.r_[np.zeros(500, np.int32), np.arange(1, 501, dtype=np.int32)], 100)
    got = find_runs(nested, np.array([len(nested)]))[0]
    assert got[0] == (0, 500, 1) and got[1] == (0, 100_000, 1000) and len(got) == 101


def test_primitive():
    assert primitive(np.array([1, 2, 1, 2] * 2), 2) and not primitive(np.array([1, 2, 1, 2] * 2), 4)
    assert not primitive(np.tile([1, 2, 3], 20), 15) and primitive(np.tile(np.arange(15), 2), 15)
    with pytest.raises(ValueError):
        find_runs(np.zeros(3, np.int32), np.array([3]), 6, 1)


def test_words_are_parted_by_ascii_white_space():
    texts = [None, "", " \t", "a", " a\x0bb\x0cc\rd\ne\tf ", "a\x1cb\x85c\xa0d e", "é  ü"]
    words, counts = split_words(pa.array(texts))
    want = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    assert words.to_pylist() == [w for t in want for w in t] and counts.tolist() == [len(t) for t in want]


def test_frames(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "x " * 9 + "y", 7), (3, "x " * 9 + "y", 7), (4, "a b c " * 4, 7), (5, "a b c " * 3, 7), (6, "z" + " a\nb" * 40_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect())
    assert got == [
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 10, [(0, 9, 1)], "x y"),
        (3, 10, [(0, 9, 1)], "x y"),
        (4, 12, [(0, 12, 3)], "a b c"),
        (5, 9, [], "a b c a b c a b c"),
        (6, 80_001, [(1, 80_000, 2)], "z a b"),
    ]
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_plain_search(spark):
    from orrery.llm.queries import op13_runs, planted

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: tuple(r)[1:] for r in op13_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = re.findall("[^\x20\x09-\x0d]+", d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue  # the plain search takes their square
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = lambda t: sha256(t.encode()).hexdigest()
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[d["doc_id"]] == (len(runs), *told, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(" ".join(collapsed(words, runs)))), d["doc_id"]
        some += len(runs)
    assert some > 20
    odd = spark.createDataFrame([(None, "a b"), (10, None), (11, ""), (12, " ")], "doc_id long, text string")
    assert [r["text"] for r in planted(odd).collect()] == ["a b", None, "", " "]
