import random
from collections import Counter

import numpy as np
import pytest

from orrery.llm import windows
from orrery.llm.substrings import FMIndex, dedup_substrings, resolve_words
from orrery.llm.suffixes import SuffixArray, dedup_suffixes, resolve_suffixes


def brute(texts, length):
    """Kept symbols of each sequence."""
    seen = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[tuple(t[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append([s for s, g in zip(t, gone) if not g])
    return out


def corpus(rnd, n=60):
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randrange(20, 80))] for _ in range(4)]
    texts = [None, "", "  \t ", "one", "For " * 150, "ab " * 90, "In. " * 40 + "x " + "In. " * 37]
    for _ in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 150))]
        if rnd.random() < 0.5:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = rnd.choice(passages)
        texts.append(rnd.choice([" ", "\n", "  "]).join(words))
        if rnd.random() < 0.3:
            again = list(words)
            if again and rnd.random() < 0.7:
                again[rnd.randrange(len(again))] = "edited"
            texts.append(" ".join(again))
    return texts


@pytest.mark.parametrize("group", [64, 2, 0])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(windows, "GROUP", group)
    texts = corpus(random.Random(group))
    docs = spark.createDataFrame([(i, t, "x", "y", 3, "z") for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words string, found int, _ROW string").repartition(3)
    rows = {r["doc_id"]: r for r in dedup_substrings(docs, 12, gram=3).collect()}
    assert all(r["found"] == 3 and r["kept"] == "x" and r["_ROW"] == "z" for r in rows.values())
    want = brute([(t or "").encode().split() for t in texts], 12)
    assert len(rows) == len(texts)
    for i, w in enumerate(want):
        assert rows[i]["text"].encode() == b" ".join(w)
        assert rows[i]["n_words"] - len(w) == sum(s["end"] - s["start"] for s in rows[i]["removed"])
    want = brute([(t or "").encode() for t in texts], 60)
    rows = {r["doc_id"]: r for r in dedup_suffixes(docs, 60, gram=12).collect()}
    for i, w in enumerate(want):
        assert bytes(rows[i]["kept"]) == bytes(w)
        assert rows[i]["n_bytes"] == len((texts[i] or "").encode())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(docs).count() == 0 and dedup_suffixes(docs).count() == 0


def test_resolvers_agree():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = rng.integers(0, 4, 400).astype(np.uint64)
        parts = [base[a : a + int(rng.integers(6, 40))] for a in rng.integers(0, 350, 12)]
        for copies in (None, rng.integers(1, 3, 12).tolist()):
            seen = Counter(tuple(p[i : i + 6].tolist()) for p, n in zip(parts, copies or [1] * 12) for i in range(len(p) - 5) for _ in range(n))
            for p, a, b in zip(parts, resolve_words(parts, 6, copies), resolve_suffixes(parts, 6, copies)):
                want = [seen[tuple(p[i : i + 6].tolist())] > 1 for i in range(len(p) - 5)]
                assert a.tolist() == want and b.tolist() == want


def test_longest_factors():
    """Longest previous and next factors against all pairs of suffixes."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        parts = [rng.integers(0, 3, int(rng.integers(1, 40))).astype(np.uint64) for _ in range(4)]
        array = SuffixArray(parts, 64)
        text = array.symbols.tolist()
        at = np.arange(len(text))

        def common(i, j):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        for earlier in (True, False):
            want = [max((common(i, j) for j in (range(i) if earlier else range(i + 1, len(text)))), default=0) for i in at.tolist()]
            assert array.factors(earlier, at).tolist() == want


def test_very_long_text(spark):
    """One text of some megabytes, with a passage of another in it."""
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400_000)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, "a b c " + " ".join(words[1000:1050]) + " d"), (2, None), (3, "é" * 500)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in dedup_substrings(docs, 35).collect()}
    assert rows[1]["text"] == "a b c d" and [tuple(s) for s in rows[0]["removed"]] == [(1000, 1050)] and rows[2]["text"] == ""
    rows = {r["doc_id"]: r for r in dedup_suffixes(docs, 200).collect()}
    assert rows[1]["n_bytes"] - len(rows[1]["kept"]) >= len(" ".join(words[1000:1050])) and len(rows[3]["removed"]) == 1


def test_fm_index_counts():
    text = np.r_[np.random.default_rng(2).integers(1, 6, 200), 0]
    index = FMIndex(text, 6)
    for _ in range(50):
        p = text[(a := np.random.randint(0, 190)) : a + 4]
        lo, hi = np.array([0]), np.array([len(text)])
        for s in p[::-1]:
            lo, hi = index.step(np.array([s]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + 4] == p).all() for i in range(len(text) - 3))


def test_queries_equal_brute_force(spark):
    """The columns of op3 and op7 on the smallest tables."""
    from hashlib import sha256

    from orrery.llm.queries import op3_substrings, op7_suffixes

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = list(texts)
    words = brute([texts[i].encode().split() for i in ids], 35)
    got = {r["doc_id"]: r for r in op3_substrings(spark, sf).collect()}
    for i, kept in zip(ids, words):
        n = len(texts[i].encode().split())
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, n - len(kept), sha256(b" ".join(kept)).hexdigest())
    seen = Counter(hash(raw[a : a + 200]) for raw in (texts[i].encode() for i in ids) for a in range(len(raw) - 199))
    got = {r["doc_id"]: r for r in op7_suffixes(spark, sf).collect()}
    for i in ids:
        raw = texts[i].encode()
        step = np.zeros(len(raw) + 1, int)
        for a in range(len(raw) - 199):
            if seen[hash(raw[a : a + 200])] > 1:
                step[a] += 1
                step[a + 200] -= 1
        gone = step.cumsum()[:-1] > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(raw), int(gone.sum()), spans, sha256(kept).hexdigest())
