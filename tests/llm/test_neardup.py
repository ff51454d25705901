import math
import random
from collections import Counter

import numpy as np

from orrery.llm import neardup
from orrery.llm.queries import op5_neardup
from orrery.llm.neardup import band_keys, keep_one, near_duplicates, samples, similarities, similarity, unpack, unpack_sorted, weighted_nodes


def grams(text):
    words = (text or "").lower().split()
    k = min(len(words), 5)
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def weights_of(texts):
    """Each text's shingles with count times inverse document frequency."""
    own = [grams(t) for t in texts]
    df = Counter(g for o in own for g in o)
    return [{g: n * (1 + math.log((1 + len(texts)) / (1 + df[g]))) for g, n in o.items()} for o in own]


def jaccard(a, b):
    both = sum(min(a[g], b[g]) for g in a.keys() & b.keys())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(texts, threshold=0.8):
    """(least of each text's class, pairs of unlike texts at the threshold)."""
    sets = weights_of(texts)
    label, pairs = list(range(len(texts))), []

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "").lower() == (texts[j] or "").lower()
            if same or (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= threshold):
                label[max(find(i), find(j))] = min(find(i), find(j))
                if not same:
                    pairs.append((i, j))
    return [find(i) for i in range(len(texts))], pairs


def corpus(rnd):
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]
    texts = [None, "", "one two", "One two", "a b c"]
    passage = [rnd.choice(vocab) for _ in range(50)]
    for i in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(30, 200))]
        if i % 2:
            words[3:3] = passage
        texts.append(" ".join(words))
        for _ in range(rnd.choice([0, 0, 1, 3, 8])):
            again = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2, 5, 9])):
                again[rnd.randrange(len(again))] = rnd.choice(vocab)
            texts.append(" ".join(again))
    return texts


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(1, 1 << 63, 300, np.uint64)
    a = (np.sort(keys[:250]), rng.uniform(0.5, 6, 250))
    b = (a[0][30:], np.r_[a[1][30:200], a[1][200:] * 2])
    drawn = [samples([a, b])]
    for salt in range(1, 40):  # other draws
        s = np.uint64(salt * 7919 + 1)
        drawn.append(samples([(a[0] * s, a[1]), (b[0] * s, b[1])]))
    share = np.mean([(d[0] == d[1]).mean() for d in drawn])
    assert abs(share - similarity((*a, a[1].sum()), (*b, b[1].sum()))) < 0.03


def test_weights_are_those_of_true_document_frequencies(spark, monkeypatch):
    """Also where the shingles are counted in many ranges, and texts lie in many shards."""
    monkeypatch.setattr(neardup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(neardup, "RANGE_SHINGLES", 500)
    texts = corpus(random.Random(4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["least"]: r for r in weighted_nodes(docs).collect()}
    sets, df = weights_of(texts), Counter(g for t in texts for g in grams(t))
    seen = 0
    for i, r in rows.items():
        total = sum(sets[i].values())
        private = sum(w for g, w in sets[i].items() if df[g] == 1)
        assert (r["keys"] is not None) == (total > 0 and private <= 0.2 * total + 1e-9)
        if r["keys"] is not None:
            seen += 1
            assert abs(r["total"] - total) < 1e-3 and abs(r["share"] - private / total) < 1e-6
            got = unpack(r["weights"], "<f4")
            assert len(unpack_sorted(r["ids"])) == len(got)
            assert np.allclose(sorted(got), sorted(w for g, w in sets[i].items() if df[g] > 1), rtol=1e-5)
    assert seen > 50


def test_classes_equal_brute_force(spark):
    texts = corpus(random.Random(4))
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, node int, _own0 string").repartition(4)
    want, pairs = brute_classes(texts)
    assert len(pairs) > 50
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = 3 if r["doc_id"] is None else r["doc_id"]
        assert r["class_id"] == want[i], (i, r)
        assert r["class_size"] == want.count(want[i])
        assert r["keep"] == (want[i] == i)
    kept = keep_one(docs.unionByName(docs.filter("doc_id = 5"))).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))
    assert all(r["node"] == 1 and r["_own0"] == "y" for r in kept)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_null_and_empty_ids_are_apart(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), ("", "h i j k l m n"), (None, "a b c d e f g")], "doc_id string, text string")
    assert sorted(repr(r["doc_id"]) for r in keep_one(docs).collect()) == ["''", "None"]


def test_very_long_text(spark):
    rnd = random.Random(2)
    words = [str(rnd.random())[2:9] for _ in range(300_000)]
    again = list(words)
    for i in range(0, 300_000, 5000):
        again[i] = "edited"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(again)), (3, "short"), (4, "x" * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_similarities_equal_similarity():
    rng = np.random.default_rng(3)
    unit = rng.uniform(1, 6, 60)
    sets = []
    for n in (1, 20, 40, 60, 35, 50):
        own = np.sort(rng.choice(60, n, replace=False))
        w = rng.integers(1, 5, n) * unit[own]
        sets.append((own.astype(np.uint64), w, w.sum() + rng.uniform(0, 2)))
    got = similarities(sets[:2], sets[2:], columns=7)
    assert np.allclose(got, [[similarity(a, b) for b in sets[2:]] for a in sets[:2]], atol=1e-12)
    assert np.allclose(similarities(sets, sets), [[similarity(a, b) for b in sets] for a in sets], atol=1e-12)


def family(rnd, size=400, odd=24):
    """A large family of near copies, and some that are alike enough to one member only."""
    base = [f"w{i}" for i in range(250)]
    texts = [" ".join([f"u{i % (size - 1)}", f"v{i % (size - 1)}", *base]) for i in range(size)]
    for i in range(odd):
        words = [f"u{i}", f"v{i}", *base[: 250 - rnd.randrange(12, 24)]]
        words[rnd.randrange(20, 200)] = f"x{i}"
        texts.append(" ".join(words))
    for i in range(150):  # edited at random
        words = list(base)
        for _ in range(rnd.randrange(1, 9)):
            words[rnd.randrange(250)] = f"e{rnd.randrange(12)}"
        texts.append(" ".join(words))
    return texts


def test_recall_in_a_large_family(spark):
    """Of the pairs at 0.8 or more, at least 99 % end in one class; no class joins what isn't linked."""
    texts = family(random.Random(11))
    want, pairs = brute_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert len(pairs) > 2000 and len(set(want)) > 10
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.99
    assert all(want[i] == want[g] for i, g in got.items())


def test_every_candidate_pair_is_linked(spark):
    """A pair that shares a bucket and reaches 0.8 is in one class, whatever else is in the bucket."""
    texts = family(random.Random(5), 300, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = weights_of(texts)
    rows = {r["least"]: r for r in weighted_nodes(docs).collect() if r["keys"] is not None}
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    met = 0
    for a in rows:
        for b in rows:
            if a < b and set(rows[a]["keys"]) & set(rows[b]["keys"]) and jaccard(sets[a], sets[b]) >= 0.8:
                met += 1
                assert got[a] == got[b]
    assert met > 1000 and band_keys(np.zeros((1, 64), np.float32)).shape == (1, 16)


def edited(rnd, size=60, others=340):
    """A text, copies with five words changed, and texts that are unlike."""
    base = [f"w{i}" for i in range(250)]
    texts = [" ".join(base)]
    for i in range(size):
        words = list(base)
        for at in range(5):
            words[50 * at + rnd.randrange(5, 40)] = f"e{i}x{at}"
        texts.append(" ".join(words))
    return texts + [" ".join(f"o{i}x{k}" for k in range(20)) for i in range(others)]


def test_a_large_group_of_copies_is_found_whole(spark, tmp_path, monkeypatch):
    """What copies share weighs the less the more there are; by counts they stay near. Also where all are left to the blocks."""
    texts = edited(random.Random(1))
    sets = weights_of(texts)
    assert max(jaccard(sets[0], s) for s in sets[1:61]) < 0.8 <= min(jaccard(grams(texts[0]), grams(t)) for t in texts[1:61])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = [0] * 61 + list(range(61, len(texts)))
    assert [r["class_id"] for r in op5_neardup(spark, str(tmp_path)).orderBy("doc_id").collect()] == want
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, sets, threshold: verified(pairs.limit(0), sets, threshold))
    monkeypatch.setattr(neardup, "BLOCK", 16)
    assert [r["class_id"] for r in op5_neardup(spark, str(tmp_path)).orderBy("doc_id").collect()] == want


def test_classes_by_either_weighting_equal_brute_force(spark):
    texts = corpus(random.Random(8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    one, counts = brute_classes(texts)[0], [grams(t) for t in texts]
    links = [(i, c) for i, c in enumerate(one)] + [(i, j) for i in range(len(texts)) for j in range(i) if counts[i] and counts[j] and jaccard(counts[i], counts[j]) >= 0.8]
    want = list(range(len(texts)))
    while (after := [min(want[j] for x in links if i in x for j in x) for i in range(len(texts))]) != want:
        want = after
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs, by_count=True).collect()}
    assert [got[i] for i in range(len(texts))] == want != one
