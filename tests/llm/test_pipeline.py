"""The stages of the pipeline, each against what its operator or a plain loop says."""

from collections import Counter

import corpus_pipeline
from orrery.llm.quality import fit_quality, score_quality
from orrery.llm.toxicity import fit_toxicity, score_toxicity
from orrery.session import staged
from tests.llm.test_neardup import brute_classes
from tests.llm.test_repeats import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    docs = docs.selectExpr("*", "doc_id as found", "'mine' as removed", "'mine' as score").unionByName(docs.selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars", "doc_id as found", "'mine' as removed", "'mine' as score").limit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality classifier", "MinHash near-dedup", "substring dedup", "best-fit packing"]
    before = staged(docs, "test")
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, before, SF), "test")
        rows, kept = before.collect(), after.collect()
        if name == "toxicity":
            want = score_toxicity(before, fit_toxicity(before, labels)).filter("predicted = 0").count()
            assert len(kept) == want
        elif name == "quality classifier":
            want = score_quality(before, fit_quality(before, labels)).filter("predicted = 1").count()
            assert len(kept) == want
        elif name == "MinHash near-dedup":
            classes, _ = brute_classes([r["text"] for r in rows])
            assert len(kept) == len(set(classes))
            class_of = {r["doc_id"]: c for r, c in zip(rows, classes)}
            assert Counter(class_of[r["doc_id"]] for r in kept).most_common(1)[0][1] == 1
        elif name == "substring dedup":
            words = brute([(r["text"] or "").encode().split() for r in rows], 35)
            want = {r["doc_id"]: b" ".join(w).decode() for r, w in zip(rows, words)}
            assert {r["doc_id"]: r["text"] for r in kept} == want
            assert all(r["removed"] == "mine" and r["n_chars"] == len(r["text"]) for r in kept)
        else:
            ends = Counter()
            for r in sorted(kept, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == ends[r["sequence_id"]]
                ends[r["sequence_id"]] += r["length"]
            assert max(ends.values()) <= 2048 and {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows}
        if name != "best-fit packing":
            assert after.columns == docs.columns and all(r["score"] == "mine" for r in kept)
        before = after


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
