import math
import random

import numpy as np
import pytest

from orrery.llm.quality import STATISTICS, Trees, fit_quality, grow_trees, score_quality, statistics
from orrery.llm.queries import op8_quality, op10_toxicity
from orrery.llm.toxicity import Offence, fit_noisy_or, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def area(score, y):
    """Area under the ROC curve."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query, label, least", [(op8_quality, "quality", 0.95), (op10_toxicity, "toxic", 0.7)])
def test_held_out(spark, query, label, least):
    rows = {r["doc_id"]: r for r in query(spark, SF).collect()}
    labels = [(r["doc_id"], r[label]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r[label] is not None]
    held = [(rows[i]["score"], y) for i, y in labels if i in rows and rows[i]["held_out"]]
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert area(np.array([s for s, _ in held]), np.array([y for _, y in held])) >= least
    cut = 0.3 if label == "quality" else 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in rows.values())


def odd_docs(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 40_000, "c"), (4, "plain text here. fine.", "d"), (4, "plain text here. fine.", "d"), (None, "x", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.mark.parametrize("fit, score, none", [(fit_quality, score_quality, 0.5), (fit_toxicity, score_toxicity, 0.0)])
def test_odd_rows(spark, fit, score, none):
    """Nulls, empty and long texts, repeated rows, clashing columns; no labels, labels of one kind, null labels, repeated labels."""
    docs = odd_docs(spark)
    kinds = "doc_id long, quality int, toxic int"
    for labels in ([], [(4, 1, 1)] * 3, [(4, None, None)], [(1, 0, 0), (2, 1, 1), (4, 0, 0), (99, 1, 1)]):
        model = fit(docs, spark.createDataFrame(labels, kinds))
        rows = score(docs, model).collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
        if not labels:
            assert {r["score"] for r in rows} == {none}
        assert score(docs.limit(0), model).count() == 0
    assert fit(docs.limit(0), spark.createDataFrame([(4, 1, 1)], kinds)) is not None


def test_labels_outside_the_sample_do_not_count(spark):
    """Held-out labels, turned round, leave the model as it is."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = fit_quality(docs, labels), fit_quality(docs, other)
    assert (a.value == b.value).all() and (a.threshold == b.threshold).all() and a.base == b.base


def test_trees_walk_as_loops_do():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    model = grow_trees(x, y, trees=20, depth=3)
    for row, got in zip(x[:50], model.score(x[:50])):
        total = model.base
        for t in range(20):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.value[t, node - 7]
        assert abs(got - 1 / (1 + math.exp(-total))) < 1e-12
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert isinstance(model, Trees) and len(statistics("")) == len(statistics("one two. two")) == len(STATISTICS)


def test_noisy_or_finds_the_offending_word():
    """Documents are toxic by one sentence; its word gets the weight, company it keeps does not."""
    rnd = random.Random(4)
    bags, y = [], []
    for i in range(300):
        bad = i % 3 == 0
        bags.append([[rnd.randrange(1, 6)] for _ in range(4)] + ([[0, rnd.randrange(1, 6)]] if bad else []))
        y.append(float(bad))
    w = fit_noisy_or(bags, np.array(y), 6)
    assert w[0] > 3 and w[1:].max() < w[0] / 2
    model = Offence({"bad": 8.0}, -4.0)
    found = model.sentences("Fine words. A bad word! More.")
    assert [(a, b) for a, b, _ in found] == [(11, 23)] and abs(found[0][2] - 1 / (1 + math.exp(-4))) < 1e-12


def test_score_is_the_noisy_or_of_its_sentences(spark):
    docs = spark.createDataFrame([(1, "bad one. worse bad. fine.")], "doc_id long, text string")
    row = score_toxicity(docs, Offence({"bad": 3.0, "wor": 2.0}, -4.0)).first()
    p = [1 / (1 + math.exp(4 - 3)), 1 / (1 + math.exp(4 - 5))]
    assert abs(row["score"] - (1 - (1 - p[0]) * (1 - p[1]))) < 1e-12 and len(row["offences"]) == 2
