"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is offensive with a probability
given by a logistic model of its words' stems (their first letters, see
``LENGTHS``), each counted as often as it stands there; the document's score is
the noisy-or of its sentences, 1 - prod(1 - p). Only documents have labels: the
weights are fit to them through the noisy-or, which then tells the offending
sentences apart.

Stems that may weigh are those that the labelled sample (at most ``max_rows``
documents) shows significantly more often in toxic documents; they are counted
by a Spark aggregation. Weights are never negative, so an innocent sentence
can't hide an offending one. A constant rate of wrong labels is fit along, so
that unexplained labels don't raise every sentence.

Defined results: null and empty texts have no sentences and score 0; without
labels of both kinds every score is 0; repeated rows are scored each on its
own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.labelled import held_out, labelled_sample

#: Letters of a word's stems; a shorter word is its own stem.
LENGTHS = (3, 4, 5)
_word = re.compile(r"[^\W\d_]+")
_sentence = re.compile(r"[^.!?\n]+[.!?]*")


@dataclass
class Offence:
    """Weights of stems, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold a weighted stem."""
        out = []
        for m, hits in hit_sentences(text, self.weights):
            out.append((m.start(), m.end(), 1 / (1 + math.exp(-self.bias - sum(self.weights[w] for w in hits)))))
        return out


def stems(word: str) -> set[str]:
    return {word[:n] for n in LENGTHS}


def text_stems(text: str) -> set[str]:
    return {s for w in {w[: max(LENGTHS)] for w in _word.findall(text.lower())} for s in stems(w)}


def hit_sentences(text: str, known: dict) -> Iterator[tuple[re.Match, list[str]]]:
    """The sentences that hold known stems, and those, as often as they stand there."""
    own = {w[: max(LENGTHS)] for w in _word.findall(text.lower())}
    if not any(s in known for w in own for s in stems(w)):
        return
    for m in _sentence.finditer(text):
        hits = [s for w in _word.findall(m[0].lower()) for s in sorted(stems(w)) if s in known]
        if hits:
            yield m, hits


def fit_noisy_or(bags: list[list[list[int]]], y: np.ndarray, n_stems: int, steps: int = 400, penalty: float = 0.3, bias: float = -4.0) -> np.ndarray:
    """Weights of stems (never negative) from bags of sentences of stem numbers.

    Maximises the likelihood of 1 - (1 - noise) * prod(1 - p) by Adam steps,
    with an L1 penalty on the weights.
    """
    sent = [(b, s) for b, bag in enumerate(bags) for s in bag]
    of_bag = np.array([b for b, _ in sent], np.int64)
    row = np.repeat(np.arange(len(sent)), [len(s) for _, s in sent])
    col = np.array([w for _, s in sent for w in s], np.int64)
    w, noise = np.full(n_stems, 1.0), -4.0
    m, v = np.zeros(n_stems + 1), np.zeros(n_stems + 1)
    n = max(1, len(y))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-bias - np.bincount(row, w[col], len(sent))))
        q = 1 / (1 + np.exp(-noise))
        log_none = np.log1p(-q) + np.bincount(of_bag, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
        none = np.exp(log_none)
        # of the loss by log_none; log_none falls by p for each unit of a stem's weight
        slope = np.where(y > 0, none / np.maximum(1 - none, 1e-6), -1.0)
        grad = np.r_[np.bincount(col, (slope[of_bag] * -p)[row], n_stems), (slope * -q).sum()] / n
        grad[:n_stems] += penalty / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, noise = np.maximum(0, w - move[:n_stems]), noise - move[n_stems]
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", max_rows: int = 20_000, max_stems: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> Offence:
    """Fit on at most ``max_rows`` labelled documents and ``max_stems`` stems."""
    sample = labelled_sample(docs, labels, label, max_rows, id_col=id_col, text_col=text_col)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(text_stems(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), batch.column(1)], ["stems", "y"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Offence({}, 0.0)
    counted = sample.mapInArrow(bag, "stems array<string>, y int").select(F.explode("stems").alias("stem"), "y").groupBy("stem").agg(F.sum(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    # the likelihood ratio of the stem's share of toxic documents against the whole's
    rate = pos / (pos + neg)
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    part = lambda a, expected: F.when(a > 0, a * F.log(a / expected)).otherwise(0.0)
    ratio = 2 * (part(k, n * rate) + part(n - k, n * (1 - rate)))
    listed = counted.filter((F.col("k") >= 3) & (k > n * rate * 2)).withColumn("g", ratio).filter("g > 10.8").orderBy(F.desc("g"), "stem").limit(max_stems)
    vocab = {r["stem"]: i for i, r in enumerate(listed.select("stem").collect())}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for t in batch.column(0).to_pylist():
                bags.append([[vocab[s] for s in hits] for _, hits in hit_sentences(t, vocab)])
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.list_(pa.list_(pa.int32()))), batch.column(1)], ["bag", "y"])

    rows = sorted((r["bag"], r["y"]) for r in sample.mapInArrow(split, "bag array<array<int>>, y int").toArrow().to_pylist())
    bias = -4.0
    w = fit_noisy_or([b for b, _ in rows], np.array([y for _, y in rows], float), len(vocab), bias=bias)
    return Offence({stem: float(w[i]) for stem, i in vocab.items() if w[i] > 0.05}, bias)


def score_toxicity(docs: DataFrame, model: Offence, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted, offences.

    offences: (start, end, score) of the sentences that hold weighted stems, in
    code points. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "offences")]
    at = kept.index(text_col)
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [model.sentences(t or "") for t in part.column(at).to_pylist()]
                total = [1 - math.prod(1 - p for _, _, p in own) for own in found]
                spans = [[{"start": a, "end": b, "score": p} for a, b, p in own] for own in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total, pa.float64()), pa.array(spans, kind)], [*kept, "score", "offences"])

    out = docs.select(*kept).mapInArrow(score, f"{fields}, score double, offences array<struct<start:int,end:int,score:double>>")
    return out.withColumns({"held_out": F.coalesce(held_out(F.col(id_col)), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
