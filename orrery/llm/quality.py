"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the documents are read. Trees are grown on a
bounded sample of labelled rows (``max_rows``), level by level from histograms
of gradients over quantile bins, and laid out as flat arrays (complete binary
trees), which numpy walks for all rows and trees of a batch at once.

Defined results: null and empty texts have all statistics 0 and get the score
that the trees give them; with no usable labels every score is 0.5, with labels
of one kind only the (smoothed) share of that kind; repeated rows are scored
each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.labelled import held_out, labelled_sample

STATISTICS = [
    "log_bytes", "letters", "upper", "digits", "spaces", "symbols", "points", "bars", "bangs", "high_bytes", "word_length", "long_words", "distinct_words",
    "commonest_word", "repeats", "capital_words", "sentence_words", "line_words", "distinct_lines", "byte_entropy", "symbol_words",
]
_stop = re.compile(r"[.!?]+(?:\s|$)")


def _byte_classes() -> np.ndarray:
    table = np.zeros((256, 9))
    for b in range(256):
        c = chr(b)
        hit = [b < 128 and c.isalpha(), b < 128 and c.isupper(), c.isdigit() and b < 128, b in b" \t\r\n\v\f", b < 128 and not c.isalnum() and not c.isspace() and c not in ".,;:'\"!?()-", c in ".,;:", c == "|", c == "!", b >= 128]
        table[b] = hit
    return table


BYTE_CLASSES = _byte_classes()


def statistics(text: str) -> list[float]:
    """The document statistics of one text."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    words = text.split()
    m = len(words) or 1
    often = Counter(words)
    lines = [x for x in text.split("\n") if x]
    joined = "".join(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        float(np.log1p(n)), *(counts @ BYTE_CLASSES / n).tolist(), len(joined) / m, sum(len(w) > 12 for w in often) / len(often or "x"), len(often) / m,
        max(often.values(), default=0) / m, repeats / m, sum(w.isupper() for w in words) / m, m / max(1, len(_stop.findall(text))), m / max(1, len(lines)), len(set(lines)) / max(1, len(lines)),
        float(-(p * np.log2(p)).sum()), sum(not w[-1].isalnum() for w in words) / m,
    ]


@dataclass
class Trees:
    """Complete binary trees as flat arrays, one row per tree."""

    feature: np.ndarray  # of the inner nodes
    threshold: np.ndarray
    value: np.ndarray  # of the leaves
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; every level of all trees is one step."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        leaf = self.value[trees, node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-(self.base + leaf.sum(1))))


def grow_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Gradient-boosted trees for the logistic loss, from histograms."""
    none = Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), 0.0, depth)
    if not len(y):
        return none
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    none.base = base
    if y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)], 1)
    inner, f = (1 << depth) - 1, x.shape[1]
    feature, threshold, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            gain_best, best = np.full(width, 1e-6), np.zeros((width, 2), int) - 1
            for j in range(f):
                key = (node - first) * bins + binned[:, j]
                gl = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hl = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > gain_best
                gain_best[better] = top[better]
                best[better] = np.stack([np.full(width, j), at], 1)[better]
            right = np.zeros(len(y), np.int64)
            for w in range(width):
                j, at = best[w]
                if j >= 0:
                    feature[t, first + w], threshold[t, first + w] = j, cuts[j][at]
                    own = node == first + w
                    right[own] = binned[own, j] > at
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[t] = -rate * gs / (hs + ridge)
        margin += value[t][leaf]
    return Trees(feature, threshold, value, base, depth)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **settings) -> Trees:
    """Trees grown on at most ``max_rows`` labelled rows (see ``labelled_sample``)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = labelled_sample(docs, labels, label, max_rows, id_col=id_col, text_col=text_col).mapInArrow(measure, "x array<double>, y int").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the same trees whatever order the rows came in
    return grow_trees(x[order], y[order], **settings)


def score_quality(docs: DataFrame, model: Trees, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    at = kept.index(text_col)
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.array([statistics(t or "") for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x))], [*kept, "score"])

    out = docs.select(*kept).mapInArrow(score, f"{fields}, score double")
    return out.withColumns({"held_out": F.coalesce(held_out(F.col(id_col)), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
