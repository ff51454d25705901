"""Exact top-k inner products by multi-resolution segment statistics.

Each vector is cut into segments; a segment's mean and deviation bound its part
of an inner product from above (the product of the means plus, by
Cauchy-Schwarz, that of the deviations). The coarsest bound is taken for all
pairs of a query block and a candidate block at once. What it leaves is
narrowed: each finer bound is computed for the survivors of the one before, and
exact integer scores for those of the finest. A pair goes when its bound is
under the query's k-th best score so far.

Query vectors go out in blocks of bounded size, each against all candidates;
candidates stay where they are read. A query is in one block, so that each
block's ranking is final; per task and query only the best k rows are shuffled.

Defined results: rows whose id or vector is null, and vectors that hold a null
or non-finite component or have another length than most queries (of lengths
that are equally frequent, the greatest), take no part; ties of score go to the
smaller id; repeated ids are all candidates, except a query's own id, and as
queries each gets a ranking of its own; vectors of any length are taken whole;
columns besides the id and the vector are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import staged

#: Bytes of query vectors that go to the executors at once.
BLOCK_BYTES = 16 << 20
SPLITS = (1, 4, 16)


def segment_rows(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner product bounds that of the vectors: sqrt(n)*mean and sqrt(n)*deviation of each segment."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    cols = []
    for p in parts:
        s = x[:, p]
        n = len(p) ** 0.5
        mean = s.mean(1)
        cols += [n * mean, n * np.sqrt(np.maximum(0, (s * s).mean(1) - mean * mean))]
    return np.stack(cols, 1)


def quantised(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors take part, their floor(scale * x) as float64 rows)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    lengths = np.diff(vectors.offsets.to_numpy()) if n else np.zeros(0, int)
    valid = np.asarray(vectors.is_valid()) & (lengths == dim) if n else np.zeros(0, bool)
    out = np.full((n, dim), np.nan)
    start = vectors.offsets.to_numpy()[:-1][valid]
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out[valid] = flat[start[:, None] + np.arange(dim)] if len(start) else out[valid]
    ok = valid & np.isfinite(out).all(1)
    return ok, np.floor(out[ok] * scale)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Add pairs (query row, score, id)."""
        if not len(rows):
            return
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        keep = rank < self.k
        rows, scores, ids, rank = rows[keep], scores[keep], ids[keep], rank[keep]
        touched = np.unique(rows)
        at = np.searchsorted(touched, rows)
        s = np.full((len(touched), 2 * self.k), -np.inf)
        i = np.full((len(touched), 2 * self.k), np.iinfo(np.int64).max)
        s[:, : self.k], i[:, : self.k] = self.score[touched], self.id[touched]
        s[at, self.k + rank], i[at, self.k + rank] = scores, ids
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[touched] = np.take_along_axis(s, order, 1)
        self.id[touched] = np.take_along_axis(i, order, 1)


def search_block(best: Best, q: np.ndarray, q_ids: np.ndarray, q_levels: list[np.ndarray], x: np.ndarray, ids: np.ndarray) -> list[int]:
    """Search one block of candidates; returns how many pairs met each bound after the first, and exact scores."""
    levels = [segment_rows(x, segments) for segments in SPLITS]
    slack = lambda bound: bound + 1e-9 * np.abs(bound) + 1e-3  # noqa: E731  rounding of the bound itself
    coarse = slack(q_levels[0] @ levels[0].T)
    alive = (coarse >= best.score[:, -1:]) & (q_ids[:, None] != ids[None, :])
    order = np.argsort(-coarse, axis=1)  # each query's likeliest first, so that the others meet a higher score
    place, rows = np.nonzero(np.take_along_axis(alive, order, 1).T)
    cols = order[rows, place]
    met, at, size = [0] * len(SPLITS), 0, 2 * best.k * len(q)
    while at < len(rows):
        r, c = rows[at : at + size], cols[at : at + size]
        at, size = at + size, min(2 * size, 1 << 15)
        for i, (mine, theirs) in enumerate(zip(q_levels[1:], levels[1:])):
            met[i] += len(r)
            near = slack(np.einsum("ij,ij->i", mine[r], theirs[c])) >= best.score[r, -1]
            r, c = r[near], c[near]
        met[-1] += len(r)
        scores = np.einsum("ij,ij->i", q[r], x[c])
        kept = scores >= best.score[r, -1]
        best.merge(r[kept], scores[kept], ids[c[kept]])
    return met


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The ``k`` rows of ``vectors`` of the highest integer inner product with each query.

    Columns: query_id, rank (from 1), vec_id, score.
    """
    usable = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(vec_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    picked = vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    queries = queries.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    spark = vectors.sparkSession
    most = queries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = most["dim"]
    queries = queries.filter(F.size("v") == dim)
    blocks = -(-most["n"] // max(1, BLOCK_BYTES // (8 * max(1, dim))))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def ranked(b: int) -> DataFrame:
        rows = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b)).toArrow()
        _, q = quantised(rows.column("v"), dim, scale)
        sent = spark.sparkContext.broadcast((rows.column("id").to_numpy(), q))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            best, levels = Best(len(q), k), [segment_rows(q, s) for s in SPLITS]
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ok, x = quantised(part.column(1), dim, scale)
                    ids = part.column(0).to_numpy()[ok]
                    for lo in range(0, len(q) if len(x) else 0, 512):
                        hi = lo + 512
                        view = Best.__new__(Best)
                        view.k, view.score, view.id = k, best.score[lo:hi], best.id[lo:hi]
                        search_block(view, q[lo:hi], q_ids[lo:hi], [x_[lo:hi] for x_ in levels], x, ids)
            r, c = np.nonzero(np.isfinite(best.score))
            for at in range(0, len(r), 50_000):
                i, j = r[at : at + 50_000], c[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(q_ids[i]), pa.array(best.id[i, j]), pa.array(best.score[i, j].astype(np.int64))], ["query", "query_id", "vec_id", "score"])

        found = picked.mapInArrow(search, "query long, query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    if blocks == 1:
        return ranked(0)
    return reduce(DataFrame.unionByName, [staged(ranked(b), "topk") for b in range(blocks)])
