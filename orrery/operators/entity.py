"""Entity resolution: connected components of a graph of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import staged

#: Links that one task of a round handles.
LINKS_PER_TASK = 200_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars: each node with the least that it reaches by these links; LINKS_PER_TASK of them at a time."""
    leader: dict = {}

    def find(x):
        while (up := leader.setdefault(x, x)) != x:
            leader[x] = leader[up]
            x = leader[x]
        return x

    def stars(kind: pa.DataType) -> pa.RecordBatch:
        rows = [(x, y) for x in leader if (y := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for x, y in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = find(x), find(y)
            if x != y:
                leader[max(x, y)] = min(x, y)
        if len(leader) > LINKS_PER_TASK:
            yield stars(batch.column(0).type)
            leader.clear()
    if leader:
        yield stars(batch.column(0).type)


def _is_star(links: DataFrame) -> bool:
    """Whether every node has one link up, or is what others link to."""
    roles = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): each linked node with the least node of its component.

    Tasks first reduce their own links to stars. Then large-star and small-star
    rounds alternate: a node's larger neighbours are
    linked to its least neighbour, then its smaller ones are. Rounds grow with
    the logarithm of a component's size, not with its diameter. Each round
    groups with partial aggregation and joins the (skew-splittable) links back,
    so a node with very many links doesn't gather in one task. Tables of a
    round have as many tasks as the links need. Self links and null ends are
    ignored.
    """
    links = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = staged(links, "links")
    tasks = 4 + links.count() // LINKS_PER_TASK
    kind = dict(links.dtypes)["u"]
    links = staged(links.coalesce(tasks).mapInArrow(_local_stars, f"u {kind}, v {kind}").distinct().coalesce(tasks), "links")
    for _ in range(max_rounds):
        if _is_star(links):
            break
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "large-star")
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = staged(large.coalesce(tasks), "links")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "small-star")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        links = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
