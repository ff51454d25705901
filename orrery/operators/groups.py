"""Runs whose members share something, and peaks that keep their distance: rules that look back at what was met, as rounds of joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.entity import connected_components
from orrery.session import staged


def before_in_buckets(df: DataFrame, keys: list[str], at: str, place: Column, width: float, *, span: tuple[float, float] | None = None) -> DataFrame:
    """Each row with the ``place`` (a struct that begins with the time) of the row before it in its key, as ``before``.

    Windows span a bucket of time, and a bucket's first row takes the last place
    of the buckets before, so a key of very many rows is spread over tasks. Where
    ``span``, the first and last time of all rows, is given and no wider than a
    bucket, there is nothing to take over.
    """
    if span and span[1] - span[0] <= width:
        return df.withColumn("_place", place).withColumn("before", F.lag("_place").over(Window.partitionBy(*keys).orderBy("_place"))).drop("_place")
    rows = df.withColumns({"_bucket": F.floor(F.col(at) / width), "_place": place})
    ends = rows.groupBy(*keys, "_bucket").agg(F.max("_place").alias("_last"))
    ends = ends.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    own = F.lag("_place").over(Window.partitionBy(*keys, "_bucket").orderBy("_place"))
    return rows.join(ends, [*keys, "_bucket"]).withColumn("before", F.coalesce(own, "_carried")).drop("_bucket", "_place", "_carried")


def set_runs(hits: DataFrame, keys: list[str], at: str, items: str, id_col: str, gap: float, *, width: float | None = None, name: str = "run", max_rounds: int = 100) -> DataFrame:
    """``hits`` with the run that each belongs to, named by the least id of its hits.

    Taken in order of time, a hit joins the open runs of its key that hold any of
    its items, all of them becoming one run with the items of all; a run that
    has had no hit for longer than ``gap`` is closed. So a run may take up a hit
    by an item that it met long ago, as long as other items kept it open.

    The order of time is not walked through. Where two hits with an item between
    which it doesn't occur are at most ``gap`` apart, they are of one run. Runs
    are then the components of those links, each open up to ``gap`` after its last
    hit; of the other pairs, those whose later hit comes while the earlier one's
    run is open join two runs, which may keep them open for more, and so on until
    nothing changes. Rounds handle runs and pairs left, not hits.

    ``id_col`` is unique. Hits without a time or key, and without items, are runs
    of their own; null items join nothing. ``width`` is the span of time that
    one task orders at a time. The hits are worked out once; only what is paired
    is followed up.
    """
    hits = staged(hits, "hits")
    width = width or 16 * gap
    first, final = hits.dropna(subset=keys).agg(F.min(at), F.max(at)).first()
    seen = hits.dropna(subset=[*keys, at]).select(*keys, F.col(at).alias("_at"), F.col(id_col).alias("_id"), F.explode(F.array_distinct(items)).alias("_item")).dropna(subset=["_item"])
    pairs = before_in_buckets(seen, [*keys, "_item"], "_at", F.struct("_at", "_id"), width, span=None if first is None else (first, final)).dropna(subset=["before"])
    pairs = staged(pairs.select(F.col("before._id").alias("a"), F.col("_id").alias("b"), (F.col("_at") - F.col("before._at")).alias("apart"), F.col("before._at").alias("s"), F.col("_at").alias("t")), "run-pairs")
    run_of = staged(connected_components(pairs.filter(F.col("apart") <= gap)).select(F.col("node").alias("_id"), F.col("component").alias("_run")), "runs")
    # a hit without a pair is a run that nothing joins
    own = pairs.select(F.col("a").alias("_id"), F.col("s").alias("_at")).unionByName(pairs.select(F.col("b").alias("_id"), F.col("t").alias("_at"))).distinct().join(run_of, "_id", "left").withColumn("_run", F.coalesce("_run", "_id"))
    last = staged(own.groupBy("_run").agg(F.max("_at").alias("last")), "run-ends")

    def renamed(df: DataFrame, column: str, new: DataFrame) -> DataFrame:
        """The column's ids by the names that the table ``new`` (_id, _run) gives them."""
        found = df.join(new.select(F.col("_id").alias(column), F.col("_run").alias("_new")), column, "left")
        return found.withColumn(column, F.coalesce("_new", column)).drop("_new")

    left = pairs.filter(F.col("apart") > gap).select("a", "b", "t")
    new = run_of
    for _ in range(max_rounds):
        left = staged(renamed(renamed(left, "a", new), "b", new).filter("a <> b").distinct(), "run-pairs")
        met = left.join(last.withColumnRenamed("_run", "a"), "a").filter(F.col("t") - F.col("last") <= gap).select("a", "b")
        met = staged(met, "run-links")
        if met.isEmpty():
            break
        new = staged(connected_components(met).select(F.col("node").alias("_id"), F.col("component").alias("_run")), "runs")
        last = staged(renamed(last, "_run", new).groupBy("_run").agg(F.max("last").alias("last")), "run-ends")
        again = renamed(run_of, "_run", new)
        # runs of one hit have no row in run_of until they are joined
        run_of = staged(again.unionByName(new.join(run_of, "_id", "left_anti")), "runs")
    else:
        raise RuntimeError(f"runs did not settle in {max_rounds} rounds")
    named = run_of.select(F.col("_id").alias("_key"), F.col("_run").alias(name))
    return hits.drop(name).join(named, hits[id_col] == named["_key"], "left").drop("_key").withColumn(name, F.coalesce(name, id_col))


def separated_peaks(peaks: DataFrame, keys: list[str], at: str, height: str, apart: float, *, width: float | None = None, max_rounds: int = 1000) -> DataFrame:
    """The ``peaks`` that stay when, from the highest down, each removes those nearer than ``apart`` to it.

    Of equal heights the earlier goes first; ``at`` is unique in its key. A peak
    is settled once all higher ones in reach are, so stretches of ``width`` are
    settled side by side, each with the peaks in reach of its ends; what depends
    on a peak that another stretch has not settled yet waits for the next round.
    Rounds grow with the longest chain of stretches that wait for one another,
    and each takes the unsettled peaks, and the kept ones in their reach, only.
    Peaks with a null key, place or height are left out.
    """
    width = max(width or 64 * apart, apart)
    rows = peaks.dropna(subset=[*keys, at, height]).select(*keys, F.col(at).cast("double").alias("_at"), F.col(height).cast("double").alias("_height"), F.lit(0).alias("_state"))
    home = F.floor(F.col("_at") / width)
    # a peak near an end of its stretch is shown to the stretch beyond as well
    shown = F.array_distinct(F.array(home, F.floor((F.col("_at") - apart) / width), F.floor((F.col("_at") + apart) / width)))

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at", ignore_index=True)
        place, level, state, own = part["_at"].to_numpy(), part["_height"].to_numpy(), part["_state"].to_numpy().copy(), part["_own"].to_numpy()
        order = np.lexsort((place, -level))
        rank = np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        lo, hi = np.searchsorted(place, place - apart, "right"), np.searchsorted(place, place + apart, "left")
        for i in order:
            if state[i]:
                continue
            near = slice(lo[i], max(hi[i], i + 1))
            if (state[near] == 1).any():
                state[i] = 2
            elif own[i] and not ((state[near] == 0) & (rank[near] < rank[i])).any():
                state[i] = 1
        part["_state"] = state
        return part[part["_own"]].drop(columns=["_own", "_stretch"])

    kept, left = None, staged(rows, "peaks")
    for _ in range(max_rounds):
        spread = left.select("*", F.explode(shown).alias("_stretch")).withColumn("_own", F.col("_stretch") == home)
        done = staged(spread.groupBy(*keys, "_stretch").applyInPandas(settle, left.schema), "peaks")
        found = done.filter("_state = 1").select(*keys, "_at")
        kept = found if kept is None else kept.unionByName(found)
        open_ = done.filter("_state = 0")
        if open_.isEmpty():
            break
        # a kept peak still removes unsettled ones beyond its stretch, once
        left = staged(done.filter("_state < 2"), "peaks")
        settled_near = left.filter("_state = 1").select(*keys, "_at").withColumn("_w", F.explode(F.array(home - 1, home, home + 1)))
        waiting = left.filter("_state = 0").select(*keys, home.alias("_w")).distinct()
        useful = settled_near.join(waiting, [*keys, "_w"], "left_semi").select(*keys, "_at").distinct()
        again = left.filter("_state = 1").join(useful, [*keys, "_at"], "left_semi")
        left = staged(left.filter("_state = 0").unionByName(again), "peaks")
        kept = staged(kept, "peaks-kept")
    else:
        raise RuntimeError(f"peaks did not settle in {max_rounds} rounds")
    return peaks.withColumn("_at", F.col(at).cast("double")).join(kept.distinct(), [*keys, "_at"], "left_semi").drop("_at")
