import random

from pyspark.sql import functions as F

from orrery.operators.groups import before_in_buckets, separated_peaks, set_runs


def plain_runs(hits, gap):
    """Hits of one key in order of time, with the list of open runs."""
    open_, done = [], []
    for day, hit, items in sorted(hits, key=lambda h: h[:2]):
        items = {i for i in items or () if i is not None}
        met = [r for r in open_ if day - r["last"] <= gap and r["items"] & items]
        done += [r for r in open_ if day - r["last"] > gap]
        open_ = [r for r in open_ if day - r["last"] <= gap and r not in met]
        open_.append({"last": day, "items": set.union(items, *(r["items"] for r in met)), "ids": [hit, *(i for r in met for i in r["ids"])]})
    return {i: min(r["ids"]) for r in open_ + done for i in r["ids"]}


def runs_of(spark, rows, gap, **more):
    hits = spark.createDataFrame(rows, "id long, key string, day long, items array<string>, run int, a string")
    return {r["id"]: r["run"] for r in set_runs(hits, ["key"], "day", "items", "id", gap, **more).collect()}


def test_runs_equal_a_walk_in_time(spark):
    rnd, rows = random.Random(4), []
    for key, (n, kinds, gap_between) in enumerate([(200, 4, 3), (200, 30, 2), (150, 12, 6), (100, 300, 1), (120, 8, 0), (60, 2, 12)]):
        day = 0
        for _ in range(n):
            day += rnd.randrange(2 * gap_between + 1)
            rows.append((len(rows) * 7919 % 100_003, f"k{key}", day, [f"i{rnd.randrange(kinds)}" for _ in range(rnd.randrange(4))], 0, "x"))
    want = {}
    for key in {r[1] for r in rows}:
        want |= plain_runs([(r[2], r[0], r[3]) for r in rows if r[1] == key], 10)
    got = runs_of(spark, rows, 10, width=25)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert got == want and 50 < len(set(want.values())) < 0.8 * len(want)


def test_an_item_of_long_ago_joins_while_others_keep_the_run_open(spark):
    # b is met again 30 days on, in a run that a has kept open; c comes when its run is closed
    rows = [(9, "k", 0, ["a", "b"], 0, ""), (8, "k", 10, ["a"], 0, ""), (7, "k", 20, ["a"], 0, ""), (6, "k", 30, ["b", "c"], 0, ""), (5, "k", 41, ["c"], 0, ""), (4, "k", 41, [], 0, ""), (3, "k", 30, None, 0, ""), (2, "k", None, ["a"], 0, ""), (1, None, 20, ["a"], 0, ""), (0, "k", 41, [None], 0, "")]
    assert runs_of(spark, rows, 10) == {9: 6, 8: 6, 7: 6, 6: 6, 5: 5, 4: 4, 3: 3, 2: 2, 1: 1, 0: 0}
    assert runs_of(spark, [], 10) == {}


def test_one_key_with_a_run_over_many_buckets(spark):
    """A run that is kept open throughout, and pairs far apart in it that join one after another."""
    rows = [(i, "hot", i, [f"chain{i // 2}", f"chain{(i + 1) // 2}"], 0, "") for i in range(1500)]
    rows += [(5000 + i, "hot", i * 60, [f"rare{i // 2}"], 0, "") for i in range(25)]
    rows += [(6000, "hot", 5, ["x", "chain1"], 0, ""), (6001, "hot", 1400, ["x"], 0, ""), (6002, "hot", 1405, ["y"], 0, ""), (6003, "hot", 1409, ["y", "x"], 0, "")]
    assert runs_of(spark, rows, 3, width=40) == plain_runs([(r[2], r[0], r[3]) for r in rows], 3)


def test_before_across_buckets(spark):
    rows = [("k", 1), ("k", 2), ("k", 35), ("k", 95), ("k", 96), ("j", 50), ("k", 2)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "key string, t long, i long")
    got = {r["i"]: r["before"] and r["before"]["i"] for r in before_in_buckets(df, ["key"], "t", F.struct("t", "i"), 10).collect()}
    assert got == {0: None, 1: 0, 6: 1, 2: 6, 3: 2, 4: 3, 5: None}


def test_before_in_one_bucket_needs_no_carrying(spark):
    rows = [("k", 1), ("k", 2), ("k", 35), ("k", 95), ("k", 96), ("j", 50), ("k", 2)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "key string, t long, i long")
    both = []
    for span in ((1, 96), (1, 102)):
        found = before_in_buckets(df, ["key"], "t", F.struct("t", "i"), 100, span=span)
        both.append((found._jdf.queryExecution().optimizedPlan().toString().count("Join"), {r["i"]: r["before"] and r["before"]["i"] for r in found.collect()}))
    assert both == [(n, {0: None, 1: 0, 6: 1, 2: 6, 3: 2, 4: 3, 5: None}) for n in (0, 1)]


def plain_peaks(peaks, apart):
    kept = []
    for t, v in sorted(peaks, key=lambda p: (-p[1], p[0])):
        if all(abs(t - s) >= apart for s, _ in kept):
            kept.append((t, v))
    return set(kept)


def test_peaks_equal_the_sequential_rule(spark):
    rnd, rows = random.Random(3), []
    rows += [("noise", float(t), rnd.choice([rnd.random(), 0.5])) for t in rnd.sample(range(4000), 700)]
    rows += [("ramp", float(t), float(t)) for t in range(240)]  # every peak waits for the one after it
    rows += [("flat", float(t), 1.0) for t in range(0, 300, 2)] + [("one", 5.0, 1.0)]
    odd = [("one", None, 1.0), ("one", 3.0, None), (None, 3.0, 9.0)]
    df = spark.createDataFrame(rows + odd, "star string, t double, v double")
    for width in (None, 40.0):
        got = {}
        for r in separated_peaks(df, ["star"], "t", "v", 12.0, width=width or 100.0).collect():
            got.setdefault(r["star"], set()).add((r["t"], r["v"]))
        want = {k: plain_peaks([r[1:] for r in rows if r[0] == k], 12.0) for k in ("noise", "ramp", "flat", "one")}
        assert got == want
    assert separated_peaks(df.limit(0), ["star"], "t", "v", 12.0).count() == 0
