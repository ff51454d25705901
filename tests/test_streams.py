import datetime

import pyarrow.parquet as pq

from orrery.plans import streams

SF = "/root/testdata/sf0.001"


def events():
    rows = pq.ParquetFile(f"{SF}/events.parquet").read().to_pylist()
    by = {}
    for r in rows:
        by.setdefault(r["user_id"], []).append((r["ts"].replace(tzinfo=datetime.UTC).timestamp(), r["value"]))
    return {k: sorted(v) for k, v in by.items()}


def test_debounced(spark):
    want = []
    for user, rows in events().items():
        first = None
        for t, _ in rows:
            if first is not None and t > min(last + 6 * 3600, first + 24 * 3600):  # noqa: F821
                want.append((user, round(first, 3), round(min(last + 6 * 3600, first + 24 * 3600), 3), n))  # noqa: F821
                first = None
            if first is None:
                first, n = t, 0
            last, n = t, n + 1
        want.append((user, round(first, 3), round(min(last + 6 * 3600, first + 24 * 3600), 3), n))
    got = streams.stream_debounced(spark, SF).collect()
    assert sorted((r["user_id"], round(r["first"], 3), round(r["due"], 3), r["kicks"]) for r in got) == sorted(want)


def test_watches(spark):
    want = []
    for user, rows in events().items():
        opened, low, seen = False, 0, 0
        for t, v in rows:
            t /= 86400
            if opened and t - seen > 2:
                want.append((user, "timeout"))
                opened, low = False, 0
            if opened:
                low = low + 1 if v < 30 else 0
                if low >= 2:
                    want.append((user, "faded"))
                    opened, low = False, 0
            elif v >= 80:
                want.append((user, "rose"))
                opened, low = True, 0
            seen = t
        if opened:
            want.append((user, "timeout"))
    got = streams.stream_watches(spark, SF).collect()
    assert want and sorted((r["user_id"], r["reason"]) for r in got) == sorted(want)


def test_stream_equals_batch_with_many_files(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet")
    df.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    rows = lambda d: sorted(tuple(r) for r in streams.stream_tumbling(spark, d).collect())
    assert rows(str(tmp_path)) == rows(SF)


def test_every_kick_is_in_a_run(spark):
    """The last run of a user comes out as well."""
    rows = streams.stream_debounced(spark, SF).collect()
    by = events()
    for user, own in by.items():
        runs = sorted((r["first"], r["due"], r["kicks"]) for r in rows if r["user_id"] == user)
        assert sum(n for _, _, n in runs) == len(own)
        for first, due, n in runs:
            inside = [t for t, _ in own if first <= t <= due]
            assert len(inside) == n and inside[0] == first and abs(due - min(inside[-1] + 6 * 3600, first + 24 * 3600)) < 1e-3
    assert {r["user_id"] for r in rows} == set(by)


def test_every_watch_ends(spark):
    """A watch that no later value ends is ended by its timeout."""
    rows = streams.stream_watches(spark, SF).collect()
    last = {k: v[-1][0] for k, v in events().items()}
    open_ = 0
    for user in last:
        own = sorted((r["at"], r["state"], r["reason"]) for r in rows if r["user_id"] == user)
        assert sum(r[1] == "watching" for r in own) == sum(r[1] == "ended" for r in own)
        if own and own[-1][0] > last[user]:
            assert own[-1][1:] == ("ended", "timeout") and abs(own[-1][0] - last[user] - 172_800) < 1e-6
            open_ += 1
    assert open_


def test_a_running_stream_emits_what_is_due(spark, tmp_path):
    """Timers: a run comes out when the watermark is past it, without another kick of its key; a late row doesn't change it."""
    import time

    from orrery.streaming import jobs

    def put(name, rows):
        spark.createDataFrame(rows, "key string, at double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put("a", [("x", 1000.0), ("x", 1010.0), ("y", 1005.0)])
    stream = spark.readStream.schema("key string, at double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.debounced(stream, "key", "at", 60, 600, late="10 seconds").writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        put("b", [("z", 5000.0)])
        q.processAllAvailable()
        for _ in range(40):
            got = sorted((r["key"], r["first"], r["due"], r["kicks"]) for r in spark.table("runs").collect())
            if len(got) >= 2:
                break
            time.sleep(0.5)
        put("c", [("y", 1020.0)])
        q.processAllAvailable()
        assert got == sorted((r["key"], r["first"], r["due"], r["kicks"]) for r in spark.table("runs").collect()) == [("x", 1000.0, 1070.0, 2), ("y", 1005.0, 1065.0, 1)]
    finally:
        q.stop()
