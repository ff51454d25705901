import random

import pytest
from pyspark.sql import functions as F

from orrery.streaming.delivery import AlertOutbox, EventRing, SendFailed, live_bins, live_curve
from orrery.streaming.jobs import each_batch, run_once

SCHEMA = "topic string, id long, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_batches_gives_the_batch_result(spark, tmp_path, seed):
    """Rows in any order over any files, late ones too."""
    rnd = random.Random(seed)
    rows = [("ab"[i % 2], rnd.uniform(0, 100), rnd.uniform(10, 12), rnd.choice([0.01, 0.03, 2.0, 0.0, float("nan"), None])) for i in range(300)] + [("a", None, 1.0, 1.0), ("b", 5.0, None, 1.0), ("b", 5.0, float("inf"), 1.0)]
    fields = "star string, t double, mag double, err double"
    args = (["star"], F.col("t"), "mag", "err", 7.0)
    want = sorted(map(tuple, live_bins(spark.createDataFrame(rows, fields), *args).collect()))
    rnd.shuffle(rows)
    cuts = sorted(rnd.sample(range(1, 300), 6))
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[lo:hi], fields).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    bins = run_once(live_bins(stream, *args), ["star", "bin"])
    assert sorted(map(tuple, bins.select("star", "bin", "n", "weight", "weighted", "low", "high").collect())) == want
    plain = {}
    for star, t, mag, err in rows:
        if t is not None and mag and mag < 100 and err and err > 0:
            plain.setdefault((star, t // 7.0), []).append((mag, max(1, round(1e4 / err**2))))
    curve = {(r["star"], r["at"] // 7.0): r for r in live_curve(bins, ["star"], 7.0).collect()}
    assert curve.keys() == plain.keys()
    for k, own in plain.items():
        assert abs(curve[k]["mean"] - sum(m * w for m, w in own) / sum(w for _, w in own)) < 1e-5 and curve[k]["n"] == len(own)


def test_ring_is_the_same_before_and_after_trimming(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    ring = EventRing(spark, f"file://{tmp_path}/ring", schema, size=5)
    assert ring.events().count() == 0
    rows = [("a", i, f"a{i}") for i in range(1, 13)] + [("b", i, f"b{i}") for i in (3, 7)] + [("c", 1, "c1")]
    for batch, (lo, hi) in enumerate([(0, 4), (4, 13), (13, 15)]):
        ring.append(spark.createDataFrame(rows[lo:hi], SCHEMA), batch)
        ring.append(spark.createDataFrame(rows[lo:hi], SCHEMA), batch)  # run again after a restart

    def missed(**after):
        return sorted((r["topic"], r["id"], r["refetch"]) for r in ring.catch_up(after).collect())

    def checks():
        assert missed(a=10, b=3) == [("a", 11, False), ("a", 12, False), ("b", 7, False)]
        assert missed(a=0, b=0) == [("a", 12, False), ("b", 7, False)]  # new listeners
        assert missed(a=7) == [("a", i, False) for i in range(8, 13)]
        assert missed(a=6) == [("a", i, True) for i in range(8, 13)]  # 7 has left the ring
        assert missed(a=12, c=5, d=3) == []

    checks()
    ring.trim(1)
    checks()
    ring.append(spark.createDataFrame([("a", 13, "a13")], SCHEMA), 3)
    assert missed(a=12) == [("a", 13, False)]
    ring.trim(3)
    assert sorted(r["id"] for r in ring.events().filter("topic = 'a'").collect()) == [9, 10, 11, 12, 13]


class Crash(Exception):
    pass


def outbox(spark, tmp_path, **more):
    return AlertOutbox(spark, f"file://{tmp_path}/outbox", "star string, mag double", "star", **more)


def frame(spark, *rows):
    return spark.createDataFrame(rows, "star string, mag double")


def state_of(box):
    return {r["star"]: (r["state"], r["tries"]) for r in box.states().collect()}


def test_claims_are_made_once(spark, tmp_path):
    box = outbox(spark, tmp_path)
    assert state_of(box) == {} and box.deliver(print) == 0
    box.claim(frame(spark, ("x", 3.0), ("x", 2.0), ("y", 1.0), (None, 5.0)), 0)
    box.claim(frame(spark, ("x", 3.0), ("x", 2.0), ("y", 1.0), (None, 5.0)), 0)  # the batch again
    box.claim(frame(spark, ("x", 9.0), ("z", 1.0)), 1)
    assert sorted((r["star"], r["mag"]) for r in box.claims().collect()) == [("x", 2.0), ("y", 1.0), ("z", 1.0)]


def test_a_restart_between_claim_and_send_loses_and_repeats_nothing(spark, tmp_path):
    box, sent = outbox(spark, tmp_path), []
    box.claim(frame(spark, ("x", 1.0), ("y", 2.0)), 0)
    again = outbox(spark, tmp_path)  # as after a restart
    assert again.deliver(lambda a: sent.append(a["star"])) == 2
    assert outbox(spark, tmp_path).deliver(lambda a: sent.append(a["star"])) == 0
    assert sorted(sent) == ["x", "y"] and set(state_of(again).values()) == {("sent", 1)}


def test_unknown_outcomes_are_never_sent_again(spark, tmp_path):
    box, sent = outbox(spark, tmp_path), []
    box.claim(frame(spark, *((s, 1.0) for s in "abcd")), 0)

    def send(alert):
        if alert["star"] == "b":
            raise SendFailed
        if alert["star"] == "c":
            raise Crash  # the outcome of this one is not known
        sent.append(alert["star"])

    with pytest.raises(Crash):
        box.deliver(send)
    assert state_of(box) == {"a": ("sent", 1), "b": ("waiting", 1), "c": ("unknown", 1), "d": ("waiting", 1)}
    assert box.deliver(lambda a: sent.append(a["star"])) == 2
    assert sorted(sent) == ["a", "b", "d"] and state_of(box)["c"] == ("unknown", 1)


def test_failures_end_after_some_attempts(spark, tmp_path):
    box, tries = outbox(spark, tmp_path, attempts=3), []

    def send(alert):
        tries.append(alert["star"])
        raise SendFailed

    box.claim(frame(spark, ("x", 1.0)), 0)
    for _ in range(5):
        assert box.deliver(send) == 0
    assert tries == ["x"] * 3 and state_of(box) == {"x": ("failed", 3)}


def test_a_stream_stopped_and_started_again(spark, tmp_path):
    """A batch whose claims were written and not committed is run again, and nothing is claimed twice."""
    box, fields = outbox(spark, tmp_path), "star string, mag double"
    for i in range(4):
        spark.createDataFrame([(f"s{i % 3}", float(i))], fields).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []

    def write(df, batch):
        box.claim(df, batch)
        seen.append(batch)
        if seen == [0, 1]:
            raise Crash

    with pytest.raises(Exception, match="Crash"):
        each_batch(stream, write, f"{tmp_path}/job")
    each_batch(stream, write, f"{tmp_path}/job")
    assert seen == [0, 1, 1, 2, 3] and sorted(r["star"] for r in box.claims().collect()) == ["s0", "s1", "s2"]
