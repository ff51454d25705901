"""Streaming queries over the events table, run over all there is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.time import MICROS_PER_HOUR, micros
from orrery.plans.registry import query
from orrery.session import shared_dir
from orrery.streaming import delivery, jobs

HOUR = MICROS_PER_HOUR


@query(f"""
SELECT event_type, cast(floor(epoch_us(ts)/{6 * HOUR})*{6 * HOUR} AS BIGINT) AS began, count(*) AS n, max(value) AS top FROM events GROUP BY 1,2""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.table_stream(spark, sf_dir, "events").withColumn("at", (micros("ts") / 1e6).cast("timestamp"))
    w = jobs.windowed(s, "at", "6 hours", [F.count("*").alias("n"), F.max("value").alias("top")], keys=["event_type"], late="40 days")
    return jobs.run_once(w, ["began", "event_type"])


@query(f"""
SELECT event_type, cast(w*{HOUR} AS BIGINT) AS began, count(*) AS n FROM (SELECT event_type, unnest(range(epoch_us(ts)//{HOUR}-2, epoch_us(ts)//{HOUR}+1)) AS w FROM events) GROUP BY 1,2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.table_stream(spark, sf_dir, "events").withColumn("at", (micros("ts") / 1e6).cast("timestamp"))
    w = jobs.windowed(s, "at", "3 hours", [F.count("*").alias("n")], slide="1 hour", keys=["event_type"], late="40 days")
    return jobs.run_once(w, ["began", "event_type"])


@query("""
SELECT user_id, arg_max(event_id,(ts,event_id)) AS event_id, arg_max(event_type,(ts,event_id)) AS event_type FROM events GROUP BY 1""")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.table_stream(spark, sf_dir, "events").withColumn("us", micros("ts"))
    return jobs.run_once(jobs.latest(s, ["user_id"], ["us", "event_id"], ["event_id", "event_type"]), ["user_id"])


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.table_stream(spark, sf_dir, "events").select("user_id", "event_type")
    return jobs.run_once(jobs.deduplicated(s, ["user_id", "event_type"]), [], "append")


@query("""
WITH RECURSIVE k AS (SELECT user_id, epoch_us(ts)/1e6 AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 21600 THEN 1 ELSE 0 END AS new FROM k),
s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS sid FROM g),
r AS (SELECT user_id, sid, min(t) AS f FROM s GROUP BY 1,2 UNION ALL SELECT r.user_id, r.sid, min(s.t) FROM r JOIN s ON s.user_id=r.user_id AND s.sid=r.sid AND s.t > r.f+86400 GROUP BY r.user_id, r.sid, r.f),
n AS (SELECT *, lead(f) OVER (PARTITION BY user_id, sid ORDER BY f) AS after FROM r)
SELECT n.user_id, n.f AS first, least(max(s.t)+21600, n.f+86400) AS due, count(*) AS kicks FROM n JOIN s ON s.user_id=n.user_id AND s.sid=n.sid AND s.t>=n.f AND (n.after IS NULL OR s.t<n.after) GROUP BY n.user_id, n.f""")
def stream_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kicks of each user merged into runs."""
    s = jobs.table_stream(spark, sf_dir, "events").select("user_id", (micros("ts") / 1e6).alias("at"))
    return jobs.run_once(jobs.debounced(s, "user_id", "at", 6 * 3600, 24 * 3600), [], "append", lambda left: jobs.last_runs(left, "user_id", 6 * 3600, 24 * 3600))


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts)/1e6 AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS rn FROM events),
w AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS t, 0.0::DOUBLE AS v, false AS opened, 0 AS low, 0.0::DOUBLE AS seen, false AS late, false AS was FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT e.user_id, e.rn, e.t, e.v,
  CASE WHEN w.opened AND e.t-w.seen<=172800 THEN NOT (e.v<30 AND w.low+1>=2) ELSE e.v>=80 END,
  CASE WHEN w.opened AND e.t-w.seen<=172800 AND e.v<30 AND w.low+1<2 THEN w.low+1 ELSE 0 END,
  e.t, w.opened AND e.t-w.seen>172800, w.opened AND e.t-w.seen<=172800 FROM w JOIN e ON e.user_id=w.user_id AND e.rn=w.rn+1),
x AS (SELECT *, lag(seen) OVER (PARTITION BY user_id ORDER BY rn) AS before, max(rn) OVER (PARTITION BY user_id) AS last FROM w)
SELECT user_id, before+172800 AS at, 'ended' AS state, 'timeout' AS reason FROM x WHERE late
UNION ALL SELECT user_id, t, 'watching', 'rose' FROM x WHERE opened AND NOT was
UNION ALL SELECT user_id, t, 'ended', 'faded' FROM x WHERE was AND NOT opened
UNION ALL SELECT user_id, seen+172800, 'ended', 'timeout' FROM x WHERE opened AND rn=last""")
def stream_watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watches opened and ended per user."""
    s = jobs.table_stream(spark, sf_dir, "events").select("user_id", (micros("ts") / 1e6).alias("at"), "value")
    return jobs.run_once(jobs.watched(s, "user_id", "at", "value", start=80, fade=30, timeout=172_800.0), [], "append", lambda left: jobs.last_timeouts(left, "user_id", 172_800.0))


@query("""
SELECT event_type, (floor(epoch_us(ts) / 1e6 / 7200) + 0.5) * 7200 AS at, round(sum(w * v) / sum(w) / 1e6, 6) AS mean, round(100 / sqrt(sum(w)), 9) AS error, count(*) AS n, round((max(v) - min(v)) / 1e6, 6) AS range
FROM (SELECT *, greatest(1, round(1e4 / pow(1 + user_id % 5, 2))) AS w, round(value * 1e6) AS v FROM events) GROUP BY ALL""")
def stream_live_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of two hours' bins, re-made in part as rows arrive."""
    s = jobs.table_stream(spark, sf_dir, "events").withColumns({"us": micros("ts"), "error": (1 + F.col("user_id") % 5).cast("double")})
    bins = jobs.run_once(delivery.live_bins(s, ["event_type"], F.col("us") / 1e6, "value", "error", 7200), ["event_type", "bin"])
    curve = delivery.live_curve(bins, ["event_type"], 7200)
    return curve.withColumns({"mean": F.round("mean", 6), "error": F.round("error", 9), "range": F.round("range", 6)})


@query("""
WITH r AS (SELECT event_type AS topic, event_id AS id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 50),
l AS (SELECT topic, CASE WHEN topic < 'd' THEN 0 WHEN topic < 'q' THEN 100 ELSE max(id) - 40 END AS seen, min(id) AS first, max(id) AS newest, count(*) AS held FROM r GROUP BY topic)
SELECT topic, id, value, seen > 0 AND held >= 50 AND first > seen + 1 AS refetch FROM r JOIN l USING (topic) WHERE CASE WHEN seen = 0 THEN id = newest ELSE id > seen END""")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listeners of each kind of event have missed: one new, one too far behind, one a little."""
    s = jobs.table_stream(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("id"), "value")
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    ring = delivery.EventRing(spark, f"{base}/ring", s.schema, size=50)
    jobs.each_batch(s, ring.append, base)
    ring.trim(0)
    newest = {r[0]: r[1] for r in ring.events().groupBy("topic").agg(F.max("id")).collect()}  # a row for each kind
    return ring.catch_up({t: 0 if t < "d" else 100 if t < "q" else n - 40 for t, n in newest.items()})


@query("""
SELECT user_id * 10 + length(event_type) AS alert, min(event_id) AS event_id, 'sent' AS state, 1 + CAST(user_id % 2 AS INTEGER) AS tries FROM events WHERE value > 260 GROUP BY user_id, length(event_type)""")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert for each user and kind, claimed from the stream; sends for users of odd number fail once."""
    s = jobs.table_stream(spark, sf_dir, "events").filter("value > 260").select((F.col("user_id") * 10 + F.length("event_type")).alias("alert"), "event_id")
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    outbox = delivery.AlertOutbox(spark, f"{base}/outbox", "alert long, event_id long", "alert")
    jobs.each_batch(s, lambda df, batch: outbox.claim(df, batch, [F.col("event_id")]), base)
    tried: set[int] = set()

    def send(alert: dict) -> None:
        if alert["alert"] // 10 % 2 and alert["alert"] not in tried:
            tried.add(alert["alert"])
            raise delivery.SendFailed

    while outbox.deliver(send, most=10_000):
        pass
    return outbox.states().select("alert", "event_id", "state", F.col("tries").cast("int").alias("tries"))
