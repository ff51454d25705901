"""Queries of sessions, runs, spans and time windows on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.time import MICROS_PER_HOUR, from_micros, micros, night
from orrery.operators import groups, matching, sessions, stats
from orrery.plans.registry import query
from orrery.session import table

HOUR = MICROS_PER_HOUR


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds."""
    return table(spark, sf_dir, "events").withColumn("us", micros("ts"))


@query(f"""
WITH e AS (SELECT user_id, event_type, event_id, value, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) > {36 * HOUR} THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT *, 1 + sum(new) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, event_type, cast(session AS BIGINT) AS session, count(*) AS n, min(us) AS began, max(us) AS ended, round(avg(value),6) AS level FROM s GROUP BY 1,2,3""")
def session_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of events of one kind at most 36 hours apart."""
    s = sessions.gap_sessions(timed(spark, sf_dir), ["user_id", "event_type"], "us", 36 * HOUR, ties=["event_id"])
    return s.groupBy("user_id", "event_type", "session").agg(F.count("*").alias("n"), F.min("us").alias("began"), F.max("us").alias("ended"), F.round(F.avg("value"), 6).alias("level"))


@query("""
WITH g AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, 1 + sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, cast(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n, max(event_id) AS last_id FROM s GROUP BY 1,2""")
def key_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.runs(timed(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type")
    return s.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query(f"""
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {24 * HOUR} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS season FROM g),
m AS (SELECT *, median(value) OVER (PARTITION BY user_id, season) AS mid, count(*) OVER (PARTITION BY user_id, season) AS n FROM s)
SELECT event_id, round(value - mid, 6) AS detrended FROM m WHERE n >= 8""")
def detrended_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons split by gaps; each one's median removed, short ones dropped."""
    s = sessions.gap_sessions(timed(spark, sf_dir), ["user_id"], "us", 24 * HOUR, ties=["event_id"], name="season")
    w = Window.partitionBy("user_id", "season")
    m = s.withColumn("mid", F.median("value").over(w)).withColumn("n", F.count("*").over(w))
    return m.filter("n >= 8").select("event_id", F.round(F.col("value") - F.col("mid"), 6).alias("detrended"))


@query(f"""
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events)
SELECT event_id, CASE WHEN count(*) OVER w >= 3 THEN round(median(value) OVER w, 6) END AS before FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND 1 PRECEDING)""")
def trailing_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the day before, both ends open; null under three values."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-(24 * HOUR - 1), -1)
    return timed(spark, sf_dir).select("event_id", F.when(F.count("*").over(w) >= 3, F.round(F.percentile("value", F.lit(0.5)).over(w), 6)).alias("before"))


@query(f"""
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events)
SELECT event_id, round(value - median(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {48 * HOUR} PRECEDING AND {48 * HOUR} FOLLOWING), 6) AS high_pass FROM e""")
def running_high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-48 * HOUR, 48 * HOUR)
    return timed(spark, sf_dir).select("event_id", F.round(F.col("value") - F.percentile("value", F.lit(0.5)).over(w), 6).alias("high_pass"))


@query("""
SELECT user_id, event_type, cast(sum(until - us) AS BIGINT) AS open_us, count(*) AS n FROM (SELECT user_id, event_type, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events) GROUP BY 1,2""")
def state_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.state_spans(timed(spark, sf_dir), ["user_id"], ["us", "event_id"], "us")
    return s.groupBy("user_id", "event_type").agg(F.sum(F.col("until") - F.col("us")).alias("open_us"), F.count("*").alias("n"))


@query(f"""
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events WHERE value <> 0),
m AS (SELECT *, avg(value) OVER w AS level, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND {24 * HOUR - 1} FOLLOWING))
SELECT user_id, round(max(level),6) AS worst FROM m WHERE n >= 3 GROUP BY 1""")
def worst_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst mean of a day's window that starts at a point and holds three."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(0, 24 * HOUR - 1)
    m = timed(spark, sf_dir).filter("value <> 0").withColumn("level", F.avg("value").over(w)).withColumn("n", F.count("*").over(w))
    return m.filter("n >= 3").groupBy("user_id").agg(F.round(F.max("level"), 6).alias("worst"))


@query(f"""
WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + cast(value * 60000000 AS BIGINT) AS b FROM events WHERE value > 0),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS span FROM m)
SELECT user_id, cast(sum(e - f) AS BIGINT) AS covered_us, count(*) AS spans FROM (SELECT user_id, span, min(a) AS f, max(b) AS e FROM g GROUP BY 1,2) GROUP BY 1""")
def union_of_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total length of the union of spans: overlaps count once."""
    s = timed(spark, sf_dir).filter("value > 0").select("user_id", F.col("us").alias("a"), (F.col("us") + F.round(F.col("value") * 60000000).cast("long")).alias("b"))
    m = sessions.merged_spans(s, ["user_id"], "a", "b")
    return m.groupBy("user_id").agg(F.sum(F.col("b") - F.col("a")).alias("covered_us"), F.count("*").alias("spans"))


@query(f"""
WITH s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS a, epoch_us(ts) + {2 * HOUR} AS b FROM events)
SELECT x.event_id AS view_id, y.event_id AS error_id, least(x.b,y.b)-greatest(x.a,y.a) AS overlap FROM s x JOIN s y ON x.user_id=y.user_id AND x.a<y.b AND y.a<x.b WHERE x.event_type='view' AND y.event_type='error'""")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timed(spark, sf_dir).select("event_id", "user_id", "event_type", F.col("us").alias("start"), (F.col("us") + 2 * HOUR).alias("end"))
    left = s.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "start", "end")
    right = s.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("start").alias("start2"), F.col("end").alias("end2"))
    return matching.interval_join(left, right, ["user_id"], 2 * HOUR).select("view_id", "error_id", "overlap")


@query(f"""
WITH e AS (SELECT *, epoch_us(ts) AS us, floor((epoch_us(ts) + {-9 * HOUR})/{24 * HOUR}) AS night FROM events),
g AS (SELECT night, us - lag(us + 60000000) OVER (PARTITION BY night ORDER BY us, event_id) AS gap, (event_type <> lag(event_type) OVER (PARTITION BY night ORDER BY us, event_id)) AS switched FROM e)
SELECT cast(night AS BIGINT) AS night, switched, count(*) AS n, cast(quantile_disc(gap, 0.5) AS BIGINT) AS median_gap, cast(quantile_disc(gap, 0.9) AS BIGINT) AS p90_gap FROM g WHERE gap >= 0 GROUP BY 1,2""")
def switch_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses between events of a night, by whether the kind changed, with nearest-rank quantiles.

    Windows span an hour, not a night; an hour's first event follows the last one of the hours before.
    """
    e = timed(spark, sf_dir).select(F.floor((F.col("us") - 9 * HOUR) / F.lit(24 * HOUR)).alias("night"), F.floor(F.col("us") / F.lit(HOUR)).alias("hour"), F.struct("us", "event_id", "event_type").alias("own"))
    ends = e.groupBy("night", "hour").agg(F.max("own").alias("last"))
    ends = ends.select("night", "hour", F.lag("last").over(Window.partitionBy("night").orderBy("hour")).alias("carried"))
    before = F.coalesce(F.lag("own").over(Window.partitionBy("night", "hour").orderBy("own")), F.col("carried"))
    g = e.join(ends, ["night", "hour"]).withColumn("before", before)
    g = g.select("night", (F.col("own.us") - F.col("before.us") - 60000000).alias("gap"), (F.col("own.event_type") != F.col("before.event_type")).alias("switched"))
    return g.filter("gap >= 0").groupBy("night", "switched").agg(F.count("*").alias("n"), stats.nearest_rank("gap", 0.5).cast("long").alias("median_gap"), stats.nearest_rank("gap", 0.9).cast("long").alias("p90_gap"))


@query("""
SELECT event_id, cast(cast(ts + INTERVAL (-5*4) MINUTE - INTERVAL 12 HOUR AS DATE) AS VARCHAR) AS night FROM events""")
def observing_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The night of an event at 5 degrees west: the day turns at local noon."""
    return timed(spark, sf_dir).select("event_id", night(F.col("us"), -5.0).cast("string").alias("night"))


@query("""
SELECT user_id, event_id, least(1.0, 3.0/count(*) OVER (PARTITION BY user_id, cast(ts AS DATE))) AS weight FROM events""")
def night_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.select("user_id", "event_id", F.least(F.lit(1.0), F.lit(3.0) / F.count("*").over(Window.partitionBy("user_id", "day"))).alias("weight"))


@query("""
WITH d AS (SELECT user_id, cast(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE value>60) AS up FROM events GROUP BY 1,2),
b AS (SELECT user_id, day, n>=3 AND (up>=0.8*n OR n-up>=0.8*n) AS bad FROM d)
SELECT user_id, count(*) AS days, count(*) FILTER (WHERE bad) AS bad_days, bool_and(bad) AS all_bad FROM b GROUP BY 1""")
def bad_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is bad when nearly all of its changes go one way; a user only if every day is."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("up"))
    bad = (F.col("n") >= 3) & ((F.col("up") >= 0.8 * F.col("n")) | (F.col("n") - F.col("up") >= 0.8 * F.col("n")))
    return d.withColumn("bad", bad).groupBy("user_id").agg(F.count("*").alias("days"), F.count_if("bad").alias("bad_days"), F.bool_and("bad").alias("all_bad"))


@query("""
WITH d AS (SELECT user_id, cast(ts AS DATE) AS day, max(value) AS top FROM events GROUP BY 1,2),
f AS (SELECT user_id, day FROM d WHERE top > 150)
SELECT f.user_id, cast(f.day AS VARCHAR) AS day, count(d.day) AS seen, round(arg_min(d.top, d.day),4) AS next_top FROM f LEFT JOIN d ON d.user_id=f.user_id AND d.day - f.day BETWEEN 1 AND 3 GROUP BY 1,2""")
def follow_on_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a flagged day's next three days showed."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("top"))
    f = d.filter("top > 150").select("user_id", F.col("day").alias("flagged"))
    wanted = f.withColumn("day", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.date_add("flagged", k))))
    seen = wanted.join(d, ["user_id", "day"], "left").withColumn("got", F.when(F.col("top").isNotNull(), F.col("day")))
    return seen.groupBy("user_id", F.col("flagged").cast("string").alias("day")).agg(F.count("got").alias("seen"), F.round(F.min_by("top", "got"), 4).alias("next_top"))


@query(f"""
SELECT user_id, event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS began, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2,3""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = F.floor(F.col("us") / F.lit(6 * HOUR)) * (6 * HOUR)
    return timed(spark, sf_dir).groupBy("user_id", "event_type", six.alias("began")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""
WITH e AS (SELECT event_type, value, epoch_us(ts) AS us FROM events)
SELECT event_type, cast(w * {HOUR} AS BIGINT) AS began, count(*) AS n, round(avg(value),6) AS level FROM (SELECT *, unnest(range(us // {HOUR} - 5, us // {HOUR} + 1)) AS w FROM e) GROUP BY 1,2""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours, one each hour."""
    h = F.floor(F.col("us") / F.lit(HOUR))
    e = timed(spark, sf_dir).select("event_type", "value", F.explode(F.sequence(h - 5, h)).alias("w"))
    return e.groupBy("event_type", (F.col("w") * HOUR).alias("began")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("level"))


@query("""
SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def sticky_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each type, as a late subscriber gets it."""
    at = F.struct("us", "event_id")
    return timed(spark, sf_dir).groupBy("event_type").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("value", at).alias("value"))


@query("""
SELECT cast(ts AS DATE)::VARCHAR AS day, round(avg(value) FILTER (WHERE event_type='view'),6) AS view, round(avg(value) FILTER (WHERE event_type='click'),6) AS click, round(avg(value) FILTER (WHERE event_type='error'),6) AS error FROM events GROUP BY 1""")
def metrics_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of one time merged into a wide row."""
    p = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).pivot("event_type", ["view", "click", "error"]).agg(F.avg("value"))
    return p.select("day", *[F.round(c, 6).alias(c) for c in ("view", "click", "error")])


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events WHERE event_type='error'),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {12 * HOUR} THEN 1 ELSE 0 END AS new FROM e),
b AS (SELECT *, 1 + sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, cast(burst AS BIGINT) AS burst, count(*) AS n, max(us)-min(us) AS length FROM b GROUP BY 1,2 HAVING count(*) >= 2""")
def error_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.gap_sessions(timed(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], "us", 12 * HOUR, ties=["event_id"], name="burst")
    return s.groupBy("user_id", "burst").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("length")).filter("n >= 2")


@query("""
SELECT event_id, round(value - lag(value) OVER w, 6) AS step, value > coalesce(lag(value) OVER w, -1) AND value > coalesce(lead(value) OVER w, -1) AS peak FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    at = F.col("value")
    peak = (at > F.coalesce(F.lag("value").over(w), F.lit(-1.0))) & (at > F.coalesce(F.lead("value").over(w), F.lit(-1.0)))
    return timed(spark, sf_dir).select("event_id", F.round(at - F.lag("value").over(w), 6).alias("step"), peak.alias("peak"))


@query("""
WITH d AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY 1,2), t AS (SELECT event_type, sum(n) AS tn, sum(s) AS ts FROM d GROUP BY 1)
SELECT d.user_id, d.event_type, round((ts-s)/(tn-n),8) AS others FROM d JOIN t USING (event_type)""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of all other users: totals less one's own, no second pass per user."""
    d = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    t = d.groupBy("event_type").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    return d.join(t, "event_type").select("user_id", "event_type", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 8).alias("others"))


@query("""
WITH RECURSIVE v AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id, value FROM events),
m AS (SELECT * FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id) QUALIFY value > coalesce(lag(value) OVER w, -1) AND value > coalesce(lead(value) OVER w, -1)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, t) AS k FROM m),
r AS (SELECT user_id, k, [t] AS kept, true AS stays, event_id FROM n WHERE k = 1
 UNION ALL SELECT n.user_id, n.k, CASE WHEN len(list_filter(r.kept, lambda x: abs(x - n.t) < 172800)) = 0 THEN list_append(r.kept, n.t) ELSE r.kept END, len(list_filter(r.kept, lambda x: abs(x - n.t) < 172800)) = 0, n.event_id FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
SELECT r.user_id, event_id, value FROM r JOIN n USING (user_id, k, event_id) WHERE stays QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY value DESC, t) <= 5""")
def separated_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest peaks of each user that keep two days from any higher one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (micros("ts") / 1e6).alias("t"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    peaks = e.withColumns({"a": F.coalesce(F.lag("value").over(w), F.lit(-1.0)), "b": F.coalesce(F.lead("value").over(w), F.lit(-1.0))}).filter("value > a and value > b").drop("a", "b")
    kept = groups.separated_peaks(peaks, ["user_id"], "t", "value", 172_800.0)
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "t")
    return kept.withColumn("n", F.row_number().over(best)).filter("n <= 5").select("user_id", "event_id", "value")


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey % 40 AS bucket, round(o_totalprice / 100) AS price FROM orders), p AS (SELECT p_partkey % 40 AS bucket, round(p_retailprice) AS price, min(p_partkey) AS part FROM part GROUP BY ALL),
d AS (SELECT id, o.bucket, part, row_number() OVER (PARTITION BY id ORDER BY abs(p.price - o.price), p.price DESC, part) AS n FROM o JOIN p USING (bucket)),
q AS (SELECT p_partkey % 40 AS bucket, round(p_retailprice) AS price, min(p_partkey) AS part FROM part WHERE p_partkey % 40 >= 6 OR p_size <= 25 GROUP BY ALL),
b AS (SELECT id, part, row_number() OVER (PARTITION BY id ORDER BY abs(q.price - o.price), q.price DESC, part) AS n FROM o JOIN q USING (bucket))
SELECT o.id, d.part, b.part AS was FROM o LEFT JOIN d ON d.id = o.id AND d.n = 1 LEFT JOIN b ON b.id = o.id AND b.n = 1 WHERE d.part IS DISTINCT FROM b.part""")
def rematched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose best part changes once new parts have come to some groups; only those groups are matched anew."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("bucket"), F.round(F.col("o_totalprice") / 100).alias("price"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("bucket"), F.round("p_retailprice").alias("price"), F.col("p_partkey").alias("part"), "p_size")
    new = (F.col("bucket") < 6) & (F.col("p_size") > 25)
    match = lambda a, b: matching.nearest(a, b.drop("p_size"), ["bucket"], "price", "part").drop("distance")
    recorded = match(o, p.filter(~new)).select("id", "bucket", "price", "part")
    found = matching.rematched(recorded, o, p, p.filter(new), ["bucket"], match, "part")
    return found.filter(~F.col("part").eqNullSafe(F.col("was"))).select("id", "part", "was")
