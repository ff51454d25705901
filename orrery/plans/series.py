"""Queries of time series: folding, periodograms, verdicts, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.time import MICROS_PER_HOUR, micros
from orrery.operators import series
from orrery.plans.registry import query
from orrery.session import table

DAY = 24.0 * MICROS_PER_HOUR


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: star (user), t in days, y (value)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("star"), (micros("ts") / DAY - 19723).alias("t"), F.col("value").alias("y"), "event_id", "event_type")


_T = "epoch_us(ts)/86400000000.0-19723"


@query(f"""
WITH p AS (SELECT user_id AS star, {_T} AS t, value-avg(value) OVER (PARTITION BY user_id) AS y FROM events), f AS (SELECT i/10.0 AS f FROM range(1,21) r(i))
SELECT star, f AS frequency, round((pow(sum(y*cos(2*pi()*f*t)),2)+pow(sum(y*sin(2*pi()*f*t)),2))/count(*)/var_pop(y),6) AS power FROM p, f GROUP BY 1,2""")
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of every star at a grid of frequencies: sums of sines and cosines."""
    grid = [i / 10 for i in range(1, 21)]
    p = series.periodogram(curves(spark, sf_dir), ["star"], "t", "y", grid)
    return p.select("star", "frequency", F.round("power", 6).alias("power"))


@query(f"""
WITH p AS (SELECT user_id AS star, cast(floor(((({_T})/2.5)-floor(({_T})/2.5))*20) AS BIGINT) AS bin, value-avg(value) OVER (PARTITION BY user_id) AS y FROM events),
b AS (SELECT star, bin, sum(y) AS s, count(*) AS n FROM p GROUP BY 1,2), w AS (SELECT b.star, c.bin AS start, k.k AS length, sum(b.s) AS s, sum(b.n) AS n FROM b, (SELECT i AS bin FROM range(0,20) r(i)) c, (SELECT i AS k FROM range(1,5) r(i)) k WHERE (b.bin - c.bin + 20) % 20 < k.k GROUP BY 1,2,3)
SELECT star, start, length, round(depth,6) AS strength FROM (SELECT star, start, length, -s/sqrt(n) AS depth, row_number() OVER (PARTITION BY star ORDER BY -s/sqrt(n) DESC, start, length) rn FROM w) WHERE rn=1""")
def box_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest box (start and length in bins of phase) of each star folded at 2.5 days."""
    b = series.box_search(curves(spark, sf_dir), ["star"], "t", "y", period=2.5, bins=20, lengths=4)
    return b.select("star", "start", "length", F.round("strength", 6).alias("strength"))


@query("""
WITH p AS (SELECT user_id AS star, CASE WHEN event_type IN ('view', 'click') THEN 'r' ELSE 'g' END AS band, event_id % 2 AS obj, 100 + event_id % 2 + CASE user_id % 4 WHEN 0 THEN value / 200 WHEN 1 THEN value WHEN 2 THEN value / 10 ELSE CASE WHEN event_id % 19 = 0 THEN 30 ELSE value / 200 END END AS y, 1 + user_id % 3 * 0.5 AS e FROM events),
c AS (SELECT star, band, obj, median(y) AS m FROM p GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT star, band, y - m AS r, y, e, row_number() OVER (PARTITION BY star, band ORDER BY y - m) - 1 AS k, count(*) OVER (PARTITION BY star, band) AS n FROM p JOIN c USING (star, band, obj)),
s AS (SELECT star, band, any_value(n) AS n, quantile_cont(r, 0.95) - quantile_cont(r, 0.05) AS amplitude, median(e) AS error, median(y) AS level, count(*) FILTER (WHERE abs(r) > 10 AND abs(r) > 5 * e) AS deviant, count(*) FILTER (WHERE r > 10 AND r > 5 * e) AS fainter,
  CASE WHEN any_value(n) > 2 * greatest(1, round(0.01 * any_value(n))) THEN max(r) FILTER (WHERE k = n - 1 - greatest(1, round(0.01 * n))) - max(r) FILTER (WHERE k = greatest(1, round(0.01 * n))) ELSE 0 END AS peak FROM r GROUP BY ALL),
v AS (SELECT *, n >= 10 AND (amplitude >= 4.5 * error OR deviant >= greatest(5, 0.02 * n) OR (fainter >= greatest(5, 0.01 * n) AND deviant - fainter <= 0.25 * fainter)) AS varies FROM s),
u AS (SELECT *, CASE WHEN varies AND peak + 2 * error >= 20 THEN 0 WHEN varies THEN 1 WHEN n >= 20 AND 3 * error <= 20 AND amplitude < 20.0 / 3 AND amplitude < 4.5 * error AND deviant <= greatest(1, 0.01 * n) THEN 2 ELSE 3 END AS kind FROM v),
b AS (SELECT *, count(*) OVER (PARTITION BY star) AS bands FROM u WHERE level BETWEEN 5 AND 200 QUALIFY row_number() OVER (PARTITION BY star ORDER BY kind, CASE WHEN kind < 2 THEN -peak WHEN kind = 2 THEN -n END, band) = 1)
SELECT star, CASE kind WHEN 0 THEN 'variable' WHEN 2 THEN 'flat' ELSE 'unknown' END AS verdict, CASE WHEN kind < 3 THEN b.band END AS band, round(CASE WHEN kind < 2 THEN peak WHEN kind = 2 THEN amplitude ELSE 0 END, 6) AS amplitude, coalesce(bands, 0) AS bands FROM (SELECT DISTINCT star FROM s) LEFT JOIN b USING (star)""")
def variability_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two bands of each star, of two objects each, say about a claimed change of 20."""
    user, value, dip = F.col("user_id"), F.col("value"), F.col("event_id") % 19 == 0
    change = F.when(user % 4 == 0, value / 200).when(user % 4 == 1, value).when(user % 4 == 2, value / 10).otherwise(F.when(dip, 30.0).otherwise(value / 200))
    obj = (F.col("event_id") % 2).alias("obj")
    p = table(spark, sf_dir, "events").select(user.alias("star"), F.when(F.col("event_type").isin("view", "click"), "r").otherwise("g").alias("band"), obj, (100 + F.col("event_id") % 2 + change).alias("y"), (1 + user % 3 * 0.5).alias("e"))
    v = series.verdicts(p, "star", "band", "obj", "y", "e", change=20.0, level=(5.0, 200.0))
    return v.select("star", "verdict", "band", F.round("amplitude", 6).alias("amplitude"), "bands")


@query("""
WITH b AS (SELECT s_suppkey, s_acctbal, 0.5+abs(s_acctbal)/1000 AS period FROM supplier), n AS (SELECT *, unnest(range(cast(ceil(10/period) AS BIGINT), cast(floor(30/period) AS BIGINT)+1)) AS n FROM b)
SELECT s_suppkey, n, round(n*period,6) AS mid, round(sqrt(pow(0.01,2)+pow(n*0.001,2)),8) AS sigma FROM n""")
def eclipse_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recurrence of an ephemeris between two times, with its error."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(0.0).alias("epoch"), (0.5 + F.abs("s_acctbal") / 1000).alias("period"))
    p = series.predictions(s, "epoch", "period", 10.0, 30.0, epoch_error=F.lit(0.01), period_error=F.lit(0.001))
    return p.select("s_suppkey", "n", F.round("mid", 6).alias("mid"), F.round("sigma", 8).alias("sigma"))


@query("""
WITH t AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate)::DOUBLE AS t FROM orders),
f AS (SELECT o_custkey, regr_slope(t,n) AS period, regr_intercept(t,n) AS epoch FROM t GROUP BY 1 HAVING count(*)>=4)
SELECT o_custkey, n, round(t-(epoch+n*period),5) AS residual FROM t JOIN f USING (o_custkey)""")
def timing_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed minus calculated times of a fitted linear ephemeris."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double")
    t = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(w).cast("long").alias("n"), days.alias("t"))
    o = series.timing_residuals(t, ["o_custkey"], "n", "t", least=4)
    return o.select("o_custkey", "n", F.round("residual", 5).alias("residual"))


@query(f"""
WITH p AS (SELECT user_id AS star, event_id, {_T} AS t, value AS y FROM events), l AS (SELECT p.*, p.t/3.0 - floor(p.t/3.0) AS phase FROM p)
SELECT event_id, round(phase,8) AS phase, cast(floor(phase*10) AS BIGINT) AS bin FROM l""")
def phase_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = series.phase(F.col("t"), F.lit(0.0), F.lit(3.0))
    return curves(spark, sf_dir).select("event_id", F.round(phase, 8).alias("phase"), F.floor(phase * 10).alias("bin"))


@query("""
WITH d AS (SELECT user_id AS star, cast(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY 1,2), m AS (SELECT day, avg(y) AS c, sum(y) AS s, count(*) AS n FROM d GROUP BY 1)
SELECT star, round(stddev_samp(y-(s-y)/(n-1)),6) AS scatter FROM d JOIN m USING (day) WHERE n>1 GROUP BY 1 HAVING count(*)>1""")
def comparison_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scatter of each star against the mean of all others of the same day."""
    d = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("star"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("y"))
    m = d.groupBy("day").agg(F.sum("y").alias("s"), F.count("*").alias("n")).filter("n > 1")
    off = d.join(m, "day").select("star", (F.col("y") - (F.col("s") - F.col("y")) / (F.col("n") - 1)).alias("r"))
    return off.groupBy("star").agg(F.stddev_samp("r").alias("x"), F.count("*").alias("k")).filter("k > 1").select("star", F.round("x", 6).alias("scatter"))
