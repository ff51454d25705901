"""Queries of percentiles, robust statistics, fits, rates and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.time import micros
from orrery.operators import fits, stats
from orrery.plans.registry import query
from orrery.session import table


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, CASE WHEN l_quantity>1 THEN l_extendedprice/l_quantity END AS raw, l_discount FROM lineitem),
g AS (SELECT l_returnflag, l_linestatus, quantile_cont(raw, 0.9) FILTER (WHERE l_discount<0.09) AS ref FROM r GROUP BY 1,2)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN raw>0 AND ref>0 THEN least(1.0, raw/ref) ELSE 0 END,8) AS score FROM r JOIN g USING (l_returnflag, l_linestatus)""")
def capped_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight over the 90th percentile of the group's counted rows, at most 1, 0 where unknown."""
    raw = F.when(F.col("l_quantity") > 1, F.col("l_extendedprice") / F.col("l_quantity"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", raw.alias("raw"))
    s = stats.capped_scores(li, ["l_returnflag", "l_linestatus"], "raw", counted=F.col("l_discount") < 0.09)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 8).alias("score"))


@query("""
SELECT event_type, round(quantile_cont(value,0.05),6) AS p05, round(quantile_cont(value,0.95)-quantile_cont(value,0.05),6) AS amplitude, quantile_disc(value,0.9) AS rank90,
 list_sort(list(value))[len(list(value))//2+1] AS upper_median FROM events GROUP BY 1""")
def percentile_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated, nearest-rank and upper-median quantiles side by side."""
    n = F.col("n")
    ranks = {"low": F.floor(0.05 * (n - 1)), "low2": F.ceil(0.05 * (n - 1)), "high": F.floor(0.95 * (n - 1)), "high2": F.ceil(0.95 * (n - 1)), "rank90": F.ceil(0.9 * n - 1e-9) - 1, "upper_median": F.floor(n / 2)}
    found = stats.order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value", ranks)
    between = lambda q, a, b: F.col(a) + (q * (n - 1) - F.floor(q * (n - 1))) * (F.col(b) - F.col(a))
    p05, p95 = between(0.05, "low", "low2"), between(0.95, "high", "high2")
    return found.select("event_type", F.round(p05, 6).alias("p05"), F.round(p95 - p05, 6).alias("amplitude"), "rank90", "upper_median")


@query("""
WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1)
SELECT event_type, round(any_value(med),6) AS median, round(1.4826*median(abs(value-med)),6) AS mad FROM events JOIN m USING (event_type) GROUP BY 1""")
def median_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.mad(table(spark, sf_dir, "events"), ["event_type"], "value")
    return m.select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(max(value)-min(value),6) AS peak_to_peak FROM r WHERE r>greatest(1,round(n*0.01)) AND r<=n-greatest(1,round(n*0.01)) GROUP BY 1""")
def trimmed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.trimmed_range(table(spark, sf_dir, "events"), ["user_id"], "value")
    return t.select("user_id", F.round("peak_to_peak", 6).alias("peak_to_peak"))


_CLIP = " ".join(f""", s{i} AS (SELECT event_type, median(value) AS m, stddev_pop(value) AS s FROM v{i} GROUP BY 1), v{i + 1} AS (SELECT v.event_type, v.value FROM v{i} v JOIN s{i} USING (event_type) WHERE abs(value-m)<=2*s)""" for i in range(3))


@query(f"""WITH v0 AS (SELECT event_type, value FROM events) {_CLIP}
SELECT event_type, round(median(value),6) AS median, round(stddev_pop(value),6) AS deviation, count(*) AS n FROM v3 GROUP BY 1""")
def clipped_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.clipped(table(spark, sf_dir, "events"), ["event_type"], "value", 2.0, 3)
    return c.select("event_type", F.round("median", 6).alias("median"), F.round("deviation", 6).alias("deviation"), "n")


@query("""
WITH x AS (SELECT l_returnflag, l_quantity AS x, l_discount AS y, l_extendedprice AS w FROM lineitem),
s AS (SELECT l_returnflag, sum(w) s, sum(w*x) sx, sum(w*y) sy, sum(w*x*x) sxx, sum(w*x*y) sxy FROM x GROUP BY 1)
SELECT l_returnflag, round(greatest(0,(s*sxy-sx*sy)/(s*sxx-sx*sx)),8) AS slope, round(greatest(0,(sy-(s*sxy-sx*sy)/(s*sxx-sx*sx)*sx)/s),6) AS intercept FROM s""")
def weighted_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted straight line, slope and intercept at least 0."""
    slope, intercept = stats.weighted_line("l_quantity", "l_discount", "l_extendedprice")
    fits = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(slope.alias("slope"), intercept.alias("intercept"))
    return fits.select("l_returnflag", F.round(F.greatest(F.lit(0.0), "slope"), 8).alias("slope"), F.round(F.greatest(F.lit(0.0), "intercept"), 6).alias("intercept"))


@query("""
SELECT l_returnflag, CASE WHEN l_discount=0.1 OR (l_discount>=0.08 AND l_discount<0.1) THEN 3 WHEN l_discount>=0 AND l_discount<0.02 THEN 0 WHEN l_discount>=0.02 AND l_discount<0.05 THEN 1 WHEN l_discount>=0.05 AND l_discount<0.08 THEN 2 END AS bin, count(*) AS n FROM lineitem GROUP BY 1,2""")
def closed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", stats.histogram("l_discount", [0, 0.02, 0.05, 0.08, 0.1]).alias("bin")).agg(F.count("*").alias("n"))


@query("""
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) rn FROM events GROUP BY 1,2) WHERE rn=1""")
def most_common_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_common(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (WHERE value>50) AS k FROM events GROUP BY 1,2),
t AS (SELECT event_type, sum(n) AS subs, sum(k) AS kept, count(*) AS g FROM c GROUP BY 1)
SELECT event_type, cast(any_value(subs) AS BIGINT) AS subs, round(any_value(kept/subs),8) AS rate, round(greatest(1, sum(pow(k-kept/subs*n,2))*any_value(g)/(any_value(g)-1)/any_value(kept/subs*(1-kept/subs)*subs)),6) AS effect FROM c JOIN t USING (event_type) GROUP BY 1""")
def clustered_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of high values with the design effect of users as clusters."""
    d = stats.design_effect(table(spark, sf_dir, "events"), ["event_type"], "user_id", F.col("value") > 50)
    return d.select("event_type", "subs", F.round("rate", 8).alias("rate"), F.round("effect", 6).alias("effect"))


@query("""
WITH r AS (SELECT (count(*) FILTER (WHERE l_returnflag='R')+1.0)/(count(*)+2) AS p FROM lineitem),
a AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE l_returnflag='R') AS k FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1),
ar AS (SELECT p_brand, n, (k+40*p)/(n+40) AS rate FROM a, r),
b AS (SELECT p_brand, p_type, count(*) AS n, count(*) FILTER (WHERE l_returnflag='R') AS k FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2)
SELECT 1 AS level, p_brand, NULL AS p_type, n, round(rate,8) AS rate FROM ar UNION ALL SELECT 2, b.p_brand, p_type, b.n, round((k+40*rate)/(b.n+40),8) FROM b JOIN ar USING (p_brand)""")
def shrunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned share by brand and type, each level shrunk to its parent."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return stats.shrunk_rates(li, ["p_brand", "p_type"], F.col("l_returnflag") == "R").select("level", "p_brand", "p_type", "n", F.round("rate", 8).alias("rate"))


@query("""
WITH l AS (SELECT p_partkey, p_brand, p_size, ln(p_retailprice) AS x FROM part)
SELECT a.p_partkey, coalesce(max(b.p_size) FILTER (WHERE abs(a.x-b.x)<=ln(1.01)+1e-12) , 0) * 0 + CASE WHEN count(*) FILTER (WHERE abs(a.x-b.x)<=ln(1.01)+1e-12)>=5 THEN max(b.p_size) FILTER (WHERE abs(a.x-b.x)<=ln(1.01)+1e-12)
 WHEN count(*) FILTER (WHERE abs(a.x-b.x)<=ln(1.02)+1e-12)>=5 THEN max(b.p_size) FILTER (WHERE abs(a.x-b.x)<=ln(1.02)+1e-12) ELSE max(b.p_size) END AS best FROM l a JOIN l b ON a.p_brand=b.p_brand GROUP BY 1""")
def adaptive_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best among parts of like price, widening until five are found."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return stats.neighbourhood_max(p, ["p_brand"], "p_retailprice", "p_size", least=5, ratios=(1.01, 1.02)).select("p_partkey", "best")


@query("""
WITH s AS (SELECT user_id, event_type, value/200 AS q, value/100 AS r FROM events), a AS (SELECT DISTINCT event_type, cast(u AS DOUBLE)/20 AS q FROM s, range(1,20) t(u))
SELECT a.event_type, a.q, CASE WHEN count(*) FILTER (WHERE abs(a.q-s.q)<=0.01+1e-9)>=20 THEN round(median(r) FILTER (WHERE abs(a.q-s.q)<=0.01+1e-9),6) WHEN count(*) FILTER (WHERE abs(a.q-s.q)<=0.02+1e-9)>=20 THEN round(median(r) FILTER (WHERE abs(a.q-s.q)<=0.02+1e-9),6)
 WHEN count(*) FILTER (WHERE abs(a.q-s.q)<=0.03+1e-9)>=20 THEN round(median(r) FILTER (WHERE abs(a.q-s.q)<=0.03+1e-9),6) END AS expected FROM a JOIN s USING (event_type) GROUP BY 1,2""")
def expected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of past ratios in a band of quality that widens until twenty are found."""
    s = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 200).alias("q"), (F.col("value") / 100).alias("r"))
    asked = s.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("u")).select("event_type", (F.col("u") / 20.0).alias("q"))
    e = stats.expected_score(s, asked, ["event_type"], "q", "r", step=0.01, steps=3, least=20)
    return e.select("event_type", "q", F.round("expected", 6).alias("expected"))


@query("""
WITH n AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS x, stddev_samp(l_extendedprice)/sqrt(count(*)) AS e FROM lineitem GROUP BY 1,2 HAVING count(*)>=3)
SELECT l_suppkey, round(sum(x/(e*e))/sum(1/(e*e)),4) AS level, round(sqrt(1/sum(1/(e*e))),4) AS error FROM n GROUP BY 1""")
def combined_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group means combined by inverse variance."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("x"), (F.stddev_samp("l_extendedprice") / F.sqrt(F.count("*"))).alias("e"), F.count("*").alias("n")).filter("n >= 3")
    w = 1 / (F.col("e") * F.col("e"))
    return n.groupBy("l_suppkey").agg(F.round(F.sum(F.col("x") * w) / F.sum(w), 4).alias("level"), F.round(F.sqrt(1 / F.sum(w)), 4).alias("error"))


@query("""
SELECT o_custkey, round(regr_slope(o_totalprice, d),6) AS slope, round(regr_r2(o_totalprice, d),6) AS r2, count(*) AS n FROM (SELECT o_custkey, o_totalprice, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate)::DOUBLE AS d FROM orders) GROUP BY 1 HAVING count(*)>=3""")
def trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", d.alias("d"))
    fits = o.groupBy("o_custkey").agg(F.regr_slope("o_totalprice", "d").alias("slope"), F.regr_r2("o_totalprice", "d").alias("r2"), F.count("*").alias("n"))
    return fits.filter("n >= 3").select("o_custkey", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "n")


@query("""
WITH w AS (SELECT l_partkey, l_extendedprice AS x, l_quantity AS w, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS lo, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS hi FROM lineitem),
c AS (SELECT l_partkey, avg(x) AS m, stddev_pop(x) AS s FROM w WHERE lo>4 AND hi>4 GROUP BY 1)
SELECT l_partkey, round(sum(x*w)/sum(w),2) AS level, count(*) AS n FROM w JOIN c USING (l_partkey) WHERE abs(x-m)<=3*greatest(s,0.05*m) GROUP BY 1""")
def clipped_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and spread without the four extremes each side, then a 3-sigma clipped weighted mean."""
    by = Window.partitionBy("l_partkey")
    w = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"), "l_orderkey", "l_linenumber")
    w = w.withColumn("lo", F.row_number().over(by.orderBy("x", "l_orderkey", "l_linenumber"))).withColumn("hi", F.row_number().over(by.orderBy(F.desc("x"), "l_orderkey", "l_linenumber")))
    c = w.filter("lo > 4 and hi > 4").groupBy("l_partkey").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    near = w.join(c, "l_partkey").filter(F.abs(F.col("x") - F.col("m")) <= 3 * F.greatest(F.col("s"), 0.05 * F.col("m")))
    return near.groupBy("l_partkey").agg(F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 2).alias("level"), F.count("*").alias("n"))


@query("""
WITH t AS (SELECT s_suppkey, s_nationkey, sum(l_quantity) AS done, any_value(s_acctbal) AS want FROM supplier LEFT JOIN lineitem ON l_suppkey=s_suppkey GROUP BY 1,2)
SELECT s_nationkey, arg_min(s_suppkey, (done/10000, s_suppkey)) AS s_suppkey, round(min(done/10000),6) AS share, round(avg(least(1,done/10000)),6) AS mean_share FROM t GROUP BY 1""")
def least_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least complete supplier of each nation."""
    t = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey", "s_nationkey").agg((F.sum("l_quantity") / 10000).alias("share"))
    known = F.when(F.col("share").isNotNull(), F.struct("share", "s_suppkey"))
    return t.groupBy("s_nationkey").agg(F.min_by("s_suppkey", known).alias("s_suppkey"), F.round(F.min("share"), 6).alias("share"), F.round(F.avg(F.least(F.lit(1.0), "share")), 6).alias("mean_share"))


@query("""
WITH p AS (SELECT l_orderkey, string_agg(concat(l_linenumber,'x',cast(l_quantity AS BIGINT)), ',' ORDER BY l_linenumber, l_quantity) AS plan, count(*) AS n FROM lineitem WHERE l_quantity>=48 GROUP BY 1)
SELECT plan, count(*) AS orders, cast(floor((median(l_orderkey)*2+1)/2) AS BIGINT) AS middle FROM p GROUP BY 1""")
def exposure_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders grouped by their ordered plan, with how many use it and a whole-number median."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    plan = F.array_join(F.transform(items, lambda r: F.concat(r["l_linenumber"].cast("string"), F.lit("x"), r["l_quantity"].cast("long").cast("string"))), ",")
    p = table(spark, sf_dir, "lineitem").filter("l_quantity >= 48").groupBy("l_orderkey").agg(plan.alias("plan"))
    return p.groupBy("plan").agg(F.count("*").alias("orders"), F.floor((F.median("l_orderkey") * 2 + 1) / 2).cast("long").alias("middle"))


@query("""
WITH e AS (SELECT event_type AS kind, CAST(epoch_us(ts) // 21600000000 % 4 AS BIGINT) AS part, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS night, CAST(value > 50 AS INT) AS kept FROM events),
f AS (SELECT u.night, kind, part, kept FROM e JOIN (SELECT DISTINCT night FROM e) u ON e.night <> u.night),
r0 AS (SELECT u.night, (coalesce(sum(kept), 0) + 1) / (count(kept) + 2) AS rate FROM (SELECT DISTINCT night FROM e) u LEFT JOIN f USING (night) GROUP BY u.night),
r1 AS (SELECT c.night, c.kind, (coalesce(sum(f.kept), 0) + 40 * any_value(r0.rate)) / (count(f.kept) + 40) AS rate FROM (SELECT DISTINCT night, kind FROM e) c JOIN r0 USING (night) LEFT JOIN f ON f.night = c.night AND f.kind = c.kind GROUP BY 1, 2),
r2 AS (SELECT c.night, c.kind, c.part, own_n, own_k, count(f.kept) AS n, (coalesce(sum(f.kept), 0) + 40 * any_value(r1.rate)) / (count(f.kept) + 40) AS rate FROM (SELECT night, kind, part, count(*) AS own_n, sum(kept) AS own_k FROM e GROUP BY ALL) c JOIN r1 USING (night, kind)
 LEFT JOIN f ON f.night = c.night AND f.kind = c.kind AND f.part = c.part GROUP BY ALL)
SELECT night, kind, part, n, round(rate, 9) AS rate, own_n, CAST(own_k AS BIGINT) AS own_k FROM r2""")
def held_out_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rates of each night's cells, as fitted without that night."""
    us = micros("ts")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.floor(us / 21_600_000_000) % 4).alias("part"), F.floor(us / 86_400_000_000).alias("night"), "value")
    rates = stats.leave_one_out_rates(e, ["kind", "part"], "night", F.col("value") > 50)
    return rates.select("night", "kind", "part", "n", F.round("rate", 9).alias("rate"), "own_n", "own_k")


@query("""
WITH p AS (SELECT p_brand, p_retailprice AS y, CAST(p_size AS DOUBLE) AS x FROM part),
f AS (SELECT p_brand, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt(regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x)) / sqrt(count(*)) AS rms, count(*) AS n FROM p GROUP BY p_brand),
f2 AS (SELECT p_brand, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x)) / count(*)) AS rms, count(*) AS n FROM p JOIN f USING (p_brand) WHERE abs(y - a - b * x) <= 1.6 * f.rms GROUP BY p_brand),
f3 AS (SELECT p_brand, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_slope(y, x)) / count(*)) AS rms, count(*) AS n FROM p JOIN f2 USING (p_brand) WHERE abs(y - a - b * x) <= 1.6 * f2.rms GROUP BY p_brand)
SELECT p_brand, round(a, 5) AS constant, round(b, 7) AS slope, round(rms, 6) AS rms, n FROM f3""")
def rejecting_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by size for each brand, fitted three times without what lies off."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_size")
    fit = fits.rejecting_fit(p, ["p_brand"], "p_retailprice", ["p_size"], clip=1.6, rounds=3)
    return fit.select("p_brand", F.round("constant", 5).alias("constant"), F.round("slope_p_size", 7).alias("slope"), F.round("rms", 6).alias("rms"), "n")


@query("""
WITH c AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY ALL)
SELECT flag, status, round(s / n, 4) AS parameter FROM c""")
def searched_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that makes squared differences least, found by a bounded search over sums; the SQL takes the mean, which it is."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    found = fits.searched(li, ["flag", "status"], lambda a: (F.col("l_quantity") - a) ** 2, 0.0, 60.0, steps=16, rounds=8)
    return found.select("flag", "status", F.round("parameter", 4).alias("parameter"))
