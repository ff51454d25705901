"""Composite queries of an observatory, on frames and targets made of the driver's tables.

Events stand in for frames (their kind, setup and object follow from type, user
and id), suppliers for targets, orders for observing plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import sky
from orrery.functions.time import micros
from orrery.operators import calibration, finds, upsert
from orrery.plans.registry import query
from orrery.session import table

_FRAMES = """
WITH frames AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'LIGHT' WHEN 'click' THEN 'DARK' WHEN 'purchase' THEN 'FLAT' WHEN 'signup' THEN 'BIAS' ELSE 'LIGHT' END AS kind,
 'obj'||(user_id%12) AS object, cast(ts AS DATE) AS night, epoch_us(ts)/1e6 AS secs, CASE WHEN event_type='signup' THEN 0.0 WHEN event_type='error' AND user_id%2=0 THEN 300.0 ELSE 60.0*(1+user_id%3) END AS exposure,
 CASE WHEN user_id%10=9 THEN NULL ELSE 50.0*(user_id%4) END AS gain, CASE WHEN user_id%7=6 THEN 20.0 ELSE 10.0 END AS "offset", CASE WHEN user_id%9=8 THEN NULL ELSE -10.0+5*(user_id%3) END AS set_temp, CASE WHEN user_id%6=5 THEN 2 ELSE 1 END AS bin_x,
 CASE WHEN user_id%5=0 THEN 'R' ELSE 'L' END AS filter, CASE WHEN user_id%8<>3 THEN (user_id*37%24)*15.0 + CASE WHEN event_type='purchase' THEN user_id%3 ELSE 0 END END AS rotator FROM events),
lib AS (SELECT *, sum(new) OVER (PARTITION BY kind, exposure, gain, "offset", set_temp, bin_x ORDER BY secs, id ROWS UNBOUNDED PRECEDING) AS session FROM
 (SELECT *, CASE WHEN secs - lag(secs) OVER (PARTITION BY kind, exposure, gain, "offset", set_temp, bin_x ORDER BY secs, id) > 129600 THEN 1 ELSE 0 END AS new FROM frames WHERE kind IN ('DARK','BIAS'))),
sets AS (SELECT kind, exposure, gain, "offset", set_temp, bin_x, session, count(*) AS frames, min(night) AS first_night, max(night) AS night, max(secs) AS until FROM lib GROUP BY ALL),
lights AS (SELECT *, row_number() OVER () AS gid FROM (SELECT object, night, filter, exposure, gain, "offset", set_temp, bin_x, rotator, count(*) AS lights FROM frames WHERE kind='LIGHT' GROUP BY ALL)),
dp AS (SELECT gid, s.frames, s.exposure AS dark_exposure, abs(l.night-s.night) AS nights, coalesce(abs(l.set_temp-s.set_temp),10) AS off, abs(l.exposure-s.exposure)<=0.01*l.exposure AS same, abs(l.exposure-s.exposure)<=0.01*l.exposure AND coalesce(abs(l.set_temp-s.set_temp)<=1, false) AS exact
  FROM lights l JOIN sets s ON s.kind='DARK' AND l.gain IS NOT DISTINCT FROM s.gain AND l."offset"=s."offset" AND l.bin_x=s.bin_x WHERE s.frames>=3 AND coalesce(abs(l.set_temp-s.set_temp),10)<=10 AND s.exposure>0),
darks AS (SELECT gid, arg_min(exact, (NOT (frames >= CASE WHEN dark_exposure>=120 THEN 10 ELSE 25 END AND exact), off, NOT same, -dark_exposure, nights)) AS exact FROM dp GROUP BY 1)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, kinds = F.col("user_id"), {"click": "DARK", "purchase": "FLAT", "signup": "BIAS"}
    kind = F.lit("LIGHT")
    for name, k in kinds.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), kind.alias("kind"), F.concat(F.lit("obj"), (u % 12).cast("string")).alias("object"), F.to_date("ts").alias("night"), (micros("ts") / 1e6).alias("at"), F.when(u % 5 == 0, "R").otherwise("L").alias("filter"),
        F.when(F.col("event_type") == "signup", 0.0).when((F.col("event_type") == "error") & (u % 2 == 0), 300.0).otherwise(60.0 * (1 + u % 3)).alias("exposure"), F.when(u % 10 != 9, 50.0 * (u % 4)).alias("gain"), F.when(u % 7 == 6, 20.0).otherwise(10.0).alias("offset"),
        F.when(u % 9 != 8, -10.0 + 5 * (u % 3)).alias("set_temp"), F.when(u % 6 == 5, 2).otherwise(1).alias("bin_x"),
        F.when(u % 8 != 3, (u * 37 % 24) * 15.0 + F.when(F.col("event_type") == "purchase", u % 3).otherwise(0)).alias("rotator"),
    )


@query(_FRAMES + "SELECT kind, exposure, gain, set_temp, frames, cast(first_night AS VARCHAR) AS first_night, cast(night AS VARCHAR) AS night FROM sets")
def calibration_set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calibration.calibration_sets(frames(spark, sf_dir)).filter("kind <> 'FLAT'")
    return s.select("kind", "exposure", "gain", "set_temp", "frames", F.col("first_night").cast("string").alias("first_night"), F.col("night").cast("string").alias("night"))


@query(_FRAMES + """SELECT object, cast(night AS VARCHAR) AS night, exposure, gain, set_temp, lights, CASE WHEN d.gid IS NULL THEN 'missing' WHEN d.exact THEN 'exact' ELSE 'fallback' END AS grade FROM lights LEFT JOIN darks d USING (gid)""")
def dark_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a dark fits each group of lights."""
    f = frames(spark, sf_dir)
    groups = calibration.light_groups(f)
    chosen = groups.join(calibration.choose_darks(groups, calibration.calibration_sets(f)), "group_id", "left")
    return chosen.select("object", F.col("night").cast("string").alias("night"), "exposure", "gain", "set_temp", "lights", F.coalesce("dark_grade", F.lit("missing")).alias("grade"))


@query(_FRAMES + """
, need AS (SELECT gain, "offset", round(set_temp/5)*5 AS rung, exposure, cast(sum(lights) AS BIGINT) AS lights, count(DISTINCT night) AS nights FROM lights WHERE gain IS NOT NULL AND set_temp IS NOT NULL GROUP BY ALL)
SELECT gain, rung, exposure, lights, nights FROM need n WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.kind='DARK' AND s.frames>=3 AND s.gain=n.gain AND s."offset"=n."offset" AND abs(s.set_temp-n.rung)<=1 AND abs(s.exposure-n.exposure)<=0.01*n.exposure)""")
def dark_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.dark_gaps(frames(spark, sf_dir)).select("gain", "rung", "exposure", "lights", "nights")


_CHOSEN = _FRAMES + """
, biases AS (SELECT gid, arg_min(s, (abs(s.night-l.night), l.night-s.night, -s.frames, -s.until)) AS b, min(abs(s.night-l.night)) = 0 AS exact FROM lights l JOIN sets s ON s.kind='BIAS' AND s.frames>=3 AND l.gain IS NOT DISTINCT FROM s.gain AND l."offset"=s."offset" AND l.bin_x=s.bin_x GROUP BY 1)
"""


@query(_CHOSEN + """
, fs AS (SELECT filter, gain, "offset", night, bin_x, round(rotator) AS rotator FROM frames WHERE kind='FLAT' GROUP BY filter, gain, "offset", night, bin_x, object, exposure, set_temp, round(rotator) HAVING count(*)>=3),
fp AS (SELECT gid, s.night - l.night AS nights, l.rotator IS NULL OR s.rotator IS NULL OR least(abs(l.rotator-s.rotator)%360, 360-abs(l.rotator-s.rotator)%360)<=1.5 AS fits, least(abs(l.rotator-s.rotator)%360, 360-abs(l.rotator-s.rotator)%360) AS angle,
  l.gain IS NOT DISTINCT FROM s.gain AND l."offset"=s."offset" AS same FROM lights l JOIN fs s USING (filter, bin_x)),
flats AS (SELECT gid, arg_min(fits AND same AND nights=0, (NOT fits, CASE WHEN fits THEN 0 ELSE angle END, NOT same, abs(nights), -nights)) AS exact FROM fp GROUP BY 1)
SELECT object, cast(night AS VARCHAR) AS night, exposure, gain, set_temp, lights, CASE WHEN d.gid IS NULL THEN 'missing' WHEN d.exact THEN 'exact' ELSE 'fallback' END AS dark_grade,
 CASE WHEN f.gid IS NULL THEN 'missing' WHEN f.exact THEN 'exact' ELSE 'fallback' END AS flat_grade, CASE WHEN b.gid IS NULL THEN 'missing' WHEN b.exact THEN 'exact' ELSE 'fallback' END AS bias_grade
FROM lights g LEFT JOIN darks d ON d.gid=g.gid LEFT JOIN flats f ON f.gid=g.gid LEFT JOIN biases b ON b.gid=g.gid""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark, flat and bias of every group of lights."""
    c = calibration.coverage(frames(spark, sf_dir))
    return c.select("object", F.col("night").cast("string").alias("night"), "exposure", "gain", "set_temp", "lights", "dark_grade", "flat_grade", "bias_grade")


@query(_CHOSEN + """
, last AS (SELECT gain, "offset", bin_x, max(until) AS full_until FROM sets WHERE kind='BIAS' AND frames>=30 GROUP BY ALL),
w AS (SELECT l.gain, l."offset", l.bin_x, night, lights, b.gid IS NULL AS missing, b.gid IS NOT NULL AND b.b.frames<30 AND NOT coalesce(full_until > b.b.until, false) AS thin FROM lights l LEFT JOIN biases b USING (gid) LEFT JOIN last USING (gain, "offset", bin_x) WHERE l.gain IS NOT NULL),
per AS (SELECT gain, "offset", bin_x, sum(CASE WHEN missing THEN lights ELSE 0 END)::BIGINT AS missing, sum(CASE WHEN thin THEN lights ELSE 0 END)::BIGINT AS thin, max(CASE WHEN missing OR thin THEN night END) AS latest FROM w GROUP BY 1,2,3)
SELECT gain, missing, thin, row_number() OVER (ORDER BY missing DESC, thin DESC, latest DESC, gain, "offset", bin_x) AS priority FROM per WHERE missing>0 OR thin>0""")
def bias_backlog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera setups in want of biases."""
    return calibration.bias_backlog(frames(spark, sf_dir)).select("gain", "missing", "thin", "priority")


@query("""
WITH a AS (SELECT o_orderkey AS key, o_orderstatus AS etag FROM orders), b AS (SELECT l_orderkey AS key, max(l_linestatus) AS etag FROM lineitem WHERE l_returnflag<>'R' GROUP BY 1 UNION ALL SELECT -c_custkey, c_mktsegment FROM customer)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key=b.key WHERE a.etag IS DISTINCT FROM b.etag) GROUP BY 1""")
def inventory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing against the stored inventory: new, changed and vanished keys."""
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("etag"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_linestatus").alias("etag"))
    listed = lines.unionByName(table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("key"), F.col("c_mktsegment").alias("etag")))
    return upsert.inventory_changes(stored, listed).groupBy("change").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT s_suppkey, (s_suppkey*37)%360 AS ra, ((s_suppkey*17)%120)-30 AS dec FROM supplier), g AS (SELECT t.*, 60000 + k/24.0 AS mjd FROM t, range(0,24) r(k))
SELECT s_suppkey, count(*) FILTER (WHERE degrees(asin(sin(radians(45))*sin(radians(dec))+cos(radians(45))*cos(radians(dec))*cos(radians(((280.46061837+360.98564736629*(mjd-51544.5)+10) % 360)-ra)))) >= 30) AS hours FROM g GROUP BY 1""")
def hours_above_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a day for which each target stands over 30 degrees."""
    s = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select("s_suppkey", ((s * 37) % 360).cast("double").alias("ra"), ((s * 17) % 120 - 30).cast("double").alias("dec"))
    g = t.withColumn("mjd", F.explode(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: 60000 + k / 24.0)))
    up = sky.altitude("ra", "dec", "mjd", 45.0, 10.0) >= 30
    return g.groupBy("s_suppkey").agg(F.count_if(up).alias("hours"))


@query("""
WITH c AS (SELECT l_partkey%50 AS k, l_linenumber*30.0 AS exposure, avg(1-l_discount) AS noise_share, avg(l_tax)*100 AS overhead, avg(l_quantity)/50 AS kept FROM lineitem GROUP BY 1,2),
e AS (SELECT *, noise_share*exposure/(exposure+overhead)*kept AS eff, max(noise_share*exposure/(exposure+overhead)*kept) OVER (PARTITION BY k) AS best FROM c)
SELECT k, min(exposure) AS exposure, round(arg_min(eff, exposure),8) AS efficiency FROM e WHERE sqrt(eff/best)>=0.95 GROUP BY 1""")
def exposure_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest exposure near the best efficiency."""
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("k"), (F.col("l_linenumber") * 30.0).alias("exposure")).agg(F.avg(1 - F.col("l_discount")).alias("noise_share"), (F.avg("l_tax") * 100).alias("overhead"), (F.avg("l_quantity") / 50).alias("kept"))
    r = finds.recommended_exposures(c.withColumn("blocked", F.lit(False)), ["k"])
    return r.select("k", "exposure", F.round("efficiency", 8).alias("efficiency"))


@query("""
SELECT c_nationkey, bit_xor(('0x'||substr(md5(c),1,15))::BIGINT) AS document, cast(sum(n) AS BIGINT) AS plans FROM (SELECT c_nationkey, c_custkey, c_custkey||':'||coalesce(string_agg(o_orderkey||'/'||o_orderstatus, ',' ORDER BY o_orderkey),'') AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1,2) GROUP BY 1""")
def planning_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer with its orders, and by nation a digest of them in any order."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    plans = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("plans"))
    text = F.array_join(F.transform("plans", lambda p: F.concat(p["o_orderkey"].cast("string"), F.lit("/"), p["o_orderstatus"])), ",")
    one = c.join(plans, "c_custkey", "left").select("c_nationkey", "c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(":"), F.coalesce(text, F.lit(""))).alias("c"), F.coalesce(F.size("plans"), F.lit(0)).alias("n"))
    digest = F.conv(F.substring(F.md5(F.col("c").cast("binary")), 1, 15), 16, 10).cast("long")
    return one.groupBy("c_nationkey").agg(F.bit_xor(digest).alias("document"), F.sum(F.greatest(F.col("n"), F.lit(0))).cast("long").alias("plans"))


@query("""
WITH d AS (SELECT user_id, cast(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1,2), c AS (SELECT day, count(*) FILTER (WHERE n>=2) AS busy FROM d GROUP BY 1)
SELECT month(day) AS month, count(*) AS days, count(*) FILTER (WHERE busy>=20) AS clear, round(median(busy),4) AS typical FROM c GROUP BY 1""")
def clear_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    c = d.groupBy("day").agg(F.count_if(F.col("n") >= 2).alias("busy"))
    return c.groupBy(F.month("day").cast("long").alias("month")).agg(F.count("*").alias("days"), F.count_if(F.col("busy") >= 20).alias("clear"), F.round(F.median("busy"), 4).alias("typical"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT greatest(a.vec_id,b.vec_id) AS u, least(a.vec_id,b.vec_id) AS v FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id AND sqrt(pow(a.embedding[1]::DOUBLE-b.embedding[1]::DOUBLE,2)+pow(a.embedding[2]::DOUBLE-b.embedding[2]::DOUBLE,2))<=0.004),
w AS (SELECT u AS x, v AS y FROM e UNION SELECT v, u FROM e), r AS (SELECT x AS node, x AS reach FROM w UNION SELECT r.node, w.y FROM r JOIN w ON w.x=r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained neighbours in the plane as one entity each."""
    from orrery.operators.entity import connected_components
    from orrery.operators.matching import cell_join

    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    near = cell_join(p, p.select(F.col("a").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2")), 0.004).filter("a < b")
    return connected_components(near.select("a", "b"))
