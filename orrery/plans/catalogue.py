"""Queries of catalogue upkeep, listings, positions and names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import sky, text
from orrery.functions.time import micros
from orrery.operators import catalogue, matching, names, upsert
from orrery.operators.images import weighted_update
from orrery.operators.mirrors import Mirror
from orrery.plans.registry import query
from orrery.session import shared_dir, table
from orrery.sources import optional, tiles


@query("""
WITH p AS (SELECT o_custkey AS key, CAST(year(o_orderdate)*12+month(o_orderdate) AS BIGINT) AS hour, o_totalprice AS price, o_orderkey FROM orders),
d AS (SELECT key, hour, max(price) AS price FROM p GROUP BY 1,2), base AS (SELECT min(hour)+3 AS since FROM d),
f AS (SELECT key, since AS hour, arg_max(price, hour) AS price FROM d, base WHERE hour<=since GROUP BY key, since),
h AS (SELECT hour, since, row_number() OVER (ORDER BY hour) AS n FROM (SELECT DISTINCT hour FROM d), base WHERE hour>since),
l AS (SELECT * FROM f UNION ALL SELECT d.* FROM d WHERE hour IN (SELECT hour FROM h WHERE hour=since+n))
SELECT key, max(hour) AS hour, arg_max(price, hour) AS price FROM l GROUP BY 1""")
def delta_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full copy and the deltas of the periods after it, up to the first period that lacks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("hour"), F.col("o_totalprice").alias("price"))
    d = o.groupBy("key", "hour").agg(F.max("price").alias("price"))
    since = d.agg((F.min("hour") + 3).alias("since"))  # one row
    early = d.crossJoin(F.broadcast(since)).filter("hour <= since")
    full = early.groupBy("key").agg(F.max_by("price", "hour").alias("price"), F.max("since").alias("hour")).select("key", "hour", "price")
    return catalogue.apply_deltas(full, d, "key")


@query("""
SELECT vec_id, x, y FROM (SELECT vec_id, round(embedding[1]::DOUBLE*100,6) AS x, round(embedding[2]::DOUBLE*100,6) AS y, embedding[1]::DOUBLE*100 AS a, embedding[2]::DOUBLE*100 AS b FROM embeddings) WHERE (
 (CASE WHEN (b > -10.0) <> (b > -5.0) AND a < -10.0 + (b - -10.0)/5.0*20.0 THEN 1 ELSE 0 END) + (CASE WHEN (b > -5.0) <> (b > 12.0) AND a < 10.0 + (b - -5.0)/17.0*(-8.0) THEN 1 ELSE 0 END)
 + (CASE WHEN (b > 12.0) <> (b > 1.0) AND a < 2.0 + (b - 12.0)/(-11.0)*(-1.0) THEN 1 ELSE 0 END) + (CASE WHEN (b > 1.0) <> (b > -10.0) AND a < 1.0 + (b - 1.0)/(-11.0)*(-11.0) THEN 1 ELSE 0 END)) % 2 = 1""")
def points_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside a concave field outline."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 100).alias("a"), (F.col("embedding")[1].cast("double") * 100).alias("b"))
    inside = catalogue.inside_polygon(F.col("a"), F.col("b"), [(-10.0, -10.0), (10.0, -5.0), (2.0, 12.0), (1.0, 1.0)])
    return p.filter(inside).select("vec_id", F.round("a", 6).alias("x"), F.round("b", 6).alias("y"))


@query("""
WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber, true AS hit FROM lineitem WHERE l_returnflag='R' AND l_discount>0.08),
t AS (SELECT l_suppkey, CASE WHEN hit THEN 'rejected' ELSE l_linestatus END AS status, coalesce(hit,false) AND l_linestatus<>'rejected' AS changed FROM lineitem LEFT JOIN h USING (l_orderkey, l_linenumber))
SELECT l_suppkey, count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE status='rejected') AS rejected, bool_or(changed) AS dirty FROM t GROUP BY 1""")
def bulk_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection's status overwritten, and the parents that have to be built anew."""
    li = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), "l_suppkey", F.col("l_linestatus").alias("status"), "l_returnflag", "l_discount")
    done = catalogue.set_status(li, li.filter("l_returnflag = 'R' and l_discount > 0.08"), "id", "rejected")
    dirty = catalogue.dirty_parents(done, "l_suppkey").withColumn("dirty", F.lit(True))
    per = done.groupBy("l_suppkey").agg(F.count_if("changed").alias("changed"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    return per.join(dirty, "l_suppkey", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))


@query("""
SELECT c_custkey, c_name, count(l_orderkey) AS subs, count(l_orderkey) FILTER (WHERE l_returnflag<>'R') AS good, count(DISTINCT o_orderkey) AS sets, bool_or(s_suppkey IS NOT NULL) AS linked
FROM customer LEFT JOIN orders ON o_custkey=c_custkey LEFT JOIN lineitem ON l_orderkey=o_orderkey LEFT JOIN supplier ON s_suppkey=c_custkey GROUP BY 1,2""")
def objects_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with counts over two fan-outs and whether they are linked; the items are counted per order before the join."""
    c, o, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("g"))
    per = o.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(li, "o_orderkey", "left").groupBy("c_custkey").agg(F.sum("n").alias("subs"), F.sum("g").alias("good"), F.count("*").alias("sets"))
    out = c.join(per, "c_custkey", "left").join(s.select(F.col("s_suppkey").alias("c_custkey"), F.lit(True).alias("linked")), "c_custkey", "left")
    return out.select("c_custkey", "c_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("subs", "good", "sets")], F.coalesce("linked", F.lit(False)).alias("linked"))


@query("""
WITH s AS (SELECT p_partkey, p_brand, p_size, p_retailprice, round(0.6*least(1.0,p_size/50.0)+0.4*(1-least(1.0,abs(p_retailprice-1000)/1000)),8) AS score,
 concat_ws('; ', CASE WHEN p_size<5 THEN 'small' END, CASE WHEN p_retailprice>1800 THEN 'dear' END, CASE WHEN p_type='PROMO' THEN 'promoted' END) AS why FROM part)
SELECT p_partkey, p_brand, score, why, (SELECT count(*) FROM s WHERE why='') AS total FROM s WHERE why='' ORDER BY score DESC, p_partkey LIMIT 50""")
def finder_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates without a reason against them, the best 50 (the page is the feature) with their total."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    score = 0.6 * F.least(F.lit(1.0), size / 50.0) + 0.4 * (1 - F.least(F.lit(1.0), F.abs(price - 1000) / 1000))
    why = F.concat_ws("; ", F.when(size < 5, "small"), F.when(price > 1800, "dear"), F.when(F.col("p_type") == "PROMO", "promoted"))
    kept = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.round(score, 8).alias("score"), why.alias("why")).filter("why = ''")
    return kept.orderBy(F.desc("score"), "p_partkey").limit(50).crossJoin(F.broadcast(kept.agg(F.count("*").alias("total"))))  # one row


@query("""
SELECT p_brand, p_type AS filter, count(*) AS epochs, count(*) FILTER (WHERE good) AS good, round(median(mag) FILTER (WHERE good),6) AS typical FROM (
 SELECT p_brand, p_type, CASE WHEN p_size%7=0 THEN 'nan'::DOUBLE WHEN p_size%11=0 THEN NULL ELSE p_retailprice/100-5 END AS mag, p_size%5 AS flags,
  p_size%5=0 AND p_size%7<>0 AND p_size%11<>0 AND p_retailprice/100-5>0 AND p_partkey%13>1 AS good FROM part) GROUP BY 1,2""")
def good_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs without flags whose magnitude and error are finite and positive."""
    size = F.col("p_size")
    mag = F.when(size % 7 == 0, float("nan")).when(size % 11 != 0, F.col("p_retailprice") / 100 - 5)
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("filter"), sky.finite(mag).alias("mag"), (size % 5).alias("flags"), F.when(F.col("p_partkey") % 13 == 0, float("inf")).otherwise((F.col("p_partkey") % 13 - 1) / 100).alias("error"))
    good = tiles.good_epoch("flags", "mag", "error")
    return p.groupBy("p_brand", "filter").agg(F.count("*").alias("epochs"), F.count_if(good).alias("good"), F.round(F.median(F.when(good, F.col("mag"))), 6).alias("typical"))


@query("""
SELECT cast(ts AS DATE)::VARCHAR AS run, count(*) FILTER (WHERE event_type='view') AS view, count(*) FILTER (WHERE event_type='click') AS click, count(*) FILTER (WHERE event_type='error') AS error,
 count(*) FILTER (WHERE value>=50) AS vetted, count(*) FILTER (WHERE value<5 AND event_type<>'error') AS held, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: candidates of each class, vetted ones, those held back, and the latest change."""
    e = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    kinds = [F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click", "error")]
    out = e.groupBy(F.to_date("ts").cast("string").alias("run")).agg(*kinds, F.count_if(F.col("value") >= 50).alias("vetted"), F.count_if((F.col("value") < 5) & (F.col("event_type") != "error")).alias("held"), F.max_by("event_type", F.struct("us", "event_id")).alias("latest"))
    return out


@query("""
WITH s AS (SELECT user_id%20 AS site, cast(ts AS DATE) AS night, event_type AS filter, value/2-10 AS moon, value+event_id%7 AS sky FROM events), d AS (SELECT *, CASE filter WHEN 'view' THEN 1 WHEN 'click' THEN 2 END AS o FROM s WHERE moon<0 AND filter IN ('view','click')),
p AS (SELECT site, night, o, count(*) AS n, median(sky) AS sky FROM d GROUP BY 1,2,3 HAVING count(*)>=2), f AS (SELECT site, night, arg_min(sky,o) AS sky FROM p GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY night DESC) AS r FROM f)
SELECT site, round(median(sky),2) AS sky, count(*) AS nights FROM r WHERE r<=5 GROUP BY 1""")
def moonfree_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.select((F.col("user_id") % 20).alias("site"), F.to_date("ts").alias("night"), F.col("event_type").alias("filter"), (F.col("value") / 2 - 10).alias("moon_altitude"), (F.col("value") + F.col("event_id") % 7).alias("sky"))
    return catalogue.moonfree_brightness(s, ["view", "click"], least=2, nights=5)


@query("""
SELECT l_returnflag AS filter, arg_max(exposure, (n, -exposure)) AS exposure, max(n) AS most, sum(n)::BIGINT AS used, max(last)::VARCHAR AS last_use FROM (SELECT l_returnflag, CAST(l_quantity AS BIGINT) AS exposure, count(*) AS n, max(cast(l_shipdate AS DATE)) AS last FROM lineitem GROUP BY 1,2) GROUP BY 1""")
def filter_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filter's commonest exposure, how often it is used and when last."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("filter"), F.col("l_quantity").cast("long").alias("exposure")).agg(F.count("*").alias("n"), F.max(F.to_date("l_shipdate")).alias("last"))
    return per.groupBy("filter").agg(F.max_by("exposure", F.struct(F.col("n"), -F.col("exposure"))).alias("exposure"), F.max("n").alias("most"), F.sum("n").alias("used"), F.max("last").cast("string").alias("last_use"))


@query("""
WITH c AS (SELECT user_id, max(CASE WHEN event_type='error' THEN value END) AS motion, max(CASE WHEN event_type='view' THEN value END) AS known, min(CASE WHEN event_type='click' THEN value END) AS image, count(*) FILTER (WHERE event_type='signup') AS pending FROM events GROUP BY 1)
SELECT user_id, CASE WHEN motion>100 THEN 'mover' WHEN known>100 THEN 'known' WHEN image IS NULL THEN 'undecided' WHEN image<1 THEN 'artifact' ELSE 'candidate' END AS verdict,
 CASE WHEN motion>100 AND known>100 THEN 'low' WHEN image IS NULL THEN 'none' ELSE 'high' END AS confidence, pending>0 AS pending FROM c""")
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over the checks of a source: a verdict, how sure it is, and whether checks are pending."""
    of = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(of("error")).alias("motion"), F.max(of("view")).alias("known"), F.min(of("click")).alias("image"), F.count_if(F.col("event_type") == "signup").alias("pending"))
    moving, known, none = F.col("motion") > 100, F.col("known") > 100, F.col("image").isNull()
    verdict = F.when(moving, "mover").when(known, "known").when(none, "undecided").when(F.col("image") < 1, "artifact").otherwise("candidate")
    return c.select("user_id", verdict.alias("verdict"), F.when(moving & known, "low").when(none, "none").otherwise("high").alias("confidence"), (F.col("pending") > 0).alias("pending"))


@query("""
SELECT o_orderpriority AS task, count(*) AS due, count(*) FILTER (WHERE o_orderstatus='F') AS done, count(*) FILTER (WHERE o_orderstatus='P' AND o_totalprice>200000) AS failed, round(count(*) FILTER (WHERE o_orderstatus='F')/count(*),6) AS share FROM orders GROUP BY 1""")
def backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(F.count("*").alias("due"), done.alias("done"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000)).alias("failed"), F.round(done / F.count("*"), 6).alias("share"))


@query("""
WITH p AS (SELECT vec_id, (embedding[1]::DOUBLE*720+3600)%360 AS ra, embedding[2]::DOUBLE*180 AS dec FROM embeddings) SELECT vec_id FROM p WHERE (ra>=350 OR ra<=20) AND dec BETWEEN -10 AND 15""")
def box_over_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in a box that runs over 0 degrees."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("embedding")[0].cast("double") * 720 + 3600) % 360).alias("ra"), (F.col("embedding")[1].cast("double") * 180).alias("dec"))
    return p.filter(sky.in_box("ra", "dec", 350, 20, -10, 15)).select("vec_id")


@query("""
WITH p AS (SELECT vec_id, radians((embedding[1]::DOUBLE+0.5)*360) AS l, radians(embedding[2]::DOUBLE*90) AS b FROM embeddings), v AS (SELECT vec_id, cos(b)*cos(l) AS x, cos(b)*sin(l) AS y, sin(b) AS z FROM p),
w AS (SELECT vec_id, -0.0548755604162154*x+0.4941094278755837*y-0.8676661490190047*z AS x, -0.8734370902348850*x-0.4448296299600112*y-0.1980763734312015*z AS y, -0.4838350155487132*x+0.7469822444972189*y+0.4559837761750669*z AS z FROM v)
SELECT vec_id, round((degrees(atan2(y,x))+360)%360,6) AS ra, round(degrees(asin(greatest(-1,least(1,z)))),6) AS dec FROM w""")
def galactic_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("embedding")[0].cast("double") + 0.5) * 360).alias("l"), (F.col("embedding")[1].cast("double") * 90).alias("b"))
    ra, dec = sky.galactic_to_equatorial("l", "b")
    return p.select("vec_id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query("""
WITH p AS (SELECT vec_id, radians(30+embedding[1]::DOUBLE*4) AS a, radians(20+embedding[2]::DOUBLE*4) AS d, radians(30) AS a0, radians(20) AS d0 FROM embeddings), c AS (SELECT *, sin(d0)*sin(d)+cos(d0)*cos(d)*cos(a-a0) AS k FROM p),
t AS (SELECT vec_id, degrees(cos(d)*sin(a-a0)/k) AS xi, degrees((cos(d0)*sin(d)-sin(d0)*cos(d)*cos(a-a0))/k) AS eta FROM c)
SELECT vec_id, round((0.0006*xi-0.0001*eta)/(-0.0005*0.0006-0.0001*0.0002)+1024,5) AS x, round((-0.0005*eta-0.0002*xi)/(-0.0005*0.0006-0.0001*0.0002)+768,5) AS y FROM t""")
def pixel_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions through a gnomonic plate solution."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", (30 + F.col("embedding")[0].cast("double") * 4).alias("ra"), (20 + F.col("embedding")[1].cast("double") * 4).alias("dec"))
    x, y = sky.sky_to_pixel("ra", "dec", 30.0, 20.0, (1024.0, 768.0), [[-0.0005, 0.0001], [0.0002, 0.0006]])
    return p.select("vec_id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("""
WITH s AS (SELECT c_custkey, c_acctbal/200 AS deg FROM customer), t AS (SELECT c_custkey, deg, CAST(round(abs(deg)*3600) AS BIGINT) AS s FROM s)
SELECT c_custkey, (CASE WHEN deg<0 THEN '-' ELSE '+' END)||lpad((s//3600)::VARCHAR,2,'0')||' '||lpad((s//60%60)::VARCHAR,2,'0')||' '||lpad((s%60)::VARCHAR,2,'0') AS written, round((CASE WHEN deg<0 THEN -1 ELSE 1 END)*s/3600.0,9) AS read FROM t""")
def coordinate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles written as text and read back."""
    written = text.to_sexagesimal(F.col("c_acctbal") / 200)
    return table(spark, sf_dir, "customer").select("c_custkey", written.alias("written")).withColumn("read", F.round(text.sexagesimal(F.col("written")), 9))


@query("""
SELECT event_id, CASE lower(trim(event_type)) WHEN 'view' THEN 'L' WHEN 'click' THEN 'Ha' ELSE event_type END AS filter FROM events""")
def filter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))
    asked = F.when(F.col("event_type").isin("view", "click"), written).otherwise(F.concat(F.lit(" "), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", text.filter_name(asked, {"view": "L", "click": "Ha"}).alias("filter"))


@query("""
WITH w AS (SELECT s_suppkey, 'Blue '||replace(s_name,'#',' ')||' nebula' AS name FROM supplier) SELECT s_suppkey, 'blue '||trim(regexp_replace(lower(replace(s_name,'#',' ')),'[^a-z0-9]+',' ','g')) AS core, name AS base FROM w JOIN supplier USING (s_suppkey)""")
def core_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without generic words, and targets without their panel number."""
    name = F.concat(F.lit("Blue "), F.replace(F.col("s_name"), F.lit("#"), F.lit(" ")), F.lit(" nebula"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.core_name(name).alias("core"), text.strip_panel(F.concat(name, F.lit(" Panel "), (F.col("s_suppkey") % 9).cast("string"))).alias("base"))


_TRIGRAMS = "list_distinct(list_transform(range(1, len({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"
_LADDER = f"""
g AS (SELECT *, {_TRIGRAMS.format('q')} AS t FROM a), h AS (SELECT DISTINCT n, {_TRIGRAMS.format('n')} AS u FROM nm),
j AS (SELECT asked, q, n, len(list_intersect(t, u))::DOUBLE / (len(t) + len(u) - len(list_intersect(t, u))) AS j FROM g, h),
m AS (SELECT asked, n, CASE WHEN q = n THEN 80 WHEN starts_with(n, q) THEN 50 WHEN len(q) >= 3 AND contains(n, q) THEN 35 WHEN len(q) >= 4 AND j >= 0.45 THEN 30 * j END AS score FROM j)"""


@query("WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS asked, split_part(lower(p_name), ' ', 1) AS q FROM part), nm AS (SELECT DISTINCT p_name AS id, lower(p_name) AS n FROM part)," + _LADDER + """
SELECT asked, id AS name, round(score, 8) AS score FROM m JOIN nm USING (n) WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, id) = 1""")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best known name of each asked one, by the ladder from exact to alike."""
    p = table(spark, sf_dir, "part")
    known = p.select(F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("designation"), F.array().cast("array<string>").alias("aliases"), F.lit(0.0).alias("rank")).distinct()
    found = names.name_search(p.select(F.split("p_name", " ")[0].alias("asked")), known, limit=1)
    return found.select("asked", F.col("id").alias("name"), F.round("score", 8).alias("score"))


@query("""WITH o AS (SELECT p_partkey AS id, p_name, p_size FROM part),
a AS (SELECT DISTINCT trim(asked) AS asked, lower(trim(asked)) AS q, CASE WHEN starts_with(asked, 'ngc') THEN 'NGC' || CAST(substr(asked, 5) AS INTEGER) WHEN starts_with(asked, 'Arp') THEN 'ARP' || CAST(substr(asked, 4) AS INTEGER) END AS key
 FROM (SELECT unnest([split_part(p_name, ' ', 1), 'ngc 0' || p_size, replace(p_name, 'l', 'r'), substr(p_name, 2, 5), 'Arp' || p_size % 3]) AS asked FROM part)),
nm AS (SELECT id, lower(p_name) AS n FROM o UNION SELECT id, 'ngc ' || id FROM o UNION SELECT id, 'arp 0' || p_size FROM o), ky AS (SELECT id, 'NGC' || id AS k FROM o UNION SELECT id, 'ARP' || p_size FROM o),""" + _LADDER + """,
w AS (SELECT asked, id, score FROM m JOIN nm USING (n) WHERE score IS NOT NULL UNION ALL SELECT asked, id, 45 FROM a JOIN ky ON len(replace(q, ' ', '')) >= 2 AND starts_with(k, upper(replace(q, ' ', ''))) UNION ALL SELECT asked, min(id), 100 FROM a JOIN ky ON k = key GROUP BY asked)
SELECT asked, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, id) AS INTEGER) AS place, id, round(score, 8) AS score FROM (SELECT asked, id, max(score) + any_value(p_size) / 100 AS score FROM w JOIN o USING (id) GROUP BY asked, id)
QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, id) <= 20""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best objects of designations, words, misspelt names and scraps of them."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    asked = F.array(F.split("p_name", " ")[0], F.concat(F.lit("ngc 0"), size), F.replace("p_name", F.lit("l"), F.lit("r")), F.substring("p_name", 2, 5), F.concat(F.lit("Arp"), (F.col("p_size") % 3).cast("string")))
    objects = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("NGC "), F.col("p_partkey").cast("string")).alias("designation"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("Arp 0"), size)).alias("aliases"), (F.col("p_size") / 100).alias("rank"))
    found = names.name_search(p.select(F.explode(asked).alias("asked")), objects)
    return found.select("asked", "place", "id", F.round("score", 8).alias("score"))


@query("""
SELECT o_orderstatus, bit_xor(o_orderkey) AS keys, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS owners FROM orders GROUP BY 1""")
def mirrored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned mirror published twice, then read: the second publication replaces partitions of the first."""
    import uuid

    path = f"{shared_dir(spark)}/mirror-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    upsert.mirror(path, o.withColumn("o_custkey", F.lit(0).cast(o.schema["o_custkey"].dataType)), "o_orderstatus")
    upsert.mirror(path, o, "o_orderstatus")
    read = spark.read.schema(o.schema).parquet(path)
    return read.groupBy("o_orderstatus").agg(F.bit_xor("o_orderkey").alias("keys"), F.count("*").alias("rows"), F.sum("o_custkey").cast("long").alias("owners"))


@query("""
SELECT 'key' AS matched, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer JOIN supplier ON s_suppkey=c_custkey
UNION ALL SELECT 'place', count(*), CAST(sum(c_custkey) AS BIGINT) FROM (SELECT c_custkey, floor(c_acctbal) AS step, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)) JOIN (SELECT floor(s_acctbal) AS step, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)) x USING (step) WHERE s_nationkey=c_nationkey HAVING count(*)>0""")
def catalogue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues matched by key, the rest by place."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.floor("c_acctbal").alias("step"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation2"), F.floor("s_acctbal").alias("step2"))
    near = lambda a, b: a.join(b.drop("key"), (F.col("nation") == F.col("nation2")) & (F.col("step") == F.col("step2")))
    return matching.cross_match(c, s, ["key"], near).groupBy("matched").agg(F.count("*").alias("n"), F.sum("key").cast("long").alias("keys"))


@query("""
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS level, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by both columns, each of them and neither, with the level of each row."""
    cube = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return cube.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


@query("""
SELECT s_suppkey, count(c_custkey) AS customers, bool_or(c_custkey IS NULL) AS orphan FROM (SELECT * FROM customer WHERE c_acctbal<0) c RIGHT JOIN supplier ON c_nationkey=s_nationkey AND c_custkey=s_suppkey GROUP BY 1""")
def right_join_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the right side, with what matches on the left."""
    c, s = table(spark, sf_dir, "customer").filter("c_acctbal < 0"), table(spark, sf_dir, "supplier")
    both = c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_custkey") == F.col("s_suppkey")), "right")
    return both.groupBy("s_suppkey").agg(F.count("c_custkey").alias("customers"), F.bool_or(F.col("c_custkey").isNull()).alias("orphan"))


@query("""
SELECT a.n_regionkey AS region, a.n_name||'+'||b.n_name AS members, 2 AS size FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_name<b.n_name
UNION ALL SELECT a.n_regionkey, a.n_name||'+'||b.n_name||'+'||c.n_name, 3 FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_name<b.n_name JOIN nation c ON a.n_regionkey=c.n_regionkey AND b.n_name<c.n_name""")
def member_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs and triples of each region's nations, as the bodies of a sky event are combined."""
    r = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_set("n_name")).alias("all"))  # nations: a table of fixed size
    s = r.select("region", F.explode(catalogue.subsets("all", 2, 3)).alias("m"))
    return s.select("region", F.array_join("m", "+").alias("members"), F.size("m").alias("size"))


@query("""
WITH q AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus<>'F')
SELECT o_custkey, o_orderkey, o_orderpriority FROM q WHERE r=1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')""")
def claim_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One waiting task per target, the most urgent and oldest, for targets that nothing works on."""
    o = table(spark, sf_dir, "orders")
    return catalogue.claims(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey", ["o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""
WITH x AS (SELECT o_custkey, bit_xor(o_orderkey) FILTER (WHERE o_orderstatus='F') AS stored, bit_xor(o_orderkey) AS now, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT o_custkey, n, round(total,2) AS total FROM x WHERE stored IS DISTINCT FROM now""")
def checksum_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose inputs no longer have the stored checksum, computed anew."""
    o = table(spark, sf_dir, "orders")
    stored = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.bit_xor("o_orderkey").alias("sum"))
    now = o.groupBy("o_custkey").agg(F.bit_xor("o_orderkey").alias("sum"))
    stale = catalogue.stale_keys(stored, now, "o_custkey", "sum")
    return o.join(stale, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT user_id, cast(ts AS DATE)::VARCHAR AS frame, arg_min(event_id, (abs(value-10), event_id)) AS event_id, round(min(abs(value-10)),6) AS off FROM events WHERE event_type<>'error' AND abs(value-10)<=5 GROUP BY 1,2""")
def nearest_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a frame's detections within reach of a source, the nearest."""
    off = F.abs(F.col("value") - 10)
    e = table(spark, sf_dir, "events").filter((F.col("event_type") != "error") & (off <= 5))
    return e.groupBy("user_id", F.to_date("ts").cast("string").alias("frame")).agg(F.min_by("event_id", F.struct(off, F.col("event_id"))).alias("event_id"), F.round(F.min(off), 6).alias("off"))


@query("""
SELECT l_suppkey, sum(l_quantity)::DOUBLE AS weight, round(sum(l_quantity*l_discount)/sum(l_quantity),9) AS mean,
 round(sum(l_quantity*l_discount*l_discount)/sum(l_quantity)-pow(sum(l_quantity*l_discount)/sum(l_quantity),2),9) AS variance, count(*) AS n FROM lineitem GROUP BY 1""")
def weighted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and variance of each group from sums that merge in any order."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_discount").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("w"))
    return weighted_update(li, ["l_suppkey"], "x", "w").select("l_suppkey", "weight", F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"), "n")


@query("""
WITH p AS (SELECT vec_id, (embedding[1]::DOUBLE+0.5)*360 AS ra, embedding[2]::DOUBLE*80 AS dec, embedding[3]::DOUBLE*5000 AS a, embedding[4]::DOUBLE*5000 AS b FROM embeddings),
q AS (SELECT *, radians(sqrt(a*a+b*b)*25/3.6e6) AS d, atan2(a,b) AS pa, radians(dec) AS d0 FROM p), s AS (SELECT *, greatest(-1,least(1,sin(d0)*cos(d)+cos(d0)*sin(d)*cos(pa))) AS s FROM q)
SELECT vec_id, round(((ra+degrees(atan2(sin(pa)*sin(d)*cos(d0), cos(d)-sin(d0)*s)))%360+360)%360,7) AS ra, round(degrees(asin(s)),7) AS dec FROM s""")
def moved_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions after 25 years of proper motion."""
    at = lambda i: F.col("embedding")[i].cast("double")
    p = table(spark, sf_dir, "embeddings").select("vec_id", ((at(0) + 0.5) * 360).alias("ra"), (at(1) * 80).alias("dec"), (at(2) * 5000).alias("a"), (at(3) * 5000).alias("b"))
    ra, dec = sky.propagated("ra", "dec", "a", "b", F.lit(25.0))
    return p.select("vec_id", F.round(ra, 7).alias("ra"), F.round(dec, 7).alias("dec"))


@query("""
WITH p AS (SELECT vec_id, radians((embedding[1]::DOUBLE+0.5)*360) AS a, radians(embedding[2]::DOUBLE*90) AS d FROM embeddings), v AS (SELECT vec_id, cos(d)*cos(a) AS x, cos(d)*sin(a) AS y, sin(d) AS z FROM p),
w AS (SELECT vec_id, 0.9999256782*x-0.0111820611*y-0.0048579477*z AS x, 0.0111820610*x+0.9999374784*y-0.0000271765*z AS y, 0.0048579479*x-0.0000271474*y+0.9999881997*z AS z FROM v)
SELECT vec_id, round((degrees(atan2(y,x))+360)%360,6) AS ra, round(degrees(asin(greatest(-1,least(1,z)))),6) AS dec FROM w""")
def b1950_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the B1950 frame in that of J2000."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("embedding")[0].cast("double") + 0.5) * 360).alias("ra"), (F.col("embedding")[1].cast("double") * 90).alias("dec"))
    ra, dec = sky.b1950_to_j2000("ra", "dec")
    return p.select("vec_id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


@query("""
SELECT l_shipmode AS file, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(sum(l_orderkey) AS BIGINT) AS keys, count(*) FILTER (WHERE l_linestatus = 'new') AS fresh
FROM (SELECT CAST(l_suppkey % 7 AS VARCHAR) AS l_shipmode, l_quantity, l_orderkey, 'new' AS l_linestatus FROM lineitem) GROUP BY 1""")
def versioned_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version built in two runs, the first cut short, over one that was there."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).cast("string").alias("file"), "l_quantity", "l_orderkey")
    m = Mirror(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/mirror-{uuid.uuid4().hex}", "file")
    m.build(li.withColumn("status", F.lit("old")), 1)
    new = li.withColumn("status", F.lit("new"))
    m.build(new, 2, limit=3)
    m.build(new, 2)
    return m.read(verify=True).groupBy("file").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"), F.sum("l_orderkey").alias("keys"), F.count_if(F.col("status") == "new").alias("fresh"))


@query("""
WITH p AS (SELECT p_partkey, p_size * 60.0 - 1024 AS dx, (p_partkey % 997) * 2.0 - 768 AS dy, radians(30) AS a0, radians(20) AS d0 FROM part), t AS (SELECT p_partkey, a0, d0, radians(-0.0005*dx+0.0001*dy) AS x, radians(0.0002*dx+0.0006*dy) AS y FROM p)
SELECT p_partkey, round(degrees(a0 + atan2(x, cos(d0)-y*sin(d0))), 8) AS ra, round(degrees(atan2(sin(d0)+y*cos(d0), sqrt(x*x+pow(cos(d0)-y*sin(d0), 2)))), 8) AS dec FROM t""")
def sky_of_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a plate as positions: the way back of ``pixel_positions``."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60.0).alias("x"), ((F.col("p_partkey") % 997) * 2.0).alias("y"))
    ra, dec = sky.pixel_to_sky("x", "y", 30.0, 20.0, (1024.0, 768.0), [[-0.0005, 0.0001], [0.0002, 0.0006]])
    return p.select("p_partkey", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"))


@query("""SELECT s_suppkey, s_acctbal, NULL::VARCHAR AS s_note, s_acctbal AS balance FROM supplier""")
def optional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that the table lacks is null, and a table that isn't there overrides nothing."""
    s = optional.optional_table(spark, f"{sf_dir}/supplier.parquet", {"s_suppkey": "long", "s_acctbal": "double", "s_note": "string"})
    other = optional.optional_table(spark, f"{sf_dir}/overrides.parquet", {"s_suppkey": "long", "balance": "double"})
    return s.join(other, "s_suppkey", "left").withColumn("balance", F.coalesce("balance", "s_acctbal"))
