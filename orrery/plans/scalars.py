"""Queries of text, name, sky and nested-value functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import sky, text
from orrery.functions.time import micros, mjd
from orrery.operators import matching
from orrery.plans.registry import query
from orrery.session import table

_NORM = "trim(regexp_replace(replace(lower({}),'&',' and '),'[^a-z0-9]+',' ','g'))"


@query(f"""
SELECT c_custkey, {_NORM.format('c_name')} AS normal, regexp_replace(regexp_replace(lower(c_name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') AS slug, cast(regexp_extract(c_name,'#0*(\\d+)',1) AS BIGINT) AS number FROM customer""")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", text.normal_name(name).alias("normal"), text.slug(name).alias("slug"), F.regexp_extract(name, r"#0*(\d+)", 1).cast("long").alias("number"))


@query("""
SELECT p_partkey, CASE WHEN p_size%3=0 AND p_size BETWEEN 1 AND 110 THEN 'M '||p_size WHEN p_size%3=1 AND p_partkey BETWEEN 1 AND 9999 THEN 'NGC '||p_partkey ELSE NULL END AS designation FROM part""")
def designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical designations of names written in several ways."""
    written = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("messier 0"), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" ngc00"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.designation(written).alias("designation"))


@query("""
WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, list_distinct(list_transform(range(1, len(p_name)+2), lambda i: substr('  '||p_name||' ', i, 3))) AS t FROM n)
SELECT a.p_name AS name, b.p_name AS other, round(len(list_intersect(a.t,b.t))::DOUBLE/(len(a.t)+len(b.t)-len(list_intersect(a.t,b.t))),8) AS likeness FROM g a JOIN g b ON a.p_name<b.p_name WHERE len(list_intersect(a.t,b.t))::DOUBLE/(len(a.t)+len(b.t)-len(list_intersect(a.t,b.t))) >= 0.45""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names whose trigrams agree by 0.45 or more.

    Names that agree so far share one of their rarest trigrams: all but
    ceil(0.45 n) - 1 of them. The equi-join is on these, so frequent trigrams
    hardly meet.
    """
    least = 0.45
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("t", text.trigrams(F.col("name")))
    grams = n.select("name", F.explode("t").alias("gram"))
    ranked = grams.join(grams.groupBy("gram").agg(F.count("*").alias("names")), "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("names", "gram"))).alias("r"))
    size = F.size("r")
    rare = ranked.select("name", F.col("r.gram").alias("t"), F.explode(F.slice("r", F.lit(1), size - F.ceil(least * size - 1e-9).cast("int") + 1)).alias("g")).select("name", "t", "g.gram")
    both = rare.join(rare.select(F.col("name").alias("other"), F.col("t").alias("u"), "gram"), "gram")
    both = both.filter((F.col("name") < F.col("other")) & (F.size("t") >= least * F.size("u")) & (F.size("u") >= least * F.size("t")))
    # a pair is kept at the first rare trigram that both have
    shared = F.size(F.array_intersect("t", "u"))
    likeness = shared / (F.size("t") + F.size("u") - shared)
    return both.filter(F.col("gram") == F.array_intersect("t", "u")[0]).withColumn("likeness", likeness).filter(F.col("likeness") >= least).select("name", "other", F.round("likeness", 8).alias("likeness"))


@query("""
SELECT page_id, regexp_extract(url,'^https?://([^/]+)',1) AS host, string_split(url,'/')[-1] AS base, regexp_extract(html,'<title>([^<]*)</title>',1) AS title, len(regexp_extract_all(html,'<a href="([^"]*)"',1)) AS links FROM pages""")
def page_scraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, last path part, title and links of pages."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), text.base_name(F.col("url")).alias("base"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"),
    )


@query("""
SELECT page_id, regexp_replace(substr(html,1,500),'(<[^>]*|&[^;\\s]{0,10})$','') AS head FROM pages""")
def cut_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.cut_html(F.col("html"), 500).alias("head"))


@query("""
SELECT user_id, cast(json_extract(props,'$.k') AS BIGINT)%5 AS k, count(*) AS n FROM events GROUP BY 1,2""")
def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("meta", F.from_json("props", "k long"))
    return e.groupBy("user_id", (F.col("meta.k") % 5).alias("k")).agg(F.count("*").alias("n"))


@query("""
SELECT event_id, CASE WHEN event_id%4=0 THEN value WHEN event_id%4=1 THEN value ELSE NULL END AS parsed FROM events""")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written plainly, quoted, as "NaN" or not at all, out of JSON text."""
    v = F.col("value").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit('{"x": '), v, F.lit("}")), F.concat(F.lit('{"x": "'), v, F.lit('"}')), F.lit('{"x": "NaN"}'), F.lit('{"y": 1}')), (F.col("event_id") % 4 + 1).cast("int"))
    x = F.get_json_object(raw, "$.x").try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", sky.finite(x).alias("parsed"))


@query("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE*180 AS ra, embedding[2]::DOUBLE*90 AS dec FROM embeddings)
SELECT vec_id, round(degrees(2*asin(sqrt(least(1, pow(sin(radians(20-dec)/2),2)+cos(radians(dec))*cos(radians(20))*pow(sin(radians(350-ra)/2),2))))),7) AS separation,
 round(degrees(asin(sin(radians(48))*sin(radians(dec))+cos(radians(48))*cos(radians(dec))*cos(radians(100-ra)))),7) AS altitude FROM p""")
def sky_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 180).alias("ra"), (F.col("embedding")[1].cast("double") * 90).alias("dec"))
    h = F.radians(100 - F.col("ra"))
    alt = F.degrees(F.asin(F.sin(F.radians(F.lit(48.0))) * F.sin(F.radians("dec")) + F.cos(F.radians(F.lit(48.0))) * F.cos(F.radians("dec")) * F.cos(h)))
    return p.select("vec_id", F.round(sky.separation("ra", "dec", 350.0, 20.0), 7).alias("separation"), F.round(alt, 7).alias("altitude"))


@query("""
WITH p AS (SELECT vec_id, (embedding[1]::DOUBLE+0.5)*360 AS ra, greatest(-89.9,least(89.9,embedding[2]::DOUBLE*200)) AS dec FROM embeddings),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, degrees(2*asin(sqrt(least(1, pow(sin(radians(b.dec-a.dec)/2),2)+cos(radians(a.dec))*cos(radians(b.dec))*pow(sin(radians(b.ra-a.ra)/2),2))))) AS s FROM p a JOIN p b ON a.vec_id<b.vec_id)
SELECT a, b, round(s,6) AS separation FROM d WHERE s<=3""")
def cone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of positions within 3 degrees, by bands and cells, around 0/360 and the poles."""
    dec = F.greatest(F.lit(-89.9), F.least(F.lit(89.9), F.col("embedding")[1].cast("double") * 200))
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), ((F.col("embedding")[0].cast("double") + 0.5) * 360).alias("ra"), dec.alias("dec"))
    other = p.select(F.col("a").alias("b"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    return matching.cone_join(p, other, 3.0).filter("a < b").select("a", "b", F.round("separation", 6).alias("separation"))


@query("""
WITH p AS (SELECT vec_id, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings)
SELECT a, b, round(d,8) AS distance FROM (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), b.vec_id) rn FROM p a JOIN p b ON a.vec_id<>b.vec_id) WHERE rn=1 AND d<=0.02""")
def nearest_in_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding")[2].cast("double").alias("x"), F.col("embedding")[3].cast("double").alias("y"))
    return matching.nearest_within(p, 0.02, id_col="a").select("a", F.col("other").alias("b"), F.round("distance", 8).alias("distance"))


@query("""
SELECT label, i, round(avg(x),7) AS mean, round(median(x),7) AS middle FROM (SELECT label, unnest(range(0,64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1,2""")
def ranks_against_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array places aggregated over rows: the reference array of each label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return e.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("x"), 7).alias("mean"), F.round(F.median("x"), 7).alias("middle"))


@query("""
WITH r AS (SELECT label, i, median(x) AS m FROM (SELECT label, unnest(range(0,64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1,2),
e AS (SELECT vec_id, label, unnest(range(0,64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, round(median(x/m),5) AS ratio FROM e JOIN r USING (label,i) WHERE m>0.05 AND x>0 GROUP BY 1""")
def rank_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median ratio of a row's places to its label's reference, places of a small reference left out."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    r = e.groupBy("label", "i").agg(F.median("x").alias("m")).filter("m > 0.05")
    return e.filter("x > 0").join(r, ["label", "i"]).groupBy("vec_id").agg(F.round(F.median(F.col("x") / F.col("m")), 5).alias("ratio"))


@query("""
SELECT event_id, cast(bits AS BIGINT) AS bits, cast(bit_count(bits) AS BIGINT) AS layers, (bits & 4) <> 0 AS third FROM (SELECT event_id, (CASE WHEN value>20 THEN 1 ELSE 0 END)|(CASE WHEN value>50 THEN 2 ELSE 0 END)|(CASE WHEN event_type='error' THEN 4 ELSE 0 END)|(1<<(event_id%8)) AS bits FROM events)""")
def mask_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c, b: F.when(c, b).otherwise(0)
    bits = one(F.col("value") > 20, 1).bitwiseOR(one(F.col("value") > 50, 2)).bitwiseOR(one(F.col("event_type") == "error", 4)).bitwiseOR(F.expr("shiftleft(1, cast(event_id % 8 as int))")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", bits.alias("bits")).select("event_id", "bits", F.bit_count("bits").cast("long").alias("layers"), (F.col("bits").bitwiseAND(4) != 0).alias("third"))


@query("""
SELECT event_id, round(40587 + epoch_us(ts)/86400000000.0, 9) AS mjd, round((280.459+0.98564736*(40587+epoch_us(ts)/86400000000.0-51544.5))%360, 6) AS mean_longitude FROM events""")
def julian_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mjd(micros("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(m, 9).alias("mjd"), F.round((280.459 + 0.98564736 * (m - 51544.5)) % 360, 6).alias("mean_longitude"))


@query("""
SELECT l_orderkey, l_linenumber, round(-2.5*log10(l_extendedprice),6) AS magnitude, round(25+l_quantity/10.0,0) AS rounded, cast(cast(l_discount AS FLOAT) AS VARCHAR)::DOUBLE AS shortest FROM lineitem""")
def magnitudes_and_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(sky.magnitude("l_extendedprice"), 6).alias("magnitude"), F.round(25 + F.col("l_quantity") / 10.0, 0).alias("rounded"), sky.decimal("l_discount").alias("shortest"))


@query("""
SELECT doc_id, len(regexp_extract_all(text,'[.!?]')) AS stops, md5(lower(trim(text))) AS digest FROM documents""")
def document_scraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[.!?]"), F.lit(0))).cast("long").alias("stops"), F.md5(F.lower(F.trim("text")).cast("binary")).alias("digest"))
