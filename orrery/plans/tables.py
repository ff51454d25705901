"""Queries of joins, aggregates, set operations and write semantics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.time import micros
from orrery.operators import matching, stats, upsert
from orrery.plans.registry import query
from orrery.session import table


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue,
  round(avg(l_discount),8) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-01-01' GROUP BY 1,2""")
def group_by_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered group-by with several aggregates; the filter reaches the scan."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count("*").alias("n")
    )


@query("""
SELECT c_custkey, count(o_orderkey) AS orders, count(l.l_orderkey) AS items, count(*) FILTER (WHERE l.l_returnflag='R') AS returned,
  count(DISTINCT o_orderdate) AS days FROM customer LEFT JOIN orders ON o_custkey=c_custkey LEFT JOIN lineitem l ON l.l_orderkey=o_orderkey GROUP BY 1""")
def fan_out_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over two one-to-many left joins, of join rows, not of distinct ones."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    joined = c.select("c_custkey").join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("o_custkey") == F.col("c_custkey"), "left").join(li.select("l_orderkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("orders"), F.count("l_orderkey").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.countDistinct("o_orderdate").alias("days")
    )


@query("""
SELECT count(*) AS customers, round(median(total),4) AS median_total FROM
 (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 1000000)""")
def having_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).filter("total >= 1000000")
    found = stats.exact_percentiles(totals, [], "total", {"median_total": 0.5})
    return found.select(F.coalesce("n", F.lit(0)).alias("customers"), F.round("median_total", 4).alias("median_total"))


@query("""
SELECT cast(round(l_quantity/10) AS BIGINT) AS step, count(*) AS n, round(max(l_extendedprice),2) AS top FROM lineitem GROUP BY 1""")
def group_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.round(F.col("l_quantity") / 10).cast("long").alias("step")).agg(F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 2).alias("top"))


@query("""
SELECT o_orderkey, o_orderpriority FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey=o.o_orderkey AND l.l_returnflag='R')
 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey=o.o_orderkey AND l.l_quantity>45)""")
def exists_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    kept = o.join(li.filter("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(li.filter("l_quantity > 45"), "o_orderkey", "left_anti")
    return kept.select("o_orderkey", "o_orderpriority")


@query("""
SELECT n_name, c_custkey, o_orderkey FROM nation JOIN customer ON c_nationkey=n_nationkey LEFT JOIN orders ON o_custkey=c_custkey AND o_orderstatus='P'""")
def join_condition_in_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    both = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return both.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "P"), "left").select("n_name", "c_custkey", "o_orderkey")


@query("""
SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_brand IN ('Brand#1','Brand#3') AND p_size BETWEEN 10 AND 30 AND p_type IS NOT NULL""")
def predicate_chain_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.filter(F.col("p_brand").isin("Brand#1", "Brand#3") & F.col("p_size").between(10, 30) & F.col("p_type").isNotNull()).select("p_brand", "p_type", "p_size").distinct()


@query("""
SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal),2) AS balance FROM region JOIN nation ON n_regionkey=r_regionkey JOIN customer ON c_nationkey=n_nationkey
 GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    joined = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows at any size
    return joined.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
SELECT c_custkey, 'no orders' AS why FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT c_custkey, 'both' FROM (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus='F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus='P')
UNION ALL SELECT c_custkey, 'only open' FROM (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus='O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus<>'O')""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    none = c.select("c_custkey").join(o, "c_custkey", "left_anti").withColumn("why", F.lit("no orders"))
    of = lambda cond: o.filter(cond).select("c_custkey")
    both = of("o_orderstatus = 'F'").intersect(of("o_orderstatus = 'P'")).withColumn("why", F.lit("both"))
    only = of("o_orderstatus = 'O'").subtract(of("o_orderstatus <> 'O'")).withColumn("why", F.lit("only open"))
    return none.unionByName(both).unionByName(only)


@query("""
SELECT s_suppkey, c_custkey, round(abs(s_acctbal-c_acctbal),2) AS off FROM (
 SELECT s_suppkey, s_acctbal, c_custkey, c_acctbal, row_number() OVER (PARTITION BY s_suppkey ORDER BY (c_mktsegment<>'BUILDING'), abs(s_acctbal-c_acctbal), c_custkey) rn
 FROM supplier LEFT JOIN customer ON c_nationkey=s_nationkey AND abs(s_acctbal-c_acctbal)<=5000) WHERE rn=1""")
def ranked_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicographic preference: an exact kind first, then the nearest, ties to the least key; none is kept as missing."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_nationkey").alias("nation"))
    found = s.withColumn("at", F.col("s_acctbal"))
    for name, kind in (("first", F.col("c_mktsegment") == "BUILDING"), ("second", ~F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False)))):
        of_kind = c.filter(kind).select("nation", F.col("c_acctbal").alias("at"), F.col("c_custkey").alias(name))
        found = matching.nearest(found, of_kind, ["nation"], "at", name, later=False).withColumn(name, F.when(F.col("distance") <= 5000, F.struct(F.col(name).alias("c_custkey"), F.round("distance", 2).alias("off")))).drop("distance")
    return found.select("s_suppkey", F.coalesce("first", "second").alias("best")).select("s_suppkey", "best.c_custkey", "best.off")


@query("""
WITH t AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier)
SELECT c_custkey, coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN a.s_suppkey IS NOT NULL THEN 'key' WHEN b.s_suppkey IS NOT NULL THEN 'nation' END AS method
FROM customer LEFT JOIN t a ON a.s_suppkey=c_custkey LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM t GROUP BY 1 HAVING count(*)=1) b ON b.s_nationkey=c_nationkey""")
def tiered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key, else by a nation that only one supplier has, else unlinked."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    by_key = s.select(F.col("s_suppkey").alias("c_custkey"), "s_suppkey")
    alone = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"), F.count("*").alias("n")).filter("n = 1")
    return matching.tiered(c, [("key", by_key, ["c_custkey"]), ("nation", alone, ["c_nationkey"])], "s_suppkey").select("c_custkey", "s_suppkey", "method")


@query("""
SELECT a.event_id, a.user_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id=a.user_id AND b.event_type='view' AND b.ts =
  (SELECT max(v.ts) FROM events v WHERE v.user_id=a.user_id AND v.event_type='view' AND v.ts<=a.ts)) AS view_id
FROM events a WHERE a.event_type='purchase'""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view at or before it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("us"))
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    right = e.filter("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id"))
    return matching.asof(left, right, ["user_id"], "us", "view_id").select("event_id", "user_id", "view_id")


@query("""
SELECT event_id, nearest_id FROM (SELECT a.event_id, b.event_id AS nearest_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts)-epoch_us(a.ts)), b.ts DESC, b.event_id) rn
 FROM events a LEFT JOIN events b ON a.user_id=b.user_id AND b.event_type='signup' WHERE a.event_type='error') WHERE rn=1""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest sign-up of the same user either side; ties to the later one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("us"))
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "us")
    right = e.filter("event_type = 'signup'").select("user_id", "us", F.col("event_id").alias("nearest_id"))
    return matching.nearest(left, right, ["user_id"], "us", "nearest_id").select("event_id", "nearest_id")


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn=1""")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("us", micros("ts"))
    return upsert.last_wins(e, ["user_id", "event_type"], ["us", "event_id"]).select("user_id", "event_type", "event_id", "value")


_NEW = "(SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal, 'NEW' AS c_mktsegment FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1 UNION ALL SELECT -s_suppkey, s_acctbal, 'NEW' FROM supplier)"


def _incoming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers as stored, and rows to write: urgent orders' customers, and suppliers under keys not stored yet."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    known = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    fresh = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return old, known.unionByName(fresh).withColumn("c_mktsegment", F.lit("NEW"))


@query(f"""
WITH old AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer), new AS {_NEW}
SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)""")
def upsert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert(*_incoming(spark, sf_dir), ["c_custkey"])


@query(f"""
WITH old AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer), new AS {_NEW}
SELECT coalesce(o.c_custkey,n.c_custkey) AS c_custkey, coalesce(n.c_acctbal,o.c_acctbal) AS c_acctbal, coalesce(o.c_mktsegment,n.c_mktsegment) AS c_mktsegment
FROM old o FULL JOIN new n ON o.c_custkey=n.c_custkey""")
def upsert_some_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert(*_incoming(spark, sf_dir), ["c_custkey"], only=["c_acctbal"])


@query(f"""
WITH old AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer), new AS {_NEW}
SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.insert_absent(*_incoming(spark, sf_dir), ["c_custkey"])


@query(f"""
WITH old AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer), new AS {_NEW}
SELECT coalesce(o.c_custkey,n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, o.c_acctbal AS old_c_acctbal, n.c_acctbal AS new_c_acctbal
FROM old o FULL JOIN new n ON o.c_custkey=n.c_custkey WHERE o.c_acctbal IS DISTINCT FROM n.c_acctbal""")
def change_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.changes(*_incoming(spark, sf_dir), ["c_custkey"], ["c_acctbal"])


@query("""
SELECT o.o_custkey, o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM orders t WHERE t.o_custkey=o.o_custkey AND t.o_orderpriority=o.o_orderpriority AND t.o_orderstatus=o.o_orderstatus AND t.o_orderkey<o.o_orderkey)""")
def earlier_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey")
    return upsert.later_twins(o, ["o_custkey", "o_orderpriority", "o_orderstatus"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("""
SELECT l_suppkey, bit_xor(('0x'||substr(md5(concat_ws(':',l_orderkey,l_linenumber,l_returnflag)),1,15))::BIGINT) AS print, count(*) AS n FROM lineitem GROUP BY 1""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each supplier's lines, whatever their order; lines have keys, so none cancels another."""
    row = F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_returnflag").cast("binary"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("print"), F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_size>45 THEN 'too large' WHEN p_type='PROMO' THEN 'promotion' WHEN p_retailprice<950 THEN 'cheap' ELSE 'kept' END AS class,
 concat_ws('; ', CASE WHEN p_size>45 THEN 'size '||p_size END, CASE WHEN p_type='PROMO' THEN 'promo' END, CASE WHEN p_retailprice<950 THEN 'price' END) AS reasons FROM part""")
def classification_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    big, promo, cheap = F.col("p_size") > 45, F.col("p_type") == "PROMO", F.col("p_retailprice") < 950
    why = F.concat_ws("; ", F.when(big, F.concat(F.lit("size "), F.col("p_size").cast("string"))), F.when(promo, "promo"), F.when(cheap, "price"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(big, "too large").when(promo, "promotion").when(cheap, "cheap").otherwise("kept").alias("class"), why.alias("reasons"))


@query("""
SELECT p_brand, CASE WHEN p_size>45 THEN 'too large' WHEN p_retailprice<950 THEN 'cheap' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1,2""")
def exclusion_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("p_size") > 45, "too large").when(F.col("p_retailprice") < 950, "cheap").otherwise("kept")
    return table(spark, sf_dir, "part").groupBy("p_brand", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT 'large' AS view, count(*) FILTER (WHERE o_totalprice>300000) AS n FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority='1-URGENT') FROM orders
UNION ALL SELECT 'open', count(*) FILTER (WHERE o_orderstatus='O') FROM orders UNION ALL SELECT 'all', count(*) FROM orders""")
def named_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row can be in many views; one pass counts them all."""
    views = {"large": F.col("o_totalprice") > 300000, "urgent": F.col("o_orderpriority") == "1-URGENT", "open": F.col("o_orderstatus") == "O", "all": F.lit(True)}
    one = table(spark, sf_dir, "orders").agg(*[F.count_if(c).alias(v) for v, c in views.items()])
    return one.unpivot([], list(views), "view", "n")


@query("""
SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name),'00001') OR contains(lower(c_mktsegment),'auto')""")
def multi_field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.lower("c_name").contains("00001") | F.lower("c_mktsegment").contains("auto")
    return table(spark, sf_dir, "customer").filter(hit).select("c_custkey", "c_name")


@query("""
SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice, count(*) OVER () AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)""")
def clamped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the largest orders with the total; a limit out of range becomes 100 (the page is the feature)."""
    asked = 5000
    limit = asked if 0 < asked <= 500 else 100
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(limit).crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))  # one row


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority='1-URGENT' THEN 0 ELSE row_number() OVER (PARTITION BY o_custkey, o_orderpriority='1-URGENT' ORDER BY o_orderdate DESC, o_orderkey) END AS priority FROM orders""")
def priority_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    asked = F.col("o_orderpriority") == "1-URGENT"
    o = table(spark, sf_dir, "orders").withColumn("asked", asked)
    rank = F.row_number().over(Window.partitionBy("o_custkey", "asked").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return o.select("o_orderkey", F.when(F.col("asked"), 0).otherwise(rank).cast("long").alias("priority"))


@query("""
SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey
WHERE l_orderkey IS NULL OR (o_orderstatus='O' AND first < TIMESTAMP '2000-01-01')""")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with no partner yet, or a retryable status whose time is past."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"))
    due = (F.col("o_orderstatus") == "O") & (F.col("first") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").join(li, "o_orderkey", "left").filter(F.col("first").isNull() | due).select("o_orderkey", "o_orderstatus")


@query("""
SELECT o_orderstatus, map_from_entries(list((o_orderpriority, n) ORDER BY o_orderpriority))::VARCHAR AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1,2) GROUP BY 1""")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a two-level key as one map per outer key, written as text."""
    per = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("o_orderpriority", "n")))
    text = F.transform(entries, lambda e: F.concat(e["o_orderpriority"], F.lit("="), e["n"].cast("string")))
    return per.groupBy("o_orderstatus").agg(F.concat(F.lit("{"), F.array_join(text, ", "), F.lit("}")).alias("counts"))


@query("""
SELECT c_mktsegment, cast(count(*) FILTER (WHERE o_orderstatus='F') AS BIGINT) AS f, count(*) FILTER (WHERE o_orderstatus='O') AS o, count(*) FILTER (WHERE o_orderstatus='P') AS p FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1""")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    p = c.join(o, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("c_mktsegment", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "FOP"])


@query("""
SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS top, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) rn FROM supplier) WHERE rn<=3 AND s_acctbal>=top/4""")
def ranked_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three of each group that reach a quarter of the best (a top-k report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    s = table(spark, sf_dir, "supplier").withColumn("top", F.max("s_acctbal").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("s_acctbal"), "s_suppkey")))
    return s.filter("rn <= 3 and s_acctbal >= top / 4").select("s_nationkey", "s_suppkey", "s_acctbal")


@query("""
WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal<0 THEN NULL ELSE c_acctbal END AS bal, c_nationkey FROM customer)
SELECT a.s_suppkey, count(b.c_custkey) AS n FROM supplier a LEFT JOIN s b ON a.s_nationkey=b.c_nationkey AND (CASE WHEN a.s_acctbal<0 THEN NULL ELSE floor(a.s_acctbal/1000) END) IS NOT DISTINCT FROM floor(b.bal/1000) GROUP BY 1""")
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values match each other."""
    step = lambda c: F.floor(F.when(F.col(c) >= 0, F.col(c)) / 1000)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", step("s_acctbal").alias("a"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", step("c_acctbal").alias("b"))
    return s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & F.col("a").eqNullSafe(F.col("b")), "left").groupBy("s_suppkey").agg(F.count("c_custkey").alias("n"))


@query("""
SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, round(l_extendedprice/(max(l_extendedprice) OVER (PARTITION BY l_suppkey, l_returnflag)),6) AS share FROM lineitem""")
def group_best_joined_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max("l_extendedprice").alias("best"))
    li = table(spark, sf_dir, "lineitem").join(best, ["l_suppkey", "l_returnflag"])
    return li.select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.col("best"), 6).alias("share"))


@query("""
SELECT user_id, CASE WHEN len(list_filter(['view','click'], lambda x: NOT list_contains(seen,x)))=0 AND len(list_filter(failed, lambda x: x NOT IN ('error','signup')))=0 THEN true ELSE false END AS alert, len(seen) AS kinds
FROM (SELECT user_id, list(DISTINCT event_type) AS seen, coalesce(list(DISTINCT event_type) FILTER (WHERE value>100), []) AS failed FROM events GROUP BY 1)""")
def alert_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All required checks made, and only optional ones failed."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"), F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))).alias("failed"))
    lits = lambda *x: F.array(*map(F.lit, x))
    ok = (F.size(F.array_except(lits("view", "click"), "seen")) == 0) & (F.size(F.array_except("failed", lits("error", "signup"))) == 0)
    return e.select("user_id", ok.alias("alert"), F.size("seen").cast("long").alias("kinds"))


@query("""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_totalprice>50000)) """)
def every_row_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    good = o.groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 50000).alias("ok")).filter("ok")
    return o.join(good, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("""
SELECT n_name, cast(o_year AS BIGINT) AS o_year, coalesce(round(revenue,2),0) AS revenue FROM (SELECT n_nationkey, n_name, y AS o_year FROM nation, (SELECT DISTINCT year(o_orderdate) AS y FROM orders))
LEFT JOIN (SELECT c_nationkey, year(o_orderdate) AS yy, sum(o_totalprice) AS revenue FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1,2) ON c_nationkey=n_nationkey AND yy=o_year""")
def calendar_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of years for every nation, with 0 where there is nothing."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    years = o.select(F.year("o_orderdate").cast("long").alias("o_year")).distinct()
    sums = c.join(o, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").cast("long").alias("o_year")).agg(F.sum("o_totalprice").alias("revenue"))
    grid = n.select("n_nationkey", "n_name").crossJoin(F.broadcast(years))  # 25 nations by the years there are
    return grid.join(sums, ["n_nationkey", "o_year"], "left").select("n_name", "o_year", F.coalesce(F.round("revenue", 2), F.lit(0.0)).alias("revenue"))
