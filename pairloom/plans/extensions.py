"""General SQL features next to the data operators: windows of time, cubes, frames, as-of and outer joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.operators.joins import as_of, interval_join
from pairloom.plans.base import query, table


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(CAST(6 * i AS INTEGER)) AS start, count(*) AS n FROM events, range(2) r(i) GROUP BY 1")
def sliding(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_counts(spark, d):
    return table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("__customer")
    return spark.sql("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM __customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


@query("""SELECT p.event_id, p.user_id, (SELECT max(v.event_id) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts AND v.ts = (SELECT max(w.ts) FROM events w WHERE w.event_type = 'view' AND w.user_id = p.user_id AND w.ts <= p.ts)) AS view_id
FROM events p WHERE p.event_type = 'purchase'""")
def asof_events(spark, d):
    e = table(spark, d, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return as_of(buys, views, ["user_id"], "ts", ["view_id"]).select("event_id", "user_id", "view_id")


@query("""SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def interval_events(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("view_id"))
    b = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return interval_join(a, b, ["user_id"], "start", "ts", 1800).select("view_id", "click_id")


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def running_frames(spark, d):
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.expr("unix_micros(cast(ts as timestamp))")
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return e.withColumn("us", micros).select(
        "event_id", F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("mean3"), F.lag("event_id").over(w).alias("previous"), F.count(F.lit(1)).over(day).alias("last_day")
    )


@query()
def approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("median_price"))


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def star_join(spark, d):
    t = lambda n: table(spark, d, n)
    li = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    j = li.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by = j.groupBy("c_nationkey").agg(F.sum("x").alias("x"))
    return by.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("x"), 2).alias("revenue"))


@query("""SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) b ON c_nationkey = s_nationkey""")
def full_outer_counts(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT p_brand, p_size, count(l_orderkey) AS n FROM lineitem RIGHT JOIN part ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY 1, 2")
def right_outer_counts(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 49").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    return li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "right").groupBy("p_brand", "p_size").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
