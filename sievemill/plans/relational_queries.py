"""Relational and streaming queries over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import relational as R
from ..session import table
from ..streaming import events as S


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("revenue_rollup", """SELECT r_name, n_name, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("semi_anti", """SELECT 'with' AS kind, count(*)::BIGINT AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.lit("with").alias("kind"), F.count("*").alias("n")).unionByName(c.join(o, "c_custkey", "left_anti").agg(F.lit("without").alias("kind"), F.count("*").alias("n")))


@query("top_orders", "SELECT o_orderpriority, o_orderkey, o_totalprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10")
def top_orders(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query("set_ops", "SELECT 'both' AS kind, count(*)::BIGINT AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers_only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_ops(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).agg(F.lit("both").alias("kind"), F.count("*").alias("n")).unionByName(a.exceptAll(b).distinct().join(b, "k", "left_anti").agg(F.lit("customers_only").alias("kind"), F.count("*").alias("n")))


@query("events_pivot", "SELECT user_id % 10 AS bucket, count(*) FILTER (event_type = 'click')::BIGINT AS click, count(*) FILTER (event_type = 'view')::BIGINT AS \"view\" FROM events GROUP BY 1")
def events_pivot(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("bucket")).pivot("event_type", ["click", "view"]).count().na.fill(0)


@query("events_json", "SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def events_json(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("events_moving", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def events_moving(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


_PURCHASE = "(SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"


@query("events_asof", f"SELECT e.event_id, p.last_id FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN {_PURCHASE} p ON e.user_id = p.user_id AND e.ts >= p.ts")
def events_asof(spark, d):
    e = table(spark, d, "events")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return R.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "ts", ["last_id"]).select("event_id", "last_id")


@query("size_bands", "SELECT p_partkey, b.low::INT AS low FROM part JOIN range(0, 60, 10) b(low) ON p_size BETWEEN b.low AND b.low + 12")
def size_bands(spark, d):
    bands = spark.range(0, 60, 10).select(F.col("id").cast("int").alias("low"), (F.col("id") + 12).cast("int").alias("high"))
    return R.band_join(table(spark, d, "part").select("p_partkey", "p_size"), bands, "p_size", "low", "high", 10.0).select("p_partkey", "low")


@query("salted_join", "SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def salted_join(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.salted_join(o, table(spark, d, "customer"), ["c_custkey"], 8).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("event_sessions", "SELECT user_id, max(s)::BIGINT AS n_sessions FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY 1")
def event_sessions(spark, d):
    return R.sessions(table(spark, d, "events"), "user_id", "ts", 21_600).groupBy("user_id").agg(F.max("session_no").alias("n_sessions"))


@query("cube_totals", "SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_totals(spark, d):
    g = table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.select("o_orderpriority", "o_orderstatus", F.col("level").cast("long").alias("level"), "n", "total")


@query("event_times", "SELECT event_id, epoch_us(ts)::BIGINT AS micros, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, epoch(date_trunc('hour', ts))::BIGINT AS hour_seconds, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS day_no FROM events")
def event_times(spark, d):
    """Instants as numbers and text, and read back from their text."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", F.unix_micros("ts").alias("micros"), text.alias("text"), F.unix_timestamp(F.date_trunc("hour", F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"))).alias("hour_seconds"), F.date_diff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long").alias("day_no"))


@query("approx_distinct")
def approx_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("middle"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def events_tumbling(spark, d):
    return S.tumbling(table(spark, d, "events")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("events_sliding", "SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(k) AS start, event_type, count(*)::BIGINT AS n FROM events, unnest([0, 1]) u(k) WHERE ts IS NOT NULL GROUP BY 1, 2")
def events_sliding(spark, d):
    return S.sliding(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("events_session", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM f) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, no""")
def events_session(spark, d):
    return S.sessions(table(spark, d, "events")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("stream_dedup", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events) GROUP BY 1, 2")
def stream_dedup(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return S.first_seen(e, ["user_id", "event_type", "day"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
