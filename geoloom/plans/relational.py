"""Relational queries that the frame inherits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..frame import asof


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _join(how):
    def run(s, d):
        # Shifted keys leave rows of both sides without a partner.
        n, r = _t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), _t(s, d, "region").select((F.col("r_regionkey") + 1).alias("n_regionkey"), "r_name")
        return n.join(r, "n_regionkey", how)

    return run


def _join_sql(how: str, cols: str = "n_regionkey, n_nationkey, n_name, r_name") -> str:
    return f"SELECT {cols} FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation) n {how} JOIN (SELECT r_regionkey + 1 AS n_regionkey, r_name FROM region) r USING (n_regionkey)"


def _asof(s, d):
    e = _t(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("seen"))
    return asof(e.select("event_id", "user_id", "ts"), right, "ts", "user_id").select("event_id", "user_id", "seen")


def _asof_all(s, d):
    e = _t(s, d, "events")
    right = e.where("event_type = 'purchase'").groupBy("ts").agg(F.max("event_id").alias("seen"))
    return asof(e.select("event_id", "ts"), right, "ts").select("event_id", "seen")


def _rolling(s, d):
    """Count and largest id of the half hour up to each event of a user."""
    w = W.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-1800, 0)
    return _t(s, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.max("event_id").over(w).alias("hi"))


def _agg(s, d):
    g = _t(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    q = "l_quantity"
    return g.agg(F.sum(q).alias("s"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.count(F.lit(1)).alias("n"), F.round(F.stddev(q), 6).alias("sd"), F.round(F.variance(q), 6).alias("var"), F.expr("percentile(l_quantity, 0.5)").alias("median"), F.expr("percentile(l_quantity, 0.25)").alias("q25"), F.countDistinct("l_partkey").alias("parts"), F.min_by("l_orderkey", F.struct("l_quantity", "l_orderkey")).alias("first_order"), F.max_by("l_orderkey", F.struct("l_quantity", "l_orderkey")).alias("last_order"))


_EV = "SELECT event_id, user_id, ts, value FROM events"


def _w():
    return W.partitionBy("user_id").orderBy("ts", "event_id")


def _ev(s, d):
    return _t(s, d, "events")


QUERIES = {
    "rel_select": (lambda s, d: _t(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_acctbal") * 2).alias("twice")), "SELECT c_custkey, c_name AS name, c_acctbal * 2 AS twice FROM customer"),
    "rel_filter": (lambda s, d: _t(s, d, "customer").where(F.col("c_acctbal").between(100, 5000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").isNotNull()).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name IS NOT NULL"),
    "rel_join_inner": (_join("inner"), _join_sql("")),
    "rel_join_left": (_join("left"), _join_sql("LEFT")),
    "rel_join_full": (_join("full"), _join_sql("FULL")),
    "rel_join_semi": (_join("left_semi"), _join_sql("SEMI", "n_regionkey, n_nationkey, n_name")),
    "rel_join_anti": (_join("left_anti"), _join_sql("ANTI", "n_regionkey, n_nationkey, n_name")),
    "rel_join_cross": (lambda s, d: _t(s, d, "nation").select("n_nationkey").crossJoin(_t(s, d, "region").select("r_regionkey")), "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region"),
    "rel_join_range": (lambda s, d: (n := _t(s, d, "nation")).select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("r")).join(n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("r")), "r").where("b > a AND b <= a + 6").select("a", "b"), "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND y.n_nationkey > x.n_nationkey AND y.n_nationkey <= x.n_nationkey + 6"),
    "rel_join_asof": (_asof, "SELECT l.event_id, l.user_id, r.seen FROM events l ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) r ON l.user_id = r.user_id AND l.ts >= r.ts"),
    "rel_agg": (_agg, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n, round(stddev(l_quantity), 6) AS sd, round(variance(l_quantity), 6) AS var, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.25) AS q25, count(DISTINCT l_partkey) AS parts, arg_min(l_orderkey, {'q': l_quantity, 'o': l_orderkey}) AS first_order, arg_max(l_orderkey, {'q': l_quantity, 'o': l_orderkey}) AS last_order FROM lineitem GROUP BY 1, 2"),
    "rel_distinct": (lambda s, d: _t(s, d, "orders").select("o_orderstatus", "o_orderpriority").distinct(), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "rel_n_unique": (lambda s, d: _t(s, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n")), "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1"),
    "rel_approx_unique": (lambda s, d: _t(s, d, "orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("about")), None),
    "rel_rollup": (lambda s, d: _t(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "rel_cube": (lambda s, d: _t(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "rel_collect": (lambda s, d: _t(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "|").alias("names")), "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "rel_window_rank": (lambda s, d: (w := W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")) and _t(s, d, "customer").select("c_custkey", F.row_number().over(w).alias("rn"), F.rank().over(W.partitionBy("c_nationkey").orderBy("c_mktsegment")).alias("rk"), F.dense_rank().over(W.partitionBy("c_nationkey").orderBy("c_mktsegment")).alias("dr")), "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rk, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr FROM customer"),
    "rel_window_lag": (lambda s, d: _ev(s, d).select("event_id", F.lag("event_id").over(_w()).alias("before"), F.lead("event_id", 2).over(_w()).alias("after"), F.first("event_id").over(_w()).alias("first")), f"SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_id) OVER w AS first FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "rel_window_frame": (lambda s, d: _ev(s, d).select("event_id", F.count("event_id").over(_w().rowsBetween(-2, 0)).alias("n"), F.max("value").over(_w().rowsBetween(-2, 2)).alias("hi"), F.sum("event_id").over(_w().rowsBetween(W.unboundedPreceding, 0)).alias("run")), f"SELECT event_id, count(event_id) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hi, CAST(sum(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "rel_time_window": (lambda s, d: _ev(s, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n"), "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "rel_topk": (lambda s, d: _t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "rel_union": (lambda s, d: (c := _t(s, d, "customer").select(F.col("c_nationkey").alias("k"))).unionByName(_t(s, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "rel_intersect": (lambda s, d: _t(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(_t(s, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "rel_except": (lambda s, d: _t(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(_t(s, d, "orders").select(F.col("o_custkey").alias("k"))), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "rel_unpivot": (lambda s, d: _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.max("l_linenumber").cast("double").alias("line")).unpivot("l_orderkey", ["quantity", "line"], "name", "value"), "SELECT l_orderkey, unnest(['quantity', 'line']) AS name, unnest([sum(l_quantity), CAST(max(l_linenumber) AS DOUBLE)]) AS value FROM lineitem GROUP BY 1"),
    "rel_pivot": (lambda s, d: _t(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))), "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS O FROM lineitem GROUP BY 1"),
    "rel_explode": (lambda s, d: _t(s, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word")), "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part"),
    "rel_fill_null": (lambda s, d: _join("left")(s, d).fillna({"r_name": "none"}), _join_sql("LEFT", "n_regionkey, n_nationkey, n_name, coalesce(r_name, 'none') AS r_name")),
    "rel_drop_null": (lambda s, d: _join("left")(s, d).dropna(), _join_sql("")),
    "rel_string": (lambda s, d: _t(s, d, "part").select("p_partkey", F.upper("p_name").alias("u"), F.length("p_name").alias("n"), F.substring("p_brand", 1, 5).alias("b"), F.concat_ws("-", "p_brand", "p_type").alias("c"), F.regexp_replace("p_type", "[AEIOU]", "_").alias("v"), F.instr("p_name", "a").alias("i")), "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS INTEGER) AS n, substr(p_brand, 1, 5) AS b, p_brand || '-' || p_type AS c, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS v, CAST(instr(p_name, 'a') AS INTEGER) AS i FROM part"),
    "rel_date": (lambda s, d: _t(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("t"), F.datediff("o_orderdate", F.lit("1992-01-01")).alias("since")), "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS t, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS since FROM orders"),
    "rel_math": (lambda s, d: _t(s, d, "part").select("p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("r"), F.floor("p_retailprice").cast("long").alias("f"), F.abs(F.col("p_size") - 25).alias("a"), F.round(F.log("p_retailprice"), 6).alias("l"), (F.col("p_size") % 7).alias("m")), "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, abs(p_size - 25) AS a, round(ln(p_retailprice), 6) AS l, p_size % 7 AS m FROM part"),
    "rel_json": (lambda s, d: _ev(s, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "rel_sample": (lambda s, d: _ev(s, d).sample(fraction=0.1, seed=7).select("event_id"), None),
    "rel_join_asof_all": (_asof_all, "SELECT l.event_id, r.seen FROM events l ASOF LEFT JOIN (SELECT ts, max(event_id) AS seen FROM events WHERE event_type = 'purchase' GROUP BY ts) r ON l.ts >= r.ts"),
    "rel_sliding_window": (lambda s, d: _ev(s, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1"),
    "rel_rolling_time": (_rolling, "SELECT event_id, count(*) OVER w AS n, max(event_id) OVER w AS hi FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW)"),
    "rel_approx_within": (lambda s, d: _t(s, d, "orders").groupBy("o_orderstatus").agg((F.abs(F.approx_count_distinct("o_custkey", 0.02) / F.countDistinct("o_custkey") - 1) < 0.1).alias("close")), "SELECT o_orderstatus, true AS close FROM orders GROUP BY 1"),
    "rel_sample_within": (lambda s, d: (e := _ev(s, d).select("event_id")).sample(fraction=0.1, seed=7).join(e, "event_id", "left_semi").agg(F.count(F.lit(1)).between(F.lit(e.count() * 0.05), F.lit(e.count() * 0.15)).alias("close"), (F.count(F.lit(1)) == F.countDistinct("event_id")).alias("once")), "SELECT true AS close, true AS once"),
}
