"""Named queries over the driver's tables, each with its SQL twin.

A shared query is one statement that both engines run; own operators are DataFrame plans beside separately
written SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import buckets
from ..model import IndexSpec
from ..operators import coverage as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Register one statement for both engines; tables are named in braces."""
    text = spark_sql or sql
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    QUERIES[name] = query
    ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", sql)


def own(name: str, sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn

    return register


WEEK = "ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-12 00:00:00'"
DUCK_WEEK = WEEK.replace("TIMESTAMP_NTZ", "TIMESTAMP")


def shared_ntz(name: str, sql: str) -> None:
    """A statement with timestamp literals, which the engines name differently."""
    shared(name, sql.replace("TIMESTAMP_NTZ", "TIMESTAMP"), sql)


# scans, filters, aggregates
shared_ntz("range_scan_half_open", f"SELECT event_id, ts, user_id, event_type, value FROM {{events}} WHERE {WEEK}")
shared_ntz("count_sum_range", f"SELECT count(*) AS n, round(sum(value), 2) AS total FROM {{events}} WHERE {WEEK}")
shared_ntz("filtered_agg_range", f"SELECT count(*) AS n, round(sum(value), 2) AS total FROM {{events}} WHERE {WEEK} AND value > 10 AND event_type <> 'click'")
shared_ntz("group_count_range", f"SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM {{events}} WHERE {WEEK} GROUP BY user_id")
shared("taxi_style_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
shared("between_in_filters", "SELECT event_id, user_id, value FROM {events} WHERE user_id BETWEEN 10 AND 40 AND event_type IN ('click', 'view', 'purchase') AND user_id NOT IN (13, 17) AND NOT (value < 5 OR value > 500)")
shared("having_count", "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id HAVING count(*) > 50")
shared("count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM {events} GROUP BY event_type")
shared("rollup_sales", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) + grouping(l_linestatus) AS lvl FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)".replace("grouping(l_returnflag) + grouping(l_linestatus)", "CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT)"))
shared("cube_sales", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
shared("grouping_sets_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
shared("scalar_subquery_max", "SELECT event_id, value FROM {events} WHERE value = (SELECT max(value) FROM {events})")
shared("correlated_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
shared("statistics", "SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_pop(value), 3) AS var, min(value) AS lo, max(value) AS hi FROM {events} GROUP BY event_type")
shared("filter_clause", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS big FROM {events} GROUP BY user_id")
shared("median_value", "SELECT event_type, round(median(value), 6) AS mid FROM {events} GROUP BY event_type")

# windows
shared("moving_avg_5", "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS ma5 FROM {events}")
shared("rank_functions", "SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
shared("lag_lead", "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS head FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
shared("last_nth_value", "SELECT event_id, last_value(value) OVER w AS tail, nth_value(value, 2) OVER w AS second FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
shared("range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM {orders}")

# sort, limit, sets, subqueries
shared("top_k_desc", "SELECT event_id, value FROM {events} ORDER BY value DESC NULLS LAST, event_id LIMIT 25")
shared("limit_after_sort", "SELECT event_id, ts FROM {events} ORDER BY ts NULLS FIRST, event_id LIMIT 10 OFFSET 5")
shared("union_all_types", "SELECT event_type AS name FROM {events} UNION ALL SELECT o_orderstatus AS name FROM {orders}")
shared("limit_zero", "SELECT event_id, value FROM {events} LIMIT 0")
shared("group_by_alias", "SELECT CAST(ts AS DATE) AS on_day, count(*) AS n FROM {events} GROUP BY on_day")
shared("union_distinct", "SELECT event_type AS name FROM {events} UNION SELECT o_orderstatus AS name FROM {orders}")
shared("intersect_users", "SELECT user_id FROM {events} WHERE event_type = 'click' INTERSECT SELECT user_id FROM {events} WHERE event_type = 'purchase'")
shared("except_users", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders}")
shared("except_all_keys", "SELECT o_custkey AS k FROM {orders} EXCEPT ALL SELECT c_custkey AS k FROM {customer}")
shared("intersect_all_keys", "SELECT o_custkey AS k FROM {orders} INTERSECT ALL SELECT c_custkey AS k FROM {customer}")
shared("cte_values", "WITH t(k, name) AS (VALUES (1, 'one'), (2, 'two')) SELECT k, name FROM t UNION ALL SELECT 3 AS k, 'three' AS name")
shared("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t")
shared("select_without_from", "SELECT 1 AS one, 'a' AS a, CAST(2.5 AS DOUBLE) AS x")
shared("exists_subquery", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")

# joins
shared("join_inner_dim", "SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey")
shared("join_left_missing", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
shared("join_right", "SELECT n.n_name, r.r_name FROM {nation} n RIGHT JOIN {region} r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey < 10")
shared("join_composite", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM {events} a JOIN {events} b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id = b.event_id + 1")
shared("join_composite_supply", "SELECT l.l_orderkey, l.l_linenumber, s.n FROM {lineitem} l JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey, l_suppkey) s ON l.l_partkey = s.l_partkey AND l.l_suppkey = s.l_suppkey")
shared("join_semi", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_nationkey = 3)")
shared("join_anti", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
shared("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
shared("join_full", "SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL OUTER JOIN {supplier} s ON c.c_custkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey")
shared("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
shared("join_duplicate_keys", "SELECT l.l_orderkey, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey")

# scalar functions
shared("interval_arithmetic", "SELECT event_id, CAST(ts + INTERVAL 1 DAY AS TIMESTAMP) AS later, CAST(ts + INTERVAL 1 MONTH AS TIMESTAMP) AS month_later FROM {events}", "SELECT event_id, ts + INTERVAL 1 DAY AS later, ts + INTERVAL 1 MONTH AS month_later FROM {events}")
shared_ntz("interval_shift_filter", "SELECT event_id FROM {events} WHERE ts + INTERVAL 2 HOUR < TIMESTAMP_NTZ '2024-01-03 00:00:00'")
shared("to_date_filter", "SELECT event_id FROM {events} WHERE CAST(ts AS DATE) = DATE '2024-01-08'")
shared("date_parts", "SELECT event_id, CAST(date_part('minute', ts) AS BIGINT) AS m, CAST(date_part('hour', ts) AS BIGINT) AS h, char_length(event_type) AS len FROM {events} WHERE date_part('minute', ts) = 30")
shared("string_functions", "SELECT user_id, upper(event_type) AS u, concat(event_type, '-', CAST(user_id AS VARCHAR(20))) AS c, substring(event_type, 1, 3) AS s, length(event_type) AS n FROM {events} WHERE event_type LIKE '%i%'")
shared("math_functions", "SELECT event_id, round(sqrt(abs(value)), 6) AS r, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c, mod(event_id, 7) AS m FROM {events}")
shared("case_coalesce", "SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(event_type, 'click'), 'none') AS kind FROM {events}")
shared("rfc3339_compare", "SELECT event_id FROM {events} WHERE ts >= '2024-01-29T00:00:00'")
shared("decimal_cast", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR(40)) AS d FROM {orders}")


# time bins
@own("hourly_date_trunc", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def _hourly_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return table(spark, sf_dir, "events").groupBy(hour).agg(F.count(F.lit(1)).alias("n")).orderBy("hour")


@own("hourly_date_bin", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bin, count(*) AS n FROM events GROUP BY 1")
def _hourly_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(buckets.date_bin(3_600_000_000, F.col("ts")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@own("date_bin_origin", "SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01 00:07:30') AS bin, count(*) AS n FROM events GROUP BY 1")
def _bin_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = 1_704_067_650_000_000
    return table(spark, sf_dir, "events").groupBy(buckets.date_bin(900_000_000, F.col("ts"), origin).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@own("date_bin_month", "SELECT time_bucket(INTERVAL 3 MONTH, CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1992-02-01') AS bin, count(*) AS n FROM orders GROUP BY 1")
def _bin_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = buckets.date_bin_months(3, F.col("o_orderdate").cast("timestamp_ntz"), F.lit("1992-02-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@own("unix_seconds_filter", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec FROM events WHERE epoch_us(ts) < 1704326400000000")
def _unix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = buckets.to_unixtime(F.col("ts"))
    return table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")).select("event_id", sec.alias("sec"))


# buckets and coverage; hour buckets, entity event_type
HOUR = IndexSpec.timestamp("ts", "1h", ["event_type"])
LOW, HIGH = HOUR.range_ordinals(datetime(2024, 1, 5), datetime(2024, 1, 12))
DUCK_COV = "c AS (SELECT DISTINCT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS b FROM events)"
DUCK_RUNS = DUCK_COV + """, i AS (SELECT *, b - row_number() OVER (PARTITION BY event_type ORDER BY b) AS g FROM c),
 r AS (SELECT event_type, min(b) AS s, max(b) AS e FROM i GROUP BY event_type, g)"""
DUCK_GAPS = DUCK_COV + f""", p AS (SELECT * FROM c WHERE b BETWEEN {LOW} AND {HIGH} UNION ALL SELECT DISTINCT event_type, {LOW - 1} FROM c UNION ALL SELECT DISTINCT event_type, {HIGH + 1} FROM c),
 g AS (SELECT event_type, b + 1 AS s, lead(b) OVER (PARTITION BY event_type ORDER BY b) - 1 AS e FROM p), m AS (SELECT * FROM g WHERE e >= s)"""
KEYS = ["event_type"]


def hour_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(table(spark, sf_dir, "events"), HOUR)


def hour_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.runs(hour_coverage(spark, sf_dir), KEYS)


@own("coverage_runs", f"WITH {DUCK_RUNS} SELECT event_type, s AS first, e AS last FROM r")
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hour_runs(spark, sf_dir)


@own("entity_coverage", f"WITH {DUCK_COV} SELECT event_type, b AS bucket FROM c")
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hour_coverage(spark, sf_dir)


@own("global_coverage_runs", "WITH c AS (SELECT DISTINCT (epoch_us(ts) // 60000000)::BIGINT AS b FROM events), i AS (SELECT b, b - row_number() OVER (ORDER BY b) AS g FROM c) SELECT min(b) AS first, max(b) AS last FROM i GROUP BY g")
def _global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.runs(C.coverage(table(spark, sf_dir, "events"), IndexSpec.timestamp("ts", "1m")), [])


@own("bucket_ids", "SELECT event_id, ((epoch_us(ts) // 900000000)::HUGEINT + 9223372036854775808)::VARCHAR AS bucket_id FROM events")
def _bucket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = buckets.ordinal(IndexSpec.timestamp("ts", "15m"))
    return table(spark, sf_dir, "events").select("event_id", (at.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string").alias("bucket_id"))


@own("bucket_ids_int_signed", "SELECT event_id, floor((event_id - 5000) / 7.0)::BIGINT AS bucket FROM events")
def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") - 5000).alias("idx"))
    return idx.select("event_id", buckets.ordinal(IndexSpec.integer("idx", 7)).alias("bucket"))


@own("bucket_decode", "WITH c AS (SELECT DISTINCT epoch_us(ts) // 900000000 AS b FROM events) SELECT b::BIGINT AS bucket, make_timestamp(b * 900000000) AS start, make_timestamp((b + 1) * 900000000) AS stop FROM c")
def _decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = C.coverage(table(spark, sf_dir, "events"), IndexSpec.timestamp("ts", "15m"))
    at = lambda n: F.timestamp_micros((F.col("bucket") + n) * 900_000_000).cast("timestamp_ntz")
    return cov.select("bucket", at(0).alias("start"), at(1).alias("stop"))


@own("coverage_ratio_entity", f"WITH {DUCK_COV} SELECT event_type, count(*) AS covered, {HIGH - LOW + 1}::BIGINT AS total, count(*) / {float(HIGH - LOW + 1)} AS ratio FROM c WHERE b BETWEEN {LOW} AND {HIGH} GROUP BY event_type")
def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ratio(hour_coverage(spark, sf_dir), KEYS, LOW, HIGH)


@own("missing_runs", f"WITH {DUCK_GAPS} SELECT event_type, s AS first, e AS last FROM m")
def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_runs(hour_runs(spark, sf_dir), KEYS, LOW, HIGH)


@own("missing_runs_split", f"WITH {DUCK_GAPS}, x AS (SELECT event_type, e, unnest(generate_series(s, e, 2)) AS f FROM m) SELECT event_type, f AS first, least(e, f + 1) AS last FROM x")
def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_runs(hour_runs(spark, sf_dir), KEYS, LOW, HIGH, longest=2)


@own("max_gap_entity", f"WITH {DUCK_GAPS} SELECT c.event_type, coalesce(max(m.e - m.s + 1), 0)::BIGINT AS max_gap FROM (SELECT DISTINCT event_type FROM c) c LEFT JOIN m USING (event_type) GROUP BY 1")
def _gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.max_gap(hour_runs(spark, sf_dir), KEYS, LOW, HIGH)


@own("last_window_entity", f"WITH {DUCK_RUNS}, k AS (SELECT event_type, s, least(e, {HIGH}) AS e FROM r WHERE s <= {HIGH}) SELECT event_type, max(e) - 2 AS first, max(e) AS last FROM k WHERE e - s + 1 >= 3 GROUP BY event_type")
def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_window(hour_runs(spark, sf_dir), KEYS, HIGH, 3)


@own("last_run_min_len", f"WITH {DUCK_RUNS}, k AS (SELECT event_type, greatest(s, {LOW}) AS s, least(e, {HIGH}) AS e FROM r WHERE s <= {HIGH} AND e >= {LOW}) SELECT event_type, max_by(s, e) AS first, max(e) AS last FROM k WHERE e - s + 1 >= 4 GROUP BY event_type")
def _last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_run(hour_runs(spark, sf_dir), KEYS, LOW, HIGH, 4)


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    return tuple(C.coverage(e.where(F.pmod("event_id", F.lit(2)) == k), HOUR) for k in (0, 1))

# arrays, maps, JSON, collected values, ranges joined to points
shared("array_functions", "SELECT event_type, array_agg(DISTINCT user_id ORDER BY user_id) AS users FROM {events} GROUP BY event_type".replace("array_agg", "list"), "SELECT event_type, array_sort(collect_set(user_id)) AS users FROM {events} GROUP BY event_type")
shared("unnested_rows", "SELECT o_orderkey, w.word FROM {orders} o, LATERAL (SELECT unnest(string_split(o_orderpriority, '-')) AS word) w", "SELECT o_orderkey, word FROM {orders} LATERAL VIEW explode(split(o_orderpriority, '-')) AS word")
shared("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}", "SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}")
shared("string_collected", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
shared_ntz("join_interval", "WITH d AS (SELECT * FROM (VALUES (1, TIMESTAMP_NTZ '2024-01-05 00:00:00', TIMESTAMP_NTZ '2024-01-05 06:00:00'), (2, TIMESTAMP_NTZ '2024-01-05 04:00:00', TIMESTAMP_NTZ '2024-01-06 00:00:00'), (3, TIMESTAMP_NTZ '2024-01-20 00:00:00', TIMESTAMP_NTZ '2024-01-21 00:00:00')) AS v(span_id, low, high)) SELECT d.span_id, e.event_id FROM {events} e JOIN d ON e.ts >= d.low AND e.ts < d.high")
shared("ranked_shares", "SELECT user_id, n, ntile(4) OVER (ORDER BY n, user_id) AS quarter, percent_rank() OVER (ORDER BY n) AS pr, cume_dist() OVER (ORDER BY n) AS cd FROM (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) g")


DUCK_HALVES = ", ".join(f"{n} AS (SELECT DISTINCT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS bucket FROM events WHERE event_id % 2 = {k})" for n, k in (("a", 0), ("b", 1)))


@own("coverage_union", f"WITH {DUCK_HALVES} SELECT * FROM a UNION SELECT * FROM b")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.union(*halves(spark, sf_dir))


@own("coverage_intersect", f"WITH {DUCK_HALVES} SELECT * FROM a INTERSECT SELECT * FROM b")
def _intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.intersect(*halves(spark, sf_dir), KEYS)


@own("overlap_example", f"WITH {DUCK_HALVES}, o AS (SELECT * FROM a INTERSECT SELECT * FROM b) SELECT (SELECT count(*) FROM o) AS overlap_count, event_type, bucket FROM o ORDER BY event_type, bucket LIMIT 1")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlap(*halves(spark, sf_dir), KEYS)


@own("overlap_pairs", f"WITH {DUCK_HALVES}, o AS (SELECT * FROM a INTERSECT SELECT * FROM b) SELECT event_type, count(*) AS n FROM o GROUP BY event_type")
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (C.runs(h, KEYS) for h in halves(spark, sf_dir))
    return C.overlapping_runs(a, b, KEYS).groupBy("event_type").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))


@own("latest_per_user", "SELECT user_id, max_by(event_id, ts) AS event_id, max(ts) AS ts FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) GROUP BY user_id")
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_id", "ts")
