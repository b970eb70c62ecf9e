"""Relational constructs of the SQL dialects, as Spark SQL. Where an engine's spelling differs, ORACLE has DuckDB's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.sources.shared import Scratch, materialise
from lintel.sources.tables import load

_money = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(18, 2))) AS DOUBLE)"

SQL = {
    # scans
    "scan_mysql": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3",
    "scan_postgres": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 200000",
    "scan_sqlite": "SELECT p_partkey, p_brand FROM part WHERE p_size < 10",
    "scan_sqlserver": "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 9000",
    "scan_oracle": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2",
    "scan_cassandra": "SELECT event_id, event_type FROM events WHERE user_id = 7",
    "scan_dynamo": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'",
    # projection, filter, predicates
    "select_core": "SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0 ORDER BY c_mktsegment LIMIT 3",
    "project_star": "SELECT * FROM region",
    "project_cols": "SELECT n.n_name AS name, n_regionkey, 1 AS one, upper(n_name) AS loud FROM nation n",
    "call_fn": "SELECT c_custkey, length(lower(c_name)) AS n, abs(round(c_acctbal)) AS b FROM customer",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "where": "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000",
    "pred_or": "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 50",
    "pred_and": "SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 1000",
    "pred_not": "SELECT p_partkey FROM part WHERE NOT p_size > 10",
    "pred_paren": "SELECT p_partkey FROM part WHERE (p_size = 1 OR p_size = 2) AND p_retailprice > 900",
    "pred_cmp": "SELECT p_partkey FROM part WHERE p_size != 5 AND p_size >= 3 AND p_size <= 9",
    "pred_isnull": "SELECT o.o_orderkey FROM orders o LEFT JOIN nation n ON o.o_custkey = n.n_nationkey WHERE n.n_name IS NULL",
    "pred_isnotnull": "SELECT count(*) AS n FROM events WHERE props IS NOT NULL",
    "pred_in_list": "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5)",
    "pred_not_in_list": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 3, 5)",
    "pred_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 5000",
    "pred_not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "pred_like": "SELECT c_custkey FROM customer WHERE c_name LIKE '%7'",
    "pred_not_like": "SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%1%'",
    "pred_ilike": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%'",
    "pred_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "values_expr": "SELECT 1 AS a, 'x' AS b, TRUE AS c, upper('q') AS d FROM region",
    "pseudo_rownum": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10",
    "mini_select": "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal > 9000",
    # joins and subqueries
    "join_inner": "SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice < 5000",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_range": "SELECT r.r_regionkey, count(*) AS n FROM part p JOIN region r ON p.p_size BETWEEN r.r_regionkey * 10 AND r.r_regionkey * 10 + 9 GROUP BY r.r_regionkey",
    "join_cross": "SELECT count(*) AS n FROM nation CROSS JOIN region",
    "join_implicit": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "join_anti_null_aware": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "join_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), few AS (SELECT o_custkey FROM big) SELECT o_custkey, count(*) AS n FROM few GROUP BY o_custkey",
    "cte_in_subquery": "SELECT n_name FROM nation WHERE n_nationkey IN (WITH x AS (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500) SELECT c_nationkey FROM x)",
    "cte_recursive": "WITH RECURSIVE t(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 20) SELECT n, s FROM t",
    "connect_by": "WITH RECURSIVE t(node, lvl, path) AS (SELECT CAST(1 AS BIGINT), 1, ',1,' UNION ALL SELECT p.p_partkey, t.lvl + 1, concat(t.path, CAST(p.p_partkey AS STRING), ',') FROM part p JOIN t ON (p.p_partkey - p.p_partkey % 2) / 2 = t.node WHERE NOT contains(t.path, concat(',', CAST(p.p_partkey AS STRING), ','))) SELECT node, lvl FROM t",
    # aggregation
    "agg_count_star": "SELECT count(*) AS n FROM lineitem",
    "agg_count": "SELECT count(props) AS n FROM events",
    "agg_sum": f"SELECT l_returnflag, {_money('l_extendedprice')} AS total FROM lineitem GROUP BY l_returnflag",
    "agg_avg": "SELECT l_returnflag, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY l_returnflag",
    "agg_min": "SELECT min(o_totalprice) AS lo FROM orders",
    "agg_max": "SELECT o_orderpriority, max(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "agg_other": "SELECT o_orderstatus, round(stddev(o_totalprice), 2) AS s, round(median(o_totalprice), 2) AS m FROM orders GROUP BY o_orderstatus",
    "group_by": f"SELECT l_returnflag, l_linestatus, {_money('l_quantity')} AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    # sort, limit, top-k
    "order_by": "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name ASC",
    "limit": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5",
    "top_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "top_percent": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY b, o_orderkey) AS r, n FROM (SELECT o_orderkey, -o_totalprice AS b, (SELECT count(*) FROM orders) AS n FROM orders WHERE o_totalprice >= (SELECT max(o_totalprice) * 0.5 FROM orders))) WHERE r <= ceil(n * 0.001)",
    "page": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    # sets
    "set_union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    # statements, as the relation that they would leave
    "dml_insert": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (90, 'NEW'), (91, 'NEWER')) AS v(r_regionkey, r_name)",
    "dml_replace": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (1) UNION ALL SELECT 1, 'REPLACED'",
    "dml_update": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name FROM nation",
    "dml_delete": "SELECT n_nationkey, n_name FROM nation WHERE NOT coalesce(n_regionkey = 1, FALSE)",
    "dml_merge": "SELECT coalesce(t.n_nationkey, s.k) AS k, CASE WHEN s.k IS NULL THEN t.n_name WHEN t.n_nationkey IS NULL THEN 'NEW' ELSE 'OLD' END AS name FROM nation t FULL JOIN (SELECT r_regionkey * 9 AS k FROM region) s ON t.n_nationkey = s.k",
    "dml_returning": "SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    # documents
    "mongo_match": "SELECT event_id, event_type FROM events WHERE event_type = 'click' AND value > 50",
    "mongo_group": "SELECT event_type AS id, count(*) AS n, max(value) AS top FROM events GROUP BY event_type",
    "mongo_count": "SELECT count(*) AS n FROM events WHERE value > 10",
    "mongo_sortbycount": "SELECT event_type AS id, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC",
    "mongo_bucket": "SELECT CASE WHEN value < 10 THEN '0' WHEN value < 50 THEN '10' ELSE 'other' END AS id, count(*) AS n FROM events GROUP BY 1",
    "mongo_unionwith": "SELECT c_name AS name, 'c' AS kind FROM customer UNION ALL SELECT s_name, 's' FROM supplier",
    "mongo_expr": "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band, coalesce(event_type, 'none') AS kind FROM events",
    # key-value
    "redis_string": "SELECT user_id AS k, v FROM (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "redis_zset": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS place FROM events",
    "redis_set": "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'",
    "redis_stream": "SELECT event_id, ts FROM events WHERE event_id BETWEEN 100 AND 200",
    # search aggregations
    "es_term": "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND value BETWEEN 20 AND 30",
    "es_bool": "SELECT event_id FROM events WHERE (event_type = 'click') AND NOT (value < 10) AND (user_id % 2 = 0 OR value > 60)",
    "es_metric_agg": "SELECT event_type, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "es_bucket_agg": "SELECT floor(value / 10) * 10 AS bucket, count(*) AS n FROM events GROUP BY 1",
    "es_pipeline_agg": "SELECT event_type, day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS diff, sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY event_type, CAST(ts AS DATE))",
    "es_paging": "SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 30",
    # wide-column and key conditions
    "cql_select": "SELECT event_id, value FROM events WHERE user_id = 5 ORDER BY event_id",
    "cql_dml": "SELECT user_id, event_type, event_id AS written FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "ddb_partiql": "SELECT event_id, value FROM events WHERE user_id = 9",
    "ddb_kce": "SELECT event_id FROM events WHERE user_id = 9 AND event_id BETWEEN 10 AND 5000",
    "ddb_filter": "SELECT event_id FROM events WHERE event_type IS NOT NULL AND event_type LIKE 'c%' AND length(event_type) > 3",
    "ddb_condition": "SELECT event_id FROM events WHERE value > 5 AND NOT (event_type = 'view')",
}

SQL["redis_list"] = "SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 3"

ORACLE = {
    "connect_by": SQL["connect_by"].replace("(p.p_partkey - p.p_partkey % 2) / 2", "(p.p_partkey - p.p_partkey % 2) // 2"),
}


#: Levels of connect_by that are walked at once.
TOP_LEVELS = 14


def top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest 0.1 percent of all orders, rounded up; at the cut the smaller o_orderkey goes first, a null price last.

    Rows are range-partitioned in that order; counts by partition say which go in whole, and only the one at the cut is
    ranked.
    """
    order = [F.col("b").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]
    rows = load(spark, sf_dir, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("b")).groupBy("b", "o_orderkey").agg(F.count("*").alias("copies"))
    dealt = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dearest")
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("copies").alias("n")).collect())
    left, cut = -(-sum(n for _, n in counts) // 1000), -1
    for cut, n in counts:  # noqa: B007
        if n >= left:
            break
        left -= n
    before = F.sum("copies").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    last = dealt.where(F.col("part") == cut).select("o_orderkey", F.least("copies", left - before).alias("copies")).where("copies > 0")
    taken = dealt.where(F.col("part") < cut).select("o_orderkey", "copies").union(last)
    return taken.select(F.explode(F.expr("array_repeat(o_orderkey, CAST(copies AS INT))")).alias("o_orderkey"))


def connect_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, lvl) of all nodes below 1, where a part's parent is half its key, rounded down.

    Spark's recursive query stops with an error beyond a million rows. A parent has one binary digit less than its
    child, so no path comes to a node twice and level n has keys of n digits only. The top levels, under 2 ** TOP_LEVELS
    keys whatever the input, are walked at once; each further level's parts are joined with the nodes of the level above.
    Repeated keys are counted and dealt out at the end, one row for each path.
    """
    parts = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"))
    counted = lambda low, high: parts.where(F.col("node").between(low, high - 1)).groupBy("node").agg(F.count("*").alias("times"))
    copies = {1: 1}
    for node, times in sorted(counted(2, 1 << TOP_LEVELS).collect()):
        if node >> 1 in copies:
            copies[node] = copies[node >> 1] * times
    levels = Scratch(spark)
    found = levels.keep(spark.createDataFrame([(k, k.bit_length(), n) for k, n in copies.items()], "node long, lvl int, copies long"), "level")
    for lvl in range(TOP_LEVELS + 1, 64):
        above = found.where(F.col("lvl") == lvl - 1).select(F.col("node").alias("up"), "copies")
        if above.isEmpty():
            break
        reached = counted(1 << (lvl - 1), 1 << lvl).withColumn("up", F.shiftright("node", 1)).join(above, "up")
        found = levels.keep(reached.select("node", F.lit(lvl).alias("lvl"), (F.col("copies") * F.col("times")).alias("copies")), "level")
    blocks = spark.read.schema(found.schema).parquet(*levels.paths).withColumn("block", F.explode(F.expr("sequence(0L, (copies - 1) div 65536)")))
    return blocks.select(F.explode(F.expr("array_repeat(node, CAST(least(65536, copies - 65536 * block) AS INT))")).alias("node"), "lvl")


#: Queries whose SQL holds on usual data only; it is what they are held against.
QUERIES = {"top_percent": top_percent, "connect_by": connect_by}
