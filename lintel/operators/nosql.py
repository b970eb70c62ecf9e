"""Further document, search, key-value and wide-column constructs as Spark SQL. ORACLE has DuckDB's spelling where it differs."""

from __future__ import annotations

SQL = {
    "join_lateral": "SELECT n.n_nationkey, x.top FROM nation n, LATERAL (SELECT max(c_acctbal) AS top FROM customer c WHERE c.c_nationkey = n.n_nationkey) x",
    # documents
    "mongo_sort": "SELECT event_id, value FROM events ORDER BY value DESC, event_id",
    "mongo_limit": "SELECT event_id FROM events ORDER BY event_id LIMIT 12",
    "mongo_skip": "SELECT r_name FROM region ORDER BY r_regionkey OFFSET 2",
    "mongo_chain": "SELECT count(*) AS n FROM (SELECT event_id FROM events WHERE value > 20 ORDER BY event_id LIMIT 40 OFFSET 10)",
    "mongo_graphlookup": """WITH RECURSIVE up(start, node, depth) AS (
        SELECT p_partkey, p_partkey, 0 FROM part WHERE p_size = 50
        UNION ALL SELECT u.start, p.p_partkey, u.depth + 1 FROM up u JOIN part p ON p.p_partkey = CAST(floor(u.node / 2) AS BIGINT) WHERE u.depth < 4)
        SELECT start, node, depth FROM up""",
    "mongo_replaceroot": "SELECT k.* FROM (SELECT named_struct('id', n_nationkey, 'name', n_name) AS k FROM nation)",
    "mongo_out_merge": """SELECT coalesce(t.k, s.k) AS k, coalesce(s.n, t.n) AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) t
        FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON t.k = s.k""",
    "mongo_arrays_q": "SELECT p_partkey, CAST(size(split(p_name, ' ')) AS BIGINT) AS n, element_at(split(p_name, ' '), 1) AS first FROM part WHERE array_contains(split(p_name, ' '), 'red')",
    "mongo_arrays_u": "SELECT n_nationkey, array_join(CAST(array_sort(array_union(array_remove(array(1, n_regionkey, 2), 1), array(7))) AS ARRAY<STRING>), ',') AS items FROM nation",
    "mongo_text": "SELECT p_partkey FROM part WHERE arrays_overlap(split(lower(p_name), ' '), array('green', 'red'))",
    "mongo_validator": "SELECT event_id, get_json_object(props, '$.k') IS NULL AS missing, coalesce(get_json_object(props, '$.k') RLIKE '^[0-9]+$', FALSE) AS whole FROM events",
    # search
    "es_join": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
    "es_span": "SELECT p_partkey FROM part WHERE array_position(split(p_name, ' '), 'red') > 0 AND array_position(split(p_name, ' '), 'red') <= 2",
    "es_ingest": "SELECT event_id AS id, upper(event_type) AS kind, CAST(floor(value) AS BIGINT) AS whole, 'v1' AS version FROM events",
    "es_reindex": "SELECT event_id, user_id, value FROM events WHERE event_type <> 'click'",
    "es_template": "SELECT n_nationkey, replace(replace('find {{name}} in {{region}}', '{{name}}', n_name), '{{region}}', CAST(n_regionkey AS STRING)) AS text FROM nation",
    # key-value
    "redis_scan": "SELECT DISTINCT concat('user:', user_id) AS k FROM events WHERE concat('user:', user_id) LIKE 'user:1%'",
    "redis_bits": "SELECT user_id, bit_or(event_id) AS bits, CAST(bit_count(bit_or(event_id)) AS INT) AS ones FROM events GROUP BY user_id",
    "redis_modules": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS top FROM events GROUP BY CAST(ts AS DATE)",
    # wide-column and key conditions
    "cql_batch": "SELECT o_custkey AS batch, count(*) AS statements, count(DISTINCT o_orderstatus) AS partitions, count(*) > 50 AS too_large FROM orders GROUP BY o_custkey",
    "cql_script": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) >= 3",
    "ddb_projection": "SELECT event_id, get_json_object(props, '$.k') AS k FROM events",
    "ddb_update": "SELECT event_id, coalesce(value, 0) + 1 AS value, concat(event_type, '!') AS event_type FROM events",
    "ddb_transact": "SELECT l_orderkey, count(*) AS items, count(*) <= 100 AS allowed FROM lineitem GROUP BY l_orderkey",
}

_words = "string_split(p_name, ' ')"

ORACLE = {
    "mongo_replaceroot": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "mongo_arrays_q": f"SELECT p_partkey, len({_words}) AS n, {_words}[1] AS first FROM part WHERE list_contains({_words}, 'red')",
    "mongo_arrays_u": "SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_concat(list_filter([1, n_regionkey, 2], lambda x: x <> 1), [7]))), ',') AS items FROM nation",
    "mongo_text": "SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['green', 'red'])",
    "mongo_validator": "SELECT event_id, json_extract_string(props, '$.k') IS NULL AS missing, coalesce(regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$'), FALSE) AS whole FROM events",
    "es_span": f"SELECT p_partkey FROM part WHERE coalesce(list_position({_words}, 'red'), 0) BETWEEN 1 AND 2",
    "ddb_projection": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
}
