"""Analysis of statements, schema checks, history and statement scripts as Spark SQL over the corpora.

DuckDB's SQL is the same but for the names of functions in RENAMED, and where ORACLE has another spelling.
"""

from __future__ import annotations

from lintel.plans.corpus import query_corpus

#: Tables and columns of the schema that references are checked against.
COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}
#: Columns above that hold text.
TEXT = ["o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment"]

#: First words of key-value commands in the corpora.
COMMANDS = "GET|KEYS|HGETALL|LRANGE|SMEMBERS|ZRANGE|PING|EXPIRE"

_known = ", ".join(f"('{t}', '{c}', '{'text' if c in TEXT else 'number'}')" for t, cs in COLUMNS.items() for c in cs)
_refs = f"""WITH known(t, c, kind) AS (SELECT * FROM (VALUES {_known}) AS v(t, c, kind)),
r AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'customer' ELSE 'users' END AS t,
      CASE o_orderkey % 4 WHEN 0 THEN 'o_orderkey' WHEN 1 THEN 'c_name' WHEN 2 THEN 'email' ELSE 'o_custkey' END AS c,
      CASE o_orderkey % 5 WHEN 0 THEN 'text' ELSE 'number' END AS kind FROM orders) """
_q = f"WITH q AS ({query_corpus()}) "
_history = """WITH h AS (SELECT event_id AS id, user_id, ts, concat('SELECT ', event_type, ' FROM events') AS text, event_id % 3 <> 0 AS valid, event_id % 5 = 0 AS favourite FROM events) """

_rad = lambda x: f"radians({x})"
_lat, _lon = "(user_id % 90 - 45)", "(event_id % 360 - 180)"
_km = f"12742 * asin(sqrt(pow(sin({_rad(f'{_lat} - 10')} / 2), 2) + cos({_rad(_lat)}) * cos({_rad('10')}) * pow(sin({_rad(f'{_lon} - 20')} / 2), 2)))"

SQL = {
    # statements
    "an_wrong_engine": _q + f"SELECT query_id, 'SQL-WRONG-ENGINE' AS code FROM q WHERE text LIKE 'db.%' OR regexp_like(text, '^({COMMANDS})( |$)')",
    "an_engine_route": _q + f"SELECT query_id, CASE WHEN text LIKE 'db.%' THEN 'MONGO' WHEN regexp_like(text, '^({COMMANDS})( |$)') THEN 'REDIS' WHEN regexp_like(text, '(?i)^(SELECT|INSERT|UPDATE|DELETE|WITH|CREATE|DROP|ALTER) ') THEN 'SQL' ELSE 'UNKNOWN-ENGINE' END AS engine FROM q",
    "an_injection": _q + "SELECT query_id, 'SE007' AS code FROM q WHERE regexp_like(text, '(?i)''[ ]*OR[ ]*''[^'']*''[ ]*=[ ]*''') OR regexp_like(text, '(?i)(OR|AND)[ ]+[0-9]+[ ]*=[ ]*[0-9]+') OR regexp_like(text, '(?i)UNION[ ]+(ALL[ ]+)?SELECT')",
    "an_rewrite_star": _q + f"SELECT query_id, CASE WHEN text LIKE 'SELECT * FROM orders%' THEN concat('SELECT {', '.join(COLUMNS['orders'])}', substr(text, 9)) ELSE text END AS text FROM q WHERE text LIKE 'SELECT *%'",
    "an_rewrite_limit": _q + "SELECT query_id, concat(text, ' LIMIT 100') AS text FROM q WHERE regexp_like(text, '(?i)^SELECT ') AND NOT regexp_like(text, '(?i)LIMIT[ ]+[0-9]+')",
    "an_self_cmp": _q + "SELECT query_id, 'SE-SELF-CMP' AS code FROM q WHERE regexp_extract(text, 'WHERE.* ([A-Za-z_]{2,}) = ([A-Za-z_]{2,})', 1) <> '' AND regexp_extract(text, 'WHERE.* ([A-Za-z_]{2,}) = ([A-Za-z_]{2,})', 1) = regexp_extract(text, 'WHERE.* ([A-Za-z_]{2,}) = ([A-Za-z_]{2,})', 2)",
    "an_limit_unordered": _q + "SELECT query_id, 'SE010' AS code FROM q WHERE regexp_like(text, '(?i)LIMIT[ ]+[0-9]+') AND NOT regexp_like(text, '(?i)ORDER BY')",
    "an_dedupe": _q + "SELECT kind, min(query_id) AS query_id FROM (SELECT query_id, regexp_extract(text, '^([A-Za-z.]+)', 1) AS kind FROM q) GROUP BY kind",
    "an_multi_mysql": "SELECT o_custkey AS script_id, concat('[Stmt ', CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS STRING), '] ', o_orderstatus) AS error FROM orders",
    "gen_sql": "SELECT n_nationkey, concat('SELECT n_name FROM nation WHERE n_nationkey = ', CAST(n_nationkey AS STRING), ';') AS text FROM nation",
    # schema
    "an_schema_entity": _refs + "SELECT r.query_id, 'SCH-001' AS code, r.t AS entity FROM r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.t = r.t)",
    "an_schema_field": _refs + "SELECT r.query_id, 'SCH-002' AS code, r.t AS entity, r.c AS field FROM r WHERE EXISTS (SELECT 1 FROM known k WHERE k.t = r.t) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.t = r.t AND k.c = r.c)",
    "an_schema_type": _refs + "SELECT r.query_id, 'SCH-003' AS code, r.c AS field FROM r JOIN known k ON k.t = r.t AND k.c = r.c WHERE k.kind <> r.kind",
    # history
    "hist_list": _history + "SELECT id, text, valid FROM h WHERE user_id = 7",
    "hist_fav": _history + "SELECT id, text FROM h WHERE user_id = 7 AND favourite",
    "hist_valid": _history + "SELECT id, user_id FROM h WHERE valid ORDER BY id DESC",
    "hist_invalid": _history + "SELECT id, user_id FROM h WHERE NOT valid ORDER BY id DESC",
    "hist_search": _history + "SELECT id FROM h WHERE trim(' CLICK ') <> '' AND contains(lower(text), lower(trim(' CLICK ')))",
    "hist_update": _history + "SELECT id, NOT favourite AS favourite, coalesce(nullif(trim(CASE WHEN id % 2 = 0 THEN ' ' ELSE 'new' END), ''), text) AS text FROM h",
    "hist_delete": _history + "SELECT id FROM h WHERE NOT (user_id = 7)",
    # definitions and grants
    "ddl_create_table": "SELECT 'primary key' AS rule, count(*) AS broken FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1) UNION ALL SELECT 'foreign key', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey) UNION ALL SELECT 'not null', count(*) FROM customer WHERE c_name IS NULL",
    "ddl_create_view": "WITH v AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, max(o_totalprice) AS top FROM v GROUP BY o_custkey",
    "ddl_create_matview": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
    "ddl_create_index": "SELECT count(*) = count(DISTINCT c_name) AS is_unique FROM customer",
    "ddl_alter": "SELECT n_nationkey AS id, CAST(n_regionkey AS BIGINT) AS region, 'x' AS added FROM nation",
    "dcl_grant": "SELECT o_custkey AS principal, o_orderstatus AS privilege, granted FROM (SELECT o_custkey, o_orderstatus, o_orderkey % 2 = 0 AS granted, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND granted",
    "dcl_revoke": "SELECT o_custkey AS principal, o_orderstatus AS privilege FROM (SELECT o_custkey, o_orderstatus, o_orderkey % 2 = 0 AS granted, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND NOT granted",
    "infer_doc_schema": "SELECT CASE WHEN k IS NULL THEN 'absent' ELSE 'k' END AS field, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS kind FROM (SELECT get_json_object(props, '$.k') AS k, CASE WHEN regexp_like(get_json_object(props, '$.k'), '^-?[0-9]+$') THEN 'int' ELSE 'string' END AS kind FROM (SELECT props FROM events ORDER BY event_id LIMIT 10)) GROUP BY 1",
    # places: each event at a latitude and longitude made from its keys
    "mongo_geonear": f"SELECT event_id, round({_km}, 3) AS km FROM events WHERE {_km} < 2000",
    "mongo_geowithin": f"SELECT event_id FROM events WHERE {_lat} BETWEEN -10 AND 10 AND {_lon} BETWEEN 0 AND 40",
    "es_geo": f"SELECT floor({_lat} / 10.0) AS cell_lat, floor({_lon} / 10.0) AS cell_lon, count(*) AS n FROM events GROUP BY 1, 2",
    "redis_geo": f"SELECT event_id, round({_km}, 3) AS km FROM events WHERE {_km} BETWEEN 500 AND 1500",
    # key-value and wide-column scripts
    "redis_hll_exact": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "cql_dcl": "SELECT c_custkey AS role_id, length(c_mktsegment) < 9 AS weak FROM customer",
    "es_agg_depth": "SELECT p_partkey, p_size % 7 AS depth, p_size % 7 > 4 AS too_deep FROM part",
}

#: Names of functions in Spark and in DuckDB.
RENAMED = {"regexp_like(": "regexp_matches(", "get_json_object(": "json_extract_string("}


def _duck(text: str) -> str:
    for ours, theirs in RENAMED.items():
        text = text.replace(ours, theirs)
    return text


ORACLE = {k: _duck(v) for k, v in SQL.items()}
