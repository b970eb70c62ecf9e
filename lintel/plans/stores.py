"""Queries on texts of stores and scripts over corpora judged by hand, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import commands, rules, texts
from lintel.plans import corpus
from lintel.sources import stores
from lintel.sources.tables import TABLES, load, run_sql

#: Commands and, judged by hand, the rules that each breaks; marks as in the corpus of statements.
COMMANDS = [
    ("GET user:{k}", ""), ("", "RDS-SYNTAX-001!"), ("hmset h a 1", "RDS-HMSET-001?"), ("KEYS *", "RDS-KEYS-001!"), ("KEYS user:*", "RDS-KEYS-002"),
    ("FLUSHALL", "RDS-FLUSH-001!"), ("FLUSHDB ASYNC confirm", ""), ("SET session:{k} x", "RDS-SESS-001"), ("SET session:{k} x EX 60", ""), ("SET color red", ""),
    ("XADD s * f v", ""), ("XADD s", "RDS-XStream-010!"), ("XADD s MAXLEN 5 * f v", "RDS-XStream-004"), ("XADD s NOMKSTREAM MAXLEN ~ 5 * f v", ""), ("XADD s MAXLEN = 5 * f", "RDS-XStream-004 RDS-XStream-010!"),
    ("XREADGROUP GROUP g", "RDS-XStream-001!"), ("XREADGROUP GROUP g c STREAMS s >", ""), ("XGROUP CREATE s g $", "RDS-XStream-002"), ("XGROUP CREATE s g $ MKSTREAM", ""), ("XPENDING s g", "RDS-XStream-003?"),
    ("PUBLISH \"\" x", "RDS-PUB-002"), ("PUBSUB CHANNELS *", "RDS-PUB-003"), ("GEORADIUS g 1 2 3 km", "RDS-GEO-001"), ("GEOADD g 10 86 a", "RDS-GEO-002!"), ("GEOADD g 10 20 a 181 20 b", "RDS-GEO-003!"),
    ("GEOADD g 10 20 a", ""), ("GEODIST g a b miles", "RDS-GEO-004!"), ("GEODIST g a b KM", ""), ("PFCOUNT a b c d e f g h i j k", "RDS-HLL-001"), ("PFMERGE d a d", "RDS-HLL-002"),
    ("BITFIELD b GET u8 -1", "RDS-BIT-001!"), ("BITCOUNT b", "RDS-BIT-002?"), ("BITOP NOT d a b", "RDS-BIT-003!"), ("BITOP NOT d a", ""), ("SCRIPT FLUSH", "RDS-Script-001"),
    ("EVAL \"return redis.call(1)\" 0", "RDS-Script-003"), ("EVAL \"return redis.call(KEYS[1])\" 1 a", ""), ("ACL SETUSER u on +@all nopass", "RDS-ACL-001"), ("ACL SETUSER u on", "RDS-ACL-002!"), ("ACL DELUSER Default", "RDS-ACL-003!"),
    ("JSON.GET d", "RDS-MOD-001?"), ("FT.SEARCH i q", "RDS-MOD-001? RDS-MOD-002"), ("FT.SEARCH i q LIMIT 0 5", "RDS-MOD-001?"), ("SET \"a session key\" x", "RDS-SESS-001"),
]

#: CQL statements, the rules that each breaks, what it defines, its primary key and its parts as an aggregate.
CQL = [
    ("SELECT a FROM t WHERE id = {k}", "", "", ""), ("SELECT a FROM t", "CQL-FULLSCAN-001", "", ""), ("SELECT 1 WHERE a = 1", "CQL-STRUCT-SELECT!", "", ""),
    ("SELECT a FROM t WHERE b = 2 ALLOW FILTERING", "CQL-FILTER-001", "", ""), ("SELECT a FROM t WHERE id = 1 ORDER BY b", "CQL-ORDERBY-001", "", ""), ("SELECT a FROM t JOIN u WHERE id = 1", "CQL-JOIN-001!", "", ""),
    ("INSERT t (a) VALUES (1)", "CQL-STRUCT-INSERT!", "", ""), ("INSERT INTO t (a)", "CQL-STRUCT-INSERT-VALUES!", "", ""), ("INSERT INTO t (a) VALUES (1) USING TTL 30", "CQL-TTL-001", "", ""),
    ("INSERT INTO t (a) VALUES (1) USING TTL 0", "CQL-TTL-002!", "", ""), ("INSERT INTO t (a) VALUES (1) USING TTL -5", "CQL-TTL-003!", "", ""), ("INSERT INTO t (a) VALUES (1) USING TTL 600", "", "", ""),
    ("UPDATE t SET a = 1", "CQL-NOWHERE-001!", "", ""), ("UPDATE t WHERE id = 1", "CQL-STRUCT-UPDATE!", "", ""), ("UPDATE t SET a = a + [] WHERE id = 1", "CQL-COL-001", "", ""),
    ("UPDATE t SET m += {{}} WHERE id = 1", "CQL-COL-002", "", ""), ("UPDATE t SET a[-1] = 2 WHERE id = 1", "CQL-COL-004!", "", ""), ("DELETE FROM t", "CQL-NOWHERE-002!", "", ""),
    ("DELETE a WHERE id = 1", "CQL-STRUCT-DELETE!", "", ""), ("BEGIN BATCH INSERT INTO t (a) VALUES (1);", "CQL-BATCH-APPLY!", "", ""), ("BEGIN UNLOGGED BATCH DELETE FROM t WHERE id = 1; APPLY BATCH;", "", "", ""),
    ("CREATE TABLE ks.t (id int, c text, v text, PRIMARY KEY (id, c))", "", "CREATE|TABLE|ks.t", "id|c"), ("CREATE TABLE IF NOT EXISTS t (a int, b int, c int, d int, PRIMARY KEY ((a, b), c, d))", "", "CREATE|TABLE|t", "a b|c d"),
    ("CREATE TABLE u (id uuid PRIMARY KEY, tags set<address>)", "CQL-UDT-001!", "CREATE|TABLE|u", "id|"), ("CREATE TABLE (a int PRIMARY KEY)", "CQL-STRUCT-CREATE-TABLE!", "", "a|"),
    ("CREATE INDEX ON t (a)", "CQL-IDX-002?", "CREATE|INDEX|", ""), ("CREATE CUSTOM INDEX i ON t (a)", "CQL-IDX-004", "CREATE|INDEX|i", ""), ("CREATE CUSTOM INDEX i ON t (a) USING 'org.Sasi'", "", "CREATE|INDEX|i", ""),
    ("CREATE MATERIALIZED VIEW v AS SELECT a FROM t WHERE a IS NOT NULL PRIMARY KEY (a)", "", "CREATE|MATERIALIZED VIEW|v", ""), ("ALTER TYPE address RENAME zip TO code", "CQL-UDT-002!", "ALTER|TYPE|address", ""),
    ("ALTER TYPE address ADD zip text", "", "ALTER|TYPE|address", ""), ("DROP TABLE IF EXISTS t", "", "DROP|TABLE|t", ""), ("CREATE OR REPLACE AGGREGATE avg2(int) SFUNC step STYPE tuple<int, bigint> FINALFUNC done INITCOND (0, 0)", "", "CREATE|AGGREGATE|avg2", ""),
    ("SELECT WRITETIME(*) FROM t WHERE id = 1", "CQL-WT-002!", "", ""), ("SELECT TTL(*) FROM t WHERE id = 1", "CQL-TTL-005!", "", ""), ("SELECT WRITETIME(id), TTL(v), TTL(C) FROM ks.t WHERE id = 1", "", "", ""),
    ("hello world", "CQL-STRUCT-START!", "", ""), ("-- nothing", "CQL-EMPTY!", "", ""), ("SELECT a FROM t WHERE b = 'ORDER BY JOIN'", "", "", ""),
]

#: Primary keys by table for WRITETIME and TTL, and by table of the folder, which files don't carry.
CQL_KEYS = {"t": ["id", "c"]}
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"]}

#: Commands by remainder of the order key, in the scripts that customers' orders make.
SCRIPTED = ["MULTI", "SET a {k}", "EXEC", "WATCH a", "BLPOP q 0", "DISCARD", "KEYS *", "UNWATCH", "SUBSCRIBE a", "PSUBSCRIBE b", "GET a"]

#: Scripts with a dialect and their statements.
SCRIPTS = [
    ("mysql", "SELECT 1; SELECT 2;", ["SELECT 1", "SELECT 2"]),
    ("mysql", "SELECT '';'' ;  -- a ; b", ["SELECT ''", "''", "-- a ; b"]),
    ("postgresql", 'SELECT "a;b", \'it\'\'s;\' FROM t; ;; /* x ; y */ SELECT 3', ['SELECT "a;b", \'it\'\'s;\' FROM t', "/* x ; y */ SELECT 3"]),
    ("mysql", "SELECT 1 # one ; two", ["SELECT 1 # one ; two"]),
    ("postgresql", "SELECT 1 # 2; SELECT 5 - 3 / 2", ["SELECT 1 # 2", "SELECT 5 - 3 / 2"]),
    ("mysql", " ; ", []),
]

#: Copies with entity, direction and file.
COPIES = [("COPY t FROM 'a.csv'", "t|FROM|a.csv"), ("copy s.t (a, b) to 'b.csv'", "s.t|TO|b.csv"), ("COPY t TO STDOUT", "t|TO|STDOUT"), ("SELECT 'COPY t FROM x'", ""), ("COPY t", "")]

#: Statements with their tokens and the depth of their brackets.
MEASURED = [("SELECT a, b FROM t", 6, 0), ("SELECT f(g(1.5), 'x(') FROM t -- (((", 12, 2), ("", 0, 0), ("a >= 1 AND (b <> 2)", 9, 1)]

#: Explanations by code and locale, and codes that stand for others.
EXPLAINED = [
    ("SE007", "en", "Text from outside may change the statement", "It is joined to the statement as text", "WHERE name = '' OR '1'='1'", "WHERE name = ?"),
    ("SE007", "es", "Un texto externo puede cambiar la sentencia", "Se une a la sentencia como texto", "WHERE name = '' OR '1'='1'", "WHERE name = ?"),
    ("SEM-001", "en", "All rows go", "There is no WHERE", "DELETE FROM t", "DELETE FROM t WHERE id = 1"),
]
ALIASES = {"SEM-002": "SEM-001"}

#: Words by code for summaries.
MESSAGES = {"SE007": "Possible SQL injection detected"}

FIND = 'db.events.find({"event_type": {"$in": ["click", "view"]}, "value": {"$gt": 20, "$lte": 200}, "$or": [{"props.k": {"$lt": 30}}, {"user_id": 7}], "missing": null, "$nor": [{"props.k": 5}]}).limit(3)'
SEARCH = '{"query": {"bool": {"must": [{"range": {"value": {"gte": 10}}}, {"wildcard": {"event_type": "?*i*"}}], "must_not": [{"term": {"props.k": 5}}], "should": [{"prefix": {"event_type": "cl"}}, {"match": {"event_type": "View, SIGNUP!"}}], "minimum_should_match": 1}}, "sort": [{"value": "desc"}], "from": 5, "size": 20, "_source": ["event_id", "value"]}'


def _rows(pairs: list[tuple[str, str]]) -> str:
    """SQL for (query_id, text, dialect) of statements without a dialect."""
    return corpus.query_corpus([("mysql", s, "") for s, _ in pairs])


def _judged(columns: str, values: list[tuple], n: int, key: str = "query_id") -> str:
    """DuckDB's SQL for rows that were judged by hand: `values` are a slot of the order key and its columns."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(quote(v) for v in row)})" for row in values)
    return f"SELECT o_orderkey AS {key}, {columns} FROM orders JOIN (VALUES {rows}) e(slot, {columns}) ON o_orderkey % {n} = e.slot"


def _marked(codes: list[str]) -> str:
    found = [(i, c.rstrip("!?"), corpus.MARKS.get(c[-1], "WARNING")) for i, cs in enumerate(codes) for c in cs.split()]
    return _judged("code, severity", found, len(codes))


def _scripted() -> str:
    """SQL for (script_id, stmt_no, text): a script for each customer, its commands in order of the order key."""
    return f"SELECT o_custkey AS script_id, query_id AS stmt_no, text FROM ({corpus.query_corpus([('redis', s, '') for s in SCRIPTED])}) q JOIN orders ON o_orderkey = query_id"


def _cql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, _rows([(s, "") for s, *_ in CQL]))


def rds_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.command_findings(run_sql(spark, sf_dir, _rows(COMMANDS)))


def an_xscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on the order of a script's commands."""
    return commands.script_findings(run_sql(spark, sf_dir, _scripted()))


def redis_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on transactions alone."""
    return an_xscript(spark, sf_dir).where(F.col("code").startswith("RDS-TX"))


def cql_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.cql_findings(_cql(spark, sf_dir))


def cql_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.cql_cell_findings(_cql(spark, sf_dir), CQL_KEYS)


def cql_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.cql_definitions(_cql(spark, sf_dir))


def cql_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.cql_primary_key(_cql(spark, sf_dir))


def cql_uda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.cql_aggregates(_cql(spark, sf_dir))


def scan_mongo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.find({"events": load(spark, sf_dir, "events")}, FIND).select("event_id", "event_type", "value")


def scan_elastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.search(load(spark, sf_dir, "events"), SEARCH, "event_id")


def scan_redis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands on nations by key; some keys have none."""
    store = load(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey")).alias("key"), F.col("n_name").alias("value"))
    asked = "SELECT o_orderkey AS query_id, concat(CASE o_orderkey % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'strlen' WHEN 2 THEN 'EXISTS' WHEN 3 THEN 'TYPE' ELSE 'POP' END, ' \"nation ', CAST(o_orderkey % 31 AS STRING), '\"') AS text FROM orders"
    return stores.lookup(store, run_sql(spark, sf_dir, asked))


def catalog_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: load(spark, sf_dir, name) for name in TABLES}
    return spark.createDataFrame(stores.schema_rows(tables, KEYS), "entity string, field string, place int, kind string, is_key boolean")


def split_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, corpus.query_corpus([(d, s, "") for d, s, _ in SCRIPTS]))
    return texts.split_statements(rows.withColumnRenamed("query_id", "script_id"))


def sink_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.copies(run_sql(spark, sf_dir, _rows(COPIES)))


def an_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.measures(run_sql(spark, sf_dir, _rows([(s, "") for s, *_ in MEASURED])))


def explain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(EXPLAINED, "code string, locale string, what string, why string, example string, corrected string")
    return texts.explained(rules.findings(run_sql(spark, sf_dir, corpus.query_corpus())), known, ALIASES, "en-GB")


def gen_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.error_summaries(run_sql(spark, sf_dir, corpus.query_corpus()), MESSAGES)


def mongo_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 events that is the same at each run: those of the smallest digests of their ids."""
    return load(spark, sf_dir, "events").orderBy(F.md5(F.col("event_id").cast("string")), "event_id").limit(50).select("event_id", "event_type")


QUERIES = {f.__name__: f for f in (rds_findings, an_xscript, redis_tx, cql_findings, cql_meta, cql_ddl, cql_pk, cql_uda, scan_mongo, scan_elastic, scan_redis, catalog_schema, split_statements, sink_copy, an_metrics, explain_join, gen_explain, mongo_sample)}

_fold = f"""
WITH s AS (SELECT script_id, stmt_no, split_part(text, ' ', 1) AS cmd FROM ({_scripted().replace('STRING', 'VARCHAR')})),
o AS (SELECT *, coalesce(last_value(CASE cmd WHEN 'MULTI' THEN 1 WHEN 'EXEC' THEN 0 WHEN 'DISCARD' THEN 0 END IGNORE NULLS) OVER (PARTITION BY script_id ORDER BY stmt_no ROWS UNBOUNDED PRECEDING), 0) AS open,
  last_value(CASE cmd WHEN 'WATCH' THEN 1 WHEN 'EXEC' THEN 0 WHEN 'UNWATCH' THEN 0 END IGNORE NULLS) OVER (PARTITION BY script_id ORDER BY stmt_no ROWS UNBOUNDED PRECEDING) AS watched FROM s),
b AS (SELECT *, coalesce(lag(open) OVER (PARTITION BY script_id ORDER BY stmt_no), 0) AS before FROM o),
n AS (SELECT script_id, code, count(*) AS n FROM (SELECT script_id, CASE WHEN cmd = 'WATCH' AND before = 1 THEN 'RDS-TX-001' WHEN cmd = 'EXEC' AND before = 0 THEN 'RDS-TX-002' WHEN cmd = 'DISCARD' AND before = 0 THEN 'RDS-TX-003'
  WHEN cmd = 'BLPOP' AND open = 1 THEN 'RDS-TX-004' WHEN cmd = 'KEYS' AND open = 1 THEN 'RDS-PIP-001' END AS code FROM b) WHERE code IS NOT NULL GROUP BY ALL)
SELECT * FROM n UNION ALL SELECT script_id, 'RDS-TX-005', 1 FROM b GROUP BY script_id HAVING arg_max(open, stmt_no) = 1
UNION ALL SELECT script_id, 'RDS-PIP-003', 1 FROM b GROUP BY script_id HAVING arg_max(coalesce(watched, 0), stmt_no) = 1
UNION ALL SELECT script_id, 'RDS-PUB-001', 1 FROM b GROUP BY script_id HAVING bool_or(cmd = 'SUBSCRIBE') AND bool_or(cmd = 'PSUBSCRIBE')"""

_k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_defined = [(i, *[p or None for p in d.split("|")]) for i, (_, _, d, _) in enumerate(CQL) if d]
_keyed = [(i, part, at, f) for i, (_, _, _, pk) in enumerate(CQL) if pk for part, fields in zip(("partition", "clustering"), pk.split("|")) for at, f in enumerate(fields.split(), 1)]
_cells = [(i, c, f) for i, (s, *_) in enumerate(CQL) if "TTL(C)" in s for c, f in (("CQL-WT-001", "id"), ("CQL-TTL-004", "c"))]
_aggregates = [(i, "avg2", "int", "step", "tuple<int, bigint>", "done", "(0, 0)") for i, (s, *_) in enumerate(CQL) if "AGGREGATE" in s]
_copied = [(i, *c.split("|")) for i, (_, c) in enumerate(COPIES) if c]
_catalog = ", ".join(f"('{t}', '{k}')" for t, ks in KEYS.items() for k in ks)
_tables = ", ".join(f"'{t}'" for t in TABLES)
_told = ", ".join(f"('{c}', " + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for c, locale, *row in [*EXPLAINED, *[(a, *next(e[1:] for e in EXPLAINED if e[0] == c)) for a, c in ALIASES.items()]] if locale == "en")
_listed = "concat('Error summary for your query:\n\n1. [', code, '] ', CASE code WHEN 'SE007' THEN 'Possible SQL injection detected' ELSE code END, '\n\nReview syntax for engine ', dialect, '.')"

ORACLE = {
    "rds_findings": _marked([c for _, c in COMMANDS]),
    "an_xscript": _fold,
    "redis_tx": f"SELECT * FROM ({_fold}) WHERE code LIKE 'RDS-TX%'",
    "cql_findings": _marked([c for _, c, _, _ in CQL]),
    "cql_meta": _judged("code, field", _cells, len(CQL)),
    "cql_ddl": _judged("action, kind, name", _defined, len(CQL)),
    "cql_pk": _judged("part, place, field", _keyed, len(CQL)),
    "cql_uda": _judged("name, argument, step, state, final, initial", _aggregates, len(CQL)),
    "scan_mongo": f"SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value > 20 AND value <= 200 AND ({_k} < 30 OR user_id = 7) AND {_k} <> 5",
    "scan_elastic": f"SELECT event_id, value FROM events WHERE value >= 10 AND event_type IN ('click', 'view', 'signup') AND {_k} <> 5 ORDER BY value DESC, event_id LIMIT 20 OFFSET 5",
    "scan_redis": """SELECT o_orderkey AS query_id, CASE o_orderkey % 5 WHEN 0 THEN coalesce(n_name, 'null') WHEN 1 THEN CAST(coalesce(strlen(n_name), 0) AS VARCHAR) WHEN 2 THEN CASE WHEN n_name IS NULL THEN '0' ELSE '1' END
        WHEN 3 THEN CASE WHEN n_name IS NULL THEN 'none' ELSE 'string' END ELSE 'ERR unknown command POP' END AS result FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 31""",
    "catalog_schema": f"""SELECT table_name AS entity, column_name AS field, ordinal_position AS place,
        CASE WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type LIKE 'TIME%' OR data_type = 'DATE' THEN 'time' ELSE 'number' END AS kind, (table_name, column_name) IN ({_catalog}) AS is_key
        FROM information_schema.columns WHERE table_name IN ({_tables})""",
    "split_statements": _judged("stmt_no, text", [(i, at, s) for i, (_, _, found) in enumerate(SCRIPTS) for at, s in enumerate(found, 1)], len(SCRIPTS), "script_id"),
    "sink_copy": _judged("entity, direction, file", _copied, len(COPIES)),
    "an_metrics": _judged("tokens, depth", [(i, t, d) for i, (_, t, d) in enumerate(MEASURED)], len(MEASURED)),
    "explain_join": f"SELECT f.*, e.what, e.why, e.example, e.corrected FROM ({corpus.expected_findings()}) f LEFT JOIN (VALUES {_told}) e(code, what, why, example, corrected) ON e.code = f.code",
    "gen_explain": f"""SELECT q.query_id, CASE WHEN code IS NULL THEN 'No structural errors to explain.' ELSE {_listed} END AS text
        FROM ({corpus.query_corpus().replace('STRING', 'VARCHAR')}) q LEFT JOIN (SELECT * FROM ({corpus.expected_findings()}) WHERE severity = 'ERROR') f ON f.query_id = q.query_id""",
    "mongo_sample": "SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 50",
}
