"""Corpora of statements, made alike by Spark and by DuckDB from the tables."""

from __future__ import annotations

#: For each remainder of the order key a dialect, a statement ({k} stands for the key) and, judged by hand,
#: the rules that it breaks: a code with ! is an error, with ? a note, else a warning.
STATEMENTS = [
    ("mysql", "SELECT * FROM orders WHERE o_orderkey = {k}", ""),
    ("mysql", "DELETE FROM orders", "SEM-001"),
    ("sqlite", "UPDATE orders SET o_orderstatus = 'F'", "SEM-002"),
    ("mysql", "SELECT c_name FROM customer WHERE c_name LIKE '%'", "SE-LIKE-ALL"),
    ("oracle", "SELECT c_name FROM customer WHERE c_acctbal = NULL", "SE-NULL-EQUALS"),
    ("mysql", "SELECT o_orderkey FROM orders WHERE o_totalprice / 0 > {k}", "SE-DIV-ZERO"),
    ("mysql", "SELECT o_orderkey FROM orders WHERE 1=1", "SE-TAUTOLOGY"),
    ("postgresql", "SELECT o_orderkey FROM orders WHERE o_orderkey = o_orderkey LIMIT 5", "SE-SELF-CMP SE010"),
    ("mysql", "SELECT o_orderkey FROM orders, lineitem WHERE o_totalprice > {k}", "SE-CARTESIAN"),
    ("mysql", "SELECT id FROM t WHERE name = 'a' OR '1'='1'", "SE007!"),
    ("mongodb", "db.orders.find({{}})", ""),
    ("redis", "GET user:{k}", ""),
    ("sqlserver", "SELECT a FROM t WHERE a IN (SELECT b FROM u)", ""),
    ("mysql", "SELECT DISTINCT o_orderstatus FROM orders ORDER BY o_orderstatus", ""),
    ("mysql", "DELETE FROM orders WHERE 1=1", "SE-TAUTOLOGY SE-DANGER-SCOPE"),
    ("mysql", "SELECT name FROM t WHERE c = '' AND d BETWEEN 9 AND 2", "SE-EMPTY-STR SE-BETWEEN-INV"),
    ("mysql", "SELECT name FROM t WHERE d BETWEEN 2 AND 9 AND e BETWEEN 7 AND 3", "SE-BETWEEN-INV"),
    ("mysql", "SELECT name FROM t WHERE name LIKE '%ab%'", "SE-LIKE-SHORT"),
    ("mysql", "SELECT name FROM t WHERE name LIKE '%long%'", ""),
    ("mysql", "SELECT name FROM t WHERE a IN ( )", "SE-EMPTY-IN"),
    ("mysql", "SELECT name FROM t WHERE 1 = 0", "SE-IMPOSSIBLE"),
    ("mysql", "SELECT name FROM t WHERE FALSE", "SE-IMPOSSIBLE"),
    ("mysql", "SELECT name FROM t WHERE note = 'WHERE 1=1'", ""),
    ("mysql", "SELECT name FROM t WHERE b = 'x' AND b = 'y'", "SE-CONTRADICTS"),
    ("mysql", "SELECT name FROM t WHERE b = 'x' AND b = 'x'", ""),
    ("mysql", "SELECT name FROM t WHERE n > 10 AND n < 5", "SE-RANGE-IMPOSSIBLE"),
    ("mysql", "SELECT name FROM t WHERE n > 5 AND n < 10", ""),
    ("postgresql", "INSERT INTO t VALUES (1, 2)", "SE-INSERT-NO-COLS"),
    ("postgresql", "INSERT INTO t (a, b) VALUES (1, 2)", ""),
    ("mysql", "SELECT a FROM t UNION SELECT b FROM u", "SE007!"),
    ("mysql", "SELECT a FROM t WHERE b = 2 OR 3 = 3", "SE007!"),
    ("mysql", "SELECT a FROM t WHERE b = 'x'; DROP TABLE t", "SE007!"),
    ("mysql", "SELECT a FROM t, u WHERE t.id = u.id", ""),
    ("mysql", "SELECT * FROM t JOIN u ON t.id = u.id", "SE004"),
    ("mysql", "INSERT INTO t (a) VALUES (1) ON DUPLICATE KEY UPDATE a = 2", "MY001"),
    ("sqlite", "INSERT INTO t (a) VALUES (1) ON DUPLICATE KEY UPDATE a = 2", ""),
    ("mysql", "SELECT a FROM t LIMIT 3", "SE010 MY003"),
    ("mysql", "SELECT a FROM t ORDER BY a LIMIT 3", ""),
    ("mysql", "SELECT PASSWORD(a) FROM t", "MY004"),
    ("postgresql", "SELECT PASSWORD(a) FROM t", ""),
    ("mysql", "SELECT j.x FROM JSON_TABLE(doc) AS j", "MY005?"),
    ("postgresql", "SELECT a FROM t WHERE a ILIKE 'some%'", "PG001?"),
    ("mysql", "SELECT a FROM t WHERE a ILIKE 'some%'", ""),
    ("postgresql", "CREATE TABLE t (id SERIAL)", "PG003?"),
    ("postgresql", "WITH RECURSIVE r AS (SELECT 1) SELECT n FROM r", "PG006!"),
    ("sqlite", "SELECT a FROM t RIGHT JOIN u ON t.id = u.id", "LT001!"),
    ("oracle", "SELECT a FROM t RIGHT JOIN u ON t.id = u.id", ""),
    ("sqlite", "ALTER TABLE t DROP COLUMN a", "LT002!"),
    ("sqlite", "CREATE TABLE t (a INT REFERENCES u (id))", "LT003"),
    ("sqlite", "CREATE TABLE t (a DATETIME)", "LT004?"),
    ("sqlite", "SELECT sum(a) OVER (PARTITION BY b) FROM t", "LT005?"),
    ("postgresql", "SELECT sum(a) OVER (PARTITION BY b) FROM t", ""),
    ("sqlite", "CREATE TABLE t (a INT) WITHOUT ROWID", "LT006!"),
    ("sqlserver", "SELECT TOP 5 a FROM t", "SS001"),
    ("sqlserver", "SELECT a FROM t WITH (NOLOCK)", "SS002"),
    ("sqlserver", "SELECT a INTO #x FROM t", "SS003?"),
    ("sqlserver", "DECLARE c CURSOR FOR SELECT a FROM t", "SS004"),
    ("sqlserver", "MERGE t USING u ON t.id = u.id WHEN MATCHED THEN DELETE", "SS006?"),
    ("sqlserver", "SELECT @@IDENTITY", "SS007"),
    ("sqlserver", "CREATE TABLE t (a NTEXT)", "SS008"),
    ("oracle", "SELECT a FROM t WHERE ROWNUM > 5 ORDER BY a", "ORA002"),
    ("oracle", "SELECT a FROM t WHERE ROWNUM < 5", "ORA003"),
    ("oracle", "SELECT NVL(a, 0) FROM t", "ORA004?"),
    ("oracle", "SELECT DECODE(a, 1, 2) FROM t", "ORA005?"),
    ("oracle", "CREATE TABLE t (a VARCHAR(5))", "ORA006"),
    ("oracle", "CREATE TABLE t (a VARCHAR2(5))", ""),
    ("oracle", "SELECT a FROM t CONNECT BY PRIOR a = b", "ORA008"),
]

#: Severity by the mark behind a code above.
MARKS = {"!": "ERROR", "?": "INFO"}


#: Statements of MySQL and, judged by hand, the suggestions for each in their order, and the fields that it
#: selects beside GROUP BY without grouping by them.
ADVISED = [
    ("SELECT * FROM orders WHERE o_orderkey = {k}", "OPT-001 OPT-003", ""),
    ("SELECT a FROM t WHERE b = {k} LIMIT 10", "", ""),
    ("SELECT count(*) FROM t LIMIT 10", "", ""),
    ("SELECT a, t.* FROM t LIMIT 10", "OPT-001", ""),
    ("SELECT a * b FROM t LIMIT 10", "", ""),
    ("SELECT t.a FROM t, u WHERE t.id = u.id LIMIT 10", "OPT-004", ""),
    ("SELECT t.a FROM t AS x, u WHERE t.n > 5 LIMIT 10", "OPT-008", ""),
    ("SELECT a FROM t WHERE a IN (SELECT b FROM u LIMIT 3)", "OPT-005 OPT-003", ""),
    ("SELECT a FROM t WHERE a NOT IN (SELECT b FROM u) LIMIT 5", "OPT-005 OPT-009", ""),
    ("SELECT a FROM t WHERE EXISTS (SELECT b FROM u ORDER BY b) LIMIT 5", "OPT-005 OPT-010", ""),
    ("SELECT a FROM t WHERE a = NULL LIMIT 5", "OPT-006", ""),
    ("UPDATE t SET a = NULL WHERE b = 1", "", ""),
    ("SELECT a FROM t WHERE a >= 1 AND b LIKE '%x'", "OPT-011 OPT-003", ""),
    ("SELECT a FROM t WHERE b = 'LIMIT 5'", "OPT-003", ""),
    ("SELECT a, sum(b) FROM t GROUP BY a LIMIT 5", "", ""),
    ("SELECT a, b, sum(c) AS s FROM t GROUP BY a LIMIT 5", "", "b"),
    ("SELECT t.a AS x, B y, coalesce(c, max(d), e) FROM t GROUP BY T.A ORDER BY 1 LIMIT 5", "", "b"),
    ("SELECT a, b, c FROM t WHERE d = {k} GROUP BY a HAVING count(*) > 1", "OPT-003", "b c"),
]


def query_corpus(statements: list[tuple[str, str, str]] = STATEMENTS, shift: int = 0) -> str:
    """SQL for (query_id, text, dialect), the same in Spark and DuckDB; `shift` gives each key a later one's statement."""
    def text(s: str) -> str:
        quoted = s.replace("{{", "{").replace("}}", "}").replace("'", "''") if "{k}" not in s else s.replace("'", "''")
        parts = [f"'{p}'" for p in quoted.split("{k}")]
        return parts[0] if len(parts) == 1 else f"concat({', CAST(o_orderkey AS STRING), '.join(parts)})"

    slot = f"(o_orderkey + {shift}) % {len(statements)}"
    texts = " ".join(f"WHEN {i} THEN {text(s)}" for i, (_, s, _) in enumerate(statements))
    dialects = " ".join(f"WHEN {i} THEN '{d}'" for i, (d, _, _) in enumerate(statements))
    return f"SELECT o_orderkey AS query_id, CASE {slot} {texts} END AS text, CASE {slot} {dialects} END AS dialect FROM orders"


def advised_corpus() -> str:
    return query_corpus([("mysql", s, codes) for s, codes, _ in ADVISED])


def expected_advice() -> str:
    """DuckDB's SQL for (query_id, place, code, impact), from what was judged by hand."""
    impact = {"OPT-003": "MEDIUM", "OPT-004": "MEDIUM", "OPT-009": "MEDIUM", "OPT-010": "LOW"}
    values = ", ".join(f"({i}, {at}, '{c}', '{impact.get(c, 'HIGH')}')" for i, (_, codes, _) in enumerate(ADVISED) for at, c in enumerate(codes.split(), 1))
    return f"SELECT o_orderkey AS query_id, CAST(place AS BIGINT) AS place, code, impact FROM orders JOIN (VALUES {values}) e(slot, place, code, impact) ON o_orderkey % {len(ADVISED)} = e.slot"


def expected_ungrouped() -> str:
    """DuckDB's SQL for (query_id, code, field), from what was judged by hand."""
    values = ", ".join(f"({i}, '{f}')" for i, (_, _, fields) in enumerate(ADVISED) for f in fields.split())
    return f"SELECT o_orderkey AS query_id, 'MY002' AS code, field FROM orders JOIN (VALUES {values}) e(slot, field) ON o_orderkey % {len(ADVISED)} = e.slot"


def compared_corpus() -> str:
    """SQL for (query_id, a, b): each statement beside the next one, every third time with a line of its own besides."""
    after = "CASE WHEN a.query_id % 3 = 0 THEN concat(b.text, chr(10), '  ', a.text) ELSE b.text END"
    return f"SELECT a.query_id, a.text AS a, {after} AS b FROM ({query_corpus()}) a JOIN ({query_corpus(shift=1)}) b ON a.query_id = b.query_id"


#: Partial statements with what completes them, and descriptions with what is suggested for them.
PARTIAL = [("", "SELECT * FROM "), ("Sel", "SELECT * FROM "), ("SELECT n_name FROM ", "SELECT n_name FROM nation"), ("SELECT a FROM region WHERE ", "SELECT a FROM region WHERE r_regionkey"),
           ("SELECT a FROM other WHERE ", "SELECT a FROM other WHERE column_name"), ("SELECT a FROM region JOIN ", "SELECT a FROM region JOIN nation ON nation.id = "), ("SELECT a", "SELECT a /* continue your query */")]
DESCRIBED = [("  ", "-- Describe what you need"), ("Insert a nation", "INSERT INTO nation (column1, column2) VALUES (?, ?);"), ("actualizar", "UPDATE nation SET column1 = ? WHERE id = ?;"),
             ("DELETE old ones", "DELETE FROM nation WHERE id = ?;"), ("all nations", "SELECT n_nationkey, n_name FROM nation WHERE /* add your condition */;")]

#: Columns by table for completion and suggestion.
SCHEMA = {"nation": ["n_nationkey", "n_name"], "region": ["r_regionkey", "r_name"]}


def slotted(pairs: list[tuple[str, str]], at: int) -> str:
    """SQL for (query_id, text): of each order the first or second text of its key's pair."""
    cases = " ".join(f"WHEN {i} THEN '{p[at]}'" for i, p in enumerate(pairs))
    return f"SELECT o_orderkey AS query_id, CASE o_orderkey % {len(pairs)} {cases} END AS text FROM orders"


def expected_findings() -> str:
    """DuckDB's SQL for (query_id, code, severity), from what was judged by hand."""
    rows = [(i, c.rstrip("!?"), MARKS.get(c[-1], "WARNING")) for i, (_, _, codes) in enumerate(STATEMENTS) for c in codes.split()]
    values = ", ".join(f"({i}, '{c}', '{s}')" for i, c, s in rows)
    return f"SELECT o_orderkey AS query_id, code, severity FROM orders JOIN (VALUES {values}) e(slot, code, severity) ON o_orderkey % {len(STATEMENTS)} = e.slot"


def script_corpus() -> str:
    """SQL for (script_id, stmt_no, kind, name): a script for each customer, its statements in order of the order key."""
    kinds = ["BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "DML", "SAVEPOINT", "ROLLBACK TO"]
    cases = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
    return f"SELECT o_custkey AS script_id, o_orderkey AS stmt_no, CASE o_orderkey % 7 {cases} END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'S1' ELSE 's1' END AS name FROM orders"
