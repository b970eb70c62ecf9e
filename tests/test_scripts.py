"""Folds over scripts and rules on single statements, against plain Python and cases judged by hand."""

import random

from lintel.functions import rules
from lintel.plans import scripts


def transactions(statements):
    depth, names, found = 0, set(), {"TCL-001": 0, "TCL-002": 0, "TCL-003": 0}
    for kind, name in statements:
        if kind == "BEGIN":
            if depth == 0:
                names.clear()
            depth += 1
        elif kind in ("COMMIT", "ROLLBACK"):
            if depth == 0:
                found["TCL-002"] += kind == "ROLLBACK"
                continue
            depth -= 1
            if depth == 0:
                names.clear()
        elif kind == "SAVEPOINT" and name is not None:
            found["TCL-003"] += name.lower() in names
            names.add(name.lower())
    found["TCL-001"] = depth
    return {c: n for c, n in found.items() if n} if len(statements) > 1 else {}


def test_transactions_against_a_fold(spark):
    rng = random.Random(4)
    made = {i: [(rng.choice(["BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "SAVEPOINT", "ROLLBACK TO", "DML"]), rng.choice(["a", "A", "b", None])) for _ in range(rng.randint(1, 12))] for i in range(300)}
    rows = [(i, k, kind, name) for i, statements in made.items() for k, (kind, name) in enumerate(statements)]
    got = {}
    for r in scripts.transaction_findings(spark.createDataFrame(rows, "script_id long, stmt_no long, kind string, name string")).collect():
        got.setdefault(r["script_id"], {})[r["code"]] = r["n"]
    assert got == {i: found for i, s in made.items() if (found := transactions(s))}


def test_health(spark):
    rows = [(1, True, 0, 0), (1, True, 0, 3), (2, False, 1, 0), (2, False, 2, 0), (3, True, 1, 0), (4, True, 0, 0), (5, False, 1, 0)]
    cross = [(1, "ERROR"), (1, "WARNING"), (3, "INFO"), (5, "ERROR"), (5, "ERROR"), (6, "ERROR"), (7, "WARNING")]
    statements, found = spark.createDataFrame(rows, "script_id long, valid boolean, errors long, warnings long"), spark.createDataFrame(cross, "script_id long, severity string")
    score = lambda df: {r[0]: r[1] for r in df.collect()}
    assert score(scripts.health(statements)) == {1: 89, 2: 18, 3: 35, 4: 100, 5: 25}
    assert score(scripts.health(statements, found)) == {1: 64, 2: 18, 3: 28, 4: 100, 5: 0, 6: 0, 7: 100}
    assert scripts.health(statements.limit(0), found.limit(0)).count() == 0


def test_rules_on_odd_texts(spark):
    rows = [
        (1, None, "mysql"), (2, "", "mysql"), (3, "SELECT a\nFROM t\nWHERE a = 1 AND\nbb = bb", "mysql"), (4, "DELETE -- WHERE\nFROM t", None), (5, "DELETE FROM t", "cassandra"),
        (6, "SELECT a FROM t WHERE a = 10 / 0.5", None), (7, "SELECT a FROM t WHERE a BETWEEN 99999999999 AND 1", None), (8, "UPDATE t SET a = 1 /* x */\nWHERE 1 = 1", "ORACLE"),
        (9, "SELECT a FROM t LIMIT 3", "Mysql"), (10, "SELECT 'it''s' -- UNION SELECT", None), (11, "x" * 200_000, None),
    ]
    got = {}
    for r in rules.findings(spark.createDataFrame(rows, "query_id long, text string, dialect string")).collect():
        got.setdefault(r["query_id"], set()).add((r["code"], r["severity"]))
    warn = lambda *codes: {(c, "WARNING") for c in codes}
    assert got == {3: warn("SE-SELF-CMP"), 4: warn("SEM-001"), 8: warn("SE-TAUTOLOGY", "SE-DANGER-SCOPE"), 9: warn("SE010", "MY003"), 10: {("SE007", "ERROR")}}
    assert {r["query_id"]: r["valid"] for r in rules.validity(spark.createDataFrame(rows, "query_id long, text string, dialect string")).collect()} == {i: i != 10 for i, *_ in rows}
