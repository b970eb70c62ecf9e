"""Filters, searches, commands and scripts on inputs that the corpora do not have."""

import pytest
from pyspark.sql import functions as F

from lintel.functions import commands, texts
from lintel.plans import stores as queries
from lintel.sources import stores

DOCS = [(1, "a", 1.5, '{"n": 7, "s": "x"}'), (2, None, None, None), (3, "B c", -2.0, '{"n": null}'), (4, "true", 0.0, "not json")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, t string, v double, j string").cache()


@pytest.mark.parametrize(
    "text, ids",
    [
        ("db.d.find()", [1, 2, 3, 4]),
        (" db.d.find( {} ).sort({id: 1})", [1, 2, 3, 4]),
        ('db.d.find({"t": null})', [2]),
        ('db.d.find({"t": {"$ne": "a"}})', [2, 3, 4]),
        ('db.d.find({"t": {"$nin": ["a", null]}})', [3, 4]),
        ('db.d.find({"j.n": 7})', [1]),
        ('db.d.find({"j.n": {"$exists": false}, "v": {"$lte": 0}})', [3, 4]),
        ('db.d.find({"v": {"$not": {"$gt": 0}}})', [2, 3, 4]),
        ('db.d.find({"t": {"$regex": "^[A-Z]"}})', [3]),
        ('db.d.find({"$and": [{"id": {"$gte": 2}}, {"$nor": [{"id": 3}]}]})', [2, 4]),
        ('db.d.find({"absent": {"$gt": 1}})', []),
        ('db.d.find({"t": true})', [4]),
    ],
)
def test_find(docs, text, ids):
    assert sorted(r["id"] for r in stores.find({"d": docs}, text).collect()) == ids
    assert stores.find({"d": docs.limit(0)}, text).count() == 0


def test_find_refuses(docs):
    for text in ("db.d.aggregate([])", "SELECT 1", 'db.d.find({"$where": 1})', 'db.d.find({"t": {"$near": 1}})'):
        with pytest.raises(ValueError):
            stores.find({"d": docs}, text)


@pytest.mark.parametrize(
    "body, ids",
    [
        ("{}", [1, 2, 3, 4]),
        ('{"size": 0}', []),
        ('{"query": {"match": {"t": {"query": "C B", "operator": "and"}}}}', [3]),
        ('{"query": {"bool": {"should": [{"term": {"t": "a"}}, {"term": {"id": 4}}]}}}', [1, 4]),
        ('{"query": {"bool": {"filter": {"exists": {"field": "t"}}, "should": {"term": {"t": "a"}}}}}', [1, 3, 4]),
        ('{"query": {"bool": {"must_not": [{"exists": {"field": "j.n"}}]}}}', [2, 3, 4]),
        ('{"query": {"wildcard": {"t": "b*"}}}', []),
        ('{"query": {"terms": {"v": [1.5, 0]}}, "sort": [{"v": {"order": "asc"}}]}', [4, 1]),
        ('{"sort": [{"v": "desc"}, "id"], "from": 1, "size": 9}', [4, 3, 2]),
    ],
)
def test_search(docs, body, ids):
    assert [r["id"] for r in stores.search(docs, body, "id").collect()] == ids


def test_search_without_source(docs):
    assert stores.search(docs, '{"_source": false}', "id").columns == ["_id"]
    with pytest.raises(ValueError):
        stores.search(docs, '{"query": {"fuzzy": {"t": "a"}}}', "id")


def test_words(spark):
    lines = [(None, []), ("  ", []), ("a  b\tc", ["a", "b", "c"]), ("SET 'a \"b' \"c 'd\"", ["SET", 'a "b', "c 'd"]), ('a"b c"d', ["ab c", "d"]), ("x ''", ["x", ""]), ("x 'open end", ["x", "open end"]), ("x '", ["x"]), ("k " * 100_000, ["k"] * 100_000)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "i int, t string").select("i", commands.words(F.col("t")).alias("w")).collect()
    assert {r["i"]: r["w"] for r in got} == {i: w for i, (_, w) in enumerate(lines)}


def test_odd_commands_and_statements(spark):
    rows = spark.createDataFrame([(1, None), (2, "XADD"), (3, "KEYS"), (4, "GEOADD g x y m 1 99"), (5, "FLUSHALL"), (6, "XREADGROUP"), (7, "ACL"), (8, "''")], "query_id long, text string")
    got = sorted((r["query_id"], r["code"]) for r in commands.command_findings(rows).collect())
    assert got == [(1, "RDS-SYNTAX-001"), (2, "RDS-XStream-010"), (5, "RDS-FLUSH-001"), (6, "RDS-XStream-001")]
    cql = spark.createDataFrame([(1, None), (2, "SELECT a FROM t WHERE b = 1 " + "x" * 300_000), (3, "BEGIN BATCH " + "UPDATE t SET a = 1 WHERE id = 1; " * 51 + "APPLY BATCH"), (4, "insert into t (a) values (1) using ttl 60")], "query_id long, text string")
    assert sorted((r["query_id"], r["code"]) for r in commands.cql_findings(cql).collect()) == [(1, "CQL-EMPTY"), (3, "CQL-BATCH-LARGE")]
    empty = cql.limit(0)
    for rule in (commands.command_findings, commands.cql_findings, commands.cql_definitions, commands.cql_primary_key, commands.cql_aggregates):
        assert rule(empty).count() == 0


def test_script_of_a_large_block(spark):
    lines = ["MULTI"] + ["SET a 1"] * 1001 + ["EXEC", None, "WATCH a", "DISCARD"]
    rows = spark.createDataFrame([(7, i, t) for i, t in enumerate(lines)], "script_id long, stmt_no long, text string")
    assert sorted(tuple(r) for r in commands.script_findings(rows).collect()) == [(7, "RDS-PIP-002", 1), (7, "RDS-PIP-003", 1), (7, "RDS-TX-003", 1)]
    assert commands.script_findings(rows.limit(0)).count() == 0


def test_long_scripts(spark):
    long = "SELECT 'a;b' -- c;\n;" * 20_000
    rows = spark.createDataFrame([(1, None, "mysql"), (2, long, None), (3, "x;" + "\u0000" + "y /* open ; end", "oracle"), (4, "`a;b`; 'open ; end", "mysql")], "script_id long, text string, dialect string")
    got = {}
    for r in texts.split_statements(rows).orderBy("script_id", "stmt_no").collect():
        got.setdefault(r["script_id"], []).append(r["text"])
    assert got == {2: ["SELECT 'a;b' -- c;"] * 20_000, 3: ["x", "y /* open ; end"], 4: ["`a;b`", "'open ; end"]}


def test_explanations_by_alias(spark):
    known = spark.createDataFrame(queries.EXPLAINED, "code string, locale string, what string, why string, example string, corrected string")
    found = spark.createDataFrame([(1, "SE007"), (2, "SEM-002"), (3, "SE004"), (3, "SE004")], "query_id long, code string")
    got = texts.explained(found, known, queries.ALIASES, "es_MX").orderBy("query_id").collect()
    assert [(r["code"], r["what"]) for r in got] == [("SE007", "Un texto externo puede cambiar la sentencia"), ("SEM-002", None), ("SE004", None), ("SE004", None)]
