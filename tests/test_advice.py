"""Advice on texts that the corpora do not have."""

from pyspark.sql import functions as F

from lintel.functions import advice


def test_odd_texts(spark):
    rows = spark.createDataFrame([(1, None, "mysql"), (2, "", "mysql"), (3, "x" * 200_000, None), (4, "SELECT a FROM (SELECT b FROM u\nORDER BY b) v, w\nWHERE c LIKE \"%z\"", "oracle"), (5, "SELECT a FROM t GROUP BY b", "oracle")], "query_id long, text string, dialect string")
    got = sorted(tuple(r) for r in advice.optimize(rows).collect())
    assert got == [(4, 1, "OPT-011", "HIGH"), (4, 2, "OPT-003", "MEDIUM"), (4, 3, "OPT-010", "LOW"), (5, 1, "OPT-003", "MEDIUM")]
    assert advice.ungrouped(rows).count() == 0
    assert advice.optimize(rows.limit(0)).count() == advice.ungrouped(rows.limit(0)).count() == 0


def test_similarity(spark):
    pairs = [(None, None, 100), ("", " \n ", 100), ("a", None, 0), ("a\nb\nb", "b\r\n c", 67), ("SELECT a, b", "select  b a c", 75), ("é", "é", 100), ("a b c", "a d e f g h i j", 13)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").select("i", advice.similarity(F.col("a"), F.col("b"))).collect()
    assert dict(got) == {i: n for i, (_, _, n) in enumerate(pairs)}


def test_completion_without_a_schema(spark):
    texts = [None, "SELECT a FROM", "SELECT a FROM t WHERE ", "SELECT a FROM t JOIN "]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", advice.complete(F.col("t"), {}), advice.suggest(F.col("t"), {})).collect()
    assert [r[1] for r in sorted(got)] == ["SELECT * FROM ", "SELECT a FROMtable_name", "SELECT a FROM t WHERE column_name", "SELECT a FROM t JOIN related_table ON "]
    assert [r[2] for r in sorted(got)] == ["-- Describe what you need"] + ["SELECT * FROM your_table WHERE /* add your condition */;"] * 3
