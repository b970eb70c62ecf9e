"""All queries by name, with the SQL that expresses the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import advice, rules
from lintel.operators import documents, nosql, relational
from lintel.plans import analysis, corpus, scripts, stores
from lintel.sources.tables import run_sql
from lintel.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]


def _sql_query(text: str) -> Query:
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text)


def an_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All content rules over the corpus of statements."""
    return rules.findings(run_sql(spark, sf_dir, corpus.query_corpus()))


def an_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, valid, errors, warnings): a statement is valid if no rule finds an error in it."""
    return rules.validity(run_sql(spark, sf_dir, corpus.query_corpus()))


def an_stmt_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = run_sql(spark, sf_dir, corpus.query_corpus())
    return queries.groupBy(rules.statement_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def an_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, corpus.query_corpus()).select("query_id", rules.strip(F.col("text")).alias("plain"))


def an_tcl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts.transaction_findings(run_sql(spark, sf_dir, corpus.script_corpus()))


def an_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of scripts of up to sixteen statements each."""
    judged = an_validity(spark, sf_dir).withColumn("script_id", F.floor(F.col("query_id") / 16))
    return scripts.health(judged)


def an_script_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCR-MULTI-001 for scripts of sixteen statements with two or more invalid ones."""
    judged = an_validity(spark, sf_dir).groupBy(F.floor(F.col("query_id") / 16).alias("script_id")).agg(F.count_if(~F.col("valid")).alias("blocking"))
    return judged.where("blocking >= 2").withColumn("code", F.lit("SCR-MULTI-001"))


def an_custom_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement's health for an engine of one's own: 100 if valid, else 25 less for each error, not below 0."""
    judged = an_validity(spark, sf_dir)
    return judged.select("query_id", F.when(F.col("valid"), 100).otherwise(F.greatest(F.lit(0), 100 - 25 * F.col("errors"))).cast("long").alias("score"))


def an_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.optimize(run_sql(spark, sf_dir, corpus.advised_corpus()))


def group_non_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.ungrouped(run_sql(spark, sf_dir, corpus.advised_corpus()))


def diff_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, corpus.compared_corpus()).select("query_id", advice.similarity(F.col("a"), F.col("b")).alias("score"))


def gen_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, corpus.slotted(corpus.PARTIAL, 0)).select("query_id", advice.complete(F.col("text"), corpus.SCHEMA).alias("text"))


def gen_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, corpus.slotted(corpus.DESCRIBED, 0)).select("query_id", advice.suggest(F.col("text"), corpus.SCHEMA).alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an_findings(spark, sf_dir)


_corpus = corpus.query_corpus().replace("STRING", "VARCHAR")
_found = corpus.expected_findings()
_valid = f"""
SELECT query_id, count(*) FILTER (severity = 'ERROR') = 0 AS valid, count(*) FILTER (severity = 'ERROR') AS errors,
       count(*) FILTER (severity = 'WARNING') AS warnings
FROM (SELECT query_id, severity FROM ({_found}) UNION ALL SELECT o_orderkey, NULL FROM orders) GROUP BY query_id"""

_similarity = f"""
WITH p AS (SELECT query_id, [trim(x) FOR x IN string_split(a, chr(10)) IF trim(x) <> ''] AS la, [trim(x) FOR x IN string_split(b, chr(10)) IF trim(x) <> ''] AS lb,
  list_distinct([regexp_replace(x, '[^a-z0-9_*$.-]', '', 'g') FOR x IN regexp_split_to_array(lower(a), '\\s+')]) AS wa,
  list_distinct([regexp_replace(x, '[^a-z0-9_*$.-]', '', 'g') FOR x IN regexp_split_to_array(lower(b), '\\s+')]) AS wb FROM ({corpus.compared_corpus().replace("STRING", "VARCHAR")})),
w AS (SELECT query_id, la, lb, [x FOR x IN wa IF x <> ''] AS wa, [x FOR x IN wb IF x <> ''] AS wb FROM p)
SELECT query_id, CAST(floor(100 * greatest(len([x FOR x IN la IF list_contains(lb, x)]) / greatest(len(la), len(lb), 1),
  len(list_intersect(wa, wb)) / greatest(len(wa), len(wb), 1)) + 0.5) AS BIGINT) AS score FROM w"""


def _strip_sql() -> str:
    plain = "text"
    for pattern, to in rules.STRIP:
        pattern, to = pattern.replace("'", "''"), to.replace("'", "''")
        plain = f"regexp_replace({plain}, '{pattern}', '{to}', 'g')"
    return f"SELECT query_id, {plain} AS plain FROM ({_corpus})"


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {k: _sql_query(v) for k, v in (relational.SQL | nosql.SQL | analysis.SQL).items()}
    return found | relational.QUERIES | documents.QUERIES | windows.QUERIES | stores.QUERIES | {f.__name__: f for f in (an_findings, an_validity, an_stmt_kind, an_strip, an_tcl, an_health, an_script_flag, an_custom_health, an_optimize, group_non_agg, diff_similarity, gen_complete, gen_suggest)}


def oracle_sql() -> dict[str, str]:
    return (
        relational.SQL
        | relational.ORACLE
        | nosql.SQL
        | nosql.ORACLE
        | documents.ORACLE
        | analysis.ORACLE
        | windows.ORACLE
        | stores.ORACLE
        | {
            "an_findings": _found,
            "an_validity": _valid,
            "an_stmt_kind": f"SELECT CASE WHEN starts_with(text, 'db.') THEN 'MONGO' ELSE upper(regexp_extract(text, '^\\s*(\\w+)', 1)) END AS kind, count(*) AS n FROM ({_corpus}) GROUP BY 1",
            "an_strip": _strip_sql(),
            "an_optimize": corpus.expected_advice(),
            "group_non_agg": corpus.expected_ungrouped(),
            "gen_complete": corpus.slotted(corpus.PARTIAL, 1),
            "gen_suggest": corpus.slotted(corpus.DESCRIBED, 1),
            "diff_similarity": _similarity,
            "an_script_flag": f"SELECT CAST(floor(query_id / 16) AS BIGINT) AS script_id, count(*) AS blocking, 'SCR-MULTI-001' AS code FROM ({_valid}) WHERE NOT valid GROUP BY 1 HAVING count(*) >= 2",
            "an_custom_health": f"SELECT query_id, CAST(CASE WHEN valid THEN 100 ELSE greatest(0, 100 - 25 * errors) END AS BIGINT) AS score FROM ({_valid})",
            "an_tcl": scripts.TRANSACTION_SQL.format(corpus=corpus.script_corpus()),
            "an_health": f"""SELECT script_id, CAST(greatest(0, least(100, floor(base + 0.5) - CASE WHEN invalid >= 2 THEN 7 ELSE 0 END)) AS BIGINT) AS score FROM (
                SELECT CAST(floor(query_id / 16) AS BIGINT) AS script_id, count(*) FILTER (NOT valid) AS invalid,
                       avg(CASE WHEN NOT valid THEN 25 WHEN errors > 0 THEN 35 WHEN warnings > 0 THEN 78 ELSE 100 END) AS base FROM ({_valid}) GROUP BY 1)""",
        }
    )
