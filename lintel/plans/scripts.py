"""Folds over scripts: transaction checks and health, as windows and aggregates per script."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transaction_findings(scripts: DataFrame) -> DataFrame:
    """(script_id, code, n): TCL-001 (warning) for transactions open at the end, TCL-002 (error) for each ROLLBACK outside
    of one, TCL-003 (warning) for each SAVEPOINT whose name its block has already.

    `scripts`: script_id, stmt_no, kind, name. The depth rises with BEGIN, falls with COMMIT and ROLLBACK and never goes
    below 0, so it is the running sum less the running minimum of that sum (if below 0). ROLLBACK TO a savepoint changes
    nothing. A new block begins where a BEGIN finds the depth at 0 or a COMMIT or ROLLBACK brings it there. Names are
    compared without case; a savepoint without one is left out. Scripts of one statement are not judged.
    """
    order = Window.partitionBy("script_id").orderBy("stmt_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "BEGIN", 1).when(F.col("kind").isin("COMMIT", "ROLLBACK"), -1).otherwise(0)
    run = scripts.withColumn("total", F.sum(step).over(so_far)).withColumn("low", F.least(F.lit(0), F.min("total").over(so_far)))
    depth = run.withColumn("depth", F.col("total") - F.col("low")).withColumn("before", F.coalesce(F.lag("depth").over(order), F.lit(0)))
    fresh = ((F.col("kind") == "BEGIN") & (F.col("before") == 0)) | (F.col("kind").isin("COMMIT", "ROLLBACK") & (F.col("before") == 1))
    named = F.when((F.col("kind") == "SAVEPOINT") & F.col("name").isNotNull(), F.lower("name"))
    blocks = depth.withColumns({"block": F.sum(fresh.cast("int")).over(so_far), "point": named})
    points = Window.partitionBy("script_id", "block", "point").orderBy("stmt_no")
    folded = blocks.withColumn("again", F.col("point").isNotNull() & (F.row_number().over(points) > 1)).groupBy("script_id").agg(
        F.max_by("depth", "stmt_no").alias("open"),
        F.count_if((F.col("kind") == "ROLLBACK") & (F.col("before") == 0)).alias("stray"),
        F.count_if("again").alias("again"),
        F.count("*").alias("statements"),
    )
    code = lambda name, n: F.struct(F.lit(name).alias("code"), F.col(n).cast("long").alias("n"))
    codes = F.array(code("TCL-001", "open"), code("TCL-002", "stray"), code("TCL-003", "again"))
    return folded.where("statements > 1").select("script_id", F.explode(codes).alias("c")).select("script_id", "c.*").where("n > 0")


TRANSACTION_SQL = """
WITH s AS ({corpus}),
t AS (SELECT *, sum(CASE WHEN kind = 'BEGIN' THEN 1 WHEN kind IN ('COMMIT', 'ROLLBACK') THEN -1 ELSE 0 END)
        OVER (PARTITION BY script_id ORDER BY stmt_no) AS total FROM s),
d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY script_id ORDER BY stmt_no)) AS depth FROM t),
b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY script_id ORDER BY stmt_no), 0) AS before FROM d),
c AS (SELECT *, count(*) FILTER ((kind = 'BEGIN' AND before = 0) OR (kind IN ('COMMIT', 'ROLLBACK') AND before = 1))
        OVER (PARTITION BY script_id ORDER BY stmt_no) AS block FROM b),
p AS (SELECT script_id, count(*) - count(DISTINCT (block, lower(name))) AS again FROM c WHERE kind = 'SAVEPOINT' GROUP BY script_id),
f AS (SELECT script_id, arg_max(depth, stmt_no) AS open, count(*) FILTER (kind = 'ROLLBACK' AND before = 0) AS stray FROM b GROUP BY script_id HAVING count(*) > 1)
SELECT script_id, 'TCL-001' AS code, CAST(open AS BIGINT) AS n FROM f WHERE open > 0
UNION ALL SELECT script_id, 'TCL-002', stray FROM f WHERE stray > 0
UNION ALL SELECT script_id, 'TCL-003', again FROM p JOIN f USING (script_id) WHERE again > 0
"""


def health(statements: DataFrame, cross: DataFrame | None = None) -> DataFrame:
    """(script_id, score), 0 to 100: the mean over statements of 25 if invalid, 35 if valid with errors, 78 with warnings,
    else 100, rounded half up, less 18 for each cross-script error and 7 for each cross-script warning.

    `statements`: script_id, valid, errors, warnings. `cross`: script_id, severity (ERROR, else a warning); a script that
    only it names has no statements and scores 0 with an error, else 100. Two or more invalid statements are a
    cross-script warning of their own (SCR-MULTI-001).
    """
    score = F.when(~F.col("valid"), 25).when(F.col("errors") > 0, 35).when(F.col("warnings") > 0, 78).otherwise(100)
    scored = statements.groupBy("script_id").agg(F.floor(F.avg(score) + 0.5).alias("base"), (F.count_if(~F.col("valid")) >= 2).cast("int").alias("multi"))
    if cross is None:
        scored = scored.withColumns({"wrong": F.lit(0), "noted": F.lit(0)})
    else:
        counted = cross.groupBy("script_id").agg(F.count_if(F.col("severity") == "ERROR").alias("wrong"), F.count_if(F.col("severity") != "ERROR").alias("noted"))
        scored = scored.join(counted, "script_id", "full").na.fill(0, ["wrong", "noted", "multi"])
    whole = F.col("base") - 18 * F.col("wrong") - 7 * (F.col("noted") + F.col("multi"))
    return scored.select("script_id", F.when(F.col("base").isNull(), F.when(F.col("wrong") > 0, 0).otherwise(100)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), whole))).cast("long").alias("score"))
