"""Advice on statements: suggestions of the optimizer, completion of partial statements, statements from descriptions, and
how alike two statements are. All are expressions on the text of a row, so none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.rules import strip

#: Code, impact, whether on the stripped text, pattern, pattern on the same text that lifts the suggestion.
SUGGESTIONS = [
    ("OPT-001", "HIGH", True, r"(?is)\bSELECT\s+(?:(?:DISTINCT|ALL)\s+)?(?:[^()]*,\s*)?(?:\w+\.)?\*", None),
    ("OPT-003", "MEDIUM", True, r"(?i)^\s*SELECT\b", r"(?is)^\s*SELECT\s+(?:DISTINCT\s+)?TOP\b|\bLIMIT\b[^)]*$"),
    ("OPT-004", "MEDIUM", False, r"(?is)FROM\s+\w+(?:\s+(?:AS\s+)?\w+)?\s*,.*?\w+\.\w+\s*=\s*\w+\.\w+", None),
    ("OPT-005", "HIGH", False, r"(?i)\bIN\s*\(\s*SELECT\b|\bEXISTS\s*\(\s*SELECT\b", None),
    ("OPT-006", "HIGH", True, r"(?is)\b(?:WHERE|ON|HAVING)\b.*[^!<>=]=\s*NULL\b", None),
    ("OPT-008", "HIGH", False, r"(?i)FROM\s+\w+(?:\s+(?:AS\s+)?\w+)?\s*,", r"(?i)\w+\.\w+\s*=\s*\w+\.\w+"),
    ("OPT-009", "MEDIUM", False, r"(?i)\bNOT\s+IN\s*\(\s*SELECT\b", None),
    ("OPT-010", "LOW", False, r"(?is)\(\s*SELECT\b[^)]*\bORDER\s+BY\b[^)]*\)", None),
    ("OPT-011", "HIGH", False, r"(?i)\bLIKE\s+(['\"])%", None),
]

#: Impacts in the order in which suggestions are given.
IMPACTS = ["HIGH", "MEDIUM", "LOW"]

#: Words of a description and what is suggested for it, {t} being the table.
DESCRIBED = [
    (["insert", "crear", "añadir"], "INSERT INTO {t} (column1, column2) VALUES (?, ?);"),
    (["update", "actualizar"], "UPDATE {t} SET column1 = ? WHERE id = ?;"),
    (["delete", "eliminar"], "DELETE FROM {t} WHERE id = ?;"),
]


def optimize(queries: DataFrame) -> DataFrame:
    """(query_id, place, code, impact): suggestions for each statement of `queries` (query_id, text), placed from 1 on by
    impact, and by code within an impact. A null or empty text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def hits(plain: Column) -> Column:
        found = []
        for code, impact, stripped, pattern, lifted in SUGGESTIONS:
            on = plain if stripped else text
            hit = on.rlike(pattern) if lifted is None else on.rlike(pattern) & ~on.rlike(lifted)
            found.append((IMPACTS.index(impact), F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(impact).alias("impact")))))
        return F.array_compact(F.array(*[c for _, c in sorted(found, key=lambda x: x[0])]))

    advised = queries.withColumn("advice", F.element_at(F.transform(F.array(strip(text)), hits), 1))
    return advised.select("query_id", F.posexplode_outer("advice").alias("at", "s")).where("s is not null").select("query_id", (F.col("at") + 1).cast("long").alias("place"), "s.code", "s.impact")


def ungrouped(queries: DataFrame) -> DataFrame:
    """(query_id, code, field): MY002, a warning, for each plain column that a statement of MySQL selects beside GROUP BY
    without grouping by it. `queries`: query_id, text, dialect. Fields are in lower case, without table and alias."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    for _ in range(3):  # calls, three levels deep
        text = F.regexp_replace(text, r"\w*\s*\([^()]*\)", "0")
    items = lambda pattern: F.transform(F.split(F.lower(F.regexp_extract("bare", pattern, 1)), ","), lambda x: F.trim(x))
    column = lambda x: F.regexp_extract(x, r"^(?:\w+\.)?([a-z_]\w*)(?:\s+(?:as\s+)?\w+)?$", 1)
    chosen, grouped = items(r"(?is)^\s*SELECT\s+(?:DISTINCT\s+)?(.*?)\s+FROM\b"), items(r"(?is)\bGROUP\s+BY\s+(.*?)\s*(?:\bHAVING\b.*|\bORDER\b.*|\bLIMIT\b.*|;.*|$)")
    plain = F.array_distinct(F.filter(F.transform(chosen, column), lambda x: x != ""))
    judged = queries.where(F.lower("dialect") == "mysql").withColumn("bare", text).where(F.col("bare").rlike(r"(?i)\bGROUP\s+BY\b"))
    return judged.select("query_id", F.lit("MY002").alias("code"), F.explode(F.array_except(plain, F.transform(grouped, column))).alias("field"))


def similarity(a: Column, b: Column) -> Column:
    """Per cent of the lines of `a` that `b` has, or of distinct words that both have, whichever is more, of the longer one's.

    Lines are trimmed, empty ones left out; words are lower-cased, only letters A-Z, digits and _*$.- count. A null is an
    empty text; two texts without lines give 100.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    some = lambda parts: F.filter(parts, lambda x: x != "")
    lines = lambda x: some(F.transform(F.split(x, r"\r?\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")))
    words = lambda x: F.array_distinct(some(F.transform(F.split(F.lower(x), r"\s+"), lambda p: F.regexp_replace(p, r"[^a-z0-9_*$.-]", ""))))

    def score(p: Column) -> Column:
        la, lb, wa, wb = (p[n] for n in ("la", "lb", "wa", "wb"))
        only = F.filter(la, lambda x: F.array_contains(lb, x))
        by_lines, by_words = F.size(only) / F.greatest(F.size(la), F.size(lb), F.lit(1)), F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb), F.lit(1))
        return F.when((F.size(la) == 0) & (F.size(lb) == 0), 100).otherwise(F.floor(F.greatest(by_lines, by_words) * 100 + 0.5)).cast("long")

    parts = F.struct(lines(a).alias("la"), lines(b).alias("lb"), words(a).alias("wa"), words(b).alias("wb"))
    return F.element_at(F.transform(F.array(parts), score), 1)


def complete(partial: Column, schema: dict[str, list[str]]) -> Column:
    """`partial` completed by a table, a column or a hint; `schema`: columns by table, in order. A null is an empty text."""
    partial = F.coalesce(partial, F.lit(""))
    upper, table = F.upper(partial), next(iter(schema), None)
    named = F.lower(F.replace(F.regexp_extract(partial, r'(?i)\bFROM\s+([\w".]+)', 1), F.lit('"'), F.lit("")))
    column = F.lit(None).cast("string")
    for name, columns in schema.items():
        column = F.when(named == name.lower(), F.lit(columns[0] if columns else None)).otherwise(column)
    return (
        F.when((F.trim(upper) == "") | (upper.rlike(r"^S.*$") & (F.length(F.trim(upper)) <= 3)), F.lit("SELECT * FROM "))
        .when(upper.rlike(r"(?s)\bFROM\s*$"), F.concat(partial, F.lit(table or "table_name")))
        .when(upper.contains("FROM ") & upper.rlike(r"(?s)\bWHERE\s+$"), F.concat(partial, F.coalesce(column, F.lit("column_name"))))
        .when(upper.rlike(r"(?s)\bJOIN\s+$"), F.concat(partial, F.lit(f"{table} ON {table}.id = " if table else "related_table ON ")))
        .otherwise(F.concat(partial, F.lit(" /* continue your query */")))
    )


def suggest(description: Column, schema: dict[str, list[str]]) -> Column:
    """A statement on the first table of `schema` for what `description` asks; null or blank ones ask for a description."""
    wanted = F.lower(F.trim(F.coalesce(description, F.lit(""))))
    table, columns = next(iter(schema.items()), ("your_table", []))
    out = F.when(wanted == "", "-- Describe what you need")
    for words, statement in DESCRIBED:
        out = out.when(wanted.rlike("|".join(words)), statement.replace("{t}", table))
    return out.otherwise(f"SELECT {', '.join(columns) or '*'} FROM {table} WHERE /* add your condition */;")
