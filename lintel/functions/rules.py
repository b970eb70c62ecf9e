"""Rules on statements: each a pattern on the raw text, or on the text without literals and comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals, line comments and block comments, with what stands in for them, in this order.
STRIP = [(r"N?'[^']*'", "''"), (r"--[^\n]*", " "), (r"(?s)/\*.*?\*/", " ")]

#: Dialects whose statements the rules judge.
DIALECTS = ["mysql", "postgresql", "sqlite", "sqlserver", "oracle"]

#: Code, severity, whether on the stripped text, pattern, pattern on the raw text that lifts the finding.
GENERIC = [
    ("SE007", "ERROR", False, r"(?i)'\s*OR\s+'[^']*'\s*=\s*'[^']*'|'\s*;\s*(DROP|DELETE|TRUNCATE|ALTER)\b|'\s*--", None),
    ("SE-LIKE-ALL", "WARNING", False, r"(?i)LIKE\s+'[%_\s]+'", None),
    ("SE-LIKE-SHORT", "WARNING", False, r"(?i)LIKE\s+'%(.{1,2})%?'\s*(?:AND|OR|$|\))", r"(?i)LIKE\s+'[%_\s]+'"),
    ("SE-NULL-EQUALS", "WARNING", True, r"(?i)(?:=|!=|<>)\s*NULL\b", None),
    ("SE-DIV-ZERO", "WARNING", True, r"/\s*0(?![\d.])", None),
    ("SE-EMPTY-STR", "WARNING", False, r"(?i)(?:=|LIKE)\s*''", None),
    ("SE-EMPTY-IN", "WARNING", True, r"(?i)\bIN\s*\(\s*\)", None),
    ("SE-CARTESIAN", "WARNING", True, r"(?i)FROM\s+\w+\s*,\s*\w+", r"\w+\.\w+\s*=\s*\w+\.\w+"),
    ("SE-TAUTOLOGY", "WARNING", True, r"(?i)\bWHERE\s+1\s*=\s*1\b|\bWHERE\s+TRUE\b", None),
    ("SE-IMPOSSIBLE", "WARNING", True, r"(?i)\bWHERE\s+1\s*=\s*0\b|\bWHERE\s+0\s*=\s*1\b|\bWHERE\s+FALSE\b", None),
    ("SE-SELF-CMP", "WARNING", True, r"(?is)\bWHERE\b.*\b(\w{2,})\s*=\s*\1\b", None),
    ("SE-DANGER-SCOPE", "WARNING", True, r"(?is)\b(DELETE|UPDATE)\b.*\bWHERE\s+1\s*=\s*1\b", None),
    ("SE-INSERT-NO-COLS", "WARNING", False, r"(?i)\bINSERT\s+INTO\s+\w+\s+VALUES\b", None),
    ("SE004", "WARNING", True, r"(?is)^\s*SELECT\s+(DISTINCT\s+)?\*.*\bJOIN\b", None),
    ("SE010", "WARNING", True, r"(?is)^\s*SELECT\b.*\bLIMIT\s+\d+", r"(?i)\bORDER\s+BY\b"),
    ("SEM-001", "WARNING", True, r"(?i)^\s*DELETE\b", r"(?i)\bWHERE\b"),
    ("SEM-002", "WARNING", True, r"(?i)^\s*UPDATE\b", r"(?i)\bWHERE\b"),
]

#: Injection patterns that are looked for where only block comments are taken out.
STRUCTURAL = r"(?i)\b(OR|AND)\s+\d+\s*=\s*\d+|\bUNION\s+(ALL\s+)?SELECT\b"

#: A pair of numbers or literals that contradict each other.
BETWEEN = r"(?i)BETWEEN\s+(\d+)\s+AND\s+(\d+)"
CONTRADICTS = r"(?is)\b(\w+)\s*=\s*'([^']*)'[^;]*?\bAND\b[^;]*?\b\1\s*=\s*'([^']*)'"
RANGE = r"(?is)\b(\w+)\s*>\s*(\d+)[^;]*?\bAND\b[^;]*?\b\1\s*<\s*(\d+)"

#: By dialect, as above, all on the raw text.
BY_DIALECT = {
    "mysql": [
        ("MY001", "WARNING", r"(?i)\bON\s+DUPLICATE\s+KEY\b", None),
        ("MY003", "WARNING", r"(?is)^\s*SELECT\b.*\bLIMIT\s+\d+", r"(?i)\bORDER\s+BY\b"),
        ("MY004", "WARNING", r"(?i)\bPASSWORD\s*\(", None),
        ("MY004", "WARNING", r"(?i)\bENCRYPT\s*\(", None),
        ("MY005", "INFO", r"(?i)\bJSON_TABLE\s*\(", None),
    ],
    "postgresql": [
        ("PG001", "INFO", r"(?i)\bILIKE\b", None),
        ("PG003", "INFO", r"(?i)\b(SERIAL|BIGSERIAL|SMALLSERIAL)\b", None),
        ("PG006", "ERROR", r"(?i)\bWITH\s+RECURSIVE\b", r"(?i)\bUNION\s+ALL\b"),
    ],
    "sqlite": [
        ("LT001", "ERROR", r"(?i)\bRIGHT\s+(OUTER\s+)?JOIN\b", None),
        ("LT001", "ERROR", r"(?i)\bFULL\s+(OUTER\s+)?JOIN\b", None),
        ("LT002", "ERROR", r"(?is)\bALTER\s+TABLE\b.+?\bDROP\s+COLUMN\b", None),
        ("LT002", "ERROR", r"(?is)\bALTER\s+TABLE\b.+?\bRENAME\s+COLUMN\b", None),
        ("LT003", "WARNING", r"(?i)\bFOREIGN\s+KEY\b|\bREFERENCES\b", r"(?i)\bPRAGMA\s+foreign_keys\s*=\s*ON\b"),
        ("LT004", "INFO", r"(?i)\b(DATETIME|TIMESTAMP|DATE|TIME)\b", None),
        ("LT005", "INFO", r"(?i)\bOVER\s*\(", None),
        ("LT006", "ERROR", r"(?i)\bWITHOUT\s+ROWID\b", r"(?i)\bPRIMARY\s+KEY\b"),
    ],
    "sqlserver": [
        ("SS001", "WARNING", r"(?i)^\s*SELECT\s+TOP\b", r"(?i)\bORDER\s+BY\b"),
        ("SS002", "WARNING", r"(?i)\bNOLOCK\b", None),
        ("SS003", "INFO", r"(?is)\bSELECT\b.+?\bINTO\s+#\w+", None),
        ("SS004", "WARNING", r"(?i)\bCURSOR\b", None),
        ("SS006", "INFO", r"(?i)^\s*MERGE\b", r"(?i)\bOUTPUT\b"),
        ("SS007", "WARNING", r"(?i)@@IDENTITY\b", None),
        ("SS008", "WARNING", r"(?i)\b(text|ntext|image)\b", None),
    ],
    "oracle": [
        ("ORA002", "WARNING", r"(?is)\bWHERE\b.+?\bROWNUM\s*>\s*\d+", None),
        ("ORA003", "WARNING", r"(?is)^\s*SELECT\b.*\bROWNUM\b", r"(?i)\bORDER\s+BY\b"),
        ("ORA004", "INFO", r"(?i)\bNVL\s*\(", None),
        ("ORA005", "INFO", r"(?i)\bDECODE\s*\(", None),
        ("ORA006", "WARNING", r"(?i)\bVARCHAR\b(?!\s*2)", None),
        ("ORA008", "WARNING", r"(?i)\bCONNECT\s+BY\b", r"(?i)\bSTART\s+WITH\b"),
    ],
}


FOUND = "array<struct<code:string,severity:string>>"


def strip(text: Column) -> Column:
    """`text` without string literals and comments."""
    for pattern, to in STRIP:
        text = F.regexp_replace(text, pattern, to)
    return text


def statement_kind(text: Column) -> Column:
    """First word in upper case; `MONGO` for shell text."""
    return F.when(text.rlike(r"^\s*db\."), "MONGO").otherwise(F.upper(F.regexp_extract(text, r"^\s*(\w+)", 1)))


def _contradictions(text: Column, plain: Column) -> list[tuple[str, str, Column]]:
    """Rules that compare what a pattern's groups hold."""
    number = lambda c: c.try_cast("int")
    pairs = F.zip_with(F.regexp_extract_all(plain, F.lit(BETWEEN), F.lit(1)), F.regexp_extract_all(plain, F.lit(BETWEEN), F.lit(2)), lambda a, b: number(a) > number(b))
    literals = text.rlike(CONTRADICTS) & (F.regexp_extract(text, CONTRADICTS, 2) != F.regexp_extract(text, CONTRADICTS, 3))
    bounds = number(F.regexp_extract(plain, RANGE, 3)) <= number(F.regexp_extract(plain, RANGE, 2))
    return [("SE-BETWEEN-INV", "WARNING", F.exists(pairs, lambda x: x)), ("SE-CONTRADICTS", "WARNING", literals), ("SE-RANGE-IMPOSSIBLE", "WARNING", bounds)]


def judged(queries: DataFrame) -> DataFrame:
    """`queries` (text, and dialect, if it is a column) with found: an array of (code, severity); one narrow pass.

    The dialect's own rules count only for its statements; texts of engines that are not in DIALECTS break no rule. Without
    the column, or where it is null, the generic rules count. A null text breaks none.
    """
    dialect = F.lower(F.col("dialect")) if "dialect" in queries.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))

    def hits(plain: Column) -> Column:
        found = []
        for code, severity, stripped, pattern, lifted in GENERIC:
            hit = (plain if stripped else text).rlike(pattern)
            if code == "SE007":
                hit = hit | F.regexp_replace(text, STRIP[2][0], " ").rlike(STRUCTURAL)
            # whether there is a WHERE or ORDER BY is asked of the stripped text, the join condition of the raw one
            found.append(_hit(code, severity, hit if lifted is None else hit & ~(plain if stripped and code != "SE-CARTESIAN" else text).rlike(lifted)))
        found += [_hit(*rule) for rule in _contradictions(text, plain)]
        return F.array(*found)

    own = F.lit(None).cast(FOUND)
    for name, rules in BY_DIALECT.items():
        rows = [_hit(code, severity, text.rlike(pattern) if lifted is None else text.rlike(pattern) & ~text.rlike(lifted)) for code, severity, pattern, lifted in rules]
        own = F.when(dialect == name, F.array(*rows)).otherwise(own)
    # within a lambda the stripped text is made once, not for each rule that reads it
    generic = F.element_at(F.transform(F.array(strip(text)), hits), 1)
    known = dialect.isNull() | dialect.isin(DIALECTS)
    return queries.withColumn("found", F.when(known, F.array_compact(F.concat(generic, F.coalesce(own, F.array().cast(FOUND))))).otherwise(F.array().cast(FOUND)))


def _hit(code: str, severity: str, hit: Column) -> Column:
    return F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def findings(queries: DataFrame) -> DataFrame:
    """(query_id, code, severity) for each rule that a statement of `queries` (query_id, text, dialect) breaks."""
    # outer, so that no filter on the array makes it twice
    return judged(queries).select("query_id", F.explode_outer("found").alias("f")).where("f is not null").select("query_id", "f.code", "f.severity")


def validity(queries: DataFrame) -> DataFrame:
    """(query_id, valid, errors, warnings), counted in each statement's own row: valid without an error."""
    count = lambda severity: F.size(F.filter("found", lambda f: f["severity"] == severity)).cast("long")
    counted = judged(queries).select("query_id", count("ERROR").alias("errors"), count("WARNING").alias("warnings"))
    return counted.select("query_id", (F.col("errors") == 0).alias("valid"), "errors", "warnings")
