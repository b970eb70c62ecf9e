"""Texts of scripts and statements: statements of a script, copies from and to files, measures, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.rules import judged, strip

#: A literal, a quoted name, a comment, the end of a statement, or other text. `#` comments are MySQL's.
PIECE = r"'[^']*'?|\"[^\"]*\"?|`[^`]*`?|--[^\n]*|/\*(?s:.*?)(?:\*/|\z)|;|[^;'\"`/#-]+|[-/#]"
PIECE_MYSQL = r"#[^\n]*|" + PIECE

#: Tokens of a statement: literal, word, number, operator of two signs, other sign.
TOKEN = r"'[^']*'|\"[^\"]*\"|[A-Za-z_]\w*|\d+(?:\.\d+)?|<=|>=|<>|!=|\|\||[^\s\w]"

#: What takes the place of the end of a statement while it is put together again.
END = "\u0000"


def split_statements(scripts: DataFrame) -> DataFrame:
    """(script_id, stmt_no, text): the statements of each script of `scripts` (script_id, text, dialect), numbered from 1.

    A `;` in literals, quoted names and comments ends nothing; it is not part of a statement, and empty statements go. A null
    text has none. Bodies of routines and DELIMITER are not known: their statements come apart.
    """
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(END), F.lit(" "))
    cut = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.when(p == ";", END).otherwise(p))
    pieces = F.when(F.lower("dialect") == "mysql", cut(PIECE_MYSQL)).otherwise(cut(PIECE))
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    statements = F.filter(F.transform(F.split(F.array_join(pieces, ""), END), trimmed), lambda x: x != "")
    return scripts.select("script_id", F.posexplode(statements).alias("at", "text")).select("script_id", (F.col("at") + 1).cast("long").alias("stmt_no"), "text")


def copies(queries: DataFrame) -> DataFrame:
    """(query_id, entity, direction, file) of each `COPY t FROM/TO 'file'` of `queries` (query_id, text)."""
    pattern = r"""(?i)^\s*COPY\s+([\w."]+)\s*(?:\([^)]*\)\s*)?(FROM|TO)\s+('[^']*'|STDIN|STDOUT)"""
    part = lambda i: F.regexp_extract("text", pattern, i)
    return queries.where(F.col("text").rlike(pattern)).select("query_id", part(1).alias("entity"), F.upper(part(2)).alias("direction"), F.replace(part(3), F.lit("'"), F.lit("")).alias("file"))


def measures(queries: DataFrame) -> DataFrame:
    """(query_id, tokens, depth) of each statement: its tokens outside comments, and how deep its brackets nest.

    The depth is of brackets, not of a syntax tree. A null text has 0 of both.
    """
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    text = F.coalesce(F.col("text"), F.lit(""))
    signs = F.regexp_extract_all(strip(text), F.lit(r"[()]"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))

    def step(s: Column, sign: Column) -> Column:
        at = s["at"] + F.when(sign == "(", 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(s["top"], at).alias("top"))

    return queries.select("query_id", F.regexp_count(bare(text), F.lit(TOKEN)).cast("long").alias("tokens"), F.aggregate(signs, start, step, lambda s: s["top"]).cast("long").alias("depth"))


def explained(findings: DataFrame, explanations: DataFrame, aliases: dict[str, str], locale: str) -> DataFrame:
    """`findings` with what, why, example and corrected of their code, else of the code that stands for it in `aliases`.

    `explanations`: code, locale, what, why, example, corrected, one row a code and locale; a locale that starts with es reads
    Spanish, others English. Findings without an explanation keep nulls. Both joins are on the code, so no row is repeated.
    """
    language = "es" if locale.lower().startswith("es") else "en"
    told = ["what", "why", "example", "corrected"]
    known = explanations.where(F.col("locale") == language)
    own = known.select("code", *[F.col(c).alias(f"own_{c}") for c in told])
    other = known.select(F.col("code").alias("stands"), *[F.col(c).alias(f"other_{c}") for c in told])
    stands = F.lit(None).cast("string")
    for code, to in aliases.items():
        stands = F.when(F.col("code") == code, to).otherwise(stands)
    joined = findings.withColumn("stands", stands).join(own, "code", "left").join(other, "stands", "left")
    return joined.select(*findings.columns, *[F.coalesce(f"own_{c}", f"other_{c}").alias(c) for c in told])


def error_summaries(queries: DataFrame, messages: dict[str, str]) -> DataFrame:
    """(query_id, text): a numbered list, in words, of what is wrong with each statement of `queries` (query_id, text, dialect).

    `messages`: words by code; a code without any stands for itself. The list is made in the statement's row.
    """
    words = F.lit(None).cast("string")
    found = judged(queries)

    def line(f: Column, at: Column) -> Column:
        said = words
        for code, message in messages.items():
            said = F.when(f["code"] == code, message).otherwise(said)
        return F.concat((at + 1).cast("string"), F.lit(". ["), f["code"], F.lit("] "), F.coalesce(said, f["code"]), F.lit("\n"))

    errors = F.filter("found", lambda f: f["severity"] == "ERROR")
    listed = F.concat(F.lit("Error summary for your query:\n\n"), F.array_join(F.transform(errors, line), ""), F.lit("\nReview syntax for engine "), F.coalesce("dialect", F.lit("")), F.lit("."))
    return found.select("query_id", F.when(F.size(errors) == 0, "No structural errors to explain.").otherwise(listed).alias("text"))
