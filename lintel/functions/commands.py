"""Commands of key-value stores and statements of wide-column stores: their words, the rules that one breaks, and the fold
over a script of commands. Rules are expressions on a row; only the fold shuffles, on the script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.rules import FOUND, _hit, strip

#: A word of a command, quoted or bare; a quote that is never closed takes the rest.
WORD = r"""[^\s'"]*'[^']*(?:'|\z)|[^\s'"]*"[^"]*(?:"|\z)|[^\s'"]+"""

#: Bounds of places, units of distance, options that let a key expire, commands that wait, prefixes of modules.
LATITUDE, LONGITUDE = 85.05112878, 180.0
UNITS = ["m", "km", "mi", "ft"]
EXPIRY = ["EX", "PX", "EXAT", "PXAT"]
BLOCKING = ["BLPOP", "BRPOP", "BRPOPLPUSH"]
SWEEPING = ["KEYS", "FLUSHDB", "FLUSHALL"]
MODULES = r"^(JSON|FT|GRAPH|TS)\."

#: First words of statements, and types that collections hold as they are.
CQL_HEADS = "SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|BEGIN|APPLY|USE|TRUNCATE|GRANT|REVOKE|LIST|LOGIN|LOGOUT"
CQL_TYPES = "ascii|bigint|blob|boolean|counter|date|decimal|double|duration|float|inet|int|smallint|text|time|timestamp|timeuuid|tinyint|uuid|varchar|varint"

#: Code, severity, first word, whether on the stripped text, pattern, pattern that lifts the finding.
CQL_RULES = [
    ("CQL-FULLSCAN-001", "WARNING", "SELECT", True, r"^", r"(?i)\bWHERE\b"),
    ("CQL-STRUCT-SELECT", "ERROR", "SELECT", True, r"^", r"(?i)\bFROM\b"),
    ("CQL-STRUCT-INSERT", "ERROR", "INSERT", True, r"^", r"(?i)^\s*INSERT\s+INTO\b"),
    ("CQL-STRUCT-INSERT-VALUES", "ERROR", "INSERT", True, r"(?i)^\s*INSERT\s+INTO\b", r"(?i)\bVALUES\b"),
    ("CQL-STRUCT-UPDATE", "ERROR", "UPDATE", True, r"^", r"(?i)\bSET\b"),
    ("CQL-NOWHERE-001", "ERROR", "UPDATE", True, r"^", r"(?i)\bWHERE\b"),
    ("CQL-COL-001", "WARNING", "UPDATE", True, r"\+=?\s*\[\s*\]", None),
    ("CQL-COL-002", "WARNING", "UPDATE", True, r"\+=?\s*\{\s*\}", None),
    ("CQL-COL-004", "ERROR", "UPDATE", True, r"\[\s*-[^\]]+\]\s*=", None),
    ("CQL-STRUCT-DELETE", "ERROR", "DELETE", True, r"^", r"(?i)\bFROM\b"),
    ("CQL-NOWHERE-002", "ERROR", "DELETE", True, r"^", r"(?i)\bWHERE\b"),
    ("CQL-BATCH-APPLY", "ERROR", "BEGIN", True, r"(?i)^\s*BEGIN\s+(?:(?:UNLOGGED|LOGGED|COUNTER)\s+)?BATCH\b", r"(?i)\bAPPLY\s+BATCH\s*;?\s*$"),
    ("CQL-STRUCT-CREATE-TABLE", "ERROR", "CREATE", True, r"(?i)^\s*CREATE\s+TABLE\s*(?:IF\s+NOT\s+EXISTS\s*)?(?:\(|$)", None),
    ("CQL-IDX-002", "INFO", "CREATE", True, r"(?i)^\s*CREATE\s+(?:CUSTOM\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?ON\b", None),
    ("CQL-IDX-004", "WARNING", "CREATE", False, r"(?i)^\s*CREATE\s+CUSTOM\s+INDEX\b", r"(?i)\bUSING\s+'"),
    ("CQL-JOIN-001", "ERROR", None, True, r"(?i)\bJOIN\b", None),
    ("CQL-FILTER-001", "WARNING", None, True, r"(?i)\bALLOW\s+FILTERING\b", None),
    ("CQL-ORDERBY-001", "WARNING", None, True, r"(?i)\bORDER\s+BY\b", None),
    ("CQL-UDT-001", "ERROR", None, True, rf"(?i)\b(?:LIST|SET)\s*<\s*(?!(?:FROZEN|{CQL_TYPES})\b)\w", None),
    ("CQL-TTL-001", "WARNING", None, True, r"(?i)\bUSING\s+TTL\s+0*[1-5]?[1-9]\b|\bUSING\s+TTL\s+0*[1-5]0\b", None),
    ("CQL-TTL-002", "ERROR", None, True, r"(?i)\bUSING\s+TTL\s+-?0+\b", None),
    ("CQL-TTL-003", "ERROR", None, True, r"(?i)\bUSING\s+TTL\s+-0*[1-9]", None),
    ("CQL-WT-002", "ERROR", None, True, r"(?i)\bWRITETIME\s*\([^)]*\*", None),
    ("CQL-TTL-005", "ERROR", None, True, r"(?i)\bTTL\s*\([^)]*\*", None),
]


def words(text: Column) -> Column:
    """The words of a command, without their quotes; a null has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    single = lambda w: F.replace(w, F.lit("'"), F.lit(""))
    double = lambda w: F.replace(w, F.lit('"'), F.lit(""))
    return F.transform(F.filter(found, lambda w: ~w.isin("'", '"')), lambda w: F.when(w.rlike(r"""^[^'"]*'"""), single(w)).otherwise(double(w)))


def _command_rules(w: Column) -> list[tuple[str, str, Column]]:
    """Code, severity and condition on the words `w` of a command."""
    arg = lambda i: F.get(w, i if isinstance(i, Column) else F.lit(i))
    cmd, n = F.upper(arg(0)), F.size(w) - 1
    args = F.slice(w, F.lit(2), F.greatest(n, F.lit(0)))
    said = lambda *names: F.exists(args, lambda x: F.upper(x).isin(*names))
    is_ = lambda *names: cmd.isin(*names)

    # XADD key [NOMKSTREAM] [MAXLEN [~|=] n] id field value: the options come before the rest
    at = F.lit(2) + (F.upper(F.coalesce(arg(2), F.lit(""))) == "NOMKSTREAM").cast("int")
    capped, cap = F.upper(arg(at)) == "MAXLEN", arg(at + 1)
    options = F.when(capped & cap.isin("~", "="), 3).when(capped & cap.isNotNull(), 2).when(capped, 1).otherwise(0)
    # GEOADD key (longitude latitude member)...
    triples = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((n - 1) / 3).cast("int"))), lambda j: 3 * j < n)
    beyond = lambda shift, bound: F.exists(triples, lambda j: F.abs(arg(3 * j + shift).try_cast("double")) > bound)

    sub, password = F.upper(arg(1)), F.exists(args, lambda x: x.rlike("^[>#]"))
    unkeyed = ~arg(1).contains("KEYS[") & (arg(1).rlike(r"(?i)redis\.p?call\s*\(") | (is_("EVAL") & (arg(2) == "0") & (F.length(arg(1)) > 80) & F.lower(arg(1)).contains("redis.call")))
    return [
        ("RDS-SYNTAX-001", "ERROR", F.size(w) == 0),
        ("RDS-HMSET-001", "INFO", is_("HMSET")),
        ("RDS-KEYS-001", "ERROR", is_("KEYS") & (arg(1) == "*")),
        ("RDS-KEYS-002", "WARNING", is_("KEYS") & (arg(1) != "*")),
        ("RDS-FLUSH-001", "ERROR", is_("FLUSHDB", "FLUSHALL") & ~F.coalesce((n > 0) & (F.upper(arg(n)) == "CONFIRM"), F.lit(False))),
        ("RDS-SESS-001", "WARNING", is_("SET") & F.lower(arg(1)).rlike("session|token") & ~F.exists(F.slice(args, F.lit(3), F.greatest(n, F.lit(0))), lambda x: F.upper(x).isin(*EXPIRY))),
        ("RDS-XStream-010", "ERROR", is_("XADD") & (n + 1 - at - options < 3)),
        ("RDS-XStream-004", "WARNING", is_("XADD") & capped & (cap != "~")),
        ("RDS-XStream-001", "ERROR", is_("XREADGROUP") & ~F.coalesce((F.array_position(F.transform(args, F.upper), "GROUP") > 0) & (n >= F.array_position(F.transform(args, F.upper), "GROUP") + 2), F.lit(False))),
        ("RDS-XStream-002", "WARNING", is_("XGROUP") & said("CREATE") & ~said("MKSTREAM")),
        ("RDS-XStream-003", "INFO", is_("XPENDING") & (n <= 2)),
        ("RDS-PUB-002", "WARNING", is_("PUBLISH") & (arg(1) == "")),
        ("RDS-PUB-003", "WARNING", is_("PUBSUB") & (sub == "CHANNELS") & (arg(2) == "*")),
        ("RDS-GEO-001", "WARNING", is_("GEORADIUS")),
        ("RDS-GEO-002", "ERROR", is_("GEOADD") & beyond(0, LATITUDE)),
        ("RDS-GEO-003", "ERROR", is_("GEOADD") & beyond(-1, LONGITUDE)),
        ("RDS-GEO-004", "ERROR", is_("GEODIST") & (n >= 4) & ~F.lower(arg(n)).isin(*UNITS)),
        ("RDS-HLL-001", "WARNING", is_("PFCOUNT") & (n > 10)),
        ("RDS-HLL-002", "WARNING", is_("PFMERGE") & F.array_contains(F.slice(args, F.lit(2), F.greatest(n, F.lit(0))), arg(1))),
        ("RDS-BIT-001", "ERROR", is_("BITFIELD") & F.array_join(args, " ").rlike(r"(?i)\b(GET|SET|INCRBY)\s+\S+\s+(#?-\d+)")),
        ("RDS-BIT-002", "INFO", is_("BITCOUNT")),
        ("RDS-BIT-003", "ERROR", is_("BITOP") & (sub == "NOT") & (n != 3)),
        ("RDS-Script-001", "WARNING", is_("SCRIPT") & said("FLUSH")),
        ("RDS-Script-002", "INFO", is_("EVAL", "EVALSHA") & (F.length(arg(1)) > 1000)),
        ("RDS-Script-003", "WARNING", is_("EVAL", "EVALSHA") & unkeyed),
        ("RDS-ACL-001", "WARNING", is_("ACL") & (sub == "SETUSER") & F.upper(F.array_join(args, " ")).contains("+@ALL")),
        ("RDS-ACL-002", "ERROR", is_("ACL") & (sub == "SETUSER") & ~said("NOPASS") & ~password),
        ("RDS-ACL-003", "ERROR", is_("ACL") & (sub == "DELUSER") & (F.lower(arg(2)) == "default")),
        ("RDS-MOD-001", "INFO", cmd.rlike(MODULES)),
        ("RDS-MOD-002", "WARNING", is_("FT.SEARCH") & ~said("LIMIT")),
    ]


def _exploded(commands: DataFrame, found: Column) -> DataFrame:
    rows = commands.select("query_id", F.explode_outer(found).alias("f")).where("f is not null")
    return rows.select("query_id", "f.code", "f.severity")


def command_findings(commands: DataFrame) -> DataFrame:
    """(query_id, code, severity) for each rule that a command of `commands` (query_id, text) breaks, once a command.

    A null or blank text is an empty command (RDS-SYNTAX-001). Places that are no numbers are not judged.
    """
    hits = lambda w: F.array_compact(F.array(*[_hit(*rule) for rule in _command_rules(w)]))
    return _exploded(commands, F.element_at(F.transform(F.array(words(F.col("text"))), hits), 1))


def script_findings(scripts: DataFrame) -> DataFrame:
    """(script_id, code, n): rules on the order of a script's commands. `scripts`: script_id, stmt_no, text.

    MULTI opens a block, EXEC and DISCARD close it. RDS-TX-001: WATCH in a block; 002, 003: EXEC, DISCARD outside of one;
    004: a command that waits in one; 005: a block open at the end; RDS-PIP-001: KEYS or a flush in a block; RDS-PIP-002:
    more than 1000 commands in a block; RDS-PIP-003: a WATCH that neither EXEC nor UNWATCH follows; RDS-PUB-001: SUBSCRIBE
    and PSUBSCRIBE in one script. Each of the last four counts once. Null texts are no commands.
    """
    order = Window.partitionBy("script_id").orderBy("stmt_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    cmd, is_ = F.upper(F.get(words(F.col("text")), F.lit(0))), lambda *names: F.col("cmd").isin(*names)
    mark = F.when(is_("MULTI"), True).when(is_("EXEC", "DISCARD"), False)
    watch = F.when(is_("WATCH"), True).when(is_("EXEC", "UNWATCH"), False)
    rows = scripts.select("script_id", "stmt_no", cmd.alias("cmd")).where("cmd is not null")
    rows = rows.withColumns({"open": F.coalesce(F.last(mark, ignorenulls=True).over(so_far), F.lit(False)), "block": F.count_if(is_("MULTI")).over(so_far)})
    rows = rows.withColumns({"before": F.coalesce(F.lag("open").over(order), F.lit(False)), "queued": F.count_if(F.col("open") & ~is_("MULTI")).over(Window.partitionBy("script_id", "block"))})
    once = lambda c: F.max(c.cast("int"))
    counted = {
        "RDS-TX-001": F.count_if(is_("WATCH") & F.col("before")),
        "RDS-TX-002": F.count_if(is_("EXEC") & ~F.col("before")),
        "RDS-TX-003": F.count_if(is_("DISCARD") & ~F.col("before")),
        "RDS-TX-004": F.count_if(is_(*BLOCKING) & F.col("open")),
        "RDS-TX-005": F.max_by(F.col("open").cast("int"), "stmt_no"),
        "RDS-PIP-001": F.count_if(is_(*SWEEPING) & F.col("open")),
        "RDS-PIP-002": once(F.col("queued") > 1000),
        "RDS-PIP-003": F.coalesce(F.max_by(watch.cast("int"), F.when(watch.isNotNull(), F.col("stmt_no"))), F.lit(0)),
        "RDS-PUB-001": once(is_("SUBSCRIBE")) * once(is_("PSUBSCRIBE")),
    }
    folded = rows.groupBy("script_id").agg(*[c.cast("long").alias(name) for name, c in counted.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("code"), F.col(f"`{name}`").alias("n")) for name in counted])
    return folded.select("script_id", F.explode(pairs).alias("c")).select("script_id", "c.code", "c.n").where("n > 0")


def cql_findings(statements: DataFrame) -> DataFrame:
    """(query_id, code, severity) for each rule on one CQL statement of `statements` (query_id, text).

    A null or blank text breaks CQL-EMPTY alone, one that starts with no statement's word CQL-STRUCT-START alone. Texts in
    literals and comments are not read, but for the class behind USING.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def hits(plain: Column) -> Column:
        head = F.upper(F.regexp_extract(plain, r"^\s*(\w+)", 1))
        found = []
        for code, severity, first, stripped, pattern, lifted in CQL_RULES:
            on = plain if stripped else text
            hit = on.rlike(pattern) if lifted is None else on.rlike(pattern) & ~on.rlike(lifted)
            found.append(_hit(code, severity, hit if first is None else (head == first) & hit))
        found.append(_hit("CQL-BATCH-LARGE", "WARNING", (head == "BEGIN") & (F.regexp_count(plain, F.lit(r"(?i)\b(INSERT\s+INTO|UPDATE|DELETE)\b")) > 50)))
        change = F.upper(F.regexp_extract(plain, r"(?i)\b(ADD|RENAME|DROP)\b", 1))
        found.append(_hit("CQL-UDT-002", "ERROR", plain.rlike(r"(?i)^\s*ALTER\s+TYPE\b") & change.isin("RENAME", "DROP")))
        alone = lambda code: F.array(_hit(code, "ERROR", F.lit(True)))
        return F.when(plain.rlike(r"^\s*;?\s*$"), alone("CQL-EMPTY")).when(~plain.rlike(rf"(?i)^\s*({CQL_HEADS})\b"), alone("CQL-STRUCT-START")).otherwise(F.array_compact(F.array(*found)).cast(FOUND))

    return _exploded(statements, F.element_at(F.transform(F.array(strip(text)), hits), 1))


def cql_cell_findings(statements: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """(query_id, code, field): WRITETIME (CQL-WT-001) or TTL (CQL-TTL-004) of a column that is in the primary key.

    `keys`: primary key columns by table. Tables that are not named there, and null texts, have no finding.
    """
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    table = F.lower(F.regexp_extract(text, r'(?i)\bFROM\s+(?:[\w"]+\.)?"?(\w+)', 1))
    own = F.lit(None).cast("array<string>")
    for name, columns in keys.items():
        own = F.when(table == name.lower(), F.array(*[F.lit(c.lower()) for c in columns])).otherwise(own)
    call = r'(?i)\b(WRITETIME|TTL)\s*\(\s*"?(\w+)"?\s*\)'
    calls = F.arrays_zip(F.regexp_extract_all(text, F.lit(call), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(call), F.lit(2)).alias("field"))
    rows = statements.select("query_id", own.alias("own"), F.explode(calls).alias("c")).where(F.array_contains("own", F.lower("c.field")))
    return rows.select("query_id", F.when(F.upper("c.name") == "TTL", "CQL-TTL-004").otherwise("CQL-WT-001").alias("code"), F.lower("c.field").alias("field"))


def cql_definitions(statements: DataFrame) -> DataFrame:
    """(query_id, action, kind, name) of each statement that makes, changes or drops an object; an index without a name has a null."""
    kinds = r"KEYSPACE|TABLE|INDEX|MATERIALIZED\s+VIEW|TYPE|FUNCTION|AGGREGATE|TRIGGER"
    pattern = rf'(?i)^\s*(CREATE|ALTER|DROP)\s+(?:OR\s+REPLACE\s+)?(?:CUSTOM\s+)?({kinds})\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([\w."]+)'
    part = lambda i: F.regexp_extract(strip(F.col("text")), pattern, i)
    rows = statements.select("query_id", F.upper(part(1)).alias("action"), F.upper(F.regexp_replace(part(2), r"\s+", " ")).alias("kind"), part(3).alias("name"))
    return rows.where("action <> ''").withColumn("name", F.when((F.col("kind") == "INDEX") & (F.upper("name") == "ON"), None).otherwise(F.col("name")))


def cql_primary_key(statements: DataFrame) -> DataFrame:
    """(query_id, part, place, field): the columns of a table's primary key, part being partition or clustering, places from 1.

    PRIMARY KEY (a, b) has one partition column, PRIMARY KEY ((a, b), c) two; a column marked PRIMARY KEY is the partition.
    """
    text = strip(F.col("text"))
    pattern = r"(?is)\bPRIMARY\s+KEY\s*\(\s*(?:\(([^()]*)\)|([^(),]+))\s*(?:,([^()]*))?\)"
    inline = F.regexp_extract(text, r"(?i)(\w+)\s+\w+\s+PRIMARY\s+KEY\b(?!\s*\()", 1)
    names = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.lower(F.regexp_replace(x, r'[\s"]', ""))), lambda x: x != "")
    first = F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2), inline)
    parts = F.array(F.struct(F.lit("partition").alias("part"), names(first).alias("fields")), F.struct(F.lit("clustering").alias("part"), names(F.regexp_extract(text, pattern, 3)).alias("fields")))
    made = statements.where(text.rlike(r"(?i)^\s*CREATE\s+TABLE\b")).select("query_id", F.explode(parts).alias("p"))
    return made.select("query_id", "p.part", F.posexplode("p.fields").alias("at", "field")).select("query_id", "part", (F.col("at") + 1).cast("long").alias("place"), "field")


def cql_aggregates(statements: DataFrame) -> DataFrame:
    """(query_id, name, argument, step, state, final, initial) of each CREATE AGGREGATE; parts that are not given are null."""
    text = F.col("text")
    given = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    head = r'(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?AGGREGATE\s+(?:IF\s+NOT\s+EXISTS\s+)?'
    parts = {"name": head + r'([\w."]+)', "argument": head + r'[\w."]+\s*\(([^)]*)\)', "step": r"(?i)\bSFUNC\s+(\w+)", "state": r"(?i)\bSTYPE\s+(.+?)\s*(?:\bFINALFUNC\b|\bINITCOND\b|;|$)",
             "final": r"(?i)\bFINALFUNC\s+(\w+)", "initial": r"(?i)\bINITCOND\s+(.+?)\s*;?\s*$"}
    return statements.where(text.rlike(head)).select("query_id", *[given(p).alias(k) for k, p in parts.items()])
