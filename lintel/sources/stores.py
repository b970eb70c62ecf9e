"""Scans of document, search and key-value stores: a JSON filter or query body becomes a predicate on DataFrame columns,
so Catalyst can push it to the scan; commands become a join on the key."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.functions.commands import words

#: Rows of a search that asks for no size.
SIZE = 10


def field(docs: DataFrame, path: str) -> Column:
    """The column at `path`; behind a dot a struct's field or a JSON text's; one that is not there is null."""
    name, _, rest = path.partition(".")
    if name not in docs.columns:
        return F.lit(None).cast("string")
    column = docs[name]
    if rest:
        column = F.get_json_object(column, f"$.{rest}") if isinstance(docs.schema[name].dataType, T.StringType) else column.getField(rest)
    return column


def _compare(column: Column, op: str, value: object) -> Column:
    """Comparison that takes numbers as numbers, also where the column is text; false where the field is missing."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    left, right = (column.try_cast("double"), F.lit(float(value))) if number else (column.cast("string"), F.lit(str(value).lower() if isinstance(value, bool) else value))
    test = {"eq": left == right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]
    return F.coalesce(test, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(or_, parts, F.lit(False))


def _condition(column: Column, want: object) -> Column:
    """What a document filter asks of one field."""
    if not (isinstance(want, dict) and want and all(k.startswith("$") for k in want)):
        return column.isNull() if want is None else _compare(column, "eq", want)
    parts = []
    for op, value in want.items():
        if op in ("$gt", "$gte", "$lt", "$lte"):
            parts.append(_compare(column, op[1:], value))
        elif op in ("$eq", "$ne"):
            equal = _condition(column, value)
            parts.append(equal if op == "$eq" else ~equal)
        elif op in ("$in", "$nin"):
            some = _any([_condition(column, v) for v in value])
            parts.append(some if op == "$in" else ~some)
        elif op == "$exists":
            parts.append(column.isNotNull() if value else column.isNull())
        elif op == "$regex":
            parts.append(F.coalesce(column.cast("string").rlike(value), F.lit(False)))
        elif op == "$not":
            parts.append(~_condition(column, value))
        else:
            raise ValueError(f"unknown operator {op}")
    return _all(parts)


def document_filter(docs: DataFrame, spec: dict) -> Column:
    """Predicate for a document filter: fields, $and, $or, $nor; a missing field equals null and differs from any value."""
    parts = []
    for key, want in spec.items():
        if key in ("$and", "$or", "$nor"):
            inner = [document_filter(docs, s) for s in want]
            parts.append(_all(inner) if key == "$and" else _any(inner) if key == "$or" else ~_any(inner))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            parts.append(_condition(field(docs, key), want))
    return _all(parts)


def find(collections: dict[str, DataFrame], text: str) -> DataFrame:
    """Documents that `db.<collection>.find({filter})` asks for; an empty filter gives all, methods chained behind are ignored."""
    head = re.match(r"\s*db\.(\w+)\.find\s*\(\s*", text)
    if head is None:
        raise ValueError("only db.<collection>.find({...}) is read")
    docs, rest = collections[head[1]], text[head.end() :]
    spec = {} if rest.startswith(")") else json.JSONDecoder().raw_decode(rest)[0]
    return docs.where(document_filter(docs, spec))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def search_filter(docs: DataFrame, query: dict) -> Column:
    """Predicate for a search query: match_all, term, terms, range, exists, prefix, wildcard, match and bool."""
    kind, body = next(iter(query.items()))
    if kind == "match_all":
        return F.lit(True)
    if kind == "match_none":
        return F.lit(False)
    if kind == "exists":
        return field(docs, body["field"]).isNotNull()
    if kind == "bool":
        clauses = {k: [search_filter(docs, q) for q in (v if isinstance(v, list) else [v])] for k, v in body.items() if k != "minimum_should_match"}
        must, should = clauses.get("must", []) + clauses.get("filter", []), clauses.get("should", [])
        least = int(body.get("minimum_should_match", 0 if must else 1)) if should else 0
        enough = F.lit(True) if least == 0 else sum((s.cast("int") for s in should), F.lit(0)) >= least
        return _all(must) & enough & ~_any(clauses.get("must_not", []))
    name, want = next(iter(body.items()))
    column = field(docs, name)
    if kind == "terms":
        return _any([_compare(column, "eq", v) for v in want])
    if kind == "range":
        return _all([_compare(column, op, v) for op, v in want.items()])
    value = want.get("value", want.get("query")) if isinstance(want, dict) else want
    if kind == "term":
        return _compare(column, "eq", value)
    if kind == "prefix":
        return F.coalesce(column.cast("string").startswith(value), F.lit(False))
    if kind == "wildcard":
        pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in value)
        return F.coalesce(column.cast("string").rlike(f"(?s)^{pattern}$"), F.lit(False))
    if kind == "match":
        wanted, had = _terms(F.lit(value)), _terms(column.cast("string"))
        both = isinstance(want, dict) and str(want.get("operator", "or")).lower() == "and"
        return F.coalesce(F.size(F.array_except(wanted, had)) == 0 if both else F.arrays_overlap(wanted, had), F.lit(False))
    raise ValueError(f"unknown query {kind}")


def search(docs: DataFrame, body: str, key: str) -> DataFrame:
    """Hits of a search body: query, sort, from, size and _source; `key` is the documents' id, which breaks ties of the sort.

    Without a source a hit has only its id. There is no score: without a sort hits come in order of their id.
    """
    spec = json.loads(body)
    order = []
    for s in spec.get("sort", []):
        name, way = (s, "asc") if isinstance(s, str) else next(iter(s.items()))
        way = way["order"] if isinstance(way, dict) else way
        order.append(field(docs, name).desc_nulls_last() if way == "desc" else field(docs, name).asc_nulls_last())
    hits = docs.where(search_filter(docs, spec.get("query", {"match_all": {}}))).orderBy(*order, docs[key])
    hits = hits.offset(spec.get("from", 0)).limit(spec.get("size", SIZE))
    source = spec.get("_source", True)
    if source is False:
        return hits.select(F.col(key).alias("_id"))
    return hits if source is True else hits.select(*[field(docs, s).alias(s) for s in ([source] if isinstance(source, str) else source)])


def lookup(store: DataFrame, commands: DataFrame) -> DataFrame:
    """(query_id, result): what each command of `commands` (query_id, text) reads from `store` (key, value, one row a key).

    GET, STRLEN, EXISTS, TYPE and PING; a missing key reads as `null`, 0, 0 and `none`. Other commands give an error text. The
    store is joined on its key, so nothing is looked up from the driver.
    """
    asked = commands.select("query_id", words(F.col("text")).alias("w")).select("query_id", F.upper(F.get("w", F.lit(0))).alias("cmd"), F.get("w", F.lit(1)).alias("key"))
    read = asked.join(store.select("key", "value", F.lit(True).alias("found")), "key", "left")
    return read.select(
        "query_id",
        F.when(F.col("cmd") == "GET", F.coalesce("value", F.lit("null")))
        .when(F.col("cmd") == "STRLEN", F.coalesce(F.octet_length("value"), F.lit(0)).cast("string"))
        .when(F.col("cmd") == "EXISTS", F.when(F.col("found"), "1").otherwise("0"))
        .when(F.col("cmd") == "TYPE", F.when(F.col("found"), "string").otherwise("none"))
        .when(F.col("cmd") == "PING", F.coalesce("key", F.lit("PONG")))
        .otherwise(F.concat(F.lit("ERR unknown command "), F.coalesce("cmd", F.lit(""))))
        .alias("result"),
    )


def schema_rows(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> list[tuple[str, str, int, str, bool]]:
    """(table, field, place, kind, is_key) of each column; `keys` names primary keys, which files don't carry."""
    kind = lambda t: "number" if isinstance(t, T.NumericType) else "text" if isinstance(t, T.StringType) else "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "other"
    return [(name, f.name, place, kind(f.dataType), f.name in keys.get(name, [])) for name, df in tables.items() for place, f in enumerate(df.schema.fields, 1)]
