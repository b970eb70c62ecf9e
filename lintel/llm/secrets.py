"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens.

The battery asks of a token whether it looks drawn at random from the alphabet of its encoding (hexadecimal, base32 or
base64, inferred from its characters): a chi-squared test of uniform letters, a runs test above and below the middle of
the alphabet, and a serial-correlation test of neighbours. A token passes that none of the three rejects. Among tokens
that pass, those count as secrets whose uniformity would be surprising for ordinary words of their length: the score's
distribution over words is measured for each length band in the corpus, and a Benjamini-Hochberg cut on a histogram of
the p-values bounds the share of false discoveries.

Only DataFrame functions are used. What goes to the driver is a handful of numbers per length band.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Kind, pattern, group that holds the secret, fewest characters of that group.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]

#: Candidates of the battery: long runs of base64 characters, either alphabet, with a digit and a letter among them.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"

#: Largest |z| that a test of the battery accepts; accepted share of false discoveries; bins of -log10 p, up to MOST.
REJECT, FALSE_SHARE, BINS, MOST = 3.5, 0.01, 120, 30.0

#: Length bands: powers of two from 16; longer tokens share the last. Score of words where a band has none.
BANDS, WORD_SCORE = 12, (12.0, 4.0)

MATCHES = "array<struct<start:int,stop:int,n:int,token:string>>"
SPAN = "array<struct<start:int,turn:int,stop:int,kind:string>>"

#: Elements that a running fold copies at a time; code points of a text's chunk.
BLOCK, CHUNK = 256, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element the fold (from 0) of those before it, by the associative `combine`.

    Folds that grow an array copy it at each step, so they run within blocks and over one value a block.
    """

    def folded(part: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), combine))
        return F.flatten(F.zip_with(blocks, folded(totals, F.lit(0)), folded))

    return let(values, lambda v: F.when(F.size(v) > BLOCK, let(cut(v), whole)).otherwise(folded(v, F.lit(0))))


def _located(text: Column, pattern: str, group: int) -> Column:
    """For each match in order: start, stop (code points), the length of `group`, and the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), found, lambda g, m: F.struct(g.alias("gap"), m.alias("token"), F.length(m).alias("n"), F.length(m).alias("width")))
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        pieces = F.zip_with(pieces, values, lambda p, v: F.struct(p["gap"].alias("gap"), p["token"].alias("token"), F.length(v).alias("n"), p["width"].alias("width")))
    place = lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["width"]).alias("stop"), p["n"].alias("n"), p["token"].alias("token"))
    return let(pieces, lambda ps: F.zip_with(ps, _before(F.transform(ps, lambda p: p["gap"] + p["width"]), lambda a, x: a + x), place))


def _matches(text: Column, kind: int) -> Column:
    name, pattern, group, least = KINDS[kind]
    # a text can only hold a long enough value if this finds one, and looking for it is far cheaper
    sure = pattern[: pattern.rindex("+")] + f"{{{least - 4 * (name == 'access')},}}" + pattern[pattern.rindex("+") + 1 :]
    # where the whole match counts it is a longest run, so asking for its length at once finds the same matches
    kept = F.filter(_located(text, pattern if group else sure, group), lambda m: m["n"] >= least)
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("turn"), m["stop"].alias("stop"), F.lit(name).alias("kind")))
    return F.when(text.rlike(sure), spans).otherwise(F.array().cast(SPAN))


def _tokens(text: Column) -> Column:
    return F.when(text.rlike(TOKEN), _located(text, TOKEN, 0))


def battery(token: Column) -> Column:
    """Struct of band, score (excess of chi-squared over its mean, in standard deviations), runs_z, serial_z of a token."""
    alphabet = F.when(token.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), 16.0).when(token.rlike(r"^[A-Z2-7]+$"), 32.0).when(token.rlike(r"^(?:[0-9a-z]+|[0-9A-Z]+)$"), 36.0).otherwise(64.0)
    # bound once: inside the fold over characters, the patterns would be tried again at each of them
    return let(F.struct(token.alias("token"), F.length(token).cast("double").alias("n"), alphabet.alias("letters")), lambda c: _tests(c["token"], c["n"], c["letters"]))


def _tests(token: Column, n: Column, letters: Column) -> Column:
    plain = F.when(letters < 64, F.lower(token)).otherwise(token)
    squares = F.aggregate(F.array(*[F.lit(c) for c in ALPHABET]), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(plain, c, F.lit(""))), 2.0))
    names = ("first", "last", "sum", "squares", "products", "above", "runs")
    zero = F.struct(*[F.lit(None).cast("double").alias(x) if x in names[:2] else F.lit(0.0).alias(x) for x in names])

    def step(acc: Column, v: Column) -> Column:
        started, high = acc["last"].isNotNull(), lambda x: x > letters / 2
        return F.struct(
            F.coalesce(acc["first"], v).alias("first"), v.alias("last"), (acc["sum"] + v).alias("sum"), (acc["squares"] + v * v).alias("squares"),
            (acc["products"] + F.when(started, acc["last"] * v).otherwise(0.0)).alias("products"), (acc["above"] + F.when(high(v), 1.0).otherwise(0.0)).alias("above"),
            (acc["runs"] + F.when(started & (high(acc["last"]) == high(v)), 0.0).otherwise(1.0)).alias("runs"),
        )

    def tests(s: Column) -> Column:
        mean = s["sum"] / n
        variance = s["squares"] - n * mean * mean
        lagged = s["products"] - mean * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * mean * mean
        expected = 2 * s["above"] * (n - s["above"]) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        band = F.least(F.greatest(F.floor(F.log2(n)) - 4, F.lit(0)), F.lit(BANDS - 1)).cast("int")
        return F.struct(
            band.alias("band"),
            ((letters * squares / n - n - (letters - 1)) / F.sqrt(2 * (letters - 1))).alias("score"),
            F.when(spread > 0, (s["runs"] - expected) / F.sqrt(spread)).otherwise(99.0).alias("runs_z"),
            F.when(variance > 0, lagged / variance * F.sqrt(n)).otherwise(99.0).alias("serial_z"),
        )

    values = F.transform(F.split(plain, ""), lambda c: F.position(c, F.lit(ALPHABET)).cast("double"))
    return let(F.aggregate(F.filter(values, lambda v: v > 0), zero, step), tests)


def _passes(c: Column | dict[str, Column]) -> Column:
    return (c["score"] <= REJECT) & (F.abs(c["runs_z"]) <= REJECT) & (F.abs(c["serial_z"]) <= REJECT)


def _normal(z: Column) -> Column:
    """Distribution function of the normal distribution, by a logistic approximation."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), -(1.5976 * z + 0.07056 * z * z * z))))


def thresholds(docs: DataFrame, text: str = "text") -> list[float]:
    """For each length band the largest score that counts as random; nothing passes where it is -inf.

    Words for the null distribution are the corpus's tokens of letters alone. The tests of all tokens are written once to
    the shared folder, in one pass over the texts.
    """
    words = r"(?<![A-Za-z0-9+/_-])[A-Za-z]{16,}(?![A-Za-z0-9+/_-])"
    whole, none = F.col(text), F.array().cast("array<string>")
    tagged = lambda tokens, plain: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(plain).alias("plain")))
    plain = F.when(whole.rlike(words), F.regexp_extract_all(whole, F.lit(words), F.lit(0))).otherwise(none)
    other = F.when(whole.rlike(TOKEN), F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0))).otherwise(none)
    tokens = docs.select(F.explode(F.concat(tagged(plain, True), tagged(other, False))).alias("t")).select("t.*")
    scratch = Scratch(docs.sparkSession)
    tests = scratch.keep(tokens.select("plain", battery(F.col("token")).alias("b")).select("plain", "b.*"), "tests")
    null = {r["band"]: (r["mean"], r["spread"]) for r in tests.where("plain").groupBy("band").agg(F.avg("score").alias("mean"), F.stddev("score").alias("spread"), F.count("*").alias("n")).where("n >= 30 and spread > 0").collect()}
    null = [null.get(b, WORD_SCORE) for b in range(BANDS)]
    mean, spread = F.array(*[F.lit(float(m)) for m, _ in null]), F.array(*[F.lit(float(s)) for _, s in null])
    scored = tests.where(~F.col("plain"))
    z = (F.col("score") - F.element_at(mean, F.col("band") + 1)) / F.element_at(spread, F.col("band") + 1)
    scored = scored.withColumn("p", F.when(_passes({k: F.col(k) for k in ("score", "runs_z", "serial_z")}), _normal(z)).otherwise(F.lit(1.0)))
    step = MOST / BINS
    level = F.least(F.lit(BINS - 1), F.floor(F.when(F.col("p") > 0, -F.log10("p")).otherwise(F.lit(MOST)) / step)).cast("int")
    table_ = scored.groupBy(level.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect()
    scratch.clear()
    tested, passed, cut = sum(r["n"] for r in table_), 0, None
    for r in table_:  # from the smallest p: the largest bin-end p with p <= share * rank / tests
        passed += r["n"]
        if r["bin"] and 10 ** (-r["bin"] * step) <= FALSE_SHARE * passed / tested:
            cut = 10 ** (-r["bin"] * step)
    if cut is None:
        return [float("-inf")] * BANDS
    return [m + s * _normal_quantile(cut) for m, s in null]


def _normal_quantile(p: float) -> float:
    """Inverse of _normal, by bisection."""
    low, high = -20.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        if 1 / (1 + exp(min(600.0, -(1.5976 * mid + 0.07056 * mid**3)))) < p:
            low = mid
        else:
            high = mid
    return low


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with column secrets: an array of (start, turn, stop, kind), by start, then kind in the order of KINDS.

    Start and stop are code points, stop exclusive. Spans of the patterns may overlap between kinds; spans of the battery
    (kind random) overlap none of those. A null text counts as empty and has none. Texts of any length and number of
    matches are searched whole. A column named secrets is replaced; other columns, repeated rows and row count stay. An
    empty table gives an empty one.
    """
    limits = thresholds(docs, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[_matches(whole, k) for k in range(len(KINDS))])
    out = docs.withColumn("secrets", base)
    if max(limits) > float("-inf"):
        limit = F.array(*[F.lit(x) for x in limits])
        random = lambda m: let(battery(m["token"]), lambda c: _passes(c) & (c["score"] <= F.element_at(limit, c["band"] + 1)))
        span = lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("turn"), m["stop"].alias("stop"), F.lit("random").alias("kind"))
        more = F.transform(F.filter(F.coalesce(_tokens(whole), F.array().cast(MATCHES)), random), span)
        out = out.withColumn("secrets", let(F.struct(F.col("secrets").alias("base"), more.alias("more")), lambda s: F.when(F.size(s["more"]) > 0, _apart(F.array_sort(F.concat(s["base"], s["more"])))).otherwise(F.array_sort(s["base"]))))
    else:
        out = out.withColumn("secrets", F.array_sort("secrets"))
    return out


def _apart(spans: Column) -> Column:
    """Sorted `spans` without those of the battery that overlap another kind's."""
    base = lambda s: s["turn"] < len(KINDS)

    def kept(all_: Column) -> Column:
        stops = _before(F.transform(all_, lambda s: F.when(base(s), s["stop"]).otherwise(0)), larger)
        # from the end: the next start of another kind is nearer the larger its distance to the largest number is
        starts = F.reverse(_before(F.reverse(F.transform(all_, lambda s: F.when(base(s), F.lit(2**31 - 1) - s["start"]).otherwise(0))), larger))
        sides = F.zip_with(stops, starts, lambda a, b: F.struct(a.alias("stop"), (F.lit(2**31 - 1) - b).alias("start")))
        marked = F.zip_with(all_, sides, lambda s, o: F.struct(s.alias("span"), (base(s) | ((o["stop"] <= s["start"]) & (o["start"] >= s["stop"]))).alias("stays")))
        return F.transform(F.filter(marked, lambda m: m["stays"]), lambda m: m["span"])

    return let(spans, kept)


def _cut_out(chunks: Column, start: Column, stop: Column) -> Column:
    """Code points from `start` up to `stop` of a text cut into chunks; only the chunks that it touches are read."""
    at = lambda n: F.coalesce(F.get(chunks, n), F.lit(""))
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(stop / CHUNK).cast("int")
    inside = F.substring(at(first), start % CHUNK + 1, stop - start)
    across = F.concat(F.substring(at(first), start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), stop % CHUNK))
    return F.when(first == last, inside).otherwise(across)


def _redacted(text: Column, secrets: Column, mark: str) -> Column:
    def rebuilt(c: Column) -> Column:
        before = _before(F.transform(c["secrets"], lambda s: s["stop"]), larger)
        pieces = F.zip_with(before, c["secrets"], lambda done, s: F.struct(done.alias("done"), s["start"].alias("start")))
        kept = F.transform(F.filter(pieces, lambda p: p["start"] >= p["done"]), lambda p: _cut_out(c["chunks"], p["done"], p["start"]))
        return F.array_join(F.concat(kept, F.array(_cut_out(c["chunks"], F.array_max(F.transform(c["secrets"], lambda s: s["stop"])), F.length(text)))), mark)

    return let(F.struct(secrets.alias("secrets"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks")), rebuilt)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in `text` replaced by `mark`; overlapping spans become one. Null texts stay null.

    n_chars, where it is a column, is counted again for texts that change. A column named secrets is kept as it is.
    """
    found = find_secrets(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text")
    changed = F.size("secrets") > 0
    out = found.select("row", F.when(changed, _redacted(F.col("text"), F.col("secrets"), mark)).otherwise(F.col("text")).alias("text"), changed.alias("changed"))
    value = lambda c: F.col("text") if c == text else F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col(f"row.`{c}`")) if c == "n_chars" else F.col(f"row.`{c}`")
    return out.select([value(c).alias(c) for c in docs.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda turn: F.size(F.filter("secrets", lambda s: s["turn"] == turn)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)],
        F.sha2(line(F.filter("secrets", lambda s: s["turn"] < len(KINDS))), 256).alias("base_sha256"),
        line(F.col("secrets")).alias("spans"),
    )
